"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from signalframe.llm import (
    bpe, decontamination, embedding_dedup, hard_negatives, licenses, packing, quality, ranked_search, secrets, sharding, simhash, toxicity,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file's content; read where the query is built, so tasks need no file."""
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the canonical urls of pages whose document (the number in the path) is labelled toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    number = F.regexp_extract(url_filter.path(F.col("url")), r"/([0-9]+)(?:\.html)?/*$", 1)
    numbered = pages.select(url_filter.canonical(F.col("url")).alias("canonical"), number.try_cast("long").alias("doc_id"))
    listed = numbered.join(toxic, "doc_id", "left_semi").select("canonical").distinct()
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filter.judge(pages, listed, rules).select("page_id", "host", "path", "rule", "verdict", "canonical", "in_list")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").where(~out)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)
    return packed.withColumn("length", F.col("length").cast("long"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), "contaminated",
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    label = lambda only: F.array_join(F.array_sort(F.array_distinct(F.transform(
        F.filter("detections", lambda d: d["base"]) if only else F.col("detections"), lambda d: d["label"]))), ",")
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        label(True).alias("base_labels"), label(False).alias("labels"), "score",
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "named")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").where(~out)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shuffle(small, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every seventh row the label is changed; every hundredth row is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), decoded=True)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_url_filter, op2_toxicity, op3_simhash, op4_packing, op5_embedding_dedup, op6_decontamination, op7_licenses, op8_secrets, op9_quality, op10_sharding,
    op11_hard_negatives, op12_bpe, op13_ranked_search,
)}

_FITS = " OR ".join(
    f"(r.path = '{path}' AND r.host = '{host}' AND (u.host = '{host}' OR ends_with(u.host, '.{host}')) AND starts_with(u.path, '{path}'))"
    for _, host, path in RULES
)

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TERMS = f"unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"

ORACLE: dict[str, str] = {
    "op1_url_filter": f"""
        WITH u AS (
          SELECT page_id, url,
                 coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages),
        c AS (
          SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www|m)\\.', '')
                    || regexp_replace(regexp_replace(path, '\\.html$', ''), '/+$', '') END AS canonical FROM u),
        listed AS (
          SELECT DISTINCT canonical FROM c
          WHERE try_cast(regexp_extract(path, '/([0-9]+)(?:\\.html)?/*$', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        r(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
        w AS (
          SELECT u.*, (SELECT max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict))
                       FROM r WHERE {_FITS}) AS won,
                 coalesce(u.canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL), false) AS in_list
          FROM c u)
        SELECT page_id, host, path, won.rule AS rule,
               coalesce(won.verdict, CASE WHEN in_list THEN 'block' ELSE 'allow' END) AS verdict, canonical, in_list FROM w
    """,
    "op5_embedding_dedup": """
        WITH RECURSIVE e AS (
          SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM e),
        l AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_inner_product(a.v, b.v) >= 0.95 * a.size * b.size),
        r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT node, l.b FROM r JOIN l ON l.a = r.reached),
        c AS (SELECT node AS vec_id, min(reached) AS component_id FROM r GROUP BY node)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
    """,
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        t AS (SELECT item_id, {_WORDS} AS w, least(10, len({_WORDS})) AS n FROM benchmark),
        i AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM t WHERE n > 0)),
        s AS (SELECT DISTINCT n FROM i),
        p AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
        h AS (SELECT doc_id, item_id, n, k FROM p JOIN i USING (n, words)),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM h) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_hard_negatives": """
        WITH e AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
          FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
    "op13_ranked_search": f"""
        WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents),
        p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
        s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
        m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n, s),
        q AS (SELECT item_id, {_TERMS} AS term FROM benchmark),
        c AS (SELECT item_id, term, count(*) AS q FROM q GROUP BY ALL),
        r AS (
          SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM c JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM r QUALIFY rank <= 20
    """,
}
