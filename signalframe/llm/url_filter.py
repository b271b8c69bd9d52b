"""URL filter: a blocked Bloom filter in front of an exact join, in DataFrame operations only.

Every url becomes a few keys: its canonical form and, for prefix rules, each of its host's suffixes with
each prefix of its path that has the length of some listed path. The listed keys are hashed into a blocked
Bloom filter: a row per block of eight 64-bit words, a key sets one bit in each word of one block. A url's
keys first meet their block; the few that pass meet the listed keys in an equi-join on the text, which
removes the false positives. So the wide join moves possible hits only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from signalframe.llm.common import column, materialise

WORDS = 8  # of 64 bits in a block, one bit of each is set by a key
BITS_PER_KEY = 16  # about one false positive in 1,500 keys
BROADCAST_BYTES = 32 << 20  # a filter beyond this is joined by a shuffle of distinct hashes

_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_ASCII)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading `www.` or `m.`, path without `.html` and closing slashes; no scheme, query, fragment.

    Null where the url has no host.
    """
    bare = F.regexp_replace(host(url), r"^(?:www|m)\.", "")
    trimmed = F.regexp_replace(F.regexp_replace(path(url), r"\.html$", ""), r"/+$", "")
    return F.when(host(url) != "", F.concat(bare, trimmed))


def _host_suffixes(name: Column) -> Column:
    labels = F.split(name, r"\.", -1)
    return F.when(name == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def keys(url: Column, path_lengths: Column) -> Column:
    """The keys a listed entry may have in order to hit the url: `rule:host/path` and `page:canonical`.

    A text that is listed must begin with its path's slash, so prefixes of length 0 do not arise.
    """
    names, whole = _host_suffixes(host(url)), path(url)
    heads = F.transform(
        F.filter(path_lengths, lambda n: n <= F.length(whole)), lambda n: F.substr(whole, F.lit(1), n)
    )
    rules = F.flatten(F.transform(names, lambda h: F.transform(heads, lambda p: F.concat(F.lit("rule:"), h, p))))
    page = F.filter(F.array(F.concat(F.lit("page:"), canonical(url))), lambda k: k.isNotNull())
    return F.array_distinct(F.concat(rules, page))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block, from eight hashes of the key."""
    second = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast(LongType()), F.pmod(F.shiftright(second, 6 * i), F.lit(64)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the blocked Bloom filter of the column `key`; combined before the shuffle."""
    bits = [b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))]
    return listed.select(_block(F.col("key"), blocks).alias("block"), *bits).groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    )


def possible(candidates: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The candidates (column `key`) whose bits are all set in their block; some are false positives."""
    hit = [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("key")))]
    small = blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES
    probed = candidates.withColumn("block", _block(F.col("key"), blocks))
    joined = probed.join(F.broadcast(filter_) if small else filter_, "block")
    return joined.where(reduce(Column.__and__, hit)).select(*candidates.columns)


def judge(pages: DataFrame, listed: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict, canonical and in_list to every row of `pages`.

    `rules`: verdict (allow or block), host, path (beginning with `/`). A rule fits its host and that
    host's subdomains, where the url's path starts with the rule's; the longest rule decides (of equally
    long ones the one that blocks, then the last in text order). `listed`: canonical urls to block, in a
    column `canonical`; they decide where no rule fits. Else the verdict is allow.

    Null urls and urls without `://` have an empty host and path and fit nothing. Repeated pages are judged
    alike and stay. Nulls and repetitions in the lists change nothing; empty tables give allow, or no rows.
    Input columns of the same names are replaced.
    """
    mine = ["host", "path", "rule", "verdict", "canonical", "in_list"]
    entries = rules.where("host <> '' and startswith(path, '/')").select(
        F.concat(F.lit("rule:"), F.translate("host", *_ASCII), F.col("path")).alias("key"),
        F.concat(F.translate("host", *_ASCII), F.col("path")).alias("rule"),
        F.col("verdict").alias("says"),
        F.length("path").alias("path_length"),
    )
    entries = entries.unionByName(
        listed.where("canonical is not null").select(
            F.concat(F.lit("page:"), F.col("canonical")).alias("key"),
            F.lit(None).cast("string").alias("rule"),
            F.lit("block").alias("says"),
            F.lit(None).cast("int").alias("path_length"),
        )
    )
    entries = materialise(entries.groupBy("key").agg(
        F.first("rule").alias("rule"), F.max("says").alias("says"), F.first("path_length").alias("path_length")
    ))
    size = entries.agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("path_length")).alias("lengths")
    ).first()  # distinct lengths of paths: as many as a path has characters, at most
    blocks = max(1, -(-size["n"] * BITS_PER_KEY // (64 * WORDS)))
    lengths = F.array(*[F.lit(n) for n in size["lengths"]]).cast("array<int>")

    # one row per distinct url, so a page that is repeated a billion times is looked up once
    urls = pages.select(column(url).alias("_url")).where("_url is not null").distinct()
    candidates = urls.select("_url", F.explode(keys(F.col("_url"), lengths)).alias("key"))
    hits = possible(candidates, bloom(entries, blocks), blocks).join(entries, "key")
    decided = hits.groupBy("_url").agg(
        F.max_by(F.struct("rule", "says"), F.when(F.col("rule").isNotNull(), F.struct(
            F.length("rule"), F.col("says") == "block", F.col("rule")))).alias("won"),
        F.max(F.col("rule").isNull()).alias("_in_list"),
    )
    kept = [column(c) for c in pages.columns if c not in mine]
    judged = pages.withColumn("_url", column(url)).join(decided, "_url", "left")
    in_list = F.coalesce("_in_list", F.lit(False))
    return judged.select(
        *kept,
        host(F.col("_url")).alias("host"),
        path(F.col("_url")).alias("path"),
        F.col("won.rule").alias("rule"),
        F.coalesce("won.says", F.when(in_list, "block").otherwise("allow")).alias("verdict"),
        canonical(F.col("_url")).alias("canonical"),
        in_list.alias("in_list"),
    )
