"""Near-duplicate vectors by cosine: an exact comparison in tiles over PCA-ordered dimensions.

The vectors are turned to their principal axes, which changes no product. Then the leading dimensions say
most: a tile of products over the first of them, plus the product of the norms of the rest, bounds every
cosine of the tile. Pairs whose bound cannot reach the threshold stop there; the others go on to more
dimensions, and the last ones are decided in double precision on the given numbers.

The angle to the first axis is such a bound too: two vectors differ in it by at most the angle between them.
It orders the vectors into stripes, and only stripes that are near enough meet, one pair of stripes in a task.

Exact copies are one class from the start. A task returns a row per class, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalframe.llm.common import column, materialise
from signalframe.llm.links import components, forest

THRESHOLD = 0.95
STRIPES = 12  # of the angle, where that makes stripes of a size between these two
STRIPE_ROWS = (256, 131_072)  # the larger is 64 MB of 64 doubles
TILE = 1024
ENERGY = (0.4, 0.7)  # shares of the squared lengths after which a tile's pairs are bounded
MARGIN = 1e-4  # of the bounds, which are in single precision
SMALL = 8_000_000  # numbers: a rare length that has fewer is compared whole in one task


def _matrix(batch_column) -> np.ndarray:
    values = batch_column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(batch_column), -1).astype(np.float64)


def axes(vectors: DataFrame, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes as columns, share of the squared lengths up to each), from all vectors."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            x /= np.linalg.norm(x, axis=1)[:, None]
            total += x.T @ x
        i, j = np.divmod(np.arange(dimension * dimension), dimension)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "m": total.ravel()})

    summed = vectors.select("embedding").mapInArrow(moments, "i long, j long, m double")
    second = np.zeros((dimension, dimension))
    for r in summed.groupBy("i", "j").agg(F.sum("m").alias("m")).collect():  # dimension squared rows
        second[r["i"], r["j"]] = r["m"]
    values, found = np.linalg.eigh((second + second.T) / 2)
    values = np.maximum(values[::-1], 0)
    return found[:, ::-1].copy(), np.cumsum(values) / max(values.sum(), 1e-300)


class _Side:
    """Vectors of one stripe, in the order of their angle to the first axis."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, steps: list[int]) -> None:
        self.exact = x / np.linalg.norm(x, axis=1)[:, None]
        turned = self.exact @ turn
        self.order = np.argsort(np.arccos(np.clip(turned[:, 0], -1, 1)), kind="stable")
        self.exact, turned = self.exact[self.order], turned[self.order]
        self.angle = np.arccos(np.clip(turned[:, 0], -1, 1))
        rest = np.sqrt(np.maximum(np.cumsum((turned ** 2)[:, ::-1], axis=1)[:, ::-1], 0))
        rest = np.concatenate((rest, np.zeros((len(x), 1))), axis=1)
        # per step: its dimensions, and the norm of all that follow
        self.parts = [turned[:, a:b].astype(np.float32) for a, b in zip([0, *steps], steps)]
        self.rests = [rest[:, b].astype(np.float32) for b in steps]
        self.first = np.concatenate((self.parts[0], self.rests[0][:, None]), axis=1)


def tile_links(a: _Side, b: _Side, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (in a's and b's order) with a cosine of the threshold or more; each pair once."""
    reach = np.arccos(threshold) + MARGIN
    for i in range(0, len(a.angle), TILE):
        lo, hi = a.angle[i] - reach, a.angle[min(i + TILE, len(a.angle)) - 1] + reach
        for j in range(i if same else 0, len(b.angle), TILE):
            if b.angle[j] > hi or b.angle[min(j + TILE, len(b.angle)) - 1] < lo:
                continue
            x, y = np.nonzero(a.first[i: i + TILE] @ b.first[j: j + TILE].T >= threshold - MARGIN)
            x, y = x + i, y + j
            if same and i == j:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 1 << 17):
                u, v = x[at: at + (1 << 17)], y[at: at + (1 << 17)]
                product = np.einsum("ij,ij->i", a.parts[0][u], b.parts[0][v])
                for part_a, part_b, rest_a, rest_b in zip(a.parts[1:], b.parts[1:], a.rests[1:], b.rests[1:]):
                    product = product + np.einsum("ij,ij->i", part_a[u], part_b[v])
                    able = product + rest_a[u] * rest_b[v] >= threshold - MARGIN
                    u, v, product = u[able], v[able], product[able]
                near = np.einsum("ij,ij->i", a.exact[u], b.exact[v]) >= threshold
                yield u[near], v[near]


def _compare(left: pd.DataFrame, right: pd.DataFrame | None, turn: np.ndarray, steps: list[int], threshold: float) -> pd.DataFrame:
    """(cls, root, n): each class of two stripes that links, what it is joined to and how many rows it links to."""
    same = right is None
    a = _Side(np.stack(left["embedding"].to_numpy()).astype(np.float64), turn, steps)
    b = a if same else _Side(np.stack(right["embedding"].to_numpy()).astype(np.float64), turn, steps)
    names = np.concatenate([s["cls"].to_numpy()[o.order] for s, o in ([(left, a)] if same else [(left, a), (right, b)])])
    sizes = np.concatenate([s["copies"].to_numpy()[o.order] for s, o in ([(left, a)] if same else [(left, a), (right, b)])])
    shift = 0 if same else len(left)
    root, links, held, size = np.arange(len(names)), np.zeros(len(names), dtype=np.int64), [], 0
    for u, v in tile_links(a, b, same, threshold):
        v = v + shift
        np.add.at(links, u, sizes[v])
        np.add.at(links, v, sizes[u])
        held.append((u, v))
        size += len(u)
        if size > 1 << 20:
            root, held, size = forest(len(names), *(np.concatenate(x) for x in zip(*held)), root), [], 0
    if held:
        root = forest(len(names), *(np.concatenate(x) for x in zip(*held)), root)
    any_ = links > 0
    return pd.DataFrame({"cls": names[any_], "root": names[root[any_]], "n": links[any_]})


def class_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cls, root, n) over all pairs of classes (cls, embedding, copies); some rows for a class, or none."""
    spark = classes.sparkSession
    schema = "cls long, root long, n long"
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    turn, energy = axes(classes, size["d"])
    steps = sorted({min(size["d"], int(np.searchsorted(energy, share)) + 1) for share in ENERGY} | {size["d"]})
    first = [float(v) for v in turn[:, 0]]
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    product = F.aggregate(
        F.zip_with("embedding", F.array(*map(F.lit, first)), lambda v, w: v.cast("double") * w), F.lit(0.0), lambda s, v: s + v
    )
    angled = materialise(classes.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / norm)))))
    rows = min(max(size["n"] // STRIPES, STRIPE_ROWS[0]), STRIPE_ROWS[1])
    count = -(-size["n"] // rows)
    cuts = angled.approxQuantile("angle", [k / count for k in range(1, count)], 0.1 / count) if count > 1 else []
    reach = float(np.arccos(threshold)) + MARGIN
    bounds = spark.sparkContext.broadcast(np.unique(np.array(cuts)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bounds.value
        for batch in batches:
            angle = batch.column("angle").to_numpy()
            own, low, high = (np.searchsorted(edges, angle + x, side="right") for x in (0, -reach, reach))
            for k in range(int((high - own).max(initial=-1)) + 1):
                yield _sent(batch, own + k <= high, own, own + k, False)
            for k in range(1, int((own - low).max(initial=0)) + 1):
                yield _sent(batch, own - k >= low, own - k, own, True)

    def _sent(batch, which, i, j, right) -> pa.RecordBatch:
        at = np.flatnonzero(which)
        names = ["cls", "embedding", "copies"]
        return pa.RecordBatch.from_arrays(
            [pa.array(i[at].astype(np.int32)), pa.array(j[at].astype(np.int32)), pa.array(np.full(len(at), right))]
            + [batch.column(c).take(pa.array(at)) for c in names], names=["i", "j", "right", *names],
        )

    def compare(key, frame):
        left, right = frame[~frame["right"]], frame[frame["right"]]
        if key[0] != key[1] and not (len(left) and len(right)):
            return pd.DataFrame({"cls": [], "root": [], "n": []}).astype("int64")
        return _compare(left, None if key[0] == key[1] else right, turn, steps, threshold)

    kind = angled.schema["embedding"].dataType.simpleString()
    sent = angled.mapInArrow(send, f"i int, j int, right boolean, cls long, embedding {kind}, copies long")
    return sent.groupBy("i", "j").applyInPandas(compare, schema)


def _compare_whole(classes: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(cls, root, n) of all vectors of one length, without axes."""
    x = np.stack(classes["embedding"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    names, sizes = classes["cls"].to_numpy(), classes["copies"].to_numpy()
    root, links = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for i in range(0, len(x), TILE):
        for j in range(i, len(x), TILE):
            u, v = np.nonzero(x[i: i + TILE] @ x[j: j + TILE].T >= threshold - MARGIN)
            u, v = u[u + i < v + j] + i, v[u + i < v + j] + j
            for at in range(0, len(u), TILE):
                a, b = u[at: at + TILE], v[at: at + TILE]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[near], b[near]
                np.add.at(links, a, sizes[b])
                np.add.at(links, b, sizes[a])
                root = forest(len(x), a, b, root)
    any_ = links > 0
    return pd.DataFrame({"cls": names[any_], "root": names[root[any_]], "n": links[any_]})


def links_by_length(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`class_links` among the vectors of each length; the lengths that hold little share one job."""
    sized = classes.withColumn("d", F.size("embedding"))
    lengths = sized.groupBy("d").agg(F.count("*").alias("n")).where("n > 1")
    weight = F.col("n") * F.col("d")
    most = lengths.orderBy(weight.desc(), "d").limit(1).collect()
    if not most:
        return class_links(classes.limit(0), threshold)
    # the most common length, and others of more than SMALL numbers: as few as the table has room for
    large = sorted({r["d"] for r in most + lengths.where(weight > SMALL).collect()})
    rare = sized.where(~F.col("d").isin(large))
    out = rare.groupBy("d").applyInPandas(lambda x: _compare_whole(x, threshold), "cls long, root long, n long")
    for d in large:
        out = out.unionByName(class_links(sized.where(F.col("d") == d).drop("d"), threshold))
    return out


def _within_squares(v: Column) -> Column:
    """Vectors whose squares leave the range of doubles, times a power of two, which changes no cosine."""
    most = F.array_max(F.transform(v, F.abs))
    power = -F.floor(F.log2(most))
    half = F.floor(power / 2)  # in two steps, as the whole factor may leave the range too
    scaled = F.transform(v, lambda x: x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half))
    return F.when((most > 0) & ((most < 1e-100) | (most > 1e100)), scaled).otherwise(v)


def near_duplicates(
    vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
    dimension: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors with a cosine of `threshold` or more are linked. `n_links`: other rows linked directly, copies
    included; `component_id`: the smallest id reachable, its own included; `kept`: whether that is its own.

    Vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing and are their
    own component, as do those of another dimension than `dimension` where one is given. Without one,
    vectors of every length are compared with those of their length. A null id is never the smallest; a
    component of null ids has a null component_id, and such rows have a null `kept`.
    Repeated rows are copies; other columns are not read; no rows give no rows.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = vectors.select(column(id).cast("long").alias("vec_id"), column(embedding).alias("embedding"))
    usable = F.coalesce(finite, F.lit(False)) & (F.lit(True) if dimension is None else F.size(v) == dimension)
    if dict(base.dtypes)["embedding"] == "array<double>":
        v = _within_squares(v)
    base = base.select("vec_id", F.when(usable, v).alias("embedding"))
    classes = base.where("embedding is not null").groupBy("embedding").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies")
    )
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()))
    links = materialise(links_by_length(classes.select("cls", "embedding", "copies"), threshold))
    groups = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    per_class = links.groupBy("cls").agg(F.sum("n").alias("n"))
    known = classes.join(per_class, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    known = known.withColumn("group", F.coalesce("component", "cls"))
    smallest = known.groupBy("group").agg(F.min("first").alias("smallest"))
    known = known.join(smallest, "group").select("embedding", "copies", F.coalesce("n", F.lit(0)).alias("n"), "smallest")
    out = base.join(known, "embedding", "left")
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return out.select(
        "vec_id",
        F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
