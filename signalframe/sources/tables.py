"""Tabular sources and sinks with the checks the jobs rely on."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from signalframe.functions.values import clean
from signalframe.schemas import FEATURE_TABLE, FEATURES, PREDICTIONS, RECORD_METADATA, TARGET_NAMES


def read_record_metadata(spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = False) -> DataFrame:
    """The record metadata CSV, by column name and without inference; rows without a file are dropped.

    ``limit`` keeps the first records by key, before anything is read for them. ``multi_line`` is for
    files with line breaks inside quotes; such a file is read by one task.
    """
    wanted = {f.name: f.dataType for f in RECORD_METADATA}
    text = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    typed = text.select(*[
        (clean(F.col(n)).cast(t) if t.simpleString() in ("double", "bigint") else F.col(n)).alias(n)
        for n, t in wanted.items()
    ])
    return usable_metadata(typed, limit)


def usable_metadata(metadata: DataFrame, limit: int | None = None) -> DataFrame:
    first = metadata.orderBy("ecg_id").limit(limit) if limit is not None else metadata
    return first.filter(F.length("filename_lr") > 0)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def resolve_target(df: DataFrame, requested: str | None = None) -> str:
    if requested is not None:
        if requested not in df.columns:
            raise ValueError(f"Requested target column not found: {requested}")
        return requested
    for name in TARGET_NAMES:
        if name in df.columns:
            return name
    raise ValueError(f"Target column not found. Tried: {', '.join(TARGET_NAMES)}")


def check_feature_table(df: DataFrame, target: str) -> None:
    """All features present, target binary (missing labels are allowed)."""
    require_columns(df, [*FEATURES, target])
    wrong = df.filter(F.col(target).isNotNull() & ~F.col(target).cast("double").isin(0.0, 1.0)).limit(1).collect()
    if wrong:
        raise ValueError(f"Target must be binary 0/1. Found value: {wrong[0][target]}")


def read_feature_table(spark: SparkSession, path: str, target: str | None = None, fmt: str = "parquet") -> tuple[DataFrame, str]:
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
        known = {f.name: f.dataType for f in FEATURE_TABLE}
        df = raw.select(*[
            F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in raw.columns
        ])
    else:
        df = spark.read.format(fmt).load(path)
    name = resolve_target(df, target)
    check_feature_table(df, name)
    return df, name


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function from texts to its paths."""
    named = spark._jvm.org.apache.hadoop.fs.Path
    return named(path).getFileSystem(spark._jsc.hadoopConfiguration()), named


def _exchange(spark: SparkSession, staged: str, path: str, overwrite: bool) -> None:
    """Put the staged folder in the place of ``path`` by renaming; what stood there goes last."""
    system, named = _file_system(spark, path)
    old = None
    if system.exists(named(path)):
        if not overwrite:
            raise FileExistsError(f"There is a table already: {path}")
        old = named(f"{path}.old-{uuid.uuid4().hex}")
        if not system.rename(named(path), old):
            raise RuntimeError(f"Could not set the old table aside: {path}")
    if not system.rename(named(staged), named(path)):
        if old is not None:
            system.rename(old, named(path))
        raise RuntimeError(f"Could not move the new table to its place: {path}")
    if old is not None:
        system.delete(old, True)


def save_checked(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = True) -> int:
    """Save the table wholly or not at all, and return its rows; an empty one is an error.

    It is written beside its place and counted there; only when that is done and there are rows does it take
    the place of the old table, which no failure before that touches. (An observed count would save the look at
    the footers, but a session that has observed once can no longer apply a freshly fitted logistic model.)
    """
    spark, path = df.sparkSession, path.rstrip("/")
    system, named = _file_system(spark, path)
    if not overwrite and system.exists(named(path)):
        raise FileExistsError(f"There is a table already: {path}")
    staged, reader = f"{path}.new-{uuid.uuid4().hex}", spark.read
    try:
        (df.write.option("header", True).csv(staged) if fmt == "csv" else df.write.format(fmt).save(staged))
        rows = (reader.option("header", True).csv(staged) if fmt == "csv" else reader.schema(df.schema).format(fmt).load(staged)).count()
        if not rows:
            raise RuntimeError("Table is empty; nothing was saved.")
        _exchange(spark, staged, path, overwrite)
    finally:
        if system.exists(named(staged)):
            system.delete(named(staged), True)
    return rows


BUCKETS = 1024


def save_by_record(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write records so that those of one key hash lie in one file, as :func:`read_by_record` reads them.

    The samples are dealt out here, once; every later join or aggregation on ``record_id`` reads its share
    of them in place. A bucket should fit a task: choose so many that one holds a few GB at most.
    """
    spark, table = df.sparkSession, f"by_record_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, "record_id")
    dealt.write.format("parquet").bucketBy(buckets, "record_id").option("path", f"{path}/rows").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the catalogue's entry; the files stay
    layout = json.dumps({"buckets": buckets, "schema": df.schema.json()})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def read_by_record(spark: SparkSession, path: str) -> DataFrame:
    """Records that :func:`save_by_record` has written; Spark knows by which key they lie together."""
    layout = json.loads(spark.read.text(f"{path}/layout").first()["value"])
    table = f"by_record_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(layout["schema"])))
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (record_id) INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'"
    )
    return spark.table(table)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Scores and labels; patient and dataset are optional."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, ["y_true", "y_score"])
    known = {f.name: f.dataType for f in PREDICTIONS}
    return raw.select(*[
        (clean(F.col(c)).cast(known[c]) if c in ("y_true", "y_score") else F.col(c)).alias(c)
        for c in raw.columns
        if c in known
    ])


def save_metrics(report: DataFrame, path: str) -> None:
    """A report has one row per dataset, so one file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_documents(documents: DataFrame, path: str) -> None:
    """Nested report documents, one JSON line per record."""
    documents.write.mode("overwrite").json(path)


def union_datasets(spark: SparkSession, adapters: dict[str, Callable[[SparkSession, str], DataFrame]], paths: dict[str, str]) -> DataFrame:
    """Records of several datasets under one schema, with the dataset named on every row.

    An adapter is a function of session and path that returns a ``records`` frame.
    """
    frames = [adapters[key](spark, path).withColumn("dataset", F.lit(key)) for key, path in paths.items()]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole
