"""Helpers of the corpus operators: words, row-wise functions over Arrow batches, stored tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from signalframe.session import materialise, shared_dir

__all__ = ["BROADCAST_IDS", "column", "kept", "lower_ascii", "materialise", "rows", "shared_dir", "spaced_words", "without", "words"]

#: Rows that one call of a row function sees, in bytes of its text column.
SLICE_BYTES = 8 << 20

BROADCAST_IDS = 2_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def column(name: str):
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, id: str, dropped: DataFrame) -> DataFrame:
    """The rows whose id is not in `dropped` (column `_id`); rows with a null id stay.

    Up to BROADCAST_IDS ids are broadcast, about 64 MB, so that no text moves; more are joined by a shuffle.
    """
    dropped = materialise(dropped)
    small = dropped.count() <= BROADCAST_IDS
    return df.join(F.broadcast(dropped) if small else dropped, column(id).cast("long") == F.col("_id"), "left_anti")


def kept(name: str, make: Callable):
    """What `make` returned when this worker process first asked for it.

    Functions travel with each task by value, and a module's globals with them; so they are new in every
    task and must not hold what is costly to build.
    """
    store = sys.__dict__.setdefault("_signalframe_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, ASCII digits and non-ASCII characters, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "replace").translate(_WORD).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Runs of anything but blank and the control characters 9 to 13, A-Z lower-cased; null has none."""
    return lower_ascii(text).split()


def _slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * min(1.0, limit / max(batch.nbytes, 1))))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def rows(
    df: DataFrame,
    function: Callable,
    schema: str,
    limit: int = SLICE_BYTES,
    each_task: bool = False,
) -> DataFrame:
    """Map slices of the frame, given as lists by column, to slices of the result.

    A narrow operation: no row changes its partition and a lost executor costs its own tasks only.
    A slice holds about `limit` bytes, or one row where a row is larger. `function` takes a slice and
    yields results; with `each_task` it is called without arguments at the start of a task and returns
    such a function, which may keep what it counts in that task.
    """
    names = df.columns
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = function() if each_task else function
        for batch in batches:
            for part in _slices(batch, limit):
                for out in call(dict(zip(names, part.to_pydict().values()))):
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                    )

    # plain names, as a name with a dot cannot be handed over
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, kind)
