"""What the corpus operators share."""

from __future__ import annotations

import contextlib
import io
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts delete or split at: blank, and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
LAST_ID = 2**63 - 1


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; and Python workers of this session find this package where it isn't installed."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [ROOT, *paths]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for what must outlive an executor: the session's, or its own where none is set (in tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Steps of a plan that leave each row where its file has it.
IN_PLACE = {"Project", "Filter", "ColumnarToRow", "FileScan", "BatchScan", "Scan", "LocalTableScan", "Range", "Union", "Generate"}


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row, which tells apart rows with the same or no id.

    It follows the place of the row in its file split, so ``df`` must come straight from files (or a checkpoint): a plan
    that shuffles or calls Python could number rows differently when it runs again, and is refused.
    """
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        df.explain()
    steps = set(re.findall(r"^[\s:+|-]*(?:\*\(\d+\) )?([A-Z][A-Za-z]+)", told.getvalue().split("==")[-1], re.M))
    if others := steps - IN_PLACE:
        raise ValueError(f"rows are numbered by their place in files; write this table or checkpoint it first ({', '.join(sorted(others))})")
    return df.withColumn(name, F.monotonically_increasing_id())


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores after it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


V = TypeVar("V")


class Memo(Generic[V]):
    """What a worker found out about strings. It forgets all of it when it holds more than ``most`` bytes, about; long strings aren't kept."""

    def __init__(self, most: int = 24 << 20, longest: int = 64, each: int = 160):
        self.most, self.longest, self.each = most, longest, each
        self.held: dict[str, V] = {}
        self.bytes = 0

    def get(self, key: str, make: Callable[[str], V]) -> V:
        value = self.held.get(key)
        if value is None:
            value = make(key)
            self.put(key, value)
        return value

    def put(self, key: str, value: V, size: int = 0) -> None:
        if len(key) > self.longest:
            return
        self.bytes += self.each + 2 * len(key) + size
        if self.bytes > self.most:
            self.held.clear()
            self.bytes = self.each + 2 * len(key) + size
        self.held[key] = value


def portions(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists in ``column`` have at most ``most`` elements together, unless one row alone has more."""
    ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy())
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        stop = max(int(np.searchsorted(ends, before + most, side="right")), first + 1)
        yield batch.slice(first, stop - first)
        first = stop


def text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def strings(column: pa.Array) -> Iterator[str]:
    """The column's values one by one, null as empty; never all of a batch as Python objects at once."""
    for value in column:
        yield value.as_py() or ""


def frame(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def gather(values: np.ndarray, ends: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``taken`` of ``values`` one after another; run i is ``values[ends[i]:ends[i + 1]]``. And where each begins."""
    sizes = np.diff(ends)[taken]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(begins[-1]) + np.repeat(ends[:-1][taken] - begins[:-1], sizes)], begins
