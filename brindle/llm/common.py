"""Shared plumbing of the training-data operators: shared storage, Arrow batches, tokenizer files."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Rows that one Python step works on at a time; long texts make shorter slices.
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on every machine (they are installed, never copied here)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; where its scan has fewer parts than there are cores (a small file), its rows are dealt over the cores."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores else docs


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/brindle-{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Tables in the shared folder that this process made and hasn't deleted, by application, oldest first.
_made: dict[str, list[str]] = {}
_PATH = "_brindle_path"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the loss of any executor."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    made = _made.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)


def drop_table(df: DataFrame) -> None:
    """Deletes a table that materialize wrote, once nothing reads it any more."""
    if path := getattr(df, _PATH, None):
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list]:
    """Deletes what was materialized inside, but for the tables that are put into the list."""
    before, keep = set(_made.get(spark.sparkContext.applicationId, [])), []
    try:
        yield keep
    finally:
        kept = {getattr(t, _PATH, None) for t in keep}
        for path in [p for p in _made.get(spark.sparkContext.applicationId, []) if p not in before and p not in kept]:
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators left in the shared folder; results that read them are gone too."""
    for path in list(_made.get(spark.sparkContext.applicationId, [])):
        _delete(spark, path)


def materialize_counted(df: DataFrame, tag: str, *more: Column) -> tuple[DataFrame, dict]:
    """As materialize; also the number of rows (and further aggregates), observed by the writing job itself."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), tag)
    return out, seen.get


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that no slice holds much more than SLICE_BYTES of `column`."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + SLICE_BYTES, side="left")) + 1
        to = max(at + 1, min(to, at + SLICE_ROWS, n))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Returns memory that Arrow's pool and the C library hold unused; an idle Python worker would keep it beside the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Step) -> Step:
    """The step for mapInArrow, which gives memory back when its task ends."""

    @wraps(run)
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return step


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Python strings of a column; null counts as empty."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class WordCache:
    """Hashes of words that a worker remembers, up to about `most` bytes; then it starts anew (one text's words always fit)."""

    def __init__(self, hash_one: Callable[[Any], int], most: int = 32 << 20):
        self.hash_one, self.most, self.held = hash_one, most, 0
        self.known: dict[Any, int] = {}

    def __call__(self, words: list) -> np.ndarray:
        known = self.known
        new = {*words}.difference(known)
        if new:
            size = sum(map(len, new)) + 160 * len(new)  # key, number and slot
            if self.held + size > self.most and known:
                known.clear()
                self.held, new = 0, {*words}
                size = sum(map(len, new)) + 160 * len(new)
            self.held += size
            for w in new:
                known[w] = self.hash_one(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
