"""Sources and sinks: CSV import, tables with insert-and-cast, Arrow in and out, result hash."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, delimiter: str = ",", escape: str = '"', null: str = "", header: bool = False) -> DataFrame:
    """CSV with a declared schema (never inferred); an empty field is NULL."""
    return spark.read.schema(schema).options(sep=delimiter, escape=escape, nullValue=null, emptyValue=null, header=header, mode="FAILFAST", timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", null: str = "", header: bool = False) -> None:
    df.write.mode("overwrite").options(sep=delimiter, nullValue=null, header=header, timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path)


def cast_to(df: DataFrame, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """df's columns by position as the named columns of schema (NULL for the others), cast to its types."""
    names = columns or schema.fieldNames()
    if len(names) != len(df.columns):
        raise ValueError("as many values as columns are needed")
    given = {name: f"c{k}" for k, name in enumerate(names)}
    return df.toDF(*given.values()).select(*((F.col(given[f.name]) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def insert_into(df: DataFrame, path: str, schema: T.StructType, columns: list[str] | None = None) -> None:
    """INSERT ... SELECT: append with casts to the table's types."""
    cast_to(df, schema, columns).write.mode("append").parquet(path)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def write_arrow(df: DataFrame, path: str) -> None:
    """Arrow IPC files (*.arrow) in a new folder, one a partition, written by the tasks; `_files` names those that count.

    A task that runs twice leaves a file that `_files` doesn't name, so a lost executor does no harm.
    """
    schema = df.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _place(path)
        fs.create_dir(folder)
        name, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow", 0
        with fs.open_output_stream(f"{folder}/{name}") as out, pa.ipc.new_file(out, schema) as writer:
            for b in batches:
                writer.write_table(pa.Table.from_batches([b]).cast(schema))
                rows += b.num_rows
        yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "rows": pa.array([rows], pa.int64())})

    names = sorted(r["name"] for r in df.mapInArrow(run, "name string, rows long").collect())
    fs, folder = _place(path)
    fs.create_dir(folder)
    if not names:
        names = ["part-00000-empty.arrow"]
        with fs.open_output_stream(f"{folder}/{names[0]}") as out, pa.ipc.new_file(out, schema):
            pass
    with fs.open_output_stream(f"{folder}/_files") as out:
        out.write("\n".join(names).encode())


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Arrow IPC files: one file, or a folder that write_arrow wrote; a file is read by one task, batch by batch."""
    fs, place = _place(path)
    if fs.get_file_info(place).is_file:
        files = [place]
    else:
        with fs.open_input_stream(f"{place}/_files") as f:
            files = [f"{place}/{n}" for n in f.read().decode().split("\n")]
    with fs.open_input_file(files[0]) as f:
        schema = from_arrow_schema(pa.ipc.open_file(f).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _place(path)
        for names in batches:
            for name in names.column(0).to_pylist():
                with fs.open_input_file(name) as f:
                    reader = pa.ipc.open_file(f)
                    for k in range(reader.num_record_batches):
                        yield reader.get_batch(k)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files)).mapInArrow(run, schema)


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def dump_values(df: DataFrame, *columns: str) -> DataFrame:
    """df unchanged; every value of `columns` also goes to the worker's standard error, for debugging."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in columns:
                for v in b.column(b.schema.get_field_index(c)).to_pylist():
                    print(f"{c}: {v!r}", file=sys.stderr)
            yield b

    return df.mapInArrow(run, df.schema)


def result_hash(df: DataFrame) -> str:
    """MD5 over all values, whatever the row order; hashing is distributed, one row comes back."""
    text = F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in sorted(df.columns)))
    n, total = df.select(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return hashlib.md5(f"{n}:{total}".encode()).hexdigest()


def tracked(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df and an observation of its row count, filled when df is used."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen
