"""Shared plumbing: tables, shared scratch folders and Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import remove, scratch, ship

#: Rows that an operator turns at once. Spark closes an Arrow batch at spark.sql.execution.arrow.maxBytesPerBatch
#: (64 MB unless set) or its own number of rows, and no batch is smaller than one row: a task holds so many bytes
#: of text, or one text.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; the path may be a file, a folder or any file system Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/concordia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no plan needs any more: rounds of a loop leave nothing behind."""
    for df in tables:
        remove(df.sparkSession, df._written_at)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by their quoted names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def join_unique(rows: DataFrame, unique: DataFrame, key: str, share: int = 1024, wide: bool = False) -> DataFrame:
    """rows left joined to a table that has each key once; rows must be a stored table.

    Keys that hold at least one in `share` of the rows, at most `share` of them whatever the input, are broadcast;
    the others are joined by shuffle, where none is large. Null keys match nothing and are not shuffled. With wide, the rows of `unique` are larger than
    their files tell, and none but these are broadcast, whatever Spark's threshold.
    """
    least = max(2, -(-rows.count() // share))
    frequent = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(key)
    hot = materialize(frequent.join(unique, key), "hot")
    named = F.col(key).isNotNull()
    others = unique.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = rows.filter(named).join(F.broadcast(hot.select(key)), key, "left_anti").join(others.hint("merge") if wide else others, key, "left")
    return rest.unionByName(rows.filter(named).join(F.broadcast(hot), key)).unionByName(rows.filter(~named), allowMissingColumns=True)


def map_batches(df: DataFrame, start: Callable[[], Callable], schema: str) -> DataFrame:
    """Run start() once a task; what it returns turns one RecordBatch into an iterable of RecordBatches."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                yield from each(batch.slice(first, BATCH_ROWS))
        if hasattr(each, "finish"):
            yield from each.finish()

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, start: Callable[[], Callable]) -> DataFrame:
    """The rows of df(text) whose text passes, with all columns whatever their names. start() gives what turns
    UTF-8 texts (null as empty) into a list of booleans."""
    at = df.columns.index("text")
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])

    def begin():
        passes = start()

        def each(batch):
            yield batch.filter(pa.array(passes([(t or "").encode() for t in batch.column(at).to_pylist()]), pa.bool_()))

        return each

    return map_batches(plain, begin, plain.schema).toDF(*df.columns)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})


class Shared:
    """A broadcast value, and what a Python worker builds of it: kept between tasks, only the latest two."""

    _built: dict = {}

    def __init__(self, spark: SparkSession, value):
        self.key, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.sent.value

    def build(self, make: Callable):
        if (self.key, make) not in Shared._built:
            while len(Shared._built) >= 2:
                Shared._built.pop(next(iter(Shared._built)))
            Shared._built[self.key, make] = make(self.sent.value)
        return Shared._built[self.key, make]


def lower_ascii_words(data: bytes) -> list[bytes]:
    """A-Z in lower case, split at runs of x20 and x09-x0D: what bytes.lower and bytes.split do."""
    return data.lower().split()
