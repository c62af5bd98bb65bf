"""What the operators share: reading texts, let-bindings for nested lambdas, and materialised steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_dir

#: White space of the contracts: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: An Arrow batch of whole texts handed to Python; few rows, as one text may be long.
ARROW_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it for ``body``; plain re-use of an expression inside a lambda evaluates it again for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column, separators: str = SPACE) -> Column:
    return F.array_remove(F.split(text, separators), "")


def upto(n: Column) -> Column:
    """0 .. n-1 as an array; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def running(values: Column, add, start: Column, block: int = 64) -> Column:
    """For each element what ``add`` makes of all elements before it, from ``start`` on. An array that grows in a fold is copied
    at each step; here elements are added up in blocks, and blocks in blocks of blocks, so a step costs the same at any length."""
    upto_ = lambda n: F.sequence(F.lit(0), n)
    total = lambda xs: F.aggregate(xs, start, add)
    blocks = lambda xs: F.transform(upto_(F.floor(F.size(xs) / block).cast("int")), lambda b: total(F.slice(xs, b * block + 1, F.lit(block))))
    heads = lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, F.lit(1), i)))

    def within(xs, before):
        return F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, i - i % block + 1, i % block), F.get(before, F.floor(i / block).cast("int")), add))

    return let(values, lambda xs: let(blocks(xs), lambda ys: let(within(ys, heads(blocks(ys))), lambda before: within(xs, before))))


def doc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, by ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


@contextmanager
def session_conf(spark: SparkSession, **settings: object) -> Iterator[None]:
    """Settings of the session for as long as a job runs (``__`` stands for a dot); what was set before comes back."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialized(df: DataFrame, label: str, arrow_rows: int = ARROW_ROWS, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and survives lost executors.

    While it is written, a batch handed to Python has ``arrow_rows`` rows at most (a row may be a long text), and when it is
    written the shuffles behind it give their disk back. ``discard`` removes the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=arrow_rows, spark__sql__classic__shuffleDependency__fileCleanup__enabled=True):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of materialised tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Rows (a column that names them, text) in groups of ``size`` bytes or somewhat more: the names, the texts' bytes one after
    the other, and where each text begins."""

    def joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        names, texts = (rows.column(k).chunk(0) for k in (0, 1))
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        return names, data, (offsets - offsets[0])[:-1]

    held, have = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            have += batch.column(1).nbytes
        if have >= size:
            yield joined(held)
            held, have = [], 0
    if held:
        yield joined(held)


def with_hot_rows_broadcast(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, share: int = 1000) -> DataFrame:
    """Left join on ``key`` that a hot key cannot skew.

    ``right`` has unique keys with the number of left rows of each (``weight``). At most ``share`` keys can own more than
    ``total / share`` rows, so those fit a broadcast of proven size; left rows of such keys get a key of their own for the
    shuffled join and so spread evenly.
    """
    rest = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) * share > F.lit(total)).select(F.col(key).alias("_hk"), F.struct(*rest).alias("_hot"))
    cold = right.where(F.col(weight) * share <= F.lit(total)).select(F.col(key).cast("string").alias("_ck"), F.struct(*rest).alias("_cold"))
    first = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    salted = first.withColumn("_jk", F.when(F.col("_hk").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("#"), F.rand(7).cast("string"))))
    joined = salted.join(cold, F.col("_jk") == F.col("_ck"), "left").withColumn("_r", F.coalesce("_hot", "_cold"))
    return joined.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])
