"""What the operators share: tables in the shared folder, and text columns as bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset.

    One of our own is on this machine: only a local master may have it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and whole after the loss of an executor."""
    path = f"{shared_dir(df.sparkSession)}/pagewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """name, or a longer one that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Words of 64 bits in the table that tells touched rows, at most: some 16 MB, whatever the number of rows.
FILTER_WORDS = 1 << 19


def split_off(rows: DataFrame, key: Column, touched: DataFrame, words: int = FILTER_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the longs of touched's only column, rows whose key isn't), together all of rows.

    A table of bits of fixed size, one bit for each key modulo its length, goes out to the tasks. It never misses a key;
    the more keys there are, the more rows are taken for touched. What then shuffles is the first part alone.
    """
    at = lambda of: F.pmod(of, F.lit(64 * words))
    word = lambda of: F.shiftright(at(of), 6)
    bit = lambda of: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(of, F.lit(64)).cast("int"))
    of = F.col(touched.columns[0])
    of_word, of_bits = free(rows, "_word"), free(rows, "_bits")
    bits = F.broadcast(written(touched.groupBy(word(of).alias(of_word)).agg(F.bit_or(bit(of)).alias(of_bits)), "bits"))
    met = (word(key) == F.col(of_word)) & (F.col(of_bits).bitwiseAND(bit(key)) != 0)
    return rows.join(bits, met, "left_semi"), rows.join(bits, met, "left_anti")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_crc32(column: str = "doc_id") -> Column:
    """Unsigned CRC-32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose text column holds about `most` bytes, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held + size > most and row > start:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
