"""What the corpus operators share: work folders, written tables and row keys.

Every operator selects the columns it needs first, so further columns of the input, whatever their names,
never reach its plan. Internal names start with ``__ls_``.
"""

from __future__ import annotations

import gc
import os
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.session import shared_folder, ship

#: Stands for a null id: it sorts before every other id.
NULL_ID = -(2**63)


class Work:
    """Written tables of one call, in a folder of their own below the shared folder.

    A table is a cut in the lineage that outlives any executor. ``drop`` removes a table that nothing reads any
    more; what the returned DataFrame still reads stays, for the cluster's clean-up of the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str, at: str | None = None):
        """at: a folder that outlives the call, in place of one below the shared folder."""
        ship(spark)
        self.spark, self.at = spark, at or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def note(self, name: str, text: str) -> None:
        """Writes a small text."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def names(self) -> list[str]:
        """What lies in the folder."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def tidy(self) -> None:
        """Lets Spark drop the shuffle files of finished steps: it does so once their plans are garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def id_key(column: str = "doc_id") -> Column:
    """The id as a long; null as NULL_ID."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as one struct, so that their names meet no other) with __ls_k and __ls_t of keyed()."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_key().alias("__ls_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__ls_t"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, __ls_k (id_key) and __ls_t, a hash of the text: rows that agree in both are copies of a row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select("doc_id", "text", id_key().alias("__ls_k"), F.xxhash64("text").alias("__ls_t"))


def tokenizer_file(name: str) -> str:
    """A path as it is; a bare name from the installed public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column without nulls as one byte array and its n + 1 offsets, without copies."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]] if len(at) else bytes_, at - (at[0] if len(at) else 0)
