"""Helpers shared by the document operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.sources.files import Files

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(df[column], F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: ``spark.checkpoint.dir``; a folder of its own only where executors are threads."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not configured:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="chronofold-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
    return (configured or current.get()).rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the session's JVM ends, if nothing deletes it before."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)  # only what exists can be marked
    files.deleteOnExit(path)
    return folder


class Cuts:
    """Tables written between the steps of an operator to the shared folder, so that a lost executor costs
    nothing upstream; the shuffle files behind a table go once it is written, and the table with ``free``."""

    #: While a table is written; rows hold whole sets of shingles, so Python gets few of them at a time.
    SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.number = spark, own_folder(spark, "cut"), count()
        self.files, self.paths = Files(spark, self.folder), {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path, conf = f"{self.folder}/{next(self.number)}", self.spark.conf
        before = {k: conf.get(k, None) for k in self.SETTINGS}
        try:
            for k, v in self.SETTINGS.items():
                conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def free(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for t in tables:
            self.files.delete(self.paths.pop(id(t))[0])


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are on shared storage, so a lost executor costs nothing upstream."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: A key with more than one in ``HOT`` of all rows is split over ``SALTS`` tasks; there are fewer than ``HOT`` such keys.
HOT, SALTS, FEW = 512, 64, 250


def hot_keys(counts: DataFrame, keys: list[str], total: int, n: str = "count") -> DataFrame | None:
    """Of a table of rows per key, the keys too frequent for one task: fewer than ``HOT`` whatever the input."""
    if total <= FEW:
        return None
    return counts.filter(F.col(n) > max(FEW, total / HOT)).select(*keys)


def spread(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row per key; rows of hot or null keys are dealt out by ``by`` as well."""
    if hot is None:
        return rows.join(table, keys, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    some = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    nulls = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot") | nulls, some).otherwise(0)).drop("_hot")
    salts = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(0))
    copies = table.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


#: Bits of the map in ``Flags``: what is broadcast is at most this many, 4 MiB, however many ids there are.
FLAG_BITS, FLAG_PIECE = 1 << 25, 1 << 15


class Flags:
    """A bit map of hashed ids, built and read with SQL functions: rows whose bit is not set hold none of the ids,
    so that only the others need to move to a join.  With very many ids all bits are set, and all rows move."""

    def __init__(self, ids: DataFrame, column: str) -> None:
        at = self._place(F.col(column))
        pieces = ids.select((at / FLAG_PIECE).cast("int").alias("_piece"), (at % FLAG_PIECE).alias("_bit"))
        # Dealt out before they are gathered: a bit moves as a number, not as a piece for each task.
        self.pieces = F.broadcast(pieces.repartition("_piece").groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits")))

    @staticmethod
    def _place(key: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(FLAG_BITS))

    def mark(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows with a column ``_flag``: false only if the id is none of those given."""
        at = self._place(F.col(column))
        rows = rows.withColumns({"_piece": (at / FLAG_PIECE).cast("int"), "_bit": (at % FLAG_PIECE).cast("int")})
        byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.getbit(byte, (F.col("_bit") % 8).cast("int")) > 0
        return rows.join(self.pieces, "_piece", "left").withColumn("_flag", F.coalesce(bit, F.lit(False))).drop("_piece", "_bit", "_bits")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, whatever the optimizer merges or pushes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fenced(value: Column) -> Column:
    """The value, as a column that no filter is pushed below and no projection merged with.

    The comparison is always true; being non-deterministic it only stops the optimizer from
    copying a costly expression to every place that reads it.
    """
    return F.when(F.rand(0) >= 0, value)


def whole(df: DataFrame) -> Column:
    """A row's own columns as one struct, out of the way of any name used beside it."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def unpacked(df: DataFrame, columns: list[str], row: str = "row", **replaced: Column) -> DataFrame:
    """The columns of a row kept by ``whole``, some of them replaced."""
    return df.select(*[replaced[c].alias(c) if c in replaced else F.col(row)[c].alias(c) for c in columns])
