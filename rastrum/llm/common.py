"""Helpers that the text operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII space characters: 0x20 and 0x09 to 0x0D.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: One word, as a regular expression for Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_spaces(text: Column) -> Column:
    """text without its ASCII spaces. Plain replacements run at memory speed, unlike a regular expression."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the session names none and runs in this process alone, as in tests, it is a temporary folder; on a cluster
    that is an error, as no folder of this machine's own would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Tables:
    """Parquet tables in the shared folder, for rows of which later steps read a few columns; drop() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("parquet.enable.dictionary", "false").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables, and the shuffles of steps whose frames are gone, which Spark does when the driver's garbage is collected."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        self.spark._jvm.System.gc()


def as_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that names of an operator's own cannot clash with theirs."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns))


def text_key(text: str = "text") -> Column:
    """A 64-bit hash of the text; with the document's id it stands for the row, so that repeated ids do no harm."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


#: Bounds of a bit map: 4 KB to 16 MB.
MIN_BITS, MAX_BITS = 1 << 15, 1 << 27


def map_bits(n: int) -> int:
    """Bits of a map for n keys: 32 for each, within the bounds; a fuller map lets more other keys pass, and loses none."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (32 * max(n, 1) - 1).bit_length()))


class BitMap:
    """A bit map as rows of 4 KB that are broadcast to those they are held against; at most MAX_BITS / 8 bytes.

    It is made by Spark's bitmap aggregate, and unlike a literal it puts nothing into plans.
    """

    def __init__(self, keys: DataFrame, column: str, n: int):
        """keys: rows with a BIGINT column, about n different ones."""
        self.bits = map_bits(n)
        b = F.pmod(F.col(column), F.lit(self.bits))
        rows = keys.select(F.floor(b / 32768).cast("int").alias("_part"), F.pmod(b, F.lit(32768)).cast("bigint").alias("bit"))
        rows = rows.groupBy("_part").agg(F.bitmap_construct_agg("bit").alias("m"))
        # As 512 numbers of 64 bits, so that a look-up is compiled.
        longs = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("m", 8 * i + 1, F.lit(8))), 16, -10).cast("bigint"))
        self.rows = checkpoint(rows.select("_part", longs.alias("_map")))

    def flag(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """df with a column that is true where the key's bit is set: for every key given, and for a few others.

        The names _part, _map and _at are taken; df has none of them.
        """
        b = F.pmod(key, F.lit(self.bits))
        df = df.withColumns({"_at": F.pmod(b, F.lit(32768)).cast("int"), "_part": F.floor(b / 32768).cast("int")})
        df = df.join(F.broadcast(self.rows), "_part", "left")
        word = F.get("_map", F.shiftright("_at", 6))
        # Bytes of a map stand in order, bits of a byte from the lowest.
        bit = F.getbit(word, F.col("_at").bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56))) == 1
        return df.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_at", "_part", "_map")
