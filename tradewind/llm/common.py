"""Shared pieces of the corpus operators: text expressions, seeded hashes, staging.

Everything here is lazy DataFrame code except :func:`stage`, which writes a table
into the folder that the cluster shares, so that a lost executor costs a re-read and
not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A run of the six ASCII blanks; every other code point belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

#: Rows that one hash bucket of :func:`bucket_bits` holds on average.
BUCKET_ROWS = 512
HASH_BITS = 60


def lower_ascii(text: Column) -> Column:
    """A-Z only, so that the result does not depend on a locale."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The blank-separated words of a text as they stand; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_hash(*parts: Column) -> Column:
    """A 60-bit hash in [0, 2**60) of the parts as text; nulls are left out.

    MD5 rather than a faster hash because any SQL engine can repeat it.
    """
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def bucket_bits(rows: int) -> int:
    """How many leading hash bits give buckets of about BUCKET_ROWS rows (at most 2**18 buckets)."""
    return max(0, min(18, (max(1, rows) // BUCKET_ROWS).bit_length()))


def bucket(h: Column, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits)


def let(value: Column, use) -> Column:
    """Bind `value` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (a single machine, as in tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tradewind-"))
        found = _OWN[0]
    return found.rstrip("/")


def staged_dir(spark: SparkSession) -> str:
    """The folder of all that this application stages."""
    return f"{shared_dir(spark)}/tradewind-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{staged_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Remove all that this application has staged: to be called when the results are written, for results read from it."""
    drop_path(spark, staged_dir(spark))


def stage(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged folder that is not needed any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
