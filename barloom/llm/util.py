"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.joins import broadcast_up_to  # noqa: F401  for the operators of this package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much work each: read from fewer splits than there are cores (a few small files), it is dealt out first."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


#: Short names of the types in the schemas of this package.
TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def fields(**kinds: str | T.DataType) -> T.StructType:
    """A struct type by field name, usable before any session exists."""
    return T.StructType([T.StructField(name, TYPES.get(kind, kind) if isinstance(kind, str) else kind) for name, kind in kinds.items()])


def hash_number(text: Column, digits: int) -> Column:
    """The first ``digits`` hexadecimal digits of the md5 of a string, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it the name of no column of ``df``."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_or_pieces(text: str, most: int, pieces: int = 8) -> Column:
    """A text of at most ``most`` characters as it is; of a longer one so many characters in ``pieces`` parts spread evenly over it, a line each."""
    length, part = F.length(text), most // pieces
    spread = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substring(F.col(text), (k * (length - part) / (pieces - 1)).cast("int") + 1, F.lit(part)))
    return F.when(length <= most, F.col(text)).otherwise(F.array_join(spread, "\n"))
