"""What the operators of this subpackage share: cutting lineage, column checks, words, identity of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder

#: A word: a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where it names none and all is one process, as in tests."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder: it survives the loss of executors and isn't computed again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` reduced to the named columns, so that other columns, whatever their names, can't clash."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def octets(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
