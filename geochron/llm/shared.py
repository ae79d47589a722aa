"""What the operators share: folds, tables, and places for their own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, new_path, passing_tables, shared_dir, written

__all__ = ["discard", "fold_of", "free_names", "new_path", "passing_tables", "shared_dir", "table", "written"]


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as the table has columns called so (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
