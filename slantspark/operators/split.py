"""Deterministic train/test splits M1 and M2.

The bucket is a hash of the id and the seed, so the split is the same under
any partitioning or executor loss (``randomSplit`` depends on partition
layout) and is reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def bucket(id_col: str | Column, seed: int = DEFAULT_SEED) -> Column:
    """0..99 from the first 32 bits of md5('<id>:<seed>')."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.pmod(F.conv(h, 16, 10).cast("bigint"), F.lit(100))


def train_test_split(df: DataFrame, id_col: str, test_percent: int = 20, seed: int = DEFAULT_SEED
                     ) -> tuple[DataFrame, DataFrame]:
    """M1: (train, test); test holds the rows whose bucket < ``test_percent``."""
    b = bucket(id_col, seed)
    return df.where(b >= test_percent), df.where(b < test_percent)


def train_eval_split(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """M2: one 90/10 split (the reference draws two unrelated ones; quirk Q6 fixed)."""
    return train_test_split(df, id_col, 10, seed)
