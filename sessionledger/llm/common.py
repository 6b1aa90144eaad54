"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task orders at a time where a rank is computed block by block.
BLOCK_ROWS = 20_000
#: Rows of a join's small side that may be broadcast.
SENT_ROWS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def hash60(*cols: Column) -> Column:
    """A uniform number below 2^60 from the first 15 hex digits of an MD5, the same in any SQL engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("~")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def blocks_for(n_rows: int) -> int:
    return n_rows // BLOCK_ROWS + 1


def sent(small: DataFrame) -> DataFrame:
    """``small`` marked for broadcast if it is counted below a limit; else the join shuffles."""
    return F.broadcast(small) if small.count() <= SENT_ROWS else small
