"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 128 * 1024 * 1024
POSTS = 2_000  # posts whose tokens are a task's share of a shuffle


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only once the row count and the bytes are known to be within bounds.

    Beyond them the frame is returned as it is and the join shuffles on its keys.
    """
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    facts = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if facts.n <= rows and facts.bytes <= BROADCAST_BYTES else df


def broadcast_if_bytes(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Same decision from a row count the caller already knows."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def parts_for(posts: DataFrame) -> int:
    """Number of partitions for the tokens of posts: what one task holds doesn't grow with the table."""
    return max(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-posts.count() // POSTS))
