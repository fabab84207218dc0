"""Exact ranking and size-checked materialisation.

``rank_by`` gives every row of a table its 0-based position in a total order
without a window over the whole table (which Spark runs in one task): the
table is range-partitioned and sorted, each row gets a partition-local index,
and a prefix sum over the per-partition counts (one row per partition) turns
the local index into the global rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import cut_lineage, scratch_path

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def rank_by(df: DataFrame, *order: Column, rank_col: str = "rank") -> DataFrame:
    """Add ``rank_col`` (long, from 0) by the total order ``order``.

    The order must be total (end with a unique key) for the rank to be
    deterministic.  Cost: one distributed sort plus one reliable checkpoint of
    the sorted table; no row ever leaves its partition for the ranking.
    """
    mid = "__wl_mid"
    s = cut_lineage(df.orderBy(*order).withColumn(mid, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(mid), _LOCAL_BITS)
    local = F.col(mid).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # One row per partition of ``s``: bounded by the partition count.
    sizes = s.groupBy(part.alias("__wl_p")).agg(F.count(F.lit(1)).alias("__wl_n"))
    before = Window.orderBy("__wl_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__wl_p", F.coalesce(F.sum("__wl_n").over(before), F.lit(0)).alias("__wl_off"))
    out = s.join(F.broadcast(offsets), part == F.col("__wl_p"))
    return out.withColumn(rank_col, F.col("__wl_off") + local).drop(mid, "__wl_p", "__wl_off")


def top_k(df: DataFrame, k: int, *order: Column, rank_col: str = "rank") -> DataFrame:
    """Rows of rank < k in the total order ``order``, with their rank."""
    return rank_by(df, *order, rank_col=rank_col).filter(F.col(rank_col) < k)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared scratch folder and read it back.

    Used for lexicons, vocabularies and vector tables that are joined many
    times: lineage is cut, and the planner sees the table's real size on disk,
    so the broadcast decision (``autoBroadcastJoinThreshold``) is made on a
    measured size instead of a guess; larger tables fall back to a shuffle
    join with AQE skew handling.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
