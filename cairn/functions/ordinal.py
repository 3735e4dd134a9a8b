"""Ordering helpers that never funnel a whole table or a hot group into one task.

* ``global_ordinal`` numbers rows 1..N in a total order.  A plain
  ``row_number() over (order by ...)`` moves every row into one partition; here
  the rows are range-partitioned, numbered inside each partition, and shifted
  by the row counts of the partitions before them (a table with one row per
  partition, so its size is bounded by the partition count).
* ``group_ordinal`` numbers rows inside groups that may be arbitrarily large
  (a store holding a third of all files) from the global ordinal.
* ``top_k`` keeps the first k rows per group.  Spark 4 plans the
  ``row_number() <= k`` filter with a partial ``WindowGroupLimit`` before the
  shuffle, so at most k rows per group leave each map task.
* ``ordered_concat`` joins strings per group in order, pre-concatenating
  fixed-size runs in parallel first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import written

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_ordinal(df: DataFrame, order_cols: Sequence, name: str = "ordinal",
                   num_partitions: int | None = None) -> DataFrame:
    """Append a 1-based ordinal in ``order_cols`` order (make it total with a unique key).

    The range-partitioned rows are written once with their partition and place in it;
    both the counts per partition and the rows come from that table.  (Two reads of
    the shuffle itself may sample different range bounds, since column pruning gives
    them different inputs, and then disagree about which partition a row is in.)
    """
    order = _cols(order_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order)
                       .sortWithinPartitions(*order)
                       .withColumn("_mid", F.monotonically_increasing_id())
                       .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
                       .withColumn("_local", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1))
                       .drop("_mid"), "ordinal")
    # One row per partition: bounded by the partition count, never by the data.
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_offset"))
    return (ranged.join(F.broadcast(offsets), "_pid", "left")
                  .withColumn(name, F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_local") + 1)
                  .drop("_pid", "_local", "_offset"))


def group_ordinal(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                  name: str = "ordinal") -> DataFrame:
    """1-based ordinal within each group, safe for groups of any size."""
    numbered = global_ordinal(df, list(group_cols) + list(order_cols), "_g")
    # a written table, so that AQE can split the join on a hot group
    starts = written(numbered.groupBy(*group_cols).agg(F.min("_g").alias("_start")), "group_starts")
    return (numbered.join(starts, list(group_cols))
                    .withColumn(name, F.col("_g") - F.col("_start") + 1)
                    .drop("_g", "_start"))


def nth(df: DataFrame, order_cols: Sequence, n: int) -> DataFrame:
    """The row with ordinal ``n`` (1-based; negative counts from the end); none if there is none."""
    numbered = global_ordinal(df, order_cols, "_ordinal")
    wanted = F.lit(n) if n > 0 else numbered.agg(F.max("_ordinal") + 1 + n).scalar()
    return numbered.filter(F.col("_ordinal") == wanted).drop("_ordinal")


def top_k(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, k: int,
          rank_name: str = "rank") -> DataFrame:
    """First ``k`` rows per group in ``order_cols`` order, numbered 1..k."""
    w = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols))
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= k)


def ordered_concat(df: DataFrame, group_cols: Sequence[str], order_col: str, value_col: str,
                   sep: str = "", out: str = "text", run: int = 256, count: str | None = None) -> DataFrame:
    """Concatenate ``value_col`` per group in ``order_col`` order with ``sep``; ``count`` names a
    column for the number of rows.

    Runs of ``run`` consecutive order values are joined first (in parallel,
    spread over the hot group's rows), then the runs per group.
    """
    def joined(items: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(items), lambda x: x["v"]), sep)

    pieces = (df.withColumn("_run", F.floor(F.col(order_col) / F.lit(run)))
                .groupBy(*group_cols, "_run")
                .agg(joined(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                    F.col(value_col).alias("v")))).alias("_piece"),
                     F.count(F.lit(1)).alias("_rows")))
    total = [F.sum("_rows").alias(count)] if count else []
    return (pieces.groupBy(*group_cols)
                  .agg(joined(F.collect_list(F.struct(F.col("_run").alias("o"),
                                                      F.col("_piece").alias("v")))).alias(out), *total))
