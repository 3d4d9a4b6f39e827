"""Windows over groups that may hold most of all rows: such a group is parted into ranges of its order, each with some rows of its neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewell.sources.files import cut

#: Rows from which on a group is parted, and rows of a range aimed at.
LARGE, RANGE = 1_000_000, 250_000


def with_neighbours(rows: DataFrame, group: str, order: list[str], halo: int, add: Callable[[WindowSpec], dict[str, Column]], large: int | None = None) -> DataFrame:
    """rows with add(w)'s columns, w being the window of each group; they may look at `halo` rows on either side at most.

    Groups of up to `large` rows go the ordinary way. Larger ones are dealt by ranges of (group, order), and each range gets
    copies of the `halo` rows before and behind it, so that no task has more than a range. Counts and sums over a whole group are
    right up to halo rows only. Ties in order are broken by nothing: make it total.
    """
    large = LARGE if large is None else large
    sizes = rows.groupBy(F.col(group).alias("_tw_group")).count().where(F.col("count") > large)
    hot = cut(sizes.select("_tw_group", "count"))  # few: each holds more than `large` rows
    total = hot.agg(F.sum("count")).first()[0]
    names = rows.columns
    if not total:
        w = Window.partitionBy(group)
        return rows.select("*", *(c.alias(k) for k, c in add(w).items()))
    same = rows[group].eqNullSafe(hot["_tw_group"])
    w = Window.partitionBy(group)
    small = rows.join(F.broadcast(hot), same, "left_anti").select("*", *(c.alias(k) for k, c in add(w).items()))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    parts = max(2, -(-total // min(RANGE, large)))
    # written, so that a range has the same rows and number whatever is computed again
    dealt = cut(rows.join(F.broadcast(hot), same, "left_semi").repartitionByRange(parts, *keys).withColumn("_tw_part", F.spark_partition_id()))
    counted = {r[0]: r[1] for r in dealt.groupBy("_tw_part").count().collect()}  # one number a range
    within = Window.partitionBy("_tw_part")
    ends = dealt.withColumn("_tw_first", F.row_number().over(within.orderBy(*keys))).withColumn("_tw_last", F.row_number().over(within.orderBy(*(F.col(c).desc_nulls_last() for c in (group, *order)))))
    ends = cut(ends.where((F.col("_tw_first") <= halo) | (F.col("_tw_last") <= halo)))
    goes = []
    numbers = sorted(counted)
    for i, part in enumerate(numbers):
        for side, others in (("_tw_last", numbers[:i][::-1]), ("_tw_first", numbers[i + 1 :])):
            wanted = halo
            for other in others:
                if wanted <= 0:
                    break
                goes.append((other, part, side, wanted))
                wanted -= counted[other]
    sent = rows.sparkSession.createDataFrame(goes or [(-1, -1, "", 0)], "_tw_part int, _tw_to int, _tw_side string, _tw_rows int")
    place = F.when(F.col("_tw_side") == "_tw_last", F.col("_tw_last")).otherwise(F.col("_tw_first"))
    copies = ends.join(F.broadcast(sent), "_tw_part").where(place <= F.col("_tw_rows")).select(*names, F.col("_tw_to").alias("_tw_part"), F.lit(False).alias("_tw_own"))
    every = dealt.select(*names, "_tw_part", F.lit(True).alias("_tw_own")).unionByName(copies)
    w = Window.partitionBy("_tw_part", group)
    parted = every.select("*", *(c.alias(k) for k, c in add(w).items())).where("_tw_own").drop("_tw_part", "_tw_own")
    return small.unionByName(parted)
