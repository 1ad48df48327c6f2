"""Ordered operators over long groups, without a window that holds a whole group.

A group (a transcript, a user) may hold a third of all rows.  Its rows are cut into blocks along the
order; windows run inside blocks, and one small row per block carries what crosses the borders.
Windows run against the order: what lies ahead of a row is then a growing frame, which costs one step
for each row, and all of them share one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 512


def with_block(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    return df.withColumn("_block", F.expr(f"CAST(floor({order} / {block}) AS BIGINT)"))


def delivered_once(df: DataFrame, group: str, order: str) -> DataFrame:
    """One row of each (group, order); ``_block`` must exist and follow the order.

    Repeated deliveries are alike in what is kept, so which copy stays does not matter.  The rows are
    shuffled by (group, block), as the operators below want them.
    """
    w = Window.partitionBy(group, "_block").orderBy(F.col(order).desc())
    again = df.withColumn("_again", F.lag(order).over(w))
    return again.where(F.col("_again").isNull() | (F.col("_again") != F.col(order))).drop("_again")


def look_ahead(
    df: DataFrame, group: str, order: str, wanted: dict[str, tuple[Column, Column | None]], from_end: str | None = None
) -> DataFrame:
    """Forward as-of: for each ``name: (condition, value)`` adds the value of the first later row of the group that
    meets the condition, else null.

    All names are served by one window pass and one table of block states.  ``from_end``, if named, is
    the number of rows of the group from this one to its last; a value of None stands for that number.
    """
    w = Window.partitionBy(group, "_block").orderBy(F.col(order).desc())
    x = df.withColumn("_row", F.row_number().over(w)) if from_end else df
    value = lambda v: F.col("_row") if v is None else v
    x = x.withColumns({f"_m_{k}": F.when(c, F.struct(F.col(order).alias("o"), value(v).alias("v"))) for k, (c, v) in wanted.items()})
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    inner = x.withColumns({f"_i_{k}": F.last(f"_m_{k}", ignorenulls=True).over(ahead) for k in wanted})
    inner = inner.drop(*[f"_m_{k}" for k in wanted])

    firsts = [F.min(f"_m_{k}").alias(f"_m_{k}") for k in wanted] + ([F.count("*").alias("_n")] if from_end else [])
    states = x.groupBy(group, "_block").agg(*firsts)
    over = Window.partitionBy(group).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    if from_end:
        states = states.withColumn("_after", F.coalesce(F.sum("_n").over(over), F.lit(0)))
        for k, (_, v) in wanted.items():
            if v is None:
                moved = F.struct(F.col(f"_m_{k}.o").alias("o"), (F.col(f"_m_{k}.v") + F.col("_after")).alias("v"))
                states = states.withColumn(f"_m_{k}", F.when(F.col(f"_m_{k}").isNotNull(), moved))
    states = states.withColumns({f"_l_{k}": F.last(f"_m_{k}", ignorenulls=True).over(over) for k in wanted})
    states = states.select(group, "_block", *[f"_l_{k}" for k in wanted], *(["_after"] if from_end else []))

    # A left join, though every block has its state: it adds no test of the keys, so that the shuffle is the same for both sides.
    joined = inner.join(states, [group, "_block"], "left")
    here = lambda k: F.col(f"_i_{k}.v") + F.col("_after") if wanted[k][1] is None else F.col(f"_i_{k}.v")
    found = {k: F.when(F.col(f"_i_{k}").isNotNull(), here(k)).otherwise(F.col(f"_l_{k}.v")) for k in wanted}
    if from_end:
        found[from_end] = F.col("_after") + F.col("_row")
    return joined.withColumns(found).drop(*[f"_{c}_{k}" for k in wanted for c in "il"], "_row", "_after")


def next_matching(df: DataFrame, group: str, order: str, condition: Column, value: Column, out: str) -> DataFrame:
    """``look_ahead`` for one condition."""
    return look_ahead(df, group, order, {out: (condition, value)})


def next_row(df: DataFrame, group: str, order: str, value: Column, out: str) -> DataFrame:
    """Adjacent pairs: adds ``value`` of the next row of the group, null at its end (or where that value is null)."""
    return next_matching(df, group, order, F.lit(True), value, out)


def with_position(df: DataFrame, group: str, order: str, out: str = "pos") -> DataFrame:
    """Adds the dense 0-based position of each row in its group; ``_block`` must exist and follow the order."""
    w = Window.partitionBy(group, "_block").orderBy(order)
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    sizes = sizes.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = df.withColumn("_row", F.row_number().over(w)).join(sizes, [group, "_block"], "left")
    return inner.withColumn(out, F.col("_before") + F.col("_row") - 1).drop("_before", "_row")
