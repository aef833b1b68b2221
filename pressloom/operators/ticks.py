"""Which ticks of the dump a run takes, and what a run may spend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(cursor: DataFrame, latest: DataFrame, most: int = 24, hours_back: int = 2) -> DataFrame:
    """tick: after the stored `cursor` (one row, null if there is none) up to `latest`, the oldest `most`; without a cursor from `hours_back` on."""
    both = cursor.crossJoin(F.broadcast(latest)).select(F.coalesce(F.col("cursor") + F.expr("interval 15 minutes"), F.col("latest") - F.expr(f"interval {hours_back} hours")).alias("a"), F.col("latest").alias("b"))
    return both.select(F.explode(F.expr("case when a <= b then sequence(a, b, interval 15 minutes) end")).alias("tick")).orderBy("tick").limit(most)


def progress(states: DataFrame, now: DataFrame, hole_minutes: int = 90) -> DataFrame:
    """tick, taken, hole: how far a run gets. `states`: tick, ok (some stream was read), missing (all streams are not there).

    A tick whose streams are all missing is skipped as a hole when it is `hole_minutes` old; any other tick that was not read stops the run, and
    later ones wait for it.
    """
    s = states.crossJoin(F.broadcast(now)).withColumn("hole", ~F.col("ok") & F.col("missing") & ((F.unix_timestamp("now") - F.unix_timestamp("tick")) / 60 >= hole_minutes))
    first = F.broadcast(s.where(~F.col("ok") & ~F.col("hole")).agg(F.min("tick").alias("stop")))
    return s.crossJoin(first).where(F.col("stop").isNull() | (F.col("tick") < F.col("stop"))).select("tick", F.col("ok").alias("taken"), "hole")


def within_budget(rows: DataFrame, group: str, order: list, per_group: int, in_all: int, cost: str | None = None, most_cost: float = 0.0) -> DataFrame:
    """The first `per_group` rows of each group by `order`, `in_all` rows altogether, while the running `cost` stays within `most_cost`.

    Limits come first, so the running cost is taken over `in_all` rows at most.
    """
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= per_group)
    top = r.orderBy(*order).limit(in_all)
    if cost is None:
        return top.drop("_r")
    run = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("_run", run).where(F.col("_run") <= most_cost).drop("_r", "_run")
