"""Choosing within groups: varied picks, titles, numbered batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.functions import vector as V
from pressloom.storage import cut


def varied(rows: DataFrame, group: str, picks: int = 5, lam: float = 0.7) -> DataFrame:
    """group, k, id: maximal marginal relevance. Relevance is importance scaled within the group, 0.5 where all are equal;
    each pick gains lam * relevance - (1 - lam) * highest cosine to those picked, not below 0; ties go to the smaller id.

    `rows`: group, id, importance, vector. Each pick is one aggregation over all groups.
    """
    span = rows.groupBy(group).agg(F.min("importance").alias("lo"), F.max("importance").alias("hi"))
    rel = F.when(F.col("hi") - F.col("lo") > 1e-9, (F.col("importance") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    left = cut(rows.join(span, group).select(group, "id", "vector", rel.alias("rel"), F.lit(0.0).alias("near")))
    out = None
    for k in range(picks):
        score = F.round(lam * F.col("rel") - (1 - lam) * F.col("near"), 9)
        best = cut(left.groupBy(group).agg(F.max_by(F.struct("id", "vector"), F.struct(score, -F.col("id"))).alias("w")).select(group, F.col("w.id").alias("pid"), F.col("w.vector").alias("pv")))
        now = best.select(group, F.lit(k).alias("k"), F.col("pid").alias("id"))
        out = now if out is None else out.unionByName(now)
        near = F.greatest("near", F.coalesce(V.cosine(F.col("vector"), F.col("pv")), F.lit(0.0)))
        left = cut(left.join(best, group).where("id <> pid").select(group, "id", "vector", "rel", near.alias("near")))
    return out


def best_title(rows: DataFrame, group: str, order: str, least: int = 28, most: int = 170) -> DataFrame:
    """group, id, title: the title nearest to the group's mean vector, 0.16 for a good length, less its flaws.

    `rows`: group, id, title, vector (null allowed) and `order`, a column by which ties and titles out of bounds are settled, the largest
    first; titles out of bounds stand in only where no other is there. Means are taken by dimension, so no group is collected.
    """
    t = rows.where(F.coalesce(F.col("title"), F.lit("")) != "").withColumn("live", F.length("title").between(least, most))
    unit = t.where(F.col("live") & F.col("vector").isNotNull()).select(group, "id", V.unit(F.col("vector")).alias("u"))
    mean = unit.select(group, F.posexplode("u").alias("d", "x")).groupBy(group, "d").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    mid = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda y: y["x"]).alias("mid"), F.max("n").alias("n"))
    sim = unit.join(mid.where("n > 1"), group).select("id", V.cosine(F.col("u"), F.col("mid")).alias("sim"))
    fit = F.when(F.length("title").between(50, 112), 0.16).otherwise(0.0)
    scored = t.join(sim, "id", "left").withColumn("score", F.round(F.coalesce("sim", F.lit(0.0)) + fit - T.title_flaws(F.col("title")), 9))
    rank = F.struct("live", F.when(F.col("live"), F.col("score")).otherwise(0.0), order, -F.col("id"))
    return scored.groupBy(group).agg(F.max_by(F.struct("id", "title"), rank).alias("w")).select(group, "w.id", "w.title")


def numbered_batches(rows: DataFrame, at: str, id_: str, size: int = 20) -> DataFrame:
    """The rows with `batch` and `place`: numbered by (at, id) over the whole table and cut into batches.

    Ranks are taken inside hours and shifted by the hours' running total; only hour counts meet in one task.
    """
    hour = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 3_600_000_000)
    h = rows.withColumn("_h", F.coalesce(hour, F.lit(-1)))
    per = h.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = F.row_number().over(Window.partitionBy("_h").orderBy(at, id_)) - 1
    n = h.withColumn("_r", r).join(per.select("_h", "_before"), "_h").withColumn("_at", F.col("_r") + F.col("_before"))
    return n.withColumn("batch", F.floor(F.col("_at") / size) + 1).withColumn("place", (F.col("_at") % size + 1).cast("int")).drop("_h", "_r", "_before", "_at")


def running(per: DataFrame, value: str, *sums: str, parts: int = 64) -> DataFrame:
    """The rows with `before_<c>` for each of `sums`: its total over the rows of smaller `value`, whose values are distinct.

    Rows are spread over ranges of about equal size; only the ranges' totals meet in one task.
    """
    edges = per.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10_000).alias("_edges"))
    cut_at = per.crossJoin(F.broadcast(edges)).withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    total = cut_at.groupBy("_b").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("_b", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_t_{c}") for c in sums))
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut_at.join(F.broadcast(total), "_b")
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"_t_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_b", *(f"_t_{c}" for c in sums))


def quantile(per: DataFrame, value: str, n: str, p: float) -> DataFrame:
    """q: the exact quantile, linear between neighbours, of distinct values with their numbers `n`."""
    run = running(per, value, n)
    size = per.agg(F.sum(n).alias("_n"))
    at = (F.col("_n") - 1) * F.lit(p)
    up_to = F.col(f"before_{n}") + F.col(n)
    two = run.crossJoin(F.broadcast(size)).agg(F.min(F.when(up_to > F.floor(at), F.col(value))).alias("a"), F.min(F.when(up_to > F.ceil(at), F.col(value))).alias("b"), F.max(at - F.floor(at)).alias("f"))
    return two.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("q"))


def places(rows: DataFrame, value: str, *ties: str, parts: int = 64) -> DataFrame:
    """The rows with `place`, from 1, by falling `value` and then `ties`, over the whole table without sorting it in one task."""
    per = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    at = running(per.withColumn("_down", -F.col(value)), "_down", "_n", parts=parts).select(F.col(value).alias("_v"), "before__n")
    inside = Window.partitionBy(value).orderBy(*ties)
    return rows.join(at, F.col(value).eqNullSafe(F.col("_v"))).withColumn("place", F.col("before__n") + F.row_number().over(inside)).drop("_v", "before__n")
