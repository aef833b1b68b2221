"""Relevance gate: TF-IDF and embedding classifiers, thresholds and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.operators import logistic as L
from pressloom.operators.select import quantile, running
from pressloom.storage import cut


def training_set(articles: DataFrame, chars: int | None = None) -> DataFrame:
    """article_id, y, text, vector: judged rows with a vector whose label does not come from the gate or a copy; the text whole, or its first `chars` letters."""
    a = articles.where("importance is not null and embedding is not null and (scored_by is null or scored_by = 'llm')")
    body = F.coalesce("text", F.lit(""))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" \n "), body if chars is None else F.substring(body, 1, chars))
    return a.select("article_id", "fetched_at", (F.col("importance") > 5).cast("int").alias("y"), text.alias("text"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """The rows with `fold`: contiguous in time within each class, of equal size as far as possible.

    The fold is read from the row's place among quantiles of its class, so no class is sorted in one task:
    (class, hour) counts are summed up first, then rows are placed by their rank within the hour.
    """
    hour = F.floor(F.unix_micros(F.col("fetched_at").cast("timestamp")) / 3_600_000_000)
    h = rows.withColumn("_h", hour)
    per = h.groupBy("y", "_h").agg(F.count(F.lit(1)).alias("_n"))
    run = per.withColumn("_before", F.sum("_n").over(Window.partitionBy("y").orderBy("_h")) - F.col("_n"))
    size = F.broadcast(rows.groupBy("y").agg(F.count(F.lit(1)).alias("_size")))
    r = F.row_number().over(Window.partitionBy("y", "_h").orderBy("fetched_at", "article_id")) - 1
    placed = h.withColumn("_r", r).join(run.select("y", "_h", "_before"), ["y", "_h"]).join(size, "y").withColumn("_at", F.col("_before") + F.col("_r"))
    big, rest = F.floor(F.col("_size") / k), F.col("_size") % k
    edge = rest * (big + 1)
    fold = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (big + 1))).otherwise(rest + F.floor((F.col("_at") - edge) / F.greatest(big, F.lit(1)))) + 1
    return placed.withColumn("fold", fold.cast("int")).drop("_h", "_r", "_before", "_size", "_at")


def placed(rows: DataFrame, k: int) -> DataFrame:
    """The rows with the `fold` of `folds`, read from the last row of each: only keys and times are sorted, and texts stay where they are."""
    key = F.struct(F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("t"), F.col("article_id").alias("i"))
    last = folds(rows.select("article_id", "fetched_at", "y"), k).groupBy("y", "fold").agg(F.max(key).alias("e")).collect()  # a row a fold and class
    t = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    after = lambda e: (t > e.t) | ((t == e.t) & (F.col("article_id") > F.lit(e.i)))
    past = [F.coalesce(((F.col("y") == r.y) & after(r.e)).cast("int"), F.lit(0)) for r in last]
    return rows.withColumn("fold", F.least(sum(past, F.lit(1)), F.lit(k)).cast("int"))


def probabilities(rows: DataFrame, k: int = 5, features: int = 150_000, least: int = 3, tolerance: float = 1e-6, rounds: int = 3000) -> DataFrame:
    """article_id, y, p_vec, p_txt: out-of-fold probabilities of both classifiers, in as many folds as the smaller class allows, `k` at most.

    Terms are counted once. A fold's vocabulary, the `features` terms of at least `least` of its training rows that most rows hold, and their weights come
    from the document frequencies of all folds less its own; a term weighs (1 + ln tf) * idf and a row has unit length.
    Rows are packed into arrays once, for all folds; each pass over them serves every classifier that is not settled.
    """
    few = rows.groupBy("y").count().collect()  # two rows
    k = min(k, *(r["count"] for r in few)) if len(few) == 2 else 0
    if k < 2:
        return rows.select("article_id", "y", F.lit(None).cast("double").alias("p_vec"), F.lit(None).cast("double").alias("p_txt")).where("false")
    f = placed(rows, k)
    found = f.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("length")).collect()  # a row a fold and class
    classes = {(r.fold, r.y): r.n for r in found}
    sizes = [sum(classes.get((i, y), 0) for y in (0, 1)) for i in range(1, k + 1)]
    known = L.vocabulary(cut(L.frequencies(f, k)), sizes, features, least)
    packed = L.blocks(f, known, k)
    weights = L.fitted(packed, known, classes, k, max(r.length for r in found), tolerance, rounds)
    return L.held_out(packed, known, weights)


def combined(scored: DataFrame) -> DataFrame:
    """The rows with `z`: both probabilities scaled to mean 0 and population deviation 1, summed."""
    m = F.broadcast(scored.agg(F.avg("p_vec").alias("_mv"), F.stddev_pop("p_vec").alias("_sv"), F.avg("p_txt").alias("_mt"), F.stddev_pop("p_txt").alias("_st")))
    z = (F.col("p_vec") - F.col("_mv")) / F.greatest("_sv", F.lit(1e-9)) + (F.col("p_txt") - F.col("_mt")) / F.greatest("_st", F.lit(1e-9))
    return scored.crossJoin(m).withColumn("z", z).drop("_mv", "_sv", "_mt", "_st")


def thresholds(scored: DataFrame, score: str = "z", recall: float = 0.95, precision: float = 0.90) -> DataFrame:
    """lo, hi: `lo` keeps `recall` of the positives; above `hi` precision holds, or nothing is kept unseen.

    Counts are taken over distinct scores and summed up by ranges, so no task sorts them all.
    """
    lo = quantile(scored.where("y = 1").groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n")), "s", "n", 1 - recall).withColumnRenamed("q", "lo")
    per = scored.groupBy(F.col(score).alias("s")).agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("s"))
    run = running(per, "down", "p", "n").select("s", ((F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))).alias("precision"))
    hi = run.agg(F.min(F.when(F.col("precision") >= precision, F.col("s"))).alias("hi"), F.max("s").alias("top"))
    return lo.crossJoin(hi).select("lo", F.when(F.col("hi").isNull() | (F.col("hi") <= F.col("lo")), F.col("top") + 1).otherwise(F.col("hi")).alias("hi"))


def verdicts(scored: DataFrame, bounds: DataFrame, score: str = "z") -> DataFrame:
    """The rows with `verdict`: drop below lo, keep above hi, ask between and where there is no score."""
    v = F.when(F.col(score) < F.col("lo"), "drop").when(F.col(score) > F.col("hi"), "keep").otherwise("ask")
    return scored.crossJoin(F.broadcast(bounds)).withColumn("verdict", v).drop("lo", "hi")


def auc(scored: DataFrame, score: str = "z") -> DataFrame:
    """auc by rank sums over distinct scores, ties at their mean rank."""
    per = scored.groupBy(F.col(score).alias("s")).agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    r = running(per, "s", "n")
    t = r.agg(F.sum(F.col("p") * (F.col("before_n") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum("p").alias("pos"), F.sum("n").alias("n"))
    return t.select(((F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2.0) / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("auc"))


def saved(shares: DataFrame, least: float = 0.30) -> DataFrame:
    """The shares with `saved`: a gate that drops fewer than `least` of the negatives is not worth keeping."""
    return shares.withColumn("saved", F.coalesce(F.col("dropped") >= least, F.lit(False)))


def gated(scored: DataFrame, bounds: DataFrame | None, score: str = "z") -> DataFrame:
    """The rows with `verdict`; without bounds (no gate saved) everything is asked."""
    return scored.withColumn("verdict", F.lit("ask")) if bounds is None else verdicts(scored, bounds, score)
