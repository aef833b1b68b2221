"""Topics of articles by word lists, and by one classifier for each topic."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.storage import cut

#: The default word lists, in the order in which ties are settled; the remainder comes last.
BUCKETS = {
    "ai": "model weights|language model|neural|chat assistant|training cluster|speech recogniser",
    "chips": "wafer|semiconductor|lithography|foundry|photoresist|cleanroom",
    "space": "orbital|lunar|satellite|launch pad|payload|star tracker",
    "medicine": "vaccine|gene therapy|antibiotic|clinic|blood test|cancer",
    "energy": "turbine|solar|heat pump|reactor|geothermal|hydrogen",
    "law": "court|lawsuit|statute|verdict|injunction|patent",
    "farming": "harvest|greenhouse|crop|livestock|dairy|grain",
    "cyber": "malware|ransom|phishing|data breach|firewall|botnet",
    "transport": "ferry|tram|railway|bus line|cargo|airport",
    "sport": "match|league|coach|tournament|sprint|stadium",
}


def matches(text: Column, words: str) -> Column:
    """Distinct matched words in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({words})"), F.lit(1)))


def scan(articles: DataFrame, buckets: dict[str, str] = BUCKETS, body: int = 700, least: int = 2) -> DataFrame:
    """article_id, slug, ord, head, deep, strict for each topic with a match.

    Strict: named in the title, or by `least` different words of the body's first `body` characters.
    """
    head, tail = F.coalesce("title", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, body)
    one = [F.struct(F.lit(s).alias("slug"), F.lit(i).alias("ord"), matches(head, w).alias("h"), matches(tail, w).alias("t")) for i, (s, w) in enumerate(buckets.items())]
    # each list is matched once; counts are taken from what it found
    x = articles.select("article_id", F.explode(F.array(*one)).alias("x")).select("article_id", "x.*")
    x = x.select("article_id", "slug", "ord", F.size("h").alias("head"), F.size(F.array_except("t", "h")).alias("deep")).where("head + deep > 0")
    return x.withColumn("strict", (F.col("head") > 0) | (F.col("deep") >= least))


def of(articles: DataFrame, scanned: DataFrame) -> DataFrame:
    """article_id, topics: strict ones (title hits, more words, list order first), else the best weak one, else `other`."""
    key = F.struct((F.col("head") == 0).alias("a"), (-(F.col("head") + F.col("deep"))).alias("b"), "ord", "slug")
    got = scanned.groupBy("article_id").agg(F.array_sort(F.collect_list(F.when(F.col("strict"), key))).alias("s"), F.array_sort(F.collect_list(F.when(~F.col("strict"), F.struct((-F.col("deep")).alias("b"), "ord", "slug")))).alias("w"))
    slugs = lambda c: F.transform(c, lambda x: x["slug"])
    out = articles.select("article_id").join(got, "article_id", "left")
    topics = F.when(F.size("s") > 0, slugs("s")).when(F.size("w") > 0, F.slice(slugs("w"), 1, 1)).otherwise(F.array(F.lit("other")))
    return out.select("article_id", topics.alias("topics"))


def classified(labelled: DataFrame, rows: DataFrame, slugs: list[str], least: int = 40, above: float = 0.75, in_all: int = 80) -> DataFrame:
    """article_id, slug, p: topics that one of the logistic models gives with a probability above `above`.

    `labelled`: article_id, slug, vector; `rows`: article_id, vector. A topic needs `least` positives and some negatives, all topics `in_all` articles.
    """
    base = cut(labelled.groupBy("article_id").agg(F.collect_set("slug").alias("slugs"), F.first("vector").alias("vector"))).withColumn("features", array_to_vector("vector"))
    n = {r.slug: r.n for r in labelled.groupBy("slug").agg(F.count_distinct("article_id").alias("n")).collect()}  # one row a topic
    total = base.count()
    asked = rows.withColumn("features", array_to_vector("vector")).select("article_id", "features")
    parts = []
    for s in slugs:
        if total < in_all or not least <= n.get(s, 0) < total:
            continue
        y = F.array_contains("slugs", s).cast("int")
        train = base.select("features", y.alias("y"), F.when(y == 1, total / (2.0 * n[s])).otherwise(total / (2.0 * (total - n[s]))).alias("w"))
        model = LogisticRegression(labelCol="y", weightCol="w", regParam=0.25 / total, maxIter=50, tol=1e-4).fit(train)
        p = model.transform(asked).select("article_id", F.lit(s).alias("slug"), vector_to_array("probability")[1].alias("p"))
        parts.append(p.where(F.col("p") > above))
    if not parts:
        return asked.select("article_id", F.lit("").alias("slug"), F.lit(0.0).alias("p")).where("false")
    return reduce(DataFrame.unionByName, parts)
