"""Aggregations: entities, outlets, regions, facets, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.operators.topics import BUCKETS
from pressloom.plans.oracle import NAMES, outlet
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles
from pressloom.sources.tables import table

Q, SQL, query = registry()


def names(spark: SparkSession, d: str) -> DataFrame:
    """article_id, country, pos, name: the distinct cleaned names of each article."""
    a = articles(spark, d, "article_id", "country", "entities").where("entities is not null")
    raw = a.select("article_id", "country", F.posexplode(F.transform(F.split("entities", ";"), T.entity_clean)).alias("pos", "name")).where("name <> ''")
    return raw.groupBy("article_id", "country", "name").agg((F.min("pos") + 1).alias("pos"))


def frequencies(n: DataFrame) -> DataFrame:
    return n.groupBy("country", "name").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {NAMES} SELECT country, name, count(*) AS df FROM names GROUP BY country, name")
def a01_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return frequencies(names(spark, d))


_DF = f"WITH {NAMES}, df AS (SELECT country, name, count(*) AS df FROM names GROUP BY country, name)"


@query(f"{_DF} SELECT n.article_id, count(*) AS prominent FROM names n JOIN df ON df.country IS NOT DISTINCT FROM n.country AND df.name = n.name WHERE df.df >= 3 GROUP BY n.article_id")
def a02_prominent(spark: SparkSession, d: str) -> DataFrame:
    n = names(spark, d)
    big = frequencies(n).where("df >= 3").select(F.col("country").alias("c"), F.col("name").alias("m"))
    return n.join(big, F.col("country").eqNullSafe(F.col("c")) & (F.col("name") == F.col("m"))).groupBy("article_id").agg(F.count(F.lit(1)).alias("prominent"))


@query(f"{_DF} SELECT n.article_id, round(least(1.0, count(*) FILTER (WHERE df.df >= 3) / 4.0), 6) AS weight FROM names n JOIN df ON df.country IS NOT DISTINCT FROM n.country AND df.name = n.name GROUP BY n.article_id")
def a03_entity_weight(spark: SparkSession, d: str) -> DataFrame:
    n = names(spark, d)
    f = frequencies(n).select(F.col("country").alias("c"), F.col("name").alias("m"), "df")
    joined = n.join(f, F.col("country").eqNullSafe(F.col("c")) & (F.col("name") == F.col("m")))
    return joined.groupBy("article_id").agg(F.round(F.least(F.lit(1.0), F.count_if(F.col("df") >= 3) / 4.0), 6).alias("weight"))


@query(f"SELECT title_hash, count(DISTINCT nullif({outlet('url')}, '')) AS outlets FROM articles WHERE title_hash IS NOT NULL GROUP BY title_hash")
def a04_outlets(spark: SparkSession, d: str) -> DataFrame:
    dom = T.outlet(F.col("url"))
    return articles(spark, d, "title_hash", "url").where("title_hash is not null").groupBy("title_hash").agg(F.count_distinct(F.when(dom != "", dom)).alias("outlets"))


@query(f"SELECT {outlet('url')} AS domain, count(*) AS reach FROM articles WHERE {outlet('url')} <> '' GROUP BY 1")
def a05_reach(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "url").groupBy(T.outlet(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("reach")).where("domain <> ''")


@query("SELECT verdict, count(*) AS n, sum(attempts) AS attempts, count(embedding) AS with_vector FROM seen_urls GROUP BY verdict")
def a08_verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seen_urls").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"), F.count("embedding").alias("with_vector"))


@query("""WITH b AS (SELECT slug, CAST(row_number() OVER (ORDER BY slug) - 1 AS INT) AS i FROM subjects)
SELECT article_id, CAST(bit_or(1 << i) AS INT) AS mask FROM (SELECT DISTINCT article_id, slug FROM subject_labels) l JOIN b USING (slug) GROUP BY article_id""")
def a10_topic_mask(spark: SparkSession, d: str) -> DataFrame:
    bits = table(spark, d, "subjects", "slug").withColumn("i", F.row_number().over(Window.orderBy("slug")) - 1)
    labels = table(spark, d, "subject_labels", "article_id", "slug").distinct()
    return labels.join(F.broadcast(bits), "slug").groupBy("article_id").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("mask"))


_SENT = "unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?…])\\s+|\\n+', '\\1\x01', 'g'), '\x01'))"
_FP = "substr(regexp_replace(lower(s), '[^\\p{L}\\p{N}_]+', '', 'g'), 1, 120)"


@query(f"""SELECT domain, fp, count(DISTINCT k) AS stories FROM (SELECT {outlet('url')} AS domain, coalesce(title_hash, CAST(article_id AS VARCHAR)) AS k, {_FP} AS fp FROM (SELECT url, title_hash, article_id, {_SENT} AS s FROM articles))
WHERE length(fp) >= 12 GROUP BY domain, fp HAVING count(DISTINCT k) >= 4""")
def a11_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of one outlet in four stories or more. Distinct (outlet, sentence, story) first, so the counting groups are pre-aggregated."""
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?…])\s+|\n+", "$1\x01"), "\x01")
    a = articles(spark, d, "article_id", "url", "title_hash", "text").select(T.outlet(F.col("url")).alias("domain"), F.coalesce("title_hash", F.col("article_id").cast("string")).alias("k"), F.explode(parts).alias("s"))
    fp = a.select("domain", "k", T.fingerprint(F.col("s")).alias("fp")).where(F.length("fp") >= 12).distinct()
    return fp.groupBy("domain", "fp").agg(F.count(F.lit(1)).alias("stories")).where("stories >= 4")


_TOK = "list_filter(regexp_extract_all(lower(coalesce(title, '') || ' ' || substr(coalesce(text, ''), 1, 700)), '[a-zа-яё][a-zа-яё-]{3,}'), lambda x: TRUE)"
_TOPIC_RX = " UNION ALL ".join(f"SELECT '{s}' AS slug, '({w})' AS rx" for s, w in BUCKETS.items())


@query(f"""WITH b AS ({_TOPIC_RX}), doc AS (SELECT article_id, lower(title) AS head, {_TOK} AS ws FROM articles WHERE title IS NOT NULL), w AS (SELECT article_id, unnest(ws) AS word FROM doc),
tot AS (SELECT word, count(*) AS tn FROM w GROUP BY word), allw AS (SELECT count(*) AS n_all FROM w),
pick AS (SELECT b.slug, b.rx, d.article_id FROM b JOIN doc d ON regexp_matches(d.head, b.rx)), big AS (SELECT slug FROM pick GROUP BY slug HAVING count(*) >= 30),
c AS (SELECT p.slug, any_value(p.rx) AS rx, w.word, count(*) AS k FROM pick p JOIN w USING (article_id) WHERE p.slug IN (SELECT slug FROM big) GROUP BY p.slug, w.word), s AS (SELECT slug, sum(k) AS n FROM c GROUP BY slug),
z AS (SELECT c.slug, c.word, (ln((k + 0.01 * tn) / (n + 0.01 * n_all - k - 0.01 * tn)) - ln((tn - k + 0.01 * tn) / (n_all - n + 0.01 * n_all - (tn - k) - 0.01 * tn))) / sqrt(1 / (k + 0.01 * tn) + 1 / (tn - k + 0.01 * tn)) AS z
  FROM c JOIN tot USING (word) JOIN s USING (slug), allw WHERE k >= 8 AND tn >= 12 AND NOT regexp_matches(c.word, c.rx))
SELECT slug, word, round(z, 5) AS z FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY round(z, 5) DESC, word DESC) AS r FROM z) WHERE r <= 14""")
def a12_topic_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that tell a topic apart: log-odds with a Dirichlet prior of a hundredth of the corpus, of documents named by their title against all; fourteen
    for each topic of thirty documents or more, of words in eight of its places."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 700))
    doc = articles(spark, d, "article_id", "title", "text").where("title is not null").select("article_id", F.lower("title").alias("head"), F.regexp_extract_all(F.lower(text), F.lit("([a-zа-яё][a-zа-яё-]{3,})"), F.lit(1)).alias("ws"))
    slugs = F.filter(F.array(*(F.when(F.col("head").rlike(w), s) for s, w in BUCKETS.items())), lambda x: x.isNotNull())
    # one pass: the corpus counts itself under the empty topic
    own = doc.select(F.explode(F.concat(F.array(F.lit("")), slugs)).alias("slug"), "ws")
    docs = own.where("slug <> ''").groupBy("slug").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 30")
    c = own.select("slug", F.explode("ws").alias("word")).groupBy("slug", "word").agg(F.count(F.lit(1)).alias("k"))
    tot = c.where("slug = ''").select("word", F.col("k").alias("tn"))
    n_all = F.broadcast(tot.agg(F.sum("tn").alias("n_all")))
    c = c.join(F.broadcast(docs), "slug")
    s = F.broadcast(c.groupBy("slug").agg(F.sum("k").alias("n")))  # one row a topic
    hit = F.lit(False)
    for slug, w in BUCKETS.items():
        hit = hit | ((F.col("slug") == slug) & F.col("word").rlike(w))
    j = c.join(tot, "word").join(s, "slug").crossJoin(n_all).where("k >= 8 and tn >= 12").where(~hit)
    a = "0.01D * tn"
    z = F.expr(f"(ln((k + {a}) / (n + 0.01D * n_all - k - {a})) - ln((tn - k + {a}) / (n_all - n + 0.01D * n_all - (tn - k) - {a}))) / sqrt(1 / (k + {a}) + 1 / (tn - k + {a}))")
    r = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("z"), F.desc("word")))
    return j.select("slug", "word", F.round(z, 5).alias("z")).withColumn("r", r).where("r <= 14").select("slug", "word", "z")


@query(f"""WITH {NAMES}, f AS (SELECT 'country' AS facet, country AS value, count(*) AS n FROM articles WHERE country IS NOT NULL GROUP BY country UNION ALL SELECT 'day', CAST(CAST(fetched_at AS DATE) AS VARCHAR), count(*) FROM articles WHERE fetched_at IS NOT NULL GROUP BY 2
UNION ALL SELECT 'entity', name, count(*) FROM names GROUP BY name HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r, count(*) OVER (PARTITION BY facet) AS kinds FROM f)
SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN facet = 'day' THEN value END DESC, r) AS place FROM r WHERE r <= 8 AND kinds >= 2""")
def a17_facets(spark: SparkSession, d: str) -> DataFrame:
    """The eight commonest values of each facet with two values or more, names from two articles on, days by the calendar; all facets in one pass."""
    pair = lambda f, v: F.struct(F.lit(f).alias("facet"), v.alias("value"))
    own = F.transform(T.entities(F.col("entities")), lambda n: pair("entity", n))
    pairs = F.concat(F.array(pair("country", F.col("country")), pair("day", F.to_date("fetched_at").cast("string"))), own)
    n = articles(spark, d, "country", "fetched_at", "entities").select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))
    n = n.where("facet <> 'entity' or n >= 2")
    kinds = F.broadcast(n.groupBy("facet").agg(F.count(F.lit(1)).alias("kinds")))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where("r <= 8").join(kinds, "facet").where("kinds >= 2")
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc(F.when(F.col("facet") == "day", F.col("value"))), "r"))
    return top.select("facet", "value", "n", place.alias("place"))


@query("SELECT CAST(day AS VARCHAR) AS day, n, round_even(n * 100.0 / max(n) OVER (), 0) AS height FROM (SELECT CAST(fetched_at AS DATE) AS day, count(*) AS n FROM articles GROUP BY 1)")
def a18_histogram(spark: SparkSession, d: str) -> DataFrame:
    days = articles(spark, d, "fetched_at").groupBy(F.to_date("fetched_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    peak = F.broadcast(days.agg(F.max("n").alias("peak")))
    return days.crossJoin(peak).select(F.col("day").cast("string").alias("day"), "n", F.bround(F.col("n") * F.lit(100.0) / F.col("peak"), 0).alias("height"))


@query(f"WITH {NAMES} SELECT kind, value, count(*) AS n FROM (SELECT 'country' AS kind, country AS value FROM articles UNION ALL SELECT 'outlet', {outlet('url')} FROM articles UNION ALL SELECT 'entity', name FROM names) WHERE value IS NOT NULL GROUP BY kind, value")
def a19_suggestions(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "article_id", "country", "url", "entities")
    own = F.transform(T.entities(F.col("entities")), lambda n: F.struct(F.lit("entity").alias("kind"), n.alias("value")))
    pairs = F.concat(F.array(F.struct(F.lit("country").alias("kind"), F.col("country").alias("value")), F.struct(F.lit("outlet").alias("kind"), T.outlet(F.col("url")).alias("value"))), own)
    return a.select(F.explode(pairs).alias("p")).where("p.value is not null").groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(quantile_cont(importance, 0.05), 6) AS p05, round(quantile_cont(importance, 0.5), 6) AS p50 FROM articles WHERE importance > 5")
def a13_percentile(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "importance").where("importance > 5").agg(F.round(F.percentile("importance", 0.05), 6).alias("p05"), F.round(F.percentile("importance", 0.5), 6).alias("p50"))


@query("SELECT country, TRUE AS close FROM articles WHERE country IS NOT NULL GROUP BY country")
def a20_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Sketched numbers of distinct urls of each country, within a tenth of the exact ones."""
    n = articles(spark, d, "country", "url").where("country is not null").groupBy("country").agg(F.approx_count_distinct("url", 0.01).alias("sketch"), F.count_distinct("url").alias("n"))
    return n.select("country", (F.abs(F.col("sketch") - F.col("n")) <= F.greatest(F.lit(1), F.col("n") * 0.1)).alias("close"))
