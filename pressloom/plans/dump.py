"""Queries over the raw dump: cells, verdicts, ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import gkg as G
from pressloom.functions import time as D
from pressloom.operators import gkg as O
from pressloom.operators import ticks as K
from pressloom.plans.oracle import JUDGED
from pressloom.plans.registry import registry
from pressloom.sources.tables import table

Q, SQL, query = registry()


@query("""SELECT gkg_id, upper(trim(regexp_extract(x, '^(.*),[^,]*$', 1))) AS theme, CAST(regexp_extract(x, ',\\s*([0-9]+)\\s*$', 1) AS INT) AS off
FROM (SELECT gkg_id, unnest(string_split(coalesce(v2t, ''), ';')) AS x FROM gkg)
WHERE trim(regexp_extract(x, '^(.*),[^,]*$', 1)) <> '' AND regexp_extract(x, ',\\s*([0-9]+)\\s*$', 1) <> ''""")
def g01_themes_v2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg", "gkg_id", "v2t").select("gkg_id", F.explode(G.themes_v2(F.col("v2t"))).alias("x")).select("gkg_id", F.col("x.name").alias("theme"), F.col("x.offset").alias("off"))


@query("""SELECT gkg_id, upper(trim(p[3])) AS cc, CAST(trim(p[-1]) AS INT) AS off FROM (SELECT gkg_id, string_split(unnest(string_split(coalesce(v2l, ''), ';')), '#') AS p FROM gkg)
WHERE len(p) >= 9 AND length(trim(p[3])) = 2 AND regexp_full_match(trim(p[-1]), '[0-9]+')""")
def g02_locations_v2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg", "gkg_id", "v2l").select("gkg_id", F.explode(G.locations_v2(F.col("v2l"))).alias("x")).select("gkg_id", F.col("x.cc").alias("cc"), F.col("x.offset").alias("off"))


@query("SELECT DISTINCT gkg_id, upper(trim(x)) AS theme FROM (SELECT gkg_id, unnest(string_split(coalesce(v1t, ''), ';')) AS x FROM gkg) WHERE trim(x) <> ''")
def g03_themes_v1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg", "gkg_id", "v1t").select("gkg_id", F.explode(G.themes_v1(F.col("v1t"))).alias("theme"))


@query("""SELECT DISTINCT gkg_id, upper(trim(p[3])) AS cc FROM (SELECT gkg_id, string_split(unnest(string_split(coalesce(v1l, ''), ';')), '#') AS p FROM gkg)
WHERE len(p) >= 3 AND length(trim(p[3])) = 2""")
def g04_locations_v1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg", "gkg_id", "v1l").select("gkg_id", F.explode(G.locations_v1(F.col("v1l"))).alias("cc"))


@query(f"WITH {JUDGED} SELECT gkg_id, country, gap, round(share, 6) AS share FROM judged WHERE v2 AND gap IS NOT NULL")
def g05_min_gap(spark: SparkSession, d: str) -> DataFrame:
    return O.judged(table(spark, d, "gkg"), table(spark, d, "countries")).where("v2 and gap is not null").select("gkg_id", "country", "gap", F.round("share", 6).alias("share"))


@query(f"WITH {JUDGED} SELECT gkg_id, country, ok FROM judged WHERE v2")
def g06_judge_v2(spark: SparkSession, d: str) -> DataFrame:
    return O.judged(table(spark, d, "gkg"), table(spark, d, "countries")).where("v2").select("gkg_id", "country", "ok")


@query(f"WITH {JUDGED} SELECT gkg_id, country, ok FROM judged WHERE NOT v2")
def g07_judge_v1(spark: SparkSession, d: str) -> DataFrame:
    return O.judged(table(spark, d, "gkg"), table(spark, d, "countries")).where("not v2").select("gkg_id", "country", "ok")


@query(f"WITH {JUDGED} SELECT gkg_id, v2 FROM cand")
def g08_prereject(spark: SparkSession, d: str) -> DataFrame:
    return O.candidates(table(spark, d, "gkg")).select("gkg_id", G.has_v2(F.col("v2t"), F.col("v2l")).alias("v2"))


@query(f"""WITH {JUDGED} SELECT country, dump_ts, stream, url, min(gkg_id) AS gkg_id FROM judged JOIN gkg USING (gkg_id) WHERE ok GROUP BY country, dump_ts, stream, url""")
def g09_first_row(spark: SparkSession, d: str) -> DataFrame:
    """Of one url in one dump, the first accepted row for each country."""
    gkg = table(spark, d, "gkg")
    ok = O.judged(gkg, table(spark, d, "countries")).where("ok").select("gkg_id", "country")
    return ok.join(gkg.select("gkg_id", "url", "dump_ts", "stream"), "gkg_id").groupBy("country", "dump_ts", "stream", "url").agg(F.min("gkg_id").alias("gkg_id"))


@query("SELECT gkg_id FROM gkg WHERE contains(lower(coalesce(source, '') || ' ' || coalesce(url, '')), 'science') OR contains(lower(coalesce(source, '') || ' ' || coalesce(url, '')), 'tech')")
def g10_extra_terms(spark: SparkSession, d: str) -> DataFrame:
    where = F.lower(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("url", F.lit(""))))
    return table(spark, d, "gkg").where(where.contains("science") | where.contains("tech")).select("gkg_id")


@query("SELECT gkg_id, CAST(CAST(try_strptime(nullif(regexp_extract(coalesce(gkg_date, ''), '^([0-9]{8})', 1), ''), '%Y%m%d') AS DATE) AS VARCHAR) AS day FROM gkg")
def g11_gkg_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg").select("gkg_id", G.date_of(F.col("gkg_date")).cast("string").alias("day"))


@query(f"WITH {JUDGED} SELECT gkg_id, country, v2, ok FROM judged")
def g12_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return O.judged(table(spark, d, "gkg"), table(spark, d, "countries")).select("gkg_id", "country", "v2", "ok")


@query(f"""WITH {JUDGED} SELECT url, country, gkg_id FROM (
  SELECT g.url, j.country, j.gkg_id, row_number() OVER (PARTITION BY g.url ORDER BY g.dump_ts, CASE WHEN g.stream = 'en' THEN 0 ELSE 1 END, j.country_ord, j.gkg_id) AS r
  FROM judged j JOIN gkg g ON g.gkg_id = j.gkg_id WHERE j.ok) WHERE r = 1""")
def g13_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return O.selected(table(spark, d, "gkg"), table(spark, d, "countries"))


@query(f"""WITH {JUDGED} SELECT country, count(*) AS n, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS dropped, count(*) FILTER (WHERE NOT v2) AS v1_rows,
  round(quantile_cont(gap, 0.5), 6) AS gap_median, round(quantile_cont(gap, 0.9), 6) AS gap_p90, round(quantile_cont(share, 0.1), 6) AS share_p10, round(quantile_cont(share, 0.5), 6) AS share_median FROM judged GROUP BY country""")
def g14_filter_statistics(spark: SparkSession, d: str) -> DataFrame:
    j = O.judged(table(spark, d, "gkg"), table(spark, d, "countries"))
    return j.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("dropped"), F.count_if(~F.col("v2")).alias("v1_rows"), *(F.round(F.percentile(c, p), 6).alias(n) for c, p, n in (("gap", 0.5, "gap_median"), ("gap", 0.9, "gap_p90"), ("share", 0.1, "share_p10"), ("share", 0.5, "share_median"))))


@query("SELECT gkg_id, stream, dump_ts FROM gkg WHERE stream = 'en' UNION ALL SELECT gkg_id, stream, dump_ts FROM gkg WHERE stream = 'tl'")
def s02_two_streams(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gkg", "gkg_id", "stream", "dump_ts")
    return g.where("stream = 'en'").unionByName(g.where("stream = 'tl'"))


@query("""SELECT unnest(generate_series(date_trunc('hour', max(dump_ts)) - INTERVAL 6 HOUR, date_trunc('hour', max(dump_ts)), INTERVAL 15 MINUTE)) AS tick FROM gkg""")
def s04_rolling_ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gkg").agg(F.date_trunc("hour", F.max("dump_ts")).alias("h")).select(F.explode(F.expr("sequence(h - interval 6 hours, h, interval 15 minutes)")).alias("tick"))


_FROM = "generate_series({0}, l, INTERVAL 15 MINUTE)"


@query(f"""WITH c AS (SELECT max(dump_ts) AS l, time_bucket(INTERVAL 15 MINUTE, max(dump_ts) - INTERVAL 30 HOUR) AS stored FROM gkg)
SELECT 'stored' AS cursor, tick FROM (SELECT unnest({_FROM.format("stored + INTERVAL 15 MINUTE")}) AS tick FROM c ORDER BY tick LIMIT 24)
UNION ALL SELECT 'none', tick FROM (SELECT unnest({_FROM.format("l - INTERVAL 2 HOUR")}) AS tick FROM c)""")
def s05_pending_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of the next run from a stored cursor thirty hours back, and of a first run without one."""
    latest = table(spark, d, "gkg", "dump_ts").agg(F.max("dump_ts").cast("timestamp").alias("latest"))
    stored = latest.select(D.tick(F.col("latest") - F.expr("interval 30 hours")).alias("cursor"))
    run = lambda c: K.pending(c, latest).select("tick")
    none = latest.select(F.lit(None).cast("timestamp").alias("cursor"))
    return run(stored).select(F.lit("stored").alias("cursor"), "tick").unionByName(run(none).select(F.lit("none").alias("cursor"), "tick"))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS tick, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def d04_tick_floor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(D.tick(F.col("ts")).alias("tick")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("""WITH seen AS (SELECT DISTINCT dump_ts FROM gkg), lim AS (SELECT min(dump_ts) AS a, max(dump_ts) AS b FROM gkg),
t AS (SELECT unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS tick FROM lim)
SELECT tick FROM t LEFT JOIN seen ON seen.dump_ts = t.tick WHERE seen.dump_ts IS NULL AND tick <= (SELECT b FROM lim) - INTERVAL 90 MINUTE""")
def w02_holes(spark: SparkSession, d: str) -> DataFrame:
    """Ticks without a dump, 90 minutes old or more, that a run may skip."""
    g = table(spark, d, "gkg", "dump_ts")
    ticks = g.agg(F.min("dump_ts").alias("a"), F.max("dump_ts").alias("b")).select("b", F.explode(F.expr("sequence(a, b, interval 15 minutes)")).alias("tick"))
    return ticks.where("tick <= b - interval 90 minutes").join(g.select(F.col("dump_ts").alias("tick")), "tick", "left_anti").select("tick")
