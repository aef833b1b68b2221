"""Which dump rows mention a theme near a country, in one pass for all countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import gkg as G
from pressloom.settings import DEFAULT, THEMES, Settings


def country_codes(countries: DataFrame) -> DataFrame:
    """country, cc, country_ord: one row for each code of `A+B`, countries in the order of their names."""
    order = F.row_number().over(Window.orderBy("country")).alias("country_ord")  # a fixed dimension of some dozens of rows
    return countries.select("country", "fips", order).select("country", "country_ord", F.explode(F.split("fips", r"\+")).alias("cc"))


def candidates(gkg: DataFrame, themes: tuple[str, ...] = THEMES) -> DataFrame:
    """Cheap superset: rows that name a theme anywhere or have no V2 cells. Filters before the cells are parsed."""
    named = F.upper(G.cell(F.col("v2t"))).rlike("|".join(themes))
    return gkg.where(G.is_url(F.col("url"))).where(named | ~G.has_v2(F.col("v2t"), F.col("v2l")))


def parsed(gkg: DataFrame, themes: tuple[str, ...] = THEMES) -> DataFrame:
    """The rows with the offsets of target themes and the array of (cc, offset)."""
    targets = F.array(*map(F.lit, themes))
    hits = F.transform(F.filter(G.themes_v2(F.col("v2t")), lambda x: F.array_contains(targets, x["name"])), lambda x: x["offset"])
    return gkg.select("gkg_id", "dump_ts", "stream", "url", "gkg_date", "v1t", "v1l", G.has_v2(F.col("v2t"), F.col("v2l")).alias("v2"), hits.alias("hits"), G.locations_v2(F.col("v2l")).alias("places"), G.themes_v1(F.col("v1t")).alias("t1"), G.locations_v1(F.col("v1l")).alias("l1"))


def judged(gkg: DataFrame, countries: DataFrame, themes: tuple[str, ...] = THEMES, settings: Settings = DEFAULT) -> DataFrame:
    """gkg_id, country, v2, gap, share, ok for each row and each country it names.

    The places of a row are met with the code dimension (a broadcast of a table fixed in size), and
    a row is judged for all its countries at once instead of once for each country.
    """
    codes = F.broadcast(country_codes(countries))
    p = parsed(candidates(gkg, themes), themes)
    v2 = p.where("v2").select("gkg_id", "hits", F.size("places").alias("n"), F.explode("places").alias("p")).select("gkg_id", "hits", "n", F.col("p.cc").alias("cc"), F.col("p.offset").alias("at"))
    v2 = v2.withColumn("near", F.array_min(F.transform("hits", lambda h: F.abs(h - F.col("at"))))).join(codes, "cc")
    v2 = v2.groupBy("gkg_id", "country", "country_ord").agg(F.min("near").alias("gap"), (F.count(F.lit(1)) / F.max("n")).alias("share"))
    v2 = v2.select("gkg_id", "country", "country_ord", F.lit(True).alias("v2"), "gap", "share", (F.col("gap").isNotNull() & (F.col("share") >= settings.least_share) & (F.col("gap") <= settings.largest_gap)).alias("ok"))
    targets = F.array(*map(F.lit, themes))
    v1 = p.where(~F.col("v2")).select("gkg_id", F.arrays_overlap("t1", targets).alias("ok"), F.explode("l1").alias("cc")).join(codes, "cc")
    v1 = v1.groupBy("gkg_id", "country", "country_ord").agg(F.max("ok").alias("ok"))
    v1 = v1.select("gkg_id", "country", "country_ord", F.lit(False).alias("v2"), F.lit(None).cast("int").alias("gap"), F.lit(None).cast("double").alias("share"), "ok")
    return v2.unionByName(v1)


def selected(gkg: DataFrame, countries: DataFrame, themes: tuple[str, ...] = THEMES, settings: Settings = DEFAULT) -> DataFrame:
    """url, country, gkg_id: each url once; earlier dump, English stream, country order and row order win."""
    ok = judged(gkg, countries, themes, settings).where("ok").select("gkg_id", "country", "country_ord")
    rows = ok.join(gkg.select("gkg_id", "url", "dump_ts", "stream"), "gkg_id")
    rank = F.struct("dump_ts", F.when(F.col("stream") == "en", 0).otherwise(1).alias("s"), "country_ord", "gkg_id")
    return rows.groupBy("url").agg(F.min_by(F.struct("country", "gkg_id"), rank).alias("w")).select("url", "w.country", "w.gkg_id")
