"""Theme, location and name cells of the raw dump."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def themes_v2(c: Column) -> Column:
    """`THEME,offset;...` as an array of (name, offset); entries without a name or a whole offset left out."""
    parts = F.transform(F.split(cell(c), ";"), lambda x: F.struct(F.upper(F.trim(F.regexp_extract(x, r"^(.*),[^,]*$", 1))).alias("name"), F.regexp_extract(x, r",\s*([0-9]+)\s*$", 1).alias("o")))
    kept = F.filter(parts, lambda x: (x["name"] != "") & (x["o"] != ""))
    return F.transform(kept, lambda x: F.struct(x["name"].alias("name"), x["o"].try_cast("int").alias("offset")))


def locations_v2(c: Column) -> Column:
    """`type#name#CC#...#offset;...` as an array of (cc, offset); short entries and odd codes left out."""
    parts = F.transform(F.split(cell(c), ";"), lambda x: F.split(x, "#"))
    kept = F.filter(parts, lambda p: (F.size(p) >= 9) & F.upper(F.trim(F.get(p, F.lit(2)))).rlike("^..$") & F.trim(F.element_at(p, -1)).rlike("^[0-9]+$"))
    return F.transform(kept, lambda p: F.struct(F.upper(F.trim(F.get(p, F.lit(2)))).alias("cc"), F.trim(F.element_at(p, -1)).try_cast("int").alias("offset")))


def themes_v1(c: Column) -> Column:
    """`THEME;...` as distinct names."""
    return F.array_distinct(F.filter(F.transform(F.split(cell(c), ";"), lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def locations_v1(c: Column) -> Column:
    """`type#name#CC#...;...` as distinct two-letter codes."""
    codes = F.transform(F.filter(F.transform(F.split(cell(c), ";"), lambda x: F.split(x, "#")), lambda p: F.size(p) >= 3), lambda p: F.upper(F.trim(F.get(p, F.lit(2)))))
    return F.array_distinct(F.filter(codes, lambda x: x.rlike("^..$")))


def date_of(c: Column) -> Column:
    """Day of the first eight digits, null if they are none."""
    day = F.regexp_extract(cell(c), r"^([0-9]{8})", 1)
    return F.try_to_timestamp(F.when(day != "", day), F.lit("yyyyMMdd")).cast("date")


def is_url(c: Column) -> Column:
    return cell(c).startswith("http")


def has_v2(themes: Column, locations: Column) -> Column:
    return (F.trim(cell(themes)) != "") | (F.trim(cell(locations)) != "")
