"""Readers and page forms over files and pages that are made of the tables."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import pages as H
from pressloom.operators import embed as E
from pressloom.plans.oracle import NOW
from pressloom.plans.registry import registry
from pressloom.plans.scalars import articles, now
from pressloom.sources import files as R
from pressloom.sources.tables import table
from pressloom.storage import shared_folder

Q, SQL, query = registry()

_KEY = "array_to_string(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'), ' ')"


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT gkg_id, coalesce(nullif(gkg_date, ''), NULL) AS gkg_date, nullif(source, '') AS source, nullif(url, '') AS url, nullif(v2t, '') AS v2t, nullif(v2l, '') AS v2l, nullif(v1p, '') AS v1p FROM gkg")
def s01_dump_archives(spark: SparkSession, d: str) -> DataFrame:
    """The dump packed into one archive for each tick and stream, and read back; the row's own number travels in an unread column."""
    g = table(spark, d, "gkg").select("gkg_id", "dump_ts", "stream", *R.DUMP.values())

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        lines = []
        for r in p.to_dict("records"):
            cells = [""] * (max(R.DUMP) + 1)
            cells[0] = str(r["gkg_id"])
            for k, n in R.DUMP.items():
                cells[k] = r[n] or ""
            lines.append("\t".join(cells))
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("dump.csv", "\n".join([*lines, "a\tshort line", ""]))
        return pd.DataFrame({"path": [f"{p['dump_ts'].iloc[0]}.{p['stream'].iloc[0]}.zip"], "content": [data.getvalue()]})

    archives = g.groupBy("dump_ts", "stream").applyInPandas(pack, "path string, content binary")  # a tick is 15 minutes of rows
    rows = R.archive_rows(archives, {0: "gkg_id", **R.DUMP})
    return rows.select(F.col("gkg_id").cast("long").alias("gkg_id"), "gkg_date", "source", "url", "v2t", "v2l", "v1p")


@query("SELECT strftime(max(dump_ts), '%Y%m%d%H%M%S') AS tick FROM gkg")
def s03_latest_pointer(spark: SparkSession, d: str) -> DataFrame:
    """The newest tick that the pointer file names; it holds a line for each kind of dump."""
    stamp = F.date_format(F.max("dump_ts"), "yyyyMMddHHmmss")
    kinds = table(spark, d, "gkg").agg(stamp.alias("t")).select(F.explode(F.array(*(F.concat(F.lit("123 abc http://dumps.example/v2/"), "t", F.lit(f".{k}.csv.zip")) for k in ("export", "mentions", "gkg")))).alias("value"))
    path = folder(spark)
    kinds.write.text(path)
    return R.latest_pointer(spark, path)


@query(f"""SELECT name, ru, mode FROM (SELECT {_KEY} AS name, trim(ru) AS ru, CASE WHEN src = 'keep' THEN 'keep' ELSE 'ru' END AS mode, row_number() OVER (PARTITION BY {_KEY} ORDER BY entity_id % 2, entity_id) AS r
FROM entity_ru WHERE {_KEY} <> '' AND trim(coalesce(ru, '')) <> '') WHERE r = 1""")
def s12_glossary(spark: SparkSession, d: str) -> DataFrame:
    """Two glossary files, written and read back: the first file by name wins, within a file the first line."""
    e = table(spark, d, "entity_ru").where("name is not null").orderBy("entity_id")
    line = F.concat_ws("\t", "name", F.coalesce("ru", F.lit("")), F.when(F.col("src") == "keep", "keep").otherwise("ru"))
    path = folder(spark)
    for k in (0, 1):
        e.where(F.col("entity_id") % 2 == k).select(line.alias("value")).write.text(f"{path}/glossary_{k}")
    spark.range(1).select(F.lit("# a comment\tx\tru").alias("value")).write.text(f"{path}/glossary_9")
    return R.glossary(spark, f"{path}/glossary_*").select("name", "ru", "mode")


@query("SELECT slug, title AS name, CAST(row_number() OVER (ORDER BY slug) - 1 AS INT) AS ord FROM subjects UNION ALL SELECT 'other', 'Other', CAST(count(*) AS INT) FROM subjects")
def s13_topic_lists(spark: SparkSession, d: str) -> DataFrame:
    """A topic list written as JSON and read back with its checks."""
    one = F.struct("slug", F.col("title").alias("name"), F.array(F.col("slug")).alias("words"))
    known = table(spark, d, "subjects").agg(F.array_sort(F.collect_list(one)).alias("x"))  # a fixed dimension
    other = F.array(F.struct(F.lit("other").alias("slug"), F.lit("Other").alias("name"), F.array().cast("array<string>").alias("words")))
    path = folder(spark)
    known.select(F.to_json(F.concat("x", other)).alias("value")).write.text(path)
    return R.topic_lists(spark, path).select("slug", "name", F.col("ord").cast("int").alias("ord"))


@query("""SELECT article_id, round(a / sqrt(a * a + 1), 5) AS x, round(1 / sqrt(a * a + 1), 5) AS y FROM (SELECT article_id, list_avg(list_transform(string_split('passage: ' || title, ' '), lambda w: length(w))) AS a FROM articles WHERE title IS NOT NULL)""")
def s14_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all titles by the stand-in encoder: pooled by mask, of unit length."""
    v = E.embedded(articles(spark, d, "article_id", "title"), "article_id", "title", E.word_shapes, 2)
    return v.select("article_id", F.round(F.col("vector")[0].cast("double"), 5).alias("x"), F.round(F.col("vector")[1].cast("double"), 5).alias("y"))


_T = "coalesce(try_cast(replace(regexp_replace(trim({0}), '/', '-', 'g'), 'T', ' ') AS TIMESTAMP), try_strptime(regexp_extract(regexp_replace(trim({0}), '/', '-', 'g'), '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})', 1), '%Y-%m-%d'))"


@query(f"""WITH p AS (SELECT article_id, fetched_at AS seen, {_T.format('publish_date')} AS t, length(publish_date) BETWEEN 10 AND 40 AS fits, article_id % 5 AS kind FROM articles),
q AS (SELECT *, CASE WHEN t <= seen AND t >= seen - INTERVAL 3653 DAY AND fits THEN t END AS ok, CAST(CAST(seen AS DATE) - 2 AS TIMESTAMP) AS hint FROM p)
SELECT article_id, epoch_us(CASE WHEN kind = 4 THEN hint ELSE coalesce(ok, hint) END) AS us FROM q""")
def d02_page_stamp(spark: SparkSession, d: str) -> DataFrame:
    """Publication time out of page markup: pages with their date in a meta tag of either order, in linked data, after a date of the future, or nowhere."""
    a = articles(spark, d, "article_id", "publish_date", "fetched_at").withColumn("seen", F.col("fetched_at").cast("timestamp"))
    p = F.coalesce("publish_date", F.lit(""))
    kind = F.col("article_id") % 5
    meta = F.concat(F.lit("<meta property=\"article:published_time\" content=\""), p, F.lit("\">"))
    back = F.concat(F.lit("<meta content='"), p, F.lit("' name='sailthru.date'/>"))
    data = F.concat(F.lit("<script type=\"application/ld+json\">{\"datePublished\": \""), p, F.lit("\"}</script>"))
    late = F.concat(F.lit("<meta itemprop=\"datePublished\" content=\"2099-01-01T00:00:00\">"), meta)
    html = F.concat(F.lit("<html><head>"), F.when(kind == 0, meta).when(kind == 1, back).when(kind == 2, data).when(kind == 3, late).otherwise("<meta name=\"author\" content=\"2020-01-01\">"), F.lit("</head><body>2001-01-01</body></html>"))
    hint = F.date_sub(F.to_date("seen"), 2).cast("string")
    return a.select("article_id", F.unix_micros(H.page_stamp(html, F.col("seen"), hint)).alias("us"))


@query("""SELECT article_id, sha1(t) AS text_hash, length(t) AS n FROM (SELECT article_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), '[\\r\\x0B\\f]', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS t
FROM articles WHERE NOT regexp_matches(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x85\\x{2028}\\x{2029}]|&[a-z#]') )""")
def x01_page_text(spark: SparkSession, d: str) -> DataFrame:
    """Text out of pages that hold each line of an article as a paragraph between menus and scripts; short finds fall back to the whole page.

    Texts with control characters or entities, which a page holds otherwise, are left out on both sides.
    """
    a = articles(spark, d, "article_id", "text").where(~F.coalesce("text", F.lit("")).rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x85  ]|&[a-z#]"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), H.escaped(x), F.lit("</p>")))
    page = F.concat(F.lit("<html><head><style>p {}</style></head><body><nav><a>Menu</a></nav><script>var a = '<p>no</p>';</script><article>"), F.array_join(lines, "\n"), F.lit("</article><footer>Foot</footer></body></html>"))
    found = a.select("article_id", H.extracted(page).alias("t"))
    return found.select("article_id", F.sha1("t").alias("text_hash"), F.length("t").alias("n"))


@query(f"SELECT article_id, text_hash, kept FROM (SELECT article_id, sha1(coalesce(title, '')) AS text_hash, length(coalesce(text, '')) >= 300 AS kept FROM articles WHERE fetched_at > {NOW} - INTERVAL 48 HOUR)")
def x03_rescued(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the last two days fetched again by a stand-in browser; a find counts from 300 characters on."""
    a = articles(spark, d, "article_id", "title", "text", "fetched_at").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    recent = a.crossJoin(now(a)).where(F.col("fetched_at") > F.col("now") - F.expr("interval 48 hours")).select("article_id", "title", "text")
    return H.fetched(recent, lambda r: (r["text"] or "", r["title"] or "")).select("article_id", F.sha1("title").alias("text_hash"), (F.length("text") >= 300).alias("kept"))


_NAMES = "nm AS (SELECT article_id, title, list_distinct(list_filter(string_split(coalesce(entities, ''), ';'), lambda x: length(x) > 3 AND contains(lower(title), x))) AS ns FROM articles WHERE title IS NOT NULL)"


@query(f"WITH {_NAMES} SELECT article_id, lower(title) AS back, FALSE AS lost, len(ns) AS names FROM nm")
def l04_protect_restore(spark: SparkSession, d: str) -> DataFrame:
    """Names hidden behind markers, a stand-in translation that changes the markers' case and spacing, and the names put back."""
    low = F.lower("title")
    names = F.array_distinct(F.filter(F.split(F.coalesce("entities", F.lit("")), ";"), lambda x: (F.length(x) > 3) & F.contains(low, x)))
    a = articles(spark, d, "article_id", "title", "entities").where("title is not null").select("article_id", low.alias("title"), names.alias("ns"))
    hidden = H.protected(F.col("title"), F.col("ns"))
    moved = F.regexp_replace(hidden, r"XX(\d+)XX", "xx $1 XX")
    return a.withColumn("moved", moved).select("article_id", H.restored(F.col("moved"), F.col("ns")).alias("back"), H.markers_lost(F.col("moved"), F.col("ns")).alias("lost"), F.size("ns").alias("names"))


@query()
def k14_asset_version(spark: SparkSession, d: str) -> DataFrame:
    """Eight digits of the sha1 over the contents of three files, in the order of their names."""
    path = f"{d}/{{countries,nation,subjects}}.parquet"
    return R.content_version(spark, path)
