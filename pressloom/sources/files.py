"""Readers of dump archives, glossaries and topic lists."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions.pages import latest_tick
from pressloom.functions.text import phrase_key

#: Positions and names of the dump columns that are read.
DUMP = {1: "gkg_date", 3: "source", 4: "url", 7: "v1t", 8: "v2t", 9: "v1l", 10: "v2l", 11: "v1p", 13: "v1o"}


def dump_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the zipped dumps of a folder; see `archive_rows`."""
    return archive_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content"))


def archive_rows(files: DataFrame, cells: dict[int, str] = DUMP) -> DataFrame:
    """Rows of zipped, tab-separated dumps (path, content): the named cells, all strings, with `file` and `row_no`.

    Short lines and broken archives are skipped, bytes that are no UTF-8 are replaced; an empty cell is null. One archive
    (15 minutes of rows) is a task's unit of work.
    """
    names = ["file", "row_no", *cells.values()]
    schema = pa.schema([("file", pa.string()), ("row_no", pa.int64()), *((n, pa.string()) for n in cells.values())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[list] = [[] for _ in names]
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        lines = [x for member in z.namelist() for x in z.read(member).decode("utf-8", "replace").split("\n")]
                except zipfile.BadZipFile:
                    continue
                for n, line in enumerate(lines):
                    found = line.rstrip("\r").split("\t")
                    if len(found) > max(cells):
                        for k, v in enumerate([file, n, *(found[i] or None for i in cells)]):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict(dict(zip(names, rows, strict=True)), schema=schema)

    return files.mapInArrow(read, "file string, row_no long, " + ", ".join(f"{n} string" for n in cells.values()))


def latest_pointer(spark: SparkSession, path: str) -> DataFrame:
    """tick: the newest tick of the pointer file's dump line, as yyyyMMddHHmmss; no row if it names none."""
    return spark.read.text(path).select(latest_tick(F.col("value")).alias("tick")).where("tick <> ''").agg(F.max("tick").alias("tick")).where("tick is not null")


def content_version(spark: SparkSession, path: str, digits: int = 8) -> DataFrame:
    """version: the first digits of the sha1 over the files' contents in the order of their paths. For a handful of files."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("h"))
    return files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), "").alias("all")).select(F.substring(F.sha1("all"), 1, digits).alias("version"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """name, ru, mode, gloss of tab-separated glossaries: of one name the first file by name, then the first line.

    Comment lines, short lines and unknown modes are left out; the name is its words in lower case by single spaces.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.split("value", "\t").alias("c"), "value")
    cells = lines.where(~F.col("value").startswith("#") & (F.size("c") >= 3)).select("file", "at", phrase_key(F.get("c", F.lit(0))).alias("name"), F.trim(F.get("c", F.lit(1))).alias("ru"), F.trim(F.get("c", F.lit(2))).alias("mode"), F.trim(F.get("c", F.lit(3))).alias("gloss"))
    good = cells.where("name <> '' and ru <> '' and mode in ('keep', 'ru')")
    return good.groupBy("name").agg(F.min_by(F.struct("ru", "mode", "gloss"), F.struct("file", "at")).alias("w")).select("name", "w.ru", "w.mode", "w.gloss")


def topic_lists(spark: SparkSession, path: str, most: int = 31) -> DataFrame:
    """slug, name, words, ord of a JSON topic list. Refused: a repeated slug, no `other`, more than `most` topics."""
    raw = spark.read.schema("slug string, name string, words array<string>").json(path, multiLine=True)
    rows = raw.withColumn("ord", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)  # at most some dozens
    slugs = [r.slug for r in rows.select("slug").limit(most + 1).collect()]
    if len(set(slugs)) != len(slugs) or "other" not in slugs or len(slugs) > most:
        raise ValueError("a topic list needs distinct slugs, `other` among them, and no more than the mask holds")
    return rows
