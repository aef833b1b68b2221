"""The training-data queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import batches, blocks, encodings, languages, leaks, lookalikes, packing, repeated_lines, residue, subjects
from pressloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "articles"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(table(spark, d, "articles"), table(spark, d, "subject_labels")).select("article_id", "slug")


def p2_mix(spark: SparkSession, d: str) -> DataFrame:
    return subjects.mix(subjects.assign(table(spark, d, "articles"), table(spark, d, "subject_labels")), table(spark, d, "subjects"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated(table(spark, d, "articles"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_lines(table(spark, d, "articles", "article_id", "url", "text")).select("article_id", "text", "removed")


def p3_sequences(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.frequent_sequences(table(spark, d, "articles", "article_id", "url", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.affected(lookalikes.values(table(spark, d, "articles"), table(spark, d, "entity_ru")))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.one_form(lookalikes.values(table(spark, d, "articles"), table(spark, d, "entity_ru")))


def p4_equal(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.equal_values(lookalikes.values(table(spark, d, "articles"), table(spark, d, "entity_ru")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return batches.replay(table(spark, d, "articles", "article_id", "batch_no", "title_hash", "embedding"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return batches.class_of(table(spark, d, "articles", "article_id", "title_hash", "embedding"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return batches.class_links(table(spark, d, "articles", "article_id", "embedding")).select("class_1", "class_2", F.round("cos", 4).alias("cos"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return blocks.page_lines(table(spark, d, "articles"))


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    return blocks.bodies(table(spark, d, "articles"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.to_correct(table(spark, d, "articles"))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "articles"))


def p7_labels(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    return languages.labels(articles, languages.segments(articles))


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p8_use(spark: SparkSession, d: str) -> DataFrame:
    return packing.use(p8_bins(spark, d), table(spark, d, "containers"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.damaged(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restored(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_mix, p3_found, p3_clean, p3_sequences, p4_found, p4_forms, p4_equal, p5_found, p5_classes, p5_links, p6_found, p6_bodies, p7_found, p7_segments, p7_labels, p8_bins, p8_use, p9_found, p10_found, p10_restored)}


_SITE = r"""regexp_replace(coalesce(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), ''), '^(?:www|m|amp)\.', '')"""
_LINES = rf"""l AS (SELECT article_id, {_SITE} AS site, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM articles WHERE text IS NOT NULL),
k AS (SELECT article_id, site, CAST(line_no AS INT) AS line_no, trim(regexp_replace(regexp_replace(lower(raw), '[\s\p{{Z}}]+', ' ', 'g'), '\p{{Nd}}+', '0', 'g')) AS k FROM l)"""
_WORDS = r"regexp_extract_all(lower(replace({}, 'İ', 'i')), '[\p{{L}}\p{{N}}]+')"
_RUNS = "list_distinct(list_transform(generate_series(1, len(w) - 16), lambda i: array_to_string(w[i:i + 16], ' ')))"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH {_LINES} SELECT article_id, line_no FROM k WHERE k <> '' AND (site, k) IN (SELECT (site, k) FROM k WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT article_id) >= 4)""",
        "p5_found": """WITH u AS (SELECT article_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT article_id, CAST(embedding AS DOUBLE[]) AS v FROM articles WHERE embedding IS NOT NULL) WHERE len(v) > 0 AND list_dot_product(v, v) > 0)
SELECT a.article_id AS article_id_1, b.article_id AS article_id_2 FROM u a JOIN u b ON a.article_id < b.article_id WHERE list_dot_product(a.u, b.u) >= 0.95 - 1e-7
UNION SELECT a.article_id, b.article_id FROM articles a JOIN articles b ON a.title_hash = b.title_hash AND a.article_id < b.article_id""",
        "p5_classes": """WITH u AS (SELECT article_id, list_transform(v, lambda x: CAST(x / sqrt(list_dot_product(v, v)) AS FLOAT)) AS u FROM (SELECT article_id, CAST(embedding AS DOUBLE[]) AS v FROM articles WHERE embedding IS NOT NULL) WHERE len(v) > 0 AND list_dot_product(v, v) > 0)
SELECT 'vector' AS kind, article_id, min(article_id) OVER (PARTITION BY u) AS class_id FROM u UNION SELECT 'hash', article_id, min(article_id) OVER (PARTITION BY title_hash) FROM articles WHERE title_hash IS NOT NULL""",
        "p9_found": f"""WITH i AS (SELECT item_id, unnest({_RUNS}) AS run FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL) WHERE len(w) >= 17),
d AS (SELECT doc_id, unnest({_RUNS}) AS run FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 17)
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)""",
    }
