"""Problem 5: new batches against all history.

A segment index for bounded edit distance. Every vector is written as a signature, a fixed
string of sign bits of `segments * width` random projections; it is cut into `segments`
segments of `width` bits, each stored under its position and content (the length is one
and the same). Two signatures within `segments - 1` substitutions share a segment; beyond
that, sharing is a matter of chance: at cosine 0.95 one segment in 4.4 stays whole, so
that 1 - (1 - 0.2247) ** 28 = 0.9992 of such pairs meet, and 0.9999 at 0.965. Pairs that
meet are verified by the edit distance of their signatures (substitutions, counted by xor)
and then by the cosine itself. Title hashes are strings of one length matched at distance
0: one segment, the whole string.

The index is a stored table of (key of position and content, id, signature), written load by load. A new load
probes the stored segments, then appends its own under its name, so that a load written again replaces itself; nothing
of the history is computed again. The segments are as wide as the logarithm of the rows the store is planned for
(`similarity.fitted`), so unrelated rows that meet stay at a few a row. A load of up to `small` segments is
broadcast, and the history is read without a shuffle; a larger one is joined by shuffle.
Equal vectors are one class: only a class representative is indexed, so a vector shared
by a third of all rows adds one posting for each segment; members are stored beside the index
and joined back at the end.

Edge cases: null vectors, vectors with a null or without a norm and of different lengths match
nothing; a null title_hash matches nothing; repeated rows with one id never pair with
themselves; a null batch_no counts as the last batch; an empty table gives no pair.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators.similarity import Settings, classes, cosine_at_least, fitted, members, probe, segment_index, vectors
from pressloom.storage import cut, shared_folder

COSINE = 0.95


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("article_id_1"), F.greatest(a, b).alias("article_id_2")]


def expanded(near: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of members of the classes a, b that match; left: rep, id of the one side, right: of the other."""
    both = near.join(left.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(right.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    return both.where("x <> y").select(*ordered(F.col("x"), F.col("y")))


@dataclass(frozen=True)
class Load:
    """A load made ready once: its classes of equal vectors, their members and its title hashes."""

    reps: DataFrame
    member: DataFrame
    hashes: DataFrame


def prepared(batch: DataFrame, settings: Settings) -> Load:
    vecs = cut(vectors(batch, settings))
    reps = cut(classes(vecs))
    hashes = batch.where(F.col("title_hash").isNotNull()).select("title_hash", F.col("article_id").cast("long").alias("id"))
    return Load(reps.select("rep", "v"), cut(members(vecs, reps)), hashes)


def same_hash(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of one title_hash between (title_hash, id) of two sides."""
    both = left.select("title_hash", F.col("id").alias("x")).join(right.select("title_hash", F.col("id").alias("y")), "title_hash")
    return both.where("x <> y").select(*ordered(F.col("x"), F.col("y")))


def within(load: Load, settings: Settings) -> DataFrame:
    """article_id_1 < article_id_2: pairs of one load, by an index of its own; may name a pair twice."""
    index = segment_index(load.reps, settings)
    near = cosine_at_least(probe(index, index, settings, within=True), load.reps, load.reps, settings).select("a", "b")
    own = load.reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    more = load.hashes.groupBy("title_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("title_hash")
    hashes = load.hashes.join(more, "title_hash")
    return expanded(near.unionByName(own), load.member, load.member).unionByName(same_hash(hashes, hashes))


def all_pairs(articles: DataFrame, settings: Settings | None = None) -> DataFrame:
    """article_id_1 < article_id_2: all pairs of a table that is one batch."""
    settings = settings or fitted(articles, COSINE)
    return within(prepared(articles, settings), settings).distinct()


def class_of(articles: DataFrame) -> DataFrame:
    """kind, article_id, class_id: membership in classes of equal vectors and of equal title hashes; the class is named by its smallest id."""
    vecs = vectors(articles, fitted(articles, COSINE))
    same = members(vecs, classes(vecs)).select(F.lit("vector").alias("kind"), F.col("id").alias("article_id"), F.col("rep").alias("class_id"))
    h = articles.where(F.col("title_hash").isNotNull()).select("title_hash", F.col("article_id").cast("long").alias("article_id"))
    first = h.groupBy("title_hash").agg(F.min("article_id").alias("class_id"))
    return same.unionByName(h.join(first, "title_hash").select(F.lit("hash").alias("kind"), "article_id", "class_id")).distinct()


def class_links(articles: DataFrame) -> DataFrame:
    """class_1 < class_2, cos: classes of equal vectors that repeat one another. With `class_of`, all pairs without their expansion."""
    s = fitted(articles, COSINE)
    reps = cut(classes(vectors(articles, s)))
    index = segment_index(reps, s)
    near = cosine_at_least(probe(index, index, s, within=True), reps, reps, s)
    return near.select(F.least("a", "b").alias("class_1"), F.greatest("a", "b").alias("class_2"), "cos").distinct()


def append(load: Load, path: str, name: str, settings: Settings) -> None:
    """Adds a load to the stored index: its segments in the order of their keys, class vectors, members and title hashes; the same name again replaces it."""
    segment_index(load.reps, settings).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/segments/load={name}")
    load.reps.write.mode("overwrite").parquet(f"{path}/vectors/load={name}")
    load.member.write.mode("overwrite").parquet(f"{path}/members/load={name}")
    load.hashes.write.mode("overwrite").parquet(f"{path}/hashes/load={name}")


def check_batch(load: Load, path: str, settings: Settings, small: int = 50_000) -> DataFrame:
    """article_id_1 < article_id_2: pairs of an article of the load with a stored one or with another of the load; each once.

    Only the segments, and the vectors and members of classes that met, are read of the history.
    Nothing stored yet: the pairs of the load alone.
    """
    inside = within(load, settings)
    spark = load.reps.sparkSession
    loads = loads_of(spark, path)
    if not loads:
        return inside.distinct()
    stored, old, theirs, hashes = (stored_part(spark, path, x, loads) for x in ("segments", "vectors", "members", "hashes"))
    # an article that comes again may stand for its class on both sides
    again = load.reps.join(old.select("rep").distinct(), "rep").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    met = probe(segment_index(load.reps, settings), stored, settings, small=load.reps.count() * settings.segments <= small)
    near = cosine_at_least(met.unionByName(again), load.reps, old, settings).select("a", "b")
    return expanded(near, load.member, theirs).unionByName(same_hash(load.hashes, hashes)).unionByName(inside).distinct()


def replay(articles: DataFrame, loads: int = 2) -> DataFrame:
    """article_id_1 < article_id_2: what is reported when the table arrives in `loads` deliveries of whole batches, in order.

    Each delivery is checked against the store of the earlier ones and then appended to it. The store lies in the session's shared folder.
    """
    last = 2**31 - 1
    rows = articles.withColumn("batch_no", F.coalesce(F.col("batch_no").cast("long"), F.lit(last)))
    edges = rows.agg(F.percentile_approx("batch_no", [k / loads for k in range(1, loads)]).alias("e")).first().e or []
    edges = sorted({*edges, last})
    settings, path = fitted(articles, COSINE), f"{shared_folder(articles.sparkSession)}/segments-{uuid.uuid4().hex}"
    found, low = [], None
    for k, high in enumerate(edges):
        load = rows.where(F.col("batch_no") <= high) if low is None else rows.where((F.col("batch_no") > low) & (F.col("batch_no") <= high))
        ready = prepared(load, settings)
        found.append(cut(check_batch(ready, path, settings)))
        if k + 1 < len(edges):
            append(ready, path, f"{k:06d}", settings)
        low = high
    return reduce(DataFrame.unionByName, found).distinct()


def loads_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the loads that a store holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/hashes")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def stored_part(spark: SparkSession, path: str, part: str, loads: list[str]) -> DataFrame:
    # by the loads' own paths: plans over one folder that grew between two reads would be taken for the same
    return spark.read.option("basePath", f"{path}/{part}").parquet(*(f"{path}/{part}/{x}" for x in loads))
