"""Greedy leader clustering as a distributed fixpoint.

The rows of a group are taken in order; a row becomes a leader unless an earlier leader lies within
the threshold, and then joins the earliest such leader. That is the lexicographically first maximal
independent set of the similarity graph. Only pairs within the threshold are built (by the segment
index); rows then settle in rounds: one without unsettled or leading earlier neighbours leads, one
with a leading earlier neighbour is absorbed. Equal vectors of a group are one class, which its first row stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.operators import similarity as S
from pressloom.storage import cut


def leaders(rows: DataFrame, group: str, order: list[str], column: str, settings: S.Settings) -> DataFrame:
    """article_id, leader: rows without a usable vector lead themselves.

    `rows` holds article_id (unique), the group, the vector column and the order columns, ascending; ties go to
    the smaller article_id.
    """
    key = F.struct(*order, "article_id")
    place = rows.select(F.col("article_id").cast("long").alias("id"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), key.alias("at"))
    vec = S.vectors(rows, settings, column)
    member = cut(vec.join(place, "id"))
    reps = member.groupBy("g", "h").agg(F.min_by("id", "at").alias("rep"), F.min("at").alias("at"), F.first("v").alias("v"))
    reps = cut(reps)
    index = S.segment_index(reps, settings).join(reps.select("rep", "g"), "rep")
    near = S.cosine_at_least(S.probe(index, index, settings, within=True, groups=("g",)), reps, reps, settings)
    ats = reps.select("rep", "at")
    pairs = near.join(ats.select(F.col("rep").alias("a"), F.col("at").alias("at_a")), "a").join(ats.select(F.col("rep").alias("b"), F.col("at").alias("at_b")), "b")
    first = F.col("at_a") < F.col("at_b")
    edges = cut(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late")))

    # 0 unsettled, 1 leader, 2 absorbed; only rows with edges take part in the rounds
    state = cut(edges.select(F.explode(F.array("early", "late")).alias("id")).distinct().withColumn("state", F.lit(0)))
    # every round settles the first unsettled row at least, so it ends
    while state.where("state = 0").limit(1).count():
        seen = edges.join(state.select(F.col("id").alias("early"), F.col("state").alias("s")), "early").groupBy("late").agg(F.max(F.col("s") == 1).alias("led"), F.max(F.col("s") == 0).alias("open"))
        settled = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("led", F.lit(False)), 2).when(~F.coalesce("open", F.lit(False)), 1).otherwise(0)
        state = cut(state.join(seen.withColumnRenamed("late", "id"), "id", "left").select("id", settled.alias("state")))
    lead = edges.join(state.where("state = 1").select(F.col("id").alias("early")), "early").join(ats.withColumnRenamed("rep", "early"), "early").groupBy("late").agg(F.min_by("early", "at").alias("leader"))
    absorbed = state.where("state = 2").select(F.col("id").alias("late"))
    by_rep = reps.select("rep", "g", "h").join(lead.join(absorbed, "late", "left_semi").withColumnRenamed("late", "rep"), "rep", "left").select("g", "h", F.coalesce("leader", "rep").alias("leader"))
    found = member.select("id", "g", "h").join(by_rep, ["g", "h"]).select("id", "leader")
    return place.select("id").join(found, "id", "left").select(F.col("id").alias("article_id"), F.coalesce("leader", "id").alias("leader"))
