"""Graph score of stories: centrality, coverage and prominent names, damped by age."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.settings import DEFAULT, Settings
from pressloom.storage import cut


def coverage(outlets: Column, full: int = DEFAULT.full_coverage) -> Column:
    """0 for one outlet, 1 from `full` outlets on, by logarithm."""
    return F.when(outlets <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(outlets - 1) / F.log1p(F.lit(full - 1.0))))


def minmax(value: Column, *group: str) -> Column:
    """Scaled to [0, 1] within the group; 0.5 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low <= 1e-12, 0.5).otherwise((value - low) / (high - low))


def weights(a: np.ndarray, b: np.ndarray, dom_a: np.ndarray, dom_b: np.ndarray, same: bool) -> np.ndarray:
    """Clipped cosines between two blocks; no edge to itself nor within one outlet."""
    w = np.clip(a @ b.T, 0.0, None)
    w[(dom_a[:, None] == dom_b[None, :]) & (dom_a[:, None] != "")] = 0.0
    if same:
        np.fill_diagonal(w, 0.0)
    return w


def unit(rows: list) -> np.ndarray:
    m = np.array(rows, dtype=np.float64)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)


def lexrank(nodes: DataFrame, group: str, rounds: int = 100, damping: float = DEFAULT.damping, block: int = 2048, still: float = 1e-6) -> DataFrame:
    """group, id, lex: stationary weight of each node of its group's similarity graph; power steps until they change less than `still` in all, `rounds` at most.

    `nodes` holds the group, id, vector (array) and domain. A group of up to `block` nodes is one
    task's matrix. Larger groups are cut into blocks of that size, whose pairs of blocks make partial
    sums; neither the graph nor a group is ever held in one task.
    """
    size = nodes.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sized = nodes.join(size, group)
    schema = f"{group} string, id long, lex double"

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        n = len(p)
        if n == 1:
            return pd.DataFrame({group: p[group], "id": p["id"], "lex": [1.0]})
        dom = p["domain"].to_numpy(dtype=object)
        v = unit(p["vector"].tolist())
        w = weights(v, v, dom, dom, True)
        total = w.sum(axis=1)
        stuck = total == 0
        s = np.full(n, 1.0 / n)
        for _ in range(rounds):
            before, s = s, (1 - damping) / n + damping * (w.T @ np.where(stuck, 0, s / np.where(stuck, 1, total)) + s[stuck].sum() / n)
            if np.abs(s - before).sum() < still:
                break
        return pd.DataFrame({group: p[group], "id": p["id"], "lex": s})

    small = sized.where(F.col("n") <= block).select(group, "id", "vector", "domain").groupBy(group).applyInPandas(whole, schema)
    if not size.where(F.col("n") > block).limit(1).count():
        return small
    return small.unionByName(_in_blocks(sized.where(F.col("n") > block), group, rounds, damping, block, still))


def _in_blocks(sized: DataFrame, group: str, rounds: int, damping: float, block: int, still: float) -> DataFrame:
    part = F.pmod(F.xxhash64("id"), F.ceil(2 * F.col("n") / block).cast("long")).cast("int")
    cells = F.sort_array(F.collect_list(F.struct("id", "vector", "domain")))
    blocks = cut(sized.select(group, "n", part.alias("k"), "id", "vector", "domain").groupBy(group, "n", "k").agg(cells.alias("c")))
    left = blocks.select(group, "n", F.col("k").alias("i"), F.col("c").alias("ci"))
    pairs = left.join(blocks.select(group, F.col("k").alias("j"), F.col("c").alias("cj")), group)  # pairs of blocks, not of rows
    state = cut(blocks.select(group, "n", F.explode("c").alias("x")).select(group, "n", F.col("x.id").alias("id"), (1.0 / F.col("n")).alias("s"), F.lit(False).alias("done")))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                a, c = list(r.ci), list(r.cj)
                w = weights(unit([x["vector"] for x in a]), unit([x["vector"] for x in c]), np.array([x["domain"] for x in a], dtype=object), np.array([x["domain"] for x in c], dtype=object), r.i == r.j)
                out = {group: getattr(r, group), "id": [x["id"] for x in c]}
                if hasattr(r, "p"):
                    given = dict(zip((y["id"] for y in r.p), (y["s"] for y in r.p), strict=True))
                    out["part"] = w.T @ np.array([given[x["id"]] for x in a])
                else:
                    out["part"] = w.sum(axis=0)
                yield pd.DataFrame(out)

    schema = f"{group} string, id long, part double"
    total = cut(pairs.mapInPandas(partial, schema).groupBy(group, "id").agg(F.sum("part").alias("total")))  # weights are symmetric
    for _ in range(rounds):
        live = state.where("not done")
        if not live.limit(1).count():
            break
        spread = live.join(total, [group, "id"]).select(group, "n", "id", "s", F.when(F.col("total") > 0, F.col("s") / F.col("total")).otherwise(0.0).alias("p"), F.when(F.col("total") > 0, 0.0).otherwise(F.col("s")).alias("stuck"))
        stuck = F.broadcast(spread.groupBy(group).agg(F.sum("stuck").alias("stuck")))
        key = F.pmod(F.xxhash64("id"), F.ceil(2 * F.col("n") / block).cast("long")).cast("int")
        given = spread.select(group, key.alias("i"), F.struct("id", F.col("p").alias("s")).alias("y")).groupBy(group, "i").agg(F.collect_list("y").alias("p"))
        moved = pairs.join(given, [group, "i"]).mapInPandas(partial, schema).groupBy(group, "id").agg(F.sum("part").alias("part"))
        new = (1 - damping) / F.col("n") + damping * (F.col("part") + F.col("stuck") / F.col("n"))
        new = live.select(group, "n", "id", F.col("s").alias("before")).join(moved, [group, "id"]).join(stuck, group).select(group, "n", "id", "before", new.alias("s"))
        new = cut(new)
        done = F.broadcast(new.groupBy(group).agg((F.sum(F.abs(F.col("s") - F.col("before"))) < still).alias("done")))
        state = cut(state.where("done").unionByName(new.join(done, group).select(group, "n", "id", "s", "done")))
    return state.select(group, "id", F.col("s").alias("lex"))


def blended(lex: Column, cov: Column, ent: Column, s: Settings = DEFAULT) -> Column:
    """The three factors by their weights; the graph score alone where all weights are 0."""
    total = s.lex_weight + s.coverage_weight + s.entity_weight
    if total <= 0:
        return lex
    return (s.lex_weight * lex + s.coverage_weight * cov + s.entity_weight * ent) / total
