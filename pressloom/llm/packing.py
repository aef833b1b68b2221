"""Problem 8: filling fixed-capacity containers.

Best-fit decreasing over the whole table. Sizes are whole tokens no larger than the
capacity, so the items are known by a histogram of at most `capacity` rows. The driver runs
best-fit decreasing over it: sizes from large to small, the tightest open bin found by a
segment tree over remaining capacities in logarithmic time. Equal items and equally full bins are
placed together: once the tightest remaining room r >= s is chosen, the next items of size
s go to the same bin until its room falls below s, so r // s items fill each of those
bins. The result is the placement that best-fit decreasing makes item by item, as ranges
(size, rank) -> bins.

The items find their bins by their rank among items of equal size. Ranks come from a window
over (container, size, bucket) and running totals of the buckets, whose number grows with the pieces, so a size that a
third of all rows share is split into parts of bounded size.

Edge cases: null and empty texts have no tokens and need no room, they get no row; a text larger
than the capacity is cut into full pieces, each alone in a bin, and a rest that is packed like any text;
repeated doc_ids are packed each; an empty table gives no row; a capacity below 1 is refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.storage import cut

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Containers larger than this would make the histogram large.
MOST_CAPACITY = 1_000_000


@lru_cache(1)
def encoding(path: str):  # noqa: ANN201
    """The byte-level vocabulary at `path`; read once in each process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, column: str = "text") -> DataFrame:
    """doc_id, tokens of each whole text; rows without tokens left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(tokenizer)
        for b in batches:
            n = [len(own.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long"), column).mapInArrow(count, "doc_id long, tokens long").where("tokens > 0")


class SegmentTree:
    """Which remaining capacities have an open bin; the least one not below a size in log time."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity).bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, room: int, there: bool) -> None:
        i = room + self.leaves
        self.any[i] = there
        while i > 1:
            i >>= 1
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def tightest(self, size: int) -> int:
        """Least room >= size with an open bin; -1 if there is none."""
        i = size + self.leaves
        if self.any[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


@dataclass(frozen=True)
class Plan:
    """Items of `size` with rank in [rank, rank + count) go to bins from `bin` on, `each` to a bin."""

    size: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    each: np.ndarray
    bins: int


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over size -> number of items."""
    tree, rows, bins = SegmentTree(capacity), [], 0
    open_bins: dict[int, list[tuple[int, int]]] = {}

    def leave(room: int, first: int, n: int) -> None:
        if n and room > 0:
            if not open_bins.setdefault(room, []):
                tree.put(room, True)
            open_bins[room].append((first, n))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, each = capacity, capacity // size
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = room // size
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
                if n > (need := -(-left // each)):
                    leave(room, first + need, n - need)
                    n = need
            rows.append((size, rank, first, each))
            taken = min(left, n * each)
            full, rest = divmod(taken, each)
            leave(room - each * size, first, full)
            if rest:
                leave(room - rest * size, first + full, 1)
            rank, left = rank + taken, left - taken
    m = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return Plan(m[:, 0], m[:, 1], m[:, 2], m[:, 3], bins)


def pack(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER, each_bucket: int = 500_000) -> DataFrame:
    """container, bin, doc_id, piece, tokens: every piece of every text in a bin of every container."""
    kinds = [(r.container, r.capacity) for r in containers.select("container", F.col("capacity").cast("long")).distinct().collect()]  # as many as container kinds
    if any(c is None or not 0 < c <= MOST_CAPACITY for _, c in kinds):
        raise ValueError(f"capacities must lie between 1 and {MOST_CAPACITY}")
    spark = documents.sparkSession
    counts = cut(token_counts(documents, tokenizer))
    # a size may belong to nearly all pieces, so the buckets grow with their number
    pieces = counts.agg(F.sum(F.ceil(F.col("tokens") / min((c for _, c in kinds), default=1))).alias("n")).first().n or 0
    buckets = max(64, pieces // each_bucket)
    kind = F.broadcast(spark.createDataFrame(kinds, "container string, capacity long"))
    whole = counts.crossJoin(kind).withColumn("full", F.expr("tokens div capacity")).withColumn("rest", F.col("tokens") % F.col("capacity"))
    parts = F.concat(
        F.transform(F.sequence(F.lit(1), F.greatest("full", F.lit(1))), lambda i: F.struct(i.alias("piece"), F.when(i <= F.col("full"), F.col("capacity")).otherwise(0).alias("tokens"))),
        F.array(F.struct((F.col("full") + 1).alias("piece"), F.col("rest").alias("tokens"))),
    )
    items = whole.select("container", "doc_id", F.explode(parts).alias("p")).select("container", "doc_id", F.col("p.piece").cast("int").alias("piece"), F.col("p.tokens").alias("tokens")).where("tokens > 0")
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))

    per_bucket = items.groupBy("container", "tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("container", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = cut(per_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histograms: dict[str, dict[int, int]] = {}
    for r in per_bucket.groupBy("container", "tokens").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        histograms.setdefault(r.container, {})[r.tokens] = r.n
    capacity = dict(kinds)
    plans = {c: best_fit(h, capacity[c]) for c, h in histograms.items()}

    within = Window.partitionBy("container", "tokens", "bucket").orderBy("doc_id", "piece")
    ranked = items.withColumn("r", F.row_number().over(within) - 1).join(per_bucket, ["container", "tokens", "bucket"])
    ranked = ranked.select("container", "doc_id", "piece", "tokens", (F.col("r") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, size, rank = np.array(b.column(0).to_pylist(), dtype=object), np.asarray(b.column(3)), np.asarray(b.column(4))
            bin_ = np.zeros(len(size), dtype=np.int64)
            for c, plan in plans.items():
                own = np.flatnonzero(of == c)
                if len(own):
                    key = plan.size << 40 | plan.rank
                    at = np.searchsorted(key, size[own] << 40 | rank[own], side="right") - 1
                    bin_[own] = plan.bin[at] + (rank[own] - plan.rank[at]) // plan.each[at]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bin_), b.column(1), b.column(2), b.column(3)], names=["container", "bin", "doc_id", "piece", "tokens"])

    return ranked.mapInArrow(place, "container string, bin long, doc_id long, piece int, tokens long")


def use(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container, capacity, bins, pieces, tokens, filled: how well the room is used."""
    bins = packed.groupBy("container").agg(F.max("bin").alias("last"), F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    out = bins.join(F.broadcast(containers.select("container", "capacity")), "container").withColumn("bins", F.col("last") + 1)
    return out.select("container", "capacity", "bins", "pieces", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"))
