"""Similarity join of vectors by a segment index of sign strings.

A vector is written as a fixed string of sign bits of random projections, cut into segments that
are stored under position and content as one key. Vectors that share a segment and whose strings lie within
a bounded number of substitutions, told by their first `checked` bits, are verified by the cosine. Equal vectors are one class,
indexed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.storage import cut


@dataclass(frozen=True)
class Settings:
    """dims: length of the longest vectors; segments and width: shape of the signature; spread: how many
    standard deviations above the expected distance at `cosine` a signature may lie."""

    dims: int = 64
    cosine: float = 0.95
    segments: int = 28
    width: int = 14
    spread: float = 6.0
    most_checked: int = 128
    seed: int = 20240101

    @property
    def bits(self) -> int:
        return self.segments * self.width

    @property
    def checked(self) -> int:
        """Bits of a signature that travel with its segments: enough to tell unrelated vectors apart."""
        return min(self.bits, self.most_checked)

    @property
    def distance(self) -> int:
        """Largest edit distance of the checked bits that is verified by the cosine."""
        flip = math.acos(self.cosine) / math.pi
        return math.ceil(self.checked * flip + self.spread * math.sqrt(self.checked * flip * (1 - flip)))


def fitted(rows: DataFrame, cosine: float, column: str = "embedding", miss: float = 0.001) -> Settings:
    """Settings for a table: the vectors' length is read from it, the segments are as wide as the logarithm of the rows.

    So unrelated rows that share a segment stay at some four a row whatever the table's size; a pair exactly at
    `cosine` shares none with probability `miss` at most. One row reaches the driver.
    """
    r = rows.agg(F.count(column).alias("n"), F.max(F.size(column)).alias("dims")).first()
    width = max(10, math.ceil(math.log2(max(2, r.n))) - 2)
    whole = (1 - math.acos(cosine) / math.pi) ** width
    return Settings(dims=max(1, r.dims or 1), cosine=cosine, width=width, segments=math.ceil(math.log(miss) / math.log(1 - whole)))


def planes(settings: Settings) -> np.ndarray:
    """Random directions, orthonormal in blocks of `dims`."""
    rng = np.random.default_rng(settings.seed)
    blocks = [np.linalg.qr(rng.standard_normal((settings.dims, settings.dims)))[0] for _ in range(-(-settings.bits // settings.dims))]
    return np.concatenate(blocks, axis=1)[:, : settings.bits].astype(np.float32)


def vectors(rows: DataFrame, settings: Settings = Settings(), column: str = "embedding", key: str = "article_id") -> DataFrame:
    """id, v, h: the rows whose vector can match, `v` at unit length as binary float32, `h` its 128-bit digest. Vectors of different lengths never match."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), strict=True):
                if x is None or not 0 < len(x) <= settings.dims:
                    continue
                x = np.asarray(x, dtype=np.float64)
                norm = np.linalg.norm(x)
                if np.isfinite(norm) and norm > 0:
                    ids.append(i)
                    out.append((x / norm).astype(np.float32).tobytes())
            digests = [xxhash.xxh3_128_digest(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(digests, pa.binary())], names=["id", "v", "h"])

    return rows.where(F.col(column).isNotNull()).select(F.col(key).cast("long"), F.col(column).cast("array<float>")).mapInArrow(convert, "id long, v binary, h binary")


def padded(col: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a binary column as rows, filled up with zeros."""
    whole = dims * 4
    return np.frombuffer(b"".join(x.ljust(whole, b"\0") for x in col.to_pylist()), dtype=np.float32).reshape(len(col), dims)


def classes(vecs: DataFrame) -> DataFrame:
    """rep, v, h: one row for each distinct vector, `rep` the smallest id that has it."""
    return vecs.groupBy("h").agg(F.min("id").alias("rep"), F.first("v").alias("v"))


def members(vecs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, id: which class each vector belongs to; digests travel, not vectors."""
    return vecs.select("h", "id").join(reps.select("h", "rep"), "h").select("rep", "id")


def segment_index(reps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """key, rep, s0, ...: `segments` rows for each class; the key is position and content, the longs are the checked bits of the signature."""
    longs = -(-settings.checked // 64)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes(settings)
        powers = 1 << np.arange(settings.width, dtype=np.int64)
        place = np.arange(settings.segments, dtype=np.int64) << settings.width
        for b in batches:
            n = b.num_rows
            m = padded(b.column(1), settings.dims)
            bits = m @ p > 0
            keys = bits.reshape(n, settings.segments, settings.width).astype(np.int64) @ powers + place
            packed = np.packbits(np.pad(bits[:, : settings.checked], ((0, 0), (0, longs * 64 - settings.checked))), axis=1)
            sig = packed.reshape(n, longs, 8).view(np.int64)[:, :, 0]
            out = [pa.array(np.asarray(b.column(0)), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), settings.segments).cast(pa.list_(pa.int64()))]
            out += [pa.array(np.ascontiguousarray(sig[:, j])) for j in range(longs)]
            yield pa.RecordBatch.from_arrays(out, names=["rep", "keys", *(f"s{j}" for j in range(longs))])

    schema = "rep long, keys array<long>, " + ", ".join(f"s{j} long" for j in range(longs))
    wide = reps.select("rep", "v").mapInArrow(index, schema)
    return wide.select(F.explode("keys").alias("key"), "rep", *(f"s{j}" for j in range(longs)))


def edit_distance(settings: Settings, a: str, b: str) -> Column:
    """Substitutions between the checked bits of two signatures."""
    longs = -(-settings.checked // 64)
    return sum((F.bit_count(F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))) for j in range(1, longs)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))


def probe(new: DataFrame, stored: DataFrame, settings: Settings = Settings(), within: bool = False, groups: tuple[str, ...] = (), small: bool = False) -> DataFrame:
    """a, b: classes that share a segment and lie within the edit distance; each pair once.

    `groups`: columns of both that must be equal. `within`: `new` and `stored` are one index, whose pairs are taken in one direction.
    `small`: the caller has counted `new` and found it fit to be broadcast, so that `stored` is read without a shuffle.
    """
    a, b = (F.broadcast(new) if small else new).alias("a"), stored.alias("b")
    met = F.lit(True)
    for g in groups:
        met &= F.col(f"a.{g}") == F.col(f"b.{g}")
    met &= (F.col("a.key") == F.col("b.key")) & (edit_distance(settings, "a", "b") <= settings.distance)
    met &= F.col("a.rep") < F.col("b.rep") if within else F.col("a.rep") != F.col("b.rep")
    return a.join(b, met).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def cosine_at_least(pairs: DataFrame, left: DataFrame, right: DataFrame, settings: Settings = Settings(), few: int = 500_000) -> DataFrame:
    """a, b, cos: the pairs whose vectors reach the cosine; `left` and `right` hold rep, v.

    The pairs are written once and counted; up to `few` of them (16 bytes each) go to the vectors, more are joined by shuffle.
    """
    pairs = cut(pairs)
    if pairs.count() <= few:
        side = lambda x, k: x.join(F.broadcast(pairs.select(F.col(k).alias("rep")).distinct()), "rep", "left_semi")
        left, right = side(left, "a"), side(right, "b")
    joined = pairs.join(left.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a").join(right.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            va, vb = (padded(x.column(k), settings.dims).astype(np.float64) for k in (2, 3))
            cos = np.einsum("ij,ij->i", va, vb)
            cos[[len(p) != len(q) for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]] = -1.0
            yield x.select(["a", "b"]).append_column("cos", pa.array(cos)).filter(pa.array(cos >= settings.cosine - 1e-7))

    return joined.select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long, cos double")
