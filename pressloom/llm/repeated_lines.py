"""Problem 3: lines repeated across one site's documents.

PrefixSpan over the sequences of line identifiers of each site (the identifier hashes site and
line, so sites never mix). Level one counts the distinct articles of every single line.
Infrequent lines are pruned; each frequent line then has a projected database: what follows it in
the articles, equal continuations as one row with their number. A projected database of up to `most` rows
is mined level by level in one task; a larger one (a line of a site that holds a third of all rows) is projected
again by its next line as a DataFrame step, until every part fits, so no group is collected whole.
A sequence is frequent when `support` distinct articles hold it, and the occurrences of
all lines of frequent sequences, single ones included, are deleted.

`adjacent` sequences are runs: each line directly follows the one before, infrequent lines
left out. They number at most `longest` a line of the table; deletion is mined by them. Sequences in
any gaps are complete as well, but their number may grow exponentially with the frequent lines of a page.

Edge cases: null or empty text gives no line; a null or unreadable url counts as the site
''; blank lines are never counted nor removed; rows with one article_id are read as one
page and count as one article; an empty table gives no row; other columns pass through `without_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.storage import cut


def site(url: Column) -> Column:
    """Host of a url, lower case, without user, port and one leading www., m. or amp.; '' if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.regexp_replace(host, r"^(?:www|m|amp)\.", ""), F.lit(""))


def line_key(line: Column) -> Column:
    """Trimmed, white space squeezed, lower case, each run of digits read as one digit."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"(?U)\s+", " "), r"(?U)\d+", "0"))


def lines(articles: DataFrame) -> DataFrame:
    """article_id, line_no (from 1), line: a 64-bit identifier of site and line; blank lines left out."""
    split = articles.where(F.col("text").isNotNull()).select(
        F.col("article_id").cast("long").alias("article_id"), site(F.col("url")).alias("s"), F.posexplode(F.split("text", "\n")).alias("pos", "raw")
    )
    keyed = split.select("article_id", (F.col("pos") + 1).cast("int").alias("line_no"), "s", line_key(F.col("raw")).alias("k")).where("k <> ''")
    return keyed.select("article_id", "line_no", F.xxhash64("s", "k").alias("line"))


def frequent_lines(held: DataFrame, support: int = 4) -> DataFrame:
    """line, documents: single lines of `lines` in at least `support` distinct articles."""
    each = held.select("article_id", "line").distinct()
    return each.groupBy("line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= support)


def mined(items: np.ndarray, weight: np.ndarray, support: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sequences as rows of equal length, documents) of all frequent sequences, in any gaps.

    `items`: a sequence a row, filled up with -1; `weight`: documents that hold it. Levels of more than `most`
    rows are worked off in parts, so their size is bounded by `most` and the largest single prefix.
    """
    n, width = items.shape
    kinds, local = np.unique(items, return_inverse=True)
    local = local.reshape(n, width).astype(np.int64)
    # where the same line stood last in its row: a line is taken at its first place after the prefix
    last = np.full((n, width), -1, dtype=np.int64)
    for j in range(1, width):
        for i in range(j):
            np.copyto(last[:, j], i, where=local[:, i] == local[:, j])
    todo = [(np.arange(n), np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros((1, 0), dtype=np.int64))]
    while todo:
        row, at, prefix, paths = todo.pop()
        found = []
        for j in range(width):
            ok = np.flatnonzero((at < j) & (items[row, j] != -1) & (last[row, j] <= at))
            found.append((row[ok], np.full(len(ok), j), prefix[ok] * len(kinds) + local[row[ok], j]))
        row, at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, which = np.unique(key, return_inverse=True)
        documents = np.bincount(which, weights=weight[row], minlength=len(keys)).astype(np.int64)
        kept = documents >= support
        if not kept.any():
            continue
        paths = np.concatenate([paths[keys[kept] // len(kinds)], kinds[keys[kept] % len(kinds)][:, None]], axis=1)
        yield paths, documents[kept]
        stay = np.flatnonzero(kept[which])
        prefix = (np.cumsum(kept) - 1)[which[stay]]
        row, at = row[stay], at[stay]
        if len(row) > most:
            order = np.argsort(prefix, kind="stable")
            row, at, prefix = row[order], at[order], prefix[order]
        start = 0
        while start < len(row):
            end = len(row) if len(row) - start <= most else int(np.searchsorted(prefix, prefix[start + most], "left"))
            if end <= start:
                end = int(np.searchsorted(prefix, prefix[start], "right"))
            if start == 0 and end == len(row):
                todo.append((row, at, prefix, paths))
            else:
                lo, hi = prefix[start], prefix[end - 1] + 1
                todo.append((row[start:end], at[start:end], prefix[start:end] - lo, paths[lo:hi]))
            start = end


def runs(items: np.ndarray, skip: np.ndarray, weight: np.ndarray, support: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs as rows of equal length, documents) of all frequent runs that begin in the first column.

    `items`: a continuation a row, filled up with -1; `skip`: a row counts for runs of more lines than this, as the article
    holds the shorter ones before; `depth`: lines of the prefix.
    """
    row, group = np.arange(len(items)), np.zeros(len(items), dtype=np.int64)
    for j in range(items.shape[1]):
        ok = items[row, j] != -1
        row, group = row[ok], group[ok]
        if not len(row):
            return
        kinds, local = np.unique(items[row, j], return_inverse=True)
        keys, which = np.unique(group * len(kinds) + local, return_inverse=True)
        documents = np.bincount(which, weights=np.where(skip[row] < depth + j + 1, weight[row], 0), minlength=len(keys)).astype(np.int64)
        kept = documents >= support
        if not kept.any():
            return
        sample = np.zeros(len(keys), dtype=np.int64)
        sample[which] = row
        yield items[sample[kept], : j + 1], documents[kept]
        stay = kept[which]
        row, group = row[stay], (np.cumsum(kept) - 1)[which[stay]]


def seen_before(x: list[int]) -> list[int]:
    """For each place the length of the longest run from there that also begins at an earlier place."""
    if len(set(x)) == len(x):
        return [0] * len(x)
    # suffixes in order by doubling; the earlier neighbours in that order share the longest beginning
    n = len(x)
    rank = np.unique(np.array(x), return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.concatenate([rank[k:], np.full(min(k, n), -1)])[:n] + 1
        new = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64)
        rank = new
        if rank.max() == n - 1 or k >= n:
            break
        k *= 2
    order = np.argsort(rank, kind="stable").tolist()

    def common(i: int, j: int) -> int:
        m = 0
        while i + m < n and j + m < n and x[i + m] == x[j + m]:
            m += 1
        return m

    out = [0] * n
    for way in (order, order[::-1]):
        stack: list[int] = []
        for i in way:
            while stack and stack[-1] > i:
                stack.pop()
            if stack:
                out[i] = max(out[i], common(i, stack[-1]))
            stack.append(i)
    return out


def projected(held: DataFrame, adjacent: bool, longest: int) -> DataFrame:
    """prefix (one line), rest, skip, n: the projected databases of all frequent lines."""
    page = held.groupBy("article_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "line"))).alias("held")).select(F.transform("held", lambda x: x["line"]).alias("held"))
    if not adjacent:
        page = page.groupBy("held").agg(F.count(F.lit(1)).alias("n"))
        rest = page.select(F.explode(F.array_distinct("held")).alias("first"), "held", "n")
        rest = rest.select(F.array("first").alias("prefix"), F.expr("slice(held, int(array_position(held, first)) + 1, size(held))").alias("rest"), F.lit(0).alias("skip"), "n")
    else:

        def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("prefix", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64())), ("skip", pa.int32())])
            for b in batches:
                rows: list[tuple] = []
                for x in b.column(0).to_pylist():
                    for i, skip in enumerate(seen_before(x)):
                        rows.append((x[i : i + 1], x[i + 1 : i + longest], min(skip, longest)))
                        if len(rows) >= 20_000:
                            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema=schema)

        rest = page.mapInArrow(suffixes, "prefix array<long>, rest array<long>, skip int").withColumn("n", F.lit(1))
    return rest.where(F.size("rest") > 0).groupBy("prefix", "rest", "skip").agg(F.sum("n").alias("n"))


def frequent_sequences(articles: DataFrame, support: int = 4, adjacent: bool = False, longest: int = 64, most: int = 100_000, held: DataFrame | None = None) -> DataFrame:
    """lines (array of identifiers), documents: all frequent sequences; `adjacent`: those without gaps, of up to `longest` lines.

    `most`: rows of a projected database that one task mines; `held`: the pruned occurrences, where the caller has them.
    """
    if held is None:
        held = pruned(articles, support)
    single = frequent_lines(held, support)
    level, found, depth = cut(projected(held, adjacent, longest)), [single.select(F.array("line").alias("lines"), "documents")], 1
    done = []
    while True:
        size = level.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"))
        large = size.where(F.col("rows") > most).select("prefix")
        if not large.limit(1).count():
            break
        done.append(level.join(large, "prefix", "left_anti"))
        wide = level.join(large, "prefix")
        if adjacent:
            step = wide.select(F.concat("prefix", F.slice("rest", 1, 1)).alias("prefix"), F.expr("slice(rest, 2, size(rest))").alias("rest"), "skip", "n")
        else:
            step = wide.select("prefix", "rest", "skip", "n", F.explode(F.array_distinct("rest")).alias("next"))
            step = step.select(F.concat("prefix", F.array("next")).alias("prefix"), F.expr("slice(rest, int(array_position(rest, next)) + 1, size(rest))").alias("rest"), "skip", "n")
        step = cut(step.groupBy("prefix", "rest", "skip").agg(F.sum("n").alias("n")))
        depth += 1
        kept = step.groupBy("prefix").agg(F.sum(F.when(F.col("skip") < depth, F.col("n")).otherwise(0)).alias("documents")).where(F.col("documents") >= support)
        found.append(kept.select(F.col("prefix").alias("lines"), "documents"))
        level = cut(step.join(kept.select("prefix"), "prefix").where(F.size("rest") > 0))
    for part in done:
        level = level.unionByName(part)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lines", pa.list_(pa.int64())), ("documents", pa.int64())])

        def sequences_of(first: list[int], group: list[tuple[list[int], int, int]]) -> Iterator[pa.RecordBatch]:
            if sum(n for *_, n in group) < support:
                return
            kinds = {line: k for k, line in enumerate(sorted({x for r, *_ in group for x in r}))}
            back = np.array(list(kinds), dtype=np.int64)
            items = np.full((len(group), max(len(r) for r, *_ in group)), -1, dtype=np.int64)
            for k, (r, *_) in enumerate(group):
                items[k, : len(r)] = [kinds[x] for x in r]
            skip, weight = np.array([s for _, s, _ in group]), np.array([n for *_, n in group], dtype=np.int64)
            for paths, documents in runs(items, skip, weight, support, len(first)) if adjacent else mined(items, weight, support):
                whole = np.concatenate([np.tile(first, (len(paths), 1)), back[paths]], axis=1)
                for k in range(0, len(whole), 50_000):
                    part = whole[k : k + 50_000]
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(part.ravel())), pa.array(documents[k : k + 50_000])], schema=schema)

        now, group = None, []
        for b in batches:
            for first, r, s, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first != now and group:
                    yield from sequences_of(now, group)
                    group = []
                now = first
                group.append((r, s, n))
        if group:
            yield from sequences_of(now, group)

    longer = level.select("prefix", "rest", "skip", "n").repartition("prefix").sortWithinPartitions("prefix").mapInArrow(mine, "lines array<long>, documents long")
    for part in found:
        longer = longer.unionByName(part)
    return longer


def kept_with(held: DataFrame, named: DataFrame, parts: int = 8) -> DataFrame:
    """The occurrences whose line is in `named`; a line's occurrences are spread over `parts` keys, so no line is one task's."""
    spread = named.select("line", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return held.withColumn("part", F.pmod(F.xxhash64("article_id"), F.lit(parts)).cast("int")).join(spread, ["line", "part"]).select("article_id", "line_no", "line")


def pruned(articles: DataFrame, support: int = 4) -> DataFrame:
    """article_id, line_no, line: the occurrences of frequent single lines, written once."""
    each = cut(lines(articles))
    return cut(kept_with(each, frequent_lines(each, support)))


def repeated(articles: DataFrame, support: int = 4) -> DataFrame:
    """article_id, line_no of every occurrence of a line of a frequent sequence; each once."""
    held = pruned(articles, support)
    named = frequent_sequences(articles, support, adjacent=True, held=held).select(F.explode("lines").alias("line")).distinct()
    return kept_with(held, named).select("article_id", "line_no").distinct()


def without_lines(articles: DataFrame, support: int = 4) -> DataFrame:
    """The articles with `text` less the repeated lines and `removed`, their number."""
    gone = repeated(articles, support).groupBy("article_id").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    joined = articles.join(gone.withColumnRenamed("article_id", "_id"), F.col("article_id") == F.col("_id"), "left").drop("_id")
    kept = F.expr("array_join(filter(split(text, '\n'), (x, i) -> gone is null or not array_contains(gone, i + 1)), '\n')")
    return joined.withColumn("text", kept).withColumn("removed", F.coalesce(F.size("gone"), F.lit(0))).drop("gone")
