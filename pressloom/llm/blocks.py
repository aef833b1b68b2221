"""Problem 6: page text mixed with the article's own lines.

A recurrent block labeller. The lines of a text are the leaves of the page. Each line is read as
a layout path (the text keeps no tags: its indent, list mark, separators, line ends, letter
case, digits, place on the page and blank neighbours stand for them) and as a bag of hashed words with
learned vectors, the first and last word apart. A bidirectional LSTM, written in numpy, runs over all
non-blank lines of the document, so every line is classified knowing the whole page.

It is trained when a query starts, on at most `sample` articles of the table, those with the smallest
hash of their id. Their lines are labelled by the exemplars in `furniture` and by recurrence: a line that comes back under
different titles belongs to the page. The network then labels all lines of all articles, also those that neither explains.

Edge cases: null and empty texts and articles with residue get no row; blank lines are never labelled; a
text of one line is labelled like any; repeated rows give one row for each line; an empty table gives
no row, and nothing is trained.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm import residue
from pressloom.llm.furniture import LIST_ITEM, SENTENCE_END, is_furniture, squeezed

WORD = re.compile(r"[^\W\d_]+|\d+|[|©/>·•:]")
CLOCK = re.compile(r"\d{1,2}:\d\d|\d{1,4}[./-]\d{1,2}[./-]\d{1,4}")
MARK = re.compile(r"\s*(?:(\d+\.)|(\d+\))|([*•]|[–-]))\s")
PATHS = 29


@dataclass(frozen=True)
class Settings:
    """sample: articles to train on; recurring: different titles of the sample under which a line comes back that is labelled as page text; buckets and size: table of word vectors; hidden: cells of each
    direction; rounds, batch, rate: training, in which each word is left out with probability `dropped`; pages, cells: documents, and lines times documents filled up to the longest, labelled at a time; least: probability
    from which a line is page text."""

    sample: int = 4_000
    recurring: int = 4
    buckets: int = 1 << 13
    size: int = 24
    hidden: int = 20
    rounds: int = 8
    batch: int = 64
    rate: float = 0.012
    dropped: float = 0.2
    pages: int = 512
    cells: int = 60_000
    least: float = 0.5
    seed: int = 7


def path_of(line: str, k: int, n: int, before: bool, after: bool) -> list[float]:
    """Layout of line k of n; before, after: is the neighbour blank."""
    s = line.strip()
    size, words = len(s), s.count(" ") + 1
    letters = sum(map(str.isalpha, s)) or 1
    upper = sum(map(str.isupper, s))
    ends = len(SENTENCE_END.findall(s))
    mark = MARK.match(line)
    return [
        float(bool(mark and mark[1])), float(bool(mark and mark[2])), float(bool(mark and mark[3])),
        min(size, 600) / 200, min(words, 60) / 20, min(ends, 4) / 2, float(ends == 0), float(ends >= 2), float(s[-1] in ".!?…”»\"“"), upper / letters,
        float(upper == letters), (size - letters) / size, float("|" in s), float(" / " in s), float(" > " in s), float("·" in s or "•" in s[1:]), float("©" in s),
        float(":" in s), float("," in s), float(bool(LIST_ITEM.match(line))), float(s[0].isdigit()), float(bool(CLOCK.search(s))), float(line[0].isspace() or line[-1].isspace()),
        float("  " in s), k / n, (n - k) / n, float(k < 4), float(n - k < 5), float(before) - float(after),
    ]


class Words:
    """Buckets of words, remembered by each task."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = buckets, {}

    def of(self, line: str) -> list[int]:
        """Buckets of all words of a line, its first and last one once more under their place."""
        known, out = self.known, []
        words = WORD.findall(line.lower())
        if not words:
            return [0]
        words = ["0" if w.isdigit() else w for w in words]
        # the places come first, so that training can drop words without them
        for w in ("^" + words[0], words[-1] + "$", *words):
            b = known.get(w)
            if b is None:
                if len(known) > 1_000_000:
                    known.clear()
                b = known[w] = zlib.crc32(w.encode()) % self.buckets
            out.append(b)
        return out


@dataclass
class Page:
    """The non-blank lines of one text."""

    numbers: list[int]
    paths: list[list[float]]
    words: list[list[int]]


def page(text: str, words: Words) -> Page | None:
    lines = text.split("\n")
    own = [k for k, x in enumerate(lines) if x.strip()]
    if not own:
        return None
    n = len(own)
    paths = [path_of(lines[k], j, n, k > 0 and not lines[k - 1].strip(), k + 1 < len(lines) and not lines[k + 1].strip()) for j, k in enumerate(own)]
    return Page([k + 1 for k in own], paths, [words.of(lines[k]) for k in own])


def thinned(p: Page, rng: np.random.Generator, share: float) -> Page:
    """The page with words left out by chance; the first and last word keep their places."""
    kept = []
    for w in p.words:
        drawn = rng.random(len(w)) >= share
        kept.append(w[:2] + [b for b, keep in zip(w[2:], drawn[2:], strict=True) if keep])
    return Page(p.numbers, p.paths, kept)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs over hashed words and layout paths, and one output for each line."""

    def __init__(self, settings: Settings = Settings()) -> None:
        self.settings = settings
        rng = np.random.default_rng(settings.seed)
        d, h = PATHS + settings.size, settings.hidden
        self.p: dict[str, np.ndarray] = {"E": rng.normal(0, 0.1, (settings.buckets, settings.size))}
        for way in "fb":
            self.p["X" + way] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * h))
            self.p["H" + way] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p["c" + way] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["O"] = rng.normal(0, 0.1, 2 * h + d)
        self.p["o"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Inputs [line, page, feature], which cells are lines, and where the words went."""
        size = [len(p.numbers) for p in pages]
        n, longest = len(pages), max(size)
        cell = np.concatenate([np.arange(s) * n + j for j, s in enumerate(size)])
        flat = [w for p in pages for w in p.words]
        count = np.array([len(w) for w in flat])
        bucket = np.fromiter((b for w in flat for b in w), dtype=np.int64, count=int(count.sum()))
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        scale = (1 / np.sqrt(count)).astype(np.float32)
        mean = np.add.reduceat(self.p["E"][bucket], begin, axis=0) * scale[:, None]
        x = np.zeros((longest * n, PATHS + self.settings.size), dtype=np.float32)
        x[cell, :PATHS] = np.concatenate([np.asarray(p.paths, dtype=np.float32) for p in pages])
        x[cell, PATHS:] = mean
        there = np.zeros(longest * n, dtype=np.float32)
        there[cell] = 1
        return x.reshape(longest, n, -1), there.reshape(longest, n), (cell, bucket, count, scale)

    def run(self, way: str, x: np.ndarray, there: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states of one direction, in the order of the lines."""
        steps, n, _ = x.shape
        h_size = self.settings.hidden
        fed = (x.reshape(-1, x.shape[2]) @ self.p["X" + way] + self.p["c" + way]).reshape(steps, n, -1)
        h, c = np.zeros((n, h_size), np.float32), np.zeros((n, h_size), np.float32)
        out, tape = np.zeros((steps, n, h_size), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = fed[t] + h @ self.p["H" + way]
            gates = sigmoid(z[:, : 3 * h_size])
            i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
            g = np.tanh(z[:, 3 * h_size :])
            m = there[t][:, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out, tape

    def probabilities(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of page text for each line of each page."""
        x, there, _ = self.inputs(pages)
        both = np.concatenate([self.run("f", x, there)[0], self.run("b", x, there)[0], x], axis=2)
        p = sigmoid(both @ self.p["O"] + self.p["o"])
        return [p[: len(q.numbers), j] for j, q in enumerate(pages)]

    def gradients(self, pages: list[Page], y: list[np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
        x, there, (cell, bucket, count, scale) = self.inputs(pages)
        steps, n, d = x.shape
        h_size, g = self.settings.hidden, {}
        hf, tape_f = self.run("f", x, there, True)
        hb, tape_b = self.run("b", x, there, True)
        both = np.concatenate([hf, hb, x], axis=2)
        p = sigmoid(both @ self.p["O"] + self.p["o"])
        want = np.zeros((steps, n), np.float32)
        for j, v in enumerate(y):
            want[: len(v), j] = v
        total = there.sum()
        loss = float(-(there * (want * np.log(p + 1e-7) + (1 - want) * np.log(1 - p + 1e-7))).sum() / total)
        dz = (p - want) * there / total
        g["O"] = np.tensordot(dz, both, axes=([0, 1], [0, 1]))
        g["o"] = np.array([dz.sum()])
        dboth = dz[:, :, None] * self.p["O"]
        dx = dboth[:, :, 2 * h_size :].copy()
        for way, tape, dout in (("f", tape_f, dboth[:, :, :h_size]), ("b", tape_b, dboth[:, :, h_size : 2 * h_size])):
            dfed = np.zeros((steps, n, 4 * h_size), np.float32)
            gh = np.zeros_like(self.p["H" + way])
            dh, dc = np.zeros((n, h_size), np.float32), np.zeros((n, h_size), np.float32)
            for t, h0, c0, i, f, o, u, tc, m in reversed(tape):
                dh = dh + dout[t]
                live = dh * m
                do = live * tc
                dnew = dc + live * o * (1 - tc * tc)
                cell_grad = dnew * m
                z = np.concatenate([cell_grad * u * i * (1 - i), cell_grad * c0 * f * (1 - f), do * o * (1 - o), cell_grad * i * (1 - u * u)], axis=1)
                dfed[t] = z
                gh += h0.T @ z
                dc = cell_grad * f + dnew * (1 - m)
                dh = z @ self.p["H" + way].T + dh * (1 - m)
            g["H" + way] = gh
            flat = dfed.reshape(-1, 4 * h_size)
            g["X" + way] = x.reshape(-1, d).T @ flat
            g["c" + way] = flat.sum(0)
            dx += (flat @ self.p["X" + way].T).reshape(steps, n, d)
        dword = dx.reshape(-1, d)[cell, PATHS:] * scale[:, None]
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], bucket, np.repeat(dword, count, axis=0))
        return g, loss

    def train(self, pages: list[Page], y: list[np.ndarray]) -> float:
        """Adam over the pages, those of like length together; the loss of the last round."""
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order = sorted(range(len(pages)), key=lambda k: len(pages[k].numbers))
        groups = [order[k : k + s.batch] for k in range(0, len(order), s.batch)]
        step, last = 0, 0.0
        for r in range(s.rounds):
            last = 0.0
            rate = s.rate * (1 - r / s.rounds) ** 0.7
            for b in rng.permutation(len(groups)):
                step += 1
                g, loss = self.gradients([thinned(pages[k], rng, s.dropped) for k in groups[b]], [y[k] for k in groups[b]])
                last += loss / len(groups)
                norm = np.sqrt(sum(float((x * x).sum()) for k, x in g.items() if k != "E"))
                clip = min(1.0, 5.0 / (norm + 1e-9))
                for k, x in g.items():
                    x = x * clip
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.01 * (x * x - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return last


def parts(sizes: list[int], most: int, cells: int) -> list[tuple[int, int]]:
    """Ranges of rising sizes, of up to `most` members that make up to `cells` when filled up to the longest; a larger member stands alone."""
    out, a = [], 0
    for b, size in enumerate(sizes):
        if b > a and (b - a >= most or (b - a + 1) * size > cells):
            out.append((a, b))
            a = b
    return [*out, (a, len(sizes))] if sizes else []


def recurring(articles: list[tuple[str | None, str]], least: int) -> set[str]:
    """Squeezed lines that stand in articles of `least` different titles: a page's furniture comes back, an article's own lines do not.

    Whole paragraphs and list items are never taken for furniture.
    """
    seen: dict[str, set[int]] = {}
    for title, text in articles:
        h = zlib.crc32((title or text[:200]).encode())
        for key in {squeezed(x) for x in text.split("\n") if x.strip() and not LIST_ITEM.match(x) and len(SENTENCE_END.findall(x)) < 2}:
            have = seen.setdefault(key, set())
            if len(have) < least:
                have.add(h)
    return {k for k, v in seen.items() if len(v) >= least}


def training_pages(articles: list[tuple[str | None, str]], settings: Settings) -> tuple[list[Page], list[np.ndarray]]:
    """Pages and labels of the sample (title, text): a line is of the page around if an exemplar explains it or it recurs."""
    words, pages, labels = Words(settings.buckets), [], []
    back = recurring(articles, settings.recurring)
    for _, t in articles:
        if (p := page(t, words)) is not None:
            lines = t.split("\n")
            pages.append(p)
            labels.append(np.array([is_furniture(lines[n - 1]) or squeezed(lines[n - 1]) in back for n in p.numbers], dtype=np.float32))
    return pages, labels


def trained(articles: DataFrame, index: residue.Index, settings: Settings = Settings()) -> Labeller | None:
    """A labeller trained on the sample; None if there is nothing to train on."""
    rows = articles.where(F.length(F.trim("text")) > 0).select("title", "text", F.xxhash64("article_id").alias("h"), F.col("article_id").alias("i"))
    # rows far above the sample's expected hash stay in their tasks
    share = min(1.0, 2.0 * settings.sample / max(1, index.rows))
    sample = rows.where(F.col("h") <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63)))).orderBy("h", "i").limit(settings.sample).select("title", "text").collect()
    pages, labels = training_pages([(r.title, r.text) for r in sample if not index.residue(r.title, r.text)], settings)
    if not pages:
        return None
    net = Labeller(settings)
    net.train(pages, labels)
    return net


def labelled(articles: DataFrame, settings: Settings = Settings(), p1: residue.Settings = residue.Settings()) -> DataFrame:
    """article_id, line_no, page: probability that the line is of the page around; articles without residue."""
    index = residue.index_of(articles, p1)
    net = trained(articles, index, settings)
    schema = pa.schema([("article_id", pa.int64()), ("line_no", pa.int32()), ("page", pa.float32())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, waiting = Words(settings.buckets), [], 0

        def out(some: list[tuple[int, Page]]) -> pa.RecordBatch:
            p = net.probabilities([q for _, q in some])
            ids = np.repeat([i for i, _ in some], [len(q.numbers) for _, q in some])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n for _, q in some for n in q.numbers], pa.int32()), pa.array(np.concatenate(p), pa.float32())], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: len(x[1].numbers))
            for a, b in parts([len(p.numbers) for _, p in held], settings.pages, settings.cells):
                yield out(held[a:b])
            held.clear()

        for b in batches:
            for i, title, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if net is not None and text and not index.residue(title, text) and (p := page(text, words)) is not None:
                    held.append((i, p))
                    waiting += len(p.numbers)
                if len(held) >= 8 * settings.pages or waiting > 8 * settings.cells:
                    yield from flush()
                    waiting = 0
        yield from flush()

    rows = articles.select(F.col("article_id").cast("long"), "title", "text")
    return rows.mapInArrow(label, "article_id long, line_no int, page float")


def page_lines(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """article_id, line_no of the lines that aren't the article's own; each once."""
    return labelled(articles, settings).where(F.col("page") >= settings.least).select("article_id", "line_no").distinct()


def bodies(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """article_id, text: the article's own lines in order."""
    kept = labelled(articles, settings).where(F.col("page") < settings.least).groupBy("article_id").agg(F.sort_array(F.collect_set("line_no")).alias("kept"))
    joined = articles.select(F.col("article_id").cast("long").alias("article_id"), "text").join(kept, "article_id")
    return joined.select("article_id", F.expr("array_join(transform(kept, n -> element_at(split(text, '\n'), n)), '\n')").alias("text"))
