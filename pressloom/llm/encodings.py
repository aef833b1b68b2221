"""Problem 10: garbled text from wrong character encoding.

A noisy-channel decoder. A channel is a pair (written in, read as) of encodings. Over each text lies one
lattice: an edge keeps a span as it stands, reads its character sequences back as the bytes they
were and the characters those bytes spell, reads a whole token through a channel of single bytes, or reads U+FFFD
and lost controls as wildcards for any letter. A span costs by the frequencies of its words in the whole
corpus, a misread sequence or a lost byte that is kept by `garbled`, changing the channel by `switch`; staying in it
costs nothing, so short words are restored with the long ones around them. One Viterbi search over each
line takes the cheapest path. A text is damaged if that path differs from the text, and is restored by the same path.
A span with no edge but the keeping one lies on every path, so only the others are searched.

Word frequencies are counted over all documents, before the shuffle in each task; the model
is the `vocabulary` most frequent words, less those of the last count that would not fit whole (some 10 MB at the default), so its size is bounded
whatever the corpus, and the count a word needs grows with the corpus. The channel table is built by rule from the target characters.

A sequence that a text quotes alone (an opening quote directly before it, a closing one directly
after or as its last character) is an example, no damage.

Edge cases: null and empty texts are no case; ties go to the unchanged reading, then to the
channel that comes first; repeated rows give one row in `damaged`; an empty table gives no row; a
wildcard without a matching word stays as it is and the row is marked as not restored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.storage import cut

#: Encodings that UTF-8 bytes are read as.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1254", "iso8859_2", "cp1253", "cp1257")
#: Encodings with one byte a character, written and read.
CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")
LATIN = ("cp1252", "cp1254", "mac_roman", "cp850", "cp437", "cp1250")
#: Readings in which the bytes of a letter may look like two ordinary letters or a letter and a mark.
WEAK = {"cp1251", "cp866", "koi8_r", "cp1253"}
#: Characters that UTF-8 text of this kind holds besides ASCII.
TARGETS = [*map(chr, [*range(0xA0, 0x180), *range(0x401, 0x460), *range(0x2010, 0x2040), 0x20AC, 0x2116, 0x2122, 0x2026, 0x2082])]
OPEN, CLOSE = "“\"'«„‘’‹", "”\"'»“’›"
QUOTES = "“”„«»‹›‘’"
LOST = re.compile("[�\x80-\x9f]+")
WORD = re.compile(r"[^\W\d_]+")
CLEAN = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*$")
TOKEN = re.compile(r"\S+")
MARKED = re.compile(r"[!-~]*[^\x00-\x7f\s]\S*")
CUT = ".,;:!?()[]\""
STRIP = ".,;:!?()[]\"'…-–—*•"


@dataclass(frozen=True)
class Settings:
    """vocabulary: words in the model; least: times a word must be counted at least; switch: cost of
    changing the channel; garbled: cost of a misread sequence or lost byte that is kept; wildcard: cost of one read as an unknown letter;
    known: how much likelier a reading must be than the token as it stands;
    shortest: letters a single token needs to be a case by itself."""

    vocabulary: int = 200_000
    least: int = 3
    switch: float = 6.0
    garbled: float = 40.0
    wildcard: float = 12.0
    known: float = 3.0
    shortest: int = 4


def spelled(data: bytes, codec: str) -> str:
    """Bytes read as `codec`; a byte that it lacks becomes the control of that number."""
    out = []
    for x in data:
        try:
            out.append(bytes([x]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(x))
    return "".join(out)


def unspelled(text: str, codec: str) -> str | None:
    """UTF-8 that was read as `codec`; None if the text is none."""
    try:
        return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(codec) for c in text).decode()
    except UnicodeError:
        return None


@lru_cache(1)
def channel_table() -> dict[str, tuple[str, str]]:
    """Misread sequence -> (character, reading), also for text misread twice."""
    known: dict[str, tuple[str, str]] = {}
    for codec in READ_AS:
        for ch in TARGETS:
            once = spelled(ch.encode(), codec)
            known.setdefault(once, (ch, codec))
            if codec in ("cp1252", "latin-1"):
                for again in ("cp1252", "latin-1"):
                    known.setdefault(spelled(once.encode(), again), (ch, codec))
    return {k: v for k, v in known.items() if len(k) > 1}


@lru_cache(1)
def single_channels() -> tuple[tuple[str, str], ...]:
    """(written in, read as) for encodings of one byte a character."""
    pairs = [(w, r) for w in CYRILLIC for r in ("cp1252", "latin-1", *CYRILLIC, "mac_roman", "cp437", "cp850") if w != r]
    pairs += [(w, r) for w in LATIN for r in ("cp1252", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "koi8_r", "latin-1") if w != r]
    return tuple(pairs)


@lru_cache(1)
def reading_table() -> tuple[tuple[str, dict[int, str]], ...]:
    """For each channel with single bytes, what a shown character stands for."""
    out = []
    for written, read in single_channels():
        shown: dict[int, str] = {}
        for x in range(128, 256):
            a, b = spelled(bytes([x]), read), spelled(bytes([x]), written)
            if a != b:
                shown.setdefault(ord(a), b)
        out.append((f"{written}>{read}", shown))
    return tuple(out)


def word_counts(documents: DataFrame, settings: Settings = Settings()) -> dict[str, int]:
    """The most frequent words over all documents with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(WORD.findall(t.lower()))
            if len(seen) > 1_000_000:
                yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=schema)
                seen = Counter()
        yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=schema)

    counted = documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least)
    counted = cut(counted)
    # the count from which no more than `vocabulary` words are left: one row for each distinct count reaches the driver
    at, words = settings.least, 0
    for r in sorted(counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.n):
        words += r.words
        if words > settings.vocabulary:
            at = r.n + 1
            break
    return {r.word: r.n for r in counted.where(F.col("n") >= at).collect()}


@dataclass(frozen=True)
class Edge:
    """text: what the span reads as, None where it is kept; channel: '' for none; whole: is nothing left unread."""

    start: int
    end: int
    text: str | None
    channel: str
    cost: float
    whole: bool


class Decoder:
    """Finds and restores damaged spans of single texts."""

    def __init__(self, counts: dict[str, int], settings: Settings = Settings()) -> None:
        self.settings, self.counts = settings, counts
        self.total = sum(counts.values()) + 1.0
        # pairs of letters weigh by the root of a word's count: shares stay the same on a larger table, and copies add little
        pairs: Counter[str] = Counter()
        for x, n in counts.items():
            w = f" {x} "
            for i in range(len(w) - 1):
                pairs[w[i : i + 2]] += math.sqrt(n)
        whole = sum(pairs.values()) + 1.0
        self.pairs = {k: math.log(whole / n) for k, n in pairs.items()}
        self.unseen = max(self.pairs.values(), default=0.0) + 1.0
        self._ready = False

    def __getstate__(self) -> dict:
        return {"settings": self.settings, "counts": self.counts, "total": self.total, "pairs": self.pairs, "unseen": self.unseen, "_ready": False}

    def ready(self) -> None:
        """Builds what is not sent to the tasks."""
        if self._ready:
            return
        self.table = channel_table()
        self.edges = ahocorasick.Automaton()
        for k in self.table:
            self.edges.add_word(k, k)
        self.edges.make_automaton()
        self.channels = reading_table()
        self.tokens: dict[str, tuple[tuple[str, str, float, bool], ...]] = {}
        self.open: dict[str, int] = {}
        self.pending = False
        self._ready = True

    @cached_property
    def sorted(self) -> list[str]:
        return sorted(self.counts)

    @cached_property
    def backwards(self) -> list[str]:
        return sorted(w[::-1] for w in self.counts)

    def cost(self, word: str) -> float:
        """-log of the word's share; words that the model lacks cost by their letters."""
        n = self.counts.get(word, 0)
        return math.log(self.total / n) if n else math.log(self.total) + 1.2 * len(word)

    def words_cost(self, s: str) -> float:
        return sum(self.cost(w) for w in WORD.findall(s.lower()))

    def quoted(self, text: str, start: int, end: int) -> bool:
        return text[start - 1 : start] in OPEN and start > 0 and (text[end - 1] in CLOSE or text[end : end + 1] in CLOSE and end < len(text))

    def lattice(self, text: str) -> list[tuple[int, int, str]]:
        """Edges (start, end, character) that read several characters as one, longest first at each place."""
        found: list[tuple[int, int, str, str]] = []
        for end, key in self.edges.iter_long(text):
            start = end + 1 - len(key)
            if not self.quoted(text, start, end + 1):
                ch, codec = self.table[key]
                found.append((start, end + 1, ch, codec))
        out = []
        for i, (a, b, ch, codec) in enumerate(found):
            weak = codec in WEAK or codec == "cp850" and text[a:b].isalpha() or text[a] in "ÄÅÖÜÉ" and text[a - 1 : a].isupper()
            if weak:
                # two letters side by side must both be misread, unless the token reads better with the character
                near = i and found[i - 1][1] >= a - 1 and found[i - 1][3] == codec or i + 1 < len(found) and found[i + 1][0] <= b + 1 and found[i + 1][3] == codec
                if not near and not self.better(text, a, b, ch):
                    continue
            out.append((a, b, ch))
        return out

    def better(self, text: str, a: int, b: int, ch: str) -> bool:
        """Does the token around text[a:b] become words of the corpus, likelier by their letters, with `ch` in that place?"""
        l, r = a, b
        while l > 0 and not text[l - 1].isspace():
            l -= 1
        while r < len(text) and not text[r].isspace():
            r += 1
        core = (text[l:a] + ch + text[b:r]).strip(STRIP + QUOTES)
        if r - l <= 4 or core not in (core.lower(), core.capitalize(), core.upper()):
            return False
        return self.known(core) and self.letters_cost(text[l:r]) - self.letters_cost(core) > self.settings.known

    def known(self, token: str) -> bool:
        words = WORD.findall(token.lower())
        return bool(words) and all(w in self.counts for w in words)

    def letters_cost(self, s: str) -> float:
        """-log of the words' shares by their pairs of letters, which no single word can raise by its copies."""
        return sum(self.pairs.get(w[i : i + 2], self.unseen) for x in WORD.findall(s.lower()) for w in (f" {x} ",) for i in range(len(w) - 1))

    def open_channels(self, pair: str) -> int:
        """Bits of the channels that may make words of the corpus of two letters side by side."""
        mask = 0
        for k, (_, shown) in enumerate(self.channels):
            back = pair.translate(shown)
            # what isn't two plain letters is left to the search
            if back != pair and (len(low := back.lower()) != 2 or not WORD.fullmatch(low) or low in self.pairs):
                mask |= 1 << k
            elif back == pair and back.lower() in self.pairs:
                mask |= 1 << k
        return mask

    def readings(self, token: str) -> tuple[tuple[str, str, float, bool], ...]:
        """(channel, token read back, gain, whether the words' shares alone settle it) of the channels by which it becomes words of the corpus.

        The gain is that of the words' shares and, for longer ones, of their pairs of letters: both are relative, so a
        garbled word that was counted often, as on a large table, is still judged against the word it stands for.
        """
        if token in self.tokens:
            return self.tokens[token]
        if len(self.tokens) > 500_000:
            self.tokens.clear()
        core = token.strip(CUT)
        own, letters, out = self.words_cost(core), None, []
        mask = (1 << len(self.channels)) - 1
        for x, y in zip(core, core[1:]):
            if mask and (x > "\x7f" or y > "\x7f"):
                if (m := self.open.get(x + y)) is None:
                    m = self.open[x + y] = self.open_channels(x + y)
                mask &= m
        while mask:
            k = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            name, shown = self.channels[k]
            back = core.translate(shown)
            if back == core or not back.isprintable():
                continue
            words = WORD.findall(back.lower())
            if sum(map(str.isalpha, back)) < sum(map(str.isalpha, core)):
                continue
            if not words or not CLEAN.match(back.strip(STRIP + QUOTES)) or not all(w in self.counts for w in words):
                continue
            if back != back.lower() and back != back.capitalize() and back != back.upper() and len(words) == 1:
                continue
            gain = own - self.words_cost(back)
            settled = gain > self.settings.known
            # a right word may have a garbled one as its reading, but is then far more frequent
            if gain > -self.settings.known and max(map(len, words)) >= self.settings.shortest:
                letters = self.letters_cost(core) if letters is None else letters
                gain += max(0.0, letters - self.letters_cost(back))
            if gain > self.settings.known:
                out.append((name, back, gain, settled))
        out.sort(key=lambda x: -x[2])
        self.tokens[token] = tuple(out[:4])
        return self.tokens[token]

    def trusted(self, readings: list[tuple]) -> set[str]:
        """Channels that the words' shares settle for a token, or that the letters of two different words speak for."""
        out, backs = set(), {}
        for r in readings:
            for name, back, _, settled in r:
                backs.setdefault(name, set()).add(back.strip(STRIP + QUOTES).lower())
                if settled or len(backs[name]) > 1:
                    out.add(name)
        return out

    def damaged(self, text: str) -> bool:
        """Does the cheapest reading differ from the text?"""
        return any(e.text is not None for e in self.path(text, quick=True)) or self.pending and any(e.text is not None for e in self.path(text))

    def singles(self, text: str) -> list[tuple[int, int, tuple]]:
        """(start, end, readings) of tokens misread byte by byte, of the trusted channels."""
        found, seen = [], self.tokens
        for m in MARKED.finditer(text):
            token = m.group()
            r = seen.get(token)
            if r is None:
                r = self.readings(token)
            if r and not self.quoted(text, *m.span()):
                found.append((*m.span(), r))
        trusted = self.trusted([r for *_, r in found])
        found = [f for f in found if any(x[0] in trusted for x in f[2])]
        letters = lambda s: max(map(len, WORD.findall(s)), default=0)
        long = [f for f in found if letters(f[2][0][1]) >= self.settings.shortest]
        return found if long or len(found) > 1 else []

    def fill(self, pattern: str) -> str | None:
        """The likeliest word of the corpus for a token with wildcards."""
        holes = re.split("[�]+", pattern)
        first, last = holes[0].lower(), holes[-1].lower()
        shape = re.compile("".join(f"[^\\W\\d_a-z’'-]{{1,{len(x)}}}" if x[0] == "�" else re.escape(x) for x in re.findall("�+|[^�]+", pattern.lower())) + "$")
        best, n = None, 0
        if len(first) >= len(last):
            i = bisect_left(self.sorted, first)
            while i < len(self.sorted) and self.sorted[i].startswith(first):
                w = self.sorted[i]
                if self.counts[w] > n and shape.match(w):
                    best, n = w, self.counts[w]
                i += 1
        else:
            key = last[::-1]
            i = bisect_left(self.backwards, key)
            while i < len(self.backwards) and self.backwards[i].startswith(key):
                w = self.backwards[i][::-1]
                if self.counts[w] > n and shape.match(w):
                    best, n = w, self.counts[w]
                i += 1
        if best is None:
            return None
        return best.upper() if pattern.isupper() else best[:1].upper() + best[1:] if pattern[:1].isupper() or pattern[:1] == "�" and len(pattern) > 1 and pattern[1:2].isupper() else best

    def restore(self, text: str) -> tuple[str, bool]:
        """The text by its cheapest reading, and whether nothing damaged is left."""
        out, at, whole = [], 0, True
        for e in self.path(text):
            if e.text is not None:
                out += [text[at : e.start], e.text]
                at = e.end
            whole &= e.whole
        back = "".join([*out, text[at:]])
        return back, whole and "�" not in back

    def lines(self, text: str, quick: bool = False) -> Iterator[list[tuple[int, int, list[tuple[int, int, str]], tuple, bool]]]:
        """For each line its parts with another edge than the keeping one: (start, end, sequences, readings, lost).

        `quick` leaves single-byte readings out where there are edges of the other kinds, and notes in `pending` that it did.
        """
        self.ready()
        self.pending = False
        if text.isascii():
            return
        lost = [m.span() for m in LOST.finditer(text) if not self.quoted(text, *m.span())]
        many = self.lattice(text)
        self.pending = quick and bool(lost or many)
        one = [] if self.pending else self.singles(text)
        at = 0
        for a in sorted({x[0] for x in [*lost, *many, *one]}):
            if a < at:
                continue
            start, at = text.rfind("\n", 0, a) + 1, text.find("\n", a)
            at = len(text) if at < 0 else at
            own = [[x for x in k if start <= x[0] < at] for k in (lost, many, one)]
            yield self.spans(text, start, at, *own)

    def spans(self, text: str, start: int, end: int, lost: list, many: list, one: list) -> list[tuple]:
        # a lost byte takes the letters around it along, a sequence its whole token
        places = [[a, b, [], r, False] for a, b, r in self.channels_of(text, start, end, one, many)]
        for a, b, ch in many:
            places.append([*self.token(text, a, b), [(a, b, ch)], (), False])
        for a, b in lost:
            places.append([*self.token(text, a, b), [], (), True])
        places.sort(key=lambda x: (x[0], x[1]))
        out: list[list] = []
        for a, b, seq, r, gone in places:
            if out and a < out[-1][1]:
                last = out[-1]
                # a token's own reading holds for the token alone
                same = (a, b) == (last[0], last[1])
                last[3] = (last[3] or r) if same else last[3] if last[1] >= b else ()
                last[1], last[4] = max(last[1], b), last[4] or gone
                last[2] += seq
            else:
                out.append([a, b, list(seq), r, gone])
        return [(a, b, sorted(set(seq)), r, gone) for a, b, seq, r, gone in out]

    @staticmethod
    def token(text: str, a: int, b: int) -> tuple[int, int]:
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        return a, b

    def channels_of(self, text: str, start: int, end: int, one: list, many: list) -> list[tuple[int, int, tuple]]:
        """(start, end, ((channel, text read back), ...)) of every token with letters beyond ASCII on a line with a misread one.

        The channels are those trusted for single bytes on the line, and UTF-8 read as the encoding of one of its sequences.
        """
        if not (one or many):
            return []
        tables = dict(self.channels)
        tokens = [(start + m.start(), start + m.end(), m.group()) for m in TOKEN.finditer(text[start:end]) if not m.group().isascii()]
        names = sorted(self.trusted([self.readings(t) for *_, t in tokens])) if one else []
        codecs = sorted({self.table[text[x:y]][1] for x, y, _ in many})
        out = []
        for x, y, t in tokens:
            back = [(n, t.translate(tables[n])) for n in names] + [(f"utf-8>{c}", k) for c in codecs if (k := unspelled(t, c)) is not None]
            if read := tuple((n, k) for n, k in back if k != t and k.isprintable()):
                out.append((x, y, read))
        return out

    def span_cost(self, shown: str) -> float:
        return self.words_cost(shown) + 2.0 * sum(not c.isalnum() and ord(c) > 0x9F and c not in "«»“”„’…–—•№" for c in shown)

    def edges_over(self, text: str, span: tuple) -> list[Edge]:
        """The edges over one span, the keeping one first."""
        s = self.settings
        a, b, sequences, readings, gone = span
        shown = text[a:b]
        keep = self.span_cost(shown) + s.garbled * (len(sequences) + gone)
        if sequences or gone:
            back, sure = self.reread(shown, [(x - a, y - a, ch) for x, y, ch in sequences])
            own = [Edge(a, b, None, "", keep, False), Edge(a, b, back, "bytes", min(self.words_cost(back) + s.wildcard * (not sure), keep - 1.0), sure)]
            return own + [Edge(a, b, x, name, self.span_cost(x) + s.garbled * bool(LOST.search(x)), True) for name, x in readings]
        if r := [x for x in self.readings(shown) if any(x[0] == n for n, _ in readings)]:
            # a reading by far likelier outweighs the way into its channel and back; one that was counted too often for
            # the words to settle it is told by its letters
            keep = max(keep, self.words_cost(r[0][1]) + r[0][2]) + 2 * s.switch
        return [Edge(a, b, None, "", keep, True), *(Edge(a, b, back, name, self.span_cost(back), True) for name, back in readings)]

    def path(self, text: str, quick: bool = False) -> Iterator[Edge]:
        """The cheapest edges over the parts of each line, one line after the other."""
        for spans in self.lines(text, quick):
            best: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
            for span in spans:
                step: dict[str, tuple[float, tuple]] = {}
                for e in self.edges_over(text, span):
                    # sequences of bytes are told one by one; a channel of single bytes is entered and kept
                    cost, chain = min(((c + (self.settings.switch if m != e.channel and e.channel != "bytes" and m != "bytes" else 0.0), k) for m, (c, k) in best.items()), key=lambda x: x[0])
                    new = (cost + e.cost, (e, chain))
                    if e.channel not in step or new[0] < step[e.channel][0]:
                        step[e.channel] = new
                best = step
            _, chain = min(best.values(), key=lambda x: x[0])
            part = []
            while chain:
                part.append(chain[0])
                chain = chain[1]
            yield from reversed(part)

    def reread(self, shown: str, sequences: list[tuple[int, int, str]]) -> tuple[str, bool]:
        """A span with its sequences read back, twice where it was misread twice, and its wildcards filled; is nothing left unread?"""
        text = shown
        for _ in range(2):
            out, at = [], 0
            for a, b, ch in sequences:
                if a >= at:
                    out += [text[at:a], ch]
                    at = b
            text = "".join([*out, text[at:]])
            sequences = self.lattice(text)
            if not sequences:
                break
        # lone controls of cp1252 read as latin-1
        text = re.sub("[\x80-\x9f]", lambda m: spelled(m.group().encode("latin-1"), "cp1252"), text)
        whole = True

        def mend(m: re.Match) -> str:
            nonlocal whole
            word = self.mended(m.group())
            whole &= word is not None
            return m.group() if word is None else word

        text = re.sub("[^\\W\\d_]*(?:�+[^\\W\\d_]+)+�*|[^\\W\\d_]+�+", mend, text)
        # a wildcard that stands alone takes the place of a dash
        text = re.sub("^�{1,3}$", "—", text)
        return text, whole and "�" not in text

    def mended(self, token: str) -> str | None:
        """A token with wildcards read as a word, or as words with a quotation mark or an apostrophe lost."""
        bare = token.strip("�")
        if "�" not in bare and bare.lower() in self.counts:
            quoted = "“" * token.startswith("�") + bare + "”" * token.endswith("�")
            other = self.fill(token)
            if other is None or self.counts[bare.lower()] >= self.counts.get(other.lower(), 0):
                return quoted
        if (word := self.fill(token)) is not None:
            return word
        for m in re.finditer("�+", token):
            for size in range(len(m.group()), 0, -1):
                left, right = token[: m.start()], token[m.start() + size :]
                if left and right and "�" not in left and left.lower() in self.counts:
                    rest = right if "�" not in right and right.lower() in self.counts else self.fill(right) if "�" in right else None
                    if rest is not None:
                        return f"{left}’{rest}"
        return None


def damaged(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id of each document with a garbled sequence; each once."""
    model = documents.sparkSession.sparkContext.broadcast(Decoder(word_counts(documents, settings), settings))  # bounded by `vocabulary`

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = model.value
        for b in batches:
            found = [i for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and decoder.damaged(t)]
            yield pa.RecordBatch.from_pydict({"doc_id": found}, schema=pa.schema([("doc_id", pa.int64())]))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, "doc_id long").distinct()


def restored(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text, whole: the damaged documents read back; `whole` if nothing damaged is left."""
    model = documents.sparkSession.sparkContext.broadcast(Decoder(word_counts(documents, settings), settings))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, decoder = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())]), model.value
        for b in batches:
            rows = [(i, *decoder.restore(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and decoder.damaged(t)]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema=schema)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(mend, "doc_id long, text string, whole boolean")
