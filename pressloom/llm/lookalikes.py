"""Problem 4: visually identical text with different characters.

Classes of look-alikes are the components of a union-find over strings and code points:
wide, narrow and joined forms with their plain strings, decomposed sequences with composed
letters, unusual spaces with the space, invisible characters with the empty string, letters
of one alphabet with the letters of another that look the same. The relation is transitive: a wide Latin
letter, its Cyrillic double and its Greek one are a single class. Which member stands for a
class is decided by frequency: characters are counted over all values, apart for each alphabet, and
the most frequent member that belongs to the word's alphabet is written. Members are
rewritten greedily, longest first, by a multi-pattern automaton.

The class table is small: code points seen in the data that have such a form, and the fixed pairs
below. Only character counts reach the driver, at most one row for each code point.

Edge cases: a null or empty value is no case; an alphabet is decided for each word (a run of letters,
marks and invisible characters) and falls back to the value's; a tie keeps the word as it is;
repeated rows give one row in `affected`; an empty table gives no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that look alike. Latin, Cyrillic, Greek; "-" where an alphabet has none.
ALIKE = """
a а -   c с -   e е -   i і -   j ј -   o о ο   p р ρ   s ѕ -   x х -   y у -   v ѵ ν   h һ -   d ԁ -   q ԛ -   w ԝ -
A А Α   B В Β   C С -   E Е Ε   H Н Η   I І Ι   J Ј -   K К Κ   M М Μ   N - Ν   O О Ο   P Р Ρ   S Ѕ -   T Т Τ
X Х Χ   Y У Υ   Z - Ζ   ï ї -   ë ё -   Ë Ё -   a - α
"""
#: Latin letters whose Cyrillic double is so rare that they still tell the alphabet of a word.
TELLING = {"v", "h", "d", "q", "w"}
#: Decomposition kinds that are only another look of the same string.
KINDS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
ALPHABETS = ("LATIN", "CYRILLIC", "GREEK")


def alphabet(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK or ''."""
    n = ord(ch)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "LATIN" if ch.isalpha() and ch not in "ªº" else ""
    if 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000:
        return "GREEK"
    return "CYRILLIC" if 0x400 <= n < 0x530 else ""


def invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F


def plain_form(ch: str) -> str | None:
    """The ordinary string that a code point is another look of; None if it is ordinary itself."""
    if invisible(ch):
        return ""
    if ch != " " and unicodedata.category(ch) == "Zs":
        return " "
    d = unicodedata.decomposition(ch)
    if d.startswith(KINDS) or d.startswith("<compat>") and 0xFB00 <= ord(ch) <= 0xFB06:
        return unicodedata.normalize("NFKC", ch)
    if unicodedata.normalize("NFC", ch) != ch:
        return unicodedata.normalize("NFC", ch)
    return None


class Union:
    """Union-find over strings, with path halving."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def fixed_pairs() -> list[tuple[str, str, str]]:
    cells = ALIKE.split()
    return [(cells[i], cells[i + 1], cells[i + 2]) for i in range(0, len(cells), 3)]


class Classes:
    """Look-alike classes over the code points seen, with their representatives."""

    def __init__(self, counts: dict[str, int]) -> None:
        u = Union()
        for row in fixed_pairs():
            members = [m for m in row if m != "-"]
            for m in members[1:]:
                u.join(members[0], m)
        for ch in counts:
            plain = plain_form(ch)
            if plain is not None:
                u.join(ch, plain)
            elif len(d := unicodedata.normalize("NFD", ch)) > 1:
                u.join(d, ch)
        groups: dict[str, list[str]] = {}
        for x in list(u.parent):
            groups.setdefault(u.find(x), []).append(x)
        #: member -> alphabet -> representative; alphabet "" holds for any place
        self.form: dict[str, dict[str, str]] = {}
        for members in groups.values():
            ordinary = [m for m in members if len(m) != 1 or plain_form(m) is None]
            ordinary = [m for m in ordinary if unicodedata.normalize("NFC", m) == m]
            if not ordinary:
                continue
            best: dict[str, str] = {}
            for m in sorted(ordinary, key=lambda m: (counts.get(m, 0), m)):
                best[alphabet(m) if len(m) == 1 else ""] = m
            if len(ordinary) == 1 or not set(ALPHABETS) & set(best):
                best[""] = max(ordinary, key=lambda m: (counts.get(m, 0), m))
            for m in members:
                self.form[m] = best
        # a pair of one alphabet and another of the same look; own letters never change
        self.alike = {m for row in fixed_pairs() for m in row if m != "-"}
        self.finder = ahocorasick.Automaton()
        for m in self.form:
            if m and (len(m) > 1 or plain_form(m) is not None):
                self.finder.add_word(m, m)
        self.patterns = bool(len(self.finder))
        if self.patterns:
            self.finder.make_automaton()

    def unfold(self, s: str) -> str:
        """Every member that is no ordinary letter is rewritten, leftmost longest first."""
        if not self.patterns:
            return unicodedata.normalize("NFC", s)
        out, at = [], 0
        for end, m in self.finder.iter_long(s):
            start = end + 1 - len(m)
            best = self.form[m]
            plain = unicodedata.normalize("NFC", m) if len(m) > 1 else plain_form(m)
            # the string itself names the alphabet: a wide Latin a is a Latin a
            own = next((alphabet(c) for c in plain if alphabet(c)), "")
            out += [s[at:start], best.get(own, plain) if len(plain) == 1 else plain]
            at = end + 1
        return unicodedata.normalize("NFC", "".join([*out, s[at:]]))

    def clean(self, value: str) -> str:
        """The value in its one form."""
        s = self.unfold(value)
        if not any(0x370 <= ord(c) < 0x530 for c in s):
            return s
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", s)]
        of_words = [self.home(s[a:b]) for a, b in words]
        clear = Counter(h for h in of_words if h and not h.startswith("?"))
        whole = clear.most_common(1)[0][0] if clear else ""
        out, at = [], 0
        for (a, b), home in zip(words, of_words, strict=True):
            w = s[a:b]
            if home.startswith("?"):  # every letter has doubles: the value decides
                own = home[1:]
                sign = own == "GREEK" and len(w) == 1 or own == "LATIN" and len(w) > 1 and w == w.upper()
                mixed = len({alphabet(c) for c in w} - {""}) > 1
                home = whole if whole and (mixed or own != whole and clear[whole] >= 2 and not clear[own] and not sign) else own
            out += [s[at:a], "".join(self.form.get(c, {}).get(home, c) if home and alphabet(c) not in ("", home) else c for c in w)]
            at = b
        return "".join([*out, s[at:]])

    def home(self, word: str) -> str:
        """The alphabet of a word; "?" before it where all letters have doubles in another."""
        seen = Counter(alphabet(c) for c in word if alphabet(c))
        if not seen:
            return ""
        own = Counter(alphabet(c) for c in word if alphabet(c) and not self.double(c))
        if len(seen) == 1:
            return ("" if own else "?") + next(iter(seen))
        if len(own) > 1:
            # letters that only one alphabet has, of several: a compound of whole words
            return ""
        if own:
            return next(iter(own))
        return "?" + max(seen, key=lambda a: (seen[a], a == "LATIN", a))

    def double(self, c: str) -> bool:
        return c in self.alike and c not in TELLING


def values(articles: DataFrame, entities: DataFrame) -> DataFrame:
    """field_name, row_id, value of the fields that are brought to one form."""
    titles = articles.select(F.lit("articles.title").alias("field_name"), F.col("article_id").cast("long").alias("row_id"), F.col("title").alias("value"))
    names = entities.select(F.lit("entity_ru.name").alias("field_name"), F.col("entity_id").cast("long").alias("row_id"), F.col("name").alias("value"))
    return titles.unionByName(names)


def character_counts(rows: DataFrame) -> dict[str, int]:
    """How often each code point occurs in `value`; at most one row a code point reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for v in b.column(0).to_pylist():
                seen.update(v or "")
        yield pa.RecordBatch.from_pydict({"c": list(seen), "n": list(seen.values())}, schema=pa.schema([("c", pa.string()), ("n", pa.int64())]))

    return {r.c: r.n for r in rows.select("value").mapInArrow(count, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}


def one_form(rows: DataFrame) -> DataFrame:
    """field_name, row_id, value, clean: every value with its one form."""
    counts = character_counts(rows)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(counts)
        for b in batches:
            clean = [v if v is None or v.isascii() else classes.clean(v) for v in b.column(2).to_pylist()]
            yield b.append_column("clean", pa.array(clean, pa.string()))

    return rows.select("field_name", F.col("row_id").cast("long"), "value").mapInArrow(rewrite, "field_name string, row_id long, value string, clean string")


def affected(rows: DataFrame) -> DataFrame:
    """field_name, row_id of the values that change; each once."""
    return one_form(rows).where(F.col("value") != F.col("clean")).select("field_name", "row_id").distinct()


def equal_values(rows: DataFrame) -> DataFrame:
    """field_name, clean, members, forms: one forms that several stored strings share, with their numbers."""
    grouped = one_form(rows).where("clean is not null").groupBy("field_name", "clean", "value").agg(F.count(F.lit(1)).alias("n"))
    return grouped.groupBy("field_name", "clean").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("forms")).where("forms > 1")


def letters(values: Iterable[str]) -> Counter[str]:
    """Character counts of plain Python strings, for tests and small use."""
    seen: Counter[str] = Counter()
    for v in values:
        seen.update(v)
    return seen
