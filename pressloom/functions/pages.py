"""Pages, dump pointers, chunks and feeds as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.time import stamp

#: Names under which pages state when they were published.
STAMP_NAMES = "article:published_time|og:article:published_time|datePublished|parsely-pub-date|pubdate|publish-date|publication_date|sailthru\\.date"
_META = rf"(?i)<meta[^>]+(?:property|itemprop|name)\s*=\s*[\"'](?:{STAMP_NAMES})[\"'][^>]*?content\s*=\s*[\"']([^\"']{{10,40}})[\"']"
_META_BACK = rf"(?i)<meta[^>]+content\s*=\s*[\"']([^\"']{{10,40}})[\"'][^>]*?(?:property|itemprop|name)\s*=\s*[\"'](?:{STAMP_NAMES})[\"']"
_JSON_LD = r"\"date(?:Published|Created)\"\s*:\s*\"([^\"]{10,40})\""


def page_stamp(html: Column, seen: Column, hint: Column, most_days: int = 3653) -> Column:
    """Publication time of a page: the first date in range of its meta tags, its JSON-LD, then the day hint; null if none is."""
    head = F.substring(F.coalesce(html, F.lit("")), 1, 200_000)
    found = F.concat(*(F.regexp_extract_all(head, F.lit(p), F.lit(1)) for p in (_META, _META_BACK, _JSON_LD)), F.array(hint))
    dates = F.transform(found, lambda x: stamp(x))
    low = seen - F.expr(f"interval {most_days} days")
    return F.get(F.filter(dates, lambda t: t.isNotNull() & (t <= seen) & (t >= low)), F.lit(0))


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation and tags; block ends are line ends; null counts as empty."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|h[1-6]|li|tr)\s*>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for k, v in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def latest_tick(pointer: Column) -> Column:
    """Tick of the dump's pointer file, as yyyyMMddHHmmss; '' if there is none."""
    return F.regexp_extract(pointer, r"/(\d{14})\.gkg\.csv", 1)


def extracted(html: Column, least: int = 300) -> Column:
    """The paragraphs of a page; where they make less than `least` characters, the text of the whole page."""
    page = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>|<!--.*?-->", " ")
    strict = page_text(F.array_join(F.regexp_extract_all(page, F.lit(r"(?is)(<(?:p|h[1-6]|li)\b[^>]*>.*?</(?:p|h[1-6]|li)\s*>)"), F.lit(1)), "\n"))
    return F.when(F.length(strict) >= least, strict).otherwise(page_text(html))


def fetched(rows: DataFrame, fetch: Callable[[dict], tuple[str, str] | None]) -> DataFrame:
    """article_id, text, title of the rows that `fetch` finds; a row at a time, as pages come, and an error counts as no find."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for r in p.to_dict("records"):
                try:
                    got = fetch(r)
                except Exception:  # noqa: BLE001 -- whatever a page does
                    got = None
                if got is not None:
                    out.append((r["article_id"], *got))
            yield pd.DataFrame(out, columns=["article_id", "text", "title"])

    return rows.mapInPandas(run, "article_id long, text string, title string")


def cut_points(text: str, most: int) -> list[int]:
    """Where the chunks of `quoted_chunks` begin: one numpy pass for the sizes, one step a chunk."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain = np.isin(points, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-~/", dtype=np.uint8))
    octets = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    before = np.concatenate([[0], np.cumsum(np.where(plain, 1, 3 * octets))])
    cuts = [0]
    while cuts[-1] < len(points):
        fit = int(np.searchsorted(before, before[cuts[-1]] + most, "right")) - 1
        cuts.append(max(fit, cuts[-1] + 1))
    return cuts


def quoted_chunks(text: Column, most: int = 1500) -> Column:
    """The text, line ends as spaces, cut by character into chunks of at most `most` url-quoted bytes; [''] where it is empty or null."""

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            t = (t or "").replace("\n", " ")
            cuts = cut_points(t, most)
            out.append([t[a:b] for a, b in zip(cuts, cuts[1:])] or [t])
        return pd.Series(out)

    return chunks(text)


def escaped(c: Column) -> Column:
    """Text fit for an XML element."""
    out = F.coalesce(c, F.lit(""))
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def protected(text: Column, names: Column) -> Column:
    """The text with each name of the array replaced by its marker XXnXX."""
    numbered = F.transform(names, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    return F.aggregate(numbered, text, lambda t, x: F.replace(t, x["n"], F.concat(F.lit("XX"), x["i"].cast("string"), F.lit("XX"))))


def restored(text: Column, names: Column) -> Column:
    """Markers replaced by their names; markers that a translator spread out are found too. The highest number first."""
    numbered = F.reverse(F.transform(names, lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
    return F.aggregate(numbered, text, lambda t, x: F.call_function("regexp_replace", t, F.concat(F.lit("(?i)XX ?"), x["i"].cast("string"), F.lit(" ?XX")), x["n"]))


def markers_lost(text: Column, names: Column, most: float = 0.34) -> Column:
    """Is more than the bearable share of the markers gone?"""
    gone = F.size(F.filter(F.transform(names, lambda n, i: i), lambda i: ~F.call_function("rlike", text, F.concat(F.lit("(?i)XX ?"), i.cast("string"), F.lit(" ?XX")))))
    return (F.size(names) > 0) & (gone / F.greatest(F.size(names), F.lit(1)) > most)
