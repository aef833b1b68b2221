"""Scalars over titles, texts, urls and names. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.settings import EDGE_WORDS, JUNK_NAMES, TIERS


def squeezed(c: Column) -> Column:
    """White space squeezed to one space and trimmed."""
    return F.trim(F.regexp_replace(c, r"[\p{Z}\s]+", " "))


def title_key(title: Column) -> Column:
    """Lower case, without punctuation, squeezed; null if nothing is left."""
    key = squeezed(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\p{Z}\s]", ""))
    return F.when(key != "", key)


def title_hash(title: Column) -> Column:
    """sha1 of the title key."""
    return F.sha1(title_key(title))


def host(url: Column) -> Column:
    """Host of an absolute url, lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def outlet(url: Column) -> Column:
    """Outlet domain: the host less one leading www, m, amp, mobile, edition, en or ru."""
    return F.regexp_replace(host(url), r"^(?:www|m|amp|mobile|edition|en|ru)\.", "")


def in_domains(domain: Column, domains: list[str]) -> Column:
    """Is the domain one of `domains` or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (domain == d) | domain.endswith("." + d)
    return out


def safe_url(url: Column) -> Column:
    """The url if it is http or https, else '#'; null counts as unsafe."""
    return F.when(F.lower(F.trim(url)).rlike(r"^https?://"), F.trim(url)).otherwise("#")


def script_language(text: Column) -> Column:
    """Language told by the script alone: ko, ja, zh-cn, else null."""
    return F.when(text.rlike(r"[가-힯]"), "ko").when(text.rlike(r"[぀-ヿ]"), "ja").when(text.rlike(r"[一-鿿]"), "zh-cn")


def source_code(text: Column, label: Column) -> Column:
    """Translator's source code: script first, Cyrillic share above 0.3 as ru, then the label's first part."""
    sample = F.coalesce(text, F.lit(""))
    cyrillic = F.length(F.regexp_replace(sample, r"[^А-Яа-яЁё]", "")) / F.greatest(F.length(sample), F.lit(1))
    first = F.lower(F.split(F.trim(label), "-").getItem(0))
    script = F.regexp_replace(script_language(sample), "^zh-cn$", "zh")
    return F.coalesce(script, F.when(cyrillic > 0.3, "ru"), F.when(first != "", F.when(first == "he", "iw").otherwise(first)), F.lit("auto"))


def entity_clean(name: Column) -> Column:
    """Lower case, squeezed, edge words cut; '' for names under four letters and page furniture."""
    edge = "(?:" + "|".join(EDGE_WORDS) + ")"
    n = F.lower(squeezed(name))
    n = F.regexp_replace(F.regexp_replace(n, rf"^(?:{edge}(?: |$))+", ""), rf"(?:(?:^| ){edge})+$", "")
    return F.when((F.length(n) < 4) | n.isin(*JUNK_NAMES), "").otherwise(n)


def entities(cell: Column) -> Column:
    """Names of a ';' cell, cleaned, distinct, in order; an empty array for null."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), entity_clean), lambda n: n != ""))


def entity_cell(*cells: Column) -> Column:
    """Person and organisation cells as one ';' cell."""
    return F.array_join(entities(F.concat_ws(";", *cells)), ";")


def verdict(token: Column) -> Column:
    """Token of a judge's reply: yes or a number above 5 is 100, no or less is 0, else null."""
    t = F.lower(F.trim(token))
    n = t.try_cast("double")
    return F.when(t.isin("true", "yes", "y", "да"), 100).when(t.isin("false", "no", "n", "нет"), 0).when(n > 5, 100).when(n <= 5, 0)


def without_thoughts(reply: Column) -> Column:
    """A reply without its <think> blocks; of an unclosed one, what stood before it."""
    return F.trim(F.when(reply.contains("</think>"), F.substring_index(reply, "</think>", -1)).otherwise(F.substring_index(reply, "<think>", 1)))


def judged_ids(reply: Column, asked: Column) -> Column:
    """(id, v) of a judge's JSON reply: the first object after fences and thoughts, whole ids from 1 to `asked`, tokens that mean something."""
    read = F.from_json(F.regexp_extract(without_thoughts(reply), r"(\{[^{}]*\})", 1), "map<string,string>")
    pairs = F.transform(F.map_entries(F.coalesce(read, F.expr("map()").cast("map<string,string>"))), lambda e: F.struct(e["key"].try_cast("int").alias("id"), verdict(e["value"]).alias("v")))
    return F.filter(pairs, lambda x: x["v"].isNotNull() & x["id"].between(1, asked))


def translation_sentences(text: Column, characters: int = 6000, most: int = 60) -> Column:
    """Sentences of the first `characters` of a squeezed text, of more than one character, `most` at most: what a translator is given."""
    t = F.substring(squeezed(F.coalesce(text, F.lit(""))), 1, characters)
    parts = F.transform(F.split(F.regexp_replace(t, r"([.!?。！？；;])\s*", "$1\x01"), "\x01"), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: F.length(x) > 1), 1, most)


#: Whole weeks in words, accusative and genitive.
WEEKS = (("неделю", "недели"), ("две недели", "двух недель"), ("три недели", "трёх недель"), ("четыре недели", "четырёх недель"))


def period_words(days: Column, form: int) -> Column:
    """A span of days in words: whole weeks up to four by name, else a number of days."""
    out = F.concat_ws(" ", days.cast("string"), plural_ru(days, "день", "дня", "дней"))
    for k, w in enumerate(WEEKS, 1):
        out = F.when(days == 7 * k, w[form]).otherwise(out)
    return out


def reply_parts(reply: Column) -> Column:
    """headline, body of a reply with tagged lines; what stands before the last body tag is dropped, a reply without tags is all body."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    tag = r"(?iuU)^\s*[*#\s]*(заголовок|пересказ)[*\s]*[:—-][*\s]*"
    lines = F.split(F.coalesce(reply, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    read = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, tag, 1)).alias("tag"), F.when(x.rlike(tag), strip(F.regexp_replace(x, tag, ""))).otherwise(x).alias("line")))

    def step(acc: Column, x: Column) -> Column:
        head = F.when(x.tag == "заголовок", x.line).otherwise(acc.headline)
        body = F.when(x.tag == "", F.concat(acc.body, F.array(x.line))).when(x.tag == "пересказ", F.array(x.line)).otherwise(acc.body)
        return F.struct(head.alias("headline"), body.alias("body"))

    start = F.struct(F.lit("").alias("headline"), F.array().cast("array<string>").alias("body"))
    return F.aggregate(read, start, step, lambda a: F.struct(a.headline.alias("headline"), strip(F.array_join(a.body, "\n")).alias("body")))


def display(ru: Column, en: Column, own: Column, most: int = 300) -> Column:
    """Russian, else English, else the original, cut to `most` characters."""
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.substring(F.coalesce(full(ru), full(en), full(own), F.lit("")), 1, most)


def title_flaws(t: Column) -> Column:
    """What is taken off a title for being hard to read."""
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    dashes = (F.length(t) - F.length(F.replace(t, F.lit(" - "), F.lit("")))) / 3
    part = lambda cond, cost: F.when(cond, cost).otherwise(0.0)
    return (
        part((letters > 0) & (upper / letters > 0.55), 0.30)
        + part(F.rtrim(t).rlike(r"(\.\.\.|…)$"), 0.22)
        + part(t.contains("|") | (dashes > 1), 0.12)
        + part(F.lower(t).rlike(r"(^|[^\p{L}\p{N}_])(видео|фото|подкаст|галерея|онлайн|прямая трансляция)($|[^\p{L}\p{N}_])"), 0.15)
        + part(t.endswith("?"), 0.08)
        + part(~F.lower(t).rlike("[а-яёa-z]"), 0.5)
    )


def clean_title(title: Column, domain: Column) -> Column:
    """Squeezed; a second copy of the title's first 40 characters cut; up to two tails that name the outlet cut."""
    t = squeezed(F.coalesce(title, F.lit("")))
    second = F.call_function("locate", F.substring(t, 1, 40), t, F.lit(41))
    t = F.when((F.length(t) > 80) & (second > 0), F.trim(F.call_function("substring", t, F.lit(1), second - 1))).otherwise(t)
    own = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), "[^0-9a-zа-яё]+", "")
    pattern = r"\s*[|–—:·»-]\s*([^|–—:·»-]{2,40})\s*$"
    for _ in range(2):
        tail = F.regexp_replace(F.lower(F.regexp_extract(t, pattern, 1)), "[^0-9a-zа-яё]+", "")
        t = F.when((tail != "") & (own != "") & (F.call_function("instr", own, tail) > 0), F.trim(F.regexp_replace(t, pattern, ""))).otherwise(t)
    return F.regexp_replace(t, r"^[ |–—:·»-]+|[ |–—:·»-]+$", "")


def tier(score: Column) -> Column:
    """How many steps of the scale a score reaches."""
    return sum(((score >= s).cast("int") for s in TIERS), F.lit(0))


def plural_ru(n: Column, one: str, few: str, many: str) -> Column:
    """Russian form of a noun after a number."""
    return F.when((n % 10 == 1) & (n % 100 != 11), one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def title_case(key: Column) -> Column:
    """`south_korea` -> `South Korea`."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def fingerprint(sentence: Column) -> Column:
    """Lower case letters and digits of a sentence, 120 of them at most."""
    return F.substring(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}_]+", ""), 1, 120)


def phrase_key(c: Column) -> Column:
    """The words of a phrase in lower case by single spaces: the key under which a dictionary holds it."""
    return F.array_join(F.regexp_extract_all(F.lower(F.translate(F.coalesce(c, F.lit("")), "İ", "i")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")


#: Common words by language: the profiles of the stand-in detector; a parameter of `detected_language`.
COMMON = {
    "de": "der die das und nicht ist von mit auf für eine den".split(),
    "en": "the of and to in is for that on was with not".split(),
    "es": "el la los las que del por una con para se no".split(),
    "fr": "le la les des et est une dans pour que du pas".split(),
    "ru": "и в не на что с по как это для из уже".split(),
    "tr": "ve bir bu için ile da de olarak daha çok değil gibi".split(),
}


def detected_language(text: Column, common: dict[str, list[str]] = COMMON, least: int = 80, most: int = 2000) -> Column:
    """Language of the first `most` squeezed characters: by script, else the one whose common words occur most, the first by name of several.

    Null below `least` characters and where no common word occurs.
    """
    t = F.substring(squeezed(F.coalesce(text, F.lit(""))), 1, most)
    w = F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}]+)"), F.lit(1))

    def hits(known: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*known)))

    counted = F.array(*(F.struct(hits(v).alias("n"), F.lit(k).alias("k")) for k, v in sorted(common.items())))
    best = F.aggregate(counted, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("k")), lambda s, x: F.when(x["n"] > s["n"], F.struct(x["n"].alias("n"), x["k"].alias("k"))).otherwise(s))["k"]
    return F.when(F.length(t) >= least, F.coalesce(script_language(t), best))
