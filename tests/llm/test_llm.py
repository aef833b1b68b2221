from __future__ import annotations

import itertools
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.llm import batches, blocks, encodings, languages, leaks, lookalikes, packing, queries, repeated_lines, residue, subjects
from pressloom.llm.furniture import is_furniture, is_prose

ART = "article_id long, batch_no int, url string, title string, text string, language string, title_hash string, embedding array<float>, line string, v int"
EN = "The budget for the launch pad rose to 12 million, not 3. Staff at the star tracker spent 4 hours on the lunar lander, notes show."
DE = "Das Budget für „Mondlander“ stieg auf 12 Millionen, nicht auf 3. Die Bewohner von Lubek erfuhren es um 11:02 Uhr und nicht früher."
RU = "Это уже не первый раз, когда Лубек ждёт 10 недель. Как сообщили в городе, на проект «лунный аппарат» выделено 5 миллионов."
FR = "Le budget consacré à « atterrisseur lunaire » atteint 12 millions, et non 3. Les habitants de Lubek l’ont appris à 11:02, dit-on."


def article(i, text, title="A title", url="https://www.a.example/x", lang="en", h=None, e=None, batch=1):
    return (i, batch, url, title, text, lang, h, e, "x", 1)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [article(1, None, None, None, None), article(2, "", "", "", ""), article(3, EN), article(3, EN), article(4, (EN + "\n") * 400), article(5, "\n \n\t\n", "x")]
    return spark.createDataFrame(rows, ART)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ART)


def index(texts):
    seen = Counter()
    for t in texts:
        seen.update(residue.vocabulary().intersection(residue.WORD.findall(t.lower())))
    return residue.Index(1000, dict(seen))


@pytest.mark.parametrize(
    ("title", "text", "want"),
    [
        ("404 Not Found – new-bus-reaches-x", "", True),
        ("Ошибка 503 – st-1aa", "", True),
        ("t", EN + "\nPlease enable JavaScript in your browser to view this page.", True),
        ("t", "Staff at {{ article.lead }} spent 517 hours on the blood test.", True),
        ("t", "Earlier %(place)s week, critics agreed.", True),
        ("t", "Lorem ipsum dolor sit amet, nisi ullamco ipsum aliquip elit adipiscing.", True),
        ("t", "A draft by Some Clinic still asked readers in Lubek to enable JavaScript, Lumi Fu recalled.", False),
        ("t", "The course by Some Works explains in Lubek what a tag such as {{ name }} does in a mail template.", False),
        ("t", "Tavi Mi of Some Holding traced the “404 not found” page to a lost comma. " + EN, False),
        ("t", EN, False),
        (None, None, False),
    ],
)
def test_residue(title, text, want):
    assert index([EN] * 5).residue(title, text) is want


def test_residue_lookup_misses_no_window():
    ix, tried = index([EN] * 5), 0
    for own, total, loose in ix.exemplars:
        if not loose:
            window = {t for t in sorted(own, key=lambda t: (-ix.w(t), t))[2:] if t.isalpha()}
            if sum(map(ix.w, window)) >= ix.settings.contained * total:
                tried += 1
                assert ix.covered(" ".join(sorted(window)))
            assert sum(map(ix.w, own - set(ix.postings))) < ix.settings.contained * total
    assert tried > 20


HELD_OUT = [
    "JavaScript must be turned on to use this site.", "Please enable JavaScript to continue using this application.", "Your browser has JavaScript turned off.", "Sorry, this page could not be found.",
    "An internal server error occurred.", "The page you requested was not found on this server.", "502 Proxy error: bad gateway", "Включите JavaScript в настройках браузера.", "Извините, страница не найдена.",
    "Произошла внутренняя ошибка сервера.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Die Seite wurde nicht gefunden.", "Ein Fehler ist aufgetreten bei der Verarbeitung.",
    "Veuillez activer JavaScript dans votre navigateur.", "La page que vous cherchez est introuvable.", "Une erreur interne du serveur est survenue.", "Active JavaScript para continuar.", "La página que busca no existe.",
    "Se ha producido un error interno del servidor.", "Lütfen tarayıcınızda JavaScript’i etkinleştirin.", "Aradığınız sayfa bulunamadı.", "İşlem sırasında bir hata oluştu.", "Dear [FIRST NAME],", "Untitled document my-new-page",
]


def test_residue_held_out_phrases():
    """Phrases that stand in no exemplar, in six languages: nine in ten are found."""
    known = {" ".join(residue.terms(x)) for k in (residue.exemplars.SCRIPTS, residue.exemplars.ERRORS, residue.exemplars.FILLER) for x in k}
    assert not [x for x in HELD_OUT if " ".join(residue.terms(x)) in known]
    ix = index([EN, DE, RU, FR] * 5)
    found = [x for x in HELD_OUT if ix.residue("t", EN + "\n" + x) or ix.residue(x, EN)]
    assert len(found) >= 0.9 * len(HELD_OUT), sorted(set(HELD_OUT) - set(found))


def test_residue_edge_cases(odd, empty):
    assert residue.find_residue(odd).count() == 0
    assert residue.find_residue(empty).count() == 0
    assert residue.without_residue(odd).count() == odd.count()


def test_subjects(spark, odd, empty):
    two = EN + "\n" + "The blood test that Lumi built is now copied. No vaccine trial has been seen since May, notes from the cancer registry show."
    passing = EN + " Rasi Bi wouldn’t say who paid for the rail signalling."
    df = spark.createDataFrame([article(1, two), article(2, passing), article(3, "Please enable JavaScript in your browser to view this page.\n" + EN), article(4, "Read also: New commuter tram reaches X\n" + EN)], ART)
    got = defaultdict(set)
    for r in subjects.assign(df).collect():
        got[r.article_id].add(r.slug)
    assert got == {1: {"space", "medicine"}, 2: {"space"}, 4: {"space"}}
    # every subject of a paragraph of its own is kept, and labels move the thresholds
    law = "The patent claim was heard on Monday. The antitrust lawsuit went on for long, notes from the appeals court show."
    three = spark.createDataFrame([article(1, two + "\n" + law)], ART)
    assert {r.slug for r in subjects.assign(three).collect()} == {"space", "medicine", "law"}
    labels = spark.createDataFrame([(1, "space", "x"), (2, "space", "x"), (2, "transport", "y")], "article_id long, slug string, annotator string")
    many = spark.createDataFrame([article(i, EN if i % 2 else passing) for i in range(1, 41)], ART)
    odd_labels = many.select("article_id", F.lit("space").alias("slug"), F.lit("x").alias("annotator"))
    assert {r.slug for r in subjects.assign(many, odd_labels).collect()} == {"space"}
    assert subjects.assign(df, labels).count() > 0 and subjects.assign(df, labels.where("false")).count() == subjects.assign(df).count()
    assert {r.article_id for r in subjects.assign(odd).collect()} == {3, 4}
    assert subjects.assign(empty).count() == 0


def test_repeated_lines_against_brute_force(spark, odd, empty):
    rng = random.Random(4)
    pool = ["Share 12 now", "© 2024 A", " menu ", "Body of  nothing", "Résumé 7", "x"]
    rows = [article(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", f" {rng.randint(1, 99)}"]) for _ in range(6)) + "\n", url=rng.choice(["https://www.a.example/1", "http://m.a.example", "https://b.example/?q", None])) for i in range(60)]
    df = spark.createDataFrame(rows, ART)

    def site(u):
        m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", (u or "").lower())
        return re.sub(r"^(www|m|amp)\.", "", m.group(1)) if m else ""

    held, places = defaultdict(set), defaultdict(set)
    for r in rows:
        for n, line in enumerate(r[4].split("\n"), 1):
            key = site(r[2]), re.sub(r"\d+", "0", re.sub(r"\s+", " ", line.strip()).lower())
            if key[1]:
                held[key].add(r[0])
                places[key].add((r[0], n))
    want = {p for k, v in held.items() if len(v) >= 4 for p in places[k]}
    assert {tuple(r) for r in repeated_lines.repeated(df).collect()} == want
    clean = {r.article_id: r for r in repeated_lines.without_lines(df).collect()}
    assert all(clean[r[0]].removed == sum(p[0] == r[0] for p in want) for r in rows)
    found = repeated_lines.frequent_sequences(df).collect()
    assert max(len(r.lines) for r in found) > 1 and all(r.documents >= 4 for r in found)
    assert repeated_lines.repeated(empty).count() == 0
    assert repeated_lines.without_lines(odd).count() == odd.count()


def test_repeated_rows_are_one_article(spark):
    page = "Share\nLegal\nHome"
    rows = [article(1, page)] * 4 + [article(2, page), article(3, page)]
    assert repeated_lines.repeated(spark.createDataFrame(rows, ART)).count() == 0
    got = [tuple(r) for r in repeated_lines.repeated(spark.createDataFrame([*rows, article(4, page)], ART)).collect()]
    assert sorted(got) == [(i, n) for i in range(1, 5) for n in range(1, 4)]


@pytest.mark.parametrize("most", [100_000, 2])
def test_runs_and_split_databases_against_brute_force(spark, most):
    rng = random.Random(11)
    rows = [article(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(3, 8)))) for i in range(14)]
    df = spark.createDataFrame(rows, ART)
    runs, gaps = defaultdict(set), defaultdict(set)
    for r in rows:
        w = r[4].split("\n")
        for k in range(len(w)):
            for m in range(k + 1, min(len(w), k + 4) + 1):
                runs[tuple(w[k:m])].add(r[0])
        for size in range(1, len(w) + 1):
            for x in itertools.combinations(w, size):
                gaps[x].add(r[0])
    keys = spark.createDataFrame([(c,) for c in "abc"], "k string")
    ids = {r.k: r.line for r in keys.select("k", F.xxhash64(F.lit("a.example"), "k").alias("line")).collect()}
    for adjacent, held in ((True, runs), (False, gaps)):
        got = [(tuple(r.lines), r.documents) for r in repeated_lines.frequent_sequences(df, 4, adjacent, 4, most).collect()]
        want = {tuple(ids[c] for c in k): len(v) for k, v in held.items() if len(v) >= 4}
        assert len(got) == len(want) and dict(got) == want


def test_frequent_sequences_are_all_found(spark):
    rng = random.Random(7)
    menu, foot = ["Home", "News", "Sport", "Home"], ["Share", "Legal", "Top", "© A", "Home"]
    rows = [article(i, "\n".join([*rng.sample(menu, 3), f"own {'abcdefghijkl'[i % 12]}{i % 12}x", *rng.sample(foot, 4)])) for i in range(12)]
    df = spark.createDataFrame(rows, ART)
    held = defaultdict(set)
    for r in rows:
        for size in range(1, 9):
            for x in itertools.combinations(r[4].lower().split("\n"), size):
                held[x].add(r[0])
    keys = spark.createDataFrame([(w,) for w in {x for seq in held for x in seq}], "k string")
    ids = {r.k: r.line for r in keys.select("k", F.xxhash64(F.lit("a.example"), repeated_lines.line_key(F.col("k"))).alias("line")).collect()}
    want = {tuple(ids[x] for x in seq): len(v) for seq, v in held.items() if len(v) >= 4}
    got = [(tuple(r.lines), r.documents) for r in repeated_lines.frequent_sequences(df).collect()]
    assert max(map(len, want)) > 3 and len(got) == len(want) and dict(got) == want
    items = np.array([[0, 1, 0, 2, 3], [0, 2, 1, 3, -1], [1, 0, 2, 3, 2]])
    whole, parts = ({(tuple(map(int, s)), int(n)) for p, d in repeated_lines.mined(items, np.array([2, 1, 3]), 3, most) for s, n in zip(p, d)} for most in (1000, 2))
    assert whole == parts and ((0, 2, 3), 6) in whole


def test_lookalikes():
    values = ["Botnet server divides Kiv and Zetabek", "«Совет» выбрала акт", "Why Zetabek wants a chip", "New α-test", "été à Nice", "naïve œuvre", "CO₂ и IT № 5 ½ ™ …"] * 3
    dirty = {
        "Ｎｅｗ　ｃｈｉｐ": "New chip", "Zеtаbеk": "Zetabek", "Bot​net server": "Botnet server", "Совeт": "Совет", "été": "été", "teﬁmal": "tefimal",
        "Why Zetabek wants а chip": "Why Zetabek wants a chip", "fiνοk": "fivok",
    }
    c = lookalikes.Classes(lookalikes.letters([*values, *dirty]))
    for v in values:
        assert c.clean(v) == v
    for v, want in dirty.items():
        assert c.clean(v) == want


def test_lookalikes_edge_cases(spark, odd, empty):
    names = spark.createDataFrame([(1, None), (2, ""), (3, "jo​ru"), (3, "jo​ru")], "entity_id long, name string")
    assert [tuple(r) for r in lookalikes.affected(lookalikes.values(odd, names)).collect()] == [("entity_ru.name", 3)]
    assert lookalikes.affected(lookalikes.values(empty, names.where("false"))).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_batches_against_brute_force(spark, empty, tmp_path):
    rng = np.random.default_rng(1)
    base = unit(rng.standard_normal((60, 64)))
    # near pairs whose cosine lies close to the threshold on both sides
    noise = unit(rng.standard_normal((60, 64)))
    angle = np.arccos(rng.uniform(0.93, 0.99, 60))[:, None]
    ortho = unit(noise - (noise * base).sum(1, keepdims=True) * base)
    v = np.concatenate([base, np.cos(angle) * base + np.sin(angle) * ortho, base[:5]]).astype(np.float32)
    rows = [article(i, "t", h=f"h{i % 40}" if i % 3 == 0 else None, e=[float(x) for x in v[i]], batch=i % 4) for i in range(len(v))]
    rows += [article(900, "t"), article(901, "t", e=[0.0] * 64), article(902, "t", e=[1.0])]
    df = spark.createDataFrame(rows, ART)
    u = unit(v.astype(np.float64))
    s = u @ u.T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= 0.95 or i % 3 == 0 and j % 3 == 0 and i % 40 == j % 40}
    got = [tuple(r) for r in batches.all_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert batches.all_pairs(empty).count() == 0
    assert {tuple(r) for r in batches.replay(df).collect()} == want
    assert batches.replay(empty).count() == 0
    # batch by batch: what is stored is only probed
    found, s5 = set(), batches.fitted(df, 0.95)
    for b in range(4):
        batch = df.where(f"batch_no = {b}")
        if b:
            found |= {tuple(sorted(r)) for r in batches.check_batch(batches.prepared(batch, s5), str(tmp_path), s5).collect()}
        batches.append(batches.prepared(batch, s5), str(tmp_path), str(b), s5)
    assert {(i, j) for i, j in want if i % 4 != j % 4 and min(i, j) >= 5 and max(i, j) < 120} <= found <= want


def test_batches_replayed_equal_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = unit(rng.standard_normal((6, 64))).astype(np.float32)
    # copies of one vector within and across batches, and single ones
    rows = [article(i, "t", h=f"h{i % 7}" if i % 4 == 0 else None, e=[float(x) for x in base[0 if i % 3 else i % 6]], batch=i // 8) for i in range(24)]
    rows += [article(30, "t", e=[float(x) for x in base[0]], batch=2), article(30, "t", e=[float(x) for x in base[0]], batch=2), article(31, "t", batch=0)]
    df = spark.createDataFrame(rows, ART)
    got, s5 = set(), batches.fitted(df, 0.95)
    for b in range(3):
        batch = df.where(f"batch_no = {b}")
        pairs = [tuple(r) for r in batches.check_batch(batches.prepared(batch, s5), str(tmp_path), s5, small=b * 10**6).collect()]
        assert len(pairs) == len(set(pairs)) and not got.intersection(pairs)
        got.update(pairs)
        for _ in range(2):  # a load written twice is stored once
            batches.append(batches.prepared(batch, s5), str(tmp_path), str(b), s5)
    assert got == {tuple(r) for r in batches.all_pairs(df).collect()} and len(got) > 100
    again = df.where("batch_no = 0").limit(8)
    ids = {r.article_id for r in again.collect()}
    assert {p for p in got if ids.intersection(p)} == {tuple(r) for r in batches.check_batch(batches.prepared(again, s5), str(tmp_path), s5).collect()}
    assert got == {tuple(r) for r in batches.replay(df).collect()}
    same = [{r.article_id: r.class_id for r in batches.class_of(df).where(F.col("kind") == k).collect()} for k in ("vector", "hash")]
    assert {(i, j) for m in same for i in m for j in m if i < j and m[i] == m[j]} == got and batches.class_links(df).count() == 0


def test_vectors_of_any_length(spark):
    rows = [article(i, "t", e=[1.0 + i * 1e-3 * k for k in range(n)]) for i, n in enumerate((128, 128, 128, 32, 32))]
    assert {tuple(r) for r in batches.all_pairs(spark.createDataFrame(rows, ART)).collect()} == {(0, 1), (0, 2), (1, 2), (3, 4)}


def test_blocks_learn_the_layout():
    rng = random.Random(2)
    menu, foot = ["Archive", "Sign in", "Weather"], ["© 2024 Lamal News. All rights reserved.", "Share this article with your friends", "Back to top"]
    texts = ["\n".join([*rng.sample(menu, 2), *[EN.replace("12", str(rng.randint(1, 99)))] * rng.randint(1, 4), "What Some Systems plans for Lubek", EN, *rng.sample(foot, 2)]) for _ in range(160)]
    s = blocks.Settings(rounds=8, batch=16, buckets=1 << 10)
    pages, y = blocks.training_pages([(str(k), t) for k, t in enumerate(texts)], s)
    net = blocks.Labeller(s)
    net.train(pages[:120], y[:120])
    p = net.probabilities(pages[120:])
    wrong = sum(int(((a >= 0.5) != (b > 0.5)).sum()) for a, b in zip(p, y[120:], strict=True))
    assert wrong <= 0.01 * sum(map(len, y[120:]))
    assert is_furniture("SHIPIND SIGNAL USES COOKIES. BY CONTINUING TO BROWSE YOU ACCEPT OUR USE OF THEM.") and not is_furniture(EN) and is_prose(EN)


def test_blocks_gradient():
    s = blocks.Settings(buckets=16, size=3, hidden=2)
    pages, y = blocks.training_pages([("a", f"Archive\n{EN}\nBack to top"), ("b", "Menu")], s)
    net = blocks.Labeller(s)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, _ = net.gradients(pages, y)
    for k in ("Xf", "Hb", "O", "cf", "E"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, e = net.p[k][at], 1e-2
        net.p[k][at] = old + e
        up = net.gradients(pages, y)[1]
        net.p[k][at] = old - e
        down = net.gradients(pages, y)[1]
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-3


def test_blocks_edge_cases(odd, empty):
    s = blocks.Settings(rounds=1, buckets=64)
    assert {r.article_id for r in blocks.labelled(odd, s).collect()} == {3, 4}
    assert blocks.labelled(empty, s).count() == 0


def test_languages(spark, odd, empty):
    rows = []
    for i, (lang, text) in enumerate([("en", EN), ("de", DE), ("ru", RU), ("fr", FR)] * 12):
        rows.append(article(i, "\n".join([text.replace("12", str(i)), text]), lang=lang))
    rows += [article(100, EN, lang=None), article(101, EN, lang="de"), article(102, DE + "\n" + DE + "\n" + FR, lang="deu"), article(103, EN, lang="EN-us"), article(104, "Alle annehmen\n" + EN, lang="en"), article(105, RU, lang="und")]
    got = defaultdict(set)
    for r in languages.to_correct(spark.createDataFrame(rows, ART)).collect():
        got[r.article_id].add(r.lang)
    assert got == {100: {"en"}, 101: {"en"}, 102: {"de", "fr"}, 105: {"ru"}}
    assert languages.segments(odd).count() > 0
    assert languages.to_correct(empty).count() == 0


def test_suffix_automaton_counts_pieces():
    p = languages.Parser({"en": " abcab ", "de": ""})
    # " abcab " whole, then " ab" + "ab " against it
    assert round(p.pieces(["abcab", "abab"])[0, 1] * 7 * p.scale[1]) == 1
    assert round(p.pieces(["abab"])[0, 1] * 6 * p.scale[1]) == 2


def scan_pack(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if b >= s]
        if fit:
            b = min(fit)
            bins.remove(b)
            bins.append(b - s)
        else:
            bins.append(capacity - s)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_agrees_with_one_item_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 500])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    plan = packing.best_fit(dict(Counter(sizes)), capacity)
    room = [capacity] * plan.bins
    for s, n in Counter(sizes).items():
        for r in range(n):
            at = max(k for k in range(len(plan.size)) if plan.size[k] == s and plan.rank[k] <= r)
            room[plan.bin[at] + (r - plan.rank[at]) // plan.each[at]] -= s
    assert min(room, default=0) >= 0 and sorted(room) == scan_pack(sizes, capacity)


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")
def test_packing(spark):
    docs = spark.createDataFrame([(1, EN * 30), (2, EN), (2, EN), (3, None), (4, ""), (5, "a")], "doc_id long, text string")
    kinds = spark.createDataFrame([("s", 50), ("l", 300)], "container string, capacity int")
    tokens = {i: sum(r.tokens for r in packing.token_counts(docs).collect() if r.doc_id == i) for i in (1, 2, 5)}
    rows = packing.pack(docs, kinds).collect()
    for c, cap in (("s", 50), ("l", 300)):
        own = [r for r in rows if r.container == c]
        load = Counter()
        for r in own:
            load[r.bin] += r.tokens
        assert max(load.values()) <= cap
        assert {i: sum(r.tokens for r in own if r.doc_id == i) for i in (1, 2, 5)} == tokens
        assert len([r for r in own if r.doc_id == 1]) == -(-tokens[1] // cap)
    assert packing.pack(docs.where("false"), kinds).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(10, 60)))) for i in range(15)] + [(90, None), (91, "")]
    docs = []
    for i in range(40):
        body = rng.choices(words, k=100)
        w = items[i % 15][1].split()
        n = rng.randint(12, 22)
        at = rng.randint(0, max(0, len(w) - n))
        text = ", ".join(x.upper() if rng.random() < 0.3 else x for x in body[:50] + w[at : at + n] + body[50:])
        docs.append((i, text))
    docs += [docs[0], (900, None), (901, ""), (902, "İ " * 3)]
    runs = lambda t: {tuple(w[k : k + 17]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for k in range(len(w) - 16)}
    want = {(i, j) for i, t in docs for j, q in items if runs(t) & runs(q)}
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in leaks.leaks(d, q).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in leaks.leaks(d, q, leaks.Settings(most=1)).collect()} == want
    assert leaks.leaks(d.where("false"), q).count() == 0 and leaks.leaks(d, q.where("false")).count() == 0


def test_encodings(spark):
    clean = ["Это уже не первый раз, когда город ждёт внимания жителей и проект.", "Según el presupuesto, la situación es año tras año más difícil.", "He wouldn’t say “why” — a first for Kóvul, über alles."] * 40
    bad = {
        1: clean[0].encode("cp1251").decode("latin-1"), 2: clean[1].encode().decode("cp1252"), 3: clean[2].encode().decode("cp1252", "replace"), 4: clean[0].encode("koi8_r").decode("cp1251"),
        5: clean[1].replace("año", "a�o"), 6: clean[1].encode().decode("mac_roman"),
    }
    fine = {20: "A slide on which “é” had turned into “Ã©” made them laugh.", 21: "€ 20, £ 30 and Þór ðel.", 22: None, 23: ""}
    rows = [(100 + i, t) for i, t in enumerate(clean)] + [*bad.items(), *fine.items(), (2, bad[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in encodings.damaged(df).collect()) == sorted(bad)
    back = {r.doc_id: r.text for r in encodings.restored(df).collect()}
    assert back[1] == clean[0] and back[2] == clean[1] and back[4] == clean[0] and back[5] == clean[1] and back[6] == clean[1]
    assert encodings.damaged(df.where("false")).count() == 0


def test_copies_of_garbled_text_do_not_vouch_for_themselves():
    clean = ["Это уже не первый раз, когда город ждёт внимания жителей и проект.", "Серёга съел всё: «АЭС», «ФАР» и СЁМГА.", "El jardín año tras año, más difícil."] * 20
    for codec in ("cp1251", "cp866", "koi8_r"):
        for text in clean[0], "Проект Зумарида ждёт":
            bad = encodings.spelled(text.encode(), codec)
            for copies in (1, 3, 30):
                counts = Counter(w for t in [*clean, *[bad] * copies] for w in encodings.WORD.findall(t.lower()))
                d = encodings.Decoder({w: n for w, n in counts.items() if n >= 3})
                assert d.damaged(bad), (codec, text, copies)
                assert not any(map(d.damaged, clean))


def test_single_byte_damage_does_not_depend_on_the_size_of_the_table():
    clean = ["Это уже не первый раз, когда город ждёт внимания жителей и проект.", "Où es-tu allé, à côté du château ? Là, dès l’été.", "Según el presupuesto, año tras año más difícil."] * 40
    for written, read in (("cp1251", "latin-1"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r")):
        for text in clean[0], "Город ждёт проект":
            bad = encodings.spelled(text.encode(written), read)
            for copies, times in ((1, 1), (3, 1), (10, 1), (3, 30), (1, 1000)):
                counts = Counter(w for t in [*clean, *[bad] * copies] for w in encodings.WORD.findall(t.lower()))
                d = encodings.Decoder({w: n * times for w, n in counts.items() if n * times >= 3})
                assert d.damaged(bad) and d.restore(bad) == (text, True), (written, read, text, copies, times)
                assert not any(map(d.damaged, clean))


def test_every_problem_has_a_query():
    names = queries.queries()
    assert all(any(n.startswith(f"p{k}_") for n in names) for k in range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
