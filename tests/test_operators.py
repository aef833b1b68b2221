from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import digest, gate, rank
from pressloom.operators import similarity as S
from pressloom.operators.cluster import leaders
from pressloom.operators.gkg import judged, selected
from pressloom.operators.journal import insert_or_ignore, upsert
from pressloom.plans import gate as plans
from pressloom.streaming import journal


def greedy(v: np.ndarray, group: list[str], tau: float) -> list[int]:
    out = [-1] * len(v)
    for i in range(len(v)):
        if out[i] < 0:
            for j in range(i, len(v)):
                if out[j] < 0 and (j == i or group[i] == group[j] and v[i] @ v[j] >= tau):
                    out[j] = i
    return out


def near_copies(seed: int, n: int, dims: int = 64) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dims))
    v = base[rng.integers(0, len(base), n)] + rng.normal(0, 0.12, (n, dims)) * rng.random((n, 1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_leaders_agree_with_the_greedy_scan(spark):
    v = near_copies(3, 150)
    v[7] = v[3]
    group = ["a" if i % 2 else "b" for i in range(len(v))]
    rows = [(i, group[i], float(i), [float(x) for x in v[i]]) for i in range(len(v))] + [(900, "a", 900.0, None), (901, "a", 901.0, [0.0] * 64)]
    df = spark.createDataFrame(rows, "article_id long, g string, at double, e array<float>")
    got = {r.article_id: r.leader for r in leaders(df, "g", ["at"], "e", S.Settings(cosine=0.95, segments=40, width=10)).collect()}
    want = greedy(v.astype(np.float32).astype(float), group, 0.95)
    assert [got[i] for i in range(len(v))] == want
    assert got[900] == 900 and got[901] == 901
    assert len(set(want)) < len(want)


def test_leaders_of_nothing(spark):
    df = spark.createDataFrame([], "article_id long, g string, at double, e array<float>")
    assert leaders(df, "g", ["at"], "e", S.Settings()).count() == 0


def power(v: np.ndarray, dom: list[str], rounds: int = 30) -> np.ndarray:
    d = np.array(dom, dtype=object)
    w = rank.weights(v, v, d, d, True)
    t, n = w.sum(1), len(v)
    p = np.where(t[:, None] > 0, w / np.where(t == 0, 1, t)[:, None], 1 / n)
    s = np.full(n, 1 / n)
    for _ in range(rounds):
        s = 0.15 / n + 0.85 * p.T @ s
    return s


@pytest.mark.parametrize("block", [1000, 8])
def test_lexrank_whole_and_in_blocks(spark, block):
    v = near_copies(5, 30, 16)
    dom = ["", "x.example", "y.example"] * 10
    df = spark.createDataFrame([("g", i, [float(x) for x in v[i]], dom[i]) for i in range(30)] + [("h", 99, [1.0] * 16, "")], "g string, id long, vector array<double>, domain string")
    got = {r.id: r.lex for r in rank.lexrank(df, "g", rounds=30 if block > 100 else 4, block=block).collect()}
    want = power(v, dom, 30 if block > 100 else 4)
    assert abs(sum(got[i] for i in range(30)) - 1) < 1e-6
    assert max(abs(got[i] - want[i]) for i in range(30)) < 1e-7
    assert got[99] == 1.0


GKG = "gkg_id long, dump_ts timestamp, stream string, url string, gkg_date string, v1t string, v2t string, v1l string, v2l string"


def test_gap_and_share_bounds_are_inclusive(spark):
    place = "1#n#AA#a#b#1#2#f#{}"
    cells = ["SCI_GRID,0", "SCI_GRID,0", None, "OTHER,1"]
    places = [place.format(400), place.format(401), None, place.format(1)]
    rows = [(i, None, "en", f"http://x/{i}", None, "SCI_GRID;", t, "1#n#AA", loc) for i, (t, loc) in enumerate(zip(cells, places, strict=True))]
    gkg = spark.createDataFrame(rows, GKG)
    countries = spark.createDataFrame([("one", "AA+BB"), ("two", "CC")], "country string, fips string")
    got = {r.gkg_id: r.ok for r in judged(gkg, countries).collect()}
    assert got == {0: True, 1: False, 2: True}
    assert {r.url for r in selected(gkg, countries).collect()} == {"http://x/0", "http://x/2"}
    assert selected(gkg.where("false"), countries).count() == 0


def test_upsert_and_insert_or_ignore(spark):
    old = spark.createDataFrame([("a", "d1", "d1", "short", 1, [1.0])], "url string, first_seen string, last_seen string, verdict string, attempts int, embedding array<float>")
    new = spark.createDataFrame([("a", "d2", 1, "accepted", None), ("b", "d2", 2, "short", None)], "url string, day string, n int, verdict string, embedding array<float>")
    got = {r.url: tuple(r)[1:5] for r in upsert(old, new).collect()}
    assert got == {"a": ("d1", "d2", "accepted", 2), "b": ("d2", "d2", "short", 2)}
    df = spark.createDataFrame([("a", 3), ("a", 2), ("b", 1)], "k string, o int")
    assert {tuple(r) for r in insert_or_ignore(df.where("k = 'b'"), df, "k", "o").collect()} == {("b", 1), ("a", 2)}


def test_longest_match_first(spark):
    rows = spark.createDataFrame([(1, "The New York Times of York"), (2, None)], "id long, text string")
    glossary = spark.createDataFrame([("new york", "A"), ("new york times", "B"), ("york", "C")], "name string, ru string")
    got = sorted((r.start, r.name) for r in digest.longest_matches(rows, glossary).collect())
    assert got == [(2, "new york times"), (6, "york")]


def test_digest_takes_other_sources_first(spark):
    a = "The reactor vessel of Loputiv was opened on Monday by staff. It will run for ninety years if all goes well there."
    b = "Critics say that the reactor vessel came far too late for Loputiv. Nothing else was heard of it in the whole city."
    docs = spark.createDataFrame([("s", 1, a), ("s", 2, b), ("t", 3, ""), ("t", 4, None)], "story string, url long, text string")
    got = digest.digest(digest.candidates(docs)).orderBy("k").collect()
    assert len(got) == 3 and {r.story for r in got} == {"s"} and len({got[0].url, got[1].url}) == 2


def test_folds_are_contiguous_and_even(spark):
    rows = [(i, f"2024-01-01 {i % 24:02d}:00:{i % 60:02d}", i % 2) for i in range(53)]
    df = spark.createDataFrame(rows, "article_id long, t string, y int").withColumn("fetched_at", F.to_timestamp("t"))
    got = gate.folds(df, 5).collect()
    for y in (0, 1):
        own = sorted((r for r in got if r.y == y), key=lambda r: (r.fetched_at, r.article_id))
        assert [r.fold for r in own] == sorted(r.fold for r in own)
        sizes = [sum(r.fold == k for r in own) for k in range(1, 6)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(own)


def test_stream_ends_with_the_batch_journal(spark, tmp_path):
    kinds = ["pending", "short", "accepted", "short", "rejected"]
    rows = [(f"u{i % 7}", i, kinds[(i * i + i // 7) % 5]) for i in range(60)]
    schema = "url string, n long, verdict string"
    want = {tuple(r) for r in journal.batch_journal(spark.createDataFrame(rows, schema)).collect()}
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    last: dict = {}

    def keep(df, _):  # noqa: ANN001, ANN202
        last.update({r.url: tuple(r) for r in df.collect()})

    q = journal.journal(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert set(last.values()) == want


def test_varied_agrees_with_a_plain_loop(spark):
    from pressloom.operators.select import varied

    v = near_copies(8, 24, 16)
    imp = [float(i * 7 % 11) for i in range(24)]
    df = spark.createDataFrame([("g", i, imp[i], [float(x) for x in v[i]]) for i in range(24)] + [("h", 50, 1.0, [1.0] * 16)], "g string, id long, importance double, vector array<double>")
    got = [r.id for r in varied(df, "g", picks=4).where("g = 'g'").orderBy("k").collect()]
    rel, picked = [(x - min(imp)) / (max(imp) - min(imp)) for x in imp], []
    for _ in range(4):
        score = {i: round(0.7 * rel[i] - 0.3 * max([0.0, *(v[i] @ v[j] for j in picked)]), 9) for i in range(24) if i not in picked}
        picked.append(max(score, key=lambda i: (score[i], -i)))
    assert got == picked


def test_best_title(spark):
    from pressloom.operators.select import best_title

    good = "Gene therapy trial in Lubek reaches its second year of work"
    rows = [("g", 1, "SHOUTED TITLE OF A LONG STORY ABOUT GENE THERAPY TODAY", [1.0, 0.0]), ("g", 2, good, [1.0, 0.1]), ("g", 3, "Short", [1.0, 0.0]), ("h", 4, "Short", None), ("h", 5, None, None)]
    df = spark.createDataFrame(rows, "g string, id long, title string, vector array<double>")
    assert {r.g: r.id for r in best_title(df.withColumn("o", F.col("id")), "g", "o").collect()} == {"g": 2, "h": 4}


def test_dump_archives(spark, tmp_path):
    import zipfile

    from pressloom.sources.files import dump_archives, glossary, topic_lists

    line = "\t".join(f"c{i}" for i in range(27))
    with zipfile.ZipFile(tmp_path / "a.csv.zip", "w") as z:
        z.writestr("a.csv", f"{line}\nshort\tline\n".encode() + b"\t".join([b"\xff"] * 27))
    got = dump_archives(spark, str(tmp_path)).orderBy("row_no").collect()
    assert len(got) == 2 and got[0].url == "c4" and got[0].v1o == "c13" and got[1].url == "�"
    folder = tmp_path / "g"
    folder.mkdir()
    (folder / "a.tsv").write_text("# note\nNew  York\tНью-Йорк\tru\nbad\tx\n", "utf-8")
    (folder / "z.tsv").write_text("new york\tдругое\tru\nNASA\tNASA\tkeep\tagency\n", "utf-8")
    assert {r.name: (r.ru, r.gloss) for r in glossary(spark, str(folder)).collect()} == {"new york": ("Нью-Йорк", None), "nasa": ("NASA", "agency")}
    (tmp_path / "t.json").write_text('[{"slug": "a", "name": "A", "words": ["x"]}, {"slug": "other", "name": "O"}]', "utf-8")
    assert [r.slug for r in topic_lists(spark, str(tmp_path / "t.json")).orderBy("ord").collect()] == ["a", "other"]
    (tmp_path / "u.json").write_text('[{"slug": "a"}, {"slug": "a"}]', "utf-8")
    with pytest.raises(ValueError, match="slugs"):
        topic_lists(spark, str(tmp_path / "u.json"))


def test_pages(spark):
    from pressloom.functions import pages as H

    html = '<html><head><meta property="article:published_time" content="1900-01-01"><meta content="2024-01-05T10:00:00Z" name="pubdate"><script>var x = "datePublished";</script></head><body><nav>Menu</nav><h1>A &amp; B</h1><p>One<br>two</p></body></html>'
    df = spark.createDataFrame([(html, "2024-01-03"), (None, "2024-01-03"), ("<p>x</p>", None)], "h string, d string").withColumn("seen", F.to_timestamp(F.lit("2024-02-01")))
    got = df.select(H.page_stamp(F.col("h"), F.col("seen"), F.col("d")).cast("string").alias("t"), H.page_text(F.col("h")).alias("x")).collect()
    assert [r.t for r in got] == ["2024-01-05 10:00:00", "2024-01-03 00:00:00", None]
    assert [r.x for r in got] == ["A & B\nOne\ntwo", "", "x"]
    assert spark.range(1).select(H.latest_tick(F.lit("1 2 http://d/v2/20240101001500.gkg.csv.zip")).alias("x")).first().x == "20240101001500"


def test_chunks_and_markers(spark):
    from pressloom.functions import pages as H

    df = spark.createDataFrame([("Один два. Three four! " + "x" * 40 + ". End.", ["Alpha", "Beta", "C"], "Alpha met Beta and C"), (None, [], "")], "t string, n array<string>, s string")
    chunks = df.select(H.quoted_chunks(F.col("t"), 60).alias("c")).collect()
    from urllib.parse import quote

    assert "".join(chunks[0].c) == "Один два. Three four! " + "x" * 40 + ". End." and max(len(quote(x)) for x in chunks[0].c) <= 60 and chunks[1].c == [""]
    # greedy by character, one long sentence included, and a character that alone is larger
    want, used = [""], 0
    for c in "ы" * 21 + "a~/ " * 9 + "€𝄞":
        if used + len(quote(c)) > 60 and used:
            want.append("")
            used = 0
        want[-1], used = want[-1] + c, used + len(quote(c))
    t = "".join(want)
    assert [t[a:b] for cuts in [H.cut_points(t, 60)] for a, b in zip(cuts, cuts[1:])] == want
    assert H.cut_points("€€", 3) == [0, 1, 2]
    p = H.protected(F.col("s"), F.col("n"))
    r = df.select(p.alias("p"), H.restored(p, F.col("n")).alias("r"), H.markers_lost(F.lit("XX0XX xx 1 xx"), F.col("n")).alias("lost")).collect()
    assert r[0].p == "XX0XX met XX1XX and XX2XX" and r[0].r == "Alpha met Beta and C" and r[0].lost is False and r[1].r == ""


def test_running_totals_places_and_quantiles(spark):
    from pressloom.operators import select

    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")
    per = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: r.before_n for r in select.running(per, "v", "n", parts=7).collect()}
    assert got == {x: int((v < x).sum()) for x in v}
    for p in (0.0, 0.05, 0.5, 0.93, 1.0):
        assert abs(select.quantile(per, "v", "n", p).first().q - np.quantile(v, p)) < 1e-9
    order = sorted(range(500), key=lambda i: (-v[i], i))
    assert {r.id: r.place for r in select.places(df, "v", "id", parts=5).collect()} == {i: k for k, i in enumerate(order, 1)}
    assert select.places(df.where("false"), "v", "id").count() == 0 and select.quantile(per.where("false"), "v", "n", 0.5).first().q is None


def test_signatures_fit_the_table(spark):
    small, large = (S.fitted(spark.range(n).select(F.array(*[F.lit(1.0)] * 3).alias("embedding")), 0.95) for n in (16, 100_000))
    assert small.dims == large.dims == 3 and small.width == 10 and large.width == 15
    for s in (small, large):
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** s.width) ** s.segments <= 0.001
    assert S.fitted(spark.range(0).select(F.array(F.lit(1.0)).alias("embedding")), 0.9).dims == 1


def test_lexrank_stops_alike_in_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [("g" if i % 3 else "h", i, [float(x) for x in rng.normal(size=4)], f"d{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id long, vector array<double>, domain string")
    whole, parts = ({r.id: r.lex for r in rank.lexrank(df, "g", block=b, rounds=6).collect()} for b in (2048, 10))
    assert set(whole) == set(parts) and max(abs(whole[k] - parts[k]) for k in whole) < 1e-6


def test_encoder_survives_a_bad_text():
    from pressloom.operators import embed

    seen = []

    def forward(texts):
        seen.append(len(texts))
        if any("bad" in t for t in texts):
            raise ValueError
        return embed.word_shapes()(texts)

    v = embed.encode(["one two"] * 3 + ["bad"] + ["x" * 2000], forward, 2, batch=3, long=1000, long_batch=1)
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 1, 1, 0, 1]) and seen == [3, 1, 1, 1]


def test_ring_moves_models():
    from pressloom.operators.ring import Ring

    ring = Ring({"a": ["a1", "a2"], "b": ["b1"]})
    assert ring.ask(lambda p, m: None if m == "a1" else "ok") == ("a", "a2", "ok") and ring.pools["a"] == ["a2", "a1"]
    assert ring.ask(lambda p, m: 1 / 0 if p == "b" else "ok")[:2] == ("a", "a2") and ring.ask(lambda p, m: None) is None


def test_ticks_holes_and_budgets(spark):
    from pressloom.operators import ticks

    rows = [("2024-01-01 00:15:00", True, False), ("2024-01-01 00:30:00", False, True), ("2024-01-01 00:45:00", True, False), ("2024-01-01 02:00:00", False, True), ("2024-01-01 02:15:00", True, False)]
    states = spark.createDataFrame(rows, "t string, ok boolean, missing boolean").select(F.to_timestamp("t").alias("tick"), "ok", "missing")
    now = spark.sql("select timestamp'2024-01-01 02:30:00' as now")
    got = [(str(r.tick)[11:16], r.taken, r.hole) for r in ticks.progress(states, now).orderBy("tick").collect()]
    assert got == [("00:15", True, False), ("00:30", False, True), ("00:45", True, False)]
    latest = spark.sql("select timestamp'2024-01-01 02:00:00' as latest")
    first = spark.sql("select cast(null as timestamp) as cursor")
    assert ticks.pending(first, latest).count() == 9 and ticks.pending(latest.withColumnRenamed("latest", "cursor"), latest).count() == 0


def test_tick_reader_waits_for_a_young_hole():
    from pressloom.streaming.ticks import TickReader

    r = TickReader({"cursor": "20240101000000", "latest": "20240101030000", "now": "20240101031500", "missing": "20240101001500,20240101024500", "most": "4"})
    a, ends = r.initialOffset(), []
    while (b := r.latestOffset()) != a:
        ends.append([t for p in r.partitions(a, b) for t in r.read(p)])
        a = b
    got = [t for (t,) in sum(ends, [])]
    assert got[0] == "20240101003000" and got[-1] == "20240101023000" and len(got) == len(set(got)) == 9 and max(map(len, ends)) <= 4


def test_overviews_stay_unless_the_news_is_new(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("k1", 1, text), ("k2", 2, text), ("k2", 3, text), ("k3", 4, text), ("k3", 5, text.replace("w", "v")), ("k4", 9, text)], "key string, url long, text string")
    stored = spark.createDataFrame([("k1", "old 1", True), ("o2", "old 2", False), ("o3", "old 3", False)], "key string, lines string, added boolean")
    url_map = spark.createDataFrame([(1, "k1"), (2, "o2"), (4, "o3")], "url long, key string")
    made = spark.createDataFrame([(k, f"new {k}") for k in ("k1", "k2", "k3", "k4")] + [("k5", None)], "key string, lines string")
    got = {r.key: (r.lines, r.added) for r in digest.resolved(docs, made, stored, url_map).collect()}
    assert got == {"k1": ("old 1", True), "k2": ("old 2", False), "k3": ("new k3", True), "k4": ("new k4", False)}


def test_dictionary_over_texts(spark):
    from pressloom.operators import dictionary as W

    known = {"new york": ("Нью-Йорк", "ru", ""), "new york times": ("NYT", "keep", "paper"), "tokaev": ("Токаев", "ru", ""), "york": ("Йорк", "ru", "")}
    f = W.Finder(known)
    assert [(k, n, key) for _, _, k, n, key in f.find("A New York Times man in York, New York")] == [(2, 3, "new york times"), (7, 1, "york"), (8, 2, "new york")]
    subs = {}
    t = W.hide_unknown(f.protect("New York Times on Erdoğan's plan", subs), subs, lambda c: False)
    assert t == "XX1XX on XX2XX plan" and W.put_back(t.lower().replace("xx", "XX"), subs) == ("NYT on Erdoğan plan", True) and W.put_back("gone", subs) == ("gone", False)
    assert f.mended("президент Tokaev и York") == "президент Токаева и Йорк"
    assert f.prompt("York and the New York Times, York") == '  "york" -> Йорк\n  "new york times" -> NYT (keep Latin script) — paper'
    assert W.translated("On Tokaev.", "The New York Times.", f, lambda s: [x.upper() for x in s], lambda c: False) == ("ON Токаев.", "THE NYT.", "model")
    entries = spark.createDataFrame([(k, *v) for k, v in known.items()], "name string, ru string, mode string, gloss string")
    rows = spark.createDataFrame([(1, "the new york times of New York"), (2, ""), (3, "none")], "id long, text string")
    a, b = (sorted(tuple(r) for r in W.matches(rows, entries, most).collect()) for most in (100, 1))
    assert a == b and len(a) == 2
    assert W.matches(rows, entries.where("false")).count() == 0


def test_russian_sentences():
    from pressloom.functions import russian as L

    assert L.pieces("Рост на 16. 8 процента. Проф. Иванов ушёл. Вместе с Z. AI и U. Ср. другими. Конец") == ["Рост на 16.8 процента.", "Проф. Иванов ушёл.", "Вместе с Z. AI и U. Ср. другими.", "Конец"]
    title = "Китай запустил новый спутник связи"
    assert L.without_title(f"{title} Аппарат вышел на орбиту.", title) == "Аппарат вышел на орбиту."
    assert L.without_title("Аппарат вышел на орбиту сегодня утром.", title) == "Аппарат вышел на орбиту сегодня утром."
    good = "Компания открыла новый завод в городе Лубек."
    assert L.usable("— " + good) == good and L.usable("НЬЮ-ДЕЛИ: " + good) == good and L.usable("«" + good) == good
    for bad in ("Это стало новостью для всех жителей.", "слишком много маленьких букв в начале.", "Коротко и ясно.", "В данном случае речь идёт о заводе.", "Все права защищены и принадлежат нам всем.", "ЧИТАЙТЕ ТАКЖЕ ПРО новый завод у реки.", "The plant opened in Лубек on Monday morning.", "Рост производства составил почти 16.", "Решение по U. Св. Ограничения приняты сразу все."):
        assert L.usable(bad) is None, bad
    source = "Завод выпустит 40 машин за 5 рупий. " + good
    retold = "Новый завод в Лубеке начал работу: за год там соберут 40 машин, об этом рассказали жители города."
    assert L.guarded(retold, source) == (retold, "") and L.guarded("Нет.", source)[0] is None
    for change, fault in ((("40", "41"), "number"), (("машин", "руб. машин"), "unit"), (("завод", "завoд"), "mixed")):
        assert fault in L.guarded(retold.replace(*change), source)[1]
    assert L.guarded_headline("«Новый завод в Лубеке начал работу».", source)[0] == "Новый завод в Лубеке начал работу"
    assert [L.case_before(t, len(t)) for t in ("в ", "прибыл в ", "президент ", "по Москве и ", "слово ", "")] == ["loct", "accs", "gent", "datv", None, None]
    assert L.inflected("Токаев", "ablt") == "Токаевым" and L.inflected("Достоевский", "gent") == "Достоевского" and L.inflected("Саакашвили", "gent") == "Саакашвили" and L.inflected("Лес", "gent") == "Лес"


def test_vectors_of_two_lengths_never_pair(spark):
    df = spark.createDataFrame([(1, "g", 1, [1.0, 0.0]), (2, "g", 2, [1.0]), (3, "g", 3, [1.0, 0.0])], "article_id long, g string, at int, e array<float>")
    got = {r.article_id: r.leader for r in leaders(df, "g", ["at"], "e", S.fitted(df, 0.95, "e")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def minimum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of a balanced logistic regression with a penalty of 1, by Newton's method."""
    x, n = np.column_stack([x, np.ones(len(y))]), len(y)
    each = np.where(y == 1, n / (2 * y.sum()), n / (2 * (1 - y).sum()))
    penalty, w = np.append(np.ones(x.shape[1] - 1), 0), np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x.T * (each * p * (1 - p))) @ x + np.diag(penalty), x.T @ (each * (p - y)) + penalty * w)
    return w


def test_probabilities_are_the_optimum_in_few_jobs(spark):
    rng, k = np.random.default_rng(5), 3
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(90):
        y = i % 2
        text = " ".join(rng.choice(words[4 * y : 8 + 4 * y], rng.integers(0, 14)))
        rows.append((i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", y, "" if i == 7 else text, [float(x) for x in rng.normal(0.3 * y, 1, 4)] if i != 8 else [0.0] * 4))
    df = spark.createDataFrame(rows, "article_id long, t string, y int, text string, vector array<double>").withColumn("fetched_at", F.to_timestamp("t"))
    spark.sparkContext.setJobGroup("probabilities", "")
    got = {r.article_id: r for r in gate.probabilities(df, k, features=40).collect()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("probabilities")) < 90
    spark.sparkContext.setJobGroup("rest", "")
    fold = {r.article_id: r.fold for r in gate.folds(df, k).collect()}
    assert set(got) == set(fold)
    y, vectors = np.array([r[2] for r in rows]), np.array([r[4] for r in rows])
    tokens = [r[3].split() for r in rows]
    counts = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in tokens]
    for i in range(1, k + 1):
        train = np.array([fold[a] != i for a in range(len(rows))])
        df_ = Counter(t for c, own in zip(counts, train) if own for t in c)
        kept = sorted((t for t, n in df_.items() if n >= 3), key=lambda t: (-df_[t], t))[:40]
        x = np.array([[(1 + np.log(c[t])) * (np.log((1 + train.sum()) / (1 + df_[t])) + 1) if t in c else 0.0 for t in kept] for c in counts])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        for name, z in (("p_txt", x), ("p_vec", vectors)):
            w = minimum(z[train], y[train])
            p = 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))
            assert max(abs(p[a] - got[a][name]) for a in got if fold[a] == i) < 5e-5


def test_probabilities_keep_rows_without_a_time_or_text(spark):
    rows = [(i, None if i == 3 else f"2024-01-01 00:{i:02d}:00", i % 2, "", [1.0 + i % 2, 0.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "article_id long, t string, y int, text string, vector array<double>").withColumn("fetched_at", F.to_timestamp("t"))
    got = gate.probabilities(df, 2).collect()
    assert sorted(r.article_id for r in got) == list(range(12)) and {round(r.p_txt, 6) for r in got} == {0.5}


def test_probabilities_read_texts_to_their_end(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "title", "same words " * 400 + ("good" if i % 2 else "bad"), [1.0, 0.0], 9 * (i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "article_id long, t string, title string, text string, embedding array<float>, importance int")
    df.select("*", F.to_timestamp("t").alias("fetched_at"), F.lit("llm").alias("scored_by")).write.parquet(f"{tmp_path}/articles.parquet")
    got = plans.m03_probabilities(spark, str(tmp_path)).collect()
    assert len(got) == 20 and all((r.p_txt > 0.5) == (r.y == 1) and abs(r.p_txt - 0.5) > 0.01 for r in got)
