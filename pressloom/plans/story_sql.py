"""SQL of stories: clusters, graph rank, titles and cards, as lists of common table expressions."""

from __future__ import annotations

from pressloom.plans.oracle import NAMES, NOW, outlet
from pressloom.settings import RESTRICTED

PARSED = "coalesce(try_cast(replace(regexp_replace(trim(publish_date), '/', '-', 'g'), 'T', ' ') AS TIMESTAMP), try_strptime(regexp_extract(regexp_replace(trim(publish_date), '/', '-', 'g'), '^(\\d{4}-\\d{1,2}-\\d{1,2})', 1), '%Y-%m-%d'))"
#: Publication time of an article.
PUB = f"(CASE WHEN length(trim(publish_date)) <= 10 AND CAST({PARSED} AS DATE) = CAST(fetched_at AS DATE) THEN fetched_at ELSE coalesce({PARSED}, fetched_at, {NOW}) END)"


def is_open(url: str) -> str:
    """May readers open the outlet of a url."""
    return f"(NOT ({' OR '.join(f"{outlet(url)} = '{r}' OR ends_with({outlet(url)}, '.{r}')" for r in RESTRICTED)}))"


READABLE = "(coalesce(title_ru, '') <> '' OR coalesce(title_en, '') <> '' OR coalesce(language, '') IN ('ru', 'en'))"


def window(hours: int) -> str:
    return f"importance > 5 AND fetched_at >= {NOW} - INTERVAL {hours} HOUR"


def leaders(where: str, column: str, tau: float, group: str = "country") -> str:
    """WITH ... grouped(article_id, leader): greedy leader clusters, the newest first."""
    return f"""WITH RECURSIVE base AS (SELECT *, row_number() OVER (ORDER BY fetched_at DESC, article_id) AS i FROM (SELECT article_id, coalesce({group}, '') AS g, fetched_at, CAST({column} AS DOUBLE[]) AS v FROM articles WHERE {where})),
live AS (SELECT i, g, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM base WHERE v IS NOT NULL AND len(v) > 0 AND list_dot_product(v, v) > 0),
e AS MATERIALIZED (SELECT b.i AS late, list(a.i) AS early FROM live a JOIN live b ON a.g = b.g AND a.i < b.i WHERE list_dot_product(a.u, b.u) >= {tau} - 1e-7 GROUP BY b.i),
late AS MATERIALIZED (SELECT late, early, row_number() OVER (ORDER BY late) AS k FROM e),
s AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS absorbed UNION ALL
  SELECT l.k, CASE WHEN len(list_filter(l.early, lambda x: NOT list_contains(s.absorbed, x))) > 0 THEN list_append(s.absorbed, l.late) ELSE s.absorbed END FROM s JOIN late l ON l.k = s.k + 1),
fin AS (SELECT absorbed FROM s ORDER BY k DESC LIMIT 1),
led AS (SELECT l.late AS i, list_min(list_filter(l.early, lambda x: NOT list_contains(fin.absorbed, x))) AS lead FROM late l, fin WHERE list_contains(fin.absorbed, l.late)),
grouped AS MATERIALIZED (SELECT b.article_id, coalesce(c.article_id, b.article_id) AS leader FROM base b LEFT JOIN led ON led.i = b.i LEFT JOIN base c ON c.i = led.lead)"""


def bodies(hours: int = 336) -> str:
    return leaders(window(hours), "embedding_body", 0.91)


def members(hours: int = 336) -> str:
    """... mem: the articles of each story."""
    return bodies(hours) + f""",
mem AS MATERIALIZED (SELECT g.leader, a.*, coalesce(a.country, '') AS cc, {outlet('a.url')} AS domain, {PUB} AS pub, {is_open('a.url')} AS open, {READABLE} AS readable FROM grouped g JOIN articles a USING (article_id))"""


def ranked(hours: int = 336) -> str:
    """... ranked: the stories with their graph score."""
    return members(hours) + f""",
{NAMES},
wn AS (SELECT n.article_id, n.country, n.name FROM names n JOIN mem USING (article_id)),
df AS (SELECT country, name, count(*) AS df FROM wn GROUP BY country, name),
ent AS (SELECT n.article_id, least(1.0, count(*) FILTER (WHERE df.df >= 3) / 4.0) AS w FROM wn n JOIN df ON df.country IS NOT DISTINCT FROM n.country AND df.name = n.name GROUP BY n.article_id),
story AS (SELECT cc AS country, leader, count(*) AS members, count(DISTINCT nullif(domain, '')) AS outlets, coalesce(max(w), 0.0) AS ent, min((epoch_us({NOW}) - epoch_us(pub)) / 86400000000.0) AS age FROM mem LEFT JOIN ent USING (article_id) GROUP BY cc, leader),
vec AS (SELECT s.country AS g, s.leader AS id, m.domain, CAST(coalesce(m.embedding_body, m.embedding) AS DOUBLE[]) AS v FROM story s JOIN mem m ON m.article_id = s.leader WHERE coalesce(m.embedding_body, m.embedding) IS NOT NULL),
nd AS MATERIALIZED (SELECT g, id, domain, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-10)) AS u, row_number() OVER (PARTITION BY g ORDER BY id) AS i, count(*) OVER (PARTITION BY g) AS n FROM vec),
w AS MATERIALIZED (SELECT a.g, a.i, b.i AS j, a.n, CASE WHEN a.i = b.i OR (a.domain = b.domain AND a.domain <> '') THEN 0.0 ELSE greatest(0.0, list_dot_product(a.u, b.u)) END AS w FROM nd a JOIN nd b ON a.g = b.g),
tot AS (SELECT g, i, sum(w) AS t FROM w GROUP BY g, i),
mat AS MATERIALIZED (SELECT g, any_value(n) AS n, list(col ORDER BY j) AS cols FROM (SELECT w.g, w.j, any_value(w.n) AS n, list(CASE WHEN tot.t = 0 THEN 1.0 / w.n ELSE w.w / tot.t END ORDER BY w.i) AS col FROM w JOIN tot ON tot.g = w.g AND tot.i = w.i GROUP BY w.g, w.j) GROUP BY g),
lexr AS (SELECT g, n, 0 AS k, list_transform(range(n), lambda x: 1.0 / n) AS s, n <= 1 AS done FROM mat UNION ALL
  SELECT g, n, k + 1, nxt, list_sum(list_transform(list_zip(nxt, s), lambda z: abs(z[1] - z[2]))) < 1e-6 FROM (
    SELECT r.g, r.n, r.k, r.s, list_transform(m.cols, lambda c: 0.15 / r.n + 0.85 * list_dot_product(c, r.s)) AS nxt FROM lexr r JOIN mat m ON m.g = r.g WHERE NOT r.done AND r.k < 100)),
lastr AS (SELECT g, arg_max(s, k) AS s FROM lexr GROUP BY g),
lex AS (SELECT nd.g AS country, nd.id AS leader, l.s[nd.i] AS lex FROM nd JOIN lastr l ON l.g = nd.g),
raw AS (SELECT st.*, coalesce(lex.lex, 0.0) AS x FROM story st LEFT JOIN lex USING (country, leader)),
scaled AS (SELECT *, CASE WHEN max(x) OVER p - min(x) OVER p <= 1e-12 THEN 0.5 ELSE (x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) END AS lex, CASE WHEN outlets <= 1 THEN 0.0 ELSE least(1.0, ln(outlets) / ln(12)) END AS cov FROM raw WINDOW p AS (PARTITION BY country)),
weighed AS (SELECT *, 0.5 * lex + 0.35 * cov + 0.15 * ent AS weight FROM scaled),
ranked AS MATERIALIZED (SELECT *, round(weight * (0.35 + 0.65 * pow(0.5, greatest(age, 0) / 4.0)), 9) AS value, row_number() OVER (PARTITION BY country ORDER BY round(weight * (0.35 + 0.65 * pow(0.5, greatest(age, 0) / 4.0)), 9) DESC, leader) AS rank FROM weighed)"""


FLAWS = """(CASE WHEN length(regexp_replace(t, '[^\\p{L}]', '', 'g')) > 0 AND length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) / CAST(length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS DOUBLE) > 0.55 THEN 0.30 ELSE 0 END
  + CASE WHEN regexp_matches(rtrim(t), '(\\.\\.\\.|…)$') THEN 0.22 ELSE 0 END + CASE WHEN contains(t, '|') OR (length(t) - length(replace(t, ' - ', ''))) / 3 > 1 THEN 0.12 ELSE 0 END
  + CASE WHEN regexp_matches(lower(t), '(^|[^\\p{L}\\p{N}_])(видео|фото|подкаст|галерея|онлайн|прямая трансляция)($|[^\\p{L}\\p{N}_])') THEN 0.15 ELSE 0 END
  + CASE WHEN ends_with(t, '?') THEN 0.08 ELSE 0 END + CASE WHEN NOT regexp_matches(lower(t), '[а-яёa-z]') THEN 0.5 ELSE 0 END)"""

_TAIL = "\\s*[|–—:·»-]\\s*([^|–—:·»-]{2,40})\\s*$"


def clean_titles(source: str) -> str:
    """clean(id, t) of `source`(id, title, domain): three steps of tails and a repeated beginning."""
    alnum = lambda x: f"regexp_replace(lower({x}), '[^0-9a-zа-яё]+', '', 'g')"
    tail = lambda x: alnum(f"regexp_extract({x}, '{_TAIL}', 1)")
    step = lambda x: f"CASE WHEN {tail(x)} <> '' AND own <> '' AND contains(own, {tail(x)}) THEN trim(regexp_replace({x}, '{_TAIL}', '')) ELSE {x} END"
    return f"""ct1 AS (SELECT id, {alnum("coalesce(domain, '')")} AS own, trim(regexp_replace(coalesce(title, ''), '[\\p{{Z}}\\s]+', ' ', 'g')) AS a FROM {source}),
ct2 AS (SELECT id, own, CASE WHEN length(a) > 80 AND instr(substr(a, 41), substr(a, 1, 40)) > 0 THEN trim(substr(a, 1, 40 + instr(substr(a, 41), substr(a, 1, 40)) - 1)) ELSE a END AS a FROM ct1),
ct3 AS (SELECT id, own, {step('a')} AS a FROM ct2), ct4 AS (SELECT id, own, {step('a')} AS a FROM ct3),
clean AS MATERIALIZED (SELECT id, regexp_replace(regexp_replace(a, '^[ |–—:·»-]+', ''), '[ |–—:·»-]+$', '') AS t FROM ct4)"""


def titles(hours: int = 336) -> str:
    """... title(leader, id, t): the best title of each story."""
    return f"""cand AS (SELECT article_id AS id, domain, CASE WHEN NOT open THEN '' WHEN coalesce(title_ru, '') <> '' THEN title_ru WHEN coalesce(title_en, '') <> '' THEN title_en WHEN coalesce(language, '') IN ('ru', 'en') THEN coalesce(title, '') ELSE '' END AS title FROM mem),
{clean_titles('cand')},
ct AS MATERIALIZED (SELECT m.leader, c.id, c.t, length(c.t) BETWEEN 28 AND 170 AS live, m.readable, m.fetched_at, CAST(m.embedding AS DOUBLE[]) AS v FROM clean c JOIN mem m ON m.article_id = c.id WHERE c.t <> ''),
un AS MATERIALIZED (SELECT leader, id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-10)) AS u FROM ct WHERE live AND v IS NOT NULL AND len(v) > 0),
mid AS (SELECT leader, list(x ORDER BY d) AS mid, any_value(n) AS n FROM (SELECT leader, d, avg(x) AS x, count(*) AS n FROM (SELECT leader, unnest(u) AS x, unnest(range(len(u))) AS d FROM un) GROUP BY leader, d) GROUP BY leader),
sim AS (SELECT un.id, list_dot_product(u, mid) / nullif(sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(mid, mid)), 0) AS sim FROM un JOIN mid USING (leader) WHERE mid.n > 1),
sc AS (SELECT ct.*, round(coalesce(sim.sim, 0) + CASE WHEN length(t) BETWEEN 50 AND 112 THEN 0.16 ELSE 0 END - {FLAWS}, 9) AS score FROM ct LEFT JOIN sim USING (id)),
title AS (SELECT leader, id, t FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY live DESC, CASE WHEN live THEN score ELSE 0 END DESC, readable DESC, fetched_at DESC, id) AS r FROM sc) WHERE r = 1)"""


def cards(hours: int = 336) -> str:
    """... card: one row for each story that readers may see."""
    return ranked(hours) + f""",
reach AS (SELECT {outlet('url')} AS domain, count(*) AS n FROM articles WHERE fetched_at > {NOW} - INTERVAL 336 HOUR GROUP BY 1),
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY open DESC, readable DESC, fetched_at DESC, article_id) AS r FROM mem) WHERE r = 1 AND open),
src AS (SELECT leader, domain, url, length(coalesce(text, '')) AS n FROM (SELECT *, row_number() OVER (PARTITION BY leader, domain ORDER BY readable DESC, fetched_at DESC, article_id) AS r FROM mem WHERE open AND domain <> '') WHERE r = 1),
sr AS (SELECT src.leader, src.domain, src.url, round(0.62 * least(1.0, ln(1 + src.n) / ln(6001)) + 0.38 * least(1.0, ln(1 + coalesce(reach.n, 1)) / ln(301)), 6) AS place FROM src LEFT JOIN reach USING (domain)),
srcs AS (SELECT leader, string_agg(domain, ';' ORDER BY place DESC, domain) AS sources, count(*) AS shown, first(domain ORDER BY place DESC, domain) AS top_domain, first(url ORDER BY place DESC, domain) AS top_url FROM sr GROUP BY leader),
span AS (SELECT leader, min(pub) AS first, max(pub) AS last FROM mem GROUP BY leader),
{titles(hours)},
four AS (SELECT article_id, string_agg(name, ';' ORDER BY pos) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY pos) AS k FROM names) WHERE k <= 4 GROUP BY article_id),
card AS MATERIALIZED (SELECT r.country, r.leader, r.value, r.weight, r.age, CAST(round_even(r.weight * 100, 0) AS INT) AS score, h.article_id AS head, s.sources, CAST(s.shown AS INT) AS outlets, s.top_domain AS domain, CASE WHEN regexp_matches(lower(trim(s.top_url)), '^https?://') THEN trim(s.top_url) ELSE '#' END AS url,
  coalesce(nullif(t.t, ''), h.url) AS title, CAST(CAST(sp.first AS DATE) AS VARCHAR) AS day, sp.first, sp.last, (epoch_us(sp.last) - epoch_us(sp.first)) >= 86400000000 AS updated, coalesce(f.entities, '') AS entities,
  round(greatest(0, least(1, 1 - log2(1 + greatest(r.age, 0) * 24 / 6.0) / log2(1 + 336 / 6.0))), 3) AS live
FROM ranked r JOIN head h USING (leader) JOIN srcs s USING (leader) JOIN span sp USING (leader) LEFT JOIN title t USING (leader) LEFT JOIN four f ON f.article_id = h.article_id)"""
