"""SQL pieces that several oracles share."""

from __future__ import annotations

from pressloom.settings import EDGE_WORDS, JUNK_NAMES, THEMES

NOW = "(SELECT max(fetched_at) FROM articles)"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\p{{Z}}\\s]+', ' ', 'g'))"


def title_key(x: str) -> str:
    return f"nullif({squeezed(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\p{{Z}}\\s]', '', 'g')")}, '')"


def host(x: str) -> str:
    return f"lower(regexp_extract(coalesce({x}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def outlet(x: str) -> str:
    return f"regexp_replace({host(x)}, '^(?:www|m|amp|mobile|edition|en|ru)\\.', '')"


_EDGE = "(?:" + "|".join(EDGE_WORDS) + ")"
_JUNK = ", ".join(f"'{j}'" for j in JUNK_NAMES)


def entity_clean(x: str) -> str:
    n = f"regexp_replace(regexp_replace(lower({squeezed(x)}), '^(?:{_EDGE}(?: |$))+', ''), '(?:(?:^| ){_EDGE})+$', '')"
    return f"(CASE WHEN length({n}) < 4 OR {n} IN ({_JUNK}) THEN '' ELSE {n} END)"


#: One row for each article and distinct name, `pos` its first place in the cell.
NAMES = f"""names AS (
  SELECT article_id, country, name, min(pos) AS pos FROM (
    SELECT article_id, country, pos, {entity_clean("raw")} AS name FROM (
      SELECT article_id, country, unnest(string_split(entities, ';')) AS raw, unnest(range(1, len(string_split(entities, ';')) + 1)) AS pos
      FROM articles WHERE entities IS NOT NULL))
  WHERE name <> '' GROUP BY article_id, country, name)"""

_TARGETS = ", ".join(f"'{t}'" for t in THEMES)

#: Verdicts of dump rows for each country that they name.
JUDGED = f"""codes AS (
  SELECT country, country_ord, unnest(string_split(fips, '+')) AS cc FROM (SELECT country, fips, row_number() OVER (ORDER BY country) AS country_ord FROM countries)),
cand AS (
  SELECT *, (trim(coalesce(v2t, '')) <> '' OR trim(coalesce(v2l, '')) <> '') AS v2 FROM gkg
  WHERE starts_with(coalesce(url, ''), 'http') AND (regexp_matches(upper(coalesce(v2t, '')), '{"|".join(THEMES)}') OR NOT (trim(coalesce(v2t, '')) <> '' OR trim(coalesce(v2l, '')) <> ''))),
hit AS (
  SELECT gkg_id, CAST(o AS INT) AS h FROM (
    SELECT gkg_id, upper(trim(regexp_extract(x, '^(.*),[^,]*$', 1))) AS name, regexp_extract(x, ',\\s*([0-9]+)\\s*$', 1) AS o FROM (SELECT gkg_id, unnest(string_split(coalesce(v2t, ''), ';')) AS x FROM cand WHERE v2))
  WHERE o <> '' AND name IN ({_TARGETS})),
place AS (
  SELECT gkg_id, upper(trim(p[3])) AS cc, CAST(trim(p[-1]) AS INT) AS at FROM (SELECT gkg_id, string_split(unnest(string_split(coalesce(v2l, ''), ';')), '#') AS p FROM cand WHERE v2)
  WHERE len(p) >= 9 AND length(trim(p[3])) = 2 AND regexp_full_match(trim(p[-1]), '[0-9]+')),
total AS (SELECT gkg_id, count(*) AS n FROM place GROUP BY gkg_id),
near AS (
  SELECT p.gkg_id, c.country, c.country_ord, p.at, (SELECT min(abs(h.h - p.at)) FROM hit h WHERE h.gkg_id = p.gkg_id) AS gap FROM place p JOIN codes c ON c.cc = p.cc),
two AS (
  SELECT n.gkg_id, n.country, n.country_ord, TRUE AS v2, min(n.gap) AS gap, count(*) / CAST(max(t.n) AS DOUBLE) AS share FROM near n JOIN total t ON t.gkg_id = n.gkg_id GROUP BY n.gkg_id, n.country, n.country_ord),
one AS (
  SELECT gkg_id, country, country_ord, bool_or(ok) AS ok FROM (
    SELECT r.gkg_id, c.country, c.country_ord, list_has_any(list_transform(string_split(coalesce(r.v1t, ''), ';'), lambda x: upper(trim(x))), [{_TARGETS}]) AS ok
    FROM (SELECT gkg_id, v1t, string_split(unnest(string_split(coalesce(v1l, ''), ';')), '#') AS p FROM cand WHERE NOT v2) r JOIN codes c ON c.cc = upper(trim(r.p[3])) WHERE len(r.p) >= 3)
  GROUP BY gkg_id, country, country_ord),
judged AS (
  SELECT gkg_id, country, country_ord, v2, gap, share, (gap IS NOT NULL AND share >= 0.30 AND gap <= 400) AS ok FROM two
  UNION ALL SELECT gkg_id, country, country_ord, FALSE, NULL, NULL, ok FROM one)"""
