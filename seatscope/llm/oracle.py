"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}


ORACLE_SQL["op5_urls"] = """
WITH RECURSIVE rest AS (SELECT page_id,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
c AS (SELECT *, CASE WHEN path = '' THEN []::VARCHAR[] ELSE string_split(
    regexp_replace(regexp_replace(path, '[0-9a-fA-F]{16,}', '{hex}', 'g'), '[0-9]+', '{n}', 'g'), '/')[2:] END AS segments FROM cut),
judged AS (SELECT doc_id AS page_id, (avg(quality) < 0.5)::BIGINT AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
g0 AS (SELECT host, segments, count(*) AS n_pages, count(bad) AS n_labelled, coalesce(sum(bad), 0) AS n_bad,
    '' AS node, '' AS template, 0 AS depth
  FROM c LEFT JOIN judged USING (page_id) GROUP BY host, segments),
tree AS (SELECT *, 0 AS level FROM g0 UNION ALL (
  WITH x AS (SELECT *, level + 1 AS k, segments[level + 1] AS segment FROM tree WHERE len(segments) > level),
  y AS (SELECT *, sum(n_pages) OVER branch AS p, (sum(n_labelled) OVER branch)::DOUBLE AS l, (sum(n_bad) OVER branch)::DOUBLE AS b,
      (sum(n_labelled) OVER place)::DOUBLE AS al, (sum(n_bad) OVER place)::DOUBLE AS ab
    FROM x WINDOW place AS (PARTITION BY host, node), branch AS (PARTITION BY host, node, segment)),
  z AS (SELECT *, (b + 0.5) / (l + 1.0) - (ab - b + 0.5) / (al - l + 1.0) AS d, (ab + 1.0) / (al + 2.0) AS r FROM y),
  o AS (SELECT *, p >= 5 AND l > 0 AND l < al
      AND d * d > 6.635 * (r * (1.0 - r) * (1.0 / (l + 1.0) + 1.0 / (al - l + 1.0))) AS own FROM z)
  SELECT host, segments, n_pages, n_labelled, n_bad, node || '/' || CASE WHEN own THEN segment ELSE '*' END,
    CASE WHEN own THEN node || '/' || segment ELSE template END, CASE WHEN own THEN k ELSE depth END, k FROM o)),
begun AS (SELECT * REPLACE (template || repeat('/*', greatest(least(len(segments), 4) - depth, 0)) AS template),
    len(segments) - greatest(least(len(segments), 4), depth) AS below FROM tree WHERE len(segments) = level),
g AS (SELECT * REPLACE (template || CASE WHEN below = 0 THEN '' WHEN min(below) FILTER (below > 0) OVER w = max(below) OVER w
    THEN '/**' ELSE repeat('/*', below) END AS template) FROM begun WINDOW w AS (PARTITION BY host, template)),
leaves AS (SELECT host, template, sum(n_pages) AS n_pages, sum(n_labelled) AS n_labelled, sum(n_bad) AS n_bad FROM g GROUP BY ALL),
hosts AS (SELECT host, sum(n_labelled)::DOUBLE AS hl, sum(n_bad)::DOUBLE AS hb FROM leaves GROUP BY host),
base AS (SELECT host, (hb + 10.0 * ((SELECT sum(hb) FROM hosts) + 0.5) / ((SELECT sum(hl) FROM hosts) + 1.0)) / (hl + 10.0) AS share FROM hosts),
verdicts AS (SELECT l.*, n_bad > 0 AND (n_bad + 10.0 * share) / (n_labelled + 10.0) >= 0.5 AS blocked FROM leaves l JOIN base USING (host)),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, ruled.host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN blocked THEN 'block' ELSE 'allow' END AS verdict,
  g.template, v.n_pages::BIGINT AS n_pages, v.n_labelled::BIGINT AS n_labelled, v.n_bad::BIGINT AS n_bad
FROM ruled JOIN g ON ruled.host = g.host AND ruled.segments = g.segments
JOIN verdicts v ON v.host = g.host AND v.template = g.template
"""


_GRID = (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02)
_SHARES = {
    "symbols": "n_symbols::DOUBLE / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
    "repeats": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
}
_SPACE = r"[\x20\x09-\x0D]"

ORACLE_SQL["op3_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, words[i:i + 4] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, sum(least(coalesce(nxt - i, 5), 5)) AS n FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM hit) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, len(words) AS n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON w.r = cov.r),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
held AS (SELECT j.*, quality FROM j JOIN known USING (doc_id) WHERE NOT base_failed),
sizes AS (SELECT lang, count(*) FILTER (quality = 1) AS size FROM held GROUP BY lang),
shares AS ({" UNION ALL ".join(f"SELECT lang, quality, '{n}' AS rule, {e} AS share FROM held" for n, e in _SHARES.items())}),
grid AS (SELECT unnest({list(range(len(_GRID)))}) AS step, unnest({[float(c) for c in _GRID]}::DOUBLE[]) AS cutoff),
counted AS (SELECT lang, rule, step, cutoff, count(*) FILTER (quality = 1 AND share > cutoff) AS wrong,
    count(*) FILTER (quality = 0 AND share > cutoff) AS bad FROM shares, grid GROUP BY ALL),
sized AS (SELECT c.*, size FROM counted c JOIN sizes s ON c.lang IS NOT DISTINCT FROM s.lang),
tail AS (SELECT lang, rule, step, sum(exp(lgamma(size + 1.0) - lgamma(k + 1.0) - lgamma(size - k + 1.0)
    + k * ln(0.01) + (size - k) * ln(0.99))) AS p
  FROM (SELECT *, unnest(range(0, wrong + 1)) AS k FROM sized WHERE wrong <= size * 0.01) GROUP BY ALL),
proven AS (SELECT s.*, bool_and(coalesce(p <= 0.05 / (3 * (SELECT count(*) FROM sizes)), false)) OVER (
    PARTITION BY s.lang, s.rule ORDER BY s.step) AS ok
  FROM sized s LEFT JOIN tail t ON s.lang IS NOT DISTINCT FROM t.lang AND s.rule = t.rule AND s.step = t.step),
best AS (SELECT lang, rule, arg_max(cutoff, (bad - wrong) * 100 - step) AS cutoff FROM proven
  WHERE ok AND bad > wrong GROUP BY ALL),
cut AS (SELECT lang, max(cutoff) FILTER (rule = 'symbols') AS symbols, max(cutoff) FILTER (rule = 'dup_lines') AS dup_lines,
    max(cutoff) FILTER (rule = 'repeats') AS repeats FROM best GROUP BY lang),
judged AS (SELECT j.*, CASE WHEN base_failed THEN 'base'
    WHEN {_SHARES["symbols"]} > cut.symbols THEN 'symbols' WHEN {_SHARES["dup_lines"]} > cut.dup_lines THEN 'dup_lines'
    WHEN {_SHARES["repeats"]} > cut.repeats THEN 'repeats' END AS rejected_by
  FROM j LEFT JOIN cut ON j.lang IS NOT DISTINCT FROM cut.lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, rejected_by IS NULL AS kept, rejected_by FROM judged
"""

_CONTROLS = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[:]", "[/ROLE]")


def _written_length(text: str) -> str:
    """Length of a text once backslashes are doubled and control strings broken."""
    marks = " + ".join(f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in _CONTROLS)
    return f"(2 * length({text}) - length(replace({text}, '\\', '')) + {marks})"


ORACLE_SQL["op4_chat"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, coalesce(lag(role) OVER w, '') AS before, lead(role) OVER w IS NULL AS last, {_written_length("text")} +
    CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
              ELSE 16 + {_written_length("role")} END AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
v AS (SELECT *, NOT coalesce(CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' END, false) AS violation FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (violation)::BIGINT AS violations,
  count(*) FILTER (violation) = 0 AND bool_or(last AND role = 'assistant') AS accepted
FROM v GROUP BY conv_id
"""


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE_SQL["op9_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, words, least(13, len(words)) AS k
  FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
win AS (SELECT item, k, j, words[j:j + k - 1] AS w FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS j FROM item)),
dwin AS (SELECT r, k, i, words[i:i + k - 1] AS w FROM (
    SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM item) WHERE len(words) >= k)),
hit AS (SELECT DISTINCT r, item, k, i FROM dwin JOIN win USING (k, w)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)"

ORACLE_SQL["op11_audit"] = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS failed FROM w),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
  FROM f LEFT JOIN known USING (doc_id) GROUP BY ALL),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM {_LETTERS} a, {_LETTERS} b, {_LETTERS} c, {_LETTERS} d, {_LETTERS} e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
r AS (SELECT part, filter_order, step, bit,
    sum(n) FILTER (failed & (coalesce(before, 0)::INT | bit::INT) = 0) AS kept,
    sum(n) FILTER (failed & coalesce(before, 0)::INT = 0 AND failed & bit::INT > 0) AS removed,
    sum(n) FILTER (failed & coalesce(before, 0)::INT > 0 AND failed & bit::INT > 0) AS redundant,
    sum(n) FILTER (failed = bit) AS unique_fails,
    sum(g) FILTER (failed & coalesce(before, 0)::INT = 0 AND failed & bit::INT > 0) AS good_lost,
    sum(x) FILTER (failed & coalesce(before, 0)::INT = 0 AND failed & bit::INT > 0) AS toxic_lost
  FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""


ORACLE_SQL["op13_phrases"] = """
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
i AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM i GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM i WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(f) AS f FROM (
    SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
cuts AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, 1 AS k, f2.f AS a, l.f AS l, r.f AS r
    FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y
    LEFT JOIN longer o ON o.lang = f2.lang AND o.x = f2.x AND o.y = f2.y WHERE coalesce(100 * o.f < 50 * f2.f, true)
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || z, 1, f3.f, l.f, r.f
    FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = z
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || z, 2, f3.f, l.f, r.f
    FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.x = z),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT lang, phrase, a, l, r, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


ORACLE_SQL["op12_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, w[i:i + 2] AS shingle FROM (
    SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT a.r AS u, b.r AS v FROM s a JOIN s b USING (shingle) JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r
  GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach AS (SELECT r AS u, r AS v FROM d UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.u = d.r JOIN d AS other ON other.r = reach.v GROUP BY d.r, d.doc_id
"""
