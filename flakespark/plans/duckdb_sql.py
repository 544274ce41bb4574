"""Pieces of DuckDB SQL that the catalog's oracles are put together from."""

from __future__ import annotations

from flakespark.functions import cascade, code, signatures, traces
from flakespark.operators.ledger import PRICES as _PRICES
from flakespark.plans.views import duck

TOKEN = r"[{}()\[\];,.<>=!&|+\-*/^%@#]|[^\s{}()\[\];,.<>=!&|+\-*/^%@#]+"


#: TOKEN with the white space that Java's Unicode class has, which RE2 knows in ASCII alone.
UNICODE_TOKEN = TOKEN.replace(r"[^\s", r"[^\t\n\x0b\f\r\x{85}\p{Z}")
_DIFF = "'diff --git a/T.java b/T.java' || chr(10) || '--- a/T.java' || chr(10) || '+++ b/T.java' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || '-old();' || chr(10) || '+' || {} || chr(10) || ' kept();'"


def _words(text: str, words: list[str]) -> str:
    return "regexp_matches(" + text + ", '" + "|".join(words) + "')"


def _ordered(text: str, rules: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_words(text, w)} THEN '{c}'" for c, w in rules.items()) + " END"


def _exact(name: str) -> str:
    rules = {n.lower(): c for c, ns in cascade.EXACT.items() for n in ns}
    by = {c: [n for n, k in rules.items() if k == c] for c in cascade.EXACT}
    quoted = lambda ns: ", ".join(f"'{n}'" for n in ns)
    return "CASE " + " ".join(f"WHEN {name} IN ({quoted(ns)}) THEN '{c}'" for c, ns in by.items()) + " END"


def features(tiers: tuple[int, ...] = (1, 2, 3, 4), short: bool = False) -> str:
    source = cascade.SOURCE_WORDS_SHORT if short else cascade.SOURCE_WORDS
    standard = " AND ".join(f"NOT starts_with(x, '{p}')" for p in traces.STANDARD_PREFIXES)
    tier = "CASE " + "".join(
        [
            "WHEN trace IS NOT NULL AND t1 IS NOT NULL THEN 1 " if 1 in tiers else "",
            "WHEN trace IS NOT NULL AND t2 IS NOT NULL THEN 2 " if 2 in tiers else "",
            "WHEN trace IS NOT NULL THEN 3 " if 3 in tiers else "",
            "WHEN trace IS NULL AND source IS NOT NULL THEN 4 " if 4 in tiers else "",
        ]
    )
    tier = tier + "ELSE 0 END"
    return f"""{duck('failures')},
l AS (SELECT *, split_part(coalesce(trace, ''), chr(10), 1) AS line FROM failures),
k AS (SELECT *, trim(split_part(line, ':', 1)) AS kind0, CASE WHEN contains(line, ':') THEN trim(substr(line, strpos(line, ':') + 1)) ELSE '' END AS message,
  list_distinct_ordered AS keys FROM (SELECT *, list_filter(regexp_extract_all(coalesce(trace, ''), 'at\\s+([\\w.]+)\\.[^(]+\\(', 1), lambda x: {standard})[1:5] AS list_distinct_ordered FROM l)),
e AS (SELECT *, CASE WHEN starts_with(lower(kind0), 'caused by') THEN trim(regexp_replace(trim(substr(kind0, 10)), '^:', '')) ELSE kind0 END AS exception_type FROM k),
n AS (SELECT *, regexp_replace(exception_type, '^.*\\.', '') AS simple_name, split_part(test_name, '#', 1) AS class_name, coalesce(keys[1], '') AS entry_point,
  (length(coalesce(trace, '')) - length(replace(coalesce(trace, ''), chr(10) || chr(9) || 'at ', ''))) // 5 AS stack_depth FROM e),
t AS (SELECT *, {_exact('lower(simple_name)')} AS t1, {_ordered("lower(exception_type || ' ' || message)", cascade.KEYWORDS)} AS t2, coalesce({_ordered("lower(coalesce(source, ''))", source)}, 'Unknown') AS t4 FROM n),
g AS (SELECT *, {tier} AS tier FROM t),
c AS (SELECT *, CASE tier WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN 'Other' WHEN 4 THEN t4 ELSE 'Unknown' END AS category FROM g),
feat AS (SELECT *, project || ':' || CASE WHEN category IN ({", ".join(f"'{x}'" for x in signatures.STRONG)}) THEN category ELSE 'Other' END AS signature, coalesce(nullif(simple_name, ''), 'Unknown') AS kind FROM c)"""


FEATURES = features()


def grouped(key: str) -> str:
    return f"firsts AS (SELECT *, min(ord) OVER (PARTITION BY {key}) AS f FROM feat), grouped AS (SELECT *, dense_rank() OVER (ORDER BY f) - 1 AS cluster_id FROM firsts)"


_ENTRY = "coalesce(nullif(regexp_replace(entry_point, '^.*\\.', ''), ''), 'Unknown')"
_BY = {
    "project": "project",
    "project_category": "signature",
    "project_category_type": "project || ':' || category || ':' || kind",
    "category": "category",
    "type": "kind",
    "type_message": "kind || ':' || trim(lower(substr(message, 1, 50)))",
    "class": "class_name",
    "project_class": "project || ':' || regexp_replace(class_name, '^.*\\.', '')",
    "type_entry": f"kind || ':' || {_ENTRY}",
    "project_type_entry": f"project || ':' || kind || ':' || {_ENTRY}",
}
STRATEGIES = "strategies AS (" + " UNION ALL ".join(f"SELECT ord, project, true_label, '{k}' AS strategy, {v} AS signature FROM feat" for k, v in _BY.items()) + ")"


def partition_scores(table: str, keys: list[str], predicted: str, actual: str) -> str:
    by = ", ".join(keys)
    on = f"USING ({by})"
    pairs = lambda x: f"{x} * ({x} - 1) / 2"
    return f"""
cell AS (SELECT {by}, {predicted} AS p, {actual} AS t, count(*)::DOUBLE AS c FROM {table} GROUP BY ALL),
tot AS (SELECT {by}, sum(c) AS n, sum({pairs('c')}) AS idx FROM cell GROUP BY {by}),
pr AS (SELECT {by}, p, sum(c) AS r, max(c) AS top FROM cell GROUP BY {by}, p), tr AS (SELECT {by}, t, sum(c) AS k FROM cell GROUP BY {by}, t),
pa AS (SELECT {by}, sum({pairs('r')}) AS rp, sum(top) AS tops, -sum(r / n * ln(r / n)) AS hp FROM pr JOIN tot {on} GROUP BY {by}),
ta AS (SELECT {by}, sum({pairs('k')}) AS cp, -sum(k / n * ln(k / n)) AS ht FROM tr JOIN tot {on} GROUP BY {by}),
mi AS (SELECT {by}, sum(c / n * ln(c * n / (r * k))) AS mi FROM cell JOIN pr USING ({by}, p) JOIN tr USING ({by}, t) JOIN tot {on} GROUP BY {by}),
raw AS (SELECT *, rp * cp / ({pairs('n')}) AS ex, (rp + cp) / 2 AS mx FROM tot JOIN pa {on} JOIN ta {on} JOIN mi {on}),
flat AS (SELECT *, CASE WHEN abs(hp) < 1e-12 THEN 0 ELSE hp END AS h1, CASE WHEN abs(ht) < 1e-12 THEN 0 ELSE ht END AS h2, CASE WHEN abs(mi) < 1e-12 THEN 0 ELSE mi END AS m FROM raw),
hc AS (SELECT *, CASE WHEN h2 = 0 THEN 1 ELSE m / h2 END AS hom, CASE WHEN h1 = 0 THEN 1 ELSE m / h1 END AS com FROM flat),
scores AS (SELECT {by}, n::BIGINT AS n, round(CASE WHEN mx = ex THEN (idx = ex)::INT ELSE (idx - ex) / (mx - ex) END, 6) AS ari, round(CASE WHEN h1 + h2 = 0 THEN 0 ELSE m / ((h1 + h2) / 2) END, 6) AS nmi,
  round(CASE WHEN hom + com = 0 THEN 0 ELSE 2 * hom * com / (hom + com) END, 6) AS v_measure, round(tops / n, 6) AS purity FROM hc)"""


DIFFS = f"""{duck('pairs')},
diffs AS (SELECT id, 'diff --git a/T.java b/T.java' || chr(10) || 'index 1..2' || chr(10) || '--- a/T.java' || chr(10) || '+++ b/T.java' || chr(10) || '@@ -2,3 +2,3 @@' || chr(10) || ' class T {{' || chr(10) || '-' || truth || chr(10) || '+' || generated || chr(10) || '+  // new  ' || chr(10) || ' }}' AS diff,
  'package p;' || chr(10) || 'class T {{' || chr(10) || generated || chr(10) || '  // new  ' || chr(10) || '}}' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' AS code FROM pairs)"""
_NO_HEADER = "NOT (starts_with(x, '@@') OR starts_with(x, '---') OR starts_with(x, '+++') OR starts_with(x, 'diff --git') OR starts_with(x, 'index '))"
ADDED = f"{_NO_HEADER} AND starts_with(x, '+')"
REMOVED = f"{_NO_HEADER} AND starts_with(x, '-')"
CONTEXT = f"{_NO_HEADER} AND (starts_with(x, '+') OR starts_with(x, ' '))"
CHANGED = f"{_NO_HEADER} AND (starts_with(x, '+') OR starts_with(x, '-'))"


def lines_with(condition: str, cut: bool) -> str:
    shown = "substr(x, 2)" if cut else "rtrim(x)"
    return f"array_to_string(list_transform(list_filter(string_split(diff, chr(10)), lambda x: {condition}), lambda x: {shown}), chr(10))"


BLEU = f"""{duck('pairs')},
tok AS (SELECT id, regexp_extract_all(generated, '{TOKEN}') AS g, regexp_extract_all(truth, '{TOKEN}') AS t FROM pairs),
ord AS (SELECT unnest([1, 2, 3, 4]) AS k),
gg AS (SELECT id, k, g[i:i + k - 1] AS gram, count(*) AS c FROM (SELECT id, k, g, unnest(range(1, len(g) - k + 2)) AS i FROM tok, ord) GROUP BY ALL),
tt AS (SELECT id, k, t[i:i + k - 1] AS gram, count(*) AS c FROM (SELECT id, k, t, unnest(range(1, len(t) - k + 2)) AS i FROM tok, ord) GROUP BY ALL),
pk AS (SELECT id, k, sum(least(gg.c, coalesce(tt.c, 0))) AS hit, sum(gg.c) AS n FROM gg LEFT JOIN tt USING (id, k, gram) GROUP BY id, k),
lg AS (SELECT id, count(*) FILTER (hit > 0) AS orders, sum(CASE WHEN hit > 0 THEN ln(hit / n) END) AS logs FROM pk GROUP BY id),
bleu AS (SELECT id, CASE WHEN orders = 4 THEN least(1, CASE WHEN len(g) < len(t) THEN exp(1 - len(t) / len(g)) ELSE 1 END * exp(logs / 4)) ELSE 0 END AS bleu FROM lg JOIN tok USING (id))"""


def repairs(generated: str, truth: str = "truth") -> str:
    """BLEU and its companions of pairs whose sides are given by expressions."""
    own = f"base AS ({duck('pairs').removeprefix('pairs AS (').removesuffix(')')}), pairs AS (SELECT id, {generated} AS generated, {truth} AS truth FROM base)"
    scores = "sim AS (SELECT id, 1 - levenshtein(g, t)::DOUBLE / greatest(length(g), length(t)) AS edit FROM (SELECT id, replace(generated, chr(10) || ' ', chr(10)) AS g, truth AS t FROM pairs))"
    return f"""WITH {BLEU.replace(duck('pairs'), own)}, {KEYWORDS}, {scores}
SELECT id, round(bleu, 6) AS bleu, round(0.5 * bleu + 0.25 * keyword + 0.25 * structure, 6) AS codebleu, round(edit, 6) AS edit, generated = truth AS exact, TRUE AS has_truth FROM bleu JOIN kw USING (id) JOIN sim USING (id) JOIN pairs USING (id)"""


_KW = "[" + ", ".join(f"'{w}'" for w in code.JAVA_WORDS) + "]"
_BR = "regexp_replace({}, '[^{{}}()\\[\\]]', '', 'g')"
KEYWORDS = f"""kws AS (SELECT id, list_intersect(list_distinct(g), {_KW}) AS a, list_intersect(list_distinct(t), {_KW}) AS b FROM tok),
br AS (SELECT id, {_BR.format('generated')} AS x, {_BR.format('truth')} AS y FROM pairs),
kw AS (SELECT id, CASE WHEN len(b) = 0 THEN CASE WHEN len(a) = 0 THEN 1 ELSE 0.5 END ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS keyword,
  1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) AS structure FROM kws JOIN br USING (id))"""

REPLIES = """base AS (SELECT conv_id, turn, coalesce(conv_id, 0) * 7 + coalesce(turn, 0) AS k FROM conversations),
parsed AS (SELECT conv_id, turn, greatest(1, least(5, k % 9)) AS score, ['Yes', 'No', 'Partial', 'Partial'][k % 4 + 1] AS correctness,
  CASE WHEN k % 12 >= 10 THEN 1 ELSE greatest(1, least(3, k % 12)) END AS specificity, ['Networking', 'Timing', 'Other'][k % 3 + 1] AS category,
  ['Yes', 'No', 'Partial', 'Yes'][k % 4 + 1] AS verdict, ['High', 'Low', 'Medium'][k % 3 + 1] AS confidence FROM base)"""

PRF = """lab AS (SELECT DISTINCT unnest([actual, predicted]) AS category FROM scored),
cnt AS (SELECT category, (SELECT count(*) FROM scored WHERE actual = category) AS support, (SELECT count(*) FROM scored WHERE predicted = category) AS pred, (SELECT count(*) FROM scored WHERE actual = category AND predicted = category) AS hit FROM lab),
pr0 AS (SELECT *, CASE WHEN pred > 0 THEN hit / pred ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM cnt),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr0)"""

DATASET_STATS = f"""WITH {FEATURES}, cl AS (SELECT project, true_label, count(*) AS size, count(source) AS s, count(trace) AS tr FROM feat GROUP BY ALL)
SELECT count(*) AS clusters, count(DISTINCT project) AS projects, sum(size)::BIGINT AS tests, min(size) AS smallest, max(size) AS largest, round(avg(size), 6) AS mean_size, round(sum(s) / sum(size), 6) AS source_ratio, round(sum(tr) / sum(size), 6) AS trace_ratio FROM cl"""

PRICES = "prices(model, a, b) AS (VALUES " + ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in _PRICES.items()) + ")"


def shared_cause(text: str) -> str:
    return _words(text, cascade.SHARED_CAUSE_WORDS)
