"""DuckDB SQL for what SQL can express of the corpus operators, over whole tables."""

from __future__ import annotations

TEXTS = "d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)"


def spans_sql(kinds: dict[str, tuple[str, int, str]]) -> str:
    """Base spans of the kinds, in the order given: pattern, group that a check looks at, and the check on m (the match) and b (the group)."""
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {g}) AS bs, string_split_regex(t, '{p}') AS gs FROM d" for k, (p, g, _) in enumerate(kinds.values()))
    good = " OR ".join(f"kind = {k} AND {check}" for k, (_, _, check) in enumerate(kinds.values()))
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(kinds)) + " END"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{x}" for k, x in enumerate(kinds))
    return f"""WITH {TEXTS}, every AS ({each}), one AS (SELECT doc_id, kind, unnest(ms) AS m, unnest(bs) AS b, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM every),
placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM one),
good AS (SELECT doc_id, kind, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE {good}),
found AS (SELECT doc_id, {counts}, string_agg({name} || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM good GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in kinds)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN found ON d.doc_id = found.doc_id"""


# The patterns of the contracts.
SECRETS = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, "length(b) >= 6"),
    "access": ("AKIA[A-Z0-9]+", 0, "length(m) >= 20"),
    "hex": ("[0-9a-f]+", 0, "length(m) >= 24"),
}
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 0 THEN CAST({DIGITS}[i] AS INTEGER) ELSE CAST({DIGITS}[i] AS INTEGER) * 2 - CASE WHEN CAST({DIGITS}[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
PERSONAL = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", 0, "true"),
    "ip": ("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", 0, "list_bool_and(list_transform(string_split(m, '.'), lambda x: CAST(x AS DOUBLE) <= 255))"),
    "card": ("[0-9]([\\x20-]?[0-9])+", 0, f"length({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}"),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", 0, f"length({DIGITS}) BETWEEN 10 AND 15"),
}

EXACT = rf"""WITH {TEXTS}, n AS (SELECT doc_id, t, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS k FROM d), o AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM o"""

# a source is capped exactly if three times its size is below its weight times the level; by rising size per weight the first that isn't gives the level
TARGETS = rf"""WITH {TEXTS}, z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM z GROUP BY source),
c AS (SELECT *, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(3 * source_size) OVER before, 0) AS rest, sum(w) OVER after AS left_w FROM s WINDOW before AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT coalesce(arg_min(rest / left_w, 3.0 * source_size / w) FILTER (3.0 * source_size >= w * (rest / left_w)), 0) AS level FROM c)
SELECT doc_id, size, source_size, least(source_size * 3.0::DOUBLE, w * level) AS target FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source, l"""

DEVIATIONS = """WITH e AS (SELECT vec_id, embedding AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, list_transform(v, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM e), f AS (SELECT DISTINCT x FROM x), n AS (SELECT count(*) AS n FROM f),
s AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, CAST(sum(c) AS BIGINT) AS s FROM (SELECT unnest(x) AS c, unnest(range(len(x))) AS i FROM f) GROUP BY i))
SELECT vec_id, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: CAST((n * x[i] - s[i]) AS HUGEINT) * (n * x[i] - s[i]))) AS BIGINT) AS deviation FROM x, n, s"""

DIVERGENCE = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3), v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term), g AS (SELECT lang, source, coalesce(max(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.total + v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (v.total + v) AS q FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY lang, a.source, b.source),
u AS (SELECT lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b USING (lang) LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source WHERE a.source <> b.source
UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200"""

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS five FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
h AS (SELECT r, i FROM g SEMI JOIN (SELECT r, five FROM g GROUP BY r, five HAVING count(*) > 1) USING (r, five)), n AS (SELECT r, count(DISTINCT i + j) AS n FROM h, range(5) s(j) GROUP BY r),
o AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN n USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o"""

SQL = {"op6_exact_duplicates": EXACT, "op12_source_divergence": DIVERGENCE, "secret_base_spans": spans_sql(SECRETS), "personal_base_spans": spans_sql(PERSONAL), "mix_source_targets": TARGETS, "embedding_deviations": DEVIATIONS, "quality_base_counts": QUALITY}
