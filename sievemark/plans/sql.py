"""Pieces of DuckDB SQL that say the same as the library's expressions."""

from __future__ import annotations

from sievemark.functions import lists as L


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def scored(values) -> str:
    return "[" + ", ".join(f"{{'p': {text(p)}, 'c': {float(c)}::DOUBLE}}" for p, c in values) + "]"


def hits(values, of: str = "lower(t)") -> str:
    return f"list_filter({names(values)}, lambda p: contains({of}, p))"


def scored_hits(values, of: str = "lower(t)") -> str:
    return f"list_filter({scored(values)}, lambda x: contains({of}, x.p))"


def any_hit(values, of: str = "lower(t)") -> str:
    return f"len({hits(values, of)}) > 0"


def peak(found: str) -> str:
    return f"coalesce(list_max(list_transform({found}, lambda x: x.c)), 0.0::DOUBLE)"


def summed(found: str) -> str:
    return f"coalesce(list_sum(list_transform({found}, lambda x: x.c)), 0.0::DOUBLE)"


#: `probed`: documents with the sentences of lists.PROBES added by doc_id.
PROBED = f"probed AS (SELECT doc_id, lang, text || ' ' || ({names(L.PROBES)})[doc_id % {len(L.PROBES)} + 1] AS t FROM documents)"


def over_probed(select: str, more: str = "") -> str:
    return f"WITH {PROBED}{more} {select}"


def words(of: str = "t") -> str:
    return f"list_filter(string_split_regex({of}, '\\s+'), lambda w: w <> '')"


def matches(pattern: str, of: str = "t") -> str:
    """All matches; RE2's own \\b is ASCII."""
    return f"regexp_extract_all({of}, {text(pattern)})"


def inline_flags(pattern: str) -> str:
    return pattern.replace("(?i:", "(?i)(?:", 1) if pattern.startswith("(?i:") else pattern


def spans(parts: list[tuple[str, str, float, str]], conditions: dict[str, str] | None = None) -> str:
    """(doc_id, rank, i, kind, c, m, a, b): all matches with their places in characters; conditions by kind are about m."""
    each = []
    for rank, (kind, pattern, confidence, _) in enumerate(parts):
        p = text(inline_flags(pattern))
        a = "coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0)"
        one = f"SELECT doc_id, {rank} AS rank, i, {text(kind)} AS kind, {float(confidence)}::DOUBLE AS c, g[i] AS m, ({a})::BIGINT AS a FROM (SELECT doc_id, g, s, unnest(range(1, len(g) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS g, string_split_regex(t, {p}) AS s FROM probed))"
        if conditions and kind in conditions:
            one = f"SELECT * FROM ({one}) WHERE {conditions[kind]}"
        each.append(one)
    return f"(SELECT *, a + length(m) AS b FROM ({' UNION ALL '.join(each)}))"


def surest(found: str) -> str:
    """CTEs, of which `kept` (doc_id, kind, m, a, b) has the spans that stay where of overlapping ones the surer does."""
    return f"""x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, rank, i) AS k FROM {found}),
s AS (SELECT doc_id, k, a, b, c, kind, m, false AS closes, a AS pa, b AS pb, kind AS pk, m AS pm FROM x WHERE k = 1
UNION ALL SELECT doc_id, k, CASE WHEN keep THEN a ELSE na END, CASE WHEN keep THEN b ELSE nb END, CASE WHEN keep THEN c ELSE nc END, CASE WHEN keep THEN kind ELSE nk END, CASE WHEN keep THEN m ELSE nm END, NOT o, a, b, kind, m FROM (SELECT *, o AND nc <= c AS keep FROM (SELECT s.doc_id, n.k, s.a, s.b, s.c, s.kind, s.m, n.a AS na, n.b AS nb, n.c AS nc, n.kind AS nk, n.m AS nm, n.a < s.b AS o FROM s JOIN x n ON n.doc_id = s.doc_id AND n.k = s.k + 1))),
kept AS (SELECT doc_id, pk AS kind, pm AS m, pa AS a, pb AS b FROM s WHERE closes UNION ALL SELECT doc_id, kind, m, a, b FROM s JOIN (SELECT doc_id, max(k) AS k FROM x GROUP BY doc_id) USING (doc_id, k))"""


def spliced(replacement: str) -> str:
    """(doc_id, t): probed texts with the kept spans replaced."""
    return f"(SELECT doc_id, coalesce(string_agg(substr(t, (before + 1)::BIGINT, (a - before)::BIGINT) || {replacement}, '' ORDER BY a), '') || substr(any_value(t), (coalesce(max(b), 0) + 1)::BIGINT) AS t FROM (SELECT doc_id, t, kind, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, row_number() OVER (PARTITION BY doc_id, kind ORDER BY a) AS number FROM probed JOIN kept USING (doc_id)) GROUP BY doc_id)"
