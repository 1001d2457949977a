"""op8_pii_disclosure in DuckDB's SQL: base spans by patterns, masked texts, and words by their smoothed mutual information with a value."""

from __future__ import annotations

#: The patterns of the kinds, in the order of results.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_D = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda j: CAST(substr({_D}, length({_D}) + 1 - CAST(j AS INT), 1) AS INT) * (1 + (j + 1) % 2) - CASE WHEN j % 2 = 0 AND CAST(substr({_D}, length({_D}) + 1 - CAST(j AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END)) % 10 = 0"
VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 256) > 255)) = 0",
    "card": f"length({_D}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_D}) BETWEEN 8 AND 15",
}


def found(src: str, text: str, pattern: str, kind: str) -> str:
    """Rows r, kind, e (end), v of all matches in the column text of src."""
    return f"SELECT r, '{kind}' AS kind, sum(length(gap) + length(v)) OVER (PARTITION BY r ORDER BY i) AS e, v FROM (SELECT r, i, g[i] AS gap, m[i] AS v FROM (SELECT r, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g FROM {src}), unnest(range(1, len(m) + 1)) AS u(i))"


RUN = r"[\p{L}\p{Nd}]+"


def words(t: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({t}, '{RUN}'), lambda x: lower(x)))"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM (SELECT DISTINCT doc_id, text FROM documents)),
base AS ({' UNION ALL '.join(f"SELECT r, {k} AS o, kind, e - length(v) AS s, e, v FROM ({found('d', 't', PATTERNS[n], n)}) WHERE {VALID[n]}" for k, n in enumerate(PATTERNS))}),
spans AS (SELECT r, list(struct_pack(s := s, e := e)) AS spans FROM base GROUP BY r),
masked AS (SELECT r, array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE WHEN len(list_filter(spans, lambda x: x.s < i AND i <= x.e)) > 0 THEN ' ' ELSE c END), '') AS t FROM d JOIN spans USING (r)),
near AS (SELECT r, unnest({words('t')}) AS term FROM masked),
held AS (SELECT term, count(*) AS n_t FROM (SELECT term FROM near UNION ALL SELECT unnest({words('t')}) FROM d WHERE r NOT IN (SELECT r FROM spans)) GROUP BY term),
holds AS (SELECT DISTINCT r, kind || ':' || lower(v) AS entity FROM base),
ent AS (SELECT entity, CAST(count(*) AS DOUBLE) AS n_e FROM holds GROUP BY entity),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
told AS (SELECT entity, term FROM holds JOIN near USING (r) JOIN ent USING (entity) JOIN held USING (term), total GROUP BY entity, term, n_e, n_t, n
         HAVING ln((count(*) + 0.1::DOUBLE * n_e / n) / (n_t + 0.1::DOUBLE) * n / n_e) >= ln(n / n_e) / 1.25::DOUBLE),
hide AS (SELECT DISTINCT r, term FROM told JOIN holds USING (entity) JOIN near USING (r, term)),
terms AS (SELECT r, 4 AS o, kind, e - length(v) AS s, e, v FROM ({found('masked', 't', RUN, 'term')}) AS f WHERE EXISTS (SELECT 1 FROM hide h WHERE h.r = f.r AND h.term = lower(f.v))),
every AS (SELECT * FROM base UNION ALL SELECT * FROM terms),
named AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in (*PATTERNS, 'term'))},
          coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < 4), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans FROM every GROUP BY r)
SELECT x.doc_id, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n in (*PATTERNS, 'term'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents x JOIN d ON x.doc_id IS NOT DISTINCT FROM d.doc_id AND coalesce(x.text, '') = d.t LEFT JOIN named USING (r)"""
