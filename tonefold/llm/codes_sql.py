"""DuckDB counterpart of codes.compressed(): its rounds written out one after another."""

from __future__ import annotations


def compressed(table: str = "embeddings", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    out = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM {table}
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT row, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x FROM v, range({parts}) AS r(part))",
        f"book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {entries})",
    ]
    for k in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        out.append(f"at{k} AS MATERIALIZED (SELECT row, part, any_value(p.x) AS x, min({{'d': CAST({far} AS BIGINT), 'e': entry}}) AS best FROM p JOIN book{k} b USING (part) GROUP BY row, part)")
        if k < rounds:
            out.append(f"sum{k} AS (SELECT part, best.e AS entry, pos, sum(x[pos]) AS s, count(*) AS n FROM at{k}, unnest(range(1, len(x) + 1)) AS u(pos) GROUP BY ALL)")
            out.append(f"mean{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM sum{k} GROUP BY part, entry)")
            out.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))")
    out += [
        f"coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM at{rounds} GROUP BY row)",
        f"named AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})",
    ]
    return f"""WITH {", ".join(out)}
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (row), named"""
