"""The operators over their whole tables, with production parameters; and DuckDB counterparts where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, codes, codes_sql, decon, embed, lines, ngram, pii, pii_sql, quality, substring, tokens, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _read(spark, sf_dir, "pages")).drop("url", "payload")


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near(_read(spark, sf_dir, "embeddings"))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.components(_read(spark, sf_dir, "documents"), words=3, percent=90)


def op7_substring_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_read(spark, sf_dir, "documents"))


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.counted(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 50256)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.digests(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_read(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_zip": op1_warc_zip,
    "op2_bpe_automaton": op2_bpe_automaton,
    "op3_embedding_itq": op3_embedding_itq,
    "op4_quality_crf": op4_quality_crf,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_substring_chaining": op7_substring_chaining,
    "op8_pii_disclosure": op8_pii_disclosure,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_url_filters": op12_url_filters,
    "op13_vector_codes": op13_vector_codes,
}

_BASE32 = """list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
        (((instr('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS INT), 1)) - 1) * 16
          + instr('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS INT), 1)) - 1) >> CAST(3 - 5 * i % 4 AS INT)) % 32 + 1 AS INT), 1)), 'string_agg', '')"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op8_pii_disclosure": pii_sql.SQL,
    "op13_vector_codes": codes_sql.compressed(),
    "op5_line_dedup": rf"""
        WITH l AS (SELECT doc_id, i AS item, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)),
        w AS (SELECT *, regexp_extract_all({_LOWER.format("line")}, '[^\x20\x09-\x0D]+') AS w FROM l),
        s AS (SELECT *, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        t AS (SELECT doc_id, item, len(s) AS n, unnest(s) AS t FROM s),
        inter AS (SELECT a.doc_id, a.item, a.n, b.n AS m, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.item < a.item)
                  GROUP BY a.doc_id, a.item, a.n, b.doc_id, b.item, b.n),
        gone AS (SELECT DISTINCT doc_id, item, true AS g FROM inter WHERE 100 * k >= 80 * (n + m - k)),
        per AS (SELECT doc_id, count(*) AS n_lines, count(g) AS n_removed, count(*) FILTER (g IS NULL AND len(w) > 0) AS n_left,
                       coalesce(string_agg(line, chr(10) ORDER BY item) FILTER (g IS NULL), '') AS kept FROM s LEFT JOIN gone USING (doc_id, item) GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN kept END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_left, 0) AS n_left
        FROM documents d LEFT JOIN per USING (doc_id)""",
    "op10_decontamination": rf"""
        WITH w AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        win AS (SELECT row_number() OVER () AS r, * FROM sized),
        wpos AS (SELECT r, item_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS k FROM win, unnest(range(1, len(w) - n + 2)) AS u(j)),
        sizes AS (SELECT DISTINCT n FROM sized),
        placed AS (SELECT doc_id, w, n FROM w, sizes WHERE len(w) >= n),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM placed, unnest(range(1, len(w) - n + 2)) AS u(i)),
        h AS (SELECT doc_id, i, n, r, j, item_id FROM dw JOIN wpos USING (n, k)),
        pos AS (SELECT doc_id, count(DISTINCT i + d) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM h) AS p, unnest(range(n)) AS v(d) GROUP BY doc_id),
        named AS (SELECT doc_id, count(x) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id),
        runs AS (SELECT doc_id, count(*) + n - 1 AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS run FROM h) GROUP BY doc_id, r, n, i - j, run),
        far AS (SELECT doc_id, max(len) AS longest FROM runs GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
        FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN far USING (doc_id)""",
    "op1_warc_zip": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages),
             d AS (SELECT *, sha1(html) AS h FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM d""",
    "op3_embedding_itq": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
        top AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
        SELECT vec_id, (SELECT count(*) FROM links WHERE links.u = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN top ON u = vec_id""",
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
        n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
        t AS (SELECT doc_id, unnest(s) AS t FROM s),
        inter AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT u, v FROM inter JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 90 * (x.n_shingles + y.n_shingles - k)),
        reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
        SELECT n.doc_id, n_shingles, min(v) AS component_id FROM n JOIN reach ON u = n.doc_id GROUP BY ALL""",
}
