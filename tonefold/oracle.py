"""DuckDB counterparts of the engine's views and queries: the same results by another engine's SQL."""

from __future__ import annotations

from tonefold import lexicon as L
from tonefold.functions.lexical import span_pattern
from tonefold.views import PLANTED


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:  # noqa: ANN001
    return "[" + ", ".join(map(_q, words)) + "]"


def _any(c: str, words) -> str:  # noqa: ANN001
    return "(" + " OR ".join(f"contains(lower({c}), {_q(w)})" for w in words) + ")"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def clean(c: str) -> str:
    c = f"translate({c}, '’‘“”–—' || chr(160), '''''\"\"-- ')"
    c = rf"regexp_replace({c}, '[^\S\n]', ' ', 'g')"
    c = rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(f"regexp_replace({c}, ' {{2,}}', ' ', 'g')")


def tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"


def share(toks: str, *categories: str) -> str:
    hits = " + ".join(f"len(list_filter({toks}, lambda w: list_contains({_list(L.FINANCE[k])}, w)))" for k in categories)
    return f"coalesce(({hits}) / nullif(CAST(len({toks}) AS DOUBLE), 0), 0.0)"


def phrases(c: str) -> str:
    cleaned = rf"list_transform({words(c)}, lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g'))"
    parts = [f"list_filter({cleaned}, lambda w: list_contains({_list(L.hedge_words())}, w))"]
    parts += [f"list_transform(regexp_extract_all({c}, {_q('(?i)' + p)}), lambda h: {strip('lower(h)')})" for p in L.HEDGE_PATTERNS]
    return "list_concat(" + ", ".join(parts) + ")"


def distinct_in_order(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def spans_found(c: str) -> str:
    """Separators are doubled, so that each span has its own on either side."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    doubled = rf"regexp_replace(lower({c}), '({edge})', '\1\1', 'g')"
    return f"regexp_extract_all({doubled}, {_q(f'(?:^|{edge})({span_pattern()})(?:$|{edge})')}, 1)"


def span_count(c: str) -> str:
    return f"len({spans_found(c)})"


def date8(c: str) -> str:
    return f"strftime({c}, '%Y%m%d')"


def normal_date(c: str) -> str:
    tried = ", ".join(f"CASE WHEN regexp_full_match({c}, '{shape}') THEN strftime(try_strptime({c}, '{fmt}'), '%Y%m%d') END" for shape, fmt in ((r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), (r"\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"), (r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"), (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"), (r"\d{8}", "%Y%m%d")))
    return rf"coalesce({tried}, CASE WHEN length(regexp_replace({c}, '\D', '', 'g')) = 8 THEN regexp_replace({c}, '\D', '', 'g') END, '19000101')"


def _planted(c: str) -> str:
    for a, b in PLANTED:
        c = f"replace({c}, {_q(a)}, {_q(b)})"
    return c


def role(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(c, w)} THEN '{r}'" for r, w in L.ROLE_KEYWORDS.items()) + " ELSE 'other' END"


def confidence(cert: str, spec: str, hedge: str, delta: str) -> str:
    w = L.CONFIDENCE
    return f"2 * ({w['certainty']}::DOUBLE * least(1.0, {cert} * 5) + {w['specificity']}::DOUBLE * least(1.0, {spec} * 2) + {w['hedge']}::DOUBLE * (1 - least(1.0, {hedge} * 10)) + {w['tone']}::DOUBLE * greatest(0.0, least(1.0, ({delta} + 1) / 2))) - 1"


HEADER = _q(L.HEADER)
SIGNALS, RETURNS = L.SIGNALS, tuple(f"ret_{k}d" for k in L.HORIZONS)
_GRID = " UNION ALL ".join(
    f"SELECT {(i * len(RETURNS) + j) * 2 + k} AS config, '{s}' AS signal_column, '{h}' AS holding_period, '{'Inverse_' if k else ''}{s}' AS actual_signal_used, ticker, call_date, {'-' if k else ''}CAST({s} AS DOUBLE) AS s, {h} AS r FROM trade WHERE {s} IS NOT NULL AND {h} IS NOT NULL"
    for i, s in enumerate(SIGNALS)
    for j, h in enumerate(RETURNS)
    for k in (0, 1)
)


_DAYS = "CAST(regexp_extract(holding_period, 'ret_(\\d+)d', 1) AS INT)"


def ratio(x: str, days: str = f"any_value({_DAYS})") -> str:
    return f"coalesce(avg({x}) / CASE WHEN stddev_samp({x}) > 1e-15 THEN stddev_samp({x}) END * sqrt(252.0 / {days}), 0.0)"


METRICS = f"""count(*) AS total_trades, count(*) FILTER (position = 1) AS long_trades, count(*) FILTER (position = -1) AS short_trades,
    avg(CAST(tr > 0 AS DOUBLE)) AS win_rate, avg(CAST(tr <= 0 AS DOUBLE)) AS false_positive_rate, avg(tr) AS mean_trade_return,
    product(1 + tr) - 1 AS cumulative_return, {ratio('tr')} AS annualized_sharpe_ratio, {ratio('active')} AS information_ratio"""
POSITION = "CASE WHEN s <= q_short THEN -1 WHEN s >= q_long THEN 1 ELSE 0 END"

BASE = rf"""
WITH raw AS (
    SELECT 'TK' || (conv_id % 37) AS ticker, {date8("DATE '2019-01-01' + CAST(conv_id * 13 % 1825 AS INT)")} AS date,
           string_agg(t, chr(10) ORDER BY turn) AS raw_text, 'set' || (conv_id % 3) || '/part' AS source, conv_id AS dataset_row_id
    FROM (SELECT conv_id, turn,
            CASE turn WHEN 0 THEN 'Good morning; prepared remarks of 2024 follow.' || chr(10) WHEN 2 THEN 'We will now begin the question-and-answer session, part 2.' || chr(10) ELSE '' END
            || CASE WHEN role = 'user' THEN 'Cy Poe: Analyst' WHEN role = 'system' THEN 'Operator:' WHEN conv_id % 2 = 0 THEN 'Ann Lee: Chief Executive Officer' ELSE 'Bo Roe: Chief Financial Officer' END
            || chr(10) || {_planted("coalesce(text, '')")}
            || CASE WHEN turn = 0 THEN chr(10) || 'Copyright 2024 by the speakers' WHEN (turn + conv_id) % 3 = 1 THEN chr(10) || 'Revenue grew ' || (conv_id % 17) || '% to $2.3B,  “ahead of plan” – again.' ELSE '' END AS t
          FROM conversations) GROUP BY conv_id),
split_ AS (SELECT *, string_split({clean('raw_text')}, chr(10)) AS l FROM raw),
line AS (SELECT ticker, date, i AS line_no, l[i + 1] AS line, {strip('l[i + 1]')} AS s FROM split_, unnest(range(len(l))) AS u(i)),
flag AS (SELECT ticker, date, line_no, line, s, length(s) < 3 OR regexp_matches(s, {_q('(?i)' + '|'.join(L.BOILERPLATE))}) AS boilerplate FROM line),
mark AS (SELECT *, CASE WHEN {_any('line', L.QA_MARKERS)} THEN 'qa' WHEN {_any('line', L.REMARKS_MARKERS)} THEN 'remarks' END AS marker, regexp_matches(s, {HEADER}) AS is_header FROM flag WHERE NOT boilerplate),
head AS (SELECT *, CASE WHEN is_header THEN {strip(f"regexp_extract(s, {HEADER}, 1)")} END AS speaker_name, CASE WHEN is_header THEN {strip(f"regexp_extract(s, {HEADER}, 2)")} END AS hint FROM mark),
rol AS (SELECT *, CASE WHEN is_header THEN {role("(speaker_name || ' ' || hint)")} END AS speaker_role FROM head),
cue AS (SELECT *, CASE WHEN speaker_role = 'analyst' THEN 'qa' WHEN speaker_role IN ('ceo', 'cfo') THEN 'remarks' END AS cue FROM rol),
state AS (SELECT *,
        coalesce(last_value(marker IGNORE NULLS) OVER here, first_value(cue IGNORE NULLS) OVER here, 'unknown') AS section_after,
        coalesce(last_value(marker IGNORE NULLS) OVER here, first_value(cue IGNORE NULLS) OVER before, 'unknown') AS section_flush,
        sum(CAST(is_header AS INT)) OVER here AS block
    FROM cue WINDOW here AS (PARTITION BY ticker, date ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    before AS (PARTITION BY ticker, date ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per AS (SELECT ticker, date, block, arg_min(section_flush, line_no) AS opened_as, arg_max(section_after, line_no) AS closed_as,
        coalesce(max(speaker_name), 'unknown') AS speaker_name, coalesce(max(speaker_role), 'other') AS speaker_role,
        {strip("coalesce(string_agg(s, ' ' ORDER BY line_no) FILTER (NOT is_header), '')")} AS text FROM state GROUP BY ALL),
blk AS (SELECT * FROM (SELECT ticker, date, block, speaker_name, speaker_role, coalesce(lead(opened_as) OVER (PARTITION BY ticker, date ORDER BY block), closed_as) AS section, text FROM per) WHERE text <> ''),
cut AS (SELECT *, string_split(regexp_replace(text, '([.!?]+\s+)([A-Z])', '\1' || chr(31) || '\2', 'g'), chr(31)) AS ps FROM blk WHERE length(text) >= 10),
piece AS (SELECT ticker, date, block, speaker_name, speaker_role, section, i, i = len(ps) AS final, ps[i] AS p, regexp_extract(ps[i], '[.!?]+\s+$') AS run FROM cut, unnest(range(1, len(ps) + 1)) AS u(i)),
body AS (SELECT *, substr(p, 1, length(p) - length(run)) AS b, regexp_extract(run, '^[.!?]+') AS pun FROM piece),
valid AS (SELECT *, NOT regexp_matches(b, '[0-9A-Z]$') AND NOT regexp_matches(b, '\.[\p{{L}}\p{{N}}_]$') AS ok1 FROM body),
ends AS (SELECT *, NOT final AND (ok1 OR length(pun) >= 2) AS ok FROM valid),
part AS (SELECT *, CASE WHEN NOT ok THEN p WHEN ok1 THEN b ELSE b || left(pun, 1) END AS t, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY ticker, date, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ends),
glued AS (SELECT ticker, date, block, speaker_name, speaker_role, section, g, {strip("string_agg(t, '' ORDER BY i)")} AS text FROM part GROUP BY ALL),
sent AS (SELECT row_number() OVER (PARTITION BY ticker, date ORDER BY block, g) - 1 AS sentence_id, ticker, date, speaker_role, speaker_name, section, text, len({words('text')}) AS word_count
    FROM glued WHERE length(text) >= 15 AND len({words('text')}) >= 3),
tok AS (SELECT *, {tokens('text')} AS toks FROM sent),
net AS (SELECT *, {share('toks', 'positive')} AS pos, {share('toks', 'negative')} AS neg, {share('toks', 'strong_modal')} AS certainty, {span_count('text')} AS hedges, regexp_matches(text, '\d') AS numeric FROM tok),
sco AS (SELECT *, CASE WHEN (pos - neg) > 0.01 THEN 0 WHEN (pos - neg) < -0.01 THEN 1 ELSE 2 END AS label FROM net),
rated AS (SELECT *, CASE label WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS score FROM sco),
agg AS (SELECT ticker, date AS call_date,
        coalesce(avg(score) FILTER (section = 'remarks' AND speaker_role IN ('ceo', 'cfo')), 0.0) AS remarks_sentiment,
        coalesce(avg(score) FILTER (section = 'qa' AND speaker_role IN ('ceo', 'cfo')), 0.0) AS qa_sentiment,
        coalesce(avg(score) FILTER (section = 'qa' AND speaker_role = 'analyst'), 0.0) AS analyst,
        coalesce(avg(score) FILTER (section = 'remarks' AND speaker_role = 'ceo') - avg(score) FILTER (section = 'remarks' AND speaker_role = 'cfo'), 0.0) AS ceo_cfo_divergence,
        coalesce(sum(hedges) / nullif(CAST(sum(word_count) AS DOUBLE), 0), 0.0) AS hedge_density,
        coalesce(avg(certainty), 0.0) AS certainty, coalesce(avg(CAST(numeric AS DOUBLE)), 0.0) AS specificity, count(*) FILTER (section = 'qa') > 0 AS has_qa
    FROM rated GROUP BY ALL),
sig AS (SELECT ticker, call_date, remarks_sentiment, qa_sentiment, {confidence('certainty', 'specificity', 'hedge_density', '(qa_sentiment - analyst)')} AS confidence_score,
        hedge_density, ceo_cfo_divergence, qa_sentiment - analyst AS qa_pushback_signal, has_qa, certainty, specificity FROM agg),
bar AS (SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS date, arg_min(coalesce(value, 0) + 10000.0::DOUBLE, (ts, event_id)) AS open, max(coalesce(value, 0) + 10000.0::DOUBLE) AS high, min(coalesce(value, 0) + 10000.0::DOUBLE) AS low,
        arg_max(coalesce(value, 0) + 10000.0::DOUBLE, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL),
ahead AS (SELECT *, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5 FROM bar WINDOW w AS (PARTITION BY ticker ORDER BY date)),
calls AS (SELECT DISTINCT 'U' || user_id AS ticker, CAST(ts AS DATE) - 1 AS call_date FROM events WHERE event_type = 'signup'),
entry AS (SELECT c.ticker, c.call_date, b.date AS entry_date, b.close AS entry_price, c1 / nullif(b.close, 0) - 1 AS ret_1d, c3 / nullif(b.close, 0) - 1 AS ret_3d, c5 / nullif(b.close, 0) - 1 AS ret_5d
    FROM calls c ASOF JOIN ahead b ON c.ticker = b.ticker AND c.call_date <= b.date),
ret AS (SELECT ticker, {date8('call_date')} AS call_date, ret_1d, ret_3d, ret_5d FROM entry),
stand AS (SELECT ticker, {date8('date - 1')} AS call_date, close - open AS confidence_score, high - low AS qa_sentiment, CAST(volume AS DOUBLE) AS hedge_density, open - 10000.0::DOUBLE AS ceo_cfo_divergence FROM bar),
trade AS (SELECT *, strptime(call_date, '%Y%m%d')::DATE AS trade_date FROM stand JOIN ret USING (ticker, call_date)),
grid AS ({_GRID}),
cuts AS (SELECT config, quantile_cont(s, 0.7) AS q_long, quantile_cont(s, 0.3) AS q_short FROM grid GROUP BY ALL),
pos AS (SELECT *, {POSITION} AS position, ({POSITION}) * r AS tr, ({POSITION}) * r - r AS active FROM grid JOIN cuts USING (config)),
res AS (SELECT config, signal_column, holding_period, actual_signal_used, {METRICS} FROM pos WHERE position <> 0 GROUP BY ALL)
"""


def query(select: str, *doubles: str) -> str:
    """The views and a query; doubles are rounded as the engine's queries round theirs."""
    inner = f"{select}"
    if not doubles:
        return BASE + inner
    swaps = ", ".join(f"round({d}, 6) + 0.0::DOUBLE AS {d}" for d in doubles)
    return BASE + f"SELECT * REPLACE ({swaps}) FROM ({inner})"


FIGURES = ("win_rate", "false_positive_rate", "mean_trade_return", "cumulative_return", "annualized_sharpe_ratio", "information_ratio")
SIGNAL_COLUMNS = ("remarks_sentiment", "qa_sentiment", "confidence_score", "hedge_density", "ceo_cfo_divergence", "qa_pushback_signal")
_share_columns = ", ".join(f"{share('toks', k)} AS {k}" for k in L.CATEGORIES)
_DOCS = rf"(SELECT doc_id, lang, {tokens('coalesce(text, chr(32))')} AS toks FROM documents)"

_alpha = "{a}::DOUBLE * (remarks_sentiment + qa_sentiment) / 2 + {b}::DOUBLE * confidence_score - {c}::DOUBLE * least(1.0, hedge_density * 10) + {d}::DOUBLE * qa_pushback_signal".format(a=L.ALPHA["sentiment"], b=L.ALPHA["confidence"], c=L.ALPHA["hedge"], d=L.ALPHA["tone"])
_sectors = "(SELECT DISTINCT 'U' || user_id AS ticker, 'S' || (user_id % 5) AS sector FROM events)"

_BUCKET = "CAST('0x' || substr(md5(doc_id || ':42'), 1, 8) AS BIGINT) % 100"


def _f1(confusion: str) -> str:
    """Accuracy and macro F1 of a table label, predicted, n."""
    per = "SELECT c, sum(tp) AS tp, sum(t) AS t, sum(p) AS p FROM (SELECT label AS c, CASE WHEN label = predicted THEN n ELSE 0 END AS tp, n AS t, 0 AS p FROM cm UNION ALL SELECT predicted, 0, 0, n FROM cm) GROUP BY c"
    return f", cm AS ({confusion}) SELECT CAST(sum(n) AS BIGINT) AS n, round(coalesce(sum(n) FILTER (label = predicted), 0) / CAST(sum(n) AS DOUBLE), 6) AS accuracy, (SELECT round(avg(2.0 * tp / (t + p)), 6) FROM ({per})) AS macro_f1 FROM cm"


#: The density of Student's distribution by Simpson's rule from 0 to |t|.
_STUDENT = """(SELECT 1 - 2 * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * k / 4000, 2) / (n - 2), -(n - 1) / 2.0)) * abs(t) / 12000
    * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) FROM range(4001) AS q(k))"""

SQL: dict[str, str] = {
    "lexicon_scores": query(f"SELECT doc_id, len(toks) AS n_tokens, {_share_columns}, {share('toks', *L.HEDGE_CATEGORIES)} AS lex_hedge_density, {share('toks', 'positive')} - {share('toks', 'negative')} AS sentiment_net FROM {_DOCS}", *L.CATEGORIES, "lex_hedge_density", "sentiment_net"),
    "lexicon_by_lang": query(f"SELECT lang, count(*) AS n_docs, CAST(sum(len(toks)) AS BIGINT) AS n_tokens, avg({share('toks', *L.HEDGE_CATEGORIES)}) AS hedge, avg({share('toks', 'positive')} - {share('toks', 'negative')}) AS net FROM {_DOCS} GROUP BY lang", "hedge", "net"),
    "hedge_phrases": query(f"SELECT ticker, date, sentence_id, array_to_string({distinct_in_order('h')}, '|') AS phrases FROM (SELECT *, {phrases('text')} AS h FROM sent)"),
    "phrase_spans": query(rf"SELECT ticker, date, sentence_id, array_to_string(list_transform({spans_found('text')}, lambda x: regexp_replace(x, '\s+', ' ', 'g')), '|') AS phrases, {span_count('text')} AS n_spans FROM sent"),
    "hedge_span_density": query(f"SELECT ticker, date, CAST(sum(hedges) AS BIGINT) AS spans, CAST(sum(word_count) AS BIGINT) AS n_words, sum(hedges) / CAST(sum(word_count) AS DOUBLE) AS span_hedge_density FROM net GROUP BY ALL", "span_hedge_density"),
    "clean_text": query(f"SELECT ticker, date, {clean('raw_text')} AS text, length(raw_text) - length({clean('raw_text')}) AS n_dropped FROM raw"),
    "boilerplate_filter": query("SELECT ticker, date, count(*) AS n_lines, count(*) FILTER (boilerplate) AS n_boilerplate FROM flag GROUP BY ALL"),
    "html_strip": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    "date_normalize": "WITH d AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 4 THEN strftime(o_orderdate, '%Y%m%d') WHEN 5 THEN 'on ' || strftime(o_orderdate, '%Y.%m.%d') ELSE 'soon' END AS raw FROM orders) "
    + f"SELECT o_orderkey, {normal_date('raw')} AS date, coalesce(try_strptime({normal_date('raw')}, '%Y%m%d')::DATE BETWEEN DATE '2015-01-01' AND DATE '2025-01-01', false) AS valid FROM d",
    "line_explode": query("SELECT ticker, date, line_no, line, boilerplate FROM flag"),
    "section_markers": query("SELECT ticker, date, line_no, marker FROM mark WHERE marker IS NOT NULL"),
    "section_state": query("SELECT ticker, date, line_no, section_after, section_flush, CAST(block AS BIGINT) AS block FROM state"),
    "speaker_headers": query("SELECT ticker, date, line_no, speaker_name, hint, speaker_role FROM rol WHERE is_header"),
    "speaker_blocks": query("SELECT ticker, date, CAST(block AS BIGINT) AS block, speaker_name, speaker_role, section, text FROM blk"),
    "sentences": query("SELECT sentence_id, ticker, date, speaker_role, speaker_name, section, text, word_count FROM sent"),
    "sentence_filter": query("SELECT ticker, date, count(*) AS n_sentences, count(*) FILTER (word_count > 3) AS n_api FROM sent GROUP BY ALL"),
    "role_section_hist": query("SELECT speaker_role, section, count(*) AS n_sentences, CAST(sum(word_count) AS BIGINT) AS n_words FROM sent GROUP BY ALL"),
    "preprocess_stats": query("SELECT count(*) FILTER (NOT short AND n IS NOT NULL) AS processed, count(*) FILTER (short) AS skipped, count(*) FILTER (NOT short AND n IS NULL) AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS sentences, sum(n) / CAST(count(*) FILTER (NOT short AND n IS NOT NULL) AS DOUBLE) AS avg_sentences FROM (SELECT ticker, date, length(raw_text) < 200 AS short FROM raw) LEFT JOIN (SELECT ticker, date, count(*) AS n FROM sent GROUP BY ALL) USING (ticker, date)", "avg_sentences"),
    "collection_stats": query("SELECT count(*) AS total_files, CAST(sum(length(raw_text)) AS BIGINT) AS total_chars, min(length(raw_text)) AS min_text_len, max(length(raw_text)) AS max_text_len, min(date) AS first_date, max(date) AS last_date, count(DISTINCT ticker) AS unique_tickers, (SELECT string_agg(f || '=' || n, ',' ORDER BY f) FROM (SELECT split_part(source, '/', 1) AS f, count(*) AS n FROM raw GROUP BY 1)) AS sources, (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM (SELECT DISTINCT ticker FROM raw ORDER BY ticker LIMIT 20)) AS tickers FROM raw"),
    "call_dates": query("SELECT ticker, count(*) AS n_dates, string_agg(date, ',' ORDER BY date) AS dates FROM (SELECT DISTINCT ticker, date FROM raw) GROUP BY ticker"),
    "domain_tokens": query(r"SELECT ticker, date, sentence_id, array_to_string(regexp_extract_all(text, '\$?\d[\d.,]*[BMK%]?|Q[1-4]|[A-Z]{2,}'), '|') AS found FROM sent"),
    "first_source": query("SELECT ticker, date, source, dataset_row_id FROM raw WHERE source = 'set1/part'"),
    "unite_sources": query("SELECT source, dataset_row_id FROM raw WHERE source IN ('set2/part', 'set0/part') ORDER BY source = 'set0/part', dataset_row_id LIMIT 60"),
    "batch_normalize": query("SELECT ticker, date, dataset_row_id, length(raw_text) AS n_chars FROM (SELECT * FROM raw ORDER BY source, dataset_row_id LIMIT 80) WHERE length(raw_text) > 200"),
    "dedup_keep_first": query("SELECT ticker, source, dataset_row_id FROM raw QUALIFY row_number() OVER (PARTITION BY ticker, source ORDER BY dataset_row_id) = 1"),
    "anti_existing": query("SELECT ticker, date, dataset_row_id FROM raw WHERE NOT (dataset_row_id % 4 = 0 AND length(raw_text) > 1000)"),
    "weak_labels": query("SELECT ticker, date, sentence_id, CAST(label AS BIGINT) AS label, CAST(score AS BIGINT) AS score FROM rated WHERE word_count >= 5"),
    "class_cap": query("SELECT ticker, date, sentence_id, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ticker, date, sentence_id) AS n FROM rated WHERE word_count >= 5) WHERE n <= 50"),
    "macro_f1": query(_f1("SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")),
    "hash_split": f"SELECT doc_id, CASE WHEN {_BUCKET} < 70 THEN 'train' WHEN {_BUCKET} < 85 THEN 'validation' ELSE 'test' END AS part FROM labels",
    "stratified_split": "SELECT doc_id, label, CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.85 THEN 'validation' ELSE 'test' END AS part FROM (SELECT doc_id, quality AS label, percent_rank() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42')) AS s FROM labels)",
    "baseline_evaluation": query(_f1(f"SELECT 1 - quality AS label, CASE WHEN net > 0.01 THEN 0 WHEN net < -0.01 THEN 1 ELSE 2 END AS predicted, count(*) AS n FROM (SELECT doc_id, {share('toks', 'positive')} - {share('toks', 'negative')} AS net FROM {_DOCS}) JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL")),
    "ticker_allow_list": query("SELECT * FROM calls WHERE ticker IN (SELECT 'U' || user_id FROM events WHERE user_id % 3 = 0)"),
    "key_figures": query("SELECT annualized_sharpe_ratio, cumulative_return, win_rate, total_trades, actual_signal_used, holding_period FROM res ORDER BY annualized_sharpe_ratio DESC, config LIMIT 1", "annualized_sharpe_ratio", "cumulative_return", "win_rate"),
    "daily_bars": query("SELECT ticker, date, open, high, low, close, volume FROM bar", "open", "high", "low", "close"),
    "asof_entry": query("SELECT ticker, call_date, entry_date, entry_price FROM entry", "entry_price"),
    "asof_hourly": query("""
        SELECT c.ticker, call_date, date AS entry_date, entry_price, c1 / nullif(entry_price, 0) - 1 AS ret_1d, c3 / nullif(entry_price, 0) - 1 AS ret_3d, c5 / nullif(entry_price, 0) - 1 AS ret_5d
        FROM (SELECT DISTINCT CASE event_type WHEN 'signup' THEN 'view' ELSE 'click' END AS ticker, ts AS call_date FROM events WHERE event_type IN ('signup', 'purchase') AND ts IS NOT NULL) c
        ASOF JOIN (SELECT ticker, date, open AS entry_price, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5 FROM (
            SELECT event_type AS ticker, date_trunc('hour', ts) AS date, arg_min(p, (ts, event_id)) AS open, arg_max(p, (ts, event_id)) AS close
            FROM (SELECT event_type, ts, event_id, coalesce(value, 0.0) + 10000.0 AS p FROM events WHERE ts IS NOT NULL) GROUP BY ALL) WINDOW w AS (PARTITION BY ticker ORDER BY date)) b
        ON c.ticker = b.ticker AND c.call_date <= b.date""", "entry_price", *RETURNS),
    "forward_returns": query("SELECT * FROM ret", *RETURNS),
    "returns_null_share": query("SELECT " + ", ".join(f"avg(CAST(ret_{k}d IS NULL AS DOUBLE)) AS null_{k}d, avg(CAST(abs(ret_{k}d) > 0.6 AS DOUBLE)) AS outlier_{k}d" for k in L.HORIZONS) + " FROM ret", *[f"{n}_{k}d" for k in L.HORIZONS for n in ("null", "outlier")]),
    "price_window": query("SELECT ticker, min(call_date) - 15 AS first_date, max(call_date) + 15 AS last_date FROM calls GROUP BY ticker"),
    "transcript_signals": query(f"SELECT ticker, call_date, {', '.join(SIGNAL_COLUMNS)} FROM sig", *SIGNAL_COLUMNS),
    "confidence_score": query("SELECT ticker, call_date, certainty, specificity, has_qa, confidence_score FROM sig", "certainty", "specificity", "confidence_score"),
    "alpha_composite": query(f"SELECT ticker, call_date, {_alpha} AS alpha_signal FROM sig", "alpha_signal"),
    "qoq_delta": query("SELECT ticker, call_date, confidence_score - lag(confidence_score) OVER (PARTITION BY ticker ORDER BY call_date) AS confidence_delta FROM sig", "confidence_delta"),
    "zscore_expanding": query("SELECT ticker, call_date, (confidence_score - avg(confidence_score) OVER w) / CASE WHEN count(*) OVER w >= 2 AND stddev_samp(confidence_score) OVER w > 1e-12 THEN stddev_samp(confidence_score) OVER w END AS confidence_z FROM stand WINDOW w AS (PARTITION BY ticker ORDER BY call_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "confidence_z"),
    "signal_returns_join": query("SELECT ticker, call_date, trade_date, confidence_score, ret_1d, ret_3d, ret_5d FROM trade", "confidence_score", *RETURNS),
    "quantile_positions": query("SELECT CAST(config AS BIGINT) AS config, ticker, call_date, CAST(position AS BIGINT) AS position, tr AS trade_return FROM pos", "trade_return"),
    "backtest_single": query(f"SELECT CAST(0 AS BIGINT) AS config, signal_column, holding_period, actual_signal_used, total_trades, long_trades, short_trades, {', '.join(FIGURES)} FROM res WHERE actual_signal_used = 'confidence_score' AND holding_period = 'ret_5d'", *FIGURES),
    "backtest_grid": query("SELECT * REPLACE (CAST(config AS BIGINT) AS config) FROM res", *FIGURES),
    "backtest_best": query("SELECT * REPLACE (CAST(config AS BIGINT) AS config) FROM res ORDER BY annualized_sharpe_ratio DESC, config LIMIT 1", *FIGURES),
    "equity_curve": query("SELECT CAST(config AS BIGINT) AS config, call_date, ticker, equity, equity / greatest(1.0, max(equity) OVER w) - 1 AS drawdown FROM (SELECT *, product(1 + tr) OVER w AS equity FROM pos WHERE position <> 0 WINDOW w AS (PARTITION BY config ORDER BY call_date, ticker ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY config ORDER BY call_date, ticker ROWS UNBOUNDED PRECEDING)", "equity", "drawdown"),
    "max_drawdown": query("SELECT CAST(config AS BIGINT) AS config, min(d) AS max_drawdown FROM (SELECT config, equity / greatest(1.0, max(equity) OVER w) - 1 AS d FROM (SELECT *, product(1 + tr) OVER w AS equity FROM pos WHERE position <> 0 WINDOW w AS (PARTITION BY config ORDER BY call_date, ticker ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY config ORDER BY call_date, ticker ROWS UNBOUNDED PRECEDING)) GROUP BY config", "max_drawdown"),
    "pearson": query("SELECT signal_column, holding_period, count(*) AS n, corr(s, r) AS r, corr(s, r) * sqrt((count(*) - 2) / nullif(1 - corr(s, r) * corr(s, r), 0)) AS t FROM grid WHERE actual_signal_used = signal_column GROUP BY ALL", "r", "t"),
    "pearson_p_values": query(f"SELECT signal_column, holding_period, n, r, t, CASE WHEN n > 2 THEN {_STUDENT} END AS p_value FROM (SELECT *, r * sqrt((n - 2) / nullif(1 - r * r, 0)) AS t FROM (SELECT signal_column, holding_period, count(*) AS n, corr(s, r) AS r FROM grid WHERE actual_signal_used = signal_column GROUP BY ALL))", "r", "t", "p_value"),
    "ic_by_quarter": query("SELECT quarter, count(*) AS n, corr(s, r) AS ic, corr(rs, rr) AS rank_ic FROM (SELECT *, rank() OVER (PARTITION BY quarter ORDER BY s) + (count(*) OVER (PARTITION BY quarter, s) - 1) / 2 AS rs, rank() OVER (PARTITION BY quarter ORDER BY r) + (count(*) OVER (PARTITION BY quarter, r) - 1) / 2 AS rr FROM (SELECT date_trunc('quarter', trade_date)::DATE AS quarter, confidence_score AS s, ret_5d AS r FROM trade WHERE ret_5d IS NOT NULL)) GROUP BY quarter", "ic", "rank_ic"),
    "quintile_returns": query("SELECT bucket, count(*) AS n_calls, avg(ret_1d) AS mean_ret_1d, avg(ret_3d) AS mean_ret_3d, avg(ret_5d) AS mean_ret_5d FROM (SELECT *, ntile(5) OVER (ORDER BY confidence_score, ticker, call_date) AS bucket FROM trade) GROUP BY bucket", "mean_ret_1d", "mean_ret_3d", "mean_ret_5d"),
    "sharpe_rollup": query(f"SELECT actual_signal_used, holding_period, sector, year, count(*) AS n_trades, {ratio('tr', 'avg(days)')} AS sharpe FROM (SELECT *, substr(call_date, 1, 4) AS year, {_DAYS} AS days FROM pos JOIN {_sectors} USING (ticker) WHERE position <> 0) GROUP BY ROLLUP (actual_signal_used, holding_period, sector, year)", "sharpe"),
    "oos_split": query(f"SELECT CAST(config AS BIGINT) AS config, signal_column, holding_period, actual_signal_used, {METRICS} FROM (SELECT *, {POSITION} AS position, ({POSITION}) * r AS tr, ({POSITION}) * r - r AS active FROM grid JOIN (SELECT config, quantile_cont(s, 0.7) AS q_long, quantile_cont(s, 0.3) AS q_short FROM grid WHERE call_date <= '20240115' GROUP BY ALL) USING (config) WHERE call_date > '20240115') WHERE position <> 0 GROUP BY ALL", *FIGURES),
    "walk_forward": query(f"""
        WITH f AS (SELECT CAST(fold AS BIGINT) AS fold, train_to, test_to FROM (VALUES (0, '20240108', '20240115'), (1, '20240115', '20240122'), (2, '20240122', '99999999')) v(fold, train_to, test_to)),
        wq AS (SELECT fold, config, quantile_cont(s, 0.7) AS q_long, quantile_cont(s, 0.3) AS q_short FROM grid, f WHERE call_date <= train_to GROUP BY ALL),
        wp AS (SELECT *, {POSITION} AS position, ({POSITION}) * r AS tr, ({POSITION}) * r - r AS active, call_date <= train_to AS learns FROM grid JOIN wq USING (config) JOIN f USING (fold) WHERE call_date <= test_to),
        wr AS (SELECT fold, learns, config, signal_column, holding_period, actual_signal_used, {METRICS} FROM wp WHERE position <> 0 GROUP BY ALL),
        pick AS (SELECT fold, config, signal_column, holding_period, actual_signal_used, annualized_sharpe_ratio AS train_sharpe FROM wr WHERE learns QUALIFY row_number() OVER (PARTITION BY fold ORDER BY annualized_sharpe_ratio DESC, config) = 1)
        SELECT pick.* REPLACE (CAST(pick.config AS BIGINT) AS config), train_to, test_to, wr.* EXCLUDE (fold, learns, config, signal_column, holding_period, actual_signal_used)
        FROM pick JOIN f USING (fold) LEFT JOIN wr ON wr.fold = pick.fold AND wr.config = pick.config AND NOT wr.learns""", *FIGURES, "train_sharpe"),
    "ablation": query(f"SELECT CAST(config AS BIGINT) AS config, signal_column, holding_period, actual_signal_used, {METRICS} FROM (SELECT *, {POSITION} AS position, ({POSITION}) * r AS tr, ({POSITION}) * r - r AS active FROM ab JOIN (SELECT config, quantile_cont(s, 0.7) AS q_long, quantile_cont(s, 0.3) AS q_short FROM ab GROUP BY ALL) USING (config)) WHERE position <> 0 GROUP BY ALL", *FIGURES).replace("SELECT * REPLACE", ", ab AS (" + " UNION ALL ".join(f"SELECT {i} AS config, '{n}' AS signal_column, 'ret_5d' AS holding_period, '{n}' AS actual_signal_used, {e} AS s, ret_5d AS r FROM trade WHERE ret_5d IS NOT NULL" for i, (n, e) in enumerate((("model_only", "qa_sentiment"), ("lexicon_only", "hedge_density"), ("composite", "0.5::DOUBLE * confidence_score + 0.5::DOUBLE * qa_sentiment")))) + ") SELECT * REPLACE", 1),
    "ticker_lookup": query(f"SELECT ticker, call_date, {', '.join(SIGNAL_COLUMNS)} FROM sig WHERE upper(ticker) = 'TK5'", *SIGNAL_COLUMNS),
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "transcript_files": query("SELECT ticker, date, source, dataset_row_id, length(raw_text) AS n_chars, md5(raw_text) AS digest FROM raw QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY dataset_row_id) = 1"),
    "sentence_files": query("SELECT sentence_id, ticker, date, speaker_role, speaker_name, section, text, word_count FROM sent"),
    "price_files": query("SELECT ticker, date, open, high, low, close, volume FROM bar", "open", "high", "low", "close"),
    "return_files": query("SELECT * FROM ret", *RETURNS),
    "signal_files": query(f"SELECT ticker, call_date, {', '.join(SIGNAL_COLUMNS)} FROM sig", *SIGNAL_COLUMNS),
    "result_files": query("SELECT CAST(config AS BIGINT) AS config, actual_signal_used, holding_period, total_trades, annualized_sharpe_ratio, row_number() OVER (ORDER BY annualized_sharpe_ratio DESC, config) = 1 AS is_best FROM res", "annualized_sharpe_ratio"),
    "matcher_files": query(f"SELECT ticker, date, sentence_id, {span_count('text')} AS n_spans FROM sent"),
    "dictionary_scan": f"""
        WITH w AS (SELECT DISTINCT unnest({tokens('text')}) AS word FROM documents)
        SELECT 'negative' AS category, word FROM w WHERE length(word) % 3 <> 1 UNION ALL SELECT 'positive', word FROM w WHERE length(word) % 4 = 0 UNION ALL SELECT 'strong_modal', word FROM w WHERE length(word) > 8""",
    "analyze_requests": query(f"""
        WITH g AS (SELECT ticker || ':' || date || ':' || block AS id, text, len({words('text')}) AS word_count, {tokens('text')} AS toks FROM glued WHERE len({words('text')}) > 3),
        n AS (SELECT *, {share('toks', 'positive')} - {share('toks', 'negative')} AS net, {share('toks', 'strong_modal')} AS certainty, {span_count('text')} AS hedges, regexp_matches(text, '\\d') AS numeric FROM g),
        a AS (SELECT id, avg(CASE WHEN net > 0.01 THEN 1 WHEN net < -0.01 THEN -1 ELSE 0 END) AS remarks_sentiment, 0.0::DOUBLE AS qa_sentiment, 0.0::DOUBLE AS qa_pushback_signal, 0.0::DOUBLE AS ceo_cfo_divergence, sum(hedges) / CAST(sum(word_count) AS DOUBLE) AS hedge_density,
              avg(certainty) AS certainty, avg(CAST(numeric AS DOUBLE)) AS specificity, CAST(sum(word_count) AS BIGINT) AS total_words, count(*) AS sentences_parsed FROM n GROUP BY id),
        r AS (SELECT ticker || ':' || date || ':' || block AS id, CASE WHEN length(text) >= 50 THEN 'ok' ELSE 'too_short' END AS status FROM blk)
        SELECT r.id, status, remarks_sentiment, qa_sentiment, CASE WHEN a.id IS NOT NULL THEN {confidence('certainty', 'specificity', 'hedge_density', 'qa_pushback_signal')} END AS confidence_score, hedge_density, ceo_cfo_divergence, qa_pushback_signal,
               coalesce(total_words, 0) AS total_words, coalesce(sentences_parsed, 0) AS sentences_parsed
        FROM r LEFT JOIN a ON a.id = r.id AND status = 'ok'""", *SIGNAL_COLUMNS),
}
