"""The SQL counterpart of every query that SQL can express, in DuckDB's dialect.

Written from the meaning of each operator, with plain windows and one regex per lexicon term,
so that it shares no shortcut with the Spark side.
"""

from __future__ import annotations

from voxtally.functions.lexicon import DEFAULT_LEXICON
from voxtally.operators.splits import SPLIT_RATIOS, ratio_column
from voxtally.plans import views
from voxtally.sources.csv import MISSING

WORD = r"\p{L}\p{N}_"
BLANK = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
DIM = [f"f{i:02d}" for i in range(1, views.EMBEDDING_WIDTH + 1)]


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PHRASES = " ".join(f"WHEN {i} THEN {_text(p)}" for i, p in enumerate(views.PHRASES))

COMMENTS = f"""comments AS (
  SELECT e.event_id AS comment_id,
         e.ts + to_days(CAST(e.event_id % 400 AS INTEGER)) AS createTimeISO,
         CASE l.quality WHEN 1 THEN ' positive ' WHEN 0 THEN 'NEGATIVE' END AS label,
         d.text || ' ' || CASE e.event_id % 6 {_PHRASES} ELSE '' END AS text
  FROM events e JOIN documents d ON d.doc_id = e.event_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

CANONICAL = "CASE WHEN lower(label) LIKE '%positive%' THEN 'Positive' ELSE 'Negative' END"

ENRICHED = f"""{COMMENTS}, enriched AS (
  SELECT comment_id, createTimeISO, {CANONICAL} AS label, text,
         CAST(createTimeISO AS DATE) AS date,
         strftime(createTimeISO, '%b %Y') AS month,
         CAST(hour(createTimeISO) AS INTEGER) AS hour,
         dayname(createTimeISO) AS day_name,
         strftime(createTimeISO, '%b') AS month_short,
         CAST(month(createTimeISO) AS INTEGER) AS month_num
  FROM comments)"""


def cleaned(column: str) -> str:
    collapsed = f"trim(regexp_replace(coalesce({column}, ''), '[{BLANK}]+', ' ', 'g'))"
    return f"trim(regexp_replace({collapsed}, '[^{WORD}{BLANK}.,!?-]', '', 'g'))"


TRAINING = f"""raw_training AS (
  SELECT d.doc_id AS id, d.text AS ENGLISH,
         CASE WHEN l.toxic = 1 THEN ' POSITIVE' WHEN l.quality = 1 THEN 'Positive' ELSE 'negative' END AS Sentiment
  FROM documents d JOIN labels l USING (doc_id)),
training AS (
  SELECT * FROM (SELECT id, {cleaned('ENGLISH')} AS ENGLISH, Sentiment,
                        CASE WHEN lower(Sentiment) = 'positive' THEN 1 ELSE 0 END AS label
                 FROM raw_training WHERE Sentiment IN ('Negative', 'Positive', 'negative', 'positive'))
  WHERE length(ENGLISH) > 0)"""


def _terms(text: str, listed) -> str:
    """Sum over the listed words, twice-listed ones counted twice."""
    tests = [
        f"CAST(regexp_matches({text}, '(^|[^{WORD}]){term}($|[^{WORD}])') AS INTEGER)" for term in listed
    ]
    return "(" + " + ".join(tests) + ")"


def _patterns(text: str, patterns) -> str:
    tests = [
        "2 * CAST(regexp_matches({}, '{}') AS INTEGER)".format(text, p.replace(r"\s", f"[{BLANK}]")) for p in patterns
    ]
    return "(" + " + ".join(tests) + ")"


def scored(source: str, text: str = "text", name: str = "scored") -> str:
    lex = DEFAULT_LEXICON
    return f"""{name} AS (
  SELECT *, positive_terms + positive_patterns AS positive, negative_terms + negative_patterns AS negative,
         CASE WHEN positive_terms + positive_patterns > negative_terms + negative_patterns
              THEN 'Positive' ELSE 'Negative' END AS rule_sentiment
  FROM (SELECT *, {_terms('low', lex.positive)} AS positive_terms, {_terms('low', lex.negative)} AS negative_terms,
               {_patterns('low', lex.positive_patterns)} AS positive_patterns,
               {_patterns('low', lex.negative_patterns)} AS negative_patterns
        FROM (SELECT *, lower(coalesce({text}, '')) AS low FROM {source})))"""


def draws(source: str, key: str, stratum: str, fraction: float, seed: str, name: str, out: str) -> str:
    """CTEs ending in ``name``: the source's rows and whether the row is drawn (``out``)."""
    return f"""{name}_c AS (SELECT {stratum} AS s, count(*) AS n FROM {source} GROUP BY 1),
{name}_d AS (SELECT s, n, sum(n) OVER () AS total, ceil({fraction}::DOUBLE * (sum(n) OVER ())) AS draws FROM {name}_c),
{name}_w AS (SELECT *, n::DOUBLE / total::DOUBLE * draws AS share FROM {name}_d),
{name}_r AS (SELECT *, floor(share) AS whole, share - floor(share) AS rest FROM {name}_w),
{name}_q AS (SELECT s, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, s)
                                         <= draws - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_r),
{name} AS (SELECT t.*, row_number() OVER (PARTITION BY {stratum} ORDER BY md5('{seed}:' || {key})) <= q.quota AS {out}
           FROM {source} t JOIN {name}_q q ON q.s IS NOT DISTINCT FROM ({stratum}))"""


def two_way(source: str, key: str, stratum: str, fraction: float, name: str = "parted") -> str:
    return draws(source, key, stratum, fraction, "42", f"{name}_m", "drawn") + f""",
{name} AS (SELECT * EXCLUDE (drawn), CASE WHEN drawn THEN 'test' ELSE 'train' END AS split FROM {name}_m)"""


def folds(source: str, key: str, stratum: str, count: int) -> str:
    """Rows dealt in turn to the folds, class after class; a class's rows then go to its folds in the hash's order."""
    return f"""dealt AS (
  SELECT {stratum} AS s, (row_number() OVER (ORDER BY {stratum}) - 1) % {count} AS fold FROM {source}),
sizes AS (SELECT s, fold, count(*) AS n FROM dealt GROUP BY s, fold),
upto AS (SELECT s, fold, sum(n) OVER (PARTITION BY s ORDER BY fold) AS last FROM sizes),
hashed AS (SELECT {key}, {stratum}, row_number() OVER (PARTITION BY {stratum} ORDER BY md5('42:' || {key})) AS place FROM {source}),
folded AS (SELECT {key}, {stratum}, CAST(min(fold) AS INTEGER) AS fold FROM hashed JOIN upto ON s = {stratum} AND place <= last
  GROUP BY {key}, {stratum})"""


def three_way(source: str, key: str, stratum: str, name: str = "parted") -> str:
    first = draws(source, key, stratum, 0.2, "42", f"{name}_h", "held")
    second = draws(f"{name}_hh", key, stratum, 0.5, "42:2", f"{name}_t", "tested")
    return f"""{first},
{name}_hh AS (SELECT * FROM {name}_h WHERE held),
{second},
{name} AS (SELECT * EXCLUDE (held), 'train' AS split FROM {name}_h WHERE NOT held
           UNION ALL SELECT * EXCLUDE (held, tested), CASE WHEN tested THEN 'test' ELSE 'val' END FROM {name}_t)"""


def ratio_split(source: str, key: str, stratum: str, name: str = "parted") -> str:
    parts, previous = [], source
    for i, (ratio, fraction) in enumerate(SPLIT_RATIOS.items()):
        parts.append(draws(previous, key, stratum, fraction, "42", f"{name}_{i}", f"m{i}"))
        previous = f"{name}_{i}"
    columns = ", ".join(
        f"CASE WHEN m{i} THEN 'test' ELSE 'train' END AS {ratio_column(r)}" for i, r in enumerate(SPLIT_RATIOS)
    )
    marks = ", ".join(f"m{i}" for i in range(len(SPLIT_RATIOS)))
    return ",\n".join(parts) + f",\n{name} AS (SELECT * EXCLUDE ({marks}), {columns} FROM {previous})"


FEATURES = "features AS (SELECT vec_id, label, {} FROM embeddings)".format(
    ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS {name}" for i, name in enumerate(DIM, 1))
)

PREDICTIONS = """predictions AS (
  SELECT vec_id AS id, label, (label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS prediction
  FROM embeddings)"""

SCORED_LABELS = f"""{COMMENTS}, labelled AS (SELECT * FROM comments WHERE label IS NOT NULL),
{scored('labelled')}, scored_labels AS (
  SELECT comment_id AS id, CASE WHEN lower(label) LIKE '%positive%' THEN 1 ELSE 0 END AS label,
         CASE WHEN rule_sentiment = 'Positive' THEN 1 ELSE 0 END AS prediction FROM scored)"""

HISTORY = """history AS (
  SELECT user_id AS run_id, CAST(day(ts) AS INTEGER) AS epoch,
         avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS val_acc
  FROM events GROUP BY 1, 2)"""

TRACE = f"""{HISTORY}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS step,
         greatest(0.0::DOUBLE, coalesce(max(val_acc) OVER (PARTITION BY run_id ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS best_before
  FROM history),
marked AS (SELECT *, val_acc > best_before AS improved FROM numbered),
waiting AS (
  SELECT *, step - coalesce(max(CASE WHEN improved THEN step END) OVER (PARTITION BY run_id ORDER BY epoch
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS waited FROM marked),
traced AS (
  SELECT w.*, coalesce(w.step = s.stop_step, false) AS stopped, coalesce(w.step < s.stop_step, true) AS logged
  FROM waiting w LEFT JOIN (SELECT run_id, min(step) AS stop_step FROM waiting WHERE waited >= 3 GROUP BY 1) s
       USING (run_id))"""


def _runs() -> str:
    leads = {
        "terms": "positive_terms - negative_terms",
        "patterns": "positive_patterns - negative_patterns",
        "rules": "positive - negative",
    }
    models = ", ".join(f"{{'model': '{model}', 'lead': {lead}}}" for model, lead in leads.items())
    sides = ", ".join(f"{{'split_ratio': '{ratio}', 'side': {ratio_column(ratio)}}}" for ratio in SPLIT_RATIOS)
    stages = ", ".join(f"({i}, '{stage}', {margin})" for i, (stage, margin) in enumerate(views.STAGE_MARGINS.items()))
    return f"""{COMMENTS}, labelled AS (SELECT * FROM comments WHERE label IS NOT NULL),
{scored('labelled', name='scored_m')},
scored AS MATERIALIZED (SELECT * EXCLUDE (text, low) FROM scored_m),
{ratio_split('scored', 'comment_id', 'label')},
tested AS MATERIALIZED (SELECT {CANONICAL} AS truth, m.model, m.lead, r.split_ratio
  FROM parted, unnest([{models}]) AS t(m), unnest([{sides}]) AS u(r) WHERE r.side = 'test'),
stages(stage_no, stage, margin) AS (VALUES {stages}),
runs AS MATERIALIZED (
  SELECT model, split_ratio, stage_no, stage,
    100.0::DOUBLE * avg(CASE WHEN (CASE WHEN lead > margin THEN 'Positive' ELSE 'Negative' END) = truth
                             THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
  FROM tested, stages GROUP BY ALL)"""



def _report(source: str, digits: int) -> str:
    def r(x):
        return f"round({x}, {digits})"

    return f"""classes AS (SELECT label AS c FROM {source} UNION SELECT prediction FROM {source}),
sums AS (SELECT c, (SELECT count(*) FROM {source} WHERE label = c) AS support,
                (SELECT count(*) FROM {source} WHERE prediction = c) AS predicted,
                (SELECT count(*) FROM {source} WHERE label = c AND prediction = c) AS hits FROM classes),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS p,
              CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM sums),
prf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pr),
report AS (
  SELECT CAST(c AS VARCHAR) AS class, {r('p')} AS precision, {r('r')} AS recall, {r('f')} AS f1, support FROM prf
  UNION ALL SELECT 'accuracy', NULL, NULL, {r('sum(hits) / sum(support)')}, sum(support) FROM prf
  UNION ALL SELECT 'macro avg', {r('avg(p)')}, {r('avg(r)')}, {r('avg(f)')}, sum(support) FROM prf
  UNION ALL SELECT 'weighted avg', {r('sum(p * support) / sum(support)')}, {r('sum(r * support) / sum(support)')},
                   {r('sum(f * support) / sum(support)')}, sum(support) FROM prf)
SELECT class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM report"""


WRITTEN = """written AS (
  SELECT event_id, CASE event_id % 9 WHEN 0 THEN v || 'd' WHEN 1 THEN '  ' || v || ' ' WHEN 2 THEN v || 'e2'
                   WHEN 3 THEN '' WHEN 4 THEN '-' || v WHEN 5 THEN 'n/a' ELSE v END AS written,
         event_type AS kind, value
  FROM (SELECT *, CAST(value AS VARCHAR) AS v FROM events))"""

TOKENS = f"regexp_extract_all(lower(text), '[{WORD}]+')"

VOCABULARY = f"""words AS (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM comments) GROUP BY 1),
vocabulary AS (SELECT token, n, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS token_id FROM words)"""

LEXICON_VALUES = ", ".join(
    f"({_text(term)}, '{polarity}', {weight})"
    for polarity in ("positive", "negative")
    for term, weight in DEFAULT_LEXICON.weights(polarity).items()
)

MODEL = f"""{COMMENTS}, {scored('comments')}, answered AS (
  SELECT s.*, CASE l.toxic WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' END AS model_sentiment
  FROM scored s LEFT JOIN labels l ON l.doc_id = s.comment_id),
decided AS (SELECT *, coalesce(model_sentiment, rule_sentiment) AS sentiment,
                   CASE WHEN model_sentiment IS NULL THEN 'Rule-Based' ELSE 'Model' END AS model FROM answered)"""

LOG = f"""{MODEL}, log AS (
  SELECT comment_id, createTimeISO AS ts,
         CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS text, sentiment, model
  FROM decided)"""

DISPLAY = "strftime(createTimeISO, '%b %d, %Y at %I:%M %p')"

_SCALED = ", ".join(
    f"round((p.{d} - s.m{d}) / (CASE WHEN s.d{d} > 0 THEN s.d{d} ELSE 1 END), 5) AS {d}" for d in DIM
)
_STATS = ", ".join(f"avg({d}) AS m{d}, stddev_pop({d}) AS d{d}" for d in DIM)


def statements() -> dict[str, str]:
    return {
        "enrich_comments": f"WITH {ENRICHED} SELECT * EXCLUDE (text) FROM enriched",
        "parsed_timestamps": """
            SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts)
                WHEN 1 THEN date_trunc('second', ts) - INTERVAL 8 HOUR
                WHEN 2 THEN date_trunc('second', ts) END AS createTimeISO FROM events""",
        "rejected_timestamps": "SELECT count(*) AS rejected FROM events WHERE event_id % 5 = 0",
        "inferred_times": """
            SELECT event_id, CASE WHEN event_id % 11 = 5 THEN NULL
              WHEN event_id % 3 = 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS createTimeISO
            FROM events""",
        "time_formats_found": """
            WITH e AS (
              SELECT event_id % 11 = 5 AS odd, event_id % 3 AS kind, day(ts) AS d FROM events)
            SELECT '1/2/2024' AS layout, 'day first' AS "order",
              count(*) FILTER (WHERE NOT odd AND kind = 0) AS parsed, count(*) FILTER (WHERE odd) AS rejected,
              count(*) FILTER (WHERE NOT odd AND kind = 0 AND d <= 12) AS undecided FROM e
            UNION ALL SELECT 'Jan 2, 2024', 'only', count(*), 0, 0 FROM e WHERE NOT odd AND kind = 1
            UNION ALL SELECT '20240102', 'only', count(*), 0, 0 FROM e WHERE NOT odd AND kind = 2""",
        "display_times": f"WITH {COMMENTS} SELECT comment_id, {DISPLAY} AS shown_at FROM comments",
        "elapsed_times": """
            WITH t AS (SELECT event_id, CAST(round_even(value * 3600.5::DOUBLE, 0) AS BIGINT) AS s FROM events),
            c AS (SELECT event_id, s // 86400 AS d, CAST(s % 86400 // 3600 AS VARCHAR) || ':'
                    || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':'
                    || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM t)
            SELECT event_id, CASE d WHEN 0 THEN clock WHEN 1 THEN '1 day, ' || clock
                             ELSE CAST(d AS VARCHAR) || ' days, ' || clock END AS elapsed FROM c""",
        "canonical_label": f"WITH {ENRICHED} SELECT comment_id, label FROM enriched",
        "normalized_text": f"""
            SELECT conv_id, turn, lower(regexp_replace(text, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')) AS text
            FROM conversations""",
        "clean_text": f"SELECT doc_id, {cleaned('text')} AS text FROM documents",
        "text_training_rows": f"WITH {TRAINING} SELECT id, ENGLISH, Sentiment, label FROM training",
        "sentiment_totals": f"""
            WITH {ENRICHED} SELECT count(*) AS total,
                count(*) FILTER (label = 'Positive') AS positive, count(*) FILTER (label = 'Negative') AS negative,
                coalesce(round(100.0::DOUBLE * count(*) FILTER (label = 'Positive') / nullif(count(*), 0), 6), 0)
                    AS positive_percent,
                coalesce(round(100.0::DOUBLE * count(*) FILTER (label = 'Negative') / nullif(count(*), 0), 6), 0)
                    AS negative_percent
            FROM enriched""",
        "monthly_counts": f"""
            WITH {ENRICHED} SELECT CAST(date_trunc('month', createTimeISO) AS DATE) AS month_start, count(*) AS n
            FROM enriched WHERE createTimeISO IS NOT NULL GROUP BY 1""",
        "monthly_counts_orders": """
            SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS n FROM orders GROUP BY 1""",
        "monthly_peak": f"""
            WITH {ENRICHED} SELECT coalesce(max(n), 0) AS max_count
            FROM (SELECT count(*) AS n FROM enriched GROUP BY date_trunc('month', createTimeISO))""",
        "monthly_trend": f"""
            WITH {ENRICHED} SELECT month_num, month, count(*) FILTER (label = 'Positive') AS "Positive",
                count(*) FILTER (label = 'Negative') AS "Negative"
            FROM enriched GROUP BY month_num, month""",
        "stored_trend": f"""
            WITH {ENRICHED} SELECT month_num, month, count(*) FILTER (label = 'Positive') AS "Positive",
                count(*) FILTER (label = 'Negative') AS "Negative"
            FROM enriched GROUP BY month_num, month""",
        "stored_totals": f"""
            WITH {ENRICHED} SELECT count(*) AS total,
                count(*) FILTER (label = 'Positive') AS positive, count(*) FILTER (label = 'Negative') AS negative,
                coalesce(round(100.0::DOUBLE * count(*) FILTER (label = 'Positive') / nullif(count(*), 0), 6), 0)
                    AS positive_percent,
                coalesce(round(100.0::DOUBLE * count(*) FILTER (label = 'Negative') / nullif(count(*), 0), 6), 0)
                    AS negative_percent
            FROM enriched""",
        "class_distribution": f"""
            WITH {TRAINING} SELECT label, count(*) AS n,
                round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM training), 6) AS percent
            FROM training GROUP BY label""",
        "class_summary": """
            SELECT count(*) AS n_classes, min(n) AS min_class_count
            FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)""",
        "class_weights": f"""
            WITH {TRAINING}, c AS (SELECT label, count(*) AS n FROM training GROUP BY 1)
            SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
        "weighted_rows": """
            WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
            SELECT e.label, e.vec_id, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n), 6) AS weight
            FROM embeddings e JOIN c USING (label)""",
        "csv_documents": f"""
            SELECT doc_id, CASE WHEN text NOT IN ({", ".join(map(_text, MISSING))}) THEN text END AS text FROM documents""",
        "search_comments": f"""
            WITH {ENRICHED} SELECT comment_id, label FROM enriched WHERE lower(text) LIKE '%terima kasih%'""",
        "search_pattern": f"""
            WITH {ENRICHED} SELECT comment_id, label FROM enriched
            WHERE regexp_matches(text, 'luar biasa|gagal (total|semua)', 'i')""",
        "indexed_search": f"""
            WITH {ENRICHED} SELECT comment_id, label FROM enriched WHERE lower(text) LIKE '%terima kasih%'""",
        "indexed_pattern": f"""
            WITH {ENRICHED} SELECT comment_id, label FROM enriched
            WHERE regexp_matches(text, 'luar biasa|gagal (total|semua)', 'i')""",
        "filter_by_label": f"WITH {ENRICHED} SELECT comment_id, label, month FROM enriched WHERE label = 'Positive'",
        "filter_recent": f"""
            WITH {ENRICHED} SELECT comment_id, createTimeISO FROM enriched
            WHERE createTimeISO >= TIMESTAMP '2024-06-15 12:30:00' - INTERVAL 90 DAY""",
        "filter_recent_events": """
            SELECT event_id, ts, event_type FROM events
            WHERE ts >= TIMESTAMP '2024-01-28 06:00:00' - INTERVAL 7 DAY""",
        "comments_page": f"""
            WITH {ENRICHED}, t AS (SELECT least(3, greatest(1, ceil(count(*) / 30))) AS p FROM enriched)
            SELECT comment_id, createTimeISO, label, text, {DISPLAY} AS shown_at
            FROM (SELECT *, row_number() OVER (ORDER BY createTimeISO DESC NULLS LAST, comment_id DESC) AS rn
                  FROM enriched), t
            WHERE rn > (p - 1) * 30 AND rn <= p * 30""",
        "deep_page": """
            WITH t AS (SELECT least(200, greatest(1, ceil(count(*) / 30))) AS p FROM events)
            SELECT event_id, ts, user_id, event_type, value, props
            FROM (SELECT *, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events), t
            WHERE rn > (p - 1) * 30 AND rn <= p * 30""",
        "next_page": f"""
            WITH {ENRICHED} SELECT comment_id, createTimeISO, label FROM enriched
            WHERE createTimeISO < TIMESTAMP '2024-06-01' OR createTimeISO IS NULL
               OR (createTimeISO = TIMESTAMP '2024-06-01' AND comment_id < 0)
            ORDER BY createTimeISO DESC NULLS LAST, comment_id DESC LIMIT 30""",
        "page_summary": f"""
            WITH {ENRICHED}, c AS (SELECT count(*) AS total, CAST(ceil(count(*) / 30) AS BIGINT) AS pages
                                   FROM enriched WHERE label = 'Negative'),
            p AS (SELECT *, greatest(1, least(2, pages)) AS page FROM c)
            SELECT total, pages, page, CASE WHEN total > 0 THEN (page - 1) * 30 + 1 ELSE 0 END AS first_row,
                   least(page * 30, total) AS last_row FROM p""",
        "page_numbers": f"""
            WITH {COMMENTS}, n AS (SELECT comment_id, createTimeISO,
                row_number() OVER (ORDER BY createTimeISO DESC NULLS LAST, comment_id DESC) AS row_number FROM comments)
            SELECT *, CAST(ceil(row_number / 30) AS BIGINT) AS page FROM n""",
        "page_numbers_events": """
            WITH n AS (SELECT event_id, ts,
                row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id DESC) AS row_number FROM events)
            SELECT *, CAST(ceil(row_number / 30) AS BIGINT) AS page FROM n""",
        "analysis_log": f"WITH {LOG} SELECT * FROM log",
        "latest_items": f"WITH {LOG} SELECT * FROM log ORDER BY ts DESC, comment_id DESC LIMIT 5",
        "lexicon_counts": f"""
            WITH {COMMENTS}, {scored('comments')} SELECT comment_id, positive_terms, negative_terms FROM scored""",
        "pattern_counts": f"""
            WITH {COMMENTS}, {scored('comments')} SELECT comment_id, positive_patterns, negative_patterns FROM scored""",
        "rule_sentiment": f"""
            WITH {COMMENTS}, {scored('comments')} SELECT comment_id, positive, negative, rule_sentiment FROM scored""",
        "score_conversations": f"""
            WITH {scored('conversations')} SELECT conv_id, turn, positive, negative, rule_sentiment FROM scored""",
        "model_or_rule": f"WITH {MODEL} SELECT comment_id, sentiment, model FROM decided",
        "lexicon_weights": f"""
            WITH {COMMENTS}, low AS (SELECT lower(text) AS t FROM comments),
            lexicon(term, polarity, weight) AS (VALUES {LEXICON_VALUES})
            SELECT term, polarity, weight, count(t) AS n_texts
            FROM lexicon LEFT JOIN low
              ON contains(t, term) AND regexp_matches(t, '(^|[^{WORD}])' || term || '($|[^{WORD}])')
            GROUP BY ALL""",
        "word_freq": f"""
            WITH {ENRICHED}, w AS (SELECT label, unnest({TOKENS}) AS word FROM enriched),
            c AS (SELECT label, word, count(*) AS n FROM w GROUP BY 1, 2),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS INTEGER) AS rank FROM c)
            SELECT * FROM r WHERE rank <= 20""",
        "vocabulary": f"WITH {COMMENTS}, {VOCABULARY} SELECT token, n, token_id FROM vocabulary",
        "encode_fixed_length": f"""
            WITH {COMMENTS}, {VOCABULARY},
            body AS (SELECT comment_id, label, {TOKENS}[1:254] AS tokens FROM comments),
            items AS (SELECT comment_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM body),
            ids AS (SELECT comment_id, list(coalesce(token_id, 1) ORDER BY pos) AS ids
                    FROM items LEFT JOIN vocabulary USING (token) GROUP BY 1),
            filled AS (SELECT b.comment_id, label, list_concat([2], coalesce(ids, []), [3]) AS f
                       FROM body b LEFT JOIN ids USING (comment_id))
            SELECT comment_id, label,
                   rtrim(array_to_string(f, ' ') || repeat(' 0', 256 - len(f))) AS input_ids,
                   ltrim(repeat(' 1', len(f)) || repeat(' 0', 256 - len(f))) AS attention_mask FROM filled""",
        "softmax_label": """
            WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
            m AS (SELECT vec_id, max(x) AS top, sum(exp(x)) AS z, max(CASE WHEN i = 0 THEN x END) AS x0 FROM e GROUP BY 1)
            SELECT m.vec_id, CAST(min(i) AS INTEGER) AS predicted, round(exp(any_value(top)) / any_value(z), 6) AS top_probability,
                   round(exp(any_value(x0)) / any_value(z), 6) AS first_probability
            FROM m JOIN e ON e.vec_id = m.vec_id AND e.x = m.top GROUP BY 1""",
        "drop_null_columns": f"WITH {WRITTEN} SELECT event_id, written, kind, value FROM written",
        "coerce_numeric": f"""
            WITH {WRITTEN} SELECT event_id, TRY_CAST(nullif(trim(written), '') AS DOUBLE) AS written,
                TRY_CAST(kind AS DOUBLE) AS kind, value FROM written""",
        "coerce_text_columns": f"""
            WITH {WRITTEN} SELECT event_id, w AS written, value
            FROM (SELECT *, TRY_CAST(nullif(trim(written), '') AS DOUBLE) AS w FROM written)
            WHERE w IS NOT NULL AND value IS NOT NULL AND event_id IS NOT NULL""",
        "dropna_summary": f"""
            WITH {WRITTEN} SELECT count(*) AS original_rows,
                count(*) - count(TRY_CAST(nullif(trim(written), '') AS DOUBLE)) AS dropped_rows,
                count(TRY_CAST(nullif(trim(written), '') AS DOUBLE)) AS final_rows FROM written""",
        "label_index": """
            SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label_index
            FROM events""",
        "standardize": f"""
            WITH {FEATURES}, {two_way('features', 'vec_id', 'label', 0.4)},
            stats AS (SELECT {_STATS} FROM parted WHERE split = 'train')
            SELECT p.vec_id, p.split, {_SCALED} FROM parted p, stats s""",
        "stratified_split": f"""
            WITH base AS (SELECT vec_id, label FROM embeddings), {two_way('base', 'vec_id', 'label', 0.4)}
            SELECT vec_id, label, split FROM parted""",
        "stratified_folds": f"""
            WITH {folds('embeddings', 'vec_id', 'label', 5)} SELECT vec_id, label, fold FROM folded""",
        "stratified_folds_orders": f"""
            WITH {folds('orders', 'o_orderkey', 'o_orderstatus', 7)} SELECT o_orderkey, o_orderstatus, fold FROM folded""",
        "stratified_split_orders": f"""
            WITH base AS (SELECT o_orderkey, o_orderstatus FROM orders),
            {two_way('base', 'o_orderkey', 'o_orderstatus', 0.2)}
            SELECT o_orderkey, o_orderstatus, split FROM parted""",
        "plain_split": f"""
            WITH base AS (SELECT event_id, CASE event_id WHEN 0 THEN 'once' ELSE event_type END AS kind FROM events),
            {two_way('base', 'event_id', '0', 0.2)}
            SELECT event_id, kind, split FROM parted""",
        "forest_test_side": f"""
            WITH base AS (SELECT vec_id, label FROM embeddings), {two_way('base', 'vec_id', 'label', 0.2)}
            SELECT vec_id, label FROM parted WHERE split = 'test'""",
        "kernel_svm_test_side": f"""
            WITH base AS (SELECT vec_id, label FROM embeddings), {two_way('base', 'vec_id', 'label', 0.4)}
            SELECT vec_id, label FROM parted WHERE split = 'test'""",
        "text_classifier_test_side": f"""
            WITH {TRAINING}, base AS (SELECT id, label FROM training), {three_way('base', 'id', 'label')}
            SELECT id, label FROM parted WHERE split = 'test'""",
        "trimmed_headers": "SELECT c_custkey, c_acctbal FROM customer",
        "target_column": 'SELECT event_id, value AS "Score" FROM events',
        "target_and_features": "SELECT event_id, user_id FROM events",
        "title_labels": """
            SELECT event_id, upper(event_type[1]) || lower(event_type[2:]) AS label FROM events""",
        "trainable_counts": f"""
            WITH {TRAINING} SELECT count(*) AS n_rows, count(DISTINCT label) AS n_classes FROM training""",
        "three_way_split": f"""
            WITH {TRAINING}, base AS (SELECT id, Sentiment FROM raw_training), {three_way('base', 'id', 'Sentiment')}
            SELECT id, Sentiment, split FROM parted""",
        "split_distribution": f"""
            WITH base AS (SELECT event_id, event_type FROM events), {three_way('base', 'event_id', 'event_type')}
            SELECT split, event_type, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS split_rows
            FROM parted GROUP BY 1, 2""",
        "split_ratios": f"""
            WITH base AS (SELECT vec_id, label FROM embeddings), {ratio_split('base', 'vec_id', 'label')}
            SELECT * FROM parted""",
        "accuracy": f"""
            WITH {PREDICTIONS} SELECT round(avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy
            FROM predictions""",
        "weighted_prf": f"""
            WITH {PREDICTIONS}, classes AS (SELECT label AS c FROM predictions UNION SELECT prediction FROM predictions),
            s AS (SELECT c, (SELECT count(*) FROM predictions WHERE label = c) AS support,
                         (SELECT count(*) FROM predictions WHERE prediction = c) AS predicted,
                         (SELECT count(*) FROM predictions WHERE label = c AND prediction = c) AS hits FROM classes),
            pr AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM s)
            SELECT round(sum(hits) / sum(support), 6) AS accuracy,
                   round(sum(p * support) / sum(support), 6) AS precision,
                   round(sum(r * support) / sum(support), 6) AS recall,
                   round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * support) / sum(support), 6) AS f1 FROM pr""",
        "classification_report": f"WITH {PREDICTIONS}, {_report('predictions', 6)}",
        "rule_report": f"WITH {SCORED_LABELS}, {_report('scored_labels', 4)}",
        "confusion_matrix": f"""
            WITH {PREDICTIONS}, axis AS (SELECT label AS c FROM predictions UNION SELECT prediction FROM predictions)
            SELECT a.c AS label, b.c AS prediction, count(p.id) AS n
            FROM axis a CROSS JOIN axis b LEFT JOIN predictions p ON p.label = a.c AND p.prediction = b.c GROUP BY 1, 2""",
        "confusion_table": "WITH {} SELECT label, {} FROM predictions GROUP BY 1".format(
            PREDICTIONS, ", ".join(f'count(*) FILTER (prediction = {c}) AS "{c}"' for c in range(10))
        ),
        "summary_report": f"""
            WITH {SCORED_LABELS}, enriched AS (SELECT createTimeISO FROM comments),
            base AS (SELECT event_id, event_type FROM events), {three_way('base', 'event_id', 'event_type')}
            SELECT 'cells' AS section, CASE WHEN label = 0 AND prediction = 0 THEN 'tn' WHEN label = 0 THEN 'fp'
                       WHEN prediction = 0 THEN 'fn' ELSE 'tp' END AS key, CAST(count(s.id) AS VARCHAR) AS value
            FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(label, prediction)
                 LEFT JOIN scored_labels s USING (label, prediction) GROUP BY ALL
            UNION ALL SELECT 'months', 'max_count', CAST(max(n) AS VARCHAR)
            FROM (SELECT count(*) AS n FROM enriched GROUP BY date_trunc('month', createTimeISO))
            UNION ALL SELECT 'split', split, CAST(count(*) AS VARCHAR) FROM parted GROUP BY split
            UNION ALL SELECT 'classes', CAST(label AS VARCHAR), CAST(count(*) AS VARCHAR)
            FROM scored_labels GROUP BY label""",
        "label_axis": f"""
            WITH {PREDICTIONS} SELECT label FROM predictions UNION SELECT prediction FROM predictions""",
        "confusion_cells": f"""
            WITH {SCORED_LABELS} SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn,
                count(*) FILTER (label = 0 AND prediction = 1) AS fp,
                count(*) FILTER (label = 1 AND prediction = 0) AS fn,
                count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM scored_labels""",
        "batch_accuracy": f"""
            WITH {PREDICTIONS}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM predictions),
            b AS (SELECT pos // 16 AS batch, avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS a FROM n GROUP BY 1)
            SELECT round(avg(a), 6) AS batch_accuracy, count(*) AS batches FROM b""",
        "prediction_samples": f"""
            WITH {TRAINING}, {three_way('training', 'id', 'label')},
            tested AS (SELECT * FROM parted WHERE split = 'test'), {scored('tested', 'ENGLISH')},
            g AS (SELECT *, CASE WHEN rule_sentiment = 'Positive' THEN 1 ELSE 0 END AS guess FROM scored)
            SELECT id, ENGLISH AS text, label AS true_label, guess AS predicted_label,
                   CASE label WHEN 1 THEN 'Positive' ELSE 'Negative' END AS true_sentiment,
                   rule_sentiment AS predicted_sentiment, label = guess AS correct
            FROM g ORDER BY id LIMIT 20""",
        "runs_long": f"""
            WITH {_runs()} SELECT model, split_ratio, stage_no, stage, round(accuracy, 6) AS accuracy FROM runs""",
        "best_run": f"""
            WITH {_runs()} SELECT model, round(accuracy, 6) AS accuracy, split_ratio, stage_no, stage
            FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, split_ratio, stage_no) AS rn
                  FROM runs) WHERE rn = 1""",
        "gain_over_baseline": f"""
            WITH {_runs()}, ranked AS (
              SELECT *, first_value(accuracy) OVER (PARTITION BY model, split_ratio ORDER BY stage_no) AS baseline,
                     row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, split_ratio, stage_no) AS rn FROM runs)
            SELECT model, split_ratio, stage, round(accuracy, 6) AS accuracy, round(baseline, 6) AS baseline,
                   round(accuracy - baseline, 6) AS gain FROM ranked WHERE rn = 1""",
        "stage_gain": f"""
            WITH {_runs()} SELECT r.model, r.split_ratio, r.stage_no, r.stage, round(r.accuracy, 6) AS accuracy,
                round(r.accuracy - p.accuracy, 6) AS change
            FROM runs r LEFT JOIN runs p ON p.model = r.model AND p.split_ratio = r.split_ratio
                                        AND p.stage_no = r.stage_no - 1""",
        "split_effect": f"""
            WITH {_runs()}, s AS (SELECT model, split_ratio, avg(accuracy) AS mean_accuracy, max(accuracy) AS max_accuracy
                                  FROM runs GROUP BY 1, 2)
            SELECT model, split_ratio, round(mean_accuracy, 6) AS mean_accuracy, round(max_accuracy, 6) AS max_accuracy,
                   row_number() OVER (PARTITION BY model ORDER BY max_accuracy DESC, split_ratio) = 1 AS is_best FROM s""",
        "early_stop": f"""
            WITH {TRACE} SELECT run_id, epoch, round(val_acc, 6) AS val_acc, CAST(step AS INTEGER) AS step, round(best_before, 6) AS best_before,
                improved, CAST(waited AS INTEGER) AS waited, stopped, logged FROM traced""",
        "best_epoch": f"""
            WITH {TRACE}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_acc DESC, epoch) AS rn
                                FROM traced WHERE logged)
            SELECT run_id, epoch AS best_epoch, round(val_acc, 6) AS best_score FROM r WHERE rn = 1""",
    }
