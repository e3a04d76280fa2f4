"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from voxtally.llm import bitplane_clusters, kronecker_negatives, line_rules, spaced_seeds

STATEMENTS: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]"
LETTER = r"\p{L}\p{N}_"
#: White space of all scripts.
BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(values) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(values))


STATEMENTS["op5_line_rules"] = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda w: w <> '') AS words
  FROM documents),
starts AS (SELECT doc_id, i, words[i : i + 7] AS gram FROM docs, unnest(range(1, len(words) - 6)) AS r(i)),
twice AS (SELECT doc_id, gram FROM starts GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM starts JOIN twice USING (doc_id, gram), unnest(range(0, 8)) AS r(k)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM docs),
sized AS (
  SELECT *, len(list_filter(string_split_regex(line, '{SPACE}+'), lambda w: w <> '')) AS n,
    length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars FROM lines),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM sized WHERE n > 0),
failed AS (
  SELECT *, again
    OR (NOT regexp_matches(line, '[.!?…:;。！？{line_rules.SENTENCE_MARKS}]["''”’»)\]}}]*([ \t-\r]|$)')
      AND (regexp_matches(line, '^[\x00-\x7F]*$')
        OR 2 * length(regexp_replace(line, '[^{line_rules.UNMARKED}]', '', 'g')) <= length(regexp_replace(line, '[^\p{{L}}]', '', 'g'))))
    OR length(regexp_replace(line, '[{LETTER}{BLANK}.,;:''’\-()"\p{{M}}\x{{200c}}\x{{200d}}{line_rules.SENTENCE_MARKS}{line_rules.OTHER_COMMAS}]', '', 'g')) > n
    OR length(regexp_replace(line, '[^|»›•·>]', '', 'g')) >= 3
    OR (n <= 12 AND len(list_filter(list_transform(string_split_regex(lower(line), '{SPACE}+'),
        lambda w: regexp_replace(w, '^[^{LETTER}]+|[^{LETTER}]+$', '', 'g')),
        lambda w: w <> '' AND w NOT IN ({quoted(line_rules.MENU_WORDS)}))) = 0)
    OR regexp_matches(lower(line), '{"|".join(line_rules.STOCK_PHRASES)}') AS bad
  FROM marked),
per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_failed_lines,
    coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost_chars FROM failed GROUP BY doc_id),
figures AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM docs d LEFT JOIN per_doc p ON d.doc_id = p.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id)
SELECT *, (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEATED} * n_words)
    AND 100 * lost_chars <= {line_rules.MAX_LOST} * word_chars AS kept
FROM figures"""

STATEMENTS["op8_warc"] = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)"""


def _spaced_seeds() -> str:
    """Masked stretches joined as text, then windows compared."""
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    stretches = []
    for table, key in (("d", "doc_id"), ("b", "item_id")):
        for number, mask in enumerate(spaced_seeds.MASKS):
            used = ", ".join(f"w[i + {k}]" for k, flag in enumerate(mask) if flag == "1")
            stretches.append(
                f"SELECT '{table}' AS side, {key} AS id, {number} AS mask, {len(mask)} AS span, i, "
                f"concat_ws(' ', {used}) AS seed FROM {table}, unnest(range(1, len(w) - {len(mask)} + 2)) AS r(i)"
            )
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
stretches AS ({" UNION ALL ".join(stretches)}),
hits AS (
  SELECT DISTINCT p.id AS doc_id, q.id AS item_id, p.i AS place, q.i AS item_place, p.span
  FROM stretches p JOIN stretches q ON p.side = 'd' AND q.side = 'b' AND p.mask = q.mask AND p.seed = q.seed),
windows AS (
  SELECT h.*, d.w AS dw, b.w AS bw, s, least({spaced_seeds.WINDOW}, len(b.w)) AS window_words
  FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(1, len(b.w) + 1)) AS r(s)
  WHERE len(b.w) >= {min(map(len, spaced_seeds.MASKS))}),
counted AS (
  SELECT doc_id, item_id, window_words, len(list_filter(range(0, window_words), lambda k:
      place - item_place + s + k >= 1 AND bw[s + k] = dw[place - item_place + s + k])) AS n_agreed
  FROM windows WHERE s + window_words - 1 <= len(bw) AND s <= item_place AND s + window_words >= item_place + span)
SELECT doc_id, item_id, CAST(max(n_agreed) AS BIGINT) AS n_agreed, CAST(max(window_words) AS BIGINT) AS window_words
FROM counted WHERE 100 * n_agreed >= {spaced_seeds.MIN_AGREED} * window_words GROUP BY doc_id, item_id"""


STATEMENTS["op1_spaced_seeds"] = _spaced_seeds()

STATEMENTS["op9_circulant_minhash"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+'),
    lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s
  FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
reach AS (
  SELECT doc_id AS source, doc_id AS target FROM docs UNION SELECT source, b FROM reach JOIN links ON target = a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(target) AS component_id, d.doc_id = min(target) AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN reach ON source = d.doc_id GROUP BY d.doc_id, n"""


STATEMENTS["op12_kronecker_negatives"] = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {kronecker_negatives.POSITIVES})
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {kronecker_negatives.LOW} * positive_score <= 100 * score
  AND 100 * score <= {kronecker_negatives.HIGH} * positive_score
QUALIFY rank <= {kronecker_negatives.NEGATIVES}"""


def _clusters() -> str:
    """The rounds one after the other."""
    apart = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
    parts = [
        f"""rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{bitplane_clusters.SEED}:' || vec_id), v) - 1 AS k, v AS c FROM rows
  QUALIFY k < {bitplane_clusters.CENTROIDS})"""
    ]
    for i in range(bitplane_clusters.ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(k) AS k, any_value(d) AS d
  FROM (SELECT r, vec_id, v, k, {apart} AS d FROM rows, c{i} QUALIFY d = min(d) OVER (PARTITION BY r)) GROUP BY r)"""
        )
        if i < bitplane_clusters.ROUNDS:
            parts.append(
                f"""s{i} AS (
  SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, unnest(range(1, 65)) AS u(i) GROUP BY k, i),
m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))"""
            )
    last = bitplane_clusters.ROUNDS
    return (
        "WITH "
        + ", ".join(parts)
        + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (k)"""
    )


STATEMENTS["op13_bitplane_clusters"] = _clusters()
