"""SQL definitions of those queries that SQL can express."""

from __future__ import annotations

from emberline.llm.quality import BULLETS, RULES, STOP_WORDS, SYMBOLS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS}) AS size, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / ((0.5::DOUBLE + least(size, 100) / 200.0::DOUBLE) / (1.0::DOUBLE + 4.0::DOUBLE * n_symbols / greatest(size, 1))) AS key FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [1, 2, 3][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS share
  FROM keyed GROUP BY source),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE) / CAST(sum(share) OVER rest AS DOUBLE) AS level,
    row_number() OVER (ORDER BY 3 * source_size / share, encode(source) NULLS LAST) AS place
  FROM sources
  WINDOW before AS (ORDER BY 3 * source_size / share, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY 3 * source_size / share, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
common AS (SELECT level FROM levels WHERE 3 * source_size / share >= level ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), common.level * share) AS target FROM levels, common),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source),
chosen AS (
  SELECT *, epochs + CAST(2 * before + size <= 2 * (target - epochs * source_size) AS BIGINT) AS copies FROM running)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM chosen
"""


def _broken() -> str:
    parts = []
    for rule in RULES:
        tests = [f"{rule.measure} < {rule.least}"] * (rule.least is not None) + [f"{rule.measure} > {rule.most}"] * (rule.most is not None)
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


def _ratio(part: str, whole: str, name: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} ELSE 0.0 END AS {name}"


QUALITY = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(coalesce(text, ''), '[^{SYMBOLS}]+', '', 'g')) AS n_symbols
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM base)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY r),
counted AS (
  SELECT b.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda x: x IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) AS n_stop_words,
    len(list_filter(lines, lambda x: left(ltrim(x), 1) IN ({", ".join(f"'{b}'" for b in BULLETS)}))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS n_cut_lines
  FROM base b LEFT JOIN covered c ON b.r = c.r),
rated AS (
  SELECT *, {_ratio("n_repeat_words", "n_words", "repeat_ratio")}, {_ratio("word_chars", "n_words", "mean_word_chars")},
    {_ratio("n_symbols", "n_words", "symbol_ratio")}, {_ratio("n_stop_words", "n_words", "stop_ratio")},
    {_ratio("n_dup_lines", "n_lines", "dup_line_ratio")}, {_ratio("n_bullet_lines", "n_lines", "bullet_line_ratio")},
    {_ratio("n_cut_lines", "n_lines", "cut_line_ratio")}
  FROM counted),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_broken()} AS broken_rules FROM rated)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept, broken_rules
FROM judged
"""

ARCHIVES = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM sized)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM ranked
"""

CONTAMINATION = rf"""
WITH items AS (SELECT item_id, {ALNUM} AS ws FROM benchmark),
phrases AS (
  SELECT item_id, array_to_string(ws[s:least(s + 12, len(ws))], ' ') AS phrase, least(13, len(ws)) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS s FROM items WHERE len(ws) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM phrases),
places AS (
  SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS phrase
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM docs, sizes)),
hits AS (SELECT DISTINCT p.r, p.s, p.n, f.item_id FROM places p JOIN phrases f ON p.phrase = f.phrase AND p.n = f.n),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS w FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words ON docs.r = words.r LEFT JOIN named ON docs.r = named.r
"""

NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM rows a, rows r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS place
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 5
"""

ORACLES = {
    "op3_mixing": MIXING,
    "op6_quality": QUALITY,
    "op7_warc": ARCHIVES,
    "op10_decontamination": CONTAMINATION,
    "op12_hard_negatives": NEGATIVES,
}
