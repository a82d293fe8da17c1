"""SQL definitions of the registered queries, written from the definition of each operator.

They share named parts only: posts, tokens, counts, and scores by dense regression over the
zero-filled grid of slots, which is not the formula the operators use.
"""

from __future__ import annotations

from emberline.functions.text import STOP_WORDS

ORACLES: dict[str, str] = {}

H = 3600
STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

# --- named parts ----------------------------------------------------------------------------

POSTS = rf"""
posts AS (
  SELECT d.doc_id AS post_id, e.user_id, e.ts AS created_at, d.text, d.lang, d.source,
         e.event_type = 'purchase' AS is_repost,
         CAST(floor(e.value * 10) AS BIGINT) AS orig_repost_count,
         list_concat(regexp_extract_all(d.text, '#(\w+)', 1),
                     CASE WHEN floor(e.value * 10) > 300 THEN [e.event_type, d.source] ELSE [e.event_type] END) AS hashtags,
         regexp_extract_all(d.text, '@(\w+)', 1) AS mentions,
         regexp_extract_all(d.text, '(https?://\S+)', 1) AS urls,
         CAST(floor(epoch(e.ts) / {H}) AS BIGINT) AS slot
  FROM documents d JOIN events e ON d.doc_id = e.event_id)"""

# Every event is a post, with the text of the document numbered by its number modulo the number of documents.
EVERY = POSTS.replace("d.doc_id AS post_id", "e.event_id AS post_id").replace(
    "documents d JOIN events e ON d.doc_id = e.event_id", "events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)"
)

KEPT = """
kept AS (
  SELECT * FROM posts
  WHERE lower(lang) = 'en' AND length(text) > 0 AND NOT contains(lower(text), 'worthless')
    AND len(hashtags) <= 1 AND len(urls) <= 2)"""

TOPICS = """
topics(topic_id, query, terms, tokens) AS (VALUES
  ('T1', 'from OR thre', ['from', 'thre'], ['that', 'with']),
  ('T2', 'ther OR tion OR thon', ['ther', 'tion', 'thon'], ['this', 'from', 'rewh']),
  ('T3', 'anea OR erin', ['anea', 'erin'], ['orre', 'thatin']),
  ('T4', '"from the" OR ononst', ['from the', 'ononst'], ['ononst', 'in the']),
  ('T5', '#purchase OR mail3', ['#purchase', 'mail3'], ['mail3']))"""


def tokens(source: str, name: str = "tok") -> str:
    """Rows of ``source`` with ``base``, ``summary`` and ``learner`` tokens."""
    return rf"""
cut_{name} AS (
  SELECT *, list_transform(hashtags, lambda h: '#' || h) AS tags, list_transform(mentions, lambda m: '@' || m) AS names
  FROM {source}),
base_{name} AS (
  SELECT *, list_concat(list_concat(list_concat(tags, names), urls), list_filter(string_split(regexp_replace(
      list_reduce(list_concat(list_concat(tags, names), urls), lambda acc, piece: replace(acc, piece, ' '), text),
      '[[:punct:]\n\t]', ' ', 'g'), ' '), lambda w: length(w) > 0)) AS base
  FROM cut_{name}),
{name} AS (
  SELECT *, list_transform(list_concat(base, hashtags), lambda t: lower(t)) AS summary,
         list_concat(base, tags) AS learner
  FROM base_{name})"""


def cells(source: str, minor: int = 1, by: str = "user_id", column: str = "summary", name: str = "cells", least: int = 0) -> str:
    """Distinct users (posts) per slot and token; a post counts for ``minor`` slots."""
    return f"""
uses_{name} AS (
  SELECT slot + step AS slot, {by} AS who, len({column}) AS size, list_distinct({column}) AS toks
  FROM {source}, (SELECT unnest(range({minor})) AS step)),
span_{name} AS (SELECT min(slot) AS lo, max(slot) AS hi FROM uses_{name}),
{name} AS (
  SELECT slot, token, count(DISTINCT who) AS n
  FROM (SELECT slot, who, unnest(toks) AS token FROM uses_{name} WHERE size >= {least}) GROUP BY ALL)"""


def dense(name: str = "cells", major: int = 24, emit: str = "warm", out: str = "scores", trim: int = 0) -> str:
    """Scores of every token of every window by regression over the zero-filled series."""
    keep = {"warm": f"win - lo >= {major}", "full": f"win >= least(lo + {major - 1}, hi)"}[emit]
    return f"""
wins_{out} AS (
  SELECT win, greatest(win - {major - 1}, lo) AS first_slot
  FROM (SELECT unnest(range(lo, hi - {trim} + 1)) AS win, lo, hi - {trim} AS hi FROM span_{name})
  WHERE {keep}),
seen_{out} AS (
  SELECT DISTINCT w.win, w.first_slot, c.token FROM wins_{out} w JOIN {name} c ON c.slot BETWEEN w.first_slot AND w.win),
vocab_{out} AS (SELECT win, count(*) AS v FROM seen_{out} GROUP BY win),
total_{out} AS (SELECT slot, sum(n) AS s FROM {name} GROUP BY slot),
grid_{out} AS (
  SELECT win, token, first_slot, unnest(range(0, win - first_slot + 1)) AS i FROM seen_{out}),
series_{out} AS (
  SELECT g.win, g.token, g.i, coalesce(c.n, 0) AS n,
         ln((coalesce(c.n, 0) + 1) / (coalesce(t.s, 0) + v.v)) AS y
  FROM grid_{out} g JOIN vocab_{out} v USING (win)
  LEFT JOIN {name} c ON c.slot = g.first_slot + g.i AND c.token = g.token
  LEFT JOIN total_{out} t ON t.slot = g.first_slot + g.i),
fits_{out} AS (
  SELECT win, token, regr_slope(y, i) AS slope, regr_r2(y, i) AS r2, regr_syy(y, i) AS syy,
         arg_max(n, i) - avg(n) AS lead
  FROM series_{out} GROUP BY win, token),
{out} AS (
  SELECT win, token, CASE WHEN syy > 1e-11 THEN slope * r2 ELSE 0 END AS rising,
         abs(CASE WHEN syy > 1e-11 THEN slope * r2 ELSE 0 END) AS score, lead
  FROM fits_{out})"""


def terms(scores: str = "scores", threshold: float = 0.01, length: int = 4, k: int = 10, name: str = "terms") -> str:
    return f"""
{name} AS (
  SELECT win, token, score FROM {scores} WHERE score > {threshold} AND length(token) >= {length}
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY round(score, 9) DESC, token) <= {k})"""


def units(source: str, name: str = "units") -> str:
    """Posts with the words, tags and word pairs that query terms are compared with."""
    return rf"""
words_{name} AS (
  SELECT *, regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+(?:''[\p{{L}}\p{{N}}_]+)*)', 1) AS ws FROM {source}),
{name} AS (
  SELECT *, list_filter(ws, lambda w: NOT list_contains({STOPS}, w)) AS plain,
         list_concat(list_concat(list_filter(ws, lambda w: NOT list_contains({STOPS}, w)),
                                 list_transform(hashtags, lambda h: '#' || lower(h))),
                     list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS us
  FROM words_{name})"""


def relevance(source: str = "units", name: str = "scored", op: str = "or") -> str:
    """Score of each post for each topic with a found term."""
    need = "hits = total" if op == "and" else "hits > 0"
    return f"""
found_{name} AS (
  SELECT u.post_id, t.topic_id, len(t.terms) AS total, len(u.plain) AS size,
         list_filter(list_transform(t.terms, lambda q: len(list_filter(u.us, lambda x: x = q))), lambda f: f > 0) AS freqs
  FROM {source} u, topics t),
{name} AS (
  SELECT post_id, topic_id,
         (hits / total) * weight * pow(1 + ln(0.5), 2) / sqrt(hits * pow(1 + ln(0.5), 2) + (total - hits)) / sqrt(greatest(size, 1)) AS score
  FROM (SELECT *, len(freqs) AS hits, list_sum(list_transform(freqs, lambda f: sqrt(f))) AS weight FROM found_{name})
  WHERE {need})"""


def sims(source: str, scope: str = "TRUE", name: str = "sims") -> str:
    """Largest Jaccard similarity with an earlier row; ``source`` has id, pos, toks."""
    return f"""
size_{name} AS (SELECT id, pos, grp, list_distinct(toks) AS ts FROM {source}),
flat_{name} AS (SELECT id, pos, grp, len(ts) AS size, unnest(ts) AS token FROM size_{name}),
over_{name} AS (
  SELECT a.id, b.id AS other, a.size AS sa, b.size AS sb, count(*) AS both_
  FROM flat_{name} a JOIN flat_{name} b ON a.token = b.token AND a.grp = b.grp AND b.pos < a.pos
  GROUP BY ALL),
{name} AS (
  SELECT s.id, coalesce(max(o.both_ / (o.sa + o.sb - o.both_)), 0) AS sim
  FROM size_{name} s LEFT JOIN over_{name} o USING (id) GROUP BY s.id)"""


RECURSIVE = "RECURSIVE start AS (SELECT 1)"  # first part of statements that walk step by step


def stmt(select: str, *parts: str) -> str:
    return ("WITH " + ",".join(parts) + "\n" + select) if parts else select


def oracle(name: str, select: str, *parts: str) -> None:
    ORACLES[name] = stmt(select, *parts)


def r6(column: str, alias: str | None = None) -> str:
    return f"round({column}, 6) + 0.0 AS {alias or column}"


BAR = "array_to_string({}, '|')"
EPOCH_S = "CAST(floor(epoch(created_at)) AS BIGINT)"
POST_VIEW = f"""
SELECT post_id, text, lang, user_id, {EPOCH_S} AS epoch_s, is_repost,
       CASE WHEN is_repost THEN orig_repost_count END AS orig_repost_count,
       {BAR.format('hashtags')} AS hashtags, {BAR.format('mentions')} AS mentions FROM posts"""
EN = (POSTS, KEPT, tokens("kept"))
EN_CELLS = (*EN, cells("tok", 2, least=3))
EN_SCORES = (*EN_CELLS, dense())
EN_FULL = (*EN_CELLS, dense(emit="full"))
ALL = (POSTS, tokens("posts"))
EVERYTHING = (EVERY, tokens("posts"))
MATCH = (POSTS, TOPICS, units("posts"), relevance())
SCORE_ROWS = f"SELECT win * {H} AS epoch_s, token, {r6('score')} FROM scores"
LONG_TIME = "strftime({}, '%a %b %d %H:%M:%S +0000 %Y')"

# --- sources and sinks ----------------------------------------------------------------------

for _name in ("read_posts", "repartition_input", "stream_posts", "stream_posts_kafka"):
    oracle(_name, POST_VIEW, POSTS)

WORDS5 = rf"""
words AS (
  SELECT item_id, text, list_filter(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+(?:''[\p{{L}}\p{{N}}_]+)*)', 1),
                              lambda w: NOT list_contains({STOPS}, w)) AS ws FROM benchmark),
five AS (
  SELECT item_id, text, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS five FROM words)"""
oracle(
    "read_topics",
    """SELECT 'B' || item_id AS topic_id, array_to_string(five, ' OR ') AS query,
              CASE WHEN length(text) > 700 THEN '' ELSE array_to_string(five, '|') END AS tokens FROM five""",
    WORDS5,
)
oracle(
    "read_keywords",
    "SELECT phrase FROM (SELECT lower(trim(unnest(string_split(replace(text, '.', chr(10)), chr(10))), ' ')) AS phrase FROM benchmark) WHERE length(phrase) > 0",
)
oracle("read_candidate_ids", "SELECT doc_id AS post_id FROM labels WHERE quality = 1")

TOPICAL_KEPT = """
any_token AS (SELECT list_distinct(flatten(list(tokens))) AS ts FROM topics),
topical AS (SELECT kept.* FROM kept, any_token WHERE len(list_filter(ts, lambda t: contains(lower(text), t))) > 0)"""
TERM_SCORES = (POSTS, KEPT, TOPICS, TOPICAL_KEPT, tokens("topical"), cells("tok", 2, least=3), dense())
DATED = f"dated AS (SELECT win * {H * 1000} AS date, win, token, score FROM scores WHERE score > 0.01)"
oracle("read_burst_terms", f"SELECT date, token, {r6('score')} FROM dated", *TERM_SCORES, DATED)
oracle("batch_term_scores", f"SELECT date, token, {r6('score')} FROM dated", *TERM_SCORES, DATED)
oracle(
    "write_burst_terms",
    "SELECT date, count(*) AS terms, string_agg(token, '|' ORDER BY token) AS tokens FROM dated GROUP BY date",
    *TERM_SCORES,
    DATED,
)
oracle(
    "write_selected",
    f"SELECT lang AS topic, slot * {H} AS epoch_s, post_id AS id, replace(text, chr(10), ' ') AS text FROM kept",
    POSTS,
    KEPT,
)
oracle(
    "write_scored_terms",
    f"SELECT {LONG_TIME.format(f'to_timestamp(win * {H})::TIMESTAMP')} AS time, token, {r6('score')} FROM terms",
    *EN_SCORES,
    terms(),
)
STATS = """
SELECT {time}, round(least(0, min(score)), 6) + 0.0 AS min, round(greatest(0, max(score)), 6) + 0.0 AS max,
       round(avg(score), 6) + 0.0 AS avg, round(stddev_pop(score), 6) + 0.0 AS sigma {more} FROM scores GROUP BY win"""
TRUE_MIN = ", round(min(score), 6) + 0.0 AS true_min"
oracle("write_window_stats", STATS.format(time=LONG_TIME.format(f"to_timestamp(win * {H})::TIMESTAMP") + " AS time", more=""), *EN_SCORES)
KEYWORDS3 = """
any_token AS (SELECT list_distinct(flatten(list(tokens))) AS ts FROM topics WHERE {cond}),
hit AS (SELECT posts.* FROM posts, any_token WHERE len(list_filter(ts, lambda t: contains(lower(text), t))) > 0)"""
oracle("write_raw_matches", "SELECT post_id, text FROM hit WHERE lang = 'en'", POSTS, TOPICS, KEYWORDS3.format(cond="TRUE"))
oracle("topic_corpus_filter", "SELECT post_id, text FROM hit WHERE lang = 'en'", POSTS, TOPICS, KEYWORDS3.format(cond="TRUE"))
oracle("keyword_match", "SELECT post_id FROM hit", POSTS, TOPICS, KEYWORDS3.format(cond="TRUE"))


def topic_dense(major: int = 6) -> tuple[str, ...]:
    """Scores per topic over full windows of the topics' common slot range."""
    return (
        POSTS, KEPT, TOPICS, units("kept"), relevance(), tokens("kept"),
        "span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM scored JOIN tok USING (post_id))",
        """tcells AS (SELECT topic_id, slot, token, count(DISTINCT user_id) AS n FROM (
             SELECT topic_id, slot, user_id, unnest(list_distinct(summary)) AS token FROM scored JOIN tok USING (post_id)) GROUP BY ALL)""",
        f"wins AS (SELECT unnest(range(least(lo + {major - 1}, hi), hi + 1)) AS win, lo FROM span)",
        f"""seen AS (SELECT DISTINCT topic_id, win, greatest(win - {major - 1}, lo) AS first_slot, token
             FROM wins JOIN tcells ON slot BETWEEN greatest(win - {major - 1}, lo) AND win)""",
        "vocab AS (SELECT topic_id, win, count(*) AS v FROM seen GROUP BY ALL)",
        "total AS (SELECT topic_id, slot, sum(n) AS s FROM tcells GROUP BY ALL)",
        "grid AS (SELECT *, unnest(range(0, win - first_slot + 1)) AS i FROM seen)",
        """series AS (SELECT g.topic_id, g.win, g.token, g.i, ln((coalesce(c.n, 0) + 1) / (coalesce(t.s, 0) + v.v)) AS y
             FROM grid g JOIN vocab v USING (topic_id, win)
             LEFT JOIN tcells c ON c.topic_id = g.topic_id AND c.slot = g.first_slot + g.i AND c.token = g.token
             LEFT JOIN total t ON t.topic_id = g.topic_id AND t.slot = g.first_slot + g.i)""",
        """tscores AS (SELECT topic_id, win, token,
             abs(CASE WHEN regr_syy(y, i) > 1e-11 THEN regr_slope(y, i) * regr_r2(y, i) ELSE 0 END) AS score
             FROM series GROUP BY ALL)""",
    )


oracle(
    "write_burst_log",
    f"""SELECT topic_id, token, {r6('score')}, win * {H * 1000} AS epoch_ms FROM (
          SELECT *, row_number() OVER (PARTITION BY topic_id, win ORDER BY round(score, 9) DESC, token) AS rank
          FROM tscores WHERE length(token) >= 4) WHERE rank <= 100""",
    *topic_dense(),
)

HOURLY = "hourly AS (SELECT 'H' || slot AS topic_id, post_id, text, post_id AS id, slot AS grp, (created_at, post_id) AS pos, summary AS toks FROM tok)"
oracle(
    "delivery_payload",
    """SELECT topic_id, post_id, 'http://broker/tweet/' || topic_id || '/' || post_id || '/client-1' AS address,
              post_id AS id, CAST(post_id AS VARCHAR) AS id_str,
              CASE WHEN sim >= 0.1 THEN round(sim, 3) ELSE 0.0 END AS "jaccardSim",
              len(list_filter(['that', 'with', 'from'], lambda t: contains(lower(text), t))) AS "tweetBurstCount"
       FROM hourly JOIN sims USING (id)""",
    *ALL,
    HOURLY,
    sims("hourly"),
)


def run_parts(source: str, min_hits: int, cap: int, dedupe: bool, lemma: bool) -> tuple[str, ...]:
    """Topic rows of ``source`` (post_id, time, text)."""
    pick = (
        f"picked AS (SELECT post_id, min(time) AS time, arg_min(text, time) AS text FROM {source} GROUP BY post_id)"
        if dedupe
        else f"picked AS (SELECT post_id, time, text FROM {source})"
    )
    return (
        pick,
        r"""raw AS (SELECT DISTINCT post_id, time, unnest(string_split(regexp_replace(lower(text), '[^a-zA-Z0-9\\]', ' ', 'g'), ' ')) AS token FROM picked)""",
        "clean AS (SELECT DISTINCT post_id, time, coalesce(lemma, token) AS token FROM raw LEFT JOIN lemmas ON token = form)"
        if lemma
        else "clean AS (SELECT * FROM raw)",
        f"""hits AS (SELECT topic_id, post_id, time, count(*) AS hits FROM clean JOIN (
              SELECT DISTINCT topic_id, unnest(tokens) AS token FROM topics) USING (token) GROUP BY ALL HAVING count(*) >= {min_hits})""",
        f"""rows_ AS (SELECT * FROM hits QUALIFY row_number() OVER (
              PARTITION BY topic_id, floor(time / 86400) ORDER BY time, post_id) <= {cap})""",
    )


LEMMAS = r"""
forms AS (SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^a-zA-Z0-9\\]', ' ', 'g'), ' ')) AS form FROM benchmark),
lemmas AS (SELECT form, left(form, length(form) - 1) AS lemma FROM forms WHERE regexp_matches(form, '..s$'))"""
TIMED = f"timed AS (SELECT post_id, {EPOCH_S} AS time, text FROM posts)"
oracle(
    "write_run_a",
    "SELECT topic_id AS topic, post_id AS id, time, 'run1' AS runtag FROM rows_",
    POSTS, TOPICS, TIMED, *run_parts("timed", 2, 11, True, False),
)
oracle(
    "write_run_b",
    """SELECT strftime(to_timestamp(time)::TIMESTAMP, '%Y%m%d') AS date, topic_id AS topic, 'Q0' AS q0, post_id AS id,
              CAST(1 AS BIGINT) AS rank, CAST(1.0 AS DOUBLE) AS score, 'run1' AS runtag FROM rows_""",
    POSTS, TOPICS, TIMED, *run_parts("timed", 1, 100, False, False),
)
oracle(
    "topic_runs",
    "SELECT topic_id, post_id, time, hits FROM rows_",
    POSTS, TOPICS, LEMMAS, TIMED,
    "twice AS (SELECT * FROM timed UNION ALL SELECT post_id, time + 90000, text FROM timed)",
    *run_parts("twice", 1, 11, True, True),
)

oracle(
    "topic_rows",
    """SELECT topic_id AS topic, query AS title, time, strftime(to_timestamp(time)::TIMESTAMP, '%Y%m%d') AS date, post_id AS id,
              regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM rows_ JOIN timed USING (post_id, time) JOIN topics USING (topic_id)""",
    POSTS, TOPICS, TIMED, *run_parts("timed", 1, 100, True, False),
)

# --- filters --------------------------------------------------------------------------------

oracle(
    "filter_valid",
    "SELECT conv_id, turn, text FROM conversations WHERE role <> 'system' AND turn <> 0 AND length(text) > 0",
)
oracle("filter_lang", "SELECT post_id FROM posts WHERE lower(lang) = 'en'", POSTS)
oracle("drop_reposts", "SELECT post_id FROM posts WHERE NOT is_repost", POSTS)
oracle("only_reposts", "SELECT post_id FROM posts WHERE is_repost", POSTS)
oracle(
    "filter_spam_term",
    "SELECT post_id FROM posts WHERE lower(text) NOT LIKE '%worthless%' AND lower(text) NOT LIKE '%subscribe%'",
    POSTS,
)
oracle("filter_entity_counts", "SELECT post_id FROM posts WHERE len(hashtags) <= 1 AND len(urls) <= 2", POSTS)
oracle("filter_min_tokens", "SELECT post_id FROM tok WHERE len(summary) >= 100", *ALL)
oracle("filter_repost_count", "SELECT post_id FROM posts WHERE orig_repost_count >= 100", POSTS)
oracle("topic_match", "SELECT post_id, topic_id FROM scored WHERE score > 0", *MATCH)
MANY = """
asked AS (SELECT 'B' || item_id AS topic_id, unnest(five) AS term, len(five) AS total FROM five),
freqs AS (SELECT post_id, u AS term, len(plain) AS size, count(*) AS freq FROM (SELECT post_id, plain, unnest(us) AS u FROM units) GROUP BY ALL),
many AS (
  SELECT post_id, (hits / total) * weight * pow(1 + ln(0.5), 2) / sqrt(hits * pow(1 + ln(0.5), 2) + (total - hits)) / sqrt(greatest(size, 1)) AS score
  FROM (SELECT post_id, topic_id, total, size, count(*) AS hits, sum(sqrt(freq)) AS weight FROM freqs JOIN asked USING (term) GROUP BY ALL))"""
oracle("topic_match_many", f"SELECT post_id, count(*) AS topics, {r6('sum(score)', 'score')} FROM many GROUP BY post_id", POSTS, units("posts"), WORDS5, MANY)
oracle("topic_match_all", "SELECT post_id, topic_id FROM scored WHERE score > 0", POSTS, TOPICS, units("posts"), relevance(op="and"))
oracle("topic_score", f"SELECT post_id, topic_id, {r6('score')} FROM scored", *MATCH)
oracle("filter_term_length", "SELECT DISTINCT token FROM (SELECT unnest(summary) AS token FROM tok) WHERE length(token) >= 10", *ALL)
oracle("filter_burst_score", f"SELECT win, token, {r6('score')} FROM scores WHERE score > 0.01", *EN_SCORES)
oracle(
    "track_gate",
    """SELECT post_id FROM posts WHERE contains(lower(text), 'anea') OR contains(lower(text), 'mail3')
       OR (user_id * 1.5 - 90 BETWEEN -80 AND -60 AND orig_repost_count / 10 BETWEEN 10 AND 40)""",
    POSTS,
)

# --- projections ----------------------------------------------------------------------------

oracle("tokenize", f"SELECT post_id, {BAR.format('base')} AS tokens FROM tok", *ALL)
oracle(
    "extract_entities",
    rf"""SELECT page_id, {BAR.format(r"regexp_extract_all(html, '#(\w+)', 1)")} AS hashtags,
               {BAR.format(r"regexp_extract_all(html, '@(\w+)', 1)")} AS mentions,
               {BAR.format(r"regexp_extract_all(html, '(https?://\S+)', 1)")} AS urls FROM pages""",
)
oracle("with_hashtag_terms", f"SELECT post_id, {BAR.format('summary')} AS summary, {BAR.format('learner')} AS learner FROM tok", *ALL)
oracle(
    "bigrams",
    """SELECT post_id, array_to_string(list_concat(summary, list_transform(range(1, greatest(len(summary), 1)),
         lambda i: summary[i] || ' ' || summary[i + 1])), '|') AS tokens FROM tok""",
    *ALL,
)
oracle("slice_of", "SELECT event_id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS epoch_s FROM events")
oracle("minor_dates", f"SELECT post_id, (slot + unnest([0, 1, 2])) * {H} AS epoch_s FROM posts", POSTS)
oracle(
    "slice_spine",
    f"SELECT unnest(range(lo, hi + 1)) * {H} AS epoch_s FROM (SELECT min(slot) AS lo, max(slot) AS hi FROM posts)",
    EVERY,
)
oracle(
    "jaccard",
    """SELECT a.post_id, round(len(list_intersect(a.summary, b.summary)) / len(list_distinct(list_concat(a.summary, b.summary))), 6) + 0.0 AS sim
       FROM tok a JOIN tok b ON b.post_id = a.post_id - 1""",
    *ALL,
)
oracle(
    "burst_hits",
    """SELECT post_id, len(list_filter(['that', 'with', 'thatin', 'ononst', 'mail3'], lambda t: contains(lower(text), t))) AS hits
       FROM posts""",
    POSTS,
)
oracle(
    "strip_punct_tokens",
    "SELECT post_id, array_to_string(string_split(lower(regexp_replace(text, '[[:punct:]]', '', 'g')), ' '), '|') AS tokens FROM posts",
    POSTS,
)
oracle(
    "clean_tokens",
    "SELECT DISTINCT post_id, coalesce(lemma, token) AS token FROM raw LEFT JOIN lemmas ON token = form",
    POSTS,
    LEMMAS,
    r"raw AS (SELECT post_id, unnest(string_split(regexp_replace(lower(text), '[^a-zA-Z0-9\\]', ' ', 'g'), ' ')) AS token FROM posts)",
)
oracle(
    "format_time",
    f"""SELECT event_id, {LONG_TIME.format('ts')} AS long, strftime(ts, '%Y-%-m-%-d') AS day_plain,
              strftime(ts, '%Y%m%d') AS day_compact, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, epoch_us(ts) // 1000 AS epoch_ms FROM events""",
)
oracle(
    "topic_terms",
    """SELECT item_id AS topic_id, array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), coalesce(steps, [])), lambda acc, pair:
         list_concat(list_concat(acc, CASE WHEN length(pair[1]) > 2 THEN [pair[1]] ELSE [] END),
                     CASE WHEN length(pair[2]) > 2 AND NOT list_contains(list_concat(acc, CASE WHEN length(pair[1]) > 2 THEN [pair[1]] ELSE [] END), pair[2])
                          THEN [pair[2]] ELSE [] END)), '|') AS tokens
       FROM benchmark LEFT JOIN (
         SELECT item_id, list([token, coalesce(lemma, token)] ORDER BY place) AS steps
         FROM placed LEFT JOIN lemmas ON token = form WHERE token NOT IN (SELECT word FROM stops) GROUP BY item_id) USING (item_id)""",
    LEMMAS,
    r"""stops AS (SELECT word FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)*)', 1)) AS word
         FROM benchmark) GROUP BY word HAVING count(*) > 20)""",
    r"""placed AS (SELECT item_id, place, regexp_replace(ws[place], '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS token
         FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS place FROM (SELECT item_id, string_split(lower(text), ' ') AS ws FROM benchmark)))""",
)
oracle(
    "parse_topic_markup",
    r"""SELECT 'MB' || item_id AS num, trim(replace(text, '<', ' '), E' \n\t\r') AS title,
              trim(string_split(replace(text, '<', ' '), E'\x01')[1], E' \n\t\r') AS "desc" FROM benchmark""",
)
oracle("score_magnitude", f"SELECT win, token, {r6('score')}, {r6('rising')} FROM scores", *EN_SCORES)

# --- counts ---------------------------------------------------------------------------------

COUNT_ROWS = f"SELECT slot * {H} AS epoch_s, token, n FROM cells"
oracle("term_user_counts", COUNT_ROWS, *ALL, cells("tok"))
oracle("term_post_counts", COUNT_ROWS, *ALL, cells("tok", by="post_id", column="learner"))
oracle("minor_window_merge", COUNT_ROWS, *ALL, cells("tok", 3))
PER_TOKEN = "SELECT token, count(*) AS slots, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM cells GROUP BY token"
oracle("minor_window_merge_long", PER_TOKEN, *ALL, cells("tok", 30))
oracle("term_user_counts_events", PER_TOKEN, *EVERYTHING, cells("tok"))
oracle("term_post_counts_events", PER_TOKEN, *EVERYTHING, cells("tok", by="post_id", column="learner"))
oracle(
    "slice_groups",
    f"""SELECT slot * {H} AS epoch_s, count(*) AS posts, count(DISTINCT user_id) AS users,
              CAST(floor(epoch(min(created_at))) AS BIGINT) AS first_at, CAST(floor(epoch(max(created_at))) AS BIGINT) AS last_at
       FROM posts GROUP BY slot""",
    EVERY,
)
oracle("time_bounds", f"SELECT min(slot) * {H} AS first_s, (max(slot) + 2) * {H} AS last_s FROM posts", EVERY)
oracle("slice_totals", f"SELECT slot * {H} AS epoch_s, CAST(sum(n) AS BIGINT) AS total FROM cells GROUP BY slot", *EVERYTHING, cells("tok"))
oracle("vocab_size", f"SELECT win * {H} AS epoch_s, v AS vocab FROM vocab_scores", *EN_FULL)
oracle(
    "slice_profile",
    f"""SELECT slot * {H} AS epoch_s, count(*) AS posts, len(list_distinct(flatten(list(summary)))) AS tokens
       FROM tok GROUP BY slot""",
    *ALL,
)
oracle("window_stats", STATS.format(time=f"win * {H} AS epoch_s", more=TRUE_MIN), *EN_FULL)
EXPANSION = """
texp AS (
  SELECT post_id, list_transform(list_filter(base, lambda t: length(t) >= 3), lambda t: lower(t)) AS toks,
         list_transform(hashtags, lambda t: lower(t)) AS ltags
  FROM tok WHERE lang = 'en' AND NOT is_repost)"""
UNIGRAM = """
back AS (
  SELECT token, n, ln(n) - ln(sum(n) OVER ()) AS log_p
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM texp) GROUP BY token))"""
oracle("unigram_model", f"SELECT token, n, {r6('log_p')} FROM back", *ALL, EXPANSION, UNIGRAM)
MODELS = """
uses AS (SELECT lang, is_repost, unnest(summary) AS token FROM tok),
fg AS (SELECT lang, token, n, ln(n) - ln(sum(n) OVER (PARTITION BY lang)) AS log_p
       FROM (SELECT lang, token, count(*) AS n FROM uses WHERE is_repost GROUP BY ALL)),
bg AS (SELECT token, n AS all_n, ln(n) - ln(sum(n) OVER ()) AS all_log_p FROM (SELECT token, count(*) AS n FROM uses GROUP BY ALL))"""
GAINS = "gains AS (SELECT lang, token, n, exp(log_p) * (log_p - all_log_p) AS gain FROM fg JOIN bg USING (token))"
oracle("kl_gain", f"SELECT lang, token, n, {r6('gain')} FROM gains", *ALL, MODELS, GAINS)
oracle("model_join", f"SELECT lang, token, n, {r6('log_p')}, all_n, {r6('all_log_p')} FROM fg JOIN bg USING (token)", *ALL, MODELS)
oracle(
    "top_gain_terms",
    f"""SELECT lang, token, n, {r6('gain')} FROM gains
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(gain, 9) DESC, token) <= 10""",
    *ALL, MODELS, GAINS,
)
EXP_MATCH = (*ALL, EXPANSION, TOPICS, "originals AS (SELECT * FROM posts WHERE lang = 'en' AND NOT is_repost)", units("originals"), relevance())
oracle(
    "top_hashtags",
    """SELECT topic_id, tag, n FROM (
         SELECT topic_id, tag, count(*) AS n FROM (SELECT topic_id, unnest(ltags) AS tag FROM scored JOIN texp USING (post_id)) GROUP BY ALL)
       WHERE n > 3 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, tag) <= 3""",
    *EXP_MATCH,
)
oracle("match_score_summary", f"SELECT topic_id, count(*) AS matches, {r6('max(score)', 'best')}, {r6('avg(score)', 'mean')} FROM scored GROUP BY topic_id", *EXP_MATCH)
oracle(
    "max_hits",
    f"""SELECT slot * {H} AS epoch_s, post_id, hits FROM (
         SELECT slot, post_id, len(list_filter(['that', 'with', 'from', 'this', 'thatin', 'anea'], lambda t: contains(lower(text), t))) AS hits
         FROM posts) QUALIFY rank() OVER (PARTITION BY slot ORDER BY hits DESC) = 1""",
    POSTS,
)
oracle(
    "score_distribution",
    f"SELECT {r6('min(score)', 'min')}, {r6('median(score)', 'median')}, {r6('avg(score)', 'mean')}, {r6('max(score)', 'max')} FROM dated",
    *TERM_SCORES,
    DATED,
)
oracle(
    "merge_burst_terms",
    f"""SELECT date, token, {r6('score')} FROM (
          SELECT 0 AS file, win * {H * 1000} AS date, token, score FROM s0 WHERE score > 0.005
          UNION ALL SELECT 1, win * {H * 1000}, token, score FROM s1 WHERE score > 0.005
          UNION ALL SELECT 2, win * {H * 1000}, token, score FROM s2 WHERE score > 0.005)
        QUALIFY row_number() OVER (PARTITION BY date, token ORDER BY file) = 1""",
    *EN,
    "t0 AS (SELECT * FROM tok WHERE NOT is_repost), t1 AS (SELECT * FROM tok WHERE is_repost)",
    cells("t0", 2, name="c0"), dense("c0", out="s0"),
    cells("t1", 2, name="c1"), dense("c1", out="s1"),
    cells("tok", 2, name="c2"), dense("c2", out="s2"),
)
HITS = r"""
raw AS (SELECT DISTINCT post_id, unnest(string_split(regexp_replace(lower(text), '[^a-zA-Z0-9\\]', ' ', 'g'), ' ')) AS token FROM posts),
listed AS (SELECT DISTINCT topic_id, unnest(tokens) AS token FROM topics)"""
oracle(
    "topic_keyword_hits",
    """SELECT post_id, topic_id, count(DISTINCT coalesce(lemma, raw.token)) AS hits
       FROM raw LEFT JOIN lemmas ON raw.token = form JOIN listed ON listed.token = coalesce(lemma, raw.token) GROUP BY ALL""",
    POSTS, TOPICS, LEMMAS, HITS,
)
oracle(
    "topic_keyword_rows",
    "SELECT post_id, topic_id, count(*) OVER (PARTITION BY post_id, topic_id) AS hits FROM raw JOIN listed USING (token)",
    POSTS, TOPICS, HITS,
)

# --- windows and scores ---------------------------------------------------------------------

oracle(
    "gap_fill",
    f"""SELECT slot * {H} AS epoch_s, CAST(coalesce(sum(n), 0) AS BIGINT) AS total
        FROM (SELECT unnest(range(lo, hi + 1)) AS slot FROM (SELECT min(slot) AS lo, max(slot) AS hi FROM posts)) LEFT JOIN cells USING (slot)
        GROUP BY slot""",
    *ALL,
    "popular AS (SELECT * FROM tok WHERE orig_repost_count >= 400)",
    cells("popular"),
)
SPAN = "span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM posts), spine AS (SELECT unnest(range(lo, hi + 1)) AS win, lo, hi FROM span)"
WINDOW_ROW = f"win * {H} AS epoch_s, greatest(win - 23, lo) * {H} AS first_s, win - greatest(win - 23, lo) + 1 AS n"
oracle("major_windows", f"SELECT {WINDOW_ROW} FROM spine WHERE win >= least(lo + 23, hi)", POSTS, SPAN)
oracle("growing_windows", f"SELECT {WINDOW_ROW}, win - lo >= 24 AS reported FROM spine", POSTS, SPAN)
oracle("burst_score", SCORE_ROWS, *EN_FULL)
oracle("user_scorer", f"SELECT win * {H} AS epoch_s, token, {r6('lead', 'score')} FROM scores", *EN_FULL)
oracle("average_score", f"SELECT win * {H} AS epoch_s, token, {r6('lead', 'score')} FROM scores", *EN_FULL)
oracle(
    "burst_score_undated",
    f"""SELECT token, {r6('raw', 'score')} FROM (
          SELECT token, abs(CASE WHEN regr_syy(y, i) > 1e-11 THEN regr_slope(y, i) * regr_r2(y, i) WHEN count(*) > 1 THEN 0 END) AS raw
          FROM (SELECT a.token, a.i, ln((a.n + 1) / (t.s + (SELECT count(*) FROM live))) AS y FROM aligned a JOIN totals t USING (i))
          GROUP BY token)""",
    *EN,
    cells("tok", 1, least=3),
    """live AS (SELECT token, greatest(min(first), max(hi) - 29) AS start, max(hi) AS hi FROM (
         SELECT token, min(slot) OVER (PARTITION BY token) AS first, hi, slot FROM cells, span_cells) WHERE slot > hi - 30 GROUP BY token)""",
    """aligned AS (SELECT g.token, g.i, coalesce(c.n, 0) AS n
         FROM (SELECT token, start, unnest(range(0, hi - start + 1)) AS i FROM live) g
         LEFT JOIN cells c ON c.token = g.token AND c.slot = g.start + g.i)""",
    "totals AS (SELECT i, sum(n) AS s FROM aligned GROUP BY i)",
)
oracle(
    "minmax_normalise",
    f"""SELECT win * {H} AS epoch_s, token, round(CASE WHEN max(score) OVER w > min(score) OVER w
          THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 6) + 0.0 AS score
        FROM scores WINDOW w AS (PARTITION BY win)""",
    *EN_SCORES,
)
oracle(
    "burst_ranges",
    f"""SELECT min(slot) * {H} AS first_s, max(slot) * {H} AS last_s FROM (
          SELECT slot, slot - row_number() OVER (ORDER BY slot) AS island FROM (
            SELECT DISTINCT unnest(range(greatest(win - 3, lo), win + 1)) AS slot FROM scores, span_cells WHERE score > 0.05))
        GROUP BY island""",
    *EN_CELLS,
    dense(major=12),
)
oracle(
    "daily_cap",
    f"""SELECT lang AS topic_id, post_id, {EPOCH_S} AS time FROM posts
        QUALIFY row_number() OVER (PARTITION BY lang, date_trunc('day', created_at) ORDER BY time, post_id) <= 11""",
    POSTS,
)
oracle(
    "shift_join",
    f"""SELECT a.slot * {H} AS epoch_s, a.total, b.total AS total_before FROM filled a LEFT JOIN filled b ON b.slot = a.slot - 2""",
    *ALL,
    cells("tok"),
    """filled AS (SELECT slot, CAST(coalesce(sum(n), 0) AS BIGINT) AS total
         FROM (SELECT unnest(range(lo, hi + 1)) AS slot FROM span_cells) LEFT JOIN cells USING (slot) GROUP BY slot)""",
)

# --- matching and selection -----------------------------------------------------------------

REACH = 25
oracle(
    "term_post_join",
    f"""SELECT win * {H} AS epoch_s, post_id, count(*) AS hits
        FROM kept JOIN terms ON slot BETWEEN win - {REACH - 1} AND win AND contains(lower(text), token) GROUP BY ALL""",
    *EN_SCORES,
    terms(),
)
oracle(
    "term_post_join_tokens",
    f"""SELECT win * {H} AS epoch_s, post_id, count(*) AS hits
        FROM tok JOIN terms ON slot BETWEEN win - {REACH - 1} AND win AND list_contains(summary, token) GROUP BY ALL""",
    *EN_SCORES,
    terms(),
)
oracle("topic_assign", "SELECT post_id, string_agg(topic_id, '+' ORDER BY topic_id) AS topic FROM scored GROUP BY post_id", *MATCH)
oracle(
    "topic_assign_tokens",
    """SELECT post_id, string_agg(topic_id, '+' ORDER BY topic_id) AS topic FROM posts, topics
       WHERE len(list_filter(tokens, lambda t: contains(lower(text), t))) > 0 GROUP BY post_id""",
    POSTS,
    TOPICS,
)
oracle("unseen_only", "SELECT post_id FROM posts WHERE post_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", POSTS)
oracle("gate_posts", "SELECT post_id FROM posts WHERE post_id IN (SELECT doc_id FROM labels WHERE quality = 1)", POSTS)
oracle(
    "gate_run",
    "SELECT 'MB226' || chr(9) || '6' || lpad(CAST(post_id AS VARCHAR), 17, '0') || chr(9) || 'run1' AS value FROM posts WHERE post_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    POSTS,
)
oracle(
    "novelty_join",
    f"SELECT id AS post_id, CASE WHEN sim >= 0.3 THEN {r6('sim').replace(' AS sim', '')} ELSE 0.0 END AS sim FROM sims",
    *ALL,
    "rows_ AS (SELECT post_id AS id, 0 AS grp, (created_at, post_id) AS pos, summary AS toks FROM tok)",
    sims("rows_"),
)
oracle("top_terms", SCORE_ROWS + " QUALIFY row_number() OVER (PARTITION BY win ORDER BY round(scores.score, 9) DESC, token) <= 20", *EN_FULL)
oracle(
    "top_relevant_with_ties",
    """SELECT topic_id, post_id, score FROM (SELECT topic_id, post_id, round(score, 3) AS score FROM scored)
       QUALIFY rank() OVER (PARTITION BY topic_id ORDER BY score DESC) <= 20""",
    *EXP_MATCH,
)
oracle(
    "select_least_similar",
    """SELECT topic_id, win, post_id FROM grouped JOIN sims USING (id) WHERE sim <= 0.3
       QUALIFY row_number() OVER (PARTITION BY topic_id, win ORDER BY sim, created_at, post_id) <= 5""",
    POSTS, KEPT, TOPICS, units("kept"), relevance(), tokens("kept"),
    f"""grouped AS (SELECT topic_id, slot // 24 AS win, post_id, created_at, topic_id || ' ' || post_id AS id,
         topic_id || ' ' || (slot // 24) AS grp, (created_at, post_id) AS pos, summary AS toks FROM scored JOIN tok USING (post_id))""",
    sims("grouped"),
)
oracle(
    "select_most_similar_first",
    """SELECT win, id AS post_id FROM rows_ JOIN sims USING (id) WHERE sim <= 0.3
       QUALIFY row_number() OVER (PARTITION BY win ORDER BY sim DESC, created_at, id) <= 5""",
    *ALL,
    "rows_ AS (SELECT post_id AS id, slot // 6 AS win, created_at, 0 AS grp, (created_at, post_id) AS pos, summary AS toks FROM tok)",
    sims("rows_"),
)
oracle("sort_by_time", "SELECT post_id, epoch_us(created_at) AS micros FROM posts ORDER BY micros, post_id", POSTS)

# --- set operations -------------------------------------------------------------------------

oracle(
    "union_windows",
    f"""SELECT slot * {H} AS epoch_s, token, count(DISTINCT user_id) AS n
        FROM (SELECT is_repost, slot, user_id, unnest(summary) AS token FROM tok) GROUP BY is_repost, slot, token""",
    *ALL,
)
oracle(
    "merge_slice_maps",
    """SELECT token, string_agg(day || ':' || n, '|' ORDER BY day) AS by_slot FROM (
         SELECT slot // 24 AS day, token, count(DISTINCT user_id) AS n FROM (SELECT slot, user_id, unnest(summary) AS token FROM tok) GROUP BY ALL)
       GROUP BY token""",
    *ALL,
)
oracle(
    "new_gated_ids",
    """SELECT post_id FROM hit WHERE post_id IN (SELECT doc_id FROM labels WHERE quality = 1)
       AND post_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    POSTS, TOPICS, KEYWORDS3.format(cond="TRUE"),
)
oracle("distinct_tokens", "SELECT DISTINCT unnest(summary) AS token FROM tok", *ALL)
oracle("distinct_slices", f"SELECT DISTINCT (slot + unnest([0, 1, 2])) * {H} AS epoch_s FROM posts", EVERY)

# --- adaptive thresholds --------------------------------------------------------------------

oracle(
    "adaptive_threshold",
    f"""SELECT topic_id, win * {H} AS epoch_s, bursts, {r6('before', 'old_threshold')}, {r6('after_', 'new_threshold')}
        FROM walk WHERE step > 0 AND before <> after_""",
    RECURSIVE,
    *topic_dense(),
    """steps AS (SELECT topic_id, win, row_number() OVER (PARTITION BY topic_id ORDER BY win) AS step,
         list(score) FILTER (length(token) >= 4) AS found FROM tscores GROUP BY topic_id, win)""",
    """walk AS (
         SELECT DISTINCT topic_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS win, CAST(0 AS BIGINT) AS bursts,
                CAST(0.03 AS DOUBLE) AS before, CAST(0.03 AS DOUBLE) AS after_, CAST(0 AS BIGINT) AS quiet FROM steps
         UNION ALL
         SELECT topic_id, step, win, n, thr,
                CASE WHEN n > 10 THEN pow(thr, 0.75)
                     WHEN quiet_now >= 6 AND step > 6 AND pow(thr, 1 / 0.75) >= 0.03 - 1e-12 THEN pow(thr, 1 / 0.75) ELSE thr END, quiet_now
         FROM (SELECT *, CASE WHEN n = 0 THEN quiet + 1 ELSE 0 END AS quiet_now
               FROM (SELECT s.topic_id, s.step, s.win, w.after_ AS thr, w.quiet,
                            coalesce(len(list_filter(s.found, lambda x: x > w.after_)), 0) AS n
                     FROM walk w JOIN steps s ON s.topic_id = w.topic_id AND s.step = w.step + 1)))""",
)
oracle(
    "repost_escalation",
    f"""SELECT topic_id, slot, posts, {r6('before', 'old_threshold')}, {r6('after_', 'new_threshold')} FROM walk
        WHERE step > 0 AND before <> after_""",
    RECURSIVE,
    *MATCH,
    """steps AS (SELECT topic_id, p.slot // 24 AS slot, row_number() OVER (PARTITION BY topic_id ORDER BY p.slot // 24) AS step,
         list(orig_repost_count) AS found FROM scored JOIN posts p USING (post_id) GROUP BY topic_id, p.slot // 24)""",
    """walk AS (
         SELECT DISTINCT topic_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS slot, CAST(0 AS BIGINT) AS posts,
                CAST(5 AS DOUBLE) AS before, CAST(5 AS DOUBLE) AS after_ FROM steps
         UNION ALL
         SELECT topic_id, step, slot, n, thr, CASE WHEN n > 10 THEN thr * 4 ELSE thr END
         FROM (SELECT s.topic_id, s.step, s.slot, w.after_ AS thr, len(list_filter(s.found, lambda x: x >= w.after_)) AS n
               FROM walk w JOIN steps s ON s.topic_id = w.topic_id AND s.step = w.step + 1))""",
)

oracle(
    "write_threshold_log",
    f"""SELECT topic_id, bursts AS passing, {r6('before', 'old_threshold')}, {r6('after_', 'new_threshold')}, win * {H * 1000} AS epoch_ms
        FROM walk WHERE step > 0 AND before <> after_""",
    RECURSIVE,
    *topic_dense(),
    """steps AS (SELECT topic_id, win, row_number() OVER (PARTITION BY topic_id ORDER BY win) AS step,
         list(score) FILTER (length(token) >= 4) AS found FROM tscores GROUP BY topic_id, win)""",
    """walk AS (
         SELECT DISTINCT topic_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS win, CAST(0 AS BIGINT) AS bursts,
                CAST(0.03 AS DOUBLE) AS before, CAST(0.03 AS DOUBLE) AS after_, CAST(0 AS BIGINT) AS quiet FROM steps
         UNION ALL
         SELECT topic_id, step, win, n, thr,
                CASE WHEN n > 10 THEN pow(thr, 0.75)
                     WHEN quiet_now >= 6 AND step > 6 AND pow(thr, 1 / 0.75) >= 0.03 - 1e-12 THEN pow(thr, 1 / 0.75) ELSE thr END, quiet_now
         FROM (SELECT *, CASE WHEN n = 0 THEN quiet + 1 ELSE 0 END AS quiet_now
               FROM (SELECT s.topic_id, s.step, s.win, w.after_ AS thr, w.quiet,
                            coalesce(len(list_filter(s.found, lambda x: x > w.after_)), 0) AS n
                     FROM walk w JOIN steps s ON s.topic_id = w.topic_id AND s.step = w.step + 1)))""",
)
oracle(
    "repost_escalation_long",
    f"""SELECT topic_id, slot, posts, {r6('before', 'old_threshold')}, {r6('after_', 'new_threshold')} FROM walk
        WHERE step > 0 AND before <> after_""",
    RECURSIVE,
    f"""events_ AS (SELECT CAST(floor(epoch(ts) / {12 * H}) AS BIGINT) AS slot, CAST(pow(2, CAST(floor(value * 10) AS BIGINT) % 45) AS BIGINT) AS reach FROM events)""",
    """steps AS (SELECT 'T' AS topic_id, slot, row_number() OVER (ORDER BY slot) AS step, list(reach) AS found FROM events_ GROUP BY slot)""",
    """walk AS (
         SELECT DISTINCT topic_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS slot, CAST(0 AS BIGINT) AS posts,
                CAST(1 AS DOUBLE) AS before, CAST(1 AS DOUBLE) AS after_ FROM steps
         UNION ALL
         SELECT topic_id, step, slot, n, thr, CASE WHEN n > 10 THEN thr * 2 ELSE thr END
         FROM (SELECT s.topic_id, s.step, s.slot, w.after_ AS thr, len(list_filter(s.found, lambda x: x >= w.after_)) AS n
               FROM walk w JOIN steps s ON s.topic_id = w.topic_id AND s.step = w.step + 1))""",
)

# --- jobs -----------------------------------------------------------------------------------


def summary_parts(source: str) -> tuple[str, ...]:
    """From ``tok`` and ``terms`` to the chosen posts (post_id, win)."""
    return (
        f"""cand AS (SELECT t.post_id AS id, 0 AS grp, any_value(created_at) AS created_at, min(win) AS win, any_value(summary) AS toks,
              (min(win), -epoch_us(any_value(created_at)), t.post_id) AS pos
              FROM {source} t JOIN terms ON slot BETWEEN win - {REACH - 1} AND win AND contains(lower(text), token)
              WHERE len(summary) >= 3 GROUP BY t.post_id)""",
        sims("cand"),
        """chosen AS (SELECT id AS post_id, win FROM cand JOIN sims USING (id) WHERE sim <= 0.5
              QUALIFY row_number() OVER (PARTITION BY win ORDER BY sim DESC, created_at, id) <= 5)""",
    )


oracle(
    "topical_burst_summary",
    f"""SELECT string_agg(topic_id, '+' ORDER BY topic_id) AS topic, win * {H} AS epoch_s, post_id, any_value(text) AS text
        FROM chosen JOIN scored USING (post_id) JOIN kept USING (post_id) GROUP BY win, post_id""",
    POSTS, KEPT, TOPICS, units("kept"), relevance(),
    "topical AS (SELECT * FROM kept WHERE post_id IN (SELECT post_id FROM scored))",
    tokens("topical"), cells("tok", 2, least=3), dense(), terms(), *summary_parts("tok"),
)
oracle(
    "open_domain_summary",
    f"SELECT 'OPEN_DOMAIN' AS topic, win * {H} AS epoch_s, post_id, text FROM chosen JOIN kept USING (post_id)",
    *EN_SCORES, terms(), *summary_parts("tok"),
)
oracle(
    "batch_post_finder",
    f"""SELECT string_agg(topic_id, '+' ORDER BY topic_id) AS topic, win * {H} AS epoch_s, post_id, any_value(text) AS text
        FROM chosen JOIN topical USING (post_id) JOIN topics ON len(list_filter(topics.tokens, lambda t: contains(lower(text), t))) > 0
        GROUP BY win, post_id""",
    *TERM_SCORES, terms(), *summary_parts("tok"),
)
oracle(
    "gated_burst_posts",
    f"""SELECT min(win) * {H} AS epoch_s, post_id FROM tok JOIN terms ON slot BETWEEN win - {REACH - 1} AND win AND contains(lower(text), token)
        WHERE len(summary) >= 3 AND post_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY post_id""",
    POSTS, TOPICS, KEYWORDS3.format(cond="TRUE"),
    "english AS (SELECT * FROM hit WHERE lang = 'en')",
    tokens("english"), cells("tok", 2, least=3), dense(), terms(k=1_000_000_000),
)
LEARN = (POSTS, "originals AS (SELECT * FROM posts WHERE NOT is_repost AND length(text) > 0)", tokens("originals"))
oracle("learn_term_scores", SCORE_ROWS, *LEARN, cells("tok", 2, by="post_id", column="learner", name="wide"),
       "span_cells AS (SELECT lo, hi - 1 AS hi FROM span_wide), cells AS (SELECT wide.* FROM wide, span_cells WHERE slot <= hi)", dense(emit="full"))
oracle("learn_window_stats", STATS.format(time=f"win * {H} AS epoch_s", more=TRUE_MIN), *LEARN, cells("tok", 2, by="post_id", column="base", name="wide"),
       "span_cells AS (SELECT lo, hi - 1 AS hi FROM span_wide), cells AS (SELECT wide.* FROM wide, span_cells WHERE slot <= hi)", dense(emit="full"))
oracle(
    "expand_topics",
    """SELECT topic_id, topics.query, coalesce(total, 0) AS matches, expanded_query
       FROM topics LEFT JOIN totals USING (topic_id) LEFT JOIN (
         SELECT topic_id, array_to_string(list_filter(ts, lambda t, i: list_position(ts, t) = i), ' OR ') AS expanded_query
         FROM (SELECT topic_id, list(text ORDER BY kind, rank, text) AS ts FROM parts GROUP BY topic_id)) USING (topic_id)""",
    *EXP_MATCH, UNIGRAM,
    "good AS (SELECT * FROM scored WHERE score > 0.004)",
    "totals AS (SELECT topic_id, count(*) AS total FROM good GROUP BY topic_id)",
    "usable AS (SELECT good.* FROM good JOIN totals USING (topic_id) WHERE total >= 20)",
    "best AS (SELECT * FROM usable QUALIFY rank() OVER (PARTITION BY topic_id ORDER BY score DESC) <= 50)",
    """fore AS (SELECT topic_id, token, n, ln(n) - ln(sum(n) OVER (PARTITION BY topic_id)) AS log_p FROM (
         SELECT topic_id, token, count(*) AS n FROM (SELECT topic_id, unnest(toks) AS token FROM best JOIN texp USING (post_id)) GROUP BY ALL))""",
    """gain AS (SELECT topic_id, token, round(exp(fore.log_p) * (fore.log_p - back.log_p), 9) AS g FROM fore JOIN back USING (token)
         QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY g DESC, token) <= 10)""",
    """tags AS (SELECT * FROM (SELECT topic_id, tag, count(*) AS n FROM (
         SELECT topic_id, unnest(ltags) AS tag FROM usable JOIN texp USING (post_id)) GROUP BY ALL) WHERE n > 3 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, tag) <= 3)""",
    """parts AS (SELECT topic_id, 0 AS kind, -g AS rank, token AS text FROM gain
         UNION ALL SELECT topic_id, 1, -n, '#' || tag FROM tags)""",
)


def dirty_run(task: str) -> tuple[str, ...]:
    fields = (
        "topic || ' ' || number || ' ' || time || ' ' || tag"
        if task == "a"
        else "array_to_string([date, topic, q0, number, '1', '1.0', tag], chr(9))"
    )
    return (
        POSTS,
        """made AS (SELECT *, 'MB' || lpad(CAST(user_id * 3 + 220 AS VARCHAR), 3, '0') AS topic,
             CASE WHEN orig_repost_count < 10 THEN lpad(CAST(post_id AS VARCHAR), 17, '1') ELSE '6' || lpad(CAST(post_id AS VARCHAR), 17, '0') END AS number,
             CASE WHEN lang = 'fr' THEN 'run-2' ELSE 'run-1' END AS tag, 1437350000 + orig_repost_count * 3000 AS time,
             CASE WHEN source = 'src7' THEN '2015-07-20' ELSE '201507' || lpad(CAST(user_id + 5 AS VARCHAR), 2, '0') END AS date,
             CASE WHEN source = 'src5' THEN 'Q1' ELSE 'Q0' END AS q0 FROM posts)""",
        f"""lines AS (SELECT post_id * 2 + copy AS line_no,
             CASE WHEN source = 'src3' THEN topic || ' ' || number ELSE {fields} END AS value
             FROM (SELECT *, unnest(CASE WHEN is_repost THEN [0, 1] ELSE [0] END) AS copy FROM made))""",
    )


def run_check(task: str, first_topic: int = 226) -> tuple[str, ...]:
    width = 4 if task == "a" else 7
    names = ["topic", "id", "time", "tag"] if task == "a" else ["date", "topic", "q0", "id", "rank", "score", "tag"]
    picks = ", ".join(f"f[{i + 1}] AS {n}" for i, n in enumerate(names))
    if task == "a":
        late = "WHEN CAST(time AS BIGINT) < 1437350400 OR CAST(time AS BIGINT) > 1438214399 THEN 'time'"
    else:
        late = r"""WHEN regexp_extract(date, '\d{8}') = '' THEN 'date_format'
             WHEN left(regexp_extract(date, '\d{8}'), 4) <> '2015' THEN 'year'
             WHEN substring(regexp_extract(date, '\d{8}'), 5, 2) <> '07' THEN 'month'
             WHEN CAST(substring(regexp_extract(date, '\d{8}'), 7, 2) AS INT) NOT BETWEEN 20 AND 29 THEN 'day'"""
    return (
        *dirty_run(task),
        r"split AS (SELECT line_no, regexp_split_to_array(trim(value), '\s+') AS f FROM lines)",
        f"named AS (SELECT line_no, len(f) AS width, {picks} FROM split)",
        f"""early AS (SELECT *, CASE WHEN width <> {width} THEN 'fields'
             WHEN line_no = (SELECT min(line_no) FROM named WHERE width = {width}) AND NOT regexp_matches(tag, '^[A-Za-z0-9_.-]{{1,15}}$') THEN 'malformed_tag'
             WHEN tag <> (SELECT arg_min(f[{width}], line_no) FROM split WHERE len(f) = {width}) THEN 'other_tag'
             WHEN topic NOT IN (SELECT 'MB' || unnest(range({first_topic}, 451))) THEN 'unknown_topic'
             WHEN NOT regexp_matches(id, '^[0-9]{{18}}$') THEN 'unknown_id' END AS err FROM named)""",
        """dup AS (SELECT *, err IS NULL AND row_number() OVER (PARTITION BY topic, id, err IS NULL ORDER BY line_no) > 1 AS again FROM early)""",
        f"checked AS (SELECT *, CASE WHEN err IS NOT NULL THEN err WHEN again THEN 'duplicate' {late} END AS error FROM dup)",
    )


oracle("validate_run", "SELECT line_no, error FROM checked", *run_check("a"))
oracle(
    "validate_run_daily",
    """SELECT line_no, error, coalesce(line_no = (SELECT min(line_no) FROM checked WHERE err IS NULL AND NOT again AND q0 <> 'Q0'), false) AS q0_warning
       FROM checked""",
    *run_check("b"),
)
oracle(
    "validate_run_caps",
    "SELECT topic, count(*) AS rows, 'warning' AS level FROM checked WHERE error IS NULL GROUP BY topic HAVING count(*) > 1",
    *run_check("a", 200),
)
oracle(
    "merge_near_duplicates",
    """SELECT arrival, feed, topic, post_id FROM feeds
       WHERE seq NOT IN (SELECT unnest(rejected) FROM (SELECT rejected FROM walk ORDER BY step DESC LIMIT 1))""",
    RECURSIVE,
    """feeds AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY arrival, feed, topic, post_id) AS seq,
         list_distinct(string_split(lower(regexp_replace(text, '[[:punct:]]', '', 'g')), ' ')) AS ts FROM (
         SELECT doc_id * 3 AS arrival, 'docs' AS feed, lang AS topic, doc_id AS post_id, text FROM documents
         UNION ALL SELECT conv_id * 3 + 1, 'turn' || turn, role, conv_id, text FROM conversations
         UNION ALL SELECT item_id * 3 + 2, 'items', 'en', item_id, text FROM benchmark))""",
    "flat AS MATERIALIZED (SELECT seq, len(ts) AS size, unnest(ts) AS token FROM feeds)",
    """near AS MATERIALIZED (SELECT a.seq, b.seq AS other FROM flat a JOIN flat b ON a.token = b.token AND b.seq < a.seq
         GROUP BY a.seq, b.seq, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.5
         UNION SELECT a.seq, b.seq FROM feeds a JOIN feeds b ON a.topic = b.topic AND a.post_id = b.post_id AND b.seq < a.seq)""",
    "barred AS MATERIALIZED (SELECT seq, list(other) AS others, row_number() OVER (ORDER BY seq) AS step FROM near GROUP BY seq)",
    """walk AS (
         SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS rejected
         UNION ALL
         SELECT b.step, CASE WHEN list_has_all(w.rejected, b.others) THEN w.rejected ELSE list_append(w.rejected, b.seq) END
         FROM walk w JOIN barred b ON b.step = w.step + 1)""",
)

# --- streams --------------------------------------------------------------------------------

# The streaming jobs apply no language filter.
ANY_LANG = """
anylang AS (
  SELECT * FROM posts
  WHERE length(text) > 0 AND NOT contains(lower(text), 'worthless') AND len(hashtags) <= 1 AND len(urls) <= 2)"""
PREPARED = (POSTS, ANY_LANG, TOPICS, units("anylang"), relevance(), tokens("anylang"),
            "prepared AS (SELECT s.topic_id, tok.* FROM scored s JOIN tok USING (post_id) WHERE score > 0 AND len(summary) >= 3)")
oracle("stream_prepare", "SELECT post_id, topic_id, len(summary) AS tokens FROM prepared", *PREPARED)


def closed(hours: int, source: str) -> str:
    """Last slot whose window has ended when the newest post less the delay is reached."""
    return f"closed AS (SELECT CAST(floor(epoch(max(created_at)) / {H}) AS BIGINT) - {hours} - 1 AS last FROM {source})"


oracle(
    "stream_term_counts",
    f"""SELECT topic_id, (slot + step) * {H} AS epoch_s, token, count(DISTINCT user_id) AS n
        FROM (SELECT topic_id, slot, user_id, unnest(summary) AS token FROM prepared), (SELECT unnest([0, 1]) AS step), closed
        WHERE slot + step <= last GROUP BY topic_id, slot + step, token""",
    *PREPARED,
    closed(2, "prepared"),
)
ORACLES["stream_checkpoint"] = ORACLES["stream_term_counts"]
oracle(
    "late_data",
    f"""SELECT lang, (slot + step) * {H} AS epoch_s, token, count(DISTINCT user_id) AS n
        FROM (SELECT lang, slot, user_id, unnest(base) AS token FROM tok), (SELECT unnest([0, 1]) AS step), closed
        WHERE slot + step <= last GROUP BY lang, slot + step, token""",
    *ALL,
    closed(12, "posts"),
)
CLOSED_CELLS = (*EN, closed(2, "kept"), cells("tok", 2, name="wide"),
                "cells AS (SELECT wide.* FROM wide, closed WHERE slot <= last)",
                "span_cells AS (SELECT greatest(min(slot), max(slot) - 23) AS lo, max(slot) AS hi FROM cells)")
oracle("stream_term_history", f"SELECT slot * {H} AS epoch_s, token, n FROM cells, closed WHERE slot > last - 51", *CLOSED_CELLS)
oracle("stream_burst_scores", SCORE_ROWS, *CLOSED_CELLS, dense(emit="full"))
oracle(
    "repost_stream",
    """SELECT topic_id, post_id, reposts FROM grouped JOIN sims USING (id) WHERE sim <= 0.5
       QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY sim, created_at, post_id) <= 5""",
    POSTS, TOPICS,
    """popular AS (SELECT * FROM posts WHERE lang = 'en' AND is_repost AND orig_repost_count >= 20 AND length(text) > 0
         AND NOT contains(lower(text), 'worthless') AND len(hashtags) <= 1 AND len(urls) <= 2)""",
    units("popular"), relevance(), tokens("popular"),
    """grouped AS (SELECT topic_id, post_id, created_at, orig_repost_count AS reposts, topic_id || ' ' || post_id AS id,
         topic_id AS grp, (created_at, post_id) AS pos, base AS toks FROM scored JOIN tok USING (post_id)
         QUALIFY rank() OVER (PARTITION BY topic_id ORDER BY orig_repost_count DESC) = 1)""",
    sims("grouped"),
)


def select_window(delivered: str) -> tuple[str, ...]:
    """Best posts of the last full half-day per topic, after ``delivered`` ids were delivered."""
    return (
        *PREPARED,
        "half AS (SELECT *, slot // 12 AS own FROM prepared)",
        "last_ AS (SELECT max(own) - 1 AS win FROM half)",
        """hcells AS (SELECT topic_id, own AS slot, token, count(DISTINCT user_id) AS n FROM (
             SELECT topic_id, own, user_id, unnest(summary) AS token FROM half, last_ WHERE own BETWEEN win - 2 AND win) GROUP BY ALL)""",
        "htotal AS (SELECT topic_id, slot, sum(n) AS s FROM hcells GROUP BY ALL)",
        "hseen AS (SELECT topic_id, token, count(*) OVER (PARTITION BY topic_id) AS v FROM (SELECT DISTINCT topic_id, token FROM hcells))",
        """hseries AS (SELECT h.topic_id, h.token, i, ln((coalesce(c.n, 0) + 1) / (coalesce(t.s, 0) + v)) AS y
             FROM hseen h, (SELECT unnest([0, 1, 2]) AS i), last_
             LEFT JOIN hcells c ON c.topic_id = h.topic_id AND c.token = h.token AND c.slot = win - 2 + i
             LEFT JOIN htotal t ON t.topic_id = h.topic_id AND t.slot = win - 2 + i)""",
        """hterms AS (SELECT topic_id, token FROM (
             SELECT topic_id, token, abs(CASE WHEN regr_syy(y, i) > 1e-11 THEN regr_slope(y, i) * regr_r2(y, i) ELSE 0 END) AS score
             FROM hseries GROUP BY ALL) WHERE score > 0.2 AND length(token) >= 4
             QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, token) <= 100)""",
        f"memory AS (SELECT topic_id, post_id, summary FROM half WHERE post_id IN ({delivered}))",
        """best AS (SELECT topic_id, post_id, any_value(created_at) AS created_at, any_value(summary) AS summary, count(*) AS hits
             FROM half JOIN last_ ON own = win JOIN hterms USING (topic_id) WHERE contains(lower(text), token) GROUP BY ALL
             )""",
        "most AS (SELECT * FROM best QUALIFY rank() OVER (PARTITION BY topic_id ORDER BY hits DESC) = 1)",
        """grouped AS (
             SELECT topic_id || ' ' || post_id AS id, topic_id AS grp, (1, created_at, post_id) AS pos, summary AS toks FROM most
             WHERE (topic_id, post_id) NOT IN (SELECT (topic_id, post_id) FROM memory)
             UNION ALL SELECT topic_id || ' ' || post_id, topic_id, (0, NULL, post_id), summary FROM memory)""",
        sims("grouped"),
    )


# Every half-day window of the burst job: scores by dense regression, thresholds and deliveries walked window by window.
BURST_WINDOWS = (
    *PREPARED,
    "half AS (SELECT *, slot // 12 AS own FROM prepared)",
    "bwins AS (SELECT unnest(range(min(own) + 2, max(own))) AS win FROM half)",
    """bcells AS (SELECT topic_id, own AS slot, token, count(DISTINCT user_id) AS n
         FROM (SELECT topic_id, own, user_id, unnest(summary) AS token FROM half) GROUP BY ALL)""",
    "btotal AS (SELECT topic_id, slot, sum(n) AS s FROM bcells GROUP BY ALL)",
    "bpairs AS (SELECT DISTINCT topic_id, win, token FROM bcells JOIN bwins ON slot BETWEEN win - 2 AND win)",
    "bseen AS (SELECT *, count(*) OVER (PARTITION BY topic_id, win) AS v FROM bpairs)",
    """bseries AS (SELECT h.topic_id, h.win, h.token, i, ln((coalesce(c.n, 0) + 1) / (coalesce(t.s, 0) + v)) AS y
         FROM bseen h, (SELECT unnest([0, 1, 2]) AS i)
         LEFT JOIN bcells c ON c.topic_id = h.topic_id AND c.token = h.token AND c.slot = win - 2 + i
         LEFT JOIN btotal t ON t.topic_id = h.topic_id AND t.slot = win - 2 + i)""",
    """bscores AS MATERIALIZED (SELECT topic_id, win, token,
         abs(CASE WHEN regr_syy(y, i) > 1e-11 THEN regr_slope(y, i) * regr_r2(y, i) ELSE 0 END) AS score
         FROM bseries GROUP BY ALL)""",
    """steps AS MATERIALIZED (SELECT topic_id, win, row_number() OVER (PARTITION BY topic_id ORDER BY win) AS step,
         list(score) FILTER (length(token) >= 4) AS found FROM bscores GROUP BY topic_id, win)""",
    """walk AS (
         SELECT DISTINCT topic_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS win, CAST(0 AS BIGINT) AS bursts,
                CAST(0.2 AS DOUBLE) AS before, CAST(0.2 AS DOUBLE) AS after_, CAST(0 AS BIGINT) AS quiet FROM steps
         UNION ALL
         SELECT topic_id, step, win, n, thr,
                CASE WHEN n > 10 THEN pow(thr, 0.75)
                     WHEN quiet_now >= 9 AND step > 9 AND pow(thr, 1 / 0.75) >= 0.2 - 1e-12 THEN pow(thr, 1 / 0.75) ELSE thr END, quiet_now
         FROM (SELECT *, CASE WHEN n = 0 THEN quiet + 1 ELSE 0 END AS quiet_now
               FROM (SELECT s.topic_id, s.step, s.win, w.after_ AS thr, w.quiet,
                            coalesce(len(list_filter(s.found, lambda x: x > w.after_)), 0) AS n
                     FROM walk w JOIN steps s ON s.topic_id = w.topic_id AND s.step = w.step + 1)))""",
    """bterms AS MATERIALIZED (SELECT topic_id, win, token, score, before AS threshold FROM bscores JOIN walk USING (topic_id, win)
         WHERE score > before AND length(token) >= 4
         QUALIFY row_number() OVER (PARTITION BY topic_id, win ORDER BY round(score, 9) DESC, token) <= 100)""",
)
BURST_DELIVERIES = (
    *BURST_WINDOWS,
    """bhits AS (SELECT topic_id, win, post_id, any_value(created_at) AS created_at, any_value(list_distinct(summary)) AS ts, count(*) AS hits
         FROM half JOIN bterms USING (topic_id) WHERE own = win AND contains(lower(text), token) GROUP BY ALL)""",
    """bbest AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY topic_id, win, created_at, post_id) AS pos FROM bhits
         QUALIFY rank() OVER (PARTITION BY topic_id, win ORDER BY hits DESC) = 1)""",
    "bflat AS (SELECT topic_id, win, pos, len(ts) AS size, unnest(ts) AS token FROM bbest)",
    """bnear AS (SELECT a.pos, b.pos AS other, a.win = b.win AS together, count(*) / (a.size + b.size - count(*)) AS sim
         FROM bflat a JOIN bflat b ON a.token = b.token AND a.topic_id = b.topic_id AND b.pos < a.pos
         GROUP BY a.pos, b.pos, a.win = b.win, a.size, b.size)""",
    """bcands AS (SELECT b.pos, any_value(topic_id) AS topic_id, any_value(win) AS win, any_value(post_id) AS post_id, any_value(hits) AS hits,
         any_value(created_at) AS made, coalesce(max(sim) FILTER (together), 0) AS inside,
         coalesce(list({'other': other, 'sim': sim}) FILTER (NOT together), []) AS others
         FROM bbest b LEFT JOIN bnear n ON n.pos = b.pos GROUP BY b.pos)""",
    """bsteps AS MATERIALIZED (SELECT topic_id, win, row_number() OVER (PARTITION BY topic_id ORDER BY win) AS step,
         list({'pos': pos, 'post_id': post_id, 'hits': hits, 'made': made, 'inside': inside, 'others': others}) AS cands
         FROM bcands GROUP BY topic_id, win)""",
    """given AS (
         SELECT DISTINCT topic_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS win, CAST([] AS BIGINT[]) AS past,
           CAST([] AS STRUCT(sim DOUBLE, made TIMESTAMP, post_id BIGINT, pos BIGINT, hits BIGINT)[]) AS chosen FROM bsteps
         UNION ALL
         SELECT topic_id, step, win, list_concat(past, list_transform(chosen, lambda c: c.pos)), chosen
         FROM (SELECT s.topic_id, s.step, s.win, g.past,
             list_slice(list_sort(list_filter(list_transform(s.cands, lambda c: {
               'sim': CAST(greatest(c.inside, coalesce(list_max(list_transform(list_filter(c.others, lambda o: list_contains(g.past, o.other)), lambda o: o.sim)), 0)) AS DOUBLE),
               'made': c.made, 'post_id': c.post_id, 'pos': c.pos, 'hits': c.hits}), lambda c: c.sim <= 0.5)), 1, 30) AS chosen
           FROM given g JOIN bsteps s ON s.topic_id = g.topic_id AND s.step = g.step + 1))""",
)
oracle(
    "burst_stream",
    f"""SELECT topic_id, win, chosen.post_id AS post_id, chosen.hits AS hits, {r6('chosen.sim', 'sim')}
        FROM (SELECT topic_id, win, unnest(chosen) AS chosen FROM given WHERE step > 0)""",
    RECURSIVE,
    *BURST_DELIVERIES,
)
oracle("burst_stream_terms", f"SELECT topic_id, win, token, {r6('score')}, {r6('threshold')} FROM bterms", RECURSIVE, *BURST_WINDOWS)
oracle(
    "burst_stream_thresholds",
    f"""SELECT topic_id, bursts AS passing, {r6('before', 'old_threshold')}, {r6('after_', 'new_threshold')}, win * {12 * H * 1000} AS epoch_ms
        FROM walk WHERE step > 0 AND before <> after_""",
    RECURSIVE,
    *BURST_WINDOWS,
)

for _name, _ids in (("stream_select", "SELECT doc_id FROM labels WHERE quality > 1"), ("stream_novelty_memory", "SELECT doc_id FROM labels WHERE quality = 1")):
    oracle(
        _name,
        f"""SELECT m.topic_id, win, m.post_id, hits, {r6('sim')} FROM most m, last_ JOIN sims ON sims.id = m.topic_id || ' ' || m.post_id
            WHERE sim <= 0.5 AND (m.topic_id, m.post_id) NOT IN (SELECT (topic_id, post_id) FROM memory)
            QUALIFY row_number() OVER (PARTITION BY m.topic_id ORDER BY sim, created_at, m.post_id) <= 30""",
        *select_window(_ids),
    )
