"""The registered queries: every operator over the whole test tables.

Times are epoch numbers and scores are rounded to six places, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.conf import BurstConf
from emberline.functions import similarity, text as X, timeslice as TS
from emberline.operators import counts as C, expand, filters as P, folds, matching as M, merge, runs, scores as S, select as L
from emberline.operators import novelty as N, windows as W
from emberline.operators.sizing import parts_for
from emberline.plans import jobs as J
from emberline.sources import posts as IN, sinks, terms as TERMS, topics as TOPICS
from emberline.sources.scratch import scratch_path, stage
from emberline.sources.tables import full_parts, posts_from_tables, spread_small, table
from emberline.streaming import jobs as STREAM, prepare as PREP
from emberline.streaming.state import keyed_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

HOUR = 3600
CONF = BurstConf(
    width=HOUR,
    minor=2,
    major=24,
    per_window_max=5,
    max_hashtags=1,
    spam_terms=("worthless",),
    match_threshold=0.004,
    min_post_count=20,
    min_hashtag_count=3,
    max_relevant_posts=50,
    repost_threshold=20,
)
TOPIC_ROWS = [
    ("T1", "from OR thre", ["that", "with"]),
    ("T2", "ther OR tion OR thon", ["this", "from", "rewh"]),
    ("T3", "anea OR erin", ["orre", "thatin"]),
    ("T4", '"from the" OR ononst', ["ononst", "in the"]),
    ("T5", "#purchase OR mail3", ["mail3"]),
]


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def topics(spark) -> DataFrame:
    return TOPICS.topics_frame(spark, TOPIC_ROWS)


def posts(spark, folder) -> DataFrame:
    return posts_from_tables(spark, folder)


def kept(spark, folder) -> DataFrame:
    return P.summary_filters(posts(spark, folder), CONF)


def tokenised(spark, folder, style="summary") -> DataFrame:
    return posts(spark, folder).withColumn("tokens", X.post_tokens(style))


def slotted(spark, folder, minor=1, style="summary") -> DataFrame:
    return C.with_slots(tokenised(spark, folder, style), HOUR, minor)


def every_post(spark, folder, style="summary", dealt=False) -> DataFrame:
    """All events as posts, with tokens and own slots.

    ``dealt`` brings the posts of a slot together, as texts, which are shorter than their tokens.
    """
    rows = C.with_slots(posts_from_tables(spark, folder, every_event=True), HOUR)
    return (rows.repartition(full_parts(spark), "slot") if dealt else rows).withColumn("tokens", X.post_tokens(style))


def r6(column) -> F.Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)


def scored(df: DataFrame, *names: str) -> DataFrame:
    names = names or ("score",)
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


def joined(column: str, sep: str = "|") -> F.Column:
    return F.array_join(column, sep)


def epoch(slot: str = "win") -> F.Column:
    return (F.col(slot) * HOUR).alias("epoch_s")


def labels_where(spark, folder, condition) -> DataFrame:
    return table(spark, folder, "labels").filter(condition).select(F.col("doc_id").alias("post_id"))


def en_counts(spark, folder, **changes):
    """Staged counts of the filtered posts."""
    conf = CONF.with_(**changes)
    return J.window_counts(kept(spark, folder), conf, min_tokens=conf.min_tokens)


def en_scores(spark, folder, emit="warm", scorer="regression", **changes) -> DataFrame:
    cells, lo, hi = en_counts(spark, folder, **changes)
    return S.burst_scores(cells, lo, hi, CONF.major, emit, scorer)


# --- sources and sinks ----------------------------------------------------------------------

def post_file(spark, folder) -> str:
    path = scratch_path(spark, "posts-json")
    IN.post_lines(posts(spark, folder)).write.text(path)
    return path


def post_view(df: DataFrame) -> DataFrame:
    return df.select(
        "post_id",
        "text",
        "lang",
        "user_id",
        TS.format_time(F.col("created_at"), "epoch_s").alias("epoch_s"),
        "is_repost",
        "orig_repost_count",
        joined("hashtags").alias("hashtags"),
        joined("mentions").alias("mentions"),
    )


@query("read_posts")
def _(spark, folder):
    return post_view(IN.read_posts(spark, post_file(spark, folder)))


@query("repartition_input")
def _(spark, folder):
    return post_view(IN.read_posts(spark, post_file(spark, folder), partitions=16))


@query("stream_posts")
def _(spark, folder):
    out = run_stream(IN.stream_posts(spark, "text", {"path": post_file(spark, folder)}))
    return post_view(out)


@query("stream_posts_kafka")
def _(spark, folder):
    """The decoding half: records in a broker's layout, value as bytes."""
    lines = spark.read.text(post_file(spark, folder))
    records = lines.select(F.lit("posts").alias("topic"), F.encode("value", "utf-8").alias("value"))
    return post_view(IN.parse_posts(records))


@query("read_topics")
def _(spark, folder):
    """Topics of the items, written as JSON array files in the three accepted shapes."""
    items = table(spark, folder, "benchmark")
    shape = F.when(F.length("text") > 700, "v1").when(F.length("text") > 400, "v2").otherwise("v3")
    words = F.array_distinct(X.match_words(F.col("text")))
    record = items.select(
        shape.alias("shape"),
        F.concat(F.lit("B"), F.col("item_id")).alias("id"),
        F.array_join(words, " OR ").alias("query"),
        words.alias("tokens"),
    )
    v1 = record.filter("shape = 'v1'").select(F.to_json(F.struct("query", F.col("id").alias("topid"), F.lit("").alias("narrative"))).alias("j"))
    v2 = record.filter("shape = 'v2'").select(F.to_json(F.struct("query", F.col("id").alias("num"), "tokens")).alias("j"))
    v3 = record.filter("shape = 'v3'").select(F.to_json(F.struct(F.col("query").alias("title"), F.col("id").alias("num"), "tokens")).alias("j"))
    path = scratch_path(spark, "topics-json")
    # One JSON array per file: a file holds one topic, so nothing gathers the whole list.
    arrays = v1.unionByName(v2).unionByName(v3).select(F.concat(F.lit("["), "j", F.lit("]")).alias("value"), F.monotonically_increasing_id().alias("part"))
    arrays.write.partitionBy("part").text(path)
    read = TOPICS.read_topics(spark, path)
    return read.select("topic_id", "query", joined("tokens").alias("tokens"))


@query("read_keywords")
def _(spark, folder):
    path = scratch_path(spark, "keywords")
    table(spark, folder, "benchmark").select(F.explode(F.split("text", r"\.")).alias("value")).write.text(path)
    return TOPICS.read_keywords(spark, path)


@query("read_candidate_ids")
def _(spark, folder):
    path = scratch_path(spark, "ids")
    labels_where(spark, folder, "quality = 1").select(F.col("post_id").cast("string").alias("value")).write.text(path)
    return TOPICS.read_ids(spark, path)


def term_file(spark, folder) -> str:
    """Bursting terms of the whole corpus, written as JSON lines."""
    path = scratch_path(spark, "terms")
    terms = J.batch_term_scores(posts(spark, folder), topics(spark), CONF, CONF.burst_threshold)
    TERMS.write_burst_terms(terms, path)
    return path


@query("read_burst_terms")
def _(spark, folder):
    return scored(TERMS.read_burst_terms(spark, term_file(spark, folder)))


@query("write_burst_terms")
def _(spark, folder):
    records = TERMS.read_burst_records(spark, term_file(spark, folder))
    return records.select("date", F.size("pairs").cast("bigint").alias("terms"), joined(F.array_sort(F.map_keys("pairs"))).alias("tokens"))


@query("write_selected")
def _(spark, folder):
    path = scratch_path(spark, "selected")
    rows = J.own_slot(kept(spark, folder), CONF).select(F.col("lang").alias("topic"), F.col("slot").alias("win"), "post_id", "text")
    sinks.write_selected(rows, path, HOUR)
    return sinks.read_selected(spark, path)


@query("write_scored_terms")
def _(spark, folder):
    path = scratch_path(spark, "scored")
    terms = L.burst_terms(en_scores(spark, folder), CONF.burst_threshold, 4, CONF.terms_per_window)
    sinks.write_scored_terms(terms, path, HOUR)
    return scored(spark.read.schema("time string, token string, score double").csv(path, escape='"'))


@query("write_window_stats")
def _(spark, folder):
    path = scratch_path(spark, "stats")
    sinks.write_window_stats(S.window_stats(en_scores(spark, folder)), path, HOUR)
    read = spark.read.schema("time string, min double, max double, avg double, sigma double").csv(path)
    return scored(read, "min", "max", "avg", "sigma")


@query("write_raw_matches")
def _(spark, folder):
    path = scratch_path(spark, "raw")
    sinks.write_raw(J.topic_corpus_filter(spark.read.text(post_file(spark, folder)), topics(spark)), path)
    return IN.parse_posts(spark.read.text(path)).select("post_id", "text")


@query("write_burst_log")
def _(spark, folder):
    path = scratch_path(spark, "burst-log")
    terms = L.top_terms(P.filter_term_length(topic_scores(spark, folder), 4), 100, ("topic_id", "win"))
    sinks.write_burst_log(terms, path, HOUR)
    return scored(spark.read.schema("topic_id string, token string, score double, epoch_ms bigint").csv(path, escape='"'))


@query("write_threshold_log")
def _(spark, folder):
    path = scratch_path(spark, "threshold-log")
    changes = folds.fold_threshold(topic_scores(spark, folder), 0.03, major=2)
    sinks.write_threshold_log(changes, path, HOUR)
    names = "topic_id string, passing bigint, old_threshold double, new_threshold double, epoch_ms bigint"
    return scored(spark.read.schema(names).csv(path, escape='"'), "old_threshold", "new_threshold")


@query("delivery_payload")
def _(spark, folder):
    """Payloads of the posts most similar to an earlier one of their hour."""
    rows = tokenised(spark, folder).withColumn("topic_id", F.concat(F.lit("H"), TS.slot_of(F.col("created_at"), HOUR)))
    novelty = N.novelty(candidates(rows, ("topic_id",)), 0.1, ("topic_id",))
    hits = similarity.burst_hits(F.col("text"), F.array(F.lit("that"), F.lit("with"), F.lit("from")))
    full = rows.join(novelty.select(F.col("id.post_id").alias("post_id"), "sim"), "post_id").withColumn("hits", hits)
    payload = sinks.delivery_payload(full.withColumn("sim", F.round("sim", 3)), "http://broker", "client-1")
    parsed = F.from_json("body", "id bigint, id_str string, jaccardSim double, tweetBurstCount bigint")
    return payload.select("topic_id", "post_id", "address", parsed.alias("b")).select("topic_id", "post_id", "address", "b.*")


def run_rows(spark, folder, **options) -> DataFrame:
    selected = posts(spark, folder).select("post_id", TS.format_time(F.col("created_at"), "epoch_s").alias("time"), "text")
    return runs.topic_runs(selected, topics(spark), **options)


@query("write_run_a")
def _(spark, folder):
    path = scratch_path(spark, "run-a")
    sinks.write_run(runs.run_a(run_rows(spark, folder, min_hits=2, cap=11), "run1"), path)
    return spark.read.schema("topic string, id bigint, time bigint, runtag string").csv(path, sep="\t")


@query("write_run_b")
def _(spark, folder):
    path = scratch_path(spark, "run-b")
    sinks.write_run(runs.run_b(run_rows(spark, folder, min_hits=1, cap=100, dedupe=False), "run1"), path, header=True)
    schema = "date string, topic string, q0 string, id bigint, rank bigint, score double, runtag string"
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


# --- filters --------------------------------------------------------------------------------

def ids(df: DataFrame) -> DataFrame:
    return df.select("post_id")


@query("filter_valid")
def _(spark, folder):
    """Conversation turns as posts, with the turns of a role blanked."""
    turns = table(spark, folder, "conversations")
    body = F.when(F.col("role") == "system", F.lit("")).when(F.col("turn") == 0, F.lit(None)).otherwise(F.col("text"))
    return P.filter_valid(turns.select("conv_id", "turn", body.alias("text")))


@query("filter_lang")
def _(spark, folder):
    return ids(P.filter_lang(posts(spark, folder), "EN"))


@query("drop_reposts")
def _(spark, folder):
    return ids(P.filter_reposts(posts(spark, folder), keep=False))


@query("only_reposts")
def _(spark, folder):
    return ids(P.filter_reposts(posts(spark, folder), keep=True))


@query("filter_spam_term")
def _(spark, folder):
    return ids(P.filter_spam(posts(spark, folder), ("worthless", "subscribe")))


@query("filter_entity_counts")
def _(spark, folder):
    return ids(P.filter_entities(posts(spark, folder), 1, 2))


@query("filter_min_tokens")
def _(spark, folder):
    return ids(P.filter_min_tokens(tokenised(spark, folder), 100))


@query("filter_repost_count")
def _(spark, folder):
    return ids(P.filter_repost_count(posts(spark, folder), 100))


@query("keyword_match")
def _(spark, folder):
    return ids(M.keyword_match(posts(spark, folder), topics(spark)))


@query("topic_match")
def _(spark, folder):
    return M.topic_match(posts(spark, folder), topics(spark)).select("post_id", "topic_id")


def item_topics(spark, folder) -> DataFrame:
    """Every item as a topic that asks for any of its words, far more terms than a plan could spell out."""
    items = table(spark, folder, "benchmark")
    words = F.array_join(F.array_distinct(X.match_words(F.col("text"))), " OR ")
    return items.select(F.concat(F.lit("B"), F.col("item_id")).alias("topic_id"), words.alias("query"), F.array().cast("array<string>").alias("tokens"))


@query("topic_match_many")
def _(spark, folder):
    """Matches per post and of all items' words as topics."""
    found = M.topic_match(posts(spark, folder), item_topics(spark, folder))
    return scored(found.groupBy("post_id").agg(F.count("*").alias("topics"), F.sum("score").alias("score")))


@query("topic_match_all")
def _(spark, folder):
    """All terms of a query have to occur."""
    return M.topic_match(posts(spark, folder), topics(spark), op="and").select("post_id", "topic_id")


@query("topic_score")
def _(spark, folder):
    return scored(M.topic_scores(posts(spark, folder), topics(spark), keep=("post_id",)))


@query("filter_term_length")
def _(spark, folder):
    return P.filter_term_length(merge.distinct_tokens(tokenised(spark, folder)), 10)


@query("filter_burst_score")
def _(spark, folder):
    return scored(P.filter_burst(en_scores(spark, folder), CONF.burst_threshold))


@query("track_gate")
def _(spark, folder):
    """A tracked phrase in the text, or a point (derived from user and value) in a box."""
    located = posts(spark, folder).withColumn("lon", F.col("user_id") * 1.5 - 90).withColumn("lat", F.col("orig_repost_count") / 10.0)
    return ids(P.track_gate(located, ("anea", "mail3"), (-80.0, 10.0, -60.0, 40.0)))


# --- projections ----------------------------------------------------------------------------

@query("tokenize")
def _(spark, folder):
    return tokenised(spark, folder, "plain").select("post_id", joined("tokens").alias("tokens"))


@query("extract_entities")
def _(spark, folder):
    """Entities of raw pages, where links are."""
    found = X.extract_entities(F.col("html"))
    pages = spread_small(table(spark, folder, "pages"))
    return pages.select(
        "page_id",
        joined(found["hashtags"]).alias("hashtags"),
        joined(found["mentions"]).alias("mentions"),
        F.array_join(F.transform(found["urls"], lambda u: u["url"]), "|").alias("urls"),
    )


@query("with_hashtag_terms")
def _(spark, folder):
    both = posts(spark, folder).select(
        "post_id", X.post_tokens("summary").alias("summary"), X.post_tokens("learner").alias("learner")
    )
    return both.select("post_id", joined("summary").alias("summary"), joined("learner").alias("learner"))


@query("bigrams")
def _(spark, folder):
    return tokenised(spark, folder).select("post_id", F.array_join(X.with_bigrams(F.col("tokens")), "|").alias("tokens"))


@query("slice_of")
def _(spark, folder):
    events = table(spark, folder, "events")
    posts_ = events.select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return posts_.select("event_id", F.unix_seconds(TS.slice_of(F.col("at"), 60)).alias("epoch_s"))


@query("minor_dates")
def _(spark, folder):
    return C.with_slots(posts(spark, folder), HOUR, 3).select("post_id", epoch("slot"))


@query("slice_spine")
def _(spark, folder):
    lo, hi = W.slot_range(every_post(spark, folder))
    return W.slice_spine(spark, lo, hi).select(epoch("slot"))


@query("jaccard")
def _(spark, folder):
    """Each post against the post numbered before it."""
    rows = tokenised(spark, folder).select("post_id", F.array_distinct("tokens").alias("tokens"))
    before = rows.select((F.col("post_id") + 1).alias("post_id"), F.col("tokens").alias("before"))
    sim = similarity.jaccard(F.col("tokens"), F.col("before"))
    return rows.join(before, "post_id").select("post_id", r6(sim).alias("sim"))


@query("burst_hits")
def _(spark, folder):
    terms = F.array(*[F.lit(t) for t in ("that", "with", "thatin", "ononst", "mail3")])
    return posts(spark, folder).select("post_id", similarity.burst_hits(F.col("text"), terms).alias("hits"))


@query("strip_punct_tokens")
def _(spark, folder):
    tokens = F.array_join(X.strip_punct_tokens(F.col("text")), "|")
    return posts(spark, folder).select("post_id", tokens.alias("tokens"))


def lemmas(spark, folder) -> DataFrame:
    """A lemma table from the items: forms ending in ``s`` without it."""
    words = table(spark, folder, "benchmark").select(F.explode(X.clean_tokens(F.col("text"))).alias("form")).distinct()
    return words.filter(F.col("form").rlike("..s$")).select("form", F.expr("left(form, length(form) - 1)").alias("lemma"))


@query("clean_tokens")
def _(spark, folder):
    texts = posts(spark, folder).select("post_id", "text")
    texts = texts.repartition(parts_for(texts), "post_id")  # whole texts, whose pieces then meet without a shuffle
    rows = texts.select("post_id", F.explode(X.clean_tokens(F.col("text"))).alias("token"))
    return runs.lemmatise(rows, lemmas(spark, folder)).distinct()


@query("format_time")
def _(spark, folder):
    at = F.col("ts").cast("timestamp")
    styles = ("long", "day_plain", "day_compact", "epoch_s", "epoch_ms")
    return table(spark, folder, "events").select("event_id", *[TS.format_time(at, s).alias(s) for s in styles])


@query("topic_terms")
def _(spark, folder):
    """Items as topics; the words found in most items are the stop words."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("topic_id"), F.col("text").alias("title"))
    words = items.select("topic_id", F.explode(X.all_words(F.col("title"))).alias("word")).distinct()
    stops = words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 20").select("word")
    return runs.topic_terms(items, stops, lemmas(spark, folder)).select("topic_id", joined("tokens").alias("tokens"))


@query("parse_topic_markup")
def _(spark, folder):
    """Items written as tagged topic text, one file per part of the table."""
    items = table(spark, folder, "benchmark")
    line = F.concat(
        F.lit("<top>\n<num> Number: MB"), F.col("item_id"),
        F.lit("\n<title> "), F.replace("text", F.lit("<"), F.lit(" ")),
        F.lit("\n<desc> Description:\n"), F.replace("text", F.lit("<"), F.lit(" ")), F.lit("\n\n</top>\n"),
    )
    path = scratch_path(spark, "markup")
    items.select(line.alias("value")).write.text(path)
    return TOPICS.read_topic_markup(spark, path).select("num", "title", "desc")


@query("score_magnitude")
def _(spark, folder):
    """Signed and absolute score side by side: falling tokens score like rising ones."""
    cells, lo, hi = en_counts(spark, folder)
    rising = S.burst_scores(cells, lo, hi, CONF.major, "warm", "rising").withColumnRenamed("score", "rising")
    both = rising.withColumn("score", F.abs("rising"))
    return scored(both, "score", "rising")


# --- counts ---------------------------------------------------------------------------------

def count_rows(df: DataFrame) -> DataFrame:
    return df.select(epoch("slot"), "token", "n")


@query("term_user_counts")
def _(spark, folder):
    return count_rows(C.term_counts(slotted(spark, folder)))


@query("term_post_counts")
def _(spark, folder):
    rows = slotted(spark, folder, style="learner")
    return count_rows(C.term_counts(rows, by="post", parts=parts_for(rows)))


@query("slice_groups")
def _(spark, folder):
    rows = C.posts_per_slice(every_post(spark, folder))
    at = lambda c: TS.format_time(F.col(c), "epoch_s").alias(c)
    return rows.select(epoch("slot"), "posts", "users", at("first_at"), at("last_at"))


@query("time_bounds")
def _(spark, folder):
    bounds = C.time_bounds(C.with_slots(every_post(spark, folder), HOUR, 3))
    return bounds.select((F.col("first_slot") * HOUR).alias("first_s"), (F.col("last_slot") * HOUR).alias("last_s"))


@query("slice_totals")
def _(spark, folder):
    return C.slice_totals(C.term_counts(every_post(spark, folder, dealt=True))).select(epoch("slot"), "total")


@query("vocab_size")
def _(spark, folder):
    cells, lo, hi = en_counts(spark, folder)
    windows = W.window_table(cells, lo, hi, CONF.major).filter(W.emits(F.col("win"), lo, hi, CONF.major, "full"))
    return windows.select(epoch(), "vocab")


@query("slice_profile")
def _(spark, folder):
    return C.slice_profile(slotted(spark, folder)).select(epoch("slot"), "posts", "tokens")


@query("window_stats")
def _(spark, folder):
    stats = scored(S.window_stats(en_scores(spark, folder, "full")), "min", "max", "avg", "sigma", "true_min")
    return stats.select(epoch(), "min", "max", "avg", "sigma", "true_min")


@query("unigram_model")
def _(spark, folder):
    tokens = expand.expansion_posts(posts(spark, folder), CONF).select(F.explode("tokens").alias("token"))
    return scored(C.unigram_model(tokens), "log_p")


def language_models(spark, folder):
    """Each language's reposts against all posts."""
    rows = tokenised(spark, folder).select("lang", "is_repost", F.explode("tokens").alias("token"))
    return C.unigram_model(rows.filter("is_repost"), ("lang",)), C.unigram_model(rows.select("token"))


@query("kl_gain")
def _(spark, folder):
    return scored(C.kl_gain(*language_models(spark, folder), ("lang",)), "gain")


@query("model_join")
def _(spark, folder):
    return scored(C.model_join(*language_models(spark, folder), ("lang",)), "log_p", "all_log_p")


def matches(spark, folder) -> DataFrame:
    prepared = expand.expansion_posts(posts(spark, folder), CONF)
    return M.topic_scores(prepared, topics(spark), keep=("post_id", "tags"))


@query("top_hashtags")
def _(spark, folder):
    tags = matches(spark, folder).select("topic_id", F.explode("tags").alias("tag"))
    return L.top_hashtags(tags, 3, 3)


@query("match_score_summary")
def _(spark, folder):
    return scored(M.match_summary(matches(spark, folder)), "best", "mean")


@query("max_hits")
def _(spark, folder):
    """Per hour the posts with most of the words asked for."""
    terms = F.array(*[F.lit(t) for t in ("that", "with", "from", "this", "thatin", "anea")])
    rows = slotted(spark, folder).select("slot", "post_id", similarity.burst_hits(F.col("text"), terms).alias("hits"))
    return M.keep_max_hits(rows, ("slot",)).select(epoch("slot"), "post_id", "hits")


@query("score_distribution")
def _(spark, folder):
    terms = TERMS.read_burst_terms(spark, term_file(spark, folder))
    return scored(S.score_distribution(terms), "min", "median", "mean", "max")


@query("merge_burst_terms")
def _(spark, folder):
    """Terms of originals, of reposts and of all posts, in this order of precedence."""
    def terms(df):
        cells, lo, hi = J.window_counts(df, CONF)
        scores = P.filter_burst(S.burst_scores(cells, lo, hi, CONF.major, "warm"), 0.005)
        return scores.select((F.col("win") * HOUR * 1000).alias("date"), "token", "score")

    rows = kept(spark, folder)
    files = [terms(P.filter_reposts(rows, False)), terms(P.filter_reposts(rows, True)), terms(rows)]
    return scored(merge.merge_burst_terms(files))


@query("topic_keyword_hits")
def _(spark, folder):
    return runs.topic_keyword_hits(posts(spark, folder), topics(spark), lemmas(spark, folder))


@query("topic_keyword_rows")
def _(spark, folder):
    """One row per matching token."""
    return runs.topic_keyword_hits(posts(spark, folder), topics(spark), per_token=True)


# --- windows and scores ---------------------------------------------------------------------

@query("minor_window_merge")
def _(spark, folder):
    return count_rows(C.minor_counts(slotted(spark, folder), 3))


def per_token(cells: DataFrame) -> DataFrame:
    """Counts of all slots in one row per token."""
    return cells.groupBy("token").agg(F.count("*").alias("slots"), F.sum("n").alias("total"), F.max("n").alias("most"))


@query("minor_window_merge_long")
def _(spark, folder):
    """Minor windows of thirty hours; nothing is shuffled thirty times."""
    return per_token(C.minor_counts(slotted(spark, folder), 30))


@query("term_user_counts_events")
def _(spark, folder):
    """Distinct users per slot and token over all events, by token."""
    return per_token(C.term_counts(every_post(spark, folder, dealt=True)))


@query("term_post_counts_events")
def _(spark, folder):
    return per_token(C.term_counts(every_post(spark, folder, "learner", dealt=True), by="post"))


@query("gap_fill")
def _(spark, folder):
    """Hourly totals of one kind of post, zero where there is none."""
    lo, hi = W.slot_range(C.with_slots(posts(spark, folder), HOUR))
    rare = P.filter_repost_count(slotted(spark, folder), 400)
    return W.gap_fill(C.slice_totals(C.term_counts(rare)), lo, hi).select(epoch("slot"), "total")


@query("major_windows")
def _(spark, folder):
    lo, hi = W.slot_range(C.with_slots(posts(spark, folder), HOUR))
    return W.major_windows(spark, lo, hi, 24).select(epoch(), (F.col("first_slot") * HOUR).alias("first_s"), "n")


@query("growing_windows")
def _(spark, folder):
    lo, hi = W.slot_range(C.with_slots(posts(spark, folder), HOUR))
    all_ = W.major_windows(spark, lo, hi, 24, "all").withColumn("reported", W.emits(F.col("win"), lo, hi, 24, "warm"))
    return all_.select(epoch(), (F.col("first_slot") * HOUR).alias("first_s"), "n", "reported")


def score_rows(df: DataFrame) -> DataFrame:
    return df.select(epoch(), "token", r6("score").alias("score"))


@query("burst_score")
def _(spark, folder):
    return score_rows(en_scores(spark, folder, "full"))


@query("burst_score_undated")
def _(spark, folder):
    cells, _, hi = en_counts(spark, folder, minor=1)
    return scored(S.undated_scores(cells, hi, 30))


@query("average_score")
def _(spark, folder):
    return score_rows(en_scores(spark, folder, "full", "average"))


@query("user_scorer")
def _(spark, folder):
    """A Python scorer over dense count series: last value less the mean."""
    cells, lo, hi = en_counts(spark, folder)
    return score_rows(S.score_series(cells, lo, hi, CONF.major, lambda series: series[:, -1] - series.mean(axis=1)))


@query("minmax_normalise")
def _(spark, folder):
    return score_rows(S.minmax_normalise(en_scores(spark, folder)))


@query("burst_ranges")
def _(spark, folder):
    cells, lo, hi = en_counts(spark, folder)
    hot = P.filter_burst(S.burst_scores(cells, lo, hi, 12, "warm"), 0.05).select(F.col("win").alias("slot"))
    ranges = W.burst_ranges(hot, lo, 3)
    return ranges.select((F.col("first_slot") * HOUR).alias("first_s"), (F.col("last_slot") * HOUR).alias("last_s"))


@query("daily_cap")
def _(spark, folder):
    rows = posts(spark, folder).select(F.col("lang").alias("topic_id"), "post_id", F.unix_seconds("created_at").alias("time"))
    return runs.daily_cap(rows, 11)


@query("shift_join")
def _(spark, folder):
    lo, hi = W.slot_range(C.with_slots(posts(spark, folder), HOUR))
    totals = W.gap_fill(C.slice_totals(C.term_counts(slotted(spark, folder))), lo, hi)
    return W.shift_join(totals, 2, ("total",)).select(epoch("slot"), "total", "total_before")


# --- matching and selection -----------------------------------------------------------------

def burst_terms(spark, folder) -> DataFrame:
    return J.summary_terms(kept(spark, folder), CONF, CONF.terms_per_window)


@query("term_post_join")
def _(spark, folder):
    rows = J.own_slot(kept(spark, folder), CONF)
    return M.window_hits(rows, burst_terms(spark, folder), CONF.major + CONF.minor - 1).select(epoch(), "post_id", "hits")


@query("term_post_join_tokens")
def _(spark, folder):
    """Terms equal to a token of the post."""
    rows = J.own_slot(kept(spark, folder), CONF).withColumn("tokens", X.post_tokens("summary"))
    hits = M.window_hits(rows, burst_terms(spark, folder), CONF.major + CONF.minor - 1, match="token")
    return hits.select(epoch(), "post_id", "hits")


@query("topic_assign")
def _(spark, folder):
    return M.assign_topics(posts(spark, folder), topics(spark), "query")


@query("topic_assign_tokens")
def _(spark, folder):
    return M.assign_topics(posts(spark, folder), topics(spark), "tokens")


@query("unseen_only")
def _(spark, folder):
    return ids(M.unseen_only(posts(spark, folder), labels_where(spark, folder, "toxic = 1")))


@query("gate_posts")
def _(spark, folder):
    return ids(M.gate_posts(posts(spark, folder), labels_where(spark, folder, "quality = 1")))


def run_lines(rows: DataFrame, order: str) -> DataFrame:
    """Run lines numbered in file order."""
    return rows.select(F.col(order).alias("line_no"), F.col("value"))


def eighteen(column: str) -> F.Column:
    return F.concat(F.lit("6"), F.lpad(F.col(column).cast("string"), 17, "0"))


@query("gate_run")
def _(spark, folder):
    """Run lines of all posts, gated by labelled ids."""
    lines = posts(spark, folder).select("post_id", F.concat_ws("\t", F.lit("MB226"), eighteen("post_id"), F.lit("run1")).alias("value"))
    wanted = labels_where(spark, folder, "quality = 1").select(eighteen("post_id").cast("bigint").alias("post_id"))
    return runs.gate_run(run_lines(lines, "post_id"), wanted).select("value")


def candidates(rows: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Posts as candidates of their group, oldest first."""
    pos = F.struct(F.col("created_at"), F.col("post_id"))
    ident = F.struct(*group, "post_id") if group else F.col("post_id")
    return rows.select(*group, ident.alias("id"), pos.alias("pos"), "created_at", "tokens")


@query("novelty_join")
def _(spark, folder):
    return scored(N.novelty(candidates(tokenised(spark, folder), ()), 0.3), "sim").withColumnRenamed("id", "post_id")


@query("top_terms")
def _(spark, folder):
    return score_rows(L.top_terms(en_scores(spark, folder, "full"), 20))


@query("top_relevant_with_ties")
def _(spark, folder):
    """Scores to three places, so that there are ties at the cut."""
    rounded = matches(spark, folder).select("topic_id", "post_id", F.round("score", 3).alias("score"))
    return L.top_with_ties(rounded, 20)


@query("top_gain_terms")
def _(spark, folder):
    gains = C.kl_gain(*language_models(spark, folder), ("lang",))
    return scored(L.top_gain(gains, 10, ("lang",)), "gain")


def topic_groups(spark, folder) -> DataFrame:
    """Topical posts per topic and day."""
    matched = M.topic_match(kept(spark, folder), topics(spark)).withColumn("tokens", X.post_tokens("summary"))
    return matched.withColumn("win", TS.slot_of(F.col("created_at"), 24 * HOUR))


@query("select_least_similar")
def _(spark, folder):
    group = ("topic_id", "win")
    rows = stage(candidates(topic_groups(spark, folder), group), "candidates")
    chosen = L.select_posts(rows, 0.3, 5, "novel_first", scope=group, group=group)
    return chosen.select("topic_id", "win", F.col("id.post_id").alias("post_id"))


@query("select_most_similar_first")
def _(spark, folder):
    rows = stage(candidates(tokenised(spark, folder).withColumn("win", TS.slot_of(F.col("created_at"), 6 * HOUR)), ("win",)), "candidates")
    chosen = L.select_posts(rows, 0.3, 5, "similar_first")
    return chosen.select("win", F.col("id.post_id").alias("post_id"))


@query("sort_by_time")
def _(spark, folder):
    rows = posts(spark, folder).select("post_id", F.unix_micros("created_at").alias("micros"))
    return L.sort_output(rows, "micros", "post_id")


# --- set operations -------------------------------------------------------------------------

@query("union_windows")
def _(spark, folder):
    rows = slotted(spark, folder)
    kinds = [P.filter_reposts(rows, True), P.filter_reposts(rows, False)]
    return count_rows(merge.union_all(C.term_counts(k) for k in kinds))


@query("merge_slice_maps")
def _(spark, folder):
    maps = merge.merge_slice_maps(C.term_counts(C.with_slots(tokenised(spark, folder), 24 * HOUR)))
    entries = F.transform(F.map_entries("by_slot"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return maps.select("token", F.array_join(entries, "|").alias("by_slot"))


@query("new_gated_ids")
def _(spark, folder):
    matched = M.keyword_match(posts(spark, folder), topics(spark))
    tagged, wanted = labels_where(spark, folder, "toxic = 1"), labels_where(spark, folder, "quality = 1")
    return M.new_gated(matched, tagged, wanted)


@query("distinct_tokens")
def _(spark, folder):
    return merge.distinct_tokens(tokenised(spark, folder))


@query("distinct_slices")
def _(spark, folder):
    return merge.distinct_slices(C.with_slots(every_post(spark, folder), HOUR, 3)).select(epoch("slot"))


# --- adaptive thresholds --------------------------------------------------------------------

def topic_scores(spark, folder) -> DataFrame:
    """Scores of each topic's posts over six-hour windows."""
    matched = M.topic_match(kept(spark, folder), topics(spark)).withColumn("tokens", X.post_tokens("summary"))
    counts = stage(C.term_counts(C.with_slots(matched, HOUR), keys=("topic_id",)), "counts")
    lo, hi = W.slot_range(counts)
    return S.burst_scores(counts, lo, hi, 6, "full", keys=("topic_id",), key_rows=len(TOPIC_ROWS))


@query("adaptive_threshold")
def _(spark, folder):
    changes = folds.fold_threshold(topic_scores(spark, folder), 0.03, major=2)
    return scored(changes.select("topic_id", epoch(), "bursts", "old_threshold", "new_threshold"), "old_threshold", "new_threshold")


@query("repost_escalation_long")
def _(spark, folder):
    """All events as posts of one topic: a threshold that rises at nearly every half day, far beyond 16 times."""
    events = table(spark, folder, "events")
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (12 * HOUR)).cast("bigint")
    reach = F.pow(F.lit(2), F.floor(F.col("value") * 10) % 45).cast("bigint")
    rows = events.select(F.lit("T").alias("topic_id"), slot.alias("slot"), reach.alias("orig_repost_count"))
    return scored(folds.fold_escalation(rows, 1.0, 2.0), "old_threshold", "new_threshold")


@query("repost_escalation")
def _(spark, folder):
    matched = C.with_slots(M.topic_match(posts(spark, folder), topics(spark)), 24 * HOUR)
    changes = folds.fold_escalation(matched, 5.0, 4.0)
    return scored(changes, "old_threshold", "new_threshold")


# --- jobs -----------------------------------------------------------------------------------

def chosen_rows(df: DataFrame) -> DataFrame:
    return df.select("topic", epoch(), "post_id", "text")


@query("topical_burst_summary")
def _(spark, folder):
    return chosen_rows(J.topical_burst_summary(posts(spark, folder), topics(spark), CONF))


@query("open_domain_summary")
def _(spark, folder):
    return chosen_rows(J.open_domain_summary(posts(spark, folder), CONF))


@query("gated_burst_posts")
def _(spark, folder):
    wanted = labels_where(spark, folder, "quality = 1")
    return J.gated_burst_posts(posts(spark, folder), topics(spark), wanted, CONF).select(epoch(), "post_id")


@query("batch_term_scores")
def _(spark, folder):
    return scored(J.batch_term_scores(posts(spark, folder), topics(spark), CONF, CONF.burst_threshold))


@query("batch_post_finder")
def _(spark, folder):
    terms = stage(J.batch_term_scores(posts(spark, folder), topics(spark), CONF, CONF.burst_threshold), "terms")
    return chosen_rows(J.batch_post_finder(posts(spark, folder), terms, topics(spark), CONF))


@query("learn_term_scores")
def _(spark, folder):
    return score_rows(J.learn_term_scores(posts(spark, folder), CONF))


@query("learn_window_stats")
def _(spark, folder):
    stats = scored(J.learn_window_stats(posts(spark, folder), CONF), "min", "max", "avg", "sigma", "true_min")
    return stats.select(epoch(), "min", "max", "avg", "sigma", "true_min")


@query("topic_corpus_filter")
def _(spark, folder):
    lines = J.topic_corpus_filter(IN.post_lines(posts(spark, folder)), topics(spark))
    return IN.parse_posts(lines).select("post_id", "text")


@query("expand_topics")
def _(spark, folder):
    return expand.expand_topics(posts(spark, folder), topics(spark), CONF)


@query("topic_runs")
def _(spark, folder):
    """Posts delivered twice; the earlier delivery counts."""
    at = TS.format_time(F.col("created_at"), "epoch_s")
    once = posts(spark, folder).select("post_id", at.alias("time"), "text")
    twice = once.unionByName(once.select("post_id", (F.col("time") + 90000).alias("time"), "text"))
    return runs.topic_runs(twice, topics(spark), min_hits=1, cap=11, lemmas=lemmas(spark, folder))


@query("topic_rows")
def _(spark, folder):
    """Topic rows with title and text, the query standing for the title."""
    at = TS.format_time(F.col("created_at"), "epoch_s")
    once = posts(spark, folder).select("post_id", at.alias("time"), "text")
    named = topics(spark).withColumnRenamed("query", "title")
    rows = runs.topic_runs(once, named, min_hits=1, cap=100)
    return runs.titled_rows(rows, once, named, date=True)


def dirty_run(spark, folder, task: str) -> DataFrame:
    """A run of all posts with the mistakes the check looks for, spread by the events' values."""
    rows = posts(spark, folder).select("post_id", "user_id", "orig_repost_count", "is_repost", "lang", "source")
    topic = F.concat(F.lit("MB"), F.lpad((F.col("user_id") * 3 + 220).cast("string"), 3, "0"))
    number = F.when(F.col("orig_repost_count") < 10, F.lpad("post_id", 17, "1")).otherwise(eighteen("post_id"))
    tag = F.when(F.col("lang") == "fr", "run-2").otherwise("run-1")
    time = 1437350000 + F.col("orig_repost_count") * 3000
    twice = F.explode(F.when(F.col("is_repost"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    if task == "a":
        fields = F.concat_ws(" ", topic, number, time.cast("string"), tag)
    else:
        date = F.when(F.col("source") == "src7", F.lit("2015-07-20")).otherwise(
            F.concat(F.lit("201507"), F.lpad((F.col("user_id") + 5).cast("string"), 2, "0"))
        )
        q0 = F.when(F.col("source") == "src5", "Q1").otherwise("Q0")
        fields = F.concat_ws("\t", date, topic, q0, number, F.lit("1"), F.lit("1.0"), tag)
    lines = rows.withColumn("value", F.when(F.col("source") == "src3", F.concat_ws(" ", topic, number)).otherwise(fields))
    lines = lines.select("*", twice)
    return lines.select((F.col("post_id") * 2 + F.col("copy")).alias("line_no"), "value")


@query("validate_run")
def _(spark, folder):
    return runs.check_run(dirty_run(spark, folder, "a"), "a").select("line_no", "error")


@query("validate_run_daily")
def _(spark, folder):
    return runs.check_run(dirty_run(spark, folder, "b"), "b").select("line_no", "error", "q0_warning")


@query("validate_run_caps")
def _(spark, folder):
    """A cap of one row per topic, over topics that are all known, so that there are rows to report."""
    rules = runs.RUN_RULES | {"max_rows": 1, "first_topic": 200}
    return runs.check_caps(runs.check_run(dirty_run(spark, folder, "a"), "a", rules), "a", rules)


def feeds(spark, folder) -> DataFrame:
    """Posts, conversation turns and items in order of arrival."""
    docs = table(spark, folder, "documents").select(
        (F.col("doc_id") * 3).alias("arrival"), F.lit("docs").alias("feed"), F.col("lang").alias("topic"), F.col("doc_id").alias("post_id"), "text"
    )
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 3 + 1).alias("arrival"), F.concat(F.lit("turn"), F.col("turn")).alias("feed"), F.col("role").alias("topic"), F.col("conv_id").alias("post_id"), "text"
    )
    items = table(spark, folder, "benchmark").select(
        (F.col("item_id") * 3 + 2).alias("arrival"), F.lit("items").alias("feed"), F.lit("en").alias("topic"), F.col("item_id").alias("post_id"), "text"
    )
    return merge.union_all([docs, turns, items])


@query("merge_near_duplicates")
def _(spark, folder):
    merged = merge.merge_near_duplicates(spread_small(feeds(spark, folder)), 0.5)
    return merged.select("arrival", "feed", "topic", "post_id")


# --- streams --------------------------------------------------------------------------------

def write_stream(df: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a stream makes of all input present; state is kept on disk."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    with keyed_state(df.sparkSession):
        running = writer.option("path", path).trigger(availableNow=True).start()
    running.awaitTermination()


def run_stream(df: DataFrame) -> DataFrame:
    """Runs a stream over all input present and returns what it wrote."""
    spark = df.sparkSession
    path = scratch_path(spark, "stream")
    write_stream(df, path, scratch_path(spark, "stream-state"))
    return spark.read.schema(df.schema).parquet(path)


def post_stream(spark, folder) -> DataFrame:
    return IN.stream_posts(spark, "text", {"path": post_file(spark, folder)})


@query("stream_prepare")
def _(spark, folder):
    rows = run_stream(PREP.stream_prepare(post_stream(spark, folder), topics(spark), CONF))
    return rows.select("post_id", "topic_id", F.size("tokens").cast("bigint").alias("tokens"))


@query("stream_term_counts")
def _(spark, folder):
    """Counts of the slots the watermark has passed."""
    prepared = PREP.stream_prepare(post_stream(spark, folder), topics(spark), CONF)
    return run_stream(PREP.stream_counts(prepared, CONF, "2 hours")).select("topic_id", epoch("slot"), "token", "n")


@query("stream_checkpoint")
def _(spark, folder):
    """The same counts by a query that stops halfway and is started again from its checkpoint."""
    source, target, state = (scratch_path(spark, n) for n in ("posts-json", "stream", "stream-state"))
    rows = posts(spark, folder)
    half = F.timestamp_seconds(rows.agg(F.avg(F.unix_seconds("created_at"))).scalar())
    counts = None
    for part in (rows.filter(F.col("created_at") < half), rows.filter(F.col("created_at") >= half)):
        IN.post_lines(part).write.mode("append").text(source)
        prepared = PREP.stream_prepare(IN.stream_posts(spark, "text", {"path": source}), topics(spark), CONF)
        counts = PREP.stream_counts(prepared, CONF, "2 hours")
        write_stream(counts, target, state)
    return spark.read.schema(counts.schema).parquet(target).select("topic_id", epoch("slot"), "token", "n")


@query("late_data")
def _(spark, folder):
    """Counts per language with a longer allowance for late posts."""
    rows = P.filter_valid(post_stream(spark, folder)).withColumn("tokens", X.post_tokens("plain"))
    return run_stream(PREP.stream_counts(rows, CONF, "12 hours", keys=("lang",))).select("lang", epoch("slot"), "token", "n")


def history(spark, folder) -> DataFrame:
    """Runs the counting query over all posts; histories of closed slots are its keyed state."""
    memory = scratch_path(spark, "history")
    kept_stream = P.summary_filters(post_stream(spark, folder), CONF).withColumn("tokens", X.post_tokens("summary"))
    counts = PREP.stream_counts(kept_stream, CONF, "2 hours", keys=(), timed=True)
    STREAM.keep_histories(counts, 51, CONF.width, memory, {"availableNow": True}).awaitTermination()
    return STREAM.term_history(spark, memory, 51)


@query("stream_term_history")
def _(spark, folder):
    return count_rows(history(spark, folder))


@query("stream_burst_scores")
def _(spark, folder):
    return score_rows(STREAM.score_closed(history(spark, folder), 24, keys=()))


STREAM_CONF = CONF.with_(width=12 * HOUR, minor=1, major=3, burst_threshold=0.2, per_window_max=30)


BURST_RUNS: dict[tuple[str, str], str] = {}  # finished runs of this session, by its id and the input


def burst_folder(spark, folder) -> str:
    """Tables of the burst job over all posts; the queries that read them share one run."""
    run = spark.sparkContext.applicationId, folder
    if run not in BURST_RUNS:
        memory = scratch_path(spark, "burst")
        STREAM.burst_stream(post_stream(spark, folder), topics(spark), STREAM_CONF, memory, trigger={"availableNow": True}).awaitTermination()
        BURST_RUNS[run] = memory
    return BURST_RUNS[run]


@query("burst_stream")
def _(spark, folder):
    delivered, _ = STREAM.burst_results(spark, burst_folder(spark, folder))
    return scored(delivered.select("topic_id", "win", "post_id", "hits", "sim"), "sim")


@query("burst_stream_terms")
def _(spark, folder):
    """Bursting terms of every closed window, with the threshold in force."""
    _, terms = STREAM.burst_results(spark, burst_folder(spark, folder))
    return scored(terms.select("topic_id", "win", "token", "score", "threshold"), "score", "threshold")


@query("burst_stream_thresholds")
def _(spark, folder):
    """Changes of the thresholds, as the threshold log takes them."""
    changes = STREAM.burst_changes(spark, burst_folder(spark, folder))
    return scored(sinks.threshold_log_rows(changes, STREAM_CONF.width), "old_threshold", "new_threshold")


@query("repost_stream")
def _(spark, folder):
    memory = scratch_path(spark, "reposts")
    STREAM.repost_stream(post_stream(spark, folder), topics(spark), CONF, memory, {"availableNow": True}).awaitTermination()
    return STREAM.Memory(spark, memory).read("delivered", STREAM.DELIVERED).select("topic_id", "post_id", F.col("hits").alias("reposts"))


def window_terms(spark, folder) -> tuple[DataFrame, DataFrame, int]:
    """Posts per topic, and terms of the window that ends with the last full slot."""
    matched = stage(PREP.stream_prepare(posts(spark, folder), topics(spark), STREAM_CONF), "prepared")
    rows = matched.withColumn("own", TS.slot_of(F.col("created_at"), STREAM_CONF.width))
    slots = rows.withColumn("slot", F.col("own"))
    lo, hi = W.slot_range(slots.filter(F.size("tokens") > 0))
    win = hi - 1
    inside = stage(C.term_counts(slots.filter(F.col("slot").between(win - 2, win)), keys=("topic_id",)), "counts")
    scores = S.burst_scores(inside, win - 2, win, 3, "full", keys=("topic_id",), key_rows=len(TOPIC_ROWS))
    terms = stage(L.burst_terms(scores, STREAM_CONF.burst_threshold, 4, 100, ("topic_id", "win")), "terms")
    return rows, terms, win


def select_window(spark, folder, delivered: DataFrame) -> DataFrame:
    rows, terms, win = window_terms(spark, folder)
    seen = rows.join(delivered, "post_id").select("topic_id", (F.lit(win) - 1).alias("win"), "post_id", "text", "tokens")
    chosen = STREAM.select_closed(rows.filter(F.col("own") == win), terms, stage(seen, "delivered"), win, STREAM_CONF)
    return scored(chosen.select("topic_id", "win", "post_id", "hits", "sim"), "sim")


@query("stream_select")
def _(spark, folder):
    """One closed window, nothing delivered before."""
    return select_window(spark, folder, labels_where(spark, folder, "quality > 1"))


@query("stream_novelty_memory")
def _(spark, folder):
    """The same window after the labelled posts were delivered."""
    return select_window(spark, folder, labels_where(spark, folder, "quality = 1"))
