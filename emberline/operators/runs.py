"""Run files: topic rows per post, caps, columns and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.text import clean_tokens
from emberline.functions.timeslice import format_time
from emberline.operators.select import top_per_group
from emberline.operators.sizing import broadcast_if_small


def lemmatise(tokens: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """Rows with a ``token`` replaced by its lemma; a form without lemma stays."""
    if lemmas is None:
        return tokens
    forms = lemmas.select(F.col("form").alias("token"), "lemma")
    joined = tokens.join(forms, "token", "left").withColumn("token", F.coalesce("lemma", "token"))
    return joined.select(*tokens.columns)


def topic_terms(topics: DataFrame, stops: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """``(topic_id, title, tokens)`` from topic titles.

    Lower-case words without surrounding punctuation and stop words; words and their lemmas of more
    than two characters, a lemma only if the list does not have it yet.
    """
    title = F.lower("title")
    trim = lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")
    words = topics.select("topic_id", title.alias("title"), F.posexplode(F.transform(F.split(title, " ", -1), trim)).alias("place", "token"))
    kept = words.join(stops.select(F.col("word").alias("token")), "token", "left_anti")
    with_lemma = kept
    if lemmas is not None:
        forms = lemmas.select(F.col("form").alias("token"), "lemma")
        with_lemma = kept.join(forms, "token", "left")
    else:
        with_lemma = kept.withColumn("lemma", F.lit(None).cast("string"))
    with_lemma = with_lemma.withColumn("lemma", F.coalesce("lemma", "token"))
    ordered = with_lemma.groupBy("topic_id", "title").agg(
        F.sort_array(F.collect_list(F.struct("place", "token", "lemma"))).alias("words")
    )
    empty = F.expr("cast(array() as array<string>)")
    long_ = lambda w: F.length(w) > 2

    def step(acc: Column, w: Column) -> Column:
        grown = F.when(long_(w["token"]), F.array_append(acc, w["token"])).otherwise(acc)
        new = long_(w["lemma"]) & ~F.array_contains(grown, w["lemma"])
        return F.when(new, F.array_append(grown, w["lemma"])).otherwise(grown)

    tokens = F.aggregate("words", empty, step)
    titles = topics.select("topic_id", title.alias("title"))
    joined = titles.join(ordered.select("topic_id", tokens.alias("tokens")), "topic_id", "left")
    return joined.select("topic_id", "title", F.coalesce("tokens", empty).alias("tokens"))


def topic_keyword_hits(
    posts: DataFrame, topics: DataFrame, lemmas: DataFrame | None = None, per_token: bool = False
) -> DataFrame:
    """``(post_id, topic_id, hits)``: distinct clean tokens of a post in the topic's token list.

    ``per_token`` repeats the row for every matching token.
    """
    tokens = lemmatise(posts.select("post_id", F.explode(clean_tokens(F.col("text"))).alias("token")), lemmas)
    listed = topics.select("topic_id", F.explode(F.array_distinct("tokens")).alias("token"))
    found = tokens.join(broadcast_if_small(listed), "token").distinct()
    hits = found.groupBy("post_id", "topic_id").agg(F.count("*").alias("hits"))
    if not per_token:
        return hits
    return hits.select("post_id", "topic_id", "hits", F.explode(F.sequence(F.lit(1), F.col("hits"))).alias("nth")).drop("nth")


def daily_cap(rows: DataFrame, n: int, time: str = "time") -> DataFrame:
    """At most ``n`` rows per topic and UTC day, in order of time and id."""
    day = F.floor(F.col(time) / 86400)
    capped = rows.withColumn("__day", day)
    return top_per_group(capped, ["topic_id", "__day"], [F.col(time), F.col("post_id")], n).drop("__day")


def topic_runs(
    selected: DataFrame,
    topics: DataFrame,
    min_hits: int = 2,
    cap: int = 11,
    dedupe: bool = True,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Topic rows of selected posts (``post_id, time, text``; time in epoch seconds).

    ``dedupe`` keeps the earliest row of an id.  Rows need ``min_hits`` of the topic's tokens; each
    topic takes ``cap`` rows a day.
    """
    posts = selected.select("post_id", "time", "text")
    if dedupe:
        posts = posts.groupBy("post_id").agg(F.min(F.struct("time", "text")).alias("p")).select("post_id", "p.time", "p.text")
    # Without deduplication an id may occur at several times: rows are told apart by both.
    keyed = posts.select(F.struct("post_id", "time").alias("post_id"), "text")
    hits = topic_keyword_hits(keyed, topics, lemmas).filter(F.col("hits") >= min_hits)
    rows = hits.select("topic_id", "post_id.post_id", "post_id.time", "hits")
    return daily_cap(rows, cap)


def titled_rows(rows: DataFrame, posts: DataFrame, topics: DataFrame, date: bool = False) -> DataFrame:
    """Topic rows with title and text: ``topic, title, time, [date,] id, text``.

    ``posts`` is ``(post_id, time, text)``, ``topics`` ``(topic_id, title)``.  Line ends of the text are blanked.
    """
    texts = posts.select("post_id", "time", F.regexp_replace("text", r"[\r\n]+", " ").alias("text")).dropDuplicates(["post_id", "time"])
    full = rows.join(texts, ["post_id", "time"]).join(topics.select("topic_id", "title"), "topic_id", "left")
    day = [format_time(F.timestamp_seconds("time"), "day_compact").alias("date")] if date else []
    return full.select(F.col("topic_id").alias("topic"), "title", "time", *day, F.col("post_id").alias("id"), "text")


def run_a(rows: DataFrame, tag: str) -> DataFrame:
    """Four-column run: ``topic, id, time, runtag``."""
    return rows.select(F.col("topic_id").alias("topic"), F.col("post_id").alias("id"), "time", F.lit(tag).alias("runtag"))


def run_b(rows: DataFrame, tag: str) -> DataFrame:
    """Seven-column run: ``date, topic, q0, id, rank, score, runtag``."""
    date = format_time(F.timestamp_seconds("time"), "day_compact")
    return rows.select(
        date.alias("date"),
        F.col("topic_id").alias("topic"),
        F.lit("Q0").alias("q0"),
        F.col("post_id").alias("id"),
        F.lit(1).alias("rank"),
        F.lit(1.0).alias("score"),
        F.lit(tag).alias("runtag"),
    )


def gate_run(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Run lines whose id is a candidate.

    The id column is the first field of the first line that starts with 18 digits.
    """
    fields = F.split(F.replace("value", F.lit("\t"), F.lit(" ")), " ")
    first = lines.agg(F.min_by("value", "line_no").alias("value")).select(fields.alias("fields"))
    numbered = F.filter(
        F.transform("fields", lambda f, i: F.struct(i.alias("i"), f.rlike("^[0-9]{18}").alias("is_id"))), lambda f: f["is_id"]
    )
    place = first.select(F.get(numbered, F.lit(0))["i"]).scalar()
    keyed = lines.withColumn("post_id", F.get(fields, place).try_cast("bigint"))
    return keyed.join(ids.select("post_id"), "post_id", "left_semi").select(*lines.columns)


# Fixed values of the run check.
RUN_RULES = {
    "tag": r"^[A-Za-z0-9_.-]{1,15}$",
    "topic_prefix": "MB",
    "first_topic": 226,
    "last_topic": 450,
    "id": r"^[0-9]{18}$",
    "min_time": 1437350400,
    "max_time": 1438214399,
    "year": "2015",
    "month": "07",
    "first_day": 20,
    "last_day": 29,
    "max_rows": 100,
}


def _chain(rules) -> Column:
    """Name of the first rule that fails; null if none does."""
    return reduce(lambda col, rule: col.when(rule[1], F.lit(rule[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0])))


def check_run(lines: DataFrame, task: str, rules: dict = RUN_RULES) -> DataFrame:
    """Each run line ``(line_no, value)`` with the first rule it breaks (``error``, else null).

    Task ``a`` lines are ``topic id time tag``, task ``b`` lines ``date topic Q0 id rank score tag``.
    The tag of the first line with the right number of fields is the run's tag.  A repeated (topic, id) is found by the smallest
    line number among the lines that pass the earlier rules.  ``q0_warning`` marks the first
    otherwise valid line of task b whose third field is not Q0.
    """
    names = ["topic", "id", "time", "tag"] if task == "a" else ["date", "topic", "q0", "id", "rank", "score", "tag"]
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.filter(~F.col("value").rlike(r"^\s*$")).withColumn("f", fields)
    whole = F.when(F.size("f") == len(names), F.col("line_no"))
    tag = rows.agg(F.min_by(F.get("f", F.lit(len(names) - 1)), whole).alias("tag"), F.min(whole).alias("first"))
    rows = rows.select("line_no", F.size("f").alias("fields"), *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("run_tag", tag.select("tag").scalar()).withColumn("first_line", tag.select("first").scalar())

    number = F.substring("topic", len(rules["topic_prefix"]) + 1, 9)
    known = F.col("topic").rlike(f"^{rules['topic_prefix']}[0-9]{{3}}$") & number.try_cast("int").between(
        rules["first_topic"], rules["last_topic"]
    )
    is_first = F.coalesce(F.col("line_no") == F.col("first_line"), F.lit(False))
    before = [
        ("fields", F.col("fields") != len(names)),
        ("malformed_tag", is_first & ~F.col("tag").rlike(rules["tag"])),
        ("other_tag", ~is_first & (F.col("tag") != F.col("run_tag"))),
        ("unknown_topic", ~known),
        ("unknown_id", ~F.col("id").rlike(rules["id"])),
    ]
    rows = rows.withColumn("early", _chain(before))
    # First line of each (topic, id), by aggregation: a repeated id may fill any part of the run.
    firsts = rows.filter("early is null").groupBy("topic", "id").agg(F.min("line_no").alias("first_use"))
    rows = rows.join(firsts, ["topic", "id"], "left")
    if task == "a":
        time = F.col("time").try_cast("bigint")
        late = [("time", time.isNull() | ~time.between(rules["min_time"], rules["max_time"]))]
    else:
        date = F.regexp_extract("date", r"(\d{8})", 1)
        day = F.substring(date, 7, 2).try_cast("int")
        late = [
            ("date_format", F.length(date) == 0),
            ("year", F.substring(date, 1, 4) != rules["year"]),
            ("month", F.substring(date, 5, 2) != rules["month"]),
            ("day", ~day.between(rules["first_day"], rules["last_day"])),
        ]
    error = F.coalesce("early", _chain([("duplicate", F.col("line_no") > F.col("first_use")), *late]))
    checked = rows.withColumn("error", error)
    if task == "a":
        return checked.select("line_no", "topic", "id", "error")
    reaching = F.col("early").isNull() & (F.col("line_no") == F.col("first_use")) & (F.col("q0") != "Q0")
    first_q0 = checked.filter(reaching).agg(F.min("line_no"))
    warning = F.coalesce(F.col("line_no") == first_q0.scalar(), F.lit(False))
    return checked.select("line_no", "topic", "id", "date", "error", warning.alias("q0_warning"))


def check_caps(checked: DataFrame, task: str, rules: dict = RUN_RULES) -> DataFrame:
    """Groups with too many valid rows: per topic (task a, a warning) or topic and day (task b)."""
    keys = ["topic"] if task == "a" else ["topic", "date"]
    counts = checked.filter("error is null").groupBy(*keys).agg(F.count("*").alias("rows"))
    level = F.lit("warning" if task == "a" else "error")
    return counts.filter(F.col("rows") > rules["max_rows"]).withColumn("level", level)


def validate_run(lines: DataFrame, task: str, rules: dict = RUN_RULES) -> tuple[DataFrame, DataFrame]:
    """Checked lines and groups over the cap."""
    checked = check_run(lines, task, rules)
    return checked, check_caps(checked, task, rules)
