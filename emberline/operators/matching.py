"""Matching posts with topics and with bursting terms."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.text import all_words, match_words, ngrams, text_runs
from emberline.operators import sizing
from emberline.operators.sizing import BROADCAST_ROWS, broadcast_if_bytes
from emberline.sources.scratch import stage

MEETINGS = 1 << 20  # posts beside topics that ask for one of their terms, held at a time
LISTED = 1_000  # terms of a window that are compared with every post searched for them, at most
FEW_TERMS = 64  # terms that are looked for in every text, at most
GRAM = 4  # characters of the key a substring is looked up by


# --- whole-word topic queries ---------------------------------------------------------------

def query_terms(topics: DataFrame) -> DataFrame:
    """``(topic_id, terms)``: the lower-case words, phrases and #tags of flat OR/AND queries.

    Stop words never match a word, so they only survive inside phrases.  A null query has no terms.
    """
    query = F.coalesce("query", F.lit(""))
    parts = F.transform(F.split(query, r"\s+(?:OR|AND|or|and)\s+"), lambda t: F.lower(F.trim(F.replace(t, F.lit('"'), F.lit("")))))
    return topics.select("topic_id", F.array_distinct(F.filter(parts, lambda t: F.length(t) > 0)).alias("terms"))


def _with_units(posts: DataFrame, phrase_lengths: list[int]) -> DataFrame:
    """Adds what query terms are compared with (``units``) and the post's length in words."""
    tags = F.transform(F.coalesce("hashtags", F.expr("cast(array() as array<string>)")), lambda t: F.concat(F.lit("#"), F.lower(t)))
    framed = posts.withColumn("__words", match_words(F.col("text")))
    units = [F.col("__words"), tags]
    if phrase_lengths:
        framed = framed.withColumn("__all", all_words(F.col("text")))
        units += [ngrams(F.col("__all"), n) for n in phrase_lengths]
    framed = framed.withColumn("units", F.concat(*units)).withColumn("length", F.size("__words"))
    return framed.drop("__words", "__all")


def _relevance(hits: Column, weight: Column, terms: Column, length: Column) -> Column:
    """Single-document TF-IDF score of ``hits`` found terms out of ``terms``.

    ``weight`` is the sum of √tf over the found terms.
    """
    found, missing = 1 + math.log(0.5), 1.0  # inverse document frequency with one document
    norm = 1 / F.sqrt(hits * found**2 + (terms - hits) * missing**2)
    return (hits / terms) * weight * found**2 * norm / F.sqrt(F.greatest(length, F.lit(1)))


def topic_scores(posts: DataFrame, topics: DataFrame, op: str = "or", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per post and matching topic with its ``score``.

    While the topics' terms are within the bounds of a broadcast, every task holds them with the topics that ask for each, and
    counts and scores the topics of its posts in the rows (:func:`_scorer`).  Beyond that, every distinct unit of a post that may
    be a term looks its topics up in a table by term.  No post is aggregated: the same plan serves batches and streams.
    """
    keep = tuple(keep or posts.columns)
    terms = query_terms(topics).filter(F.size("terms") > 0)
    per_term = terms.select("topic_id", "terms", F.explode("terms").alias("__term"))
    facts = per_term.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.length("__term") + F.length(F.array_join("terms", " ")) + 64), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(4 * F.length("__term") + 32), F.lit(0)).alias("own_bytes"),
        F.collect_set(F.size(F.split("__term", " "))).alias("lengths"),
    ).first()
    framed = _with_units(posts, sorted(set(facts.lengths) - {1}))
    if facts.own_bytes <= sizing.BROADCAST_BYTES:
        found = _scorer(terms, op)(F.col("units"), F.col("length"))
        return framed.select(*keep, found.alias("__found")).select(*keep, F.inline("__found"))
    lookup = broadcast_if_bytes(per_term, 1, facts.bytes)
    asked = framed.withColumn("units", F.filter("units", _maybe_in(per_term, facts.rows)))
    units = asked.select(*keep, "units", "length", F.explode(F.array_distinct("units")).alias("__term"))
    found = units.join(lookup, "__term").withColumn("own", F.array_intersect("units", "terms"))
    first = found.filter(F.element_at("own", 1) == F.col("__term"))
    if op == "and":
        first = first.filter(F.size("own") == F.size("terms"))
    weight = F.aggregate(
        "own", F.lit(0.0), lambda acc, t: acc + F.sqrt(F.size(F.filter("units", lambda u: u == t)))
    )
    score = _relevance(F.size("own"), weight, F.size("terms"), F.col("length"))
    return first.select(*keep, "topic_id", score.alias("score"))


def _scorer(terms: DataFrame, op: str):
    """A function of posts' units and lengths: per post the topics it matches, with their scores.

    The terms and, per term, the topics that ask for it come to the driver and go to the tasks; the caller checks their size.
    """
    asked = terms.select("topic_id", "terms").toArrow()
    ids, lists = (asked.column(name).combine_chunks() for name in ("topic_id", "terms"))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    by_term = np.repeat(np.arange(len(ids)), sizes)[np.argsort(code, kind="stable")]
    askers = np.bincount(code, minlength=len(coded.dictionary))
    begin = np.cumsum(askers) - askers

    def score(units: pa.Array, lengths: pa.Array) -> pa.Array:
        term = pc.index_in(units.flatten(), value_set=coded.dictionary)
        row = np.repeat(np.arange(len(units)), pc.fill_null(pc.list_value_length(units), 0).to_numpy())
        known = pc.is_valid(term).to_numpy(zero_copy_only=False)
        uses, tf = np.unique(row[known] * len(askers) + term.drop_null().to_numpy(), return_counts=True)
        row, term = uses // max(1, len(askers)), uses % max(1, len(askers))
        ends = np.cumsum(askers[term])
        found, low = [], 0
        while low < len(row):  # as many posts at a time as ask for MEETINGS topics, one at least
            high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MEETINGS, side="right"))
            high = int(np.searchsorted(row, row[min(high, len(row) - 1)])) if high < len(row) else high
            high = max(high, int(np.searchsorted(row, row[low], side="right")))
            n = askers[term[low:high]]
            topic = by_term[np.repeat(begin[term[low:high]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pair, at = np.unique(np.repeat(row[low:high], n) * len(ids) + topic, return_inverse=True)
            own, weight = np.bincount(at), np.bincount(at, weights=np.repeat(np.sqrt(tf[low:high]), n))
            if op == "and":
                whole = own == sizes[pair % len(ids)]
                pair, own, weight = pair[whole], own[whole], weight[whole]
            found.append((pair, own, weight))
            low = high
        pair, own, weight = (np.concatenate(c) for c in zip((np.empty(0, np.int64),) * 2 + (np.empty(0),), *found))
        row, topic = pair // max(1, len(ids)), pair % max(1, len(ids))
        hits = np.bincount(row, minlength=len(units))
        length = pc.fill_null(lengths, 0).to_numpy()[row]
        base = 1 + math.log(0.5)
        norm = 1 / np.sqrt(own * base**2 + (sizes[topic] - own))
        scores = (own / sizes[topic]) * weight * base**2 * norm / np.sqrt(np.maximum(length, 1))
        rows = pa.StructArray.from_arrays([ids.take(pa.array(topic)), pa.array(scores, pa.float64())], names=["topic_id", "score"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hits)]), pa.int32()), rows)

    topic_type = terms.schema["topic_id"].dataType.simpleString()
    return F.arrow_udf(score, f"array<struct<topic_id:{topic_type},score:double>>")


def _maybe_in(per_term: DataFrame, rows: int):
    """A test that every term passes and few other strings do: one byte per hash slot, as a literal.

    It spares exploding the units that no topic asks for.  The literal has 16 slots per term, 16 MB at most.
    """
    slots = min(1 << max(14, (16 * rows).bit_length()), 1 << 24)
    slot = lambda term: F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")
    table = bytearray(slots)
    for row in per_term.select(slot("__term").alias("slot")).distinct().toLocalIterator():
        table[row.slot] = 1
    return lambda term: F.substring(F.lit(bytes(table)), slot(term) + 1, F.lit(1)) == F.lit(b"\x01")


def topic_match(posts: DataFrame, topics: DataFrame, threshold: float = 0.0, op: str = "or") -> DataFrame:
    """Posts and the topics they score strictly above ``threshold`` for."""
    return topic_scores(posts, topics, op).filter(F.col("score") > threshold)


def match_any_topic(posts: DataFrame, topics: DataFrame, threshold: float = 0.0, op: str = "or") -> DataFrame:
    """Posts whose scores summed over all topics exceed ``threshold``, each once."""
    scored = topic_scores(posts, topics, op, keep=("post_id",))
    ids = scored.groupBy("post_id").agg(F.sum("score").alias("score")).filter(F.col("score") > threshold)
    return posts.join(ids.select("post_id"), "post_id", "left_semi")


def match_summary(scored: DataFrame) -> DataFrame:
    """Best and mean score per topic."""
    return scored.groupBy("topic_id").agg(
        F.count("*").alias("matches"), F.max("score").alias("best"), F.avg("score").alias("mean")
    )


# --- substring matching ---------------------------------------------------------------------

def topic_tokens(topics: DataFrame) -> DataFrame:
    """``(topic_id, term)`` of the topics' token lists, lower case, without those of blanks only."""
    rows = topics.select("topic_id", F.explode("tokens").alias("term"))
    return rows.select("topic_id", F.lower("term").alias("term")).filter(F.col("term").rlike(r"[^ \t\n]")).distinct()


def _pieces(run: Column, n: int) -> Column:
    """All pieces of ``n`` characters of a stretch (the stretch itself if it is shorter)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(run, i, F.lit(n)))


def substring_matches(posts: DataFrame, terms: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(post_id, *keep, term)`` wherever a term is a substring of the lower-case text.

    A term without blanks lies inside one blank-free stretch of the text.  Distinct stretches are
    compared with the terms once for the whole corpus, looked up by the terms' first characters,
    and posts join the resulting (stretch, term) table on equality: no pair of post and term is
    formed that does not match.  Terms with blanks use their longest part and are verified.
    A few terms (``FEW_TERMS`` at most) are looked for in every text instead: no word leaves its row.
    ``terms`` is read several times: pass a small or staged table.
    """
    ids = ["post_id", *keep]
    parts = F.split("term", r"[ \t\n]+")
    longest = F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    keyed = terms.select("term").distinct().select("term", longest.alias("part")).filter(F.length("part") > 0)
    keyed = keyed.withColumn("gram", F.substring("part", 1, GRAM))
    facts = keyed.agg(
        F.count("*").alias("terms"),
        F.collect_set(F.length("gram")).alias("lengths"),
        F.max(F.col("term") != F.col("part")).alias("blanks"),
    ).first()
    if facts.terms == 0:
        return posts.select(*ids, F.lit("").alias("term")).limit(0)
    if facts.terms <= FEW_TERMS:
        found = [F.when(F.contains(F.col("__text"), F.lit(r.term)), F.lit(r.term)) for r in keyed.select("term").collect()]
        texts = posts.select(*ids, F.lower("text").alias("__text"))
        return texts.select(*ids, F.explode(F.array_compact(F.array(*found))).alias("term")).distinct()
    runs = posts.select(*ids, F.explode(text_runs(F.col("text"))).alias("run"))
    grams = F.array_distinct(F.concat(*[_pieces(F.col("run"), n) for n in sorted(facts.lengths)]))
    vocabulary = runs.select("run").distinct().select("run", F.explode(grams).alias("gram"))
    keyed = F.broadcast(keyed) if facts.terms <= BROADCAST_ROWS else keyed
    inside = vocabulary.join(keyed, "gram").filter(F.contains("run", "part")).select("run", "term", "part").distinct()
    # Staged, its size is known: while it is small, the words of the corpus are not shuffled for it.
    inside = stage(inside, "stretches")
    size = inside.agg(F.coalesce(F.sum(F.length("run") + F.length("term") + F.length("part") + 64), F.lit(0))).first()[0]
    hits = runs.join(broadcast_if_bytes(inside, 1, size), "run")
    if not facts.blanks:
        return hits.select(*ids, "term").distinct()
    # Terms with blanks are checked against the whole text; the others are matches already.
    hits = hits.select(*ids, "term", "part").distinct()
    whole = hits.filter(F.col("term") == F.col("part")).select(*ids, "term")
    split = hits.filter(F.col("term") != F.col("part")).select(*ids, "term")
    checked = split.join(posts.select("post_id", "text"), "post_id").filter(F.contains(F.lower("text"), F.col("term")))
    return whole.unionByName(checked.select(*ids, "term"))


def _contains_any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms], F.lit(False))


def keyword_match(posts: DataFrame, topics: DataFrame) -> DataFrame:
    """Posts whose lower-case text contains any topic token as a substring.

    A batch looks the tokens up by their first characters (:func:`substring_matches`).  A stream, which
    can't group posts, tests each text against the list of tokens; the list is the topics' own, read
    when the stream starts.
    """
    terms = topic_tokens(topics).select("term").distinct()
    if posts.isStreaming:
        return posts.filter(_contains_any(F.lower("text"), sorted(r.term for r in terms.collect())))
    posts = stage(posts, "searched")  # parsed and filtered once, read by every branch
    ids = substring_matches(posts, terms).select("post_id").distinct()
    return posts.join(ids, "post_id", "left_semi")


def term_post_matches(posts: DataFrame, terms: DataFrame, match: str = "substring", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(post_id, *keep, term)`` by substring, or by equality with one of the post's tokens."""
    if match == "substring":
        return substring_matches(posts, terms, keep)
    tokens = posts.select("post_id", *keep, F.explode(F.array_distinct("tokens")).alias("term"))
    return tokens.join(terms.select("term").distinct(), "term", "left_semi").select("post_id", *keep, "term")


def _searches(terms: DataFrame, reach: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, term, win, slot)``: the slots whose posts a window searches for its terms."""
    back = F.sequence(F.col("win") - (reach - 1), F.col("win"))
    return terms.select(*keys, F.col("token").alias("term"), "win", F.explode(back).alias("slot"))


def match_posts(posts: DataFrame, terms: DataFrame, reach: int, match: str = "substring") -> DataFrame:
    """First window in which each post contains one of the window's terms: ``(post_id, win)``.

    ``posts`` has its own ``slot``, ``terms`` is ``(win, token)``; a window searches the posts of
    its last ``reach`` slots (the major window, plus the slots a minor window carries posts
    forward).  Term and slot are joined on equality with a table that holds, per term and slot,
    the first window searching that slot for it.
    """
    first = _searches(terms, reach).groupBy("term", "slot").agg(F.min("win").alias("win"))
    hits = term_post_matches(posts, terms.select(F.col("token").alias("term")), match, ("slot",))
    return hits.join(first, ["term", "slot"]).groupBy("post_id").agg(F.min("win").alias("win"))


def window_hits(
    posts: DataFrame, terms: DataFrame, reach: int, keys: tuple[str, ...] = (), match: str = "substring"
) -> DataFrame:
    """Number of a window's terms each searched post contains: ``(*keys, win, post_id, hits)``.

    With ``keys`` both sides carry them, e.g. the topic a post and a term belong to.
    """
    named = terms.select(F.col("token").alias("term"))
    hits = term_post_matches(posts, named, match, (*keys, "slot"))
    placed = hits.join(_searches(terms, reach, keys), [*keys, "term", "slot"])
    return placed.groupBy(*keys, "win", "post_id").agg(F.count("*").alias("hits"))


def listed_hits(posts: DataFrame, terms: DataFrame, reach: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``window_hits`` by substring, for windows with few terms (``LISTED`` at most; others are looked up).

    ``terms`` names a term once per key and window.  Each searched post meets its windows' lists of terms, so no
    word of a text is exploded or shuffled; where rows of a post share a slot, terms found in several of them count once.
    """
    named = terms.filter(F.col("token").rlike(r"[^ \t\n]"))
    size = F.sum(F.length("token") * 4 + 32)
    facts = named.groupBy(*keys, "win").agg(F.count("*").alias("n"), size.alias("bytes")).agg(F.max("n").alias("most"), F.sum("bytes").alias("bytes")).first()
    if (facts.most or 0) > LISTED:
        return window_hits(posts, terms, reach, keys)
    lists = broadcast_if_bytes(named.groupBy(*keys, "win").agg(F.collect_list("token").alias("__terms")), 1, facts.bytes or 0)
    searched = posts.select(*keys, "post_id", "slot", F.lower("text").alias("__text"))
    searched = searched.withColumn("win", F.explode(F.sequence("slot", F.col("slot") + (reach - 1))))
    places = F.sequence(F.lit(1), F.size("__terms"))
    found = F.filter(places, lambda i: F.contains(F.col("__text"), F.element_at("__terms", i)))
    rows = searched.join(lists, [*keys, "win"]).select(*keys, "win", "post_id", "slot", found.alias("found")).filter(F.size("found") > 0)
    per_slot = rows.groupBy(*keys, "win", "post_id", "slot").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("hits"))
    return per_slot.groupBy(*keys, "win", "post_id").agg(F.sum("hits").alias("hits"))


def keep_max_hits(hits: DataFrame, keys: tuple[str, ...] = ("win",), column: str = "hits") -> DataFrame:
    """Posts that reach the largest count of their group."""
    best = hits.groupBy(*keys).agg(F.max(column).alias("__best"))
    return hits.join(best, list(keys)).filter(F.col(column) == F.col("__best")).drop("__best")


def assign_topics(posts: DataFrame, topics: DataFrame, by: str = "query", op: str = "or", sep: str = "+") -> DataFrame:
    """``(post_id, topic)``: ids of all topics a post matches, joined by ``sep`` in id order.

    ``query`` matches the topics' text queries, ``tokens`` their tokens as substrings.
    """
    if by == "query":
        rows = topic_scores(posts, topics, op, keep=("post_id",)).select("post_id", "topic_id")
    else:
        tokens = topic_tokens(topics)
        hits = substring_matches(posts, tokens)
        rows = hits.join(tokens, "term").select("post_id", "topic_id").distinct()
    label = F.array_join(F.array_sort(F.collect_set("topic_id")), sep)
    return rows.groupBy("post_id").agg(label.alias("topic"))


def gate_posts(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts whose id is a candidate."""
    return posts.join(ids.select("post_id"), "post_id", "left_semi")


def unseen_only(posts: DataFrame, delivered: DataFrame) -> DataFrame:
    """Posts not delivered yet."""
    return posts.join(delivered.select("post_id"), "post_id", "left_anti")


def new_gated(matched: DataFrame, tagged: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched ids that are candidates and were not tagged before."""
    return gate_posts(unseen_only(matched.select("post_id").distinct(), tagged), candidates)
