"""Entities and tokens as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How entities look in raw text when a source carries none.
HASHTAG_PATTERN = r"#(\w+)"
MENTION_PATTERN = r"@(\w+)"
URL_PATTERN = r"(https?://\S+)"
SEPARATOR_PATTERN = r"[\p{Punct}\n\t]"
WORD_PATTERN = r"([\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)*)"

# English stop words of the text matcher.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with"
).split()


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def extract_entities(text: Column) -> dict[str, Column]:
    """Hashtags, mentions, urls and media of plain text."""
    found = F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(1))
    return {
        "hashtags": F.regexp_extract_all(text, F.lit(HASHTAG_PATTERN), F.lit(1)),
        "mentions": F.regexp_extract_all(text, F.lit(MENTION_PATTERN), F.lit(1)),
        "urls": F.transform(found, lambda u: F.struct(u.alias("url"), u.alias("expanded"))),
        "media": F.expr("cast(array() as array<struct<url:string,expanded:string>>)"),
    }


def _or_empty(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.expr(f"cast(array() as array<{kind}>)"))


def _blank(text: Column, pieces: Column) -> Column:
    return F.aggregate(pieces, text, lambda acc, piece: F.replace(acc, piece, F.lit(" ")))


def tokenize(text: Column, hashtags: Column, mentions: Column, urls: Column, media: Column) -> Column:
    """Entities first, then the words left once entities and ASCII punctuation are blanked out."""
    link = "struct<url:string,expanded:string>"
    tags = F.transform(_or_empty(hashtags, "string"), lambda t: F.concat(F.lit("#"), t))
    names = F.transform(_or_empty(mentions, "string"), lambda m: F.concat(F.lit("@"), m))
    urls, media = _or_empty(urls, link), _or_empty(media, link)
    cut = F.concat(tags, names, F.transform(urls, lambda u: u["url"]), F.transform(media, lambda m: m["url"]))
    bare = F.regexp_replace(_blank(text, cut), SEPARATOR_PATTERN, " ")
    words = F.array_remove(F.split(bare, " "), "")
    return F.concat(
        tags, names, F.transform(urls, lambda u: u["expanded"]), F.transform(media, lambda m: m["expanded"]), words
    )


def post_tokens(style: str = "summary") -> Column:
    """Tokens of a post row in one of three styles.

    ``summary`` adds the bare hashtags and lower-cases everything, ``learner`` adds ``#tag`` once
    more and keeps case, ``plain`` is the tokenizer's output.
    """
    base = tokenize(F.col("text"), F.col("hashtags"), F.col("mentions"), F.col("urls"), F.col("media"))
    tags = _or_empty(F.col("hashtags"), "string")
    if style == "summary":
        return F.transform(F.concat(base, tags), lambda t: F.lower(t))
    if style == "learner":
        return F.concat(base, F.transform(tags, lambda t: F.concat(F.lit("#"), t)))
    if style == "plain":
        return base
    raise ValueError(f"unknown token style {style!r}")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` consecutive tokens, joined by a space.

    Shifted copies are zipped, so that ``tokens`` is evaluated per row and not per element.
    """
    runs = tokens
    for k in range(2, n + 1):
        shifted = F.slice(tokens, k, F.greatest(F.size(tokens) - (k - 1), F.lit(0)))
        runs = F.zip_with(runs, shifted, lambda run, t: F.when(t.isNotNull(), F.concat(run, F.lit(" "), t)))
        runs = F.filter(runs, lambda run: run.isNotNull())
    return runs


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by adjacent pairs joined by a space."""
    return F.concat(tokens, ngrams(tokens, 2))


def strip_punct_tokens(text: Column) -> Column:
    """ASCII punctuation dropped, lower case, split on a space; empty pieces stay."""
    return F.split(F.lower(F.regexp_replace(text, r"\p{Punct}", "")), " ", -1)


def clean_tokens(text: Column) -> Column:
    """Distinct lower-case pieces; everything but ASCII letters, digits and backslash separates."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9\\]", " "), " ", -1))


def match_words(text: Column) -> Column:
    """Lower-case words a text query is matched against; stop words stay out."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def all_words(text: Column) -> Column:
    """Like :func:`match_words` with stop words kept, for phrases."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1))


def text_runs(text: Column) -> Column:
    """Distinct lower-case stretches of text between spaces, tabs and line ends."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n]+"), lambda r: F.length(r) > 0))
