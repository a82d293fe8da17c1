"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a column expression over the text, its words and its lines; a rule is a row of the
table (measure, least, most), and the verdict is the conjunction of all rows. No user function runs
and nothing is shuffled, so a document costs the same wherever it lies.

Defined cases: a null or blank text has no words and fails; a null id or source is carried through;
repeated rows give repeated results; an empty table gives an empty table; columns of the input whose
names clash with those of the result are replaced by the result's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.text import let, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•", "‣", "·")

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as on be are this by from or "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als "
    "le la les de des et un une du en que qui dans pour par sur au "
    "el los las que y en un una por con para del se es"
).split()


@dataclass(frozen=True)
class Rule:
    """``least <= measure <= most``; None leaves a side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("few_words", "n_words", least=20),
    Rule("repeated_words", "repeat_ratio", most=0.30),
    Rule("word_length", "mean_word_chars", least=2.0, most=15.0),
    Rule("symbols", "symbol_ratio", most=0.25),
    Rule("stop_words", "stop_ratio", least=0.01),
    Rule("repeated_lines", "dup_line_ratio", most=0.40),
    Rule("bullet_lines", "bullet_line_ratio", most=0.90),
    Rule("cut_lines", "cut_line_ratio", most=0.50),
)


def _repeated(window_hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice.

    Sorted by hash, a window is repeated if a neighbour has its hash; the places of the repeated ones,
    sorted again, each add the words that the one after it doesn't.
    """

    def places(sorted_pairs: Column) -> Column:
        last = F.size(sorted_pairs) - 1
        marked = F.filter(
            sorted_pairs,
            lambda pair, i: ((i > 0) & (pair["h"] == F.get(sorted_pairs, i - 1)["h"]))
            | ((i < last) & (pair["h"] == F.get(sorted_pairs, i + 1)["h"])),
        )
        return F.sort_array(F.transform(marked, lambda pair: pair["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    pairs = F.sort_array(F.transform(window_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, places), covered)


def _window_hashes(h: Column) -> Column:
    """Hashes of all windows of eight words, by doubling: pairs, then pairs of pairs, then of those."""

    def joined(hashes: Column, step: int) -> Column:
        return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))

    doubled = let(joined(h, 1), lambda two: let(joined(two, 2), lambda four: joined(four, 4)))
    return F.slice(doubled, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ratios that rules refer to."""
    source = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(source, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.drop("_words", "_lines", "_hashes").select(
        "*",
        words(F.col(text)).alias("_words"),
        lines.alias("_lines"),
        (F.length(source) - F.length(F.regexp_replace(source, f"[{SYMBOLS}]+", ""))).cast("bigint").alias("n_symbols"),
    )
    windows = let(F.transform("_words", lambda w: F.xxhash64(w)), _window_hashes)
    base = base.withColumn("_hashes", windows)
    repeated = F.when(
        F.size("_hashes") == F.size(F.array_distinct("_hashes")), F.lit(0).cast("bigint")
    ).otherwise(_repeated(F.col("_hashes")))
    n_words, n_lines = F.size("_words").cast("bigint"), F.size("_lines").cast("bigint")
    counted = base.select(
        "*",
        n_words.alias("n_words"),
        n_lines.alias("n_lines"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (n_lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("bigint").alias("n_stop_words"),
        F.size(F.filter("_lines", lambda x: F.left(F.ltrim(x), F.lit(1)).isin(*BULLETS))).cast("bigint").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("bigint").alias("n_cut_lines"),
    ).drop("_words", "_lines", "_hashes")
    return counted.select(
        "*",
        _ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "n_words").alias("symbol_ratio"),
        _ratio("n_stop_words", "n_words").alias("stop_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        _ratio("n_cut_lines", "n_lines").alias("cut_line_ratio"),
    )


MEASURES = (
    "word_chars n_symbols n_words n_lines n_dup_lines n_repeat_words n_stop_words n_bullet_lines n_cut_lines "
    "repeat_ratio mean_word_chars symbol_ratio stop_ratio dup_line_ratio bullet_line_ratio cut_line_ratio"
).split()


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def _broken(rule: Rule) -> Column:
    value = F.col(rule.measure)
    low = value < rule.least if rule.least is not None else F.lit(False)
    high = value > rule.most if rule.most is not None else F.lit(False)
    return low | high


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents with their measures, ``broken_rules`` (names, in table order) and ``kept``."""
    clean = docs.drop(*MEASURES, "broken_rules", "kept")
    measured = with_measures(clean, text)
    names = F.array_compact(F.array(*[F.when(_broken(rule), F.lit(rule.name)) for rule in rules])) if rules else F.array().cast("array<string>")
    return measured.withColumn("broken_rules", names).withColumn("kept", F.size("broken_rules") == 0)


def quality_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return quality(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & F.col("kept")).alias("kept"),
        F.array_join("broken_rules", ",").alias("broken_rules"),
    )
