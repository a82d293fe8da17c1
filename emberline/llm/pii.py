"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose overlapping spans per kind, with a high recall. Checked patterns (`BASE`) decide some of
them for sure; these are always redacted. They, and the same values in ways of writing that the checked
patterns miss (no country code, "(at)"), teach a gradient-boosted classifier, which sees the format and
the context of a candidate but not the checks, what such a span looks like. Per kind a
threshold is calibrated on candidates that the trees were not fitted to: the lowest one at which the
precision there is at least ``PRECISION``. Candidates above it that overlap no sure span are taken in the
order of their margins, each unless it overlaps one taken before, and redacted as well. The generators also run
on the text between sure spans, so a match that begins or ends in one doesn't hide what lies beside it.

The trees are compiled into a column expression, so that finding spans in a text is one projection: no
shuffle, no join and no user function, and a text's spans never leave its row. Fitting takes all candidates, as
counts of equal features and labels; so does the calibration.

Offsets are code points, ends exclusive. Defined cases: null and empty texts have no spans; with nothing to
learn from (no candidate that passes, or none that fails) only sure spans are redacted; repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.text import let
from emberline.sources.scratch import stage

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS = 250_000  # distinct rows of a task of the fit
PRECISION = 0.95
LEAST_MARGIN = 0.5
TREES, DEPTH = 12, 3

# Possessive groups and starts that can't lie inside a run: the same matches as the plain patterns,
# without recursion and without trying every start of a long run.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3,}+|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+",
    "card": r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){11,22}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?[0-9(][0-9\x20()./-]{5,18}[0-9](?![0-9A-Za-z])",
}
#: Digits of a candidate at least and at most.
DIGITS = {"card": (13, 19), "phone": (9, 15)}
#: What a text must contain for a pattern to be tried at all.
HINTS = {"email": r"@|[\(\[]at[\)\]]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]", "phone": r"[0-9]"}
CUES = {
    "email": r"(?i)mail|contact|write|correo",
    "ip": r"(?i)\bip\b|host|server|addr",
    "card": r"(?i)card|visa|credit|tarjeta|carte|karte",
    "phone": r"(?i)tel|phone|call|fax|mobile|ruf",
}
SPAN = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value): gaps and matches laid end to end."""
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda value, gap: F.struct(value.alias("value"), F.length(gap).alias("gap")),
    )
    found = F.filter(pairs, lambda p: p["value"].isNotNull())

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(found, none, add, lambda done: done["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", ""))
        return F.forall(parts, lambda part: (F.length(part) <= 3) & (F.coalesce(part.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(14, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _tried(text: Column, kind: str, patterns: dict[str, str]) -> Column:
    return F.when(text.rlike(HINTS[kind]), spans(text, patterns[kind])).otherwise(F.array().cast(SPAN))


def _covered(text: Column, sure: Column) -> Column:
    """The text with every character of its sure spans (ascending) replaced by one that no generator takes."""

    def cover(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        own = F.repeat(F.lit("\ufffc"), F.greatest(s["end"] - F.greatest(s["start"], done["at"]), F.lit(0)))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], gap, own).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(sure, start, cover, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def _share(part: Column, pattern: str) -> Column:
    return F.length(part) - F.length(F.regexp_replace(part, pattern, ""))


def _side(char: Column) -> Column:
    """Class of a neighbouring character: none, blank, letter, digit, other."""
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"[0-9]"), 3).when(char.rlike(r"\p{L}"), 2).otherwise(4)


FEATURES = "kind_no length n_digits n_marks n_letters n_groups longest first_group last_group before after cue line_start".split()


def _features(text: Column, kind: str, span: Column) -> list[Column]:
    """Format and context as integers, in the order of FEATURES; the sure checks are not among them."""
    value = span["value"]
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    left = F.substring(text, F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24)))
    columns = [
        F.lit(KINDS.index(kind)),
        F.length(value),
        _share(value, "[0-9]"),
        _share(value, r"[^0-9A-Za-z]"),
        _share(value, r"[A-Za-z]"),
        F.size(groups),
        F.coalesce(F.array_max(sizes), F.lit(0)),
        F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)),
        F.coalesce(F.get(sizes, F.size(sizes) - 1), F.lit(0)),
        _side(F.when(span["start"] > 0, F.substring(text, span["start"], 1)).otherwise("")),
        _side(F.substring(text, span["end"] + 1, 1)),
        left.rlike(CUES[kind]).cast("int"),
        (F.trim(F.element_at(F.split(left, "\n"), -1)) == "").cast("int"),
    ]
    return [c.cast("int").alias(name) for c, name in zip(columns, FEATURES)]


#: Kinds that people also write in a way the checked patterns miss.
FORMS = ("email", "card", "phone")


def _forms(kind: str, value: Column) -> list[Column]:
    """A sure value in other ways of writing: they teach the classifier what the checks can't see."""
    if kind == "email":
        round_, square = (F.regexp_replace(F.regexp_replace(value, r"\.", f" {dot} "), "@", f" {at} ") for at, dot in (("(at)", "(dot)"), ("[at]", "[dot]")))
        return [round_, square, F.regexp_replace(value, "@", " (at) ")]
    if kind == "card":
        return [F.regexp_replace(_digits(value), "([0-9]{4})(?=[0-9])", f"$1{mark}") for mark in (".",)]
    local = F.regexp_replace(value, r"^\+[0-9]{1,2}[\x20.-]?", "")
    plain = F.regexp_replace(F.regexp_replace(local, "[^0-9]+", "-"), "^-", "")
    return [local, plain, F.regexp_replace(plain, "-", "."), F.regexp_replace(plain, "-", " ")]


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds ``sure`` (start, kind_no, end), ``candidates`` (the same and features), ``between`` and ``forms`` (features).

    ``between`` holds the candidates of the text without its sure spans; the model isn't fitted to them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def sure_of(number: int, kind: str) -> Column:
        found = F.filter(_tried(text, kind, BASE), lambda s: _passes(kind, s["value"]))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind_no"), s["end"].alias("end")))

    def proposed(kind: str, within: Column = text) -> Column:
        found = _tried(within, kind, GENERATORS)
        if kind in DIGITS:
            found = F.filter(found, lambda s: F.length(_digits(s["value"])).between(*DIGITS[kind]))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *_features(text, kind, s)))

    def rewritten(kind: str) -> Column:
        def one(s: Column) -> Column:
            value = F.substring(text, s["start"] + 1, s["end"] - s["start"])
            left = F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
            right = F.substring(text, s["end"] + 1, 1)
            span = lambda v: F.struct(F.length(left).alias("start"), (F.length(left) + F.length(v)).alias("end"), v.alias("value"))
            forms = [F.struct(*_features(F.concat(left, v, right), kind, span(v))) for v in _forms(kind, value)]
            return F.array(*forms)

        own = F.filter("sure", lambda s: s["kind_no"] == KINDS.index(kind))
        return F.flatten(F.transform(own, one))

    sure = F.concat(*[sure_of(number, kind) for number, kind in enumerate(KINDS)])
    found = docs.withColumn("sure", F.array_sort(sure)).withColumn("candidates", F.concat(*map(proposed, KINDS)))
    beside = let(_covered(text, F.col("sure")), lambda open_: F.concat(*[proposed(kind, open_) for kind in KINDS]))
    found = found.withColumn("between", F.when(F.size("sure") > 0, beside).otherwise(F.slice("candidates", 1, 0)))
    return found.withColumn("forms", F.concat(*map(rewritten, FORMS)))



@dataclass
class Model:
    """Nested splits per tree, tree weights, and thresholds on the margin per kind."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, candidate: Column) -> Column:
        """The compiled trees: nested conditions over the candidate's features."""

        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            feature, cut, low, high = tree
            return F.when(candidate[FEATURES[feature]] <= F.lit(cut), node(low)).otherwise(node(high))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + node(tree) * F.lit(float(weight))
        return total

    def accepts(self, candidate: Column) -> Column:
        good = F.lit(False)
        for kind, cut in self.thresholds.items():
            good = good | ((candidate["kind_no"] == kind) & (candidate["margin"] >= cut))
        return good


def _parse(lines: list[str]) -> object:
    """One tree of the classifier's text form: a number, or (feature, cut, low, high)."""
    line = lines.pop(0)
    if found := re.match(r"\s*Predict: (\S+)", line):
        return float(found[1])
    feature, cut = re.match(r"\s*If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _parse(lines)
    lines.pop(0)  # Else
    return int(feature), float(cut), low, _parse(lines)


def fit(found: DataFrame) -> Model:
    """Fit the trees and the thresholds on candidates of ``found`` (a staged table with_candidates)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    def known(c: Column) -> Column:
        return F.exists("sure", lambda s: (s["start"] == c["start"]) & (s["end"] == c["end"]) & (s["kind_no"] == c["kind_no"]))

    labelled = F.transform("candidates", lambda c: c.withField("label", known(c).cast("int")))
    forms = F.transform("forms", lambda c, i: F.struct((-1 - i).alias("start"), F.lit(0).alias("end"), *[c[f] for f in FEATURES], F.lit(1).alias("label")))
    rows = found.select(F.xxhash64("doc_id", "sure").alias("doc"), F.explode(F.concat(labelled, forms)).alias("c")).select("doc", "c.*")
    # Equal features make one weighted row, so all candidates count, however many there are, and the order of rows doesn't.
    kinds = [(F.pmod("doc", F.lit(4)) == 0).alias("held"), (F.col("end") == 0).alias("form")]
    rows = stage(rows.groupBy(*FEATURES, "label", *kinds).agg(F.count("*").cast("double").alias("n")), "pii-candidates")
    fitted = stage(rows.filter("not held").groupBy(*FEATURES, "label").agg(F.sum("n").alias("n")), "pii-fitted")
    fitted = fitted.orderBy(*FEATURES, "label").coalesce(max(1, -(-fitted.count() // FIT_ROWS)))
    if fitted.select("label").distinct().count() < 2:
        return Model()
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(fitted.withColumn("label", F.col("label").cast("double")))
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, weightCol="n", seed=7).fit(vectors.select("features", "label", "n"))
    trees = []
    for tree in gbt.trees:
        trees.append(_parse([line for line in tree.toDebugString.splitlines()[1:] if line.strip()]))
    model = Model(trees, list(gbt.treeWeights))
    struct = F.struct(*FEATURES)
    scored = rows.filter("held").withColumn("margin", F.round(let(struct, model.margin), 1))
    weight = F.col("n") * F.when(F.col("form"), 0.25).otherwise(1.0)  # a value's other forms count as one candidate
    levels = scored.groupBy("kind_no", "margin").agg(F.sum(weight * F.col("label")).alias("right"), F.sum(weight).alias("n"))
    by_kind: dict[int, list] = {}
    for row in levels.collect():  # one row per kind and tenth of a margin
        by_kind.setdefault(row.kind_no, []).append((row.margin, row.right, row.n))
    for kind, levels in by_kind.items():
        right = total = 0.0
        for margin, hits, n in sorted(levels, reverse=True):
            right, total = right + hits, total + n
            if right and right >= PRECISION * total:
                model.thresholds[kind] = max(margin - 0.05, LEAST_MARGIN)
    return model


def with_spans(found: DataFrame, model: Model) -> DataFrame:
    """Adds ``added``: accepted candidates that overlap no sure span, the best first, none overlapping a better one of these."""

    def overlap(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def ranked(c: Column) -> Column:  # in ascending order: the best margin, then the earliest, the longest, the first kind
        return F.struct((-c["margin"]).alias("worse"), c["start"].alias("start"), (-c["end"]).alias("back"), c["kind_no"].alias("kind_no"), c["end"].alias("end"))

    def take(kept: Column, c: Column) -> Column:
        own = F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end"))
        return F.when(F.exists(kept, lambda k: overlap(k, c)), kept).otherwise(F.concat(kept, F.array(own)))

    free = F.filter(F.concat("candidates", "between"), lambda c: ~F.exists("sure", lambda s: overlap(c, s)))
    scored = F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end"), model.margin(c).alias("margin")))
    best = F.array_sort(F.transform(F.filter(scored, model.accepts), ranked))
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    return found.withColumn("added", F.aggregate(best, none, take))


def _joined(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(
        F.array_sort(array), lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def private_data_digest(docs: DataFrame) -> DataFrame:
    """One row per document: sure spans per kind, their checksum, and all spans."""
    found = stage(with_candidates(docs.select("doc_id", "text")).select("doc_id", "sure", "candidates", "between", "forms"), "pii-spans")

    def count(number: int, kind: str) -> Column:
        return F.size(F.filter("sure", lambda s: s["kind_no"] == number)).cast("bigint").alias(f"n_{kind}")

    counts = [count(number, kind) for number, kind in enumerate(KINDS)]
    return with_spans(found, fit(found)).select(
        "doc_id", *counts, F.sha2(_joined(F.col("sure")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("sure", "added")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """The documents with every span replaced by its kind; a text without spans stays as it is."""
    found = with_candidates(docs.select("*"))
    model = fit(stage(found.select("doc_id", "sure", "candidates", "forms"), "pii-spans"))
    names = F.array(*[F.lit(mark.format(k)) for k in KINDS])

    def cut(done: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        step = F.concat(done["out"], gap, F.when(s["start"] >= done["at"], F.get(names, s["kind_no"])).otherwise(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), step.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    all_spans = F.array_sort(F.concat("sure", "added"))
    text = F.when(F.size(all_spans) > 0, F.aggregate(all_spans, start, cut, rest)).otherwise(F.col("text"))
    return with_spans(found, model).withColumn("text", text).drop("sure", "candidates", "between", "forms", "added")
