"""Words of a text as column expressions, shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """All maximal runs of non-blank characters, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where the body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is 0; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == 0
