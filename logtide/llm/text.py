"""Column helpers shared by the operators that work on words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; empty for null or blank text."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows5(tokens: Column) -> Column:
    """64-bit hashes of all five-word windows in text order; a shorter text is one window, no word none.

    Windows of two, four and five words are built from one another by zipping an array with itself shifted.
    """
    def pairs(left: Column, right: Column, shift: int) -> Column:
        return F.zip_with(left, F.slice(right, F.lit(1 + shift), F.size(right)), lambda a, b: F.xxhash64(a, b))

    def spans(t: Column) -> Column:
        five = bind(F.transform(t, lambda w: F.xxhash64(w)), lambda one: bind(
            pairs(one, one, 1), lambda two: pairs(pairs(two, two, 2), one, 4)))
        return F.when(F.size(t) >= 5, F.slice(five, F.lit(1), F.size(t) - 4)) \
            .when(F.size(t) > 0, F.array(F.xxhash64(t))) \
            .otherwise(F.array().cast("array<bigint>"))
    return bind(tokens, spans)
