"""Tokenizing and n-gram column expressions, all inside Catalyst.

A token is cut at blanks, lower-cased, and stripped of every leading and trailing character outside a-z; what is left empty
is dropped, so ``star-cross'd`` stays whole and ``42`` disappears.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r\f]+"
#: Characters outside a-z that end a token, or begin one.
EDGES = r"[^a-z \t\n\r\f]++(?![a-z])|(?<![^ \t\n\r\f])[^a-z \t\n\r\f]++"


def tokenize(text: Column) -> Column:
    """array<string> of the tokens of ``text``; null text gives null.

    Edges are stripped from the whole text in one pass: a lambda for each token would leave generated code. Name the result
    in a select of its own before using it more than once, or it is computed for each use.
    """
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), EDGES, ""), BLANKS), "")


def adjacent(tokens: Column) -> Column:
    """array<struct<l,r>> of neighbouring tokens; empty below two tokens."""
    return shifted(tokens, 1)


def shifted(tokens: Column, by: int, back: bool = False) -> Column:
    """array<struct<l,r>> of tokens and those ``by`` places after them, or before them with ``back``."""
    n = F.size(tokens) - by
    early, late = F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(1 + by), n)
    pairs = F.arrays_zip((late if back else early).alias("l"), (early if back else late).alias("r"))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<l:string,r:string>>"))


def around(tokens: Column, window: int) -> Column:
    """array<struct<l,r>> of each token with every other within ``window`` places, by position."""
    return F.flatten(F.array(*[shifted(tokens, d, back) for d in range(1, window + 1) for back in (False, True)]))


def ellipsis(text: Column, width: int = 80) -> Column:
    """``text``, cut to ``width`` characters and marked when longer."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def log_sum(a: Column, b: Column) -> Column:
    """ln(e^a + e^b); a null or minus infinity stands for probability zero."""
    low, high = F.least(a, b), F.greatest(a, b)
    none = low.isNull() | (low == F.lit(float("-inf")))
    return F.when(none, high).otherwise(high + F.log1p(F.exp(low - high)))


def int_bytes(x: Column) -> Column:
    """The four bytes of an int, the highest first."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def string_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")
