"""Identifier and name functions as column expressions."""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a security identifier in the order of their values, and the pattern of a FIGI (fixed values).
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"
FIGI = "^BBG[0-9A-Z]{9}$"


def check_digit(eight: Column) -> Column:
    """Check digit of the first eight characters; null where one isn't in the alphabet."""
    total = F.lit(0)
    for k in range(8):
        at = F.instr(F.lit(ALPHABET), F.substring(eight, k + 1, 1)) - 1
        v = F.when(at >= 0, at * (2 if k % 2 else 1))
        total = total + F.floor(v / 10) + v % 10
    return (F.lit(10) - total % 10) % 10


def valid_identifier(x: Column) -> Column:
    return F.coalesce((F.length(x) == 9) & (F.substring(x, 9, 1) == check_digit(x).cast("string")), F.lit(False))


def repair_identifier(raw: Column) -> Column:
    """struct(fixed, action) of an identifier without blanks and dashes, in capitals.

    ok: valid as it stands; padded: valid with the zeros that were lost in front; appended_check:
    eight characters, which get their check digit; recovered: nine whose check digit is wrong,
    so the body is kept and gets another; invalid otherwise.
    """
    x = F.regexp_replace(F.upper(F.trim(raw)), "[ -]", "")
    shaped = lambda n: x.rlike(f"^[0-9A-Z*@#]{{{n}}}$")
    padded = F.lpad(x, 9, "0")
    checked = F.concat(F.substring(x, 1, 8), check_digit(x).cast("string"))
    found = lambda fixed, action: F.struct(fixed.alias("fixed"), F.lit(action).alias("action"))
    return (
        F.when(valid_identifier(x), found(x, "ok"))
        .when((x != "") & (F.length(x) < 9) & valid_identifier(padded), found(padded, "padded"))
        .when(shaped(8), found(checked, "appended_check"))
        .when(shaped(9), found(checked, "recovered"))
        .otherwise(found(F.lit(None).cast("string"), "invalid"))
    )


def valid_figi(x: Column) -> Column:
    return F.coalesce(F.upper(x).rlike(FIGI), F.lit(False))


def normal_ticker(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(x)), "[./]", "-"), r"\s+", "")


def name_tokens(x: Column, stop: tuple[str, ...] = ("INC", "CORP", "LTD", "LLC", "LP", "CO", "THE", "GROUP", "HOLDINGS")) -> Column:
    """Sorted distinct words of a name without punctuation and the words in ``stop``."""
    words = F.split(F.trim(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*stop))))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings, which no built-in function gives."""
    ratio = functools.lru_cache(maxsize=65536)(lambda x, y: difflib.SequenceMatcher(None, x, y).ratio())
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def clean_number(x: Column) -> Column:
    """A number out of text; placeholders and anything else are null."""
    return F.regexp_replace(F.trim(x), "[$,]", "").try_cast("double")


def truthy(x: Column) -> Column:
    return F.coalesce(F.upper(F.trim(x)).isin("Y", "YES", "TRUE", "T", "1"), F.lit(False))


def accession_of(path: Column) -> Column:
    """The accession number in a path or text, dashed."""
    digits = F.regexp_extract(path, r"(\d{10})-?(\d{2})-?(\d{6})", 0)
    plain = F.replace(digits, F.lit("-"))
    return F.when(digits != "", F.concat_ws("-", F.substring(plain, 1, 10), F.substring(plain, 11, 2), F.substring(plain, 13, 6)))
