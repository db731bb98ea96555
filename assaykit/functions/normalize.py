"""Per-value scalar functions: categories, normalisation stages, shapes, masks and character flags.

Everything is a Column expression. The stages that have no built-in (NFC, case folding, accents)
are Arrow functions that only see values with characters outside ASCII, and callers apply
them to distinct values.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str.strip and str.isspace know.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
BREAKS = r"\n\x0b\x0c\r\x1c\x1d\x1e\x85  "
MARKERS = ("null", "none", "n/a", "na", "nan", "nil", "-", "--", "?")
NON_ASCII = r"[^\x00-\x7F]"
# What can be white space, or can be changed by a stage before case folding, has a character outside printable ASCII.
ODD = r"[^!-~]"
CATEGORIES = ("empty", "blank", "marker", "content")
STAGES = ("raw", "nfc", "trim", "collapse_whitespace", "casefold", "strip_accents")


@cache
def arrow_udf(name: str):
    """The Arrow function of this name: nfc, nfd, casefold, strip_accents or family."""
    import pyspark.sql.functions as f

    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    def nfd(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFD", x), na_action="ignore")

    def casefold(s: pd.Series) -> pd.Series:
        return s.map(str.casefold, na_action="ignore")

    def strip_accents(s: pd.Series) -> pd.Series:
        def bare(x: str) -> str:
            return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))

        return s.map(bare, na_action="ignore")

    def family(s: pd.Series) -> pd.Series:
        groups = {"L": "letter", "M": "mark", "N": "number", "P": "punctuation", "S": "symbol", "Z": "separator", "C": "other"}

        def of(c: str) -> str:
            kind = unicodedata.category(c)
            emoji = kind == "So" and 0x1F000 <= ord(c) <= 0x1FAFF
            return f"{'emoji' if emoji else groups[kind[0]]}/{kind}"

        return s.map(of, na_action="ignore")

    return f.pandas_udf({"family": family, "nfc": nfc, "nfd": nfd, "casefold": casefold, "strip_accents": strip_accents}[name], "string")


def guarded(name: str, value: Column, plain: Column) -> Column:
    """The Arrow function where there is a character outside ASCII, ``plain`` elsewhere."""
    return F.coalesce(arrow_udf(name)(F.when(value.rlike(NON_ASCII), value)), plain)


def character_family(value: Column) -> Column:
    """Group and general category of a single character, such as letter/Lu; for distinct characters."""
    return arrow_udf("family")(value)


def nfc(value: Column) -> Column:
    return guarded("nfc", value, value)


def trim(value: Column) -> Column:
    # single characters compare by their bytes, and those of printable ASCII at both ends leave nothing to trim
    visible = F.substring(value, 1, 1).between("!", "~") & F.substring(value, -1, 1).between("!", "~")
    return F.when(visible, value).otherwise(F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", ""))


def collapse(value: Column) -> Column:
    """Runs of white space other than line breaks become one space."""
    return F.when(value.rlike(r"\x20\x20|[^\x20-~]"), F.regexp_replace(value, f"[{SPACE}&&[^{BREAKS}]]+", " ")).otherwise(value)


def casefold(value: Column) -> Column:
    return guarded("casefold", value, F.lower(value))


def strip_accents(value: Column) -> Column:
    return guarded("strip_accents", value, value)


def analytical(value: Column) -> Column:
    return collapse(trim(nfc(value)))


def comparison_key(value: Column) -> Column:
    return strip_accents(casefold(analytical(value)))


def category(value: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """empty, blank, marker or content of a string; null stays null."""
    return (
        F.when(value == "", "empty")
        .when(~F.substring(value, 1, 1).between("!", "~") & value.rlike(f"^[{SPACE}]+$"), "blank")
        .when((F.length(trim(value)) <= max(map(len, markers), default=0)) & F.lower(trim(value)).isin(*markers), "marker")
        .when(value.isNotNull(), "content")
    )


def shape(value: Column) -> Column:
    """Digits as 9, upper case as A, other letters as a, runs squeezed to one."""
    # whole runs are replaced, so none is left to squeeze
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Lu}+", "A"), r"[\p{L}&&[^\p{Lu}]]+", "a"), r"\p{Nd}+", "9")


def mask(value: Column) -> Column:
    """Upper case as A, other letters as a, digits as 9; everything else stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Lu}", "A"), r"[\p{L}&&[^\p{Lu}A]]", "a"), r"\p{Nd}", "9")


def characteristics(value: Column) -> dict[str, Column]:
    """Nine flags of a string."""
    upper, lower = value.rlike(r"\p{Lu}"), value.rlike(r"\p{Ll}")
    return {
        "non_ascii": value.rlike(NON_ASCII),
        "line_breaks": value.rlike(r"[\n\r]"),
        "control": value.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"),
        "surrounding_whitespace": value.rlike(f"^[{SPACE}]|[{SPACE}]$"),
        "repeated_whitespace": value.rlike(f"[{SPACE}][{SPACE}]"),
        "upper": upper & ~lower,
        "lower": lower & ~upper,
        "mixed_case": upper & lower,
        "no_letters": ~value.rlike(r"\p{L}"),
    }


def presence(value: Column) -> dict[str, Column]:
    """Seventeen flags of what a string holds and is made of."""
    return {
        "ascii_lower": value.rlike("[a-z]"),
        "ascii_upper": value.rlike("[A-Z]"),
        "other_latin": value.rlike(r"[\p{IsLatin}&&[^A-Za-z]]"),
        "non_latin": value.rlike(r"[\p{L}&&[^\p{IsLatin}]]"),
        "ascii_digit": value.rlike("[0-9]"),
        "other_digit": value.rlike(r"[\p{Nd}&&[^0-9]]"),
        "starts_upper": value.rlike(r"^\p{Lu}"),
        "starts_lower": value.rlike(r"^\p{Ll}"),
        "tabs": value.contains("\t"),
        "no_break_space": value.rlike(r"[\xa0 ]"),
        "ascii_only": ~value.rlike(NON_ASCII),
        "letters_only": value.rlike(r"^\p{L}+$"),
        "digits_only": value.rlike("^[0-9]+$"),
        "alphanumeric_only": value.rlike(r"^[\p{L}\p{Nd}]+$"),
        "letters_and_digits": value.rlike(r"\p{L}") & value.rlike(r"\p{Nd}"),
        "invisible": value.rlike(r"[​-‏⁠﻿­]"),
        "replacement": value.contains("�"),
    }


def exposed(value: Column, mode: str) -> Column:
    """A value as it may be shown: show, mask or hide."""
    return {"show": value, "mask": mask(value), "hide": F.lit(None).cast("string")}[mode]


def name_tokens(name: str) -> list[str]:
    """Lower-case words of a field name: camel case, acronyms, digits and separators part them."""
    import re

    bare = "".join(c for c in unicodedata.normalize("NFD", name) if unicodedata.category(c) != "Mn")
    return [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", bare)]


def feature(value: Column, which: str) -> Column:
    """What a table of categories counts of a value: prefix (two characters), length, pattern (its shape) or value."""
    return {"prefix": F.substring(value, 1, 2), "length": F.length(value).cast("string"), "pattern": shape(value), "value": value}[which]
