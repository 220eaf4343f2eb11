"""Text functions as columns; they stay in the JVM unless noted."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words without content in questions and evidence.
STOPWORDS = (
    "a about after all an and any are as at be before by can does for from how if in including is it its may must of on or "
    "should that the their these they this to under use used what when which who why with"
).split()
#: Characters at which a text is cut into lines.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\u0085  ]"
#: White space as str.split() and str.strip() see it.
SPACE = r"[\s\x0B\x1C-\x1F\u0085   -     　]"
#: White space as SQL's regular expressions see it.
ASCII_SPACE = r"[\t\n\f\r ]"
#: Spaces of all widths (Unicode's Zs), which SQL's trim takes off.
WIDTHS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
#: Characters that compatibility normalisation may change; Latin letters with one accent aren't among them.
_MAY_CHANGE = r"[ ¨ª¯²-µ¸-º¼-¾Ĳ-￿\x{10000}-\x{10FFFF}]"
_WORD = r"([A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*)"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form. Only rows that it may change are sent to Python."""
    changes = text.rlike(_MAY_CHANGE)
    return F.coalesce(_nfkc(F.when(changes, text)), text)


def lexical_terms(text: Column, normalize: bool = True) -> Column:
    """Lower-case runs of a-z, 0-9 and dotless i, in order, with repeats."""
    return F.regexp_extract_all(F.lower(nfkc(text) if normalize else text), F.lit("([a-z0-9ı]+)"), F.lit(1))


def unique_terms(terms: Column) -> Column:
    """Terms without repeats, in order of first occurrence."""
    return F.array_distinct(terms)


def word_tokens(text: Column) -> Column:
    """Words with inner hyphens and apostrophes, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(1)), F.lower)


def content_tokens(text: Column) -> Column:
    """Distinct words of two characters or more that aren't stop words."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_except(F.array_distinct(F.filter(word_tokens(text), lambda w: F.length(w) > 1)), stop)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def collapse_ascii_spaces(text: Column) -> Column:
    """Every run of ASCII's white space as one space, and no space of any width at the ends, as the SQL has it."""
    return F.btrim(F.regexp_replace(text, f"{ASCII_SPACE}+", " "), F.lit(WIDTHS))


@functools.cache
def _folded() -> str:
    """Characters that case-folding treats otherwise than lower-casing, alone or at a word's end."""
    return "".join(c for c in map(chr, range(0x110000)) if c.casefold() != c.lower() or c in "Σİ")


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def casefold(text: Column) -> Column:
    """Case-folded; only texts in which that isn't lower-casing leave the JVM."""
    return F.coalesce(_casefold(F.when(text.rlike(f"[{_folded()}]"), text)), F.lower(text))


def normalized_question(question: Column) -> Column:
    """Case-folded with white space collapsed."""
    return collapse_spaces(casefold(question))


def count_words(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE[1:-1]}]+"))


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR as LF; null as empty."""
    return F.coalesce(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(""))


def media_type(value: Column) -> Column:
    """The part of a content type before its parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(F.coalesce(value, F.lit("")), ";", 1)))


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines() gives them: no empty one after a last break."""
    parts = F.split(text, LINE_BREAK, -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def split_newlines(text: Column) -> Column:
    """Parts between line feeds: no empty one after a last line feed, one empty line for an empty text."""
    parts = F.split(text, "\n", -1)
    return F.when(F.endswith(text, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def join_wrapped(lines: Column) -> Column:
    """Wrapped lines as one: after a hyphen the next line follows at once if it starts in lower case."""
    step = lambda acc, x: F.when(acc == "", x).when(acc.endswith("-") & x.rlike("^[a-z]"), F.concat(acc, x)).otherwise(F.concat(acc, F.lit(" "), x))
    return F.aggregate(F.transform(lines, collapse_spaces), F.lit(""), step)


def join_dehyphenated(lines: Column, kept: tuple[str, ...] = (), corrections: dict[str, str] | None = None) -> Column:
    """Wrapped lines as one, without a hyphen that the wrap has made.

    The hyphen stays if the whole compound is one of ``kept``.
    """

    def step(acc: Column, x: Column) -> Column:
        left = F.regexp_extract(acc, r"([A-Za-z]+)-$", 1)
        right = F.regexp_extract(x, r"^([A-Za-z]+)", 1)
        compound = F.lower(F.concat(left, F.lit("-"), right))
        keep = compound.isin(*kept) if kept else F.lit(False)
        glued = F.when(keep, F.concat(acc, x)).otherwise(F.concat(F.regexp_replace(acc, "-$", ""), x))
        return F.when(acc == "", x).when((left != "") & x.rlike("^[a-z]"), glued).otherwise(F.concat(acc, F.lit(" "), x))

    out = F.aggregate(F.transform(lines, collapse_spaces), F.lit(""), step)
    for wrong, right in (corrections or {}).items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def dotted_number(heading: Column) -> Column:
    """The dotted number at a heading's start, as 1.2.3; null without one."""
    found = F.regexp_extract(heading, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    return F.when(found != "", found)


def dotted_depth(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def without_number(heading: Column) -> Column:
    return F.regexp_replace(heading, r"^\d+(?:\.\d+)*\.?\s+", "")


def page_id(document: Column, page: Column) -> Column:
    return F.format_string("%s:page-%04d", document, page)


def heading_id(page: Column, line: Column) -> Column:
    return F.format_string("%s:line-%04d", page, line)


def logical_source_key(unit: Column) -> Column:
    """A unit's id without its part; null if it has none."""
    found = F.regexp_extract(unit, r"^(.+):part-([0-9]{3})$", 1)
    return F.when(found != "", found)


def passage_id(source_key: Column, number: Column) -> Column:
    return F.format_string("%s:passage-%03d", source_key, number)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


#: 10**12 and its halves of 26 bits, for exact products.
_E12 = 1e12
_E12_HIGH = 134217729.0 * _E12 - (134217729.0 * _E12 - _E12)


def round12(value: Column) -> Column:
    """To 12 digits, by the number's exact binary value, halves to the even digit.

    The product with 10**12 is taken with its rounding error, so a number that
    lies a hair beside a half is told from one that lies on it. Numbers of
    9,007 and more are too coarse for more than 12 digits.
    """
    whole = F.abs(value)
    split = whole * F.lit(134217729.0)
    high = split - (split - whole)
    low, product = whole - high, whole * F.lit(_E12)
    error = ((high * F.lit(_E12_HIGH) - product) + high * F.lit(_E12 - _E12_HIGH) + low * F.lit(_E12_HIGH)) + low * F.lit(_E12 - _E12_HIGH)
    floor = F.floor(product)
    # exact: a product below 2**53 has its half, and the error is what it lacks
    beyond = (product - floor - F.lit(0.5)) + error
    up = (beyond > 0) | ((beyond == 0) & (floor % 2 == 1))
    rounded = (floor + F.when(up, 1).otherwise(0)).cast("double") / F.lit(_E12)
    return F.when(whole < 9007, F.when(value < 0, -rounded).otherwise(rounded)).otherwise(value)


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def contains_in_order(words: Column, wanted: Column) -> Column:
    """Whether ``wanted`` is a subsequence of ``words``."""
    left = F.aggregate(words, wanted, lambda rest, w: F.when((F.size(rest) > 0) & (F.get(rest, F.lit(0)) == w), F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest))
    return F.size(left) == 0


def extraction_quality(text: Column, phrase: Column | None = None) -> dict[str, Column]:
    """Measures of an extractor's output: characters, words, long runs, mean word length, phrase found."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+(?:'[a-z]+)?)"), F.lit(1))
    n = F.size(words)
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    out = {
        "character_count": F.length(text).cast("long"),
        "word_count": n.cast("long"),
        "long_runs": F.regexp_count(text, F.lit("[A-Za-z]{25,}")).cast("long"),
        "mean_word_length": F.when(n > 0, total / n).otherwise(0.0),
    }
    if phrase is not None:
        out["phrase_in_order"] = contains_in_order(words, F.regexp_extract_all(F.lower(phrase), F.lit(r"([a-z]+(?:'[a-z]+)?)"), F.lit(1)))
    return out
