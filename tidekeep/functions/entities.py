"""Amounts, dates, destinations and products named in a message."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import Lexicon

# Decimal digits of any script, and every kind of blank, the latter spelled out so that the
# pattern means the same to any regex engine.
_DIGIT = "\\p{Nd}"
BLANKS = "\t\n\x0b\f\r " + "".join(map(chr, (
    0x1c, 0x1d, 0x1e, 0x1f, 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f,
    0x205f, 0x3000)))
BLANK_CHARS = "\\s" + "".join(b for b in BLANKS if not b.isascii() or b < "\t" or b == "\x0b"
                             or "\x1b" < b < " ")
_BLANK = f"[{BLANK_CHARS}]*"
NUMBER = f"[{_DIGIT},]+(?:\\.[{_DIGIT}]+)?"
AMOUNT = f"(?:aed|dhs?\\.?){_BLANK}{NUMBER}|{NUMBER}{_BLANK}(?:aed|dirhams?)"
PREFIXED_AMOUNT = f"aed{_BLANK}{NUMBER}"
# The zeros of the scripts whose numbers are read: Arabic-Indic, Persian, N'Ko, Devanagari, Bengali,
# Gurmukhi, Gujarati, Oriya, Tamil, Telugu, Kannada, Malayalam, Sinhala, Thai, Lao, Tibetan, Myanmar,
# Khmer, Mongolian and full width. Fixed values of Unicode; nine more digits follow each.
ZEROS = (0x660, 0x6f0, 0x7c0, 0x966, 0x9e6, 0xa66, 0xae6, 0xb66, 0xbe6, 0xc66, 0xce6, 0xd66, 0xde6,
         0xe50, 0xed0, 0xf20, 0x1040, 0x17e0, 0x1810, 0xff10)
LOCAL_DIGITS = "".join(chr(zero + i) for zero in ZEROS for i in range(10))
ASCII_DIGITS = "0123456789" * len(ZEROS)


def _to_number(matched: Column) -> Column:
    digits = F.translate(F.regexp_extract(matched, NUMBER, 0), LOCAL_DIGITS, ASCII_DIGITS)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def matched_numbers(low: Column, pattern: str, tokens: tuple[str, ...]) -> Column:
    """All matched amounts as doubles, in text order; null where a match has no digit.

    The pattern only runs on texts holding one of ``tokens``, without which nothing can match.
    """
    mentioned = reduce(or_, [F.contains(low, F.lit(t)) for t in tokens])
    found = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), _to_number)
    return F.when(mentioned, found).when(low.isNotNull(), F.array().cast("array<double>"))


def amounts(low: Column) -> Column:
    has_digit = F.rlike(low, F.lit(f"[{_DIGIT}]"))
    found = F.array_compact(matched_numbers(low, AMOUNT, ("aed", "dh", "dirham")))
    return F.when(has_digit, found).when(low.isNotNull(), F.array().cast("array<double>"))


def blank_separated(text: Column, drop: str = "") -> Column:
    """Pieces between blanks of any kind, after deleting the characters of ``drop``.

    One character map and a split on a single character, both much faster than a class pattern.
    """
    spaced = F.translate(text, BLANKS + drop, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def phrases_found(low: Column, phrases: tuple[str, ...]) -> Column:
    """Phrases present, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p.lower())), p)
                                     for p in phrases]))


def gazetteer_hits(low: Column, entries: tuple[tuple[str, str], ...]) -> Column:
    """Canonical values with a key in the text, distinct and sorted.

    Grouping the keys by value beforehand and testing the values in order makes the result
    sorted and distinct by construction.
    """
    keys: dict[str, list[str]] = {}
    for key, value in entries:
        keys.setdefault(value, []).append(key)
    return F.array_compact(F.array(*[
        F.when(reduce(or_, [F.contains(low, F.lit(k)) for k in keys[value]]), value)
        for value in sorted(keys)]))


def entity_lists(low: Column, lex: Lexicon) -> dict[str, Column]:
    return {"amounts_aed": amounts(low), "dates": phrases_found(low, lex.dates),
            "destinations": gazetteer_hits(low, lex.countries),
            "products": gazetteer_hits(low, lex.products)}


def as_struct(lists: dict[str, Column]) -> Column:
    """Struct of the four lists; an empty list becomes null."""
    return F.struct(*[F.when(F.size(v) > 0, v).alias(k) for k, v in lists.items()])
