"""Checks a candidate draft must pass before a reviewer sees it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.entities import (PREFIXED_AMOUNT, blank_separated, matched_numbers,
                                  phrases_found)
from ..functions.text import contains_any
from ..lexicon import DEFAULT, Lexicon

# Fixed value: what counts as an unfilled slot.
PLACEHOLDER = r"\[[^\]]{0,40}\]|\{[^}]{0,40}\}"
MIN_WORDS = 20


def urgency_hits(low: Column, lex: Lexicon = DEFAULT) -> Column:
    return phrases_found(low, lex.urgency)


def placeholders(draft: Column) -> Column:
    """First three unfilled slots; the pattern only runs where a bracket opens."""
    found = F.slice(F.regexp_extract_all(draft, F.lit(PLACEHOLDER), F.lit(0)), 1, 3)
    opened = F.contains(draft, F.lit("[")) | F.contains(draft, F.lit("{"))
    return F.when(opened, found).when(draft.isNotNull(), F.array().cast("array<string>"))


def draft_amounts(low: Column) -> Column:
    return matched_numbers(low, PREFIXED_AMOUNT, ("aed",))


def invented_amounts(amounts: Column, offer: Column) -> Column:
    """Distinct amounts other than the approved offer, ascending."""
    allowed = F.when(offer > 0, F.array(offer)).otherwise(F.array().cast("array<double>"))
    return F.array_sort(F.array_except(F.array_compact(amounts), allowed))


def pressures(low: Column, action: Column, lex: Lexicon = DEFAULT) -> Column:
    return (action == "dignified_goodbye") & contains_any(low, lex.pressure)


def word_count(draft: Column) -> Column:
    """Words between blanks of any kind."""
    return F.size(blank_separated(draft))


def too_short(draft: Column) -> Column:
    return word_count(draft) < MIN_WORDS


def flags(urgent: Column, slots: Column, invented: Column, pressured: Column, short: Column,
          wanted: Column, detected: Column) -> Column:
    """All flags in check order from the single results; empty when the draft is clean.

    The arguments should be attributes of an earlier projection, so each check runs once.
    """
    single = F.array_compact(F.array(
        F.when(F.size(slots) > 0, F.concat(F.lit("open placeholders: "),
                                           F.array_join(slots, ", "))),
        F.when(F.size(invented) > 0, F.concat(F.lit("unapproved amounts: "), F.array_join(
            F.transform(invented, lambda a: a.cast("string")), ", "))),
        F.when(pressured, "pressure to stay in a goodbye"),
        F.when(short, "too short"),
        F.when(detected != wanted, F.concat(F.lit("wrong language: "), detected,
                                            F.lit(" instead of "), wanted))))
    return F.concat(F.transform(urgent, lambda p: F.concat(F.lit("urgent wording: "), p)), single)
