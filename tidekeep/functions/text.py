"""Language, leaving and keyword expressions over message text.

All functions take the *lower-cased* text column. Project it once (``lower``) and pass the
attribute, so that the long phrase chains share a single lower-casing.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import Lexicon


def contains_any(low: Column, phrases: Iterable[str]) -> Column:
    """Raw substring test; a flat OR stays in generated code and stops at the first hit."""
    return reduce(or_, [F.contains(low, F.lit(p.lower())) for p in phrases])


def in_script(text: Column, lex: Lexicon) -> Column:
    return F.rlike(text, F.lit(lex.script[0]))


def words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("[a-z']+"), F.lit(0))


def listed_words(tokens: Column, lex: Lexicon) -> Column:
    """Tokens that occur in the word list of any language."""
    every = sorted({w for _, vocabulary in lex.languages for w in vocabulary})
    return F.filter(tokens, lambda t: t.isin(*every))


def share_of(tokens: Column, n_words: Column, vocabulary: Iterable[str]) -> Column:
    """Tokens found in ``vocabulary``, repeated ones counted each time, per word of the text."""
    hits = F.filter(tokens, lambda t: t.isin(*vocabulary))
    return F.size(hits).cast("double") / F.greatest(n_words, F.lit(1)).cast("double")


def share_columns(tokens: Column, n_words: Column, lex: Lexicon) -> dict[str, Column]:
    return {lang: share_of(tokens, n_words, vocab) for lang, vocab in lex.languages}


def pick_language(script: Column, n_words: Column, shares: list[tuple[str, Column]],
                  lex: Lexicon) -> tuple[Column, Column]:
    """(language, confidence) from a script flag, a word count and the share of each language.

    The largest share wins if it exceeds the floor; on equal shares the language listed first.
    """
    best = F.greatest(*[s for _, s in shares]) if len(shares) > 1 else shares[0][1]
    lang = F.when(script, lex.script[1]).when(n_words == 0, lex.fallback_language)
    for name, share in shares:
        lang = lang.when((share > lex.share_floor) & (share == best), name)
    conf = (F.when(script, lex.script[2])
            .when(n_words == 0, lex.no_words_confidence)
            .when(best > lex.share_floor, F.least(F.lit(lex.share_cap), lex.share_base + best))
            .otherwise(lex.fallback_confidence))
    return lang.otherwise(lex.fallback_language), conf


def leaving_confirmed(low: Column, lex: Lexicon) -> Column:
    return contains_any(low, lex.leaving)


def keyword_issue(low: Column, lex: Lexicon) -> Column:
    """First class, in lexicon order, with any of its keywords in the text."""
    first, *rest = lex.issues
    chain = F.when(contains_any(low, first[1]), first[0])
    for label, keywords in rest:
        chain = chain.when(contains_any(low, keywords), label)
    return chain.otherwise(lex.fallback_issue)


def issue_confidence(issue: Column, lex: Lexicon) -> Column:
    return F.when(issue == lex.fallback_issue, lex.fallback_issue_confidence).otherwise(
        lex.issue_confidence)


def keyword_signal(leaving: Column, low: Column, lex: Lexicon) -> Column:
    return (F.when(leaving, "High").when(contains_any(low, lex.wavering), "Medium")
            .otherwise("Low"))


def signal_confidence(signal: Column, lex: Lexicon) -> Column:
    return F.when(signal == "Low", lex.fallback_signal_confidence).otherwise(
        lex.signal_confidence)


def reply_label(reply: Column, labels: list[str]) -> Column:
    """Free-text reply to a label: first label named in it, else the last of the list."""
    low = F.lower(reply)
    chain = F.when(F.contains(low, F.lit(labels[0].lower())), labels[0])
    for label in labels[1:]:
        chain = chain.when(F.contains(low, F.lit(label.lower())), label)
    return chain.otherwise(labels[-1])
