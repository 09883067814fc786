"""Text normalisation: undo what posts do to hide words.

``normalize_text`` is one Column expression. All steps are built-in functions
but the compatibility fold, which Spark lacks: that is one Arrow UDF, which gets
only texts with a character that it may change. Each costly step is behind a
cheap look whether the text has anything for it, and every step's result is
bound once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewise.functions.tables import INVISIBLES, LEET, LINKS, LOOKALIKE_FROM, LOOKALIKE_TO, SPACES, WORD_CHARS

#: Characters that the compatibility fold leaves alone, alone and next to each other: ASCII and what western text is mostly made of.
STABLE = r"\x00-\x7F\xA1\xA7\xA9\xAB\xAE\xB0\xB1\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2013\u2014\u2018-\u201A\u201C-\u201E\u2022\u20AC"

#: Before a class of many ranges: it is looked at only where a character isn't ASCII.
NO_ASCII = r"(?![\x00-\x7F])"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def nfkc(text: Column) -> Column:
    """Unicode compatibility fold, in Arrow batches."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(fold(F.when(text.rlike(f"{NO_ASCII}[^{STABLE}]"), text)), text)


def fold_lookalikes(token: Column) -> Column:
    """Cyrillic and Greek look-alikes become Latin in a token of both kinds of letters."""
    mixed = token.rlike("[a-z]") & token.rlike(r"[\u0370-\u03FF\u0400-\u04FF]")
    return F.when(mixed, F.translate(token, LOOKALIKE_FROM, LOOKALIKE_TO)).otherwise(token)


def hides_symbols(text: Column) -> Column:
    """Whether a sign that stands for a letter is between two of a-z: if none is, no replacement can begin."""
    return text.rlike(f"[a-z][{re.escape(''.join(LEET))}][a-z]")


def fold_symbols(token: Column) -> Column:
    """Digits and signs between two of a-z become the letter that they stand for."""

    def replaced(t: Column) -> Column:
        for sign, letter in LEET.items():
            sign = re.escape(sign)
            t = F.regexp_replace(t, f"{sign}(?<=[a-z]{sign})(?=[a-z])", letter)  # the sign first, as it is rare
        return t

    return bound(token, lambda t: F.when(hides_symbols(t), replaced(t)).otherwise(t))


def join_spaced_letters(text: Column) -> Column:
    """Three letters or more, a single space apart, become a word."""
    chain = r"(?:(?<![a-z])(?=(?:[a-z] ){2,}[a-z](?![a-z]))|(?<!^)\G)([a-z]) (?=[a-z](?![a-z]))"
    return F.when(text.rlike("(?<![a-z])[a-z] [a-z] [a-z](?![a-z])| [a-z] [a-z] "), F.regexp_replace(text, chain, "$1")).otherwise(text)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _unmarked(t: Column) -> Column:
    """Links and mentions go, tags lose their sign."""
    t = bound(t, lambda x: F.when(F.contains(x, F.lit("://")) | F.contains(x, F.lit("www.")), F.regexp_replace(x, LINKS, " ")).otherwise(x))
    t = bound(t, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, f"@{WORD_CHARS}+", " ")).otherwise(x))
    return bound(t, lambda x: F.when(F.contains(x, F.lit("#")), F.regexp_replace(x, f"#({WORD_CHARS}+)", "$1")).otherwise(x))


def _folded(t: Column) -> Column:
    """White space becomes single spaces, and words are folded. Signs stand between letters of one word, so only look-alikes need words of their own."""
    spaced = bound(F.trim(F.regexp_replace(t, SPACES, " ")), fold_symbols)
    by_word = F.array_join(F.transform(tokens(t), lambda w: fold_symbols(fold_lookalikes(w))), " ")
    return F.when(t.rlike(r"[\u0370-\u04FF]") & t.rlike("[a-z]"), by_word).otherwise(spaced)


def normalize_text(text: Column, fold: bool = True) -> Column:
    """Null becomes ''. ``fold=False`` leaves out the compatibility fold, for text known to be stable under it."""
    t = F.coalesce(text, F.lit(""))
    t = nfkc(t) if fold else t
    t = bound(t, lambda x: F.lower(F.when(F.octet_length(x) == F.char_length(x), x).otherwise(F.regexp_replace(x, NO_ASCII + INVISIBLES, ""))))
    t = F.regexp_replace(_unmarked(t), r"(?s)(.)\1{2,}", "$1$1")
    return bound(bound(t, join_spaced_letters), _folded)
