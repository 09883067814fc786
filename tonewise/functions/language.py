"""Language detection by script, letters and function words.

One Column expression over the raw text. A statistical detector can be put in
between by ``detector``, a Column that gives a code or null; without one the
rules decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewise.functions.normalize import NO_ASCII, bound
from tonewise.functions.tables import CYRILLIC_LANGUAGES, CYRILLIC_MARKS, FUNCTION_WORDS, LATIN, LATIN_MARKS, SCRIPTS

WORD = r"[\p{L}\p{Nl}\p{No}]+"


def _letters(ranges: list[tuple[int, int]]) -> str:
    spans = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)
    return f"[\\p{{L}}&&[{spans}]]"


#: Buckets in order of precedence, and the blocks of each in order of code points.
BUCKETS = ["latin", *dict.fromkeys(code for code, *_ in SCRIPTS), "other"]
BLOCKS = sorted([(lo, hi, BUCKETS.index("latin")) for lo, hi in LATIN] + [(lo, hi, BUCKETS.index(code)) for code, lo, hi in SCRIPTS])


def bucket(code: Column) -> Column:
    """The place in ``BUCKETS`` of a letter's code point, by binary search in the blocks."""

    def search(blocks: list[tuple[int, int, int]]) -> Column:
        if len(blocks) == 1:
            lo, hi, at = blocks[0]
            return F.when(code.between(lo, hi), at).otherwise(BUCKETS.index("other"))
        half = len(blocks) // 2
        return F.when(code < blocks[half][0], search(blocks[:half])).otherwise(search(blocks[half:]))

    return search(BLOCKS)


def main_script(text: Column) -> Column:
    """The bucket of most letters; of equal ones that which stands first; null without a letter.

    Each letter is looked up once; the few buckets that occur are counted.
    """
    letters = F.split(F.regexp_replace(text, r"[^\p{L}]+", ""), "")
    places = F.transform(F.filter(letters, lambda c: c != ""), lambda c: bucket(F.ascii(c)))

    def most(at: Column) -> Column:
        counted = F.transform(F.array_distinct(at), lambda k: F.struct(F.size(F.filter(at, lambda x: x == k)).alias("n"), (-F.array_position(at, k)).alias("first"), k.alias("bucket")))
        return F.get(F.array(*map(F.lit, BUCKETS)), F.array_max(counted)["bucket"])

    return bound(places, most)


def _first_mark(text: Column, marks, otherwise: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, letters in reversed(marks):
        out = F.when(text.rlike(f"[{letters}]"), F.lit(code)).otherwise(out)
    return F.when(text.rlike(f"{NO_ASCII}[{''.join(letters for _, letters in marks)}]"), out).otherwise(otherwise)


def function_word_vote(text: Column) -> Column:
    """The language of most distinct function words; ties to the first, 'en' without any, 'und' without words."""
    every = F.array(*map(F.lit, sorted({w for listed in FUNCTION_WORDS.values() for w in listed.split()})))
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)

    def vote(w: Column) -> Column:
        told = bound(F.array_intersect(w, every), lambda x: F.greatest(*_hits(x))["code"])  # distinct, and a few at most
        return F.when(F.size(w) == 0, F.lit("und")).otherwise(told)

    return bound(words, vote)


def _hits(words: Column) -> list[Column]:
    return [
        F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, listed.split())))).alias("n"), F.lit(-i).alias("rank"), F.lit(code).alias("code"))
        for i, (code, listed) in enumerate(FUNCTION_WORDS.items())
    ]


def detect_language(text: Column, detector: Column | None = None) -> Column:
    """ISO 639-1 code, or 'und'."""
    guess = F.lit(None).cast("string") if detector is None else F.substring(detector, 1, 2)
    cyrillic = _first_mark(F.lower(text), CYRILLIC_MARKS, F.when(guess.isin(*CYRILLIC_LANGUAGES), guess).otherwise(F.lit("ru")))
    vote = F.coalesce(guess, function_word_vote(text))
    # No letter that tells a Latin-script language is ASCII.
    latin = F.when(F.octet_length(text) == F.char_length(text), vote).otherwise(_first_mark(text, LATIN_MARKS, vote))
    three = text.rlike(r"(?Us)[^\s\x1c-\x1f].+?[^\s\x1c-\x1f]")  # characters or more without the white space around them
    latin = F.when(three, latin).otherwise(F.lit("und"))

    def told(script: Column) -> Column:
        return (
            F.when((script == "zh") & text.rlike(r"[\p{L}&&[\x{3040}-\x{30FF}]]"), F.lit("ja"))
            .when(script == "ru", cyrillic if detector is None else F.lit("ru"))
            .when(script.isNotNull() & ~script.isin("latin", "other"), script)
        )

    # Without a letter of any script that tells a language, a look at the text settles that none does; ASCII has none.
    first = min(lo for _, lo, _ in SCRIPTS)
    below = f"[\\x00-\\x{{{first - 1:X}}}]"
    known = (F.octet_length(text) > F.char_length(text)) & text.rlike(f"(?!{below})" + _letters([(lo, hi) for _, lo, hi in SCRIPTS]))
    found = F.when(known, bound(main_script(text), told))
    if detector is not None:  # it may be Python, which can't stand inside ``bound``
        latin = F.when(found == "ru", cyrillic).otherwise(F.coalesce(found, latin))
        return F.when(text.isNull() | (text == ""), F.lit("und")).otherwise(latin)
    return F.when(text.isNull() | (text == ""), F.lit("und")).otherwise(F.coalesce(found, latin))
