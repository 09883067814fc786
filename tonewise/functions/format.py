"""Formatting of numbers, times, handles, links and language names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewise.functions.normalize import bound

# English names of the languages that detection can give.
LANGUAGE_NAMES = {
    "am": "Amharic", "ar": "Arabic", "be": "Belarusian", "bg": "Bulgarian", "bn": "Bangla", "bo": "Tibetan", "cs": "Czech", "de": "German",
    "el": "Greek", "en": "English", "es": "Spanish", "fi": "Finnish", "fr": "French", "gu": "Gujarati", "he": "Hebrew", "hi": "Hindi",
    "hu": "Hungarian", "hy": "Armenian", "id": "Indonesian", "it": "Italian", "ja": "Japanese", "ka": "Georgian", "kk": "Kazakh",
    "km": "Khmer", "kn": "Kannada", "ko": "Korean", "ky": "Kyrgyz", "lo": "Lao", "mk": "Macedonian", "ml": "Malayalam", "mn": "Mongolian",
    "my": "Burmese", "nl": "Dutch", "or": "Odia", "pa": "Punjabi", "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian",
    "si": "Sinhala", "sr": "Serbian", "sv": "Swedish", "ta": "Tamil", "te": "Telugu", "th": "Thai", "tr": "Turkish", "tt": "Tatar",
    "uk": "Ukrainian", "vi": "Vietnamese", "zh": "Chinese",
}


def score_percent(prob: Column) -> Column:
    """A probability as a percentage of two decimals."""
    return F.round(prob * 100, 2)


def compact_number(x: Column) -> Column:
    """1234 -> 1.2K; one decimal under a hundred units, no '.0'; '0' for what isn't finite."""
    x = x.cast("double")
    whole = F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(x.cast("string"))
    out = whole
    for limit, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        y = x / limit
        digits = F.when(y < 100, F.regexp_replace(F.format_string("%.1f", F.round(y, 1)), r"\.0$", "")).otherwise(
            F.format_string("%.0f", F.round(y, 0))
        )
        out = F.when(F.abs(x) >= limit, F.concat(digits, F.lit(unit))).otherwise(out)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "0").otherwise(out)


def parse_created_at(text: Column, now: Column) -> Column:
    """Wall-clock time of a post, its offset dropped; ``now`` where there is none to read."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},?\s+", "")
    t = F.regexp_replace(t, r"\s+(?:[+-]\d{4}|GMT|UTC|Z)(?=\s|$)", "")
    found = [F.try_to_timestamp(t, F.lit(p)).cast("timestamp_ntz") for p in ("MMM d HH:mm:ss yyyy", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(*found, now.cast("timestamp_ntz"))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def relative_time(ts: Column, now: Column) -> Column:
    """5s, 3m, 2h, 4d, then the date, with the year if it is another; '' for null."""
    s = F.timestamp_diff("SECOND", ts, now)
    per = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    dated = F.when(F.year(ts) == F.year(now), F.date_format(ts, "MMM d")).otherwise(F.date_format(ts, "MMM d, yyyy"))
    return (
        F.when(ts.isNull(), "")
        .when(s < 60, F.concat(F.greatest(s, F.lit(1)).cast("string"), F.lit("s")))
        .when(s < 3600, per(60, "m"))
        .when(s < 86400, per(3600, "h"))
        .when(s < 604800, per(86400, "d"))
        .otherwise(dated)
    )


def absolute_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy, h:mm a"), F.lit(""))


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for item in LANGUAGE_NAMES.items() for x in item])
    return bound(code, lambda c: F.when(c.isNull() | c.isin("", "und"), "Unknown").otherwise(F.coalesce(F.try_element_at(names, c), F.upper(c))))


def normalize_handle(value: Column) -> Column:
    """A user name: no @ in front, ASCII word characters, fifteen at most."""
    bare = F.regexp_replace(F.regexp_replace(value, r"^(?U)\s+|(?U)\s+$", ""), "^@+", "")
    return F.substring(F.regexp_replace(bare, "[^A-Za-z0-9_]", ""), 1, 15)


def permalink(link: Column, screen_name: Column, post_id: Column) -> Column:
    link = F.when(link.startswith("/"), F.concat(F.lit("https://twitter.com"), link)).otherwise(F.nullif(link, F.lit("")))
    made = F.concat(F.lit("https://twitter.com/"), screen_name, F.lit("/status/"), F.nullif(post_id, F.lit("")))
    return F.coalesce(link, made, F.lit(""))


def large_avatar(url: Column) -> Column:
    """The first ``_normal`` becomes ``_400x400``."""
    return F.regexp_replace(url, r"^(?s)(.*?)_normal", "$1_400x400")


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.concat(F.format_string("%.1f", F.round(x * 100, 1)), F.lit("%")))


def clamp_percent(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))


def cache_key(name: Column) -> Column:
    return F.lower(name)


def rich_text(text: Column) -> Column:
    """The text as an array of (kind, text, label): link, mention, hashtag or text."""
    pieces = F.regexp_extract_all(text, F.lit(r"https?://\S+|(?s)(?:(?!https?://\S)\S)+|\s+"), 0)

    def told(piece: Column) -> Column:
        link = piece.rlike(r"^https?://\S")
        kind = F.when(link, "link").when(piece.rlike("^@[A-Za-z0-9_]+$"), "mention").when(piece.rlike("^#[A-Za-z0-9_]+$"), "hashtag").otherwise("text")
        short = F.concat(F.substring(F.regexp_replace(piece, "^https?://", ""), 1, 32), F.when(F.length(piece) > 39, "…").otherwise(""))
        return F.struct(kind.alias("kind"), piece.alias("text"), F.when(link, short).otherwise(piece).alias("label"))

    return F.transform(pieces, told)
