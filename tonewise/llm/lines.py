"""Line dedup by a deletion-neighbourhood join.

DataFrame functions only. Of all lines (split at line feeds) the earliest of
each near-duplicate stays: a line goes if an equal line or, from ``min_chars``
characters on, one within an edit distance of 1 stands earlier. Earlier means a
smaller (id, row, position). Whether the earlier line goes too is no matter.

A deletion variant is a line without a stretch of it, told by the characters
before and after, so two lines within the bound share the variant without the
edited stretch. All variants at one character are as many as there are
characters; therefore the stretches begin as thirds of the line, lines whose
hashed variant meets no other line's fall away, and only what is left is cut
finer, by ``FAN``, down to single characters. There equal variants mean an edit
distance of 1, whichever members are compared, so the join of equal variants
is a grouped minimum (the earliest member) and no pairs arise, however hot a
line is; the edit distance to that member is then verified. A variant names the
length N of the longer of two lines, so lines of N - 1 characters meet those of
N with one character deleted.

Defined cases: null text stays null; blank lines stay and match nothing.
Repeated rows and lines are duplicates of the first. Documents of which no line
is left have an empty text; ``dedup`` drops them, unless they had no line to
begin with. Lines and texts are used whole. Other columns are kept, whatever
their names. Near matching is for lines of ``min_chars`` (20) characters or more,
as one edit makes another word of a short one; equal lines of any length match.
Rows are told by their place in a source that is read alike each time (``fixed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.llm.common import discard, fixed, saved

THIRDS, FAN = 3, 8
MAX_BROADCAST_ROWS = 300_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def _variant(line: Column, size: Column, s: Column, e: Column) -> Column:
    """Hash of the variant of ``line`` that lacks [s, e) of ``size`` characters (the line may lack one itself)."""
    n = F.char_length(line)
    return F.xxhash64(size, s, e, F.substring(line, F.lit(1), s), F.substring(line, n - (size - e) + 1, size - e))


def _stretches(s: Column, e: Column, parts: int) -> Column:
    """[s, e) cut into at most ``parts`` stretches, none empty."""
    many = F.least(F.lit(parts), e - s)
    cut = lambda i: (s + F.floor((e - s) * i / many)).cast("int")
    return F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(cut(i).alias("s"), cut(i + 1).alias("e")))


def _met(rows: DataFrame, made: list[DataFrame]) -> DataFrame:
    """The rows whose key another line has as well; the table of such keys is added to ``made``."""
    keys = rows.groupBy("key").agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi")).where("lo < hi").select("key")
    keys = saved(keys, "lines-keys")
    made.append(keys)
    if keys.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return rows.join(keys, "key")


def kept_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(rid, at): the places of the lines that stay, a list for each row of ``docs`` that has some; ``docs`` is ``fixed``."""
    every = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), _lines(F.col(text_col)).alias("lines"))
    every = every.select("rid", "id", F.posexplode("lines").alias("at", "line")).where(~_blank(F.col("line")))
    every = every.withColumn("n", F.char_length("line"))
    # The longer of two lines is this one, or has a character more.
    keys = F.when(F.col("n") >= min_chars, F.array(*_first_keys(0), *_first_keys(1))).otherwise(F.array().cast("array<bigint>"))
    distinct = every.select(
        F.xxhash64("line").alias("line_id"), F.hash("line").alias("check"), F.struct("id", "rid", "at").alias("order"), keys.alias("keys")
    )
    distinct = distinct.groupBy("line_id", "check").agg(F.min("order").alias("order"), F.any_value("keys").alias("keys"))
    distinct = saved(distinct, "lines-distinct")

    met: list[DataFrame] = []
    rows = _met(distinct.select("line_id", F.posexplode("keys").alias("which", "key")), met)
    wanted = rows.join(distinct.select("line_id", "order"), "line_id").select("line_id", "which", "order")
    wanted = saved(wanted.distinct(), "lines-wanted")
    at = wanted.groupBy("line_id", "order").agg(F.collect_set("which").alias("which"))  # 2 * THIRDS numbers at most
    at = at.select("line_id", "order", "which", F.col("order.rid").alias("rid"), F.col("order.at").alias("at"))
    if at.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        at = F.broadcast(at)
    live = every.join(at, ["rid", "at"]).select("line_id", "order", "line", F.explode("which").alias("which"))
    size = (F.char_length("line") + F.when(F.col("which") < THIRDS, 0).otherwise(1)).alias("size")
    live = live.select("line_id", "order", "line", size, F.element_at(_stretches(F.lit(0), size, THIRDS), F.col("which") % THIRDS + 1).alias("c"))
    live = saved(live.select("line_id", "order", "line", "size", "c.s", "c.e"), "lines-live")
    while (live.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 0) > 1:
        cut = live.select("line_id", "order", "line", "size", F.explode(_stretches(F.col("s"), F.col("e"), FAN)).alias("c"))
        cut = cut.select("line_id", "order", "line", "size", "c.s", "c.e")
        cut = cut.withColumn("key", _variant(F.col("line"), F.col("size"), F.col("s"), F.col("e")))
        # A stretch of one character is cut no finer, but it is looked up again with the others.
        step = saved(_met(cut, met).drop("key"), "lines-live")
        discard(live)
        live = step
    key = _variant(F.col("line"), F.col("size"), F.col("s"), F.col("e"))
    leaves = live.withColumn("key", key)
    least = leaves.groupBy("key").agg(F.min(F.struct("order", "line")).alias("first"))
    later = leaves.join(least, "key").where(F.col("first.order") < F.col("order"))
    gone = later.where(F.levenshtein(F.col("line"), F.col("first.line"), 1).between(0, 1)).select("line_id", "order").distinct()
    kept = distinct.join(gone, ["line_id", "order"], "left_anti").groupBy(F.col("order.rid").alias("rid"))
    kept = saved(kept.agg(F.collect_list("order.at").alias("at")), "lines-kept")  # as many numbers as the text has lines
    discard(distinct, wanted, live, *met)
    return kept


def _first_keys(more: int) -> list[Column]:
    """The variants without one third, as plain expressions: every line has them."""
    size = F.col("n") + more
    at = [F.lit(0), *(F.floor(size * i / THIRDS).cast("int") for i in range(1, THIRDS)), size]
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        tail = F.substring("line", F.col("n") - (size - e) + 1, size - e)
        out.append(F.xxhash64(size, s, e, F.substring("line", F.lit(1), s), tail))
    return out


def _rebuilt(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with nothing (also returned), with text (what is left), lines and kept (lines that aren't blank: before and after)."""
    docs = fixed(docs)
    kept = kept_lines(docs, min_chars, id_col, text_col)
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    rest = [k for k, c in names.items() if c != text_col]
    # The text goes as its lines, split once.
    rows = docs.toDF(*names).select(*rest, F.monotonically_increasing_id().alias("rid"), _lines(F.col(f"c{docs.columns.index(text_col)}")).alias("l"))
    rows = rows.join(kept, "rid", "left")
    blank = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: _blank(F.get("l", i)))
    rows = rows.select(*rest, "l", F.coalesce("at", F.array().cast("array<int>")).alias("at"), blank.alias("blank"))
    text = F.array_join(F.transform(F.array_sort(F.concat("at", "blank")), lambda i: F.get("l", i)), "\n")
    some = F.col("l").isNotNull()
    rows = rows.select(
        *rest,
        F.when(some, text).alias("text"),
        F.when(some, F.size("l") - F.size("blank")).otherwise(0).alias("lines"),
        F.size("at").alias("kept"),
    )
    return rows, names


def dedup(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay; documents that lost all their lines go."""
    rows, names = _rebuilt(docs, min_chars, id_col, text_col)
    return rows.where("kept > 0 OR lines = 0").select(*[F.col("text" if c == text_col else k).alias(c) for k, c in names.items()])


def report(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Per document: the lines before and after, and what is left of the text by length and hash."""
    rows, _ = _rebuilt(docs.select("doc_id", "text"), min_chars, "doc_id", "text")
    return rows.select(
        F.col("c0").alias("doc_id"),
        F.col("lines").cast("long").alias("n_lines"),
        F.col("kept").cast("long").alias("n_kept"),
        F.char_length("text").cast("long").alias("n_chars_left"),
        F.sha2(F.col("text"), 256).alias("text_sha256"),
    )
