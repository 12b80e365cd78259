"""Line deduplication by overlapping three-line windows, in DataFrame operations only.

Every window of three consecutive lines is hashed; windows that occur twice or more are found globally, with the first
place of each. Later occurrences cover their lines, covers of a document are merged, and covered lines go. A first
occurrence is protected only against later ones of the same window that overlap it (a line repeated four times and
more), so that no window vanishes by covering itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm._common import key_join, materialize, may_match, remove

WINDOW = 3


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.octet_length("text"))


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2) of every window; texts of fewer lines have none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), _lines().alias("lines")).where(F.size("lines") >= window)
    at = lambda i: F.slice("lines", i + 1, window)
    keys = F.transform(F.sequence(F.lit(0), F.size("lines") - window), lambda i: F.struct(i.alias("pos"), F.xxhash64(at(i)).alias("h1"), F.xxhash64(F.lit(1), F.array_join(at(i), "\n")).alias("h2")))
    return rows.select("doc_id", "text_key", F.inline(keys))


def covered_lines(docs: DataFrame, window: int = WINDOW, guard_all: bool = False) -> DataFrame:
    """(doc_id, text_key, later, first): places of later occurrences and of protected first ones, per document.

    Protected are first occurrences that a later one of the same window overlaps; with ``guard_all``, all of them.
    """
    windows = materialize(line_windows(docs, window), "windows")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "text_key", "pos")
    repeated = materialize(windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated")
    marked = key_join(windows, repeated, ["h1", "h2"], "n").withColumn("is_first", place == F.col("first"))
    overlaps = (place["d"] == F.col("first.d")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("pos") - F.col("first.pos") < window)
    own = F.when(F.col("is_first"), F.col("pos")) if guard_all else F.when(~F.col("is_first") & overlaps, F.col("first.pos"))
    cover = marked.groupBy("doc_id", "text_key").agg(F.collect_set(F.when(~F.col("is_first"), F.col("pos"))).alias("later"), F.collect_set(own).alias("first")).where(F.size("later") > 0)
    cover = materialize(cover, "cover")
    remove(windows, repeated)
    return cover


def _without(lines: str, gone: str) -> Column:
    """``lines`` but for those at the sorted places ``gone``: the stretches between them, in one pass."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(F.col(gone), F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def line_dedup(docs: DataFrame, window: int = WINDOW, guard_all: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_removed, clean_text.

    Lines part at \\n and are compared as they are. Occurrences are ordered by doc_id (null last), then by a hash of the
    text, then by line; rows that agree in id and text count as one document and share their result. Null text counts
    as empty (one line); texts with fewer lines than a window stay as they are. Other columns are ignored; an empty
    table gives an empty one. ``guard_all`` keeps every line inside the first occurrence of any repeated window, so that
    lines at the borders of a shared passage stay. Only texts with a covered line are shuffled.
    """
    cover = covered_lines(docs, window, guard_all)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    lines = lambda c: F.split(c, "\n")
    plain = lambda df: df.select("doc_id", F.size(lines(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("clean_text"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), F.col("d.text_key") == F.col("c.text_key")]
    some = may_match(rows, cover, ["doc_id", "text_key"]).alias("d").join(cover.hint("merge").alias("c"), same, "left")
    spread = lambda col: F.array_distinct(F.flatten(F.transform(col, lambda p: F.sequence(p, p + window - 1))))
    gone = F.coalesce(F.sort_array(F.array_except(spread("later"), spread("first"))), F.array().cast("array<int>"))
    some = some.select("d.doc_id", lines(F.col("d.text")).alias("lines"), gone.alias("gone"))
    some = some.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(_without("lines", "gone"), "\n").alias("clean_text"))
    return plain(may_match(rows, cover, ["doc_id", "text_key"], without=True)).unionByName(some)
