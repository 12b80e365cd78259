"""Benchmark decontamination on a distributed positional inverted index, in DataFrame operations only.

The index holds one posting (document, place, term) for every training token that the benchmark uses too, written in
segments sorted by term. Each benchmark window is looked up by its rarest terms: their posting lists, adjusted by the
terms' places in the window, are intersected, and what is left is compared word by word. Proximity matches need the
rarest terms near each other, in any order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm._common import ascii_lower, key_join, key_left_join, materialize, may_match, sized, small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
ANCHORS = 2
#: Words of a document that are compared in one row.
STRETCH = 512


def closing() -> Column:
    """The term of the posting that closes each document, at the place after its last word; no word is empty."""
    return F.xxhash64(F.lit(""))


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.octet_length("text"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, words, m, item_ids): one row per distinct non-empty word sequence; item_ids: those of its rows, as text.

    Null or empty texts have no words and no row; null item_ids are left out of item_ids.
    """
    rows = benchmark.select("item_id", words().alias("words")).where(F.size("words") > 0)
    return rows.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids")).select(F.xxhash64("words").alias("item"), "words", F.size("words").alias("m"), "item_ids")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (doc_id, text_key, pos, term) of the terms in ``vocabulary`` (term: 64-bit hash), and a closing one per row.

    A vocabulary beyond a broadcast goes through a filter of fixed size: the index then holds some terms more.
    """
    terms = materialize(vocabulary.select("term").union(docs.sparkSession.range(1).select(closing().alias("term"))).distinct(), "vocabulary")
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.posexplode(F.concat(words(), F.array(F.lit("")))).alias("pos", "word"))
    tokens = tokens.select("doc_id", "text_key", "pos", F.xxhash64("word").alias("term"))
    postings = tokens.join(F.broadcast(terms), "term", "left_semi") if small(terms) else may_match(tokens, terms, ["term"]).select("term", "doc_id", "text_key", "pos")
    return materialize(postings.sortWithinPartitions("term"), "postings")


def _anchored(items: DataFrame, index: DataFrame, window: int, anchors: int) -> DataFrame:
    """``items`` with ``looks``: for each window, the places and terms of its rarest words in the training data."""
    places = items.select("item", "m", F.posexplode("words").alias("ipos", "word")).select("item", "m", "ipos", F.xxhash64("word").alias("term"))
    counts = index.groupBy("term").agg(F.count("*").alias("cf"))
    known = places.join(counts, "term", "left").select("item", "m", F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "ipos", "term").alias("t"))
    lists = known.groupBy("item", "m").agg(F.collect_list("t").alias("t")).withColumn("t", F.array_sort("t", lambda a, b: a["ipos"] - b["ipos"]))
    width = F.least(F.col("m"), F.lit(window))
    looks = F.transform(F.sequence(F.lit(0), F.col("m") - width), lambda i: F.slice(F.array_sort(F.slice("t", i + 1, width)), 1, anchors))
    return items.join(lists.select("item", looks.alias("looks")), "item")


def _looked_up(index: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, item, diag, ipos): postings of rarest terms, adjusted by their place in the item.

    Terms of a large benchmark are joined by ``key_join``: those with very many postings by broadcast, others merged.
    """
    spots = items.select("item", F.explode(F.array_distinct(F.flatten("looks"))).alias("t")).select("t.term", "t.cf", F.struct("item", "t.ipos").alias("at"))
    spots = materialize(spots.where("cf > 0").groupBy("term").agg(F.max("cf").alias("cf"), F.collect_list("at").alias("at")), "anchors")
    found = index.join(F.broadcast(spots), "term") if small(spots, F.size("at")) else key_join(index, spots, ["term"], "cf")
    return found.select("doc_id", "text_key", "pos", F.inline("at")).select("doc_id", "text_key", "item", (F.col("pos") - F.col("ipos")).alias("diag"), "ipos")


def _all_found(hits: str) -> Column:
    """Whether every rarest term of some window is among the places in ``hits``."""
    return F.exists("looks", lambda w: F.size(F.array_except(F.transform(w, lambda t: t["ipos"]), F.col(hits))) == 0)


def _together(places: str, slack: int) -> Column:
    """Whether ``places`` (diag, ipos) hold every rarest term of some window, at most ``slack`` apart."""
    among = lambda t, p: F.exists(places, lambda q: (q["ipos"] == t["ipos"]) & (q["diag"] >= p["diag"]) & (q["diag"] <= p["diag"] + slack))
    return F.exists("looks", lambda w: F.exists(places, lambda p: F.forall(w, lambda t: among(t, p))))


def proximity_matches(index: DataFrame, items: DataFrame, slack: int = 26, window: int = WINDOW, anchors: int = 3) -> DataFrame:
    """(doc_id, text_key, item): documents that hold the rarest terms of some window near each other, in any order.

    A posting's offset is its place in the document less the term's place in the item. The offsets of the window's
    rarest terms must lie at most ``slack`` apart, so every verbatim window matches too. Two grids of cells twice as
    wide, one shifted by ``slack``, put any such offsets into a common cell; there the distance itself is compared.
    """
    looked = materialize(_anchored(items, index, window, anchors), "near-items")
    cells = F.array(F.floor(F.col("diag") / (2 * slack)) * 2, F.floor((F.col("diag") + slack) / (2 * slack)) * 2 + 1)
    near = _looked_up(index, looked).select("doc_id", "text_key", "item", F.struct("diag", "ipos").alias("place"), F.explode(cells).alias("cell"))
    found = near.groupBy("doc_id", "text_key", "item", "cell").agg(F.collect_set("place").alias("places")).withColumn("hits", F.col("places.ipos"))
    found = found.join(sized(materialize(looked.select("item", "looks"), "looks"), values=F.size(F.flatten("looks"))), "item")
    return found.where(_all_found("hits")).where(_together("places", slack)).select("doc_id", "text_key", "item").distinct()


def phrase_matches(docs: DataFrame, index: DataFrame, items: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, text_key, item, item_ids, base, flags, need): stretches in which a window of the item occurs.

    ``flags``: a character for each word from place ``base`` on, 1 where it is the item's word; the window occurs
    wherever ``need`` ones follow each other. Texts without a candidate stay out of the shuffle by a filter of fixed
    size; the others are compared stretch by stretch, so that no row holds more than ``STRETCH`` words and an item's.
    """
    looked = materialize(_anchored(items, index, window, anchors), "items")
    looked_up = sized(looked, values=F.size("words"))
    lines = _looked_up(index, looked).groupBy("doc_id", "text_key", "item", "diag").agg(F.collect_set("ipos").alias("spots"))
    maybe = lines.join(looked_up.select("item", "looks"), "item").where(_all_found("spots"))
    maybe = materialize(maybe.select("doc_id", "text_key", "item", "diag", F.floor(F.greatest("diag", F.lit(0)) / STRETCH).cast("int").alias("nth")), "candidates")
    longest = looked.agg(F.coalesce(F.max("m"), F.lit(1))).first()[0]
    texts = may_match(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text"), maybe, ["doc_id", "text_key"])
    split = texts.select("doc_id", "text_key", words("text").alias("words"))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STRETCH)), lambda a: F.slice("words", a + 1, STRETCH + longest))
    parts = split.select("doc_id", "text_key", F.posexplode(cuts).alias("nth", "part"))
    key = ["doc_id", "text_key", "nth"]
    both = may_match(parts, maybe, key).alias("p").join(maybe.hint("merge").alias("c"), reduce(and_, (F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key)))
    rows = both.select("p.doc_id", "p.text_key", "part", "c.nth", "item", "diag").join(looked_up.select("item", F.col("words").alias("want"), "m", "item_ids"), "item")
    base = F.greatest(F.col("diag"), F.lit(0))
    skip = F.greatest(-F.col("diag"), F.lit(0))
    own = F.slice("part", base - F.col("nth") * STRETCH + 1, F.col("m") - skip)
    flags = F.array_join(F.zip_with(own, F.slice("want", skip + 1, F.size(own)), lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    rows = rows.select("doc_id", "text_key", "item", "item_ids", base.alias("base"), flags.alias("flags"), F.least("m", F.lit(window)).alias("need"))
    return rows.where(F.contains("flags", F.repeat(F.lit("1"), F.col("need"))))


def hit_places(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos) of every document word inside an occurrence, each once."""
    n = F.col("need")
    ones = lambda s: F.substring(F.col("flags"), s + 1, n) == F.repeat(F.lit("1"), n)
    starts = F.filter(F.sequence(F.lit(0), F.length("flags") - n), ones)
    places = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(F.col("base") + s, F.col("base") + s + n - 1))))
    return found.select("doc_id", "text_key", F.explode(places).alias("pos")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, near: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key (a hash of the text), n_words, n_hit, n_items, items_sha256, contaminated.

    Words: runs of anything but ASCII non-alphanumerics, A-Z lower-cased. A word is hit inside any occurrence of a
    window: ``window`` consecutive item words, or all of a shorter item. Contaminated: n_hit > 0 and
    share * n_hit >= n_words. Null and empty texts have no words, on either side. Rows that agree in id and text
    share their result; other columns are ignored; empty tables give an empty result or one without hits.
    ``near`` adds n_near and near_sha256: the items of proximity matches, the exact ones among them, counted and
    digested as those of n_items are.
    """
    items = materialize(benchmark_items(benchmark), "benchmark")
    index = build_index(docs, items.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("term")).distinct())
    found = materialize(phrase_matches(docs, index, items, window), "found")
    key = ["doc_id", "text_key"]
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    n_hit = hit_places(found).groupBy(key).agg(F.count("*").alias("n_hit"), F.lit(None).cast("array<string>").alias("ids"), F.lit(None).cast("array<string>").alias("near_ids"))
    ids = found.groupBy(key).agg(F.lit(None).cast("long").alias("n_hit"), listed("item_ids").alias("ids"), F.lit(None).cast("array<string>").alias("near_ids"))
    every = n_hit.unionByName(ids)
    if near:
        ids_of = sized(items.select("item", F.col("item_ids").alias("near_ids")), values=F.size("near_ids"))
        close = proximity_matches(index, items, window=window).join(ids_of, "item").groupBy(key).agg(listed("near_ids").alias("near_ids"))
        every = every.unionByName(close, allowMissingColumns=True)
    hit = materialize(every.groupBy(key).agg(F.max("n_hit").alias("n_hit"), F.max("ids").alias("ids"), F.max("near_ids").alias("near_ids"), F.lit(1).alias("rows")), "hits")
    rows = index.where(F.col("term") == closing()).select("doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))
    out = key_left_join(rows, hit, key, "rows")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids, near_ids = (F.coalesce(c, F.array().cast("array<string>")) for c in ("ids", "near_ids"))
    more = [F.size(near_ids).cast("long").alias("n_near"), F.sha2(F.array_join(near_ids, ","), 256).alias("near_sha256")] if near else []
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        *more,
    )
