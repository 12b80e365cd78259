"""Jaccard self-join on word n-gram sets by prefix filters under several global token orders.

Two sets of sizes a and b with 100 * |A & B| >= t * |A | B| share a token among the first n - ceil(t n / 100) + 1
tokens of each, whatever global order the tokens are put in. Candidates must therefore share prefix tokens under all of
three orders: rare tokens first, and two unrelated pseudo-random orders. The steps:

1. equal sets fold into a class, so exact copies cost one member; a class is told by 128 bits of its set;
2. tokens are counted in hash buckets; tokens found frequent beforehand are put last in the rare-first order (any order
   is sound), so that no bucket holds a hot token's whole list;
3. a class's home is the star of the least class that shares one of its rare-first prefix tokens, after one more step
   from star to star; stars are cut into blocks of bounded size, and two stars meet only if a prefix token lies in both:
   no closure over chains of candidates;
4. a pair of blocks intersects the prefix filters of all orders pair by pair, verifies what passes on the whole sets, and
   reports a spanning forest and link counts, never the pairs;
5. components of the links give the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm._common import key_join, key_left_join, materialize, may_match, mix, remove, slices, text_bytes, text_words
from panelmill.llm.components import connected_components

#: Bytes that part words: blank and \x09-\x0D.
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Odd multipliers of a shingle's words, derived from one constant.
_SPREAD = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(64)]

#: Tokens counted at once when frequent ones are sought; a task reports those it has seen ``OFTEN`` times.
COUNTED_TOKENS = 1 << 20
OFTEN = 16
#: A token is frequent from one in 2 ** HEAVY_BITS of all tokens on, so there are at most that many.
HEAVY_BITS = 20
BUCKET_ROWS = 1_000_000
DEALT_TOKENS = 500_000
#: Within a bucket, tokens travel as their low bits: any mapping of tokens that all tasks share is sound.
KEY_BITS = 40
#: Sets and tokens of a block; blocks of large stars grow with the root of the star's size between the two.
BLOCK_SETS, BLOCK_SETS_MOST = 64, 512
BLOCK_TOKENS = 1_000_000
#: Stars of one token that are paired in one row.
PAIRED = 64
CLASHES_MOST = 100_000
#: Bits of a set's first key that count; fewer only in tests.
FIRST_KEY_BITS = 64


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and the offsets of each text's."""
    raw, off = text_bytes(column, lower=True)
    n = len(off) - 1
    words, owner = text_words(raw, off, _IS_WORD)
    per = np.bincount(owner, minlength=n)
    out, owners = [], []
    if len(words) >= width:
        h = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            h += words[k : len(words) - width + 1 + k] * _SPREAD[k]
        whole = owner[: len(words) - width + 1] == owner[width - 1 :]
        out.append(mix(h[whole]))
        owners.append(owner[: len(words) - width + 1][whole])
    first = np.cumsum(per) - per
    for count in range(1, width):
        short = np.flatnonzero(per == count)
        if len(short):
            h = sum(words[first[short] + k] * _SPREAD[k] for k in range(count))
            out.append(mix(h + _SPREAD[width + count]))
            owners.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    if n == 1:  # maybe a very long text: one array to sort
        h = np.unique(out[0])
        return h, np.array([0, len(h)])
    h, who = np.concatenate(out), np.concatenate(owners)
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(who[keep], minlength=n))])


def set_keys(sets: np.ndarray, off: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set (0 for an empty one)."""
    size = np.diff(off)
    full = np.flatnonzero(size)
    out = np.zeros((2, len(size)), np.uint64)
    if len(full):
        for k in range(2):
            out[k, full] = mix(np.add.reduceat(mix(sets ^ _SPREAD[40 + 2 * k]), off[:-1][full]) + size[full].astype(np.uint64) * _SPREAD[41 + 2 * k])
    return (out[0] >> np.uint64(64 - bits)).view(np.int64), out[1].view(np.int64)


def class_ids(sets: np.ndarray, off: np.ndarray, clashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """The first key of each set; the second where the first is known (``clashes``, sorted) to stand for different sets."""
    a, b = set_keys(sets, off, bits)
    return np.where(np.isin(a, clashes), b, a) if len(clashes) else a


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - -(-n * percent // 100) + 1


def _members(docs: DataFrame, width: int) -> DataFrame:
    """Rows (0, doc_id, n, a, b) per document and (1, null, count, token, null) for tokens that a task finds frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "a", "b"]
        token, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            again = (n > 1) | np.isin(found, token)
            every, at = np.unique(np.concatenate([token, found[again]]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([count, n[again]]), minlength=len(every)).astype(np.int64)
            if len(every) > COUNTED_TOKENS:  # the least counts go
                most = np.sort(np.argpartition(total, -COUNTED_TOKENS // 2)[-COUNTED_TOKENS // 2 :])
                every, total = every[most], total[most]
            return every, total

        for batch in slices(batches):
            sets, off = shingle_sets(batch.column("text"), width)
            (a, b), size = set_keys(sets, off, FIRST_KEY_BITS), np.diff(off)
            none = size == 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), batch.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(a, mask=none), pa.array(b, mask=none)], names=names)
            use = np.zeros(len(a), bool)
            use[np.unique(a, return_index=True)[1]] = True
            held.append(sets[np.repeat(use, size)])
            if sum(map(len, held)) >= COUNTED_TOKENS:
                token, count = merge()
        if held:
            token, count = merge()
        often = count >= OFTEN
        k = int(often.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(count[often]), pa.array(token[often].view(np.int64)), pa.nulls(k, pa.int64())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, a long, b long")


BLOB = {"token": np.uint64, "class_id": np.int64, "times": np.uint32, "hot": np.int32, "hot_class": np.int64, "info_class": np.int64, "info": np.int32}


def _cut(column: np.ndarray, at: np.ndarray, drop: int = 0) -> pa.Array:
    """The bytes of ``column`` between neighbouring places of ``at``, without the ``drop`` high bytes of each value."""
    w = column.itemsize
    raw = np.ascontiguousarray(column.view(np.uint8).reshape(-1, w)[:, : w - drop]).tobytes()
    w -= drop
    return pa.array([raw[a * w : b * w] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())


def _postings(docs: DataFrame, heavy: np.ndarray, clashes: np.ndarray, buckets: int, percent: int, width: int) -> DataFrame:
    """(class_id, token, df, n, plain): rows of three kinds.

    Tokens that several classes hold, with df; frequent tokens that a prefix reaches, with df null and their negative
    rank as token; and for each class a row without token: n, the size of its set, and plain, how many of its tokens
    are not frequent.
    """
    by_token = np.argsort(heavy)
    shared = docs.sparkSession.sparkContext.broadcast((heavy[by_token], by_token.astype(np.int64)))
    bits = max(buckets.bit_length() - 1, 1)
    low = np.uint64((1 << KEY_BITS) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        bucket_of = lambda x: (x >> np.uint64(64 - bits)).astype(np.int32)

        def prepared(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            """Of the first text of each class: plain tokens and classes; frequent ones in prefixes and classes; classes, sizes, plain counts."""
            known, rank_of = shared.value
            sets, off = shingle_sets(batch.column("text"), width)
            ids, size = class_ids(sets, off, clashes, FIRST_KEY_BITS), np.diff(off)
            first = np.zeros(len(ids), bool)
            first[np.unique(ids, return_index=True)[1]] = True
            first &= size > 0
            of = np.repeat(np.arange(len(ids)), size)
            at = np.minimum(np.searchsorted(known, sets), max(len(known) - 1, 0))
            hot = known[at] == sets if len(known) else np.zeros(len(sets), bool)
            cold = ~hot & first[of]
            plain = np.bincount(of[cold], minlength=len(ids))
            key = np.sort(mix((sets[cold] & low | bucket_of(sets[cold]).astype(np.uint64) << np.uint64(KEY_BITS)) * _SPREAD[60] + ids[of[cold]].view(np.uint64)))
            if (key[1:] == key[:-1]).any():  # keys that meet in one set count once: a shorter count makes a longer prefix
                pairs = np.unique(np.stack([of[cold].astype(np.uint64), sets[cold] & low, bucket_of(sets[cold]).astype(np.uint64)]), axis=1)
                plain = np.bincount(pairs[0].astype(np.int64), minlength=len(ids))
            need = prefix_length(size, percent) - plain
            some = np.flatnonzero(hot & first[of] & (need[of] > 0))
            if len(some):  # the first frequent tokens of a class, by their rank, as many as its prefix still needs
                some = some[np.lexsort((rank_of[at[some]], of[some]))]
                begin = np.flatnonzero(np.concatenate([[True], of[some][1:] != of[some][:-1]]))
                place = np.arange(len(some)) - np.repeat(begin, np.diff(np.append(begin, len(some))))
                some = some[place < need[of[some]]]
            return sets[cold], ids[of[cold]], -1 - rank_of[at[some]].astype(np.int32), ids[of[some]], ids[first], np.stack([size[first], plain[first]], 1).astype(np.int32)

        def close() -> pa.RecordBatch:
            token, owner, hot, hot_owner, ids, info = (np.concatenate(c) for c in zip(*held))
            held.clear()
            ends = lambda b: np.searchsorted(b, np.arange(buckets + 1))
            order = np.argsort(bucket_of(token), kind="stable")
            token, owner = token[order], owner[order]
            bucket = bucket_of(token)
            # classes count once per run of their tokens
            runs = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])])) if len(token) else np.zeros(0, np.int64)
            parts = [_cut(token, ends(bucket), 8 - KEY_BITS // 8)]
            parts += [_cut(c, ends(bucket[runs])) for c in (owner[runs], np.diff(np.append(runs, len(token))).astype(np.uint32))]
            for key, values in ((hot_owner, hot), (ids, info)):
                spot = bucket_of(mix(key.view(np.uint64)))
                order = np.argsort(spot, kind="stable")
                pair = [_cut(np.ascontiguousarray(values[order]).view(np.int64) if values.ndim > 1 else values[order], ends(spot[order])), _cut(key[order], ends(spot[order]))]
                parts += pair if values.ndim == 1 else pair[::-1]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int64)), *parts], names=["bucket", *BLOB])

        for batch in slices(batches):
            held.append(prepared(batch))
            if sum(len(h[0]) for h in held) >= DEALT_TOKENS:
                yield close()
        if held:
            yield close()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["class_id", "token", "df", "n", "plain"]

        def close(bucket: int, parts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            raw = {c: b"".join(p) for c, p in zip(BLOB, parts)}
            wide = np.zeros((len(raw["token"]) * 8 // KEY_BITS, 8), np.uint8)
            wide[:, : KEY_BITS // 8] = np.frombuffer(raw.pop("token"), np.uint8).reshape(len(wide), -1)
            token = wide.reshape(-1).view(np.uint64)
            x = {c: np.frombuffer(b, BLOB[c]) for c, b in raw.items()}
            owner = np.repeat(x["class_id"], x["times"])
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            keep = np.ones(len(token), bool)
            keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner = token[keep], owner[keep]
            new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            runs = np.diff(np.append(new, len(token)))
            df = np.repeat(runs, runs)
            token, owner, df = token[df > 1], owner[df > 1], df[df > 1]
            token = token.view(np.int64) | np.int64(bucket << KEY_BITS)
            void = lambda k: pa.nulls(k, pa.int64())
            for a in range(0, len(token), 100_000):
                k = len(token[a : a + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(owner[a : a + k]), pa.array(token[a : a + k]), pa.array(df[a : a + k].astype(np.int64)), void(k), void(k)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(x["hot_class"]), pa.array(x["hot"].astype(np.int64)), void(len(x["hot"])), void(len(x["hot"])), void(len(x["hot"]))], names=names)
            ids, info = x["info_class"], x["info"].reshape(-1, 2).astype(np.int64)
            ids, at = np.unique(ids, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), void(len(ids)), void(len(ids)), pa.array(info[at, 0]), pa.array(info[at, 1])], names=names)

        now, parts = None, [[] for _ in BLOB]
        for batch in batches:
            for bucket, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", *BLOB))):
                if now is not None and bucket != now:
                    yield from close(now, parts)
                    parts = [[] for _ in BLOB]
                now = bucket
                for p, b in zip(parts, blobs):
                    p.append(b)
        if now is not None:
            yield from close(now, parts)

    blobs = docs.select("text").mapInArrow(deal, "bucket long, " + ", ".join(f"{c} binary" for c in BLOB))
    # a bucket is a partition of its own: hashed, several large ones would meet in one task
    dealt = blobs.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "class_id long, token long, df long, n long, plain long")


def _prefixes(postings: DataFrame, percent: int) -> DataFrame:
    """(token, class_id) of each class's prefix under the rare-first order, as far as other classes hold the token."""
    own = Window.partitionBy("class_id")
    size, plain = F.max("n").over(own), F.max("plain").over(own)
    due = size - F.ceil(size * percent / F.lit(100)) + 1
    ranked = postings.select("class_id", "token", "df", due.alias("due"), plain.alias("plain"), F.count("df").over(own).alias("shared"), F.row_number().over(own.orderBy(F.col("df").asc_nulls_last(), "token")).alias("place"))
    return ranked.where(F.col("token").isNotNull() & (F.col("df").isNull() | (F.col("place") <= F.col("due") - (F.col("plain") - F.col("shared"))))).select("token", "class_id").distinct()


def _share(prefix: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have some prefix token in common."""
    k = len(prefix)
    token = np.concatenate(prefix)
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(k), [len(p) for p in prefix])
    return _products(row, column, count, k) > 0


def _products(row: np.ndarray, column: np.ndarray, count: np.ndarray, k: int, width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks over the tokens that two sets or more hold."""
    several = count[column] > 1
    row, column = row[several], column[several]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((k, k), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    top = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, top, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((k, min(width, top - a)), np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    return out


def verify_block(sets: list[np.ndarray], rare: list[np.ndarray], side: np.ndarray, percent: int, cross: bool | None = None) -> np.ndarray:
    """Link matrix of a block: filters under all three orders, then verification on the whole sets.

    In a ``cross`` block (of two sides, either of which may be empty) pairs with equal ``side`` don't count; without
    the word a block is one of those if it holds several sides.
    """
    k = len(sets)
    size = np.array([len(s) for s in sets])
    due = prefix_length(size, percent)
    ok = np.triu(np.ones((k, k), bool), 1)
    if cross or (cross is None and len(np.unique(side)) > 1):
        ok &= side[:, None] != side[None, :]
    ok &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    if not ok.any():
        return ok
    ok &= _share(rare)
    for salt in (50, 51):
        if not ok.any():
            return ok
        ordered = [np.partition(mix(s ^ _SPREAD[salt]), min(d, len(s)) - 1)[:d] for s, d in zip(sets, due.tolist())]
        ok &= _share(ordered)
    some = np.argwhere(ok)
    if len(some) <= 4 * k:
        for a, b in some.tolist():
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            ok[a, b] = 100 * both >= percent * (size[a] + size[b] - both)
        return ok
    token = np.concatenate(sets)
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    both = _products(np.repeat(np.arange(k), size), column, count, k).astype(np.int64)
    return ok & (100 * both >= percent * (size[:, None] + size[None, :] - both))


def _roots(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row reaches over the links."""
    root = ids.copy()
    a, b = np.nonzero(links)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            break
    return root


def _verify(rows: DataFrame, percent: int) -> DataFrame:
    """(class_id, root, links) from rows (i, j, side, class_id, times, set, rare) sorted by block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple], cross: bool) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            side, ids, times = (np.array([r[c] for r in rows], np.int64) for c in range(3))
            links = verify_block([np.frombuffer(r[3], np.uint64) for r in rows], [np.array(r[4], np.int64) for r in rows], side, percent, cross)
            number = links @ times + times @ links
            hit = np.flatnonzero(number)
            return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(_roots(links, ids)[hit]), pa.array(number[hit].astype(np.int64))], names=["class_id", "root", "links"])

        now, rows = None, []
        for batch in batches:
            for i, j, *rest in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "side", "class_id", "times", "set", "rare"))):
                if now is not None and now != (i, j):
                    if (out := close(rows, now[0] != now[1])) is not None:
                        yield out
                    rows = []
                now = i, j
                rows.append(tuple(rest))
        if now is not None and (out := close(rows, now[0] != now[1])) is not None:
            yield out

    return rows.mapInArrow(run, "class_id long, root long, links long")


def _fetch_sets(docs: DataFrame, clashes: np.ndarray, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, off = shingle_sets(batch.column("text"), width)
            ids = class_ids(sets, off, clashes, FIRST_KEY_BITS)
            raw = sets.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([raw[8 * a : 8 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())], names=["class_id", "set"])

    return docs.select("text").mapInArrow(run, "class_id long, set binary")


def _star_pairs(spots: DataFrame) -> DataFrame:
    """(u, nu, v, nv): stars with a prefix token in common and their numbers of blocks, from distinct (token, label, blocks).

    The stars of a token are dealt to slices of about ``PAIRED``, and slices meet pair by pair, so that no row holds more
    stars than two slices do.
    """
    several = materialize(spots.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "several")
    dealt = key_join(spots, several, ["token"], "k").withColumn("cuts", F.ceil(F.col("k") / PAIRED).cast("int")).withColumn("cut", F.pmod(F.xxhash64("label", "token"), F.col("cuts")).cast("int"))
    met = dealt.select("token", "label", "blocks", "cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    met = met.groupBy("token", F.least("cut", "other").alias("x"), F.greatest("cut", "other").alias("y")).agg(F.collect_list(F.struct("label", "blocks", "cut")).alias("s"))
    apart = lambda a, b: (a["label"] < b["label"]) & ((F.col("x") == F.col("y")) | (a["cut"] != b["cut"]))
    pair = lambda a: F.transform(F.filter("s", lambda b: apart(a, b)), lambda b: F.struct(a["label"].alias("u"), a["blocks"].alias("nu"), b["label"].alias("v"), b["blocks"].alias("nv")))
    return met.select(F.inline(F.flatten(F.transform("s", pair)))).distinct()


def _block(label: str, part: str) -> Column:
    return F.xxhash64(F.col(label), F.col(part))


def _numbered(classes: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Homes (class_id, block, least, times) of classes that share a prefix token, and block pairs (block, i, j).

    A star that shares a token with stars of lesser labels joins the least of them, once: a group of near copies then
    is one star, or a few, and a chain of candidates still makes stars of a few links each.
    """
    first = held.groupBy("class_id").agg(F.min("pivot").alias("label"))
    placed = materialize(classes.join(first.hint("merge"), "class_id"), "placed")
    spots = held.select("token", "class_id").join(placed.select("class_id", "label").hint("merge"), "class_id").select("token", "label").distinct()
    spots = materialize(spots, "spots")
    ends = materialize(spots.groupBy("token").agg(F.min("label").alias("low"), F.count("*").alias("k")).where("k > 1"), "ends")
    met = materialize(key_join(spots, ends, ["token"], "k").select("token", "label", "low"), "met")
    hooks = met.groupBy("label").agg(F.min("low").alias("to"), F.count("*").alias("spots")).where("to < label")
    hooks = materialize(hooks.join(placed.groupBy("label").agg(F.count("*").alias("k")).hint("merge"), "label"), "hooks")
    hooked = lambda df, weight: key_left_join(df, hooks.select("label", "to", weight), ["label"], weight).withColumn("label", F.coalesce("to", "label")).drop("to", weight)
    joined = materialize(hooked(placed, "k"), "joined")
    spots = materialize(hooked(met.select("token", "label"), "spots").distinct(), "hooked")

    per = F.least(F.greatest(F.lit(BLOCK_SETS), (2 * F.sqrt("k")).cast("int")), F.lit(BLOCK_SETS_MOST))
    stars = joined.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("tokens"))
    stars = materialize(stars.select("label", "k", F.greatest(F.ceil(F.col("k") / per), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("blocks")), "stars")
    homes = key_join(joined, stars, ["label"], "k", every=True).withColumn("part", F.pmod(F.xxhash64("class_id", F.lit(7)), F.col("blocks")).cast("int")).withColumn("block", _block("label", "part"))
    homes = materialize(homes.select("class_id", "block", "least", "times"), "homes")
    seen = spots.groupBy("label").agg(F.count("*").alias("w"))
    seen = materialize(stars.select("label", "blocks").join(seen.hint("merge"), "label"), "seen")
    across = _star_pairs(key_join(spots, seen, ["label"], "w", every=True).select("token", "label", "blocks"))
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    far = across.select("u", "v", "nv", parts("nu").alias("pu")).select("u", "pu", "v", parts("nv").alias("pv")).select(_block("u", "pu").alias("a"), _block("v", "pv").alias("b"))
    near = stars.where("k > 1").select("label", "blocks", parts("blocks").alias("p")).select("label", "p", F.explode(F.sequence("p", F.col("blocks") - 1)).alias("q")).select(_block("label", "p").alias("a"), _block("label", "q").alias("b"))
    tasks = far.unionByName(near).select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    tasks = materialize(tasks.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j"), "tasks")
    remove(placed, spots, ends, met, hooks, joined, stars, seen)
    return homes, tasks


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links, root, set_a, set_b.

    A set: the distinct ``width``-word shingles (a shorter text: its whole word sequence); texts without words, and
    nulls, have an empty set and link with nothing. Sets link when 100 * intersection >= percent * union. The component
    id is the least doc_id that links reach (a row without partner: its own); n_links counts the linked rows, exact
    copies included. Repeated rows are rows of their own; a null doc_id takes part, and is no component id unless
    its component has no other. root tells components apart, and set_a and set_b are 128 bits of
    the set (all null for an empty one). Other columns are ignored; an empty table gives an empty one.
    """
    parts = materialize(_members(docs, width), "sets")
    members = parts.where("kind = 0").select("doc_id", "n", "a", "b")
    mixed = members.where("n > 0").groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi")
    clashes = np.sort(mixed.select("a").limit(CLASHES_MOST + 1).toPandas()["a"].to_numpy(np.int64))  # none below some 10^9 sets
    if len(clashes) > CLASHES_MOST:
        raise RuntimeError("too many sets share a key")
    members = members.withColumn("class_id", F.when(F.col("a").isin(clashes.tolist()), F.col("b")).otherwise(F.col("a")) if len(clashes) else F.col("a"))
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = parts.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") > max(OFTEN, int(total) >> HEAVY_BITS))
    frequent = frequent.toArrow().sort_by([("n", "ascending"), ("a", "ascending")])  # at most 2 ** HEAVY_BITS rows of 16 bytes
    heavy = frequent.column("a").to_numpy().astype(np.int64).view(np.uint64)
    buckets = 1 << max(4, (int(total) // BUCKET_ROWS).bit_length())
    prefixes = materialize(_prefixes(_postings(docs, heavy, clashes, buckets, percent, width), percent), "prefixes")

    classes = members.where("n > 0").groupBy("class_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"), F.first("n").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"), F.max("b").alias("b"))
    classes = materialize(classes, "classes")
    if len(clashes) and not classes.where("lo <> hi").isEmpty():
        raise RuntimeError("sets share both keys")
    tied = materialize(prefixes.groupBy("token").agg(F.min("class_id").alias("pivot"), F.count("*").alias("k")).where("k > 1"), "tied")
    held = materialize(key_join(prefixes, tied, ["token"], "k").select("token", "class_id", "pivot"), "held")
    homes, tasks = _numbered(classes.select("class_id", "least", "times", "n"), held)

    # the sets of texts that stand for a class in some star; no text is shuffled
    stand = may_match(docs.select("doc_id", "text"), homes.select(F.col("least").alias("doc_id")), ["doc_id"])
    sets = may_match(_fetch_sets(stand, clashes, width), homes, ["class_id"]).groupBy("class_id").agg(F.first("set").alias("set"))
    rare = held.groupBy("class_id").agg(F.collect_list("token").alias("rare"))
    rows = homes.select("class_id", "block", "times").join(tasks.hint("merge"), "block").withColumnRenamed("block", "side")
    dealt = rows.join(sets.hint("merge"), "class_id").join(rare.hint("merge"), "class_id").select("i", "j", "side", "class_id", "times", "set", "rare")
    found = materialize(_verify(dealt.repartition("i", "j").sortWithinPartitions("i", "j"), percent), "links")
    remove(prefixes, tied, held, homes, tasks)

    roots = connected_components(found.select(F.col("class_id").alias("u"), F.col("root").alias("v")))
    number = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    special = classes.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").join(number, "class_id", "left").where("root is not null or times > 1")
    special = materialize(special.select("class_id", F.coalesce("root", "class_id").alias("root"), "least", "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links")), "special")
    lowest = special.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialize(special.join(lowest, "root").select("class_id", "times", "component_id", "links", "root"), "known")
    remove(found, classes, special)
    out = key_left_join(members, known, ["class_id"], "times")
    alone = F.col("links").isNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "class_id").alias("root"),
        F.col("a").alias("set_a"),
        F.col("b").alias("set_b"),
    )


def with_set_keys(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` and set_a, set_b: 128 bits of each text's set (null for an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, off = shingle_sets(batch.column("text"), width)
            none = np.diff(off) == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k, mask=none) for k in set_keys(sets, off, FIRST_KEY_BITS))], names=[*batch.schema.names, "set_a", "set_b"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType())]))
