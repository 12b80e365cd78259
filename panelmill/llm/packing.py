"""Best-fit packing of token sequences, certified by bounds.

Pieces are dealt to partitions, each packed by best-fit decreasing. Dual-feasible functions give every partition a
lower bound on its bins; a partition that uses more (a gap) gives up its unfilled bins' pieces, which are exchanged
between such partitions and packed again, until no partition has a gap that a round narrows.
"""

from __future__ import annotations

import re
import string
import sys
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm._common import materialize, slices

CAPACITY = 1024


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = 2, digest: bool = False) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its ids and then ``eos``; a null or empty text is ``eos`` alone. Only a document longer than
    ``capacity`` is cut: its first piece takes the remainder, all others are full. ``tokenizer`` is a file that all
    executors can read. ``digest``: ids_crc32 in place of the ids. Repeated rows give repeated pieces; other columns are
    ignored.
    """
    last = ("ids_crc32", pa.int64(), "long") if digest else ("ids", pa.binary(), "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder(tokenizer)
        end = int(eos).to_bytes(4, "little")
        for batch in slices(batches, most=1_000_000):
            out: list[list] = [[], [], [], [], []]
            docs, pieces, starts, lengths, bodies = (c.append for c in out)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                at = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else (0, n)
                view = memoryview(ids)
                for piece, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    docs(doc)
                    pieces(piece)
                    starts(a)
                    lengths(b - a)
                    bodies(zlib.crc32(view[4 * a : 4 * b]) if digest else ids[4 * a : 4 * b])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), last[1]))], names=["doc_id", "piece", "start", "length", last[0]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, piece int, start long, length long, {last[0]} {last[2]}")


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by a byte-level tokenizer.

    The library's pre-tokenizer always parts a text between a non-space and a space, so a text whose blanks are single is the
    sum of its blank-led chunks, and chunks repeat: the ids of at most twice ``most`` recent ones are kept. Other
    texts, and ones that name an added token, are encoded whole.
    """

    _UNSAFE = re.compile(r"\s ")

    def __init__(self, tokenizer: str, most: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        # chunks of letters alone are one pre-token each: the same model without pattern or parting, and without a second cache
        self.plain = Tokenizer.from_file(tokenizer)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.model._resize_cache(0)
        self.tok, self.most, self.known, self.old, self.marks = Tokenizer.from_file(tokenizer), most, {}, {}, {}
        vocabulary = self.tok.get_vocab()
        self.leads = {lead: np.zeros(max(vocabulary.values()) + 1, bool) for lead in " \n"}
        for lead, sign in ((" ", "\u0120"), ("\n", "\u010a")):  # a byte-level vocabulary's blank and line feed
            self.leads[lead][[i for t, i in vocabulary.items() if t == sign or (lead == " " and t[0] == sign)]] = True
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = [array("I", e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for ids in out:
                ids.byteswap()
        return [ids.tobytes() for ids in out]

    def _missing(self, words: set[str]) -> set[str]:
        new = words.difference(self.known)
        if self.old:
            back = [c for c in new if c in self.old]
            self.known.update(zip(back, map(self.old.__getitem__, back)))
            new.difference_update(back)
        return new

    def _learn(self, chunks: set[str]) -> None:
        """Make all ``chunks`` known.

        Marks at the end of a word are tokens of their own, and so is a line feed between a word or its marks and a word:
        words and marks are learned apart. The word after a line feed has no blank: its key has one, as no chunk does.
        """
        plain, rest, joined, marks = [], [], [], string.punctuation
        new = self._missing(chunks)
        for c in new:
            if c.isalpha():
                plain.append(c)
                continue
            body = c.rstrip(marks)
            word, feed, second = body.partition("\n")
            if feed:
                word = word.rstrip(marks)
                if word and second and word[-1].isalnum() and second[0].isalnum() and second[-1].isalnum():
                    joined.append((c, word, body[len(word) : -len(second)], " " + second, c[len(body) :]))
                    continue
            elif body and len(body) < len(c) and body[-1].isalnum():
                joined.append((c, body, c[len(body) :], None, ""))
                continue
            rest.append(c)
        bare = []
        for c in self._missing({w for _, first, _, second, _ in joined for w in (first, second) if w} - new):
            (bare if c[0] == " " else plain if c.isalpha() else rest).append(c)
        if len(self.marks) > 10_000:
            self.marks.clear()
        if lost := list({m for _, _, first, _, second in joined for m in (first, second)}.difference(self.marks)):
            self.marks.update(zip(lost, self._whole(lost)))
        self._encode(self.plain, " ", plain, plain)
        self._encode(self.tok, " ", rest, rest)
        words = [c[1:] for c in bare if c[1:].isalpha()]
        self._encode(self.plain, "\n", words, [" " + c for c in words])
        odd = [c for c in bare if not c[1:].isalpha()]
        self.known.update(zip(odd, self._whole([c[1:] for c in odd])))
        known, mark = self.known, self.marks
        for c, first, between, second, end in joined:
            known[c] = known[first] + mark[between] + known[second] + mark[end] if second else known[first] + mark[between]

    def _encode(self, tok, lead: str, words: list[str], keys: list[str]) -> None:
        """The ids of many words by few calls: each with its blank, or without the line feed that only parts them here.

        A word has one lead, at its start. If as many tokens start with it as there are words, no token reaches over a
        border (a token that did would hold a lead within), so that each word's tokens are its own.
        """
        odd, skip = [], lead != " "
        groups = [(words[i : i + 500], keys[i : i + 500]) for i in range(0, len(words), 500)]
        for (group, names), enc in zip(groups, tok.encode_batch_fast([lead + lead.join(g) for g, _ in groups], add_special_tokens=False)):
            ids = np.array(enc.ids, "<u4")
            first = np.flatnonzero(self.leads[lead][ids])
            if len(first) != len(group):  # chunks that are empty or end in white space run into the next
                odd += zip(group, names)
                continue
            raw, at = ids.tobytes(), (4 * first).tolist()
            ends = [*at[1:], len(raw)]
            self.known.update(zip(names, [raw[a + 4 : b] for a, b in zip(at, ends)] if skip else [raw[a:b] for a, b in zip(at, ends)]))
        self.known.update(zip((n for _, n in odd), self._whole([c if skip else lead + c for c, _ in odd])))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        heads, tails = [], []
        for t in texts:
            head, blank, tail = (t, "", "") if self._UNSAFE.search(t) or any(a in t for a in self.added) else t.partition(" ")
            heads.append(head)
            tails.append(tail.split(" ") if blank else ())
        self._learn(set().union(*tails))
        known = self.known.__getitem__
        return [h + b"".join(map(known, p)) for h, p in zip(self._whole(heads), tails)]


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, into the fullest bin with room for it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by space left
    spaces: list[int] = []  # spaces that some bin has, sorted
    used = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        k = bisect_left(spaces, n)
        if k < len(spaces):
            space = spaces[k]
            b = room[space].pop()
            if not room[space]:
                spaces.pop(k)
        else:
            b, space, used = used, capacity, used + 1
        bins[i], offsets[i] = b, capacity - space
        left = space - n
        if left:
            if not room[left]:
                spaces.insert(bisect_left(spaces, left), left)
            room[left].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound that two families of dual-feasible functions give on the number of bins.

    u_k(x): x when (k + 1) x is a multiple of the capacity, else the share floor((k + 1) x / c) / k; and, for
    e up to c / 2: whole when x > c - e, nothing when x < e, else x.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    total, number = np.cumsum((counts * x)[::-1])[::-1], np.cumsum(counts[::-1])[::-1]
    for e in np.flatnonzero(counts[: capacity // 2 + 1]).tolist():
        if e:
            whole = int(number[capacity - e + 1]) if capacity - e + 1 <= capacity else 0
            middle = int(total[e] - (total[capacity - e + 1] if capacity - e + 1 <= capacity else 0))
            best = max(best, whole + -(-middle // capacity))
    for k in range(1, 41):
        y = (k + 1) * x
        scaled = np.where(y % capacity == 0, k * x, (y // capacity) * capacity)  # k * capacity * u_k
        best = max(best, -(-int((counts * scaled).sum()) // (k * capacity)))
    return best


PACKED = ["pid", "length", "sequence_id", "offset", "part", "part_sequences", "part_bound", "again"]


def _pack_round(rows: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """Pack rows (pid, length) dealt to ``parts`` at random: see ``pack`` for the columns.

    A part that uses more sequences than its bound releases those that aren't full (``again``); it then counts as two
    parts, the full sequences and the released ones, each with a bound of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("part").to_numpy(), b.column("pid").to_numpy(), b.column("length").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        part, pid, length = (np.concatenate(x) for x in zip(*got))
        for p in np.unique(part).tolist():
            own = part == p
            ids, lengths = pid[own], length[own]
            order = np.argsort(ids)
            ids, lengths = ids[order], lengths[order]
            bins, offsets = best_fit_decreasing(lengths, capacity)
            n, least = int(bins.max()) + 1, lower_bound(lengths, capacity)
            filled = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
            again = (filled[bins] < capacity) if n > least else np.zeros(len(bins), bool)
            full = int((filled == capacity).sum())
            used, bound = (np.where(again, n - full, full), np.where(again, lower_bound(lengths[again], capacity), full)) if n > least else (np.full(len(bins), n), np.full(len(bins), least))
            base = turn * parts_base + p
            columns = (ids, lengths, (base << 32) + bins, offsets, 2 * base + again, used, bound)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(again)], names=PACKED)

    parts_base = 1 << 20
    dealt = rows.select(F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(parts)).alias("part"), "pid", "length").repartition(parts, "part")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in PACKED[:-1]) + ", again boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_part: int = 200_000) -> DataFrame:
    """(pid, sequence_id, offset, part, part_sequences, part_bound) for every row of ``pieces`` (pid: unique long, length).

    Full pieces are sequences of their own (part -1, one sequence, bound 1) and leave the search at once. A part holds
    about ``rows_per_part`` narrow rows at any input size. What the parts with a gap release is pooled, dealt anew and
    packed again, for as long as that lowers the number of sequences; a round that doesn't is discarded. part_sequences
    and part_bound are the certificate: the sequences of the row's part in the result, and its lower bound.
    """
    one = lambda n: F.lit(n).cast("long")
    full = pieces.where(F.col("length") == capacity).select("pid", (-F.col("pid") - 1).alias("sequence_id"), one(0).alias("offset"), one(-1).alias("part"), one(1).alias("part_sequences"), one(1).alias("part_bound"))
    rest = pieces.where(F.col("length") < capacity).select("pid", "length")
    done, held, turn = [full], None, 0
    placed = lambda df: df.select(full.columns)
    while True:
        parts = max(1, -(-rest.count() // rows_per_part))
        packed = materialize(_pack_round(rest, parts, turn, capacity), "packed")
        sums = packed.groupBy("part", "again").agg(F.first("part_sequences").alias("n"), F.sum("length").alias("tokens"))
        n, free, tokens = sums.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum(F.when(F.col("again"), F.col("n"))), F.sum(F.when(F.col("again"), F.col("tokens")))))).first()
        if held is not None and n >= held[1]:
            done.append(placed(held[0]))
            break
        if parts == 1 or free <= -(-tokens // capacity):
            done.append(placed(packed))
            break
        done.append(placed(packed.where("not again")))
        held = packed.where("again"), free
        rest, turn = held[0].select("pid", "length"), turn + 1
    return reduce(DataFrame.union, done)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = 2) -> DataFrame:
    """``token_pieces`` with the sequence and place of each piece and the certificate of its part: ..., ids, and ``pack``'s.

    Sequences are gapless from offset 0. See ``token_pieces`` and ``pack``.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, eos).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("pid", "length"), capacity), "pid").drop("pid")


def pack_digests(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = 2) -> DataFrame:
    """As ``pack_documents`` with ``ids_crc32`` in place of the ids, so that no ids are shuffled."""
    pieces = token_pieces(docs, tokenizer, capacity, eos, digest=True)
    pieces = materialize(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("pid", "length"), capacity), "pid").drop("pid")
