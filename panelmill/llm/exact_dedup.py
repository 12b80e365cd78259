"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks; each chunk gets a polynomial hash under two prime moduli, and the hashes of neighbours
combine by H(ab) = H(a) * p^len(b) + H(b), so chunks (or longer segments of a huge text) can be hashed apart and in
parallel. Rows whose fingerprint and length agree are then compared chunk by chunk: every chunk number of such a
group must hold one distinct value. The comparison keeps the least and greatest chunk only, combined before the
shuffle, so a group of any size stays a few rows. A group that fails it (a collision) is told apart by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm._common import key_left_join, materialize, may_match, remove, sized, slices, text_bytes

CHUNK = 4096
COMPARE_CHUNK = 65_536
SEGMENT = 1 << 22
#: (modulus, base) of each half of a fingerprint
FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_566_083_941))


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base % modulus
    return out


_LOW = [_powers(p, m, CHUNK + 1) for m, p in FIELDS]
_HIGH = [_powers(pow(p, CHUNK, m), m, SEGMENT // CHUNK + 2) for m, p in FIELDS]


def shift(field: int, n: np.ndarray) -> np.ndarray:
    """p^n for lengths up to a segment's."""
    m = np.uint64(FIELDS[field][0])
    return _HIGH[field][n // CHUNK] * _LOW[field][n % CHUNK] % m


def combine(field: int, left: int, right: int, right_len: int) -> int:
    """Fingerprint of two neighbouring pieces from theirs."""
    m, p = FIELDS[field]
    return (left * pow(p, right_len, m) + right) % m


def fingerprints(raw: np.ndarray, off: np.ndarray, chunk: int = CHUNK) -> list[np.ndarray]:
    """Both halves of the fingerprint of each text in ``raw`` (all texts together at most a segment long)."""
    lengths = np.diff(off)
    out = [np.zeros(len(lengths), np.int64) for _ in FIELDS]
    if not len(raw):
        return out
    pieces = -(-lengths // chunk)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = off[:-1][owner] + nth * chunk
    end = np.minimum(start + chunk, off[1:][owner])
    exponent = np.repeat(end, end - start) - 1 - np.arange(len(raw))
    code = raw.astype(np.uint64) + np.uint64(1)
    full = np.flatnonzero(lengths)
    first = (np.cumsum(pieces) - pieces)[full]
    for field, (m, _) in enumerate(FIELDS):
        of_chunk = np.add.reduceat(code * _LOW[field][exponent], start) % np.uint64(m)
        moved = of_chunk * shift(field, off[1:][owner] - end) % np.uint64(m)
        out[field][full] = (np.add.reduceat(moved, first) % np.uint64(m)).astype(np.int64)
    return out


def fingerprint_long(raw: np.ndarray) -> list[int]:
    """As ``fingerprints`` for one text of any length, segment by segment."""
    total = [0 for _ in FIELDS]
    for at in range(0, len(raw), SEGMENT):
        part = raw[at : at + SEGMENT]
        for field, one in enumerate(fingerprints(part, np.array([0, len(part)]))):
            total[field] = combine(field, total[field], int(one[0]), len(part))
    return total


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
    raw, off = text_bytes(batch.column("text"), lower=True)
    prints = [[x] for x in fingerprint_long(raw)] if batch.num_rows == 1 and len(raw) > SEGMENT else fingerprints(raw, off)
    return raw, off, prints


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw, off, (a, b) = _keys(batch)
        view = memoryview(np.ascontiguousarray(raw))
        digests = [hashlib.sha256(view[s:e]).hexdigest() for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "fp1", "fp2", "n_bytes", "text_sha256"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw, off, (a, b) = _keys(batch)
        lengths = np.diff(off)
        pieces = np.maximum(-(-lengths // COMPARE_CHUNK), 1)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = off[:-1][owner] + nth * COMPARE_CHUNK
        end = np.minimum(start + COMPARE_CHUNK, off[1:][owner])
        view = raw.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(a)[owner], pa.int64()), pa.array(np.asarray(b)[owner], pa.int64()), pa.array(lengths[owner], pa.int64()), pa.array(nth, pa.int64()), pa.array([view[s:e] for s, e in zip(start.tolist(), end.tolist())], pa.binary())], names=["fp1", "fp2", "n_bytes", "chunk_no", "chunk"])


def collisions(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Of the fingerprint keys in ``keys``, those whose rows differ in some chunk.

    Other rows stay out by a filter of fixed size; one that slips through agrees with itself.
    """
    chunks = docs.select("text").mapInArrow(_chunks, "fp1 long, fp2 long, n_bytes long, chunk_no long, chunk binary")
    rows = may_match(chunks, keys, ["fp1", "fp2", "n_bytes"])
    ends = rows.groupBy("fp1", "fp2", "n_bytes", "chunk_no").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return ends.where("low <> high").select("fp1", "fp2", "n_bytes").distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row_id, doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and empty texts form one
    group. Of a group the row with the largest doc_id stays; rows that share it too (repeated rows) leave exactly
    one; null ids come last, and a group without any id has a null keep_id. Other columns are ignored.
    """
    base = materialize(docs.select("doc_id", "text").mapInArrow(_prints, "doc_id long, fp1 long, fp2 long, n_bytes long, text_sha256 string").withColumn("row_id", F.monotonically_increasing_id()), "prints")
    key = ["fp1", "fp2", "n_bytes"]
    twice = materialize(base.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "twice")
    bad = materialize(collisions(docs, twice), "collisions")
    told = base.join(sized(bad.withColumn("bad", F.lit(True))), key, "left").withColumn("apart", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")).drop("bad")
    rank = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    groups = told.groupBy(*key, "apart").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.max_by("row_id", rank).alias("keep_row")).where("group_size > 1")
    groups = materialize(groups, "groups")
    remove(twice)
    return key_left_join(told, groups, [*key, "apart"], "group_size").select(
        "row_id",
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_bytes",
    )
