"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only when it was counted and holds at most this many narrow rows or array values (some 16 bytes each).
BROADCAST_ROWS = 200_000


#: Bits of the filter that keeps rows without a partner out of a shuffle: at most BITS / 64 rows of two longs are broadcast.
BITS = 1 << 25

#: Keys that hold more than one HOT-th of all rows are joined by broadcast: there are fewer than HOT of them.
HOT = 2048

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; one of our own only in local mode where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="panelmill-"))
        path = _OWN_DIR[0]
    return path


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small: a task's Python side then needs a few batches of 4 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder once and read it back."""
    path = f"{shared_dir(df.sparkSession)}/panelmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, values: Column | None = None, most: int | None = None) -> bool:
    """Whether a count proves that ``df`` may be broadcast; ``values``: how many values a row's arrays hold; they count like rows.

    Call it on materialized tables only: there a count reads file footers or one column, and no task gathers rows for it.
    """
    n = df.count() if values is None else df.agg(F.coalesce(F.sum(values + 1), F.lit(0))).first()[0]
    return n <= (BROADCAST_ROWS if most is None else most)


def sized(df: DataFrame, most: int | None = None, values: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint when it is ``small``; without one (a shuffled join) beyond that.

    For tables that follow a benchmark, not the documents; those of documents are joined by ``key_join`` and its kin.
    """
    return F.broadcast(df) if small(df, values, most) else df


def may_match(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS, without: bool = False) -> DataFrame:
    """``rows`` whose ``on`` may be among those of ``keys`` (with ``without``: those whose ``on`` surely is not).

    A one-hash Bloom filter of fixed size in built-in functions: words of 64 bits, so that the broadcast never holds
    more than ``bits`` / 64 rows of two longs. It is the same plan at every size, and rows without a partner, however
    wide, take no part in the shuffle of the join that follows. Null is a key like any other.
    """
    slot, word, held = (n + "_" * max(map(len, rows.columns)) for n in ("slot", "word", "held"))  # longer than any other name
    place = F.pmod(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in on)), F.lit(bits))
    words = keys.select(place.alias(slot)).groupBy(F.shiftright(slot, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias(held))
    found = rows.withColumn(slot, place).withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.expr(f"getbit({held}, cast({slot} & 63 as int)) = 1"), F.lit(False))
    return found.where(~hit if without else hit).select(*(F.col(f"`{c}`") for c in rows.columns))


def key_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, every: bool = False) -> DataFrame:
    """Inner, null-safe join of ``rows`` with ``table``, whose ``on`` is unique and whose ``weight`` says how many rows hold the key.

    Keys above one ``HOT``-th of all rows come by broadcast, so that no task gets all rows of one; the others are
    merged, after a filter of fixed size has kept rows without a partner out of the shuffle (``every``: there are none).
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    often = table.where(F.col(weight) > int(total) // HOT)
    rest = (rows if every else may_match(rows, table, on)).alias("l_").join(F.broadcast(often.select(*on)).alias("r_"), _same(on), "left_anti")
    more = [c for c in table.columns if c not in on]
    both = lambda left, right: left.alias("l_").join(right.alias("r_"), _same(on)).select("l_.*", *(F.col(f"r_.{c}") for c in more))
    return both(rows, F.broadcast(often)).unionByName(both(rest, table.hint("merge")))


def _same(on: list[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & F.col(f"l_.{c}").eqNullSafe(F.col(f"r_.{c}"))
    return out


def left_out(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose ``on`` (null-safe) is not in ``keys``. Only rows that pass the filter of fixed size are shuffled."""
    maybe = may_match(rows, keys, on).alias("l_").join(keys.select(*on).hint("merge").alias("r_"), _same(on), "left_anti")
    return may_match(rows, keys, on, without=True).unionByName(maybe)


def key_left_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """As ``key_join``, and rows without a partner with nulls for the columns of ``table``."""
    return key_join(rows, table, on, weight).unionByName(left_out(rows, table, on), allowMissingColumns=True)


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only; the quick path serves texts that are all ASCII."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_class(*more: str) -> Column:
    """A 128-bit key of a document row by its id and text: rows that agree in both share every result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(text, F.length(text), "doc_id", *more).alias("b"))


_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the offsets of each (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return (_LOWER_BYTES[raw] if lower else raw), off - (off[0] if len(off) else 0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into ones of about ``most`` bytes of text, so that memory doesn't follow the batch size.

    A single longer text makes a slice of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def word_bounds(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the text it is in; ``is_word`` holds a flag for each byte value.

    Words never cross a text's border.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_word[raw]
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < n]] = True
    start = np.empty(n, bool)
    start[0] = inside[0]
    start[1:] = inside[1:] & (~inside[:-1] | first[1:])
    end = np.empty(n, bool)
    end[-1] = inside[-1]
    end[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes whose words are hashed at once; the arrays of a longer text follow its words, not its bytes.
SEGMENT = 1 << 20


def segments(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes that end at a text's border or before a byte that is no part of a word."""
    size, a = size or SEGMENT, 0
    while a < len(raw):
        b = min(a + size, len(raw))
        border = int(off[np.searchsorted(off, b)])
        while b < border and is_word[raw[b]]:
            ends = np.flatnonzero(~is_word[raw[b : min(b + 4096, border)]])
            b = b + int(ends[0]) if len(ends) else min(b + 4096, border)
        yield a, b
        a = b


def text_words(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts, and the text it is in, made segment by segment."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in segments(raw, off, is_word):
        starts, ends, owner = word_bounds(raw[a:b], np.clip(off - a, 0, b - a), is_word)
        hashes.append(word_hashes(raw[a:b], starts, ends))
        owners.append(owner)
    return np.concatenate(hashes), np.concatenate(owners)


def _terms(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    terms = raw.astype(np.uint64)
    terms += np.uint64(1)
    terms += place.view(np.uint64) << np.uint64(9)
    return mix(terms)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a sum of mixed (byte, place) terms, mixed again with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    if len(starts) and lengths.max() > SEGMENT:  # very long words, piece by piece: the terms add up
        out = np.zeros(len(starts), np.uint64)
        few = lengths <= SEGMENT
        out[few] = word_hashes(raw, starts[few], ends[few])
        for i in np.flatnonzero(~few).tolist():
            total = np.zeros(1, np.uint64)
            for a in range(0, int(lengths[i]), SEGMENT):
                part = raw[starts[i] + a : min(starts[i] + a + SEGMENT, ends[i])]
                total += _terms(part, np.arange(a, a + len(part), dtype=np.int64)).sum(dtype=np.uint64)
            out[i] = mix(total + lengths[i : i + 1].astype(np.uint64) * _MULT)[0]
        return out
    local = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(local, lengths)
    terms = _terms(raw[np.repeat(starts, lengths) + place], place)
    return mix(np.add.reduceat(terms, local) + lengths.astype(np.uint64) * _MULT)
