"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is described by shares of neighbouring byte
classes and by word statistics, and encoded by one hidden layer; gated attention, learned from document labels alone,
weighs the passages, and the weighted sum of their encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm import _common
from panelmill.llm._common import slices, text_bytes, word_bounds, word_hashes

PASSAGE = 64
HIDDEN, GATE = 32, 16
#: The fit uses at most this many labelled documents (those of least hash), with all their passages.
FIT_DOCS = 3000

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _classes() -> np.ndarray:
    out = np.full(256, 8, np.int64)
    groups = [b" ", bytes(range(32)), bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".,;", b"!?", b"|_=+-/\\<>~^", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
    for k, g in enumerate(groups):
        out[list(g)] = k + (k >= 8)  # 8: all other marks
    return out


_CLASS = _classes()
N_CLASS = 11
WIDTH = N_CLASS * N_CLASS + 6


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages of all texts, and each text's number of passages (one, of zeros, without words).

    A long text is described segment by segment, each of whole passages; a word of over four segments is cut.
    """
    raw, off = text_bytes(column)
    if len(off) != 2 or len(raw) <= 2 * _common.SEGMENT:
        return _described(raw, off)
    out, a = [], 0
    while a < len(raw):
        size = _common.SEGMENT
        while True:
            b = next(_common.segments(raw[a : a + size + 3 * _common.SEGMENT], np.array([0, min(size + 3 * _common.SEGMENT, len(raw) - a)]), _IS_WORD, size))[1]
            part = raw[a : a + b]
            starts = word_bounds(part, np.array([0, b]), _IS_WORD)[0]
            whole = len(starts) // PASSAGE * PASSAGE
            if whole or a + b >= len(raw):
                break
            size *= 2  # fewer words than a passage: look further
        end = b if a + b >= len(raw) or whole == len(starts) else int(starts[whole])
        x, pieces = _described(part[:end], np.array([0, end]))
        if len(starts):
            out.append(x)
        a += end
    x = np.concatenate(out) if out else np.zeros((1, WIDTH), np.float32)
    return x, np.array([len(x)])


def _described(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(off) - 1
    starts, ends, owner = word_bounds(raw, off, _IS_WORD)
    per = np.bincount(owner, minlength=n)
    pieces = np.maximum(-(-per // PASSAGE), 1)
    base = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    out = np.zeros((total, WIDTH), np.float32)
    if not len(starts):
        return out, pieces
    place = np.arange(len(starts)) - (np.cumsum(per) - per)[owner]
    of = base[owner] + place // PASSAGE
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    last = np.append(first[1:], len(of)) - 1
    ids, begin, stop = of[first], starts[first], ends[last]
    # shares of neighbouring byte classes
    mark = np.zeros(len(raw) + 1, np.int64)
    np.add.at(mark, begin, 1)
    np.add.at(mark, stop, -1)
    inside = np.flatnonzero(np.cumsum(mark[:-1]))
    which = ids[np.searchsorted(begin, inside, side="right") - 1]
    code = _CLASS[raw]
    after = np.append(code[1:], 0)
    pair = np.bincount(which * (N_CLASS * N_CLASS) + code[inside] * N_CLASS + after[inside], minlength=total * N_CLASS * N_CLASS).reshape(total, -1)
    size = np.maximum(pair.sum(1), 1)[:, None]
    out[:, : N_CLASS * N_CLASS] = np.sqrt(pair / size)
    # word statistics
    h = word_hashes(raw, starts, ends)
    count = np.bincount(of, minlength=total).astype(np.float64)
    some = np.maximum(count, 1)
    order = np.lexsort((h, of))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])])
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])])
    upper = (raw[starts] >= 65) & (raw[starts] <= 90)
    length = (ends - starts).astype(np.float64)
    stats = [np.log1p(count), np.bincount(of, length, total) / some, np.sqrt(np.bincount(of, length**2, total) / some), np.bincount(of[order], new, total) / some, np.bincount(of, same, total) / some, np.bincount(of, upper, total) / some]
    out[:, N_CLASS * N_CLASS :] = np.stack(stats, 1)
    return out, pieces


@dataclass
class Model:
    """Weights of the encoder, the gate and the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, pieces: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages; pieces: passages of each bag (at least one)."""
        w = self.weights
        first = np.cumsum(pieces) - pieces
        h = np.tanh(x @ w["encode"] + w["encode0"])
        p = np.tanh(h @ w["look"] + w["look0"])
        q = 1 / (1 + np.exp(-(h @ w["gate"] + w["gate0"])))
        s = (p * q) @ w["attend"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), pieces))
        a = e / np.repeat(np.add.reduceat(e, first), pieces)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "p": p, "q": q, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score0"], -30, 30)))}

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def scores(self, column: pa.Array) -> np.ndarray:
        x, pieces = passages(column)
        return self.forward(self.standard(x), pieces)["score"].astype(np.float64)


def gradient(model: Model, x: np.ndarray, pieces: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives of the mean cross-entropy of bags by every weight."""
    w, f, n = model.weights, model.forward(x, pieces), pieces
    start = np.cumsum(n) - n
    d = (f["score"] - y) / len(y)
    dz = np.repeat(d[:, None] * w["score"], n, axis=0)
    da = (f["h"] * dz).sum(1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, start), n))
    gated = ds[:, None] * w["attend"]
    dp = gated * f["q"] * (1 - f["p"] ** 2)
    dq = gated * f["p"] * f["q"] * (1 - f["q"])
    dh = (f["a"][:, None] * dz + dp @ w["look"].T + dq @ w["gate"].T) * (1 - f["h"] ** 2)
    return {"encode": x.T @ dh, "encode0": dh.sum(0), "look": f["h"].T @ dp, "look0": dp.sum(0), "gate": f["h"].T @ dq, "gate0": dq.sum(0), "attend": (f["p"] * f["q"]).T @ ds, "score": f["z"].T @ d, "score0": d.sum(keepdims=True)}


def fit(x: np.ndarray, pieces: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> Model:
    """Train on bags: passages end to end, passages per bag, and a label per bag. Without bags, every score is 1/2."""
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"encode": init(WIDTH, HIDDEN), "encode0": np.zeros(HIDDEN), "look": init(HIDDEN, GATE), "look0": np.zeros(GATE), "gate": init(HIDDEN, GATE), "gate0": np.zeros(GATE), "attend": init(GATE), "score": np.zeros(HIDDEN), "score0": np.zeros(1)}
    if not len(y):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), w)
    model = Model(x.mean(0), x.std(0) + 1e-3, w)
    x = model.standard(x)
    first = np.cumsum(pieces) - pieces
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            bags = order[at : at + batch]
            n = pieces[bags]
            rows = np.repeat(first[bags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            g = gradient(model, x[rows], n, y[bags])
            t += 1
            step = rate * (1 - epoch / epochs)
            for k, a in w.items():
                gk = g[k] + decay * a * (not k.endswith("0"))
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk**2
                a -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 on division by 3. A null id: not so."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on at most ``fit_docs`` labelled, not held-out documents.

    Several labels of one id count by their mean (1 from one half on); null labels and ids are left out. Of several
    texts with one id the least counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, pieces = passages(b.column("text"))
            ends = np.cumsum(pieces).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([x[f:e].astype(np.float16).tobytes() for f, e in zip([0, *ends], ends)], pa.binary())], names=["doc_id", "y", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    one = own.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "y", "text")
    rows = sorted(one.mapInArrow(run, "doc_id long, y int, x binary").collect(), key=lambda r: r.doc_id)  # at most fit_docs
    bags = [np.frombuffer(r.x, np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    if not bags:
        return fit(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0))
    return fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([float(r.y) for r in rows]))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score (higher: good likelier), predicted (score >= 0.5).

    Null and empty texts are scored as one empty passage; repeated rows are rows of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(model.scores(b.column("text")))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(model.scores(b.column("text")) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
