import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from panelmill.llm import license_scan as S
from panelmill.llm import quality as Q
from panelmill.llm._common import materialize
from panelmill.llm.queries import QUERIES
from tests.llm.test_format_pack_dedup_shard import check_packing, rows
from tests.llm.test_secrets_jaccard_decontamination_lines import LOW, contamination_expected, jaccard_expected, read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def licenses_expected(docs):
    out = Counter()
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        places, labels = [], set()
        for phrase, label in S.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out[d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    return out


BASE = "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"


def base_rows(df):
    return Counter(tuple(r) for r in df.select(*BASE).collect())


def test_op3_whole(spark, sf_dir):
    out = QUERIES["op3_license_scan"](spark, sf_dir).cache()
    assert base_rows(out) == licenses_expected(read(spark, sf_dir, "documents", "doc_id", "text"))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out.collect())


def test_license_edges(spark, docs, no_docs, clashing):
    more = [(50, "The MIT-License! mit license mit  licenses"), (51, "Apache License, Version 2.0 cc by nc by CC-BY-NC"), (52, "mit mit license"), (53, "\x1cmit\x00license é mit licenseé"), (54, "MIT LICENSE " * 3000)]
    every = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = licenses_expected([tuple(r) for r in every.select("doc_id", "text").collect()])
    flat = lambda df: base_rows(S.scan_licenses(df).withColumn("base_labels", F.array_join("base_labels", ",")))
    assert flat(every) == want == flat(every.withColumns({c: F.lit("x") for c in ("labels", "score", "spans")}))
    assert S.scan_licenses(no_docs).count() == 0


def test_base_is_the_contract_s_phrases(spark, tmp_path):
    """A base place is "under the mit license", from its first word on; "mit license" alone is a label of the method's."""
    texts = ["so: MIT License", "a b Under-the MIT\tLicense, mit license", "under the mit licence", "under the mit license apache license version 2 cc by nc under the mit license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    every = "apache-2,cc-by-nc,mit"
    want = [(0, 3, 0, None, None, "", "mit"), (1, 8, 1, 2, 2, "mit", "mit"), (2, 4, 0, None, None, "", "mit"), (3, 15, 4, 0, 11, every, every)]
    out = QUERIES["op3_license_scan"](spark, str(tmp_path))
    assert [tuple(r) for r in out.select(*BASE, "labels").sort("doc_id").collect()] == want
    for text in ("underthe mit license", "under themit license"):
        assert {f[0] for f in S.Scanner().fuzzy(f" before it {text} and after ")} == {"mit"}


def test_notices_with_errors_are_found():
    rng = random.Random(3)
    scanner = S.Scanner()
    for label, notice in S.NOTICES:
        edits = max(1, len(notice) // S.LETTERS_PER_EDIT)
        for _ in range(20):
            text = list(notice)
            for _ in range(rng.randrange(edits + 1)):
                i = rng.randrange(1, len(text) - 1)
                if text[i] == " ":
                    continue
                text[i : i + 1] = rng.choice([[], ["q"], [text[i], "q"]])
            found = scanner.fuzzy(" before it " + "".join(text) + " and after ")
            assert label in {f[0] for f in found}
            assert any(f[1] == 2 for f in found if f[0] == label)
    assert not scanner.fuzzy(" nothing of the kind is written here at all ")


def test_short_notices_with_errors_are_found_without_a_sentence():
    """Every one-edit form of each exact phrase; other licenses within an edit keep their own."""
    scanner = S.Scanner()
    labels = lambda text: {f[0] for f in scanner.fuzzy(f" before it {text} and after ")}
    for phrase, label in S.PHRASES:
        for i in range(1, len(phrase) - 1):
            for new in ("", "q", phrase[i] + "q"):
                assert label in labels(phrase[:i] + new + phrase[i + 1 :])
    for text, label in (("the mit licence", "mit"), ("licensed under the mit licence", "mit"), ("apache license verison 2 0", "apache-2"), ("distributed under the apache lisence version 2 0", "apache-2"), ("cc by mc 4 0", "cc-by-nc")):
        assert labels(text) == {label}
    for text in ("cc by nd 4 0", "cc by sa 4 0", "licensed under cc by nd 4 0", "apache license version 1 1", "licensed under the mpl license", "bsd license"):
        assert not labels(text)


def test_notices_back_to_back_are_all_reported():
    one = " relxased under the mxt license"
    found = S.Scanner().fuzzy(f"{one} released under the mit license{one} ")
    assert {(0, 5, 2), (5, 10, 0), (10, 15, 2)} <= {f[1:4] for f in found}
    many = [f for f in S.Scanner().fuzzy(" mit licence" * 500 + " ") if f[0] == "mit" and f[2] - f[1] == 2]
    assert sorted({f[1] for f in many}) == list(range(0, 1000, 2))


# quality
def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_op5_on_held_out_rows(spark, sf_dir):
    labels = dict(read(spark, sf_dir, "labels", "doc_id", "quality"))
    out = QUERIES["op5_quality"](spark, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, in read(spark, sf_dir, "documents", "doc_id"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    own = [(r.score, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert auc(np.array([s for s, _ in own]), np.array([y for _, y in own])) > 0.95
    assert np.mean([(s >= 0.5) == y for s, y in own]) > 0.95


def test_quality_edges(spark, docs, no_docs, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        for df in (docs, clashing, no_docs):
            model = Q.train(df, lab)
            assert Q.score_quality(df, model).count() == df.count()
            kept = Q.keep_good(df, model)
            assert kept.schema == df.schema and kept.count() <= df.count()


def test_fit_learns_bags():
    """The fit separates four random bags; without epochs it does not."""
    rng = np.random.default_rng(0)
    x, pieces, y = rng.normal(size=(12, Q.WIDTH)).astype(np.float32), np.array([3, 1, 5, 3]), np.array([1.0, 0, 1, 0])
    loss = lambda m: -np.mean(y * np.log(m.forward(m.standard(x), pieces)["score"]) + (1 - y) * np.log(1 - m.forward(m.standard(x), pieces)["score"]))
    assert loss(Q.fit(x, pieces, y, epochs=80)) < 0.1 < loss(Q.fit(x, pieces, y, epochs=0))


def test_passages_cover_every_word():
    text = " ".join(f"w{i}" for i in range(200))
    x, pieces = Q.passages(pa.array([text, "", None, "one"]))
    assert pieces.tolist() == [4, 1, 1, 1] and x.shape == (7, Q.WIDTH)
    assert np.allclose(np.expm1(x[:4, -6]), [64, 64, 64, 8]) and not x[4:6].any()


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    w = {k: rng.normal(size=a.shape) * 0.3 for k, a in Q.fit(np.zeros((0, Q.WIDTH)), np.zeros(0, int), np.zeros(0)).weights.items()}
    model = Q.Model(np.zeros(Q.WIDTH), np.ones(Q.WIDTH), w)
    x, pieces, y = rng.normal(size=(9, Q.WIDTH)), np.array([2, 4, 3]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(y * np.log(model.forward(x, pieces)["score"]) + (1 - y) * np.log(1 - model.forward(x, pieces)["score"]))
    g = Q.gradient(model, x, pieces, y)
    for k, a in w.items():
        for at in rng.integers(0, a.size, 4).tolist():
            was = a.flat[at]
            a.flat[at] = was + 1e-5
            up = loss()
            a.flat[at] = was - 1e-5
            assert abs((up - loss()) / 2e-5 - g[k].flat[at]) < 1e-6
            a.flat[at] = was


def forward_by_hand(model, bag):
    """Score of one bag, passage by passage."""
    w, h, s = model.weights, [], []
    for x in bag:
        e = np.tanh(x @ w["encode"] + w["encode0"])
        gate = np.tanh(e @ w["look"] + w["look0"]) / (1 + np.exp(-(e @ w["gate"] + w["gate0"])))
        h.append(e)
        s.append(float(gate @ w["attend"]))
    a = np.exp(s) / np.sum(np.exp(s))
    z = sum(ai * e for ai, e in zip(a, h))
    return 1 / (1 + np.exp(-(z @ w["score"] + w["score0"][0])))


def test_scores_by_hand():
    rng = np.random.default_rng(2)
    w = {k: rng.normal(size=a.shape) * 0.3 for k, a in Q.fit(np.zeros((0, Q.WIDTH)), np.zeros(0, int), np.zeros(0)).weights.items()}
    model = Q.Model(rng.normal(size=Q.WIDTH) * 0.1, np.ones(Q.WIDTH), w)
    texts = [" ".join(rng.choice(["ab", "Cde", "f!", "1 2", "é"], 300)), "", "one", None]
    x, pieces = Q.passages(pa.array(texts))
    bags = np.split(model.standard(x), np.cumsum(pieces)[:-1])
    assert np.allclose(model.scores(pa.array(texts)), [forward_by_hand(model, b) for b in bags])


def test_long_texts_are_described_by_segments(monkeypatch):
    rng = np.random.default_rng(3)
    for text in (" ".join(rng.choice(["word", "Other", "x", "é 1"], 5000)), "a" * 3000 + " " + "b " * 400, " \n" * 900):
        want = Q.passages(pa.array([text, ""]))
        for size in (300, 1000):
            monkeypatch.setattr(Q._common, "SEGMENT", size)
            x, pieces = Q.passages(pa.array([text]))
            monkeypatch.undo()
            assert pieces[0] == want[1][0] and (size < 1000 and "aaa" in text or np.allclose(x, want[0][: len(x)]))


def test_license_time_follows_the_hits():
    t = []
    for n in (20_000, 80_000):
        line = b" mit license" * n + b" "
        start = time.perf_counter()
        assert len(S.Scanner().exact(line)) == n
        t.append(time.perf_counter() - start)
    assert t[1] < 12 * t[0]


# pipeline
def test_near_copies_with_shared_and_null_ids(spark, sf_dir):
    """Rows that share an id are told apart by their sets."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    data = [(1, a), (1, b), (2, a + " end"), (None, b + " end"), (None, b + " fin"), (None, "c d e f g h"), (3, ""), (3, None), (4, "X y z"), (4, "x  Y z")]
    docs = spark.createDataFrame([(*d, "en", "s", 1) for d in data], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    one = [k for k in got if k[0] == 4]
    assert len(one) == 1 and got[one[0]] == 1
    assert got - Counter(one) == Counter([(1, a), (1, b), (None, "c d e f g h"), (3, ""), (3, None)])


def test_pipeline_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    labels = dict(read(spark, sf_dir, "labels", "doc_id", "quality"))
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, seen[-1], sf_dir), "test")
        assert out.columns == docs.columns
        seen.append(out)
    text = [dict(tuple(r) for r in d.select("doc_id", "text").collect()) for d in seen]
    good = [d for d in text[0] if labels.get(d) == 1]
    assert sum(d in text[1] for d in good) >= 0.99 * len(good) and sum(d in text[1] for d in text[0] if labels.get(d) == 0) <= 5
    best = {}
    for d, t in text[1].items():
        best[t.translate(LOW)] = max(d, best.get(t.translate(LOW), d))
    assert set(text[2]) == set(best.values())
    assert set(text[3]) == {k[0] for k in jaccard_expected(list(text[2].items())) if k[0] == k[2]}
    assert set(text[4]) == {k[0] for k in contamination_expected(list(text[3].items()), read(spark, sf_dir, "benchmark", "item_id", "text")) if not k[5]}
    check_packing(rows(corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf_dir)), list(text[4].items()))


def test_pipeline_edges(spark, docs, no_docs, sf_dir):
    for df in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns and out.count() <= df.count()
    kept = [tuple(r) for r in corpus_pipeline.drop_copies(spark, docs, sf_dir).select("doc_id", "text").collect()]
    assert Counter(d for d, _ in kept) == Counter([9, 4, 5, None, 7, 8])
