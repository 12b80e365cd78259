import hashlib
import json
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm import _common
from panelmill.llm import chat_format as C
from panelmill.llm import exact_dedup as D
from panelmill.llm import packing as P
from panelmill.llm import sharding as S
from panelmill.llm.queries import QUERIES, tokenizer_file

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return [r.asDict() for r in df.collect()]


# chat formatting
@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("user\\n\n<|_>"), st.text("<|\\>im_endstar\n a")), max_size=4))
def test_template_round_trip(turns):
    out = "".join(C.write_turn(*t)[0] for t in turns)
    assert C.read_turns(out) == turns


def test_layouts_meet_their_records(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        "conversations": {"id": 1, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        "instruction": {"instruction": "hi", "input": "", "output": "yo"},
        "prompt_response": {"prompt": "hi", "response": "yo"},
        "prompt_completion": {"system": None, "prompt": "hi", "completion": "yo"},
        "question_answer": {"question": "hi", "answer": "yo"},
        "nested_chat": {"chat": {"prompt": "hi", "reply": "yo"}},
    }
    data = [(n, json.dumps(r), "x") for n, r in records.items()] + [("odd", '{"what": 1}', "x"), ("null", None, "x"), ("broken", "{", "x"), ("none", '{"messages": []}', "x")]
    got = defaultdict(list)
    for r in C.canonical_turns(spark.createDataFrame(data, "name string, record string, role string")).collect():
        got[r.name].append((r.layout, r.part, r.role, r.text))
    for n in records:
        assert got[n] == [(n, 0, "user", "hi"), (n, 1, "assistant", "yo")]
    for n in ("odd", "null", "broken", "none"):
        assert got[n] == [(None, None, None, None)]


def chat_expected(convs):
    by = defaultdict(list)
    for c, t, r, x in convs:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_op1_whole(spark, sf_dir):
    convs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    say = "<|im_end|><|im_start|>assistant ok"
    convs += [(-1, 0, "user", say), (-1, 1, "assistant", say)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op1_chat_format"](spark, sf_dir).collect()}
    assert got == chat_expected(convs)


def test_chat_edges(spark):
    data = [(1, None, None, None, 5), (1, 0, "assistant", None, 5), (None, 1, "user", "x", 5), (2, 1, "assistant", "b" * 200_000, 5), (2, 1, "assistant", "a", 5), (2, 1, "assistant", "a", 5)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.chat_digests(df).collect()}
    assert got == chat_expected([d[:4] for d in data])
    assert C.chat_digests(df.limit(0)).count() == 0


# packing
def check_packing(got, docs, capacity=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cut = len(ids) % capacity or capacity
        at = [0, *range(cut, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    by = defaultdict(list)
    for g in got:
        by[g["sequence_id"]].append((g["offset"], g["length"]))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= capacity
    return len(by)


def test_op2_whole(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(QUERIES["op2_packing"](spark, sf_dir))
    n = check_packing(got, docs)
    assert n <= P.lower_bound(np.array([g["length"] for g in got])) * 1.01


def test_packing_edges(spark, docs, no_docs, clashing):
    want = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for df in (docs, clashing):
        check_packing(rows(P.pack_digests(df, tokenizer_file())), want)
    assert P.pack_digests(no_docs, tokenizer_file()).count() == 0
    whole = rows(P.pack_documents(docs, tokenizer_file()))
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", " \n", "\n ", "\u00a0", "\u2003", "\x1c", "a", "word", "it's", "don't", "42", "é", "𝔘", "!!", "<|endoftext|>", "\t", ".", "ß x", ",", "'", "x's", "***", "_", "²", "1st", "…", "~a"]), max_size=14))
def test_chunks_encode_as_the_whole(parts):
    from tokenizers import Tokenizer

    text = "".join(parts)
    encode = P.ChunkEncoder(tokenizer_file(), most=4)
    want = Tokenizer.from_file(tokenizer_file()).encode(text, add_special_tokens=False).ids
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode([text, text])] == [want, want]


def test_words_marks_and_line_feeds_are_learned_apart():
    from tokenizers import Tokenizer

    rng, marks = np.random.default_rng(3), ["", ".", ",", "***", ".\n", "\n", "!\n", "?\n\n", "\t", ".\u00a0", "\n.", "'s\n", "\r\n"]
    words = ["".join(rng.choice(list("abcdeéßØñжπ"), rng.integers(1, 9))) for _ in range(3000)]
    texts = [" ".join(a + marks[m] + b for a, b, m in zip(words[k:], words[k + 1 :], rng.integers(0, len(marks), 3000))) for k in range(3)]
    tok = Tokenizer.from_file(tokenizer_file())
    encode = P.ChunkEncoder(tokenizer_file())
    for t in (texts, [t + " " for t in texts], ["\n" + t for t in texts]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(t)] == [tok.encode(x, add_special_tokens=False).ids for x in t]
    encode, asked = P.ChunkEncoder(tokenizer_file()), []

    class Asked:  # counts what the pattern is run on
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return self.tok.encode_batch_fast(texts, **more)

    encode.tok = Asked(encode.tok)
    text = " ".join(f"{a}.\n{b}, {b}\n{a}" for a, b in zip(words, words[1:]) if a.isalpha() and b.isalpha())
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert sum(map(len, asked)) < 100 < len(text) // 100


def test_rounds_exchange_between_parts(spark):
    sizes = [(i, 100 + (i * 7919) % 900) for i in range(4000)]
    out = rows(P.pack(spark.createDataFrame(sizes, "pid long, length long"), rows_per_part=500))
    used = defaultdict(int)
    for r in out:
        used[r["sequence_id"]] += dict(sizes)[r["pid"]]
    assert len(out) == 4000 and max(used.values()) <= 1024
    assert len(used) <= P.lower_bound(np.array([n for _, n in sizes])) * 1.02


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=60))
def test_bound_holds(sizes):
    x = np.array(sizes, np.int64)
    bins, offsets = P.best_fit_decreasing(x)
    n = len(set(bins.tolist()))
    assert P.lower_bound(x) <= n and (not sizes or -(-sum(sizes) // 1024) <= P.lower_bound(x))


# exact dedup
def dedup_expected(docs):
    by = defaultdict(list)
    for d, t in docs:
        by[(t or "").translate(LOW)].append(d)
    out = Counter()
    for t, ids in by.items():
        some = [i for i in ids if i is not None]
        keep = max(some) if some else None
        stays = 0
        for i in ids:
            kept = i == keep and not stays
            stays += kept
            out[i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def dedup_got(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_op7_whole(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert dedup_got(QUERIES["op7_exact_dedup"](spark, sf_dir)) == dedup_expected(docs)


def test_dedup_edges(spark, docs, no_docs, clashing):
    want = dedup_expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert dedup_got(D.exact_dedup(docs)) == want == dedup_got(D.exact_dedup(clashing))
    assert D.exact_dedup(no_docs).count() == 0


def test_a_collision_is_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA")], "doc_id long, text string")
    keys = [tuple(r) for r in df.mapInArrow(D._prints, "doc_id long, fp1 long, fp2 long, n_bytes long, text_sha256 string").select("fp1", "fp2", "n_bytes").distinct().collect()]
    monkeypatch.setattr(D, "collisions", lambda docs, _: spark.createDataFrame(keys, "fp1 long, fp2 long, n_bytes long"))
    assert dedup_got(D.exact_dedup(df)) == dedup_expected([(1, "aa"), (2, "bb"), (3, "AA")])


def test_differing_chunks_are_found(spark):
    df = spark.createDataFrame([("aa",), ("AA",), ("bb",)], "text string")
    keys = df.selectExpr("0L doc_id", "text").mapInArrow(D._prints, "doc_id long, fp1 long, fp2 long, n_bytes long, text_sha256 string").select("fp1", "fp2", "n_bytes").distinct()
    assert D.collisions(df, keys).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 20_000])
def test_prints_compose(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    for cut in {0, n // 3, n}:
        for f in range(2):
            ends = [int(D.fingerprints(x, np.array([0, len(x)]))[f][0]) for x in (raw[:cut], raw[cut:], raw)]
            assert D.combine(f, ends[0], ends[1], n - cut) == ends[2]


def test_long_prints(monkeypatch):
    raw = np.random.default_rng(3).integers(0, 256, 50_000, dtype=np.uint8)
    want = [int(x[0]) for x in D.fingerprints(raw, np.array([0, len(raw)]))]
    monkeypatch.setattr(D, "SEGMENT", 7000)
    assert D.fingerprint_long(raw) == want


# sharding
def check_shards(got, docs, shards=8):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == want
    slots, home, load = defaultdict(list), defaultdict(set), Counter()
    for g in got:
        slots[g["shard"]].append(g["slot"])
        home[g["text_crc32"], g["size"]].add(g["shard"])
        load[g["shard"]] += g["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in home.values()) and set(slots) <= set(range(shards))
    return load


def test_op8_whole(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    load = check_shards(rows(QUERIES["op8_sharding"](spark, sf_dir)), docs)
    assert max(load.values()) <= 1.01 * min(load.values())


def test_sharding_edges(spark, docs, no_docs, clashing):
    want = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for df in (docs, clashing):
        check_shards(rows(S.shard_documents(df, rows_per_bucket=1)), want)
    assert S.shard_documents(no_docs).count() == 0


def test_broken_and_odd_records(spark):
    """Deep nesting, unpaired surrogates, keys with dots, and lists whose elements lack fields."""
    records = [
        "[" * 100_000,
        '{"a":' * 50_000,
        r'{"prompt": "x\ud800y", "response": "\ud83d\ude00"}',
        '{"chat": {}, "chat.prompt": "hello", "chat.reply": "yo"}',
        '{"messages": [{"role": "user"}, {"content": "x"}]}',
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        '{"chat": {"prompt": "p", "reply": "r"}}',
        None,
    ]
    df = spark.createDataFrame(list(enumerate(records)), "i int, record string")
    got = {i: [(r.layout, r.role, r.text) for r in rs] for i, rs in groupby(sorted(C.canonical_turns(df).collect(), key=lambda r: (r.i, r.part or 0)), lambda r: r.i)}
    none = [(None, None, None)]
    assert [got[i] for i in (0, 1, 3, 4, 7)] == [none] * 5
    assert got[2] == [("prompt_response", "user", "x\ufffdy"), ("prompt_response", "assistant", "\U0001f600")]
    assert got[5] == [("messages", "user", "q"), ("messages", "assistant", "a")] and got[6] == [("nested_chat", "user", "p"), ("nested_chat", "assistant", "r")]


def test_parts_are_certified(spark):
    """The certificate counts every sequence once, bounds hold, and exchange between parts doesn't cost sequences."""
    rng = np.random.default_rng(9)
    sizes = [(i, int(n)) for i, n in enumerate(rng.choice([700, 400, 333, 350, 1024, 60], 4000))]
    df = spark.createDataFrame(sizes, "pid long, length long")
    got = rows(P.pack(df, rows_per_part=300))
    parts, used = {}, defaultdict(set)
    for g in got:
        used[g["part"]].add(g["sequence_id"])
        parts[g["part"]] = g["part_sequences"], g["part_bound"]
    lengths = dict(sizes)
    for part, (n, bound) in parts.items():
        own = np.array([lengths[g["pid"]] for g in got if g["part"] == part])
        assert (n == len(used[part]) if part >= 0 else (n, bound) == (1, 1)) and bound <= len(used[part])
        assert part < 0 or bound <= P.lower_bound(own) <= n
    total = len({g["sequence_id"] for g in got})
    alone = sum(int(P.best_fit_decreasing(np.array([n for i, n in sizes if n < 1024 and i % 13 == k]))[0].max()) + 1 for k in range(13))
    assert total - sum(n == 1024 for _, n in sizes) <= alone


def test_dedup_with_hot_groups(spark, monkeypatch):
    """Hot groups joined by broadcast, others merged, and a filter that lets through what has no partner."""
    monkeypatch.setattr(_common, "HOT", 4)
    monkeypatch.setattr(_common.may_match, "__defaults__", (64, False))
    data = [(i, "Hot text" if i % 2 else f"text {i % 50}") for i in range(200)] + [(900 + i, f"own {i}") for i in range(40)]
    assert dedup_got(D.exact_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(3))) == dedup_expected(data)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=50), st.integers(1, 9))
def test_longest_first_is_near_even(sizes, shards):
    load = [0] * shards
    for n, s in zip(sizes, S.schedule(sizes, shards)):
        load[s] += n
    assert max(load) <= sum(sizes) / shards + max(sizes, default=0)
