"""Secret scan: fixed patterns, and a battery of randomness tests, in DataFrame operations only.

Long tokens are given an inferred encoding (hex, base32, base36, base62/64) and tested against the hypothesis that their
symbols are random: chi-squared uniformity over the encoding's alphabet, a runs test about the alphabet's middle, and
lag-one serial correlation. The least of the three p-values is the token's. Tokens of like length form a stratum. In each,
two rates are controlled: the Benjamini-Hochberg rule dismisses tokens as not random, so that at most the stated share
of those dismissed is expected to be random after all; and of what is reported as ``random`` spans at most that share
may be ordinary, by a two-group estimate: random tokens have a known distribution of the least p-value, its level is read
off the large p-values, and what the reported tokens exceed it by counts as ordinary. The estimate cannot see ordinary
tokens whose p-values are spread like random ones, as short names' are; the README states measured rates by length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm._common import materialize

#: Fixed patterns, in the order that ties of a start go by; kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}+", 0, 32),
)
TOKEN = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Parts of a run that fits no encoding: long ones between all of /+-_, else shorter ones joined by -_ only or by /+ only.
_SHORT = "[A-Za-z0-9]{1,19}+(?![A-Za-z0-9])"
PARTS = rf"[A-Za-z0-9]{{20,}}+|(?=[A-Za-z0-9_-]{{20}})(?:{_SHORT}|[_-])++|(?=[A-Za-z0-9+/]{{20}})(?:{_SHORT}|[+/])++"
LEAST = 20
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding, pattern of its tokens (without padding), alphabet; the first that fits holds. A token needs a digit and a letter.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + SMALL[:6]),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + LARGE[:6]),
    ("base32", "^[A-Z2-7]+$", LARGE + "234567"),
    ("base36", "^[a-z0-9]+$", DIGITS + SMALL),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + LARGE + SMALL),
    ("base64", "^[A-Za-z0-9+/]+$", LARGE + SMALL + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", LARGE + SMALL + DIGITS + "-_"),
)
BINS_PER_DECADE, BINS = 20, 240


#: Matches of a text are folded in runs of this many, so that time follows the matches, not their square.
RUN = 256


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _located(text: Column, pattern: str) -> Column:
    """(start, end, body) of every match, leftmost and non-overlapping; body is the match."""
    empty = F.array().cast("array<struct<start:int,end:int,body:string>>")

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["body"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), s["body"].alias("body")))).alias("out"))

    def located(p: Column) -> Column:
        gaps = F.transform(F.slice(p["gap"], F.lit(1), F.size(p["body"])), F.length)
        sizes = F.zip_with(gaps, p["body"], lambda g, w: F.struct(g.alias("gap"), w.alias("body")))
        return _let(sizes, lambda s: _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / RUN).cast("int")), lambda i: F.slice(s, i * RUN + 1, RUN)), placed))

    def placed(runs: Column) -> Column:
        total = lambda run: F.aggregate(run, F.lit(0), lambda n, s: n + s["gap"] + F.length(s["body"]))
        starts = F.aggregate(runs, F.array(F.lit(0)), lambda acc, run: F.concat(acc, F.array(F.element_at(acc, -1) + total(run))))
        own = lambda run, at: F.aggregate(run, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        return _let(starts, lambda at: F.flatten(F.zip_with(runs, F.slice(at, F.lit(1), F.size(runs)), own)))

    parts = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("body"))
    return F.when(text.rlike(pattern), _let(parts, located)).otherwise(empty)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational-exponential fit of erfc (error under 2e-7)."""
    a = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * F.lit(1.061405429)))))
    half = poly * F.exp(-a * a) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def randomness(token: Column, alphabet: Column) -> Column:
    """The least of three p-values of a token (without padding) under the hypothesis that its symbols are random.

    The chi-squared statistic is a linear function of the pairs of equal symbols; its tail is that of a shifted gamma
    law with the exact mean, variance and third moment of the number of such pairs, which holds for sparse counts too
    (20 symbols over 64 cells). Runs and serial correlation go by their normal limits.
    """

    def stats(t: Column) -> Column:
        n = F.length(t["token"]).cast("double")
        k = F.length(t["alphabet"]).cast("double")
        counts = F.transform(F.filter(F.split(t["alphabet"], ""), lambda s: s != ""), lambda s: F.length(t["token"]) - F.length(F.replace(t["token"], s, F.lit(""))))
        pairs = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * (c - 1) / 2)
        every = n * (n - 1) / 2
        p = 1 / k
        spread = F.sqrt(every * p * (1 - p))
        third = every * p * (1 - p) * (1 - 2 * p) + n * (n - 1) * (n - 2) * (p * p - p * p * p)
        shape = 4 / F.pow(third / F.pow(spread, F.lit(3.0)), F.lit(2.0))
        gamma = F.greatest((shape + (pairs - every * p) / spread * F.sqrt(shape)) / shape, F.lit(1e-9))
        uneven = (F.pow(gamma, F.lit(1 / 3)) - (1 - 1 / (9 * shape))) * 3 * F.sqrt(shape)
        x = t["codes"]
        mean = F.aggregate(x, F.lit(0.0), lambda a, c: a + c) / n
        around = F.aggregate(x, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
        ahead = F.slice(x, F.lit(2), F.size(x) - 1)
        lag = F.aggregate(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), ahead, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, c: a + c)
        serial = F.when(around > 0, (lag / F.when(around > 0, around) + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        high = F.aggregate(x, F.lit(0.0), lambda a, c: a + F.when(c * 2 >= k, 1.0).otherwise(0.0))
        turns = F.aggregate(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), ahead, lambda a, b: F.when((a * 2 >= k) != (b * 2 >= k), 1.0).otherwise(0.0)), F.lit(1.0), lambda a, c: a + c)
        mu = 1 + 2 * high * (n - high) / n
        var = (mu - 1) * (mu - 2) / (n - 1)
        runs = F.when(var > 0, (turns - mu) / F.sqrt(F.when(var > 0, var))).otherwise(F.lit(99.0))
        two = lambda z: F.least(2 * _upper_tail(F.abs(z)), F.lit(1.0))
        return F.least(_upper_tail(uneven), two(runs), two(serial))

    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
    return F.transform(F.array(F.struct(token.alias("token"), alphabet.alias("alphabet"), codes.alias("codes"))), stats)[0]


def _alphabet(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for _, pattern, letters in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(letters)).otherwise(out)
    return F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), out)


def _candidates(text: Column) -> Column:
    """(start, end, stratum, bin) of long tokens with an encoding; bin: of the p-value, on a logarithmic scale.

    A run with / or + beside - or _ fits none; its parts (see ``PARTS``) of ``LEAST`` characters or more are tokens.
    """
    runs = F.transform(_located(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.rtrim(F.replace(s["body"], F.lit("="), F.lit(" "))).alias("token")))

    def split(s: Column) -> Column:
        inner = F.filter(_located(s["token"], PARTS), lambda p: p["end"] - p["start"] >= LEAST)
        size = F.length(s["token"])  # padding stays with the last part
        parts = F.transform(inner, lambda p: F.struct((s["start"] + p["start"]).alias("start"), F.when(p["end"] == size, s["end"]).otherwise(s["start"] + p["end"]).alias("end"), p["body"].alias("token")))
        return F.when(s["token"].rlike("[+/]") & s["token"].rlike("[_-]"), parts).otherwise(F.array(s))

    found = F.flatten(F.transform(runs, split))
    coded = F.filter(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), _alphabet(s["token"]).alias("alphabet"))), lambda s: s["alphabet"].isNotNull())

    def tested(s: Column) -> Column:
        p = randomness(s["token"], s["alphabet"])
        level = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-12))) * BINS_PER_DECADE), F.lit(BINS))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.floor(F.log2(F.length(s["token"]))).cast("int").alias("stratum"), level.cast("int").alias("bin"))

    return F.transform(coded, tested)


def _beyond(p: float) -> float:
    """Share of random tokens whose least of three independent p-values is over ``p``."""
    return (1 - p) ** 3


def reported_below(counts: dict[int, int], share: float) -> int:
    """The bin below which a stratum's tokens are reported, from its tokens per bin (bin b: p-values of about 10^(-b / 20)).

    First Benjamini-Hochberg on the combined p-value 1 - (1 - p)^3, against wrong dismissals. Then, from there on towards
    larger p-values, the first bin where the tokens reported exceed the random ones among them by no more than ``share``
    of all, beyond two standard errors; the random ones are known from those with p over 0.2.
    """
    bins = [counts.get(b, 0) for b in range(BINS + 1)]
    edge = lambda b: 10 ** (-b / BINS_PER_DECADE)
    m, over, cut = sum(bins), 0, BINS + 1
    for b in range(BINS, -1, -1):
        over += bins[b]
        if bins[b] and 1 - _beyond(edge(b)) <= over * share / m:
            cut = b
    flat = next(b for b in range(BINS) if edge(b) <= 0.2)
    random = sum(bins[:flat]) / _beyond(edge(flat))
    for b in range(cut, flat, -1):
        found = sum(bins[:b])
        ordinary = found - random * _beyond(edge(min(b, BINS))) - 2 * found**0.5
        if ordinary <= share * found:
            return b
    return min(cut, flat)


def cuts(scanned: DataFrame, share: float) -> dict[int, int]:
    """``reported_below`` of each stratum; at most 32 strata of 241 bins reach the driver."""
    by: dict[int, dict[int, int]] = {}
    for r in scanned.select(F.inline("candidates")).groupBy("stratum", "bin").count().collect():
        by.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    return {stratum: reported_below(counts, share) for stratum, counts in by.items()}


def _base_spans(text: Column, kind_no: int) -> Column:
    _, pattern, group, least = BASE[kind_no]
    body = lambda s: F.regexp_extract(s["body"], pattern, group) if group else s["body"]
    long_enough = F.filter(_located(text, pattern), lambda s: F.length(body(s)) >= least)
    return F.transform(long_enough, lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end")))


def scan_secrets(docs: DataFrame, share: float = 0.05) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_spans, found.

    ``base_spans`` and ``found`` list (start, kind_no, end) by start, then kind: code points, end exclusive, kinds 0 to 2
    as in ``BASE`` and 3 for ``random``. Base spans of one kind are leftmost and non-overlapping before those that are
    too short go; ``random`` ones that overlap a base span are left out of ``found``. Null or empty text: none.
    ``share`` bounds, per stratum of length, the expected share of random tokens among those dismissed and of ordinary
    ones among those reported. Repeated rows are rows of their own, and count as tokens of their own; other columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = [_base_spans(text, k).alias(kind) for k, (kind, *_) in enumerate(BASE)]
    scanned = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *base, _candidates(text).alias("candidates")), "spans")
    cut = cuts(scanned, share)
    limit = lambda s: F.coalesce(F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])[s] if cut else F.lit(None).cast("int"), F.lit(0))
    rows = scanned.withColumn("base_spans", F.array_sort(F.concat(*(kind for kind, *_ in BASE))))
    clear = lambda c: ~F.exists("base_spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    more = F.transform(F.filter("candidates", lambda c: (c["bin"] < limit(c["stratum"])) & clear(c)), lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("kind_no"), c["end"].alias("end")))
    return rows.select("doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE), "base_spans", F.array_sort(F.concat("base_spans", more)).alias("found"))


def span_text(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k, *_ in BASE), F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind_no"]], s["start"], s["end"])), ",")
