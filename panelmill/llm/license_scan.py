"""License scan: fuzzy search for short notices.

A notice of n letters may be up to k edits off. It is split into k + 1 seeds; by the pigeonhole principle one of them
stands unchanged wherever the notice does. An automaton finds all seeds of all notices in one pass; around each, the
regex library's bounded-error matching verifies the edits and places the span. Exact phrases are found beside it, and
their labels always stay.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from panelmill.llm._common import slices

#: Exact phrases of the contract, word by word, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Shortest forms of the same: the phrases of a scanner that is given none.
SHORT = (("mit license", "mit"), *PHRASES[1:])

#: Notices that are searched with errors: label, text. The exact phrases are among them, and their common framings.
NOTICES = (
    ("mit", "mit license"),
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "distributed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "released under the apache license version 2 0"),
    ("apache-2", "distributed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "released under cc by nc 4 0"),
    ("cc-by-nc", "distributed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("epl", "eclipse public license"),
    ("unlicense", "released into the public domain"),
    ("proprietary", "all rights reserved"),
)
LETTERS_PER_EDIT = 12
#: Words of other licenses, within the edits of a label's notices: a place with errors that holds them isn't the label's.
OTHERS = {"mit": ("mpl", "sil"), "apache-2": ("version 1",), "cc-by-nc": ("cc by nd",)}

#: Bytes of words stay (A-Z lower-cased); every other ASCII byte becomes a blank.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normalise(text: str) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def seeds(notice: str, edits: int) -> list[tuple[str, int]]:
    """``edits + 1`` pieces of near equal length, and where each stands."""
    n = len(notice)
    cuts = [i * n // (edits + 1) for i in range(edits + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class Scanner:
    """Finds phrases and notices in word sequences."""

    phrases: tuple[tuple[str, str], ...] = SHORT
    notices: tuple[tuple[str, str], ...] = NOTICES
    letters_per_edit: int = LETTERS_PER_EDIT

    @cached_property
    def search(self):
        import ahocorasick
        import regex

        automaton, patterns, places = ahocorasick.Automaton(), [], {}
        for i, (_, notice) in enumerate(self.notices):
            edits = max(1, len(notice) // self.letters_per_edit)
            patterns.append(regex.compile(rf"(?<![^ ])(?:{regex.escape(notice, special_only=True)}){{e<={edits}}}(?![^ ])", regex.BESTMATCH))
            for seed, at in seeds(notice, edits):
                places.setdefault(seed, []).append((i, at, edits))
        for seed, found in places.items():
            automaton.add_word(seed, (len(seed), found))
        automaton.make_automaton()
        return automaton, patterns

    def exact(self, line: bytes) -> list[tuple[str, int, int]]:
        """(label, first word, end word) of every place of every phrase; ``line``: the words, blank-joined and blank-led."""
        out = []
        for phrase, label in self.phrases:
            want, at, seen, first = b" " + phrase.encode() + b" ", -1, 0, 0
            while (at := line.find(want, at + 1)) >= 0:
                first += line.count(b" ", seen, at)  # words are counted on from the place before
                seen = at
                out.append((label, first, first + phrase.count(" ") + 1))
        return out

    def fuzzy(self, line: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, end word, edits, likeness) of the notices near a seed."""
        automaton, patterns = self.search
        starts: dict[int, set[tuple[int, int]]] = {}
        for end, (size, found) in automaton.iter(line):
            for i, at, edits in found:
                starts.setdefault(i, set()).add((max(0, end + 1 - size - at - edits), edits))
        out = []
        for i, own in starts.items():
            label, notice = self.notices[i]
            places, seen, words = set(), 0, 0
            for a, edits in sorted(own):  # each seed's own window, to its last blank: a place of the seed fits in
                m = patterns[i].search(line, a, line.rfind(" ", a, a + len(notice) + 2 * edits + 1) + 1)
                if m is None or any(f" {other} " in f" {m[0].strip(' ')} " for other in OTHERS.get(label, ())):
                    continue
                body = m[0].strip(" ")
                words += line.count(" ", seen, a)
                seen = a
                first = words + line.count(" ", a, m.start() + len(m[0]) - len(m[0].lstrip(" "))) - 1
                places.add((sum(m.fuzzy_counts), first, first + body.count(" ") + 1))
            taken: list[tuple[int, int, int]] = []
            for edits, first, end in sorted(places):  # of overlapping places the one of least edits
                k = bisect(taken, (first, end, edits))
                if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= end):
                    taken.insert(k, (first, end, edits))
            out += [(label, first, end, edits, max(0.0, 1 - edits / len(notice))) for first, end, edits in taken]
        return out


SPAN = "struct<label:string,first_word:long,end_word:long,edits:int>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<{SPAN}>"


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, labels, score and spans (see ``SCHEMA``).

    Words: runs of anything but ASCII non-alphanumerics, A-Z lower-cased, counted from 0. n_base counts all places of
    exact phrases (``PHRASES``, or those of ``scanner``); first_word and last_word are their least and greatest start
    (null without one). labels adds those of fuzzy notices; spans lists all. score: the best likeness (1 for an exact
    phrase, 0 without any). Null and empty texts have no words. Repeated rows are rows of their own; other columns are
    ignored.
    """
    scanner = scanner or Scanner(PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())]))]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in slices(batches, most=1_000_000):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = normalise(text or "")
                line = b" " + b" ".join(words) + b" " if words else b" "
                base = scanner.exact(line)
                near = scanner.fuzzy(line.decode("utf-8", "surrogatepass"))
                own = sorted({x[0] for x in base})
                starts = [x[1] for x in base]
                spans = list(dict.fromkeys([(*x, 0) for x in base] + [x[:4] for x in near]))
                score = 1.0 if base else max((x[4] for x in near), default=0.0)
                rows.append((doc, len(words), len(base), min(starts, default=None), max(starts, default=None), own, sorted({*own, *(x[0] for x in near)}), score, [dict(zip(("label", "first_word", "end_word", "edits"), s)) for s in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
