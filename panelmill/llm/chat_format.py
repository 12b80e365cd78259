"""Chat formatting by schema fingerprints.

Every record (a JSON object) is reduced to the set of its nested field paths; the hash of that set picks a
declarative mapping from a registry, and the mapping turns the record into canonical (role, text) turns. Turns are
then written in one template whose control strings cannot occur inside a text: a control string's ``<|`` gets a
backslash put in (``<\\|``, one more where there are some), which reading back takes out again.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns.

    ``turns`` lists (role, path) pairs for fixed fields; a role that begins with ``$`` is itself read at that path.
    With ``each``, the paths are read in every element of the list there. ``roles`` renames roles. Fields in
    ``optional`` may be absent; ``ignored`` ones may be present.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    optional: frozenset[str] = frozenset()
    ignored: frozenset[str] = frozenset()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def shapes(self) -> Iterator[frozenset[str]]:
        """Every set of paths that this layout reads."""
        base = {self.each, f"{self.each}[]"} if self.each else set()
        for role, path in self.turns:
            base |= {f"{self.each}[].{p}" if self.each else p for p in (path, role[1:] if role[0] == "$" else path)}
        nested = {p.rpartition(".")[0] for p in base if "." in p}
        base |= {p for p in nested if p and not p.endswith("[]")}
        free = sorted(self.optional | self.ignored)
        for extra in chain.from_iterable(combinations(free, n) for n in range(len(free) + 1)):
            yield frozenset(base - self.optional) | frozenset(extra)


SHARE_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}
LAYOUTS = (
    Layout("turn_row", (("$role", "text"),)),
    Layout("turn_row_content", (("$role", "content"),)),
    Layout("messages", (("$role", "content"),), each="messages", ignored=frozenset({"id", "source"})),
    Layout("messages_text", (("$role", "text"),), each="messages", ignored=frozenset({"id", "source"})),
    Layout("conversations", (("$from", "value"),), each="conversations", roles=SHARE_ROLES, ignored=frozenset({"id", "source"})),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=frozenset({"system", "input"})),
    Layout("instruction_response", (("system", "system"), ("user", "instruction"), ("user", "context"), ("assistant", "response")), optional=frozenset({"system", "context"}), ignored=frozenset({"category"})),
    Layout("prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=frozenset({"system"})),
    Layout("prompt_completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=frozenset({"system"})),
    Layout("question_answer", (("user", "question"), ("assistant", "answer")), ignored=frozenset({"id"})),
    Layout("nested_chat", (("user", "chat.prompt"), ("assistant", "chat.reply"))),
)


_MARK = re.compile(r"[.\[\]\\]")
_HALF = re.compile("[\ud800-\udfff]")


def field_paths(value: object, at: str = "") -> frozenset[str]:
    """All nested field paths of a parsed record; ``[]`` stands for the elements of a list.

    Marks that join paths are escaped in keys, so that a key ``a.b`` is no ``b`` within ``a``.
    """
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            name = _MARK.sub(r"\\\g<0>", str(k))
            path = f"{at}.{name}" if at else name
            out.add(path)
            out |= field_paths(v, path)
    elif isinstance(value, list):
        out.add(f"{at}[]")
        for v in value:
            out |= field_paths(v, f"{at}[]")
    return frozenset(out)


def fingerprint(paths: frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprint to layout; of layouts with a shape in common the first holds."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for shape in layout.shapes():
            out.setdefault(fingerprint(shape), layout)
    return out


def _text(value: object) -> str:
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _HALF.sub("\ufffd", text)


def _at(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def to_turns(record: object, layout: Layout) -> list[tuple[str, str]]:
    """Canonical turns of one record; optional fields that are absent or empty give none.

    The fingerprint joins the fields of all elements of a list; an element that lacks one of its own makes the record
    one without a layout (no turns).
    """
    out = []
    due = {path.split(".")[0] for role, path in layout.turns if path not in layout.optional} | {role[1:].split(".")[0] for role, _ in layout.turns if role[0] == "$"}
    for item in _at(record, layout.each) or [] if layout.each else [record]:
        if not isinstance(item, dict) or not due <= item.keys():
            return []
        for role, path in layout.turns:
            text = _text(_at(item, path))
            if not text and path in layout.optional:
                continue
            name = _text(_at(item, role[1:])) if role[0] == "$" else role
            out.append((layout.roles.get(name, name), text))
    return out


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """One row per turn: every other column of ``records``, then fingerprint, layout, part, role, text.

    A record without a registered fingerprint, or a null, empty, broken or too deeply nested one, gives one row with null
    layout, part, role and text (its fingerprint shows which shape is missing); a record whose list is empty, or has an
    element without a field that the layout needs, gives one such row too. Unpaired surrogates become U+FFFD.
    Columns named like the new ones are replaced. Repeated records give repeated turns.
    """
    new = ["fingerprint", "layout", "part", "role", "text"]
    keep = [c for c in records.columns if c not in (record, *new)]
    schema = T.StructType([*(records.schema[c] for c in keep), *(T.StructField(n, T.LongType() if n == "part" else T.StringType()) for n in new)])
    known = registry(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: dict[frozenset[str], str] = {}
        for batch in batches:
            rows: list[tuple] = []
            take: list[int] = []
            for i, raw in enumerate(batch.column(record).to_pylist()):
                try:
                    value = json.loads(raw) if raw else None
                    paths = field_paths(value)
                except (ValueError, RecursionError):  # broken, or nested too deeply
                    value, paths = None, frozenset()
                mark = prints.get(paths)
                if mark is None:
                    mark = prints[paths] = fingerprint(paths)
                layout = known.get(mark)
                turns = to_turns(value, layout) if layout else []
                for part, (role, text) in enumerate(turns):
                    rows.append((mark, layout.name, part, role, text))
                if not turns:
                    rows.append((mark, None, None, None, None))
                take += [i] * max(len(turns), 1)
            kept = batch.select(keep).take(pa.array(take, pa.int64())) if keep else None
            made = [pa.array([r[k] for r in rows], pa.int64() if n == "part" else pa.string()) for k, n in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*(kept.columns if kept else []), *made], names=[*keep, *new])

    return records.select(*keep, record).mapInArrow(run, schema)


_GUARD = re.compile(r"<(\\*)\|")
_GUARDED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def write_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn in the template, and where its text (escaped) begins and ends in it."""
    head = f"{START}{escape_role(role or '')}\n"
    body = escape(text or "")
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a formatted string."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_turns(turns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Formatted segments: (key, the order columns, role, text, formatted, loss_start, loss_end), one per turn.

    A conversation's formatted text is its segments in order, end to end; the loss mask covers code points
    [loss_start, loss_end) of a segment: an assistant's text, nothing for other roles. Null role or text: empty.
    Segments, not whole conversations, so that one endless conversation never has to fit into one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            made = [write_turn(r, t) for r, t in zip(roles, texts)]
            trained = [r == "assistant" for r in roles]
            out = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] if t else 0 for m, t in zip(made, trained)], pa.int64()), pa.array([m[2] if t else 0 for m, t in zip(made, trained)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "formatted", "loss_start", "loss_end"])

    cols = list(dict.fromkeys([key, *order, "role", "text"]))
    picked = turns.select(*cols)
    schema = T.StructType([*picked.schema.fields, T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])
    return picked.mapInArrow(run, schema)


def digests(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key, read back from the formatted segments alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments of a key are sorted on disk if need be and digested as a stream: memory doesn't grow with a key's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> None:
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for k, formatted, a, b in zip(*(batch.column(c).to_pylist() for c in (key, "formatted", "loss_start", "loss_end"))):
                if state is None or k != now:
                    close()
                    now, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(formatted[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if len(done) >= 1000:
                yield flush()
        close()
        if done:
            yield flush()

    dealt = segments.repartition(F.col(key)).sortWithinPartitions(key, *order)
    return dealt.select(key, "formatted", "loss_start", "loss_end").mapInArrow(run, f"{key} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Digests of conversations stored by turn (conv_id, turn, role, text); see ``digests``.

    Rows of a conversation go by turn, then role and text (rows that tie in all are alike); null turns come first and
    null conv_ids form one conversation. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", F.to_json(F.struct(role.alias("role"), text.alias("text"))).alias("record"))
    order = ["turn", "role", "text"]
    return digests(format_turns(canonical_turns(rows), "conv_id", order), "conv_id", order)
