"""Chat records of several layouts as canonical turns, formatted with a reversible template."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

# Control strings of the template. Inside roles and texts a backslash splits them.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def field_paths(value, at: str = "") -> set[str]:
    """The nested field names of a record with their kinds; a list's items share one path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}") for k, v in value.items())) if value else {f"{at}:object"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(record) -> str:
    """A hash of the record's field paths: records of one layout have one fingerprint."""
    return hashlib.sha256("\n".join(sorted(field_paths(record))).encode()).hexdigest()[:16]


def layout(*examples, turns: list | str, role: str | None = None, text: str | None = None) -> dict:
    """A mapping for the layouts of the examples.

    ``turns`` names a list field, whose items have ``role`` and ``text`` fields, or lists
    (role, field) for records with a field per turn.
    """
    return {fingerprint(x): {"turns": turns, "role": role, "text": text} for x in examples}


ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = {
    **layout({"messages": [{"role": "", "content": ""}]}, {"messages": []}, turns="messages", role="role", text="content"),
    **layout({"conversations": [{"from": "", "value": ""}]}, {"conversations": []}, turns="conversations", role="from", text="value"),
    **layout({"prompt": "", "completion": ""}, turns=[("user", "prompt"), ("assistant", "completion")]),
    **layout({"prompt": "", "response": ""}, turns=[("user", "prompt"), ("assistant", "response")]),
    **layout({"instruction": "", "output": ""}, turns=[("user", "instruction"), ("assistant", "output")]),
    **layout({"instruction": "", "input": "", "output": ""}, turns=[("user", "instruction"), ("user", "input"), ("assistant", "output")]),
    **layout({"system": "", "instruction": "", "output": ""}, turns=[("system", "system"), ("user", "instruction"), ("assistant", "output")]),
}


def canonical_turns(record, layouts: dict) -> list[tuple[str, str]] | None:
    """(role, text) of each turn, or None for a layout that no mapping knows."""
    how = layouts.get(fingerprint(record))
    if how is None:
        return None
    if isinstance(how["turns"], str):
        pairs = [(x.get(how["role"]), x.get(how["text"])) for x in record[how["turns"]]]
    else:
        pairs = [(role, record[f]) for role, f in how["turns"]]
        pairs = [(r, t) for r, t in pairs if (r, t) != ("user", "") or len(pairs) < 3]  # an empty extra input
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    return [(ROLE_NAMES.get(text(r), text(r)), text(t)) for r, t in pairs]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the (start, end) spans of assistant texts that carry loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
        out.append(f"{head}{body}</s>")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


CHATS = "chat_id bigint, layout string, formatted string, loss_spans array<array<bigint>>"


def format_chats(records: DataFrame, layouts: dict = LAYOUTS) -> DataFrame:
    """Convert chat records of any known layout to formatted texts with a loss mask.

    The reference has no chat records, so this is general: ``records`` has ``chat_id`` and
    ``record``, the record as JSON; other columns are not read. The sorted nested field paths
    of a record are hashed; the hash selects a declarative mapping from ``layouts`` (message
    lists, from/value lists, prompt or instruction pairs) to canonical turns. Each turn is
    ``<s>[INST]role[/INST]text</s>``; control strings inside roles and texts are split by a
    backslash, and backslashes doubled, so ``parse`` gives back every text. A record
    is one row and is formatted alone, without a shuffle.

    Result, a row per record: ``chat_id``, ``layout`` (the fingerprint), ``formatted``,
    ``loss_spans`` ([start, end) of each assistant text, in code points). A null, broken or unknown
    record gives null ``formatted``; null texts are empty; no turns give an empty text; null ids
    and repeated rows are kept; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                turns = canonical_turns(record, layouts) if isinstance(record, dict) else None
                done = (None, None) if turns is None else render(turns)
                out.append((fingerprint(record) if record is not None else None, done[0], done[1] and [list(x) for x in done[1]] if done[1] is not None else None))
            marks, texts, spans = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.string()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["chat_id", "layout", "formatted", "loss_spans"],
            )

    rows = records.select(F.col("chat_id").cast("bigint"), F.col("record").cast("string"))
    return stage(rows.mapInArrow(run, CHATS), "chats")


def read_chats(chats: DataFrame) -> DataFrame:
    """What formatted texts hold: ``chat_id``, ``turns`` (role, text), ``loss`` (the unescaped text under the mask), ``formatted_chars``."""
    fields = "chat_id bigint, turns array<struct<role: string, text: string>>, loss string, formatted_chars bigint"

    def run(batches):
        for batch in batches:
            turns, loss, chars = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns.append(None if text is None else [{"role": r, "text": t} for r, t in parse(text)])
                loss.append(None if text is None else "".join(unescape(text[a:b]) for a, b in spans))
                chars.append(None if text is None else len(text))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], [x for x in ("chat_id", "turns", "loss", "formatted_chars")])

    return chats.select("chat_id", "formatted", "loss_spans").mapInArrow(run, fields)
