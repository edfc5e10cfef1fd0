"""Chat formatting from event logs.

A log is folded by conversation in the order of its sequence numbers: ``message`` (or a null kind)
adds a whole turn; ``delta`` adds text to the turn it names, and begins it if it is new; ``edit``
replaces the text of its turn; ``regenerate`` empties its turn and takes back the later ones, and
deltas or an edit fill it again. The final messages are rendered by a template:

    <turn ROLE>\\nTEXT</turn>\\n

In texts and roles a backslash becomes two, and ``<turn`` and ``</turn`` get one before them; in
roles ``>`` and line breaks are escaped too. So no text can end or begin a turn, and all of it can be
read back. The loss mask covers the texts of assistant turns.

The log is partitioned by conversation and sorted inside partitions, then streamed: a task holds one
conversation at a time, as one conversation is one output row.

Edge cases: a null text or role is empty; a null sequence number comes first; equal sequence numbers
are taken in the order of turn, kind, role and text; rows with a null conversation are one
conversation; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"</?turn")
_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<(?!/?turn))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    text = _CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))
    return text.replace(">", "\\>").replace("\n", "\\n") if role else text


def unescape(text: str, role: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role, True)}>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, "</turn>\n"
        at += len(head) + len(body) + 8
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; an error if anything is left over."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1], True), unescape(m[2])))
        at = m.end()
    return out


def fold(events: list[tuple[int | None, str | None, str | None, str | None]]) -> list[tuple[str, str]]:
    """(turn, kind, role, text) in order -> final (role, text)."""
    turns: list[list] = []  # turn, role, parts

    def find(turn):
        return next((i for i in range(len(turns) - 1, -1, -1) if turns[i][0] == turn), None)

    for turn, kind, role, text in events:
        if kind in (None, "message"):
            turns.append([turn, role or "", [text or ""]])
            continue
        i = find(turn)
        if i is None:
            turns.append([turn, role or "", []])
            i = len(turns) - 1
        elif kind == "regenerate":
            del turns[i + 1 :]
        if kind != "delta":
            turns[i][2] = []
        if kind != "regenerate" or text:
            turns[i][2].append(text or "")
        if role:
            turns[i][1] = role
    return [(role, "".join(parts)) for _, role, parts in turns]


def conversations(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq", turn_col: str = "turn", kind_col: str = "kind", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (array of [start, end) in code points) of each conversation."""
    log = events.select(F.col(conv_col).alias("conv_id"), F.col(seq_col).cast("long").alias("seq"), F.col(turn_col).cast("long").alias("turn"), F.col(kind_col).alias("kind"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "kind", "role", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(log.schema["conv_id"].dataType)

    def run(batches):
        now, own, out = None, [], []
        schema = pa.schema([("conv_id", kind), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

        def done():
            formatted, spans = render(fold(own))
            out.append({"conv_id": now, "formatted": formatted, "loss_spans": [{"start": a, "end": b} for a, b in spans]})

        for b in batches:
            for conv, _, *event in zip(*(c.to_pylist() for c in b.columns)):
                if own and conv != now:
                    done()
                    own = []
                now = conv
                own.append(tuple(event))
            if sum(len(x["formatted"]) for x in out) > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if own:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return log.mapInArrow(run, f"conv_id {log.schema['conv_id'].dataType.simpleString()}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output: turns and the text under the loss mask."""

    def run(batches):
        for b in batches:
            n, turns, chars, loss, size = [], [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                back = parse(text)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                n.append(len(back))
                turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest())
                chars.append(len(under))
                loss.append(hashlib.sha256(under.encode()).hexdigest())
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
