"""Event-stream frames: the text of a connection as frames, and what a run's stream came to."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELD = re.compile(r"^(?P<name>[^:]+)(?::[ ]?(?P<value>.*))?$", re.S)
FRAMES = "array<struct<id: string, event: string, data: string>>"
RESULT = "struct<text: string, deltas: int, result: string, failure: string, infrastructure: boolean>"
KNOWN = frozenset({"metadata", "custom", "end"})  # fixed values: events that carry nothing for the reader


def frames(text: str, *, whole: bool = True) -> list[tuple]:
    """(id, event, data) of each frame that has data.  Lines may end in CR; comments are skipped; lines of data are joined.
    With ``whole`` a frame that no blank line ends is left out: it is sent again from the last event's id."""
    *lines, rest = [line.removesuffix("\r") for line in text.split("\n")]
    return _until_blank(lines if whole else [*lines, rest, ""])


def _until_blank(lines: list[str]) -> list[tuple]:
    out, first = [], 0
    for end in (i for i, line in enumerate(lines) if not line):
        fields = [m for line in lines[first:end] if not line.startswith(":") and (m := _FIELD.match(line))]
        last = {m["name"]: m["value"] or "" for m in fields if not (m["name"] == "id" and "\0" in (m["value"] or ""))}
        if data := [m["value"] or "" for m in fields if m["name"] == "data"]:
            out.append((last.get("id"), last.get("event") or "message", "\n".join(data)))
        first = end + 1
    return out


def _joined(chunks: DataFrame, connection: str) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"])
    return chunks.groupBy(connection).agg(F.array_join(parts, "").alias("_text"))


def parse_streams(chunks: DataFrame, *, connection: str = "connection") -> DataFrame:
    """(connection, n, id, event, data) of the frames in a connection's chunks (connection, seq, chunk)."""

    @F.pandas_udf(FRAMES)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(frames)

    return _joined(chunks, connection).select(connection, F.posexplode(cut("_text")).alias("n", "f")).select(connection, "n", "f.*")


def _events(text: str, ndjson: bool) -> list[tuple[str, dict]]:
    if ndjson:
        payloads = [json.loads(line) for line in text.splitlines() if line.strip()]
        return [(p.get("type"), p) for p in payloads]
    out = []
    for _, event, data in frames(text, whole=False):
        payload = json.loads(data)
        if not isinstance(payload, dict):
            raise ValueError("stream returned non-object SSE data")
        out.append(("delta" if event == "messages" else event, payload))
    return out


def observed(text: str, *, ndjson: bool = False) -> tuple:
    """A stream's text, number of deltas and result, or the first thing that is wrong with it."""
    try:
        events = _events(text, ndjson)
    except ValueError as e:
        return None, 0, None, str(e) if "non-object" in str(e) else f"stream returned invalid {'NDJSON' if ndjson else 'SSE data'}", False
    deltas, result = [], None
    checks: dict[str, Callable[[dict], str | None]] = {
        "delta": lambda p: None if isinstance(p.get("delta"), str) and p["delta"] else "stream returned an empty delta",
        "complete": lambda p: None if result is None else "stream returned multiple complete events",
        "error": lambda p: str(p.get("message") or "stream failed"),
        "gap": lambda p: "stream replay gap prevented complete observation",
    }
    for kind, payload in events:
        check = checks.get(kind)
        failure = check(payload) if check else None if kind in KNOWN else f"stream returned unknown event type: {kind}"
        if failure:
            return None, len(deltas), None, failure, kind == "error" and payload.get("code") == "provider_unavailable"
        if kind == "delta":
            deltas.append(payload["delta"])
        elif kind == "complete":
            result = json.dumps(payload.get("result"), ensure_ascii=False)
    return "".join(deltas), len(deltas), result, None if result is not None else "stream ended without a complete event", False


def observe_streams(chunks: DataFrame, *, connection: str = "connection", ndjson: bool = False) -> DataFrame:
    """(connection, text, deltas, result, failure, infrastructure) of each connection."""

    @F.pandas_udf(RESULT)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([observed(t, ndjson=ndjson) for t in texts], columns=["text", "deltas", "result", "failure", "infrastructure"])

    return _joined(chunks, connection).select(connection, read("_text").alias("r")).select(connection, "r.*")
