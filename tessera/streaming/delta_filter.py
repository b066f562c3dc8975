"""Streaming filter of reference markers in text deltas.

Text flows through at once; only a possible marker is held back until it is complete.  Known references are shown
in square brackets, unknown ones dropped, anything else passed on.  One function serves the batch fold and the stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Set

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.text import CITATION

_MARK = re.compile(CITATION)
HELD = 160  # fixed value: what is longer and not closed is no marker
_OPEN = rf"(?:[LC][^{{}}]{{{{0,{HELD - 2}}}}})?\Z"
_TOKEN = re.compile(r"\[[LC][^\]]*\]|【[LC][^】]*】|(?P<held>\[" + _OPEN.format(r"\]") + "|【" + _OPEN.format("】") + ")")


def feed(held: str, delta: str, known: Set[str]) -> tuple[str, str]:
    """What may be shown now, and what is still held back: a suffix that may become a marker."""
    rest = ""

    def shown(token: re.Match) -> str:
        nonlocal rest
        if token["held"]:
            rest = token["held"]
            return ""
        if not _MARK.fullmatch(token[0]):
            return token[0]
        return f"[{token[0][1:-1]}]" if token[0][1:-1] in known else ""

    return _TOKEN.sub(shown, held + delta), rest


def _folded(batches: Iterator[pa.RecordBatch], known: Set[str]) -> Iterator[pa.RecordBatch]:
    """Runs from deltas that come run by run in order; only the run at hand is kept."""
    now, held, shown, any_rows = None, "", [], False
    for batch in batches:
        ids, texts = [], []
        for run, delta in zip(batch.column("run_id").to_pylist(), batch.column("delta").to_pylist(), strict=True):
            if any_rows and run != now:
                ids.append(now)
                texts.append("".join(shown) + held)
                held, shown = "", []
            now, any_rows = run, True
            if delta:
                if held or "[" in delta or "【" in delta:
                    delta, held = feed(held, delta, known)
                shown.append(delta)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("run_id").type), pa.array(texts, pa.string())], ["run_id", "text"])
    if any_rows:
        yield pa.RecordBatch.from_arrays([pa.array([now], batch.column("run_id").type), pa.array(["".join(shown) + held], pa.string())], ["run_id", "text"])


def fold_deltas(deltas: DataFrame, known: Set[str]) -> DataFrame:
    """(run_id, text) of every finished run from its deltas (run_id, seq, delta) in order.  Runs are dealt out and sorted by
    Spark; a task passes over its runs one after another."""
    known = frozenset(known)
    ordered = deltas.select("run_id", "seq", "delta").repartition("run_id").sortWithinPartitions("run_id", F.asc_nulls_last("seq"))
    kind = deltas.schema["run_id"].dataType.simpleString()
    return ordered.select("run_id", "delta").mapInArrow(lambda b: _folded(b, known), f"run_id {kind}, text string")


def filter_stream(deltas: DataFrame, known: Set[str]) -> DataFrame:
    """(run_id, seq, text) for a stream of deltas (run_id, seq, delta, last); a row with ``last`` flushes what is held."""
    known = frozenset(known)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ("",)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, delta, last in zip(rows.seq, rows.delta.fillna(""), rows["last"], strict=True):
            now, held = feed(held, delta, known)
            if last:
                now, held = now + held, ""
            out.append((key[0], seq, now))
        state.update((held,))
        yield pd.DataFrame(out, columns=["run_id", "seq", "text"])

    return deltas.groupBy("run_id").applyInPandasWithState(step, "run_id string, seq long, text string", "held string", "append", GroupStateTimeout.NoTimeout)
