"""The token ledger as keyed state: a scope's book is a map by reservation key that outlives micro-batches and restarts.

The state store must be RocksDB (``rocksdb``).  Requests of one micro-batch are taken in order of ``seq``; a scope's
requests must not come in an earlier batch than smaller numbers.  A scope's limit is fixed by the first start that sees the
scope, or by the initial state; a start with another limit fails and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.store import NO_ENTRY, REQUEST, ledger_step

_ENTRY = "status string, estimate long, input_tokens long, output_tokens long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = f"scope {{}}, limit long, key string, {_ENTRY}"


def rocksdb(spark: SparkSession) -> SparkSession:
    """The session, with the state store that map state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


class LedgerProcessor(StatefulProcessor):
    """One scope: its limit, its free tokens and its book."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scope = handle.getValueState("scope", "limit long, free long")
        self.book = handle.getMapState("book", "key string", _ENTRY)

    def _opened(self) -> int:
        """The scope's free tokens."""
        if not self.scope.exists():
            self.scope.update((self.limit, self.limit))
            return self.limit
        limit, free = self.scope.get()
        if limit != self.limit:
            raise ValueError(f"the scope was opened with a limit of {limit} tokens, not {self.limit}")
        return free

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        """One row (scope, limit, key and entry) of what an earlier ledger held; a row without a key opens the scope."""
        r = initialState
        limit, free = self.scope.get() if self.scope.exists() else (r.limit, r.limit)
        if limit != r.limit:
            raise ValueError(f"the initial state gives a scope the limits {limit} and {r.limit}")
        if r.key is not None:
            self.book.updateValue((r.key,), (r.status, r.estimate, r.input_tokens, r.output_tokens))
            free -= r.estimate if r.status == "reserved" else r.input_tokens + r.output_tokens if r.status == "settled" else 0
        self.scope.update((limit, free))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        free = self._opened()
        book: dict = {}  # the entries that this batch asks for: each is read once and written once
        changed = set()
        for r in sorted(rows, key=lambda r: r.seq):
            if r.key not in book:
                book[r.key] = tuple(self.book.getValue((r.key,))) if r.key is not None and self.book.containsKey((r.key,)) else NO_ENTRY
            entry = book[r.key]
            outcome, after, free = ledger_step(entry, free, *(r[c] for c in REQUEST[1:]))
            if after != entry:
                book[r.key] = after
                changed.add(r.key)
            yield Row(scope=key[0], seq=r.seq, outcome=outcome)
        for name in changed:
            self.book.updateValue((name,), book[name])
        self.scope.update((self.limit, free))

    def close(self) -> None:
        pass


def ledger_stream(requests: DataFrame, *, limit: int, initial: DataFrame | None = None) -> DataFrame:
    """(scope, seq, outcome) of a stream of requests, as ``store.ledger`` gives it for all of them at once.

    ``initial`` (scope, limit, key, status, estimate, input_tokens, output_tokens) is what the ledger holds before.
    """
    if limit <= 0:
        raise ValueError("a limit is positive")
    kind = requests.schema["scope"].dataType.simpleString()
    held = initial.select(*[c.split()[0] for c in STATE.format(kind).split(", ")]).groupBy("scope") if initial is not None else None
    return requests.groupBy("scope").transformWithState(LedgerProcessor(limit), f"scope {kind}, seq long, outcome string", "append", "none", held)


def entries(requests: DataFrame, outcomes: DataFrame, *, limit: int) -> DataFrame:
    """What a ledger holds after requests with their outcomes, as an initial state: of each key the last request that took
    effect, and each scope that made any."""
    both = requests.join(outcomes, ["scope", "seq"])
    made = both.where("outcome in ('reserved', 'settled') or op = 'release' and outcome = 'released'")
    estimate = F.max_by(F.when(F.col("outcome") == "reserved", F.col("tokens")), F.when(F.col("outcome") == "reserved", F.col("seq")))
    last = made.groupBy("scope", "key").agg(F.max_by("outcome", "seq").alias("status"), estimate.alias("estimate"), *[F.max_by(c, "seq").alias(c) for c in ("input_tokens", "output_tokens")])
    used = lambda c: F.when(F.col("status") == "settled", F.col(c)).otherwise(0).cast("long").alias(c)
    return both.select("scope").distinct().join(last, "scope", "left").select("scope", F.lit(limit).cast("long").alias("limit"), "key", "status", F.col("estimate").cast("long").alias("estimate"), used("input_tokens"), used("output_tokens"))
