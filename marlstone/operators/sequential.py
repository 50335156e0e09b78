"""Operators whose decision on a row depends on the decisions before it: limiters, breakers, lockouts, versioned state.

``fold`` runs a state machine over each key's rows in order. Rows are dealt by key and sorted within partitions by Spark, which
spills; Python sees one Arrow batch at a time and keeps the state of one key, so a hot key costs time but no memory. The streaming
forms in ``streaming`` use the same machines."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _same(a: tuple, b: tuple) -> bool:
    """Keys as grouping compares them: a null is a null's like, NaN is NaN's."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Callable[[], Callable[[Any], Any]], out: str, kind: str) -> DataFrame:
    """The rows with a column ``out`` of type ``kind``: what the key's machine, a fresh one per key, returns for each row in order. Rows come as tuples of
    Python values, a null as None; rows whose key is null are one key's."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"{out} {kind}").fields])
    names, at = rows.columns, [rows.columns.index(k) for k in keys]
    arrow = to_arrow_type(schema[-1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_type = namedtuple("Row", names, rename=True)
        key, step = None, None
        for b in batches:
            got = []
            for row in map(row_type._make, zip(*[c.to_pylist() for c in b.columns], strict=True)):
                own = tuple(row[i] for i in at)
                if step is None or not _same(own, key):
                    key, step = own, machine()
                got.append(step(row))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, arrow)], [*names, out])

    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class SlidingWindow:
    """STR-05, WIN-06: allowed if fewer than ``limit`` calls were allowed in the sub-buckets of the window; only allowed calls count."""

    def __init__(self, limit: int, window_ms: int, precision_ms: int):
        self.limit, self.span, self.precision = limit, window_ms // precision_ms, precision_ms
        self.counts: dict[int, int] = {}

    def allow(self, at_ms: int) -> bool:
        now = at_ms // self.precision
        self.counts = {b: c for b, c in self.counts.items() if b > now - self.span}
        if sum(self.counts.values()) >= self.limit:
            return False
        self.counts[now] = self.counts.get(now, 0) + 1
        return True


class TokenBucket:
    """STR-06: refills ``rate`` a second up to ``burst``."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst
        self.tokens, self.last = burst, None

    def allow(self, at_ms: int, n: float = 1) -> bool:
        if self.last is not None:
            self.tokens = min(self.burst, self.tokens + max(0, at_ms - self.last) / 1000 * self.rate)
        self.last = at_ms if self.last is None else max(self.last, at_ms)
        if self.tokens < n:
            return False
        self.tokens -= n
        return True


class Breaker:
    """STR-08, WIN-08, D27: opens when failures / requests reaches the threshold once enough were seen; after ``open_ms`` one trial decides."""

    def __init__(self, threshold: float, least: int, open_ms: int):
        self.threshold, self.least, self.open_ms = threshold, least, open_ms
        self.state, self.requests, self.failures, self.since = "closed", 0, 0, 0

    def record(self, at_ms: int, ok: bool) -> str:
        """The state in which the call was met: closed, half_open or, where it was refused, open."""
        if self.state == "open" and at_ms - self.since >= self.open_ms:
            self.state = "half_open"
        met = self.state
        if met == "open":
            return met
        if met == "half_open":
            self.state, self.requests, self.failures, self.since = ("closed", 0, 0, at_ms) if ok else ("open", 0, 0, at_ms)
            return met
        self.requests += 1
        self.failures += not ok
        if self.requests >= self.least and self.failures / self.requests >= self.threshold:
            self.state, self.requests, self.failures, self.since = "open", 0, 0, at_ms
        return met


class Lockout:
    """STR-21: five failures in a window that begins with the first of them block for a time; a success clears."""

    def __init__(self, failures: int = 5, window_ms: int = 900_000, block_ms: int = 900_000):
        self.most, self.window, self.block = failures, window_ms, block_ms
        self.count, self.first, self.until = 0, 0, -1

    def attempt(self, at_ms: int, ok: bool) -> str:
        if at_ms < self.until:
            return "blocked"
        if ok:
            self.count = 0
            return "ok"
        if not self.count or at_ms - self.first > self.window:
            self.count, self.first = 0, at_ms
        self.count += 1
        if self.count >= self.most:
            self.until, self.count = at_ms + self.block, 0
        return "failed"


class MultiLevel:
    """STR-07: levels in order, the first that refuses decides; levels before it have already counted the call. Whitelisted callers pass."""

    def __init__(self, levels: Sequence[tuple[str, Callable[[Any], Any], Callable[[], Any]]], whitelist: Sequence[str] = ()):
        self.levels, self.whitelist = levels, set(whitelist)
        self.state: dict[tuple[str, Any], Any] = {}

    def admit(self, row: Any, caller: str, at_ms: int) -> str:
        if caller in self.whitelist:
            return "allowed"
        for name, key, make in self.levels:
            at = (name, key(row))
            if at not in self.state:
                self.state[at] = make()
            if not self.state[at].allow(at_ms):
                return name
        return "allowed"


class VersionedState:
    """UDF-06: get, put, compare-and-set and delete with versions that only grow; every operation has its own status (D26)."""

    def __init__(self):
        self.value, self.version, self.there = None, 0, False

    def apply(self, op: str, value: str | None = None, expected: int | None = None) -> tuple[str, int]:
        if op == "get":
            return ("ok" if self.there else "not_found"), self.version if self.there else 0
        if op == "put":
            self.value, self.there, self.version = value, True, self.version + 1
            return "ok", self.version
        if op == "cas":
            if (self.version if self.there else 0) != (expected or 0):
                return "conflict", self.version
            self.value, self.there, self.version = value, True, self.version + 1
            return "ok", self.version
        if op == "delete":
            if not self.there:
                return "not_found", 0
            self.there, self.version = False, self.version + 1
            return "ok", self.version
        return "unknown", self.version
