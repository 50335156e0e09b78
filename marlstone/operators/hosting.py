"""Plugins as data: manifests, dependencies, hooks in order, limits of users, admission to workers."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from . import pipelines
from .sequential import TokenBucket

# The namespaces a capability may have.
NAMESPACES = ("http", "storage", "vector", "fts", "state", "event", "pipeline", "task", "net", "log", "metric", "trace", "iam", "kms", "crypto", "gateway")
# Route prefixes no plugin may take.
RESERVED = ("/", "/admin/", "/_plugins/", "/metrics", "/healthz", "/readyz", "/livez")
# Names of plugins, hook types, what may follow a failed hook.
NAME = "^[a-z][a-z0-9-]{1,62}[a-z0-9]$"
HOOK_TYPES = ("before", "after", "around")
ON_FAILURE = ("", "deny", "allow", "log_and_allow")
SEMVER = r"^v?\d+(\.\d+){0,2}(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"

# Maintenance tasks, their schedules, concurrency, retries, first and longest delay in seconds, growth of the delay.
SCHEDULES = (
    ("tiering_decision", "0 */6 * * *", 1, 3, 60, 600, 2.0),
    ("scrub_check", "0 2 * * 0", 4, 2, 300, 1800, 3.0),
    ("key_rotation", "0 3 1 * *", 1, 1, 600, 3600, 2.0),
    ("multipart_cleanup", "0 */1 * * *", 2, 1, 30, 300, 2.0),
    ("hot_index_eviction", "*/10 * * * *", 2, 0, 0, 0, 1.0),
    ("cold_index_compaction", "0 4 * * 0", 1, 1, 3600, 21600, 2.0),
    ("lifecycle_process", "0 5 * * *", 4, 0, 0, 0, 1.0),
    ("version_cleanup", "0 6 1 * *", 2, 0, 0, 0, 1.0),
)


def manifest_error(name: Column, version: Column, tier: Column, capabilities: Column) -> Column:
    """UDF-09: the first field at fault, or null. Nulls are faults; no capabilities are none."""
    bad = F.exists(capabilities, lambda c: c.isNull() | ~F.split_part(c, F.lit(":"), F.lit(1)).isin(*NAMESPACES) | ~c.contains(":"))
    ladder = [(name.rlike(NAME), "name"), (version.rlike(SEMVER), "version"), (tier.between(0, 2), "tier"), (~F.coalesce(bad, F.lit(False)), "capabilities")]
    out = F.lit(None).cast("string")
    for good, field in reversed(ladder):
        out = F.when(~F.coalesce(good, F.lit(False)), field).otherwise(out)
    return out


def hook_error(kind: Column, operation: Column, handler: Column, priority: Column, on_failure: Column) -> Column:
    """UDF-09: the first field of a hook at fault, or null."""
    ladder = [
        (kind.isin(*HOOK_TYPES), "type"), (operation.startswith("s3:"), "op"), (F.coalesce(handler, F.lit("")) != "", "handler"),
        (F.coalesce(priority, F.lit(0)).between(0, 99), "priority"), (F.coalesce(on_failure, F.lit("")).isin(*ON_FAILURE), "on_failure"),
    ]
    out = F.lit(None).cast("string")
    for good, field in reversed(ladder):
        out = F.when(~F.coalesce(good, F.lit(False)), field).otherwise(out)
    return out


def route_error(prefix: Column) -> Column:
    """UDF-09: whether a route's prefix is free, reserved, or no path."""
    return F.when(~F.coalesce(prefix.startswith("/"), F.lit(False)), "not a path").when(prefix.isin(*RESERVED), "reserved")


def dependency_edges(plugins: DataFrame) -> DataFrame:
    """(name, needs, installed): JON-15. One row per declared dependency, repeated ones once."""
    edges = plugins.select("name", F.explode(F.array_distinct("depends_on")).alias("needs"))
    known = plugins.select(F.col("name").alias("needs"), F.lit(True).alias("there")).distinct()
    return edges.join(known, "needs", "left").select("name", "needs", F.coalesce("there", F.lit(False)).alias("installed"))


def hooks_in_order(hooks: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """TOP-08: plugins after those they need, then higher priority, then registration. ``needs`` is configuration, as small as the list of plugins."""
    order = hooks.sparkSession.createDataFrame([(n, i) for i, n in enumerate(pipelines.topological_order(needs))], "plugin string, plugin_order int")
    return hooks.join(F.broadcast(order), "plugin", "left").orderBy(F.asc_nulls_last("plugin_order"), F.desc("priority"), "seq")


def placed_hooks(hooks: DataFrame, needs: dict[str, list[str]], span: int = 10_000) -> DataFrame:
    """All hooks with their ``place`` in that order, from 1; plugins that ``needs`` does not name come last, by name. Hooks are counted by plugin, priority and span
    of registrations; the running sums are over those counts, and rows are numbered within a span only."""
    order = hooks.sparkSession.createDataFrame([(n, i) for i, n in enumerate(pipelines.topological_order(needs))], "plugin string, plugin_order int")
    keys = ["plugin_order", "plugin", "priority", "__span"]
    named = hooks.join(F.broadcast(order), "plugin", "left").withColumn("__span", F.floor(F.col("seq") / span))
    named = named.withColumn("plugin_order", F.coalesce("plugin_order", F.lit(2**31 - 1)))
    counts = named.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.orderBy("plugin_order", "plugin", F.desc("priority"), "__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    return named.withColumn("__at", within).join(counts, keys).withColumn("place", F.col("before") + F.col("__at")).drop("__span", "__at", "before")


@dataclass(frozen=True)
class Hook:
    """UDF-04, UDF-07: ``verdict`` is a column of booleans, null where the handler failed; ``when`` guards it."""

    name: str
    verdict: Callable[[], Column]
    when: Callable[[], Column] = lambda: F.lit(True)
    on_failure: str = "deny"


def admitted(requests: DataFrame, hooks: Sequence[Hook]) -> DataFrame:
    """The requests with ``decision`` and ``decided_by``: UDF-07. The first hook in order whose guard holds and that says no, or that fails and
    then denies, decides; a failed hook that allows is passed over. One projection, whatever the number of hooks."""
    by = F.lit(None).cast("string")
    for h in reversed(hooks):
        fails = h.verdict().isNull() & F.lit(h.on_failure in ("", "deny"))
        by = F.when(F.coalesce(h.when(), F.lit(False)) & (fails | ~F.coalesce(h.verdict(), F.lit(True))), F.lit(h.name)).otherwise(by)
    return requests.withColumn("decided_by", by).withColumn("decision", F.when(F.col("decided_by").isNull(), "allow").otherwise("deny"))


def resolved(name: str, inside: pipelines.Registry, outside: pipelines.Registry):
    """UDF-03: a step's plugin from the engine's own registry or, where it has none, from the installed ones."""
    return inside.plugins.get(name) or outside.plugins.get(name)


#: UDF-05: the imports of a plugin's host that read or write data, and the capability that each needs.
IMPORTS = {"storage.get": "storage:read", "storage.put": "storage:write", "vector.search": "vector:search", "state.get": "state:kv", "state.put": "state:kv", "event.emit": "event:publish"}


def host_calls(calls: DataFrame, grants: DataFrame, objects: DataFrame) -> DataFrame:
    """The calls (call_id, plugin, import, bucket, key, ...) of plugins to their host with ``status`` and ``size`` (UDF-05): ``unknown`` for an import there is not, ``denied``
    where no grant (plugin, capability) covers the import's capability for the bucket, else what the call gives: for a storage read ``ok`` and the object's size or
    ``not_found``, ``queued`` for an event, ``ok`` for the others, whose rows go on to ``sequential.fold``, ``segments.in_bucket`` or ``writes.put_objects``. Grants are configuration, broadcast as one row."""
    need = F.create_map(*[F.lit(x) for kv in IMPORTS.items() for x in kv])
    table = grants.groupBy("plugin").agg(F.collect_set("capability").alias("caps")).agg(F.map_from_entries(F.collect_list(F.struct("plugin", "caps"))).alias("__grants"))
    wanted = F.concat_ws(":", F.try_element_at(need, F.col("import")), "bucket")
    held = F.coalesce(F.exists(F.try_element_at("__grants", F.col("plugin")), lambda g: P.capability_match(g, wanted)), F.lit(False))
    known = F.try_element_at(need, F.col("import")).isNotNull()
    asked = calls.join(F.broadcast(table)).withColumn("__held", held).drop("__grants")
    there = objects.select(F.col("bucket").alias("__b"), F.col("key").alias("__k"), F.col("size").alias("__size"))
    reads = asked["import"] == "storage.get"
    found = asked.join(there, reads & asked["__held"] & (asked["bucket"] == there["__b"]) & (asked["key"] == there["__k"]), "left")
    done = F.when(F.col("import") == "storage.get", F.when(F.col("__b").isNull(), "not_found").otherwise("ok")).when(F.col("import") == "event.emit", "queued").otherwise("ok")
    status = F.when(~known, "unknown").when(~F.col("__held"), "denied").otherwise(done)
    return found.withColumn("status", status).withColumn("size", F.col("__size")).drop("__b", "__k", "__size", "__held")


def write_tasks(objects: DataFrame, vectors: bool = True, text: bool = True, steps: bool = True) -> DataFrame:
    """(bucket, key, kind): PIP-08. The tasks that follow a write; columns skip_vectorize and skip_fts leave theirs out."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    kinds = F.array(F.when(no("skip_vectorize") & F.lit(vectors), "vectorize"), F.when(no("skip_fts") & F.lit(text), "fts"), F.when(F.lit(steps), "pipeline"))
    return objects.select("bucket", "key", F.explode(F.array_compact(kinds)).alias("kind"))


def retry_delays(schedules: DataFrame) -> DataFrame:
    """(task, retry, delay_s): STR-12. Delays grow from the first to the longest; tasks without retries have no rows."""
    s = schedules.where("retries > 0").withColumn("retry", F.explode(F.sequence(F.lit(1), F.col("retries"))))
    return s.select("task", "retry", F.least(F.col("longest_s").cast("double"), F.col("first_s") * F.pow("growth", F.col("retry") - 1)).alias("delay_s"))


def replication_rules(rules: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """RPL-02: an added rule replaces the one of its id, one without id gets one; removed ids leave, unknown ones change nothing."""
    new = added.withColumn("rule_id", F.when(F.coalesce(F.col("rule_id"), F.lit("")) == "", F.uuid()).otherwise(F.col("rule_id")))
    kept = rules.join(added.select("rule_id"), "rule_id", "left_anti")
    return kept.unionByName(new).join(removed.select("rule_id"), "rule_id", "left_anti")


class UserLimit:
    """STR-10: a bucket per caller, full at first, whose rate is the user's own until that expires and the usual one after; the burst stays."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.bucket = rate, TokenBucket(rate, burst)

    def admit(self, at_ms: int, own_rate: float | None = None, expires_ms: int | None = None) -> bool:
        own = own_rate is not None and own_rate == own_rate and expires_ms is not None and expires_ms > at_ms
        self.bucket.rate = own_rate if own else self.rate
        return self.bucket.allow(at_ms)


class Admission:
    """STR-16: a token first, then a place in the queue, then the first free worker. ``rate`` None needs no tokens."""

    def __init__(self, workers: int = 100, queue: int = 1000, rate: float | None = None, burst: float | None = None):
        self.queue, self.free = queue, [0] * workers
        self.bucket = TokenBucket(rate, burst or workers) if rate else None
        self.waiting: list[int] = []

    def arrive(self, at_ms: int, takes_ms: int) -> tuple[str, int | None]:
        """(result, start): admitted, exhausted (no token) or backlog (queue full); arrivals come in order."""
        if self.bucket is not None and not self.bucket.allow(at_ms):
            return "exhausted", None
        while self.waiting and self.waiting[0] <= at_ms:
            heapq.heappop(self.waiting)
        if len(self.waiting) >= self.queue:
            return "backlog", None
        start = max(at_ms, heapq.heappop(self.free))
        heapq.heappush(self.free, start + takes_ms)
        if start > at_ms:
            heapq.heappush(self.waiting, start)
        return "admitted", start
