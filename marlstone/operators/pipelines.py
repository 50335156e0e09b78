"""Content pipelines: steps with predicates over a table of objects, plugins by name, and the log of what they did."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates, scalars

Plugin = Callable[[Column, Column, Column], tuple[Column, Column, Column]]
"""(text, content_type, metadata) to (text, metadata, error); error is null where the step succeeds."""


@dataclass(frozen=True)
class Step:
    name: str
    plugin: str
    on_error: str = "fail"  # fail, skip or continue


@dataclass(frozen=True)
class Pipeline:
    name: str
    trigger: str
    steps: tuple[Step, ...]
    filter: str = ""
    enabled: bool = True
    priority: int = 0


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def register(self, name: str, plugin: Plugin) -> None:
        self.plugins[name] = plugin

    def compile(self, pipeline: Pipeline) -> Pipeline:
        """Unknown plugins and pipelines without steps are errors (PIP-02)."""
        if not pipeline.steps:
            raise ValueError(f"{pipeline.name} has no steps")
        for s in pipeline.steps:
            if s.plugin not in self.plugins:
                raise ValueError(f"{pipeline.name}: no plugin {s.plugin}")
            if s.on_error not in ("fail", "skip", "continue"):
                raise ValueError(f"{pipeline.name}: {s.on_error} is no error policy")
        return pipeline


def put(metadata: Column, key: str, value: Column | str) -> Column:
    """The last value of a key wins."""
    entry = F.create_map(F.lit(key), F.lit(value) if isinstance(value, str) else value)
    return F.map_concat(F.map_filter(metadata, lambda k, _: k != key), entry)


def redact(text, content_type, metadata):
    """PIP-03."""
    return scalars.redact_pii(text), put(metadata, "pii_redacted", "true"), F.lit(None).cast("string")


def extract(text, content_type, metadata):
    """PIP-04, SCL-23."""
    kind = scalars.content_kind(content_type)
    return text, put(metadata, "kind", F.coalesce(kind, F.lit("other"))), F.lit(None).cast("string")


def only(prefix: str, flag: str) -> Plugin:
    """PIP-05: sets a flag for its content types, and is an error for others."""

    def plugin(text, content_type, metadata):
        ok = content_type.startswith(prefix)
        return text, F.when(ok, put(metadata, flag, "true")).otherwise(metadata), F.when(~ok, F.lit("unsupported type"))

    return plugin


def default_registry() -> Registry:
    """PIP-07."""
    r = Registry()
    for name, plugin in (("encrypt_pii", redact), ("extract_metadata", extract), ("compress_image", only("image/", "compressed")), ("transcode_video", only("video/", "transcoded")), ("thumbnail", only("image/", "thumbnail"))):
        r.register(name, plugin)
    return r


def matching(objects: DataFrame, pipelines: list[Pipeline], trigger: str) -> DataFrame:
    """Each object with the names of the enabled pipelines of the trigger whose filter takes it, in configuration order (FLT-09, D28)."""
    c = lambda n: F.col(n)
    names = [
        F.when(predicates.compile_filter(p.filter, c("content_type"), c("size"), c("metadata")), F.lit(p.name))
        for p in pipelines
        if p.enabled and p.trigger == trigger
    ]
    found = F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    return objects.withColumn("pipelines", found)


def execute(objects: DataFrame, pipeline: Pipeline, registry: Registry) -> DataFrame:
    """PIP-01: the steps one after the other as column expressions; text feeds the next step, metadata add up, and ``steps`` tells each step's
    outcome. After a failure with policy fail nothing more runs; skip keeps what the step made of nothing; continue goes on."""
    registry.compile(pipeline)
    rows = objects.withColumn("failed", F.lit(False)).withColumn("steps", F.array().cast("array<struct<name:string,status:string>>"))
    for s in pipeline.steps:
        text, metadata, error = registry.plugins[s.plugin](F.col("text"), F.col("content_type"), F.col("metadata"))
        rows = rows.withColumn("__error", error).withColumn("__text", text).withColumn("__metadata", metadata)
        ok = F.col("__error").isNull() & ~F.col("failed")
        status = F.when(F.col("failed"), "not run").when(F.col("__error").isNull(), "ok").when(F.lit(s.on_error) == "skip", "skipped").otherwise("error")
        rows = rows.withColumns(
            {
                "steps": F.concat("steps", F.array(F.struct(F.lit(s.name).alias("name"), status.alias("status")))),
                "text": F.when(ok, F.col("__text")).otherwise(F.col("text")),
                "metadata": F.when(ok, F.col("__metadata")).otherwise(F.col("metadata")),
                "failed": F.col("failed") | (F.col("__error").isNotNull() & F.lit(s.on_error == "fail")),
            }
        )
    return rows.drop("__error", "__text", "__metadata")


def topological_order(needs: dict[str, list[str]]) -> list[str]:
    """Names so that each follows what it needs, the first in the alphabet where several can come (GRF-03)."""
    import heapq

    left = {n: {d for d in ds if d in needs} for n, ds in needs.items()}
    users: dict[str, list[str]] = {n: [] for n in needs}
    for n, ds in left.items():
        for d in ds:
            users[d].append(n)
    ready = [n for n, ds in left.items() if not ds]
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for u in users[n]:
            left[u].discard(n)
            if not left[u]:
                heapq.heappush(ready, u)
    if len(out) < len(needs):
        raise ValueError(f"cycle among {sorted(set(needs) - set(out))}")
    return out
