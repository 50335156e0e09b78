"""Operator 4: SimHash near-dedup with bit-sliced comparison.

Fingerprints: bit i is set if it is set in over half of the XXH64 values of the document's word shingles. Documents with the
same fingerprint are one node, so any number of copies costs one row from there on.

Candidates: the 64 bits are cut into 5 blocks. Two fingerprints within 3 bits agree on at least 2
whole blocks, so each of the 10 pairs of blocks (25 or 26 bits) makes a bucket key, and every pair within
the radius meets in a bucket: no link is lost. A bucket beyond ``BUCKET`` rows is split by hash into
parts, and the pairs of parts are dealt as tasks of their own, so no task holds an unbounded bucket.

Comparison: fingerprints stand vertically, one plane of bits for each of the 64 positions. A query's bits
invert the planes, and carry-save counters (ones, twos, and "four or more") add the 64 differences
for 64 candidates per machine word; a block of candidates is abandoned once all of it is beyond the radius. Small
buckets are sliced the same way with all their pairs side by side.

A task reports no pairs but a spanning forest of its links, and components of those are found by star
contraction. Defined results: null, empty and white texts have fingerprint zero and link like any other; repeated rows
are in one component; null ids get the least id of their component (null if it has none); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table
from . import common
from .components import connected_components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Rows of a bucket that one task compares with each other.
BUCKET = 2048
#: Buckets up to this many rows are compared with all their pairs side by side.
SMALL = 64
#: (lowest bit, number of bits) of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(*(words[i : len(words) - shingle + 1 + i] for i in range(shingle)), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(s, SEED) for s in shingles], "<u8", len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(shingle), "doc_id long, fp long")


def planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of machine words: bit j of row i is bit i of print j."""
    n = -(-len(prints) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(differences: Iterator[np.ndarray], radius: int) -> np.ndarray | None:
    """Bits of the lanes whose differences sum to at most ``radius`` (3 at most); None once all lanes are beyond."""
    ones = twos = fours = None
    for k, d in enumerate(differences):
        if ones is None:
            ones, twos, fours = d.copy(), np.zeros_like(d), np.zeros_like(d)
            continue
        carry = ones & d
        ones ^= d
        fours |= twos & carry
        twos ^= carry
        if k % 8 == 7 and (fours == ~np.uint64(0)).all():
            return None
    beyond = fours if radius >= 3 else fours | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones)
    return ~beyond


def _lanes(bits: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.astype("<u8").view(np.uint8), bitorder="little")[:n])


def _links_of_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a), 65_536):
        x, y = a[i : i + 65_536], b[i : i + 65_536]
        near = within(iter(planes(x ^ y)), radius)
        if near is not None:
            k = _lanes(near, len(x))
            yield x[k], y[k]


def _links_of_block(queries: np.ndarray, prints: np.ndarray, radius: int, later_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    up = planes(prints)
    flip = np.array([0, ~np.uint64(0)], np.uint64)
    for i, q in enumerate(queries):
        bits = np.unpackbits(np.array([q], "<u8").view(np.uint8), bitorder="little")
        near = within((up[k] ^ flip[bits[k]] for k in range(64)), radius)
        if near is not None:
            k = _lanes(near, len(prints))
            k = k[k > i] if later_only else k
            if len(k):
                yield np.full(len(k), q), prints[k]


def _forest(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, int]:
    """Parents of a spanning forest of the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for xs, ys in found:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
    return parent


def _link_batches(radius: int):
    """Rows (bucket, part_a, part_b, side, fp), sorted so, to forest edges (u, v)."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Whole groups only: what a batch's last group begins is kept for the next batch."""
        held = None
        for b in batches:
            cols = tuple(b.column(n).to_numpy() for n in ("bucket", "part", "side", "fp"))
            if held is not None:
                cols = tuple(np.concatenate(c) for c in zip(held, cols, strict=True))
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = len(same) if not same.any() else int(np.flatnonzero(same)[0])
            held = tuple(c[cut:] for c in cols)
            if cut:
                yield tuple(c[:cut] for c in cols)
        if held is not None:
            yield held

    def links(bucket, part, side, fp):
        fp = fp.view(np.uint64)
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        two_sided = np.add.reduceat(side, starts) > 0
        small = np.flatnonzero((sizes <= SMALL) & (sizes > 1) & ~two_sided)
        for size in np.unique(sizes[small]):
            rows = fp[starts[small[sizes[small] == size]][:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            step = max(1, 200_000 // len(i))
            for k in range(0, len(rows), step):
                yield from _links_of_pairs(rows[k : k + step, i].ravel(), rows[k : k + step, j].ravel(), radius)
        for g in np.flatnonzero((sizes > SMALL) & ~two_sided):
            own = fp[starts[g] : starts[g] + sizes[g]]
            yield from _links_of_block(own, own, radius, True)
        for g in np.flatnonzero(two_sided):
            own, s = fp[starts[g] : starts[g] + sizes[g]], side[starts[g] : starts[g] + sizes[g]]
            if len(own[s == 0]) and len(own[s == 1]):
                yield from _links_of_block(own[s == 0], own[s == 1], radius, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in groups(batches):
            parent = _forest(links(*cols))
            edges = [(x, p) for x, p in parent.items() if x != p]
            if edges:
                e = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["u", "v"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) edges that join exactly the distinct fingerprints (column fp) which links of at most ``radius`` bits join."""
    if not 0 <= radius <= 3:
        raise ValueError("the two-bit counters and the five blocks serve a radius of 0 to 3")
    spark = prints.sparkSession
    block = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1)) for low, n in BLOCKS]
    keys = [F.shiftleft(block[a], 13).bitwiseOR(block[b]).bitwiseOR(F.lit(k << 26)) for k, (a, b) in enumerate(combinations(range(5), 2))]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # The counts of buckets with partners, about as many rows as there are links and chance meetings.
    joined = rows.join(counts, "bucket")
    parts = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # Part p meets parts p..parts-1 as side 0 and parts 0..p-1 as side 1; with itself it has one side only.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct((F.least("own", q) * F.col("parts") + F.greatest("own", q)).cast("int").alias("part"), F.when(q < F.col("own"), 1).otherwise(0).alias("side")),
    )
    dealt = joined.withColumn("parts", parts).withColumn("own", own)
    dealt = dealt.select("bucket", "fp", F.explode(meets).alias("m")).select("bucket", F.col("m.part").alias("part"), F.col("m.side").cast("int").alias("side"), "fp")
    n = common.partitions(spark)
    return dealt.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_link_batches(radius), "u long, v long")


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) for each distinct fingerprint of a written table (doc_id, fp); least is its least id."""
    nodes, _ = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(nodes.select("fp"), radius))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    prints, _ = common.written(fingerprints(docs, id_col, text_col, shingle))
    named = _components(prints, radius)
    # One row per fingerprint, so these sums and joins never see the copies.
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(component, "root").select(F.col("fp").alias("n_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("n_fp")).select("doc_id", "fp", "component_id")


def _with_fingerprint(at: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint((x.as_py() or "").encode(), shingle) for x in b.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints)], [*b.schema.names, "__fp"])

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row, with its own columns, of each component: that of the least id (rows without id come last), once where it is repeated."""
    prints, _ = common.written(fingerprints(docs, id_col, text_col, shingle))
    named = _components(prints, radius).withColumn("first", F.struct(F.col("least").isNull().alias("none"), "least", "fp"))
    keep = named.groupBy("root").agg(F.min("first").alias("k")).select(F.col("k.least").alias("__kept"), F.col("k.fp").alias("__kept_fp"))
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])
    rows = docs.mapInArrow(_with_fingerprint(docs.columns.index(text_col), shingle), schema)
    kept = rows.join(keep, rows[id_col].cast("long").eqNullSafe(F.col("__kept")) & (rows["__fp"] == F.col("__kept_fp")), "left_semi")
    return kept.dropDuplicates([id_col, "__fp"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
