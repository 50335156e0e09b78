"""Near duplicates by similarity: two documents are linked if the Jaccard similarity of their sets of distinct shingles is ``SIMILARITY`` or more.

A node is a distinct set of 64-bit shingle hashes; however often a shingle is repeated in a text, it counts once. Nodes are known by a hash of their set; the sets
themselves, as large as the texts, are made once for their bands and again only for the nodes that have candidates, and are shuffled for those alone.

Fingerprints: bit i of 256 is set if it is set in over half of the hashes of the set's shingles (``set_print``).

Buckets: ``bands`` of ``ROWS`` least values under seeded hash functions. Two sets agree in one function with probability J, whatever their
size, so in at least one whole band with 1 - (1 - J ** ROWS) ** bands; the number of bands makes that ``RECALL`` at the threshold itself (nearer
pairs are found almost surely). Keys of sampled fingerprint bits would need hundreds a node for that recall, since a pair's difference spreads by several bits.

Comparison: within a bucket, fingerprints are compared as in ``simhash``: planes of bits, carry-save counters, blocks abandoned once all of them are beyond the radius, buckets
of more than ``BUCKET`` nodes split by hash and their parts dealt pairwise, forests instead of pairs. The radius (``radius_of``) is so wide that a pair at the threshold is beyond it
less than once in 100,000, whatever the sizes of its sets; unlike sets that share a band are beyond it. Nodes that such pairs join are a group.

Links: each group's sets are brought together and their similarity is computed exactly, by counting common shingles, so a
candidate that is no near duplicate joins nothing (a narrower radius would lose pairs, this one alone would join sets of 0.4). Pairs that are in one component already are not compared.
Groups of more than ``BUCKET`` nodes or ``GROUP_BYTES`` are split by hash and their parts dealt pairwise, so no task holds an unbounded group.

``fingerprint`` is the same over a text's shingles with repeats, which let a repeated line outweigh the rest; no link here depends on it.

Defined results: a text of fewer words than a shingle has its whole sequence as its one shingle; null texts, empty ones and those of white space are one node, the empty
set, and near each other only; of equal sets and of each group the row of the least id stays, rows without id come last, then the least hash of the text; rows that repeat id and
text are one row in the result; an empty table gives no rows; other columns are kept as they are."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import _LOWER, BUCKET, SMALL, _forest

__all__ = ["BUCKET", "SMALL", "deduplicated", "fingerprint", "planes", "within"]

BITS, SHINGLE, SIMILARITY, RECALL = 256, 5, 0.8, 0.9998
#: Least values in a band.
ROWS = 6
#: Bytes of a group's sets that one task compares with each other.
GROUP_BYTES = 8 << 20
#: Standard deviations of the difference at the threshold that the radius lies above its mean.
DEVIATIONS = 4.5
#: Fingerprints that are compared with a block at a time.
TILE = 64


def _grams(text: bytes | None, shingle: int) -> list[bytes]:
    words = (text or b"").translate(_LOWER).split()
    if len(words) >= shingle:
        return [b" ".join(g) for g in zip(*(words[i : len(words) - shingle + 1 + i] for i in range(shingle)), strict=True)]
    return [b" ".join(words)] if words else []


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles (all words are one shingle where they are fewer); no words: none."""
    grams = set(_grams(text, shingle))
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams)))


def band_count(similarity: float, rows: int = ROWS) -> int:
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - similarity**rows))) if similarity < 1 else 1


def bands(own: np.ndarray, similarity: float = SIMILARITY, rows: int = ROWS) -> list[int]:
    """The keys of a set's bands; none for the empty set."""
    if not len(own):
        return []
    n = band_count(similarity, rows)
    seeds = np.random.default_rng(23).integers(0, 1 << 63, (2, n * rows, 1), np.uint64)
    least = np.full(n * rows, ~np.uint64(0))
    for i in range(0, len(own), 2_000):
        mixed = (own[None, i : i + 2_000] ^ seeds[0]) * (seeds[1] << np.uint64(1) | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(axis=1), out=least)
    # As a signed number, which is what a column of longs holds.
    return [int(np.uint64(xxhash.xxh3_64_intdigest(v.tobytes(), k)).view(np.int64)) for k, v in enumerate(least.reshape(n, rows))]


@functools.cache
def difference(similarity: float) -> float:
    """The greatest probability, over the sizes of two sets, that a fingerprint's bit differs at a Jaccard similarity: exact for sets of up to 40, whose majorities
    change most easily, and its limit for large ones, acos(2 J / (1 + J)) / pi."""
    pmf = lambda n: np.array([math.comb(n, i) for i in range(n + 1)]) / 2**n
    share = Fraction(str(similarity))
    worst = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for a in range(1, 41):
        for b in range(a, 41):
            c = math.ceil(share * (a + b) / (1 + share))
            if c <= a:
                x = np.arange(c + 1)
                # P(over half of the bits are set | x of the common ones are).
                sets = [np.array([pmf(n - c)[2 * (i + np.arange(n - c + 1)) > n].sum() for i in x]) for n in (a, b)]
                worst = max(worst, float((pmf(c) * (sets[0] * (1 - sets[1]) + sets[1] * (1 - sets[0]))).sum()))
    return worst


def radius_of(similarity: float, bits: int = BITS) -> int:
    p = difference(similarity)
    return min(bits, math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p))))


def set_print(own: np.ndarray, bits: int = BITS) -> bytes:
    """The fingerprint of a set of shingle hashes: bit i is set if over half of the members' hashes have it; the empty set: all zero."""
    if not len(own):
        return bytes(bits // 8)
    seeds = np.random.default_rng(29).integers(0, 1 << 63, bits // 64, np.uint64)
    counts = np.zeros(bits, np.int64)
    for i in range(0, len(own), 16_320):
        h = own[i : i + 16_320, None] + seeds
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        each = np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little").view("<u8")
        for j in range(0, len(each), 255):  # eight counters a machine word, none of which overflows
            counts += each[j : j + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(counts * 2 > len(own), bitorder="little").tobytes()


def fingerprint(text: bytes | None, shingle: int = SHINGLE, bits: int = BITS) -> bytes:
    """Bit i is set if over half of the shingles' hashes have it; no words: all zero."""
    grams = _grams(text, shingle)
    if not grams:
        return bytes(bits // 8)
    digest = xxhash.xxh3_128_digest
    counts = np.zeros(bits, np.int64)
    for i in range(0, len(grams), 16_320):
        part = grams[i : i + 16_320]
        h = b"".join([digest(g, s) for g in part for s in range(bits // 128)])
        each = np.unpackbits(np.frombuffer(h, np.uint8).reshape(len(part), -1), axis=1, bitorder="little").view("<u8")
        for j in range(0, len(each), 255):  # eight counters a machine word, none of which overflows
            counts += each[j : j + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(counts * 2 > len(grams), bitorder="little").tobytes()


def _node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def _band_batches(shingle: int, similarity: float):
    """Rows (doc_id, th, text) to (doc_id, th, node, bands, print, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys, prints, sizes = [], [], [], []
            for x in b.column(2):
                own = shingle_set(x.as_py(), shingle)
                nodes.append(_node(own))
                keys.append(bands(own, similarity))
                prints.append(set_print(own))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "th", "node", "bands", "print", "size"])

    return run


def _gram_batches(shingle: int):
    """Rows (..., text) to (..., grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1_000):
                part = b.slice(i, 1_000)
                grams = pa.array([shingle_set(x.as_py(), shingle).tobytes() for x in part.column(part.num_columns - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], grams], [*part.schema.names[:-1], "grams"])

    return run


def planes(prints: np.ndarray) -> np.ndarray:
    """One row of machine words for each bit of the (n, bits / 8) byte fingerprints: bit j of row i is bit i of print j."""
    n = -(-len(prints) // 64) * 64
    bits = np.zeros((n, prints.shape[1] * 8), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(differences: Iterator[np.ndarray], radius: int) -> np.ndarray | None:
    """Bits of the lanes whose differences sum to at most ``radius``; None once all lanes are beyond. The counters are bit planes: two
    differences and a counter bit go through a carry-save adder, and the carries on to the next bit."""
    size = (radius + 1).bit_length()
    # Counters begin so that they overflow exactly beyond the radius.
    start = (1 << size) - radius - 1
    counter: list[np.ndarray] = []
    beyond = None
    step = 0
    for a in differences:
        b = next(differences, None)
        if not counter:
            counter = [np.full_like(a, ~np.uint64(0)) if start >> i & 1 else np.zeros_like(a) for i in range(size)]
            beyond = np.zeros_like(a)
        low = counter[0]
        if b is None:
            carry = low & a
            counter[0] = low ^ a
        else:
            x = low ^ a
            carry = (low & a) | (x & b)
            counter[0] = x ^ b
        for i in range(1, size):
            up = counter[i] & carry
            counter[i] ^= carry
            carry = up
        beyond |= carry
        step += 1
        if step % 16 == 0 and (beyond == ~np.uint64(0)).all():
            return None
    return ~beyond


def _lanes(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(bits).astype("<u8").view(np.uint8).reshape(*bits.shape[:-1], -1), axis=-1, bitorder="little")[..., :n]


def _near_pairs(node: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int):
    """The pairs (a, b) of places within the radius, all compared side by side."""
    for i in range(0, len(a), 4_096):
        x, y = a[i : i + 4_096], b[i : i + 4_096]
        near = within(iter(planes(fp[x] ^ fp[y])), radius)
        if near is not None:
            k = np.flatnonzero(_lanes(near, len(x)))
            yield node[x[k]], node[y[k]]


def _near_of_block(node: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int):
    """Pairs within the radius of side 0 with side 1, or, where there is no side 1, of all; none between nodes that others join."""
    asked = np.flatnonzero(side == 0)
    block = np.flatnonzero(side == 1) if side.any() else asked
    up = planes(fp[block])
    flip = np.array([0, ~np.uint64(0)], np.uint64)
    parent = np.arange(len(node))
    for t in range(0, len(asked), TILE):
        rows = asked[t : t + TILE]
        bits = np.unpackbits(fp[rows], axis=1, bitorder="little")
        near = within((up[k][None, :] ^ flip[bits[:, k]][:, None] for k in range(len(up))), radius)
        if near is None:
            continue
        for i, hit in zip(rows, _lanes(near, len(block)), strict=True):
            k = block[np.flatnonzero(hit)]
            k = k[parent[k] != parent[i]]
            if len(k):
                parent[np.isin(parent, parent[k])] = parent[i]
                yield np.full(len(k), node[i]), node[k]


def _near_batches(radius: int):
    """Rows (key, part, side, node, print), sorted so, to forest edges (u, v) of the pairs within the radius."""

    def groups(batches: Iterator[pa.RecordBatch]):
        """Whole groups only: what a batch's last group begins is kept for the next batch."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = (*(b.column(n).to_numpy() for n in ("key", "part", "side", "node")), np.frombuffer(b"".join(b.column("print").to_pylist()), np.uint8).reshape(b.num_rows, -1))
            if held is not None:
                cols = tuple(np.concatenate(c) for c in zip(held, cols, strict=True))
            cut = int(np.flatnonzero((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[0])
            held = tuple(c[cut:] for c in cols)
            if cut:
                yield tuple(c[:cut] for c in cols)
        if held is not None:
            yield held

    def near(key, part, side, node, fp):
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        sizes = np.diff(np.append(starts, len(node)))
        two_sided = np.add.reduceat(side, starts) > 0
        small = (sizes <= SMALL) & ~two_sided
        left, right, waiting = [], [], 0
        for size in np.unique(sizes[small & (sizes > 1)]):
            rows = starts[small & (sizes == size)][:, None] + np.arange(size)
            i, j = np.triu_indices(size, 1)
            step = max(1, 100_000 // len(i))
            for k in range(0, len(rows), step):
                left.append(rows[k : k + step, i].ravel())
                right.append(rows[k : k + step, j].ravel())
                waiting += len(left[-1])
                if waiting >= 200_000:
                    yield from _near_pairs(node, fp, np.concatenate(left), np.concatenate(right), radius)
                    left, right, waiting = [], [], 0
        if left:
            yield from _near_pairs(node, fp, np.concatenate(left), np.concatenate(right), radius)
        for g in np.flatnonzero(~small):
            s = slice(starts[g], starts[g] + sizes[g])
            if (side[s] == 0).any():
                yield from _near_of_block(node[s], fp[s], side[s], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in groups(batches):
            parent = _forest(near(*cols))
            # Least first, so that a node's parent has its root already: stars, which take fewer rounds of contraction than chains.
            for x in sorted(parent):
                parent[x] = parent[parent[x]]
            edges = [(x, p) for x, p in parent.items() if x != p]
            if edges:
                e = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["u", "v"])
        # The worker lives on, beside those of later stages.
        pa.default_memory_pool().release_unused()

    return run


def _links(node: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: float):
    """Links of the nodes of side 0 with those of side 1, or, where there is no side 1, of all pairs; none between nodes that others join."""
    two_sided = side.any()
    limit = Fraction(str(similarity))
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    _, columns = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(columns.max(initial=-1) + 1, np.int64)
    parent = np.arange(len(node))
    for i in np.flatnonzero(side == 0):
        others = parent != parent[i]
        if two_sided:
            others &= side == 1
        else:
            others[: i + 1] = False
        if not others.any():
            continue
        own = columns[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        # The empty set is one node and in no band, so every set here has members.
        shared = np.add.reduceat(mark[columns], starts)
        mark[own] = 0
        near = others & (shared * limit.denominator >= (sizes + sizes[i] - shared) * limit.numerator)
        parent[np.isin(parent, parent[near])] = parent[i]
        k = np.flatnonzero(near)
        yield np.full(len(k), node[i]), node[k]


def _link_batches(similarity: float):
    def groups(batches: Iterator[pa.RecordBatch]):
        """(side, node, set) of each group, which may begin in one batch and end in another; a node that repeated rows bring again counts once."""
        at, held = None, []
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("bucket", "part", "side", "node", "grams")]
            for bucket, part, side, node, grams in zip(*cols, strict=True):
                if (bucket, part) != at:
                    if held:
                        yield held
                    at, held = (bucket, part), []
                if not held or held[-1][:2] != (side, node):
                    held.append((side, node, np.frombuffer(grams, np.uint64)))
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            side, node = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
            if len(held) < 2 or side.all():
                continue
            parent = _forest(_links(node, [x[2] for x in held], side, similarity))
            edges = [(x, p) for x, p in parent.items() if x != p]
            if edges:
                e = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["u", "v"])

    return run


def _meets() -> Column:
    """Part ``own`` of ``parts`` meets parts own..parts-1 as side 0 and parts 0..own-1 as side 1; with itself it has one side only."""
    return F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct((F.least("own", q).cast("long") * F.col("parts") + F.greatest("own", q)).alias("part"), F.when(q < F.col("own"), 1).otherwise(0).alias("side")),
    )


def candidates(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, bucket): the nodes (node, bands, print) that pairs with a common band and within the radius join, and the group that those make."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    dealt = keys.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # The fingerprints of nodes without company go no further than this join.
    prints = nodes.select(F.col("node").alias("p_node"), "print")
    dealt = dealt.join(prints, F.col("node") == F.col("p_node")).select("key", "node", "print", F.explode(_meets()).alias("m"))
    dealt = dealt.select("key", F.col("m.part").alias("part"), F.col("m.side").cast("int").alias("side"), "node", "print")
    dealt = dealt.repartition(common.partitions(nodes.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    return connected_components(dealt.mapInArrow(_near_batches(radius_of(similarity)), "u long, v long")).withColumnRenamed("root", "bucket")


def near_links(rows: DataFrame, found: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v) edges that join the nodes which links join, of (bucket, node, size, doc_id, th), where (doc_id, th) is a row that has the node's text in the rows (doc_id, th, text)."""
    sizes = found.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("b")).where("n > 1")
    sizes = sizes.select("bucket", F.greatest(F.ceil(F.col("n") / BUCKET), F.ceil(F.col("b") / GROUP_BYTES)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = found.join(sizes, "bucket").withColumn("own", own).select("bucket", "node", "parts", "own", F.coalesce("doc_id", F.lit(0)).alias("w_id"), F.col("doc_id").isNull().alias("w_none"), F.col("th").alias("w_th"))
    # The text of each node's row: rows without candidates go no further than this join.
    texts = rows.select(F.coalesce("doc_id", F.lit(0)).alias("t_id"), F.col("doc_id").isNull().alias("t_none"), "th", "text")
    texts = texts.join(dealt, (F.col("th") == F.col("w_th")) & (F.col("t_id") == F.col("w_id")) & (F.col("t_none") == F.col("w_none")))
    sets = texts.select("bucket", "node", "parts", "own", "text").mapInArrow(_gram_batches(shingle), "bucket long, node long, parts int, own int, grams binary")
    sets = sets.select("bucket", "node", "grams", F.explode(_meets()).alias("m")).select("bucket", F.col("m.part").alias("part"), F.col("m.side").cast("int").alias("side"), "node", "grams")
    sets = sets.repartition(common.partitions(rows.sparkSession), "bucket", "part").sortWithinPartitions("bucket", "part", "side", "node")
    return sets.mapInArrow(_link_batches(similarity), "u long, v long")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row, with its own columns, of each group of near duplicates: that of the least id (rows without id come last), once where it is repeated."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    text_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash.alias("th"), F.col(text_col).cast("binary").alias("text"))
    known = rows.mapInArrow(_band_batches(shingle, similarity), "doc_id long, th long, node long, bands array<long>, print binary, size long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    nodes, nodes_path = common.written(known.groupBy("node").agg(first, F.first("bands").alias("bands"), F.first("print").alias("print"), F.first("size").alias("size")))
    groups = candidates(nodes, similarity)
    found, found_path = common.written(nodes.join(groups.withColumnRenamed("node", "g_node"), F.col("node") == F.col("g_node")).select("bucket", "node", "size", "first.doc_id", "first.th"))
    roots = connected_components(near_links(rows, found, shingle, similarity)).withColumnRenamed("node", "r_node")
    named = nodes.join(roots, F.col("node") == F.col("r_node"), "left").select("first", F.coalesce("root", "node").alias("root"))
    keep = named.groupBy("root").agg(F.min("first").alias("k")).select(F.coalesce("k.doc_id", F.lit(0)).alias("__kept"), F.col("k.none").alias("__kept_none"), F.col("k.th").alias("__kept_th"))
    keep, _ = common.written(keep)
    for path in (nodes_path, found_path):
        common.drop(spark, path)
    own = docs.withColumns({"__th": text_hash, "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__none": F.col(id_col).isNull()})
    same = (F.col("__id") == F.col("__kept")) & (F.col("__none") == F.col("__kept_none")) & (F.col("__th") == F.col("__kept_th"))
    kept = own.join(keep, same, "left_semi")
    # Only rows whose id and text are repeated are brought together.
    often, _ = common.written(kept.groupBy("__id", "__none", "__th").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if not often.isEmpty():
        keys = ["__id", "__none", "__th"]
        kept = kept.join(often, keys, "left_anti").unionByName(kept.join(often, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
