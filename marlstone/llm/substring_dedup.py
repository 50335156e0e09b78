"""Operator 6: substring dedup by relative Lempel-Ziv parsing.

Every document is factored greedily against reference text: all documents before it, and its own earlier words. The reference is indexed in blocks by
anchors and a document meets every block in which one of its anchors is indexed, so no factor of ``window`` words or more is missed:

* The anchor of a window is the word ``gram``-gram in it with the least hash, a choice that depends on the window's words alone, so equal windows have
  equal anchors at equal places. Windows that follow each other mostly share their anchor: one index row holds an anchor's hash, the document, the
  first window and a check of ``CHECK_BITS`` bits of each window.
* Rows are dealt to index blocks by anchor. A block runs through its rows in order of (anchor, document, start); a window that has been there is a
  candidate copy, with the place of its first occurrence as its source. Candidates of one document on one diagonal (same source, same distance) that
  touch are one match, the longest copy there.
* The parse goes from word to word: at a word, the match that reaches farthest becomes a factor and the parse goes on behind it; at a factor's boundary
  the matches that begin inside the factor and reach beyond it are tried first, so no window that crosses the boundary is lost. The words under
  factors go.
* A match counts only if its words are those of its source. Both sides hash their words with 128 bits, in cells of ``CELL`` words of the source, while
  the parse cuts the document. Matches with cells that differ (two windows of an anchor had one check) are dissolved, their windows are
  compared by 128 bits with each other and with their sources, and the documents that they belong to are parsed again. So checks decide where to look,
  never what goes.

Before the shuffle every batch resolves the windows that recur within it, comparing their words, and sends only their first occurrences, so a
passage that a third of all documents hold meets in a block once per batch, not once per document. An anchor with many different windows (a common
phrase in ever new surroundings) is found in a sample and dealt by its windows instead; where a phrase is not seen in the sample the result is the same. So a
task remembers only the distinct windows of one anchor of bounded size.

Judged on the input: "earlier" is a smaller doc_id, or the same doc_id and a smaller start. Defined results: null and empty texts have no words;
where ids are null or repeated, documents of one id (null is the last id) stand in the order of a hash of their texts, and rows of the same id and
text are one document, so their equal places are not earlier than one another and keep their words alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from . import common

WINDOW, GRAM = 20, 6
#: Bits of a window's hash that an index row holds; fewer only make more candidates.
CHECK_BITS = 32
#: Words that one chunk of documents holds; a longer document is cut into chunks that overlap.
CHUNK = 300_000
#: Words of a source that are hashed and compared together.
CELL = 64
#: Documents sampled for common anchors: HOT_DOCS of them, or one in HOT_SHARE where that is more. An anchor with HOT_SEEN different windows in the sample
#: is dealt by window; of the HOT_LIST most frequent ones at most, so one that is not has at most 1 / HOT_LIST of all index rows.
HOT_DOCS, HOT_SHARE, HOT_SEEN, HOT_LIST = 4096, 4096, 32, 1_000_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_hashes = common.WordMemo(lambda words: {w: xxhash.xxh64_intdigest(w, 7) for w in words}, 250_000, "substrings")

INDEX_SCHEMA = "h long, dkey long, start int, n int, checks binary, src long, src_start int"
_INDEX = pa.schema([("h", pa.int64()), ("dkey", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("checks", pa.binary()), ("src", pa.int64()), ("src_start", pa.int32())])
RUN_SCHEMA = "dkey long, start int, n int, src long, src_start int"
_RUN = pa.schema([("dkey", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("src", pa.int64()), ("src_start", pa.int32())])
_MATCH = "array<struct<start:int,n:int,src:long,src_start:int>>"
_PROOF = "array<struct<src:long,at:int,n:int,h1:long,h2:long>>"


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base = int(_BASES[which])
        size = 1 << n.bit_length()
        have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        _powers[which] = have
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(words: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    up, down = _power(which, len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    n = len(words) - length + 1
    return _mixed((sums[length:] - sums[:n]) * down[:n])


def _runs(flag_break: np.ndarray) -> np.ndarray:
    """Starts of runs, given for each element whether it does not continue the one before."""
    flag_break[0] = True
    return np.flatnonzero(flag_break)


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _anchors(grams: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """For each window start the place of its least gram (the first of equal ones), in blocks that bound the memory."""
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    out = np.empty(len(at), np.int64)
    for i in range(0, len(at), 65_536):
        out[i : i + 65_536] = view[at[i : i + 65_536]].argmin(axis=1)
    return out + at


def _index_chunk(keys: list[int], texts: list[list[bytes]], offset: int, window: int, gram: int, bits: int, hot: np.ndarray) -> list[pa.RecordBatch]:
    """The index rows of documents with distinct keys in ascending order (``offset``: the words before the only one): the first occurrence of each window,
    and rows without checks for the windows that are resolved here."""
    sizes = np.array([len(t) for t in texts], np.int64)
    hashed = np.concatenate([np.fromiter(map(_hashes.getter(), t), np.uint64, len(t)) for t in texts])
    firsts = np.cumsum(sizes) - sizes
    doc_of = np.repeat(np.arange(len(texts)), sizes - window + 1)
    at = _ragged(sizes - window + 1) + np.repeat(firsts, sizes - window + 1)
    if not len(at):
        return []
    full = _rolling(hashed, window, 0)[at]
    grams = _rolling(hashed, gram, 1)
    anchors = _anchors(grams, at, window - gram + 1)
    order = np.argsort(full, kind="stable")
    fresh = np.ones(len(order), bool)
    sorted_full = full[order]
    fresh[1:] = sorted_full[1:] != sorted_full[:-1]
    first_of = np.empty(len(order), np.int64)
    first_of[order] = np.repeat(order[fresh], np.diff(np.append(np.flatnonzero(fresh), len(order))))
    key = np.array(keys, np.int64)
    start = at - firsts[doc_of] + offset
    out = []
    new = first_of == np.arange(len(order))
    i = np.flatnonzero(~new)
    if len(i):
        src = first_of[i]
        s = _runs(np.concatenate([[True], (np.diff(at[i]) != 1) | (np.diff(at[src]) != 1) | (np.diff(doc_of[i]) != 0) | (np.diff(doc_of[src]) != 0)]))
        n = np.diff(np.append(s, len(i)))
        # The words themselves are compared; a run with any difference goes to the index like what is new.
        spans = n + window - 1
        off = _ragged(spans)
        differs = hashed[np.repeat(at[i[s]], spans) + off] != hashed[np.repeat(at[src[s]], spans) + off]
        same = ~np.logical_or.reduceat(differs, np.cumsum(spans) - spans)
        new[i] = np.repeat(~same, n)
        head, source, n = i[s][same], src[s][same], n[same]
        spread = _mixed(key[doc_of[head]].view(np.uint64) + start[head].astype(np.uint64)).view(np.int64)
        none = pa.nulls(len(head)).cast(pa.binary())
        out.append(pa.RecordBatch.from_arrays([pa.array(spread), pa.array(key[doc_of[head]]), pa.array(start[head].astype(np.int32)), pa.array(n.astype(np.int32)), none, pa.array(key[doc_of[source]]), pa.array(start[source].astype(np.int32))], schema=_INDEX))
    # Windows seen for the first time in this chunk, by anchor; those of common anchors one by one.
    i = np.flatnonzero(new)
    h = grams[anchors[i]].view(np.int64)
    alone = np.zeros(len(i), bool)
    if len(hot):
        alone = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        h = np.where(alone, _mixed(h.view(np.uint64) ^ full[i]).view(np.int64), h)
    s = _runs(np.concatenate([[True], alone[1:] | alone[:-1] | (np.diff(at[i]) != 1) | (np.diff(anchors[i]) != 0) | (np.diff(doc_of[i]) != 0)]))
    n = np.diff(np.append(s, len(i)))
    checks = (full[i] >> np.uint64(64 - bits)).astype("<u4")
    offsets = np.append(s, len(i)).astype(np.int32) * 4
    blob = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(checks.tobytes())])
    head = i[s]
    none = pa.nulls(len(s))
    out.append(pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(key[doc_of[head]]), pa.array(start[head].astype(np.int32)), pa.array(n.astype(np.int32)), blob, none.cast(pa.int64()), none.cast(pa.int32())], schema=_INDEX))
    return out


def _index_batches(window: int, gram: int, bits: int, hot):
    """``hot``: a broadcast of the sorted hashes of the anchors that are dealt by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_anchors = hot.value if hot is not None else np.zeros(0, np.int64)
        tail = (window, gram, bits, common_anchors)
        for b in batches:
            keys, texts, held = [], [], 0
            column = b.column("text")
            for i in b.column("dkey").to_numpy().argsort(kind="stable").tolist():
                words = (column[i].as_py() or b"").split()
                if len(words) < window:
                    continue
                key = b.column("dkey")[i].as_py()
                if keys and (held + len(words) > CHUNK or key == keys[-1]):
                    yield from _index_chunk(keys, texts, 0, *tail)
                    keys, texts, held = [], [], 0
                if len(words) > CHUNK:
                    for a in range(0, len(words) - window + 1, CHUNK):
                        yield from _index_chunk([key], [words[a : a + CHUNK + window - 1]], a, *tail)
                    continue
                keys.append(key)
                texts.append(words)
                held += len(words)
            if keys:
                yield from _index_chunk(keys, texts, 0, *tail)

    return run


def _match_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows in order of (h, dkey, start) to runs of windows that occur earlier, with their sources."""
    carried_h = None
    carried = tuple(np.zeros(0, t) for t in (np.uint32, np.int64, np.int32))  # the distinct windows of the last anchor
    for b in batches:
        done = b.column("checks").is_null().to_numpy(zero_copy_only=False)
        if done.any():
            yield pa.RecordBatch.from_arrays([b.column(n).filter(pa.array(done)) for n in _RUN.names], schema=_RUN)
        if done.all():
            continue
        keep = np.flatnonzero(~done)
        h, dkey, start, n = (b.column(c).to_numpy(zero_copy_only=False)[keep] for c in ("h", "dkey", "start", "n"))
        same = np.concatenate([[False], h[1:] == h[:-1]])
        group = np.cumsum(~same)  # from 1; 0 is the anchor carried over, if it goes on
        if carried_h is not None and h[0] == carried_h:
            group -= 1
        else:
            carried = tuple(c[:0] for c in carried)
        many = same | np.append(same[1:], False) | (group == 0) | (group == group[-1])
        r = np.flatnonzero(many)
        column = b.column("checks")
        checks = np.frombuffer(b"".join([column[int(i)].as_py() for i in keep[r]]), "<u4")
        counts = n[r].astype(np.int64)
        off = _ragged(counts)
        c_group = np.concatenate([np.zeros(len(carried[0]), np.int64), np.repeat(group[r], counts)])
        c_check = np.concatenate([carried[0], checks])
        c_key = np.concatenate([carried[1], np.repeat(dkey[r], counts)])
        c_start = np.concatenate([carried[2], (np.repeat(start[r], counts) + off).astype(np.int32)])
        code = (c_group.astype(np.uint64) << np.uint64(32)) | c_check.astype(np.uint64)
        order = np.argsort(code, kind="stable")
        head = np.concatenate([[True], code[order][1:] != code[order][:-1]])
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(order))))
        dup = (first != np.arange(len(order))) & ((c_key != c_key[first]) | (c_start != c_start[first]))
        dup[: len(carried[0])] = False
        i = np.flatnonzero(dup)
        if len(i):
            f = first[i]
            s = _runs(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(c_key[i]) != 0) | (np.diff(c_start[i]) != 1) | (np.diff(c_key[f]) != 0) | (np.diff(c_start[f]) != 1)]))
            yield pa.RecordBatch.from_arrays([pa.array(c_key[i[s]]), pa.array(c_start[i[s]]), pa.array(np.diff(np.append(s, len(i))).astype(np.int32)), pa.array(c_key[f[s]]), pa.array(c_start[f[s]])], schema=_RUN)
        last = order[head & (c_group[order] == group[-1])]
        carried_h = h[-1]
        carried = (c_check[last], c_key[last], c_start[last])


def _joined_runs(window: int):
    """(dkey, runs of windows) to (dkey, matches): runs of one diagonal whose words touch are one match of n words; matches stand in order of their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column("runs")
            sizes = np.diff(runs.offsets.to_numpy())
            start, n, src, src_start = (runs.flatten().field(k).to_numpy().astype(np.int64) for k in range(4))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            shift = src_start - start
            order = np.lexsort((start, shift, src, doc))
            doc, src, shift, start, end = doc[order], src[order], shift[order], start[order], (start + n + window - 1)[order]
            diagonal = np.concatenate([[0], np.cumsum((np.diff(doc) != 0) | (np.diff(src) != 0) | (np.diff(shift) != 0))])
            far = end.max(initial=0) + 1
            reach = np.maximum.accumulate(end + diagonal * far) - diagonal * far
            head = _runs(np.concatenate([[True], (np.diff(diagonal) != 0) | (start[1:] > reach[:-1])]))
            end = np.maximum.reduceat(end, head) if len(head) else end
            doc, src, shift, start = doc[head], src[head], shift[head], start[head]
            order = np.lexsort((src, -end, start, doc))
            doc, src, shift, start, end = doc[order], src[order], shift[order], start[order], end[order]
            fields = [pa.array(start, pa.int32()), pa.array(end - start, pa.int32()), pa.array(src), pa.array(start + shift, pa.int32())]
            flat = pa.StructArray.from_arrays(fields, ["start", "n", "src", "src_start"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sizes)))])
            yield pa.RecordBatch.from_arrays([b.column("dkey"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["dkey", "matches"])

    return run


def matched(runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(dkey, matches) of the runs; a document has no more runs than words."""
    per = runs.groupBy("dkey").agg(F.collect_list(F.struct("start", "n", "src", "src_start")).alias("runs"))
    return per.mapInArrow(_joined_runs(window), f"dkey long, matches {_MATCH}")


def factors(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The greedy parse: (start, end) of the factors, given those of the matches in order of their starts."""
    out: list[tuple[int, int]] = []
    end = i = 0
    while i < len(matches):
        at = max(end, matches[i][0])  # the next word that begins a match, or the boundary that matches may cross
        best = (0, end)
        while i < len(matches) and matches[i][0] <= at:
            if matches[i][1] > best[1]:
                best = matches[i]
            i += 1
        if best[1] > end:
            out.append(best)
            end = best[1]
    return out


def _cells(start: int, n: int) -> list[tuple[int, int]]:
    """(start, words) of a source's span, cut at the multiples of CELL."""
    cuts = [start, *range(start - start % CELL + CELL, start + n, CELL), start + n]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _cut_batches(window: int, texts: bool):
    """Rows with their matches and the cells that others ask for, to the result and the hashes of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, removed, shas, counts, kept_texts, sizes = [], [], [], [], [], []
            proved: list[list[int]] = [[], [], []]
            digests: list[bytes] = []
            asked = b.column("asked")
            for i, x in enumerate(b.column("text")):
                words = (x.as_py() or b"").split()
                n_words.append(len(words))
                before = len(digests)
                kept, cut = words, []
                if own := b.column("matches")[i].as_py():
                    cut = factors([(m["start"], m["start"] + m["n"]) for m in own])
                    kept, at = [], 0
                    for a, e in cut:
                        kept += words[at:a]
                        at = max(at, e)
                    kept += words[at:]
                    for m in own:
                        shift = m["start"] - m["src_start"]
                        for a, n in _cells(m["src_start"], m["n"]):
                            for col, v in zip(proved, (m["src"], a, n), strict=True):
                                col.append(v)
                            digests.append(_digest(words[a + shift : a + shift + n]))
                if asked[i].is_valid:
                    key = b.column("dkey")[i].as_py()
                    for q in asked[i].as_py():
                        for col, v in zip(proved, (key, q["at"], q["n"]), strict=True):
                            col.append(v)
                        digests.append(_digest(words[q["at"] : q["at"] + q["n"]]))
                sizes.append(len(digests) - before)
                removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                shas.append(hashlib.sha256(joined).hexdigest())
                counts.append(len(cut))
                if texts:
                    kept_texts.append(joined.decode("utf-8", "replace"))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            fields = [pa.array(proved[0], pa.int64()), pa.array(proved[1], pa.int32()), pa.array(proved[2], pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            proofs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(fields, ["src", "at", "n", "h1", "h2"]))
            cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(counts, pa.int64()), b.column("dkey"), proofs]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "dkey", "proofs"]
            if texts:
                cols.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _window_batches(window: int):
    """(dkey, text, starts) to (dkey, start, h1, h2): 128 bits of the windows at the starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, x, starts in zip(b.column("dkey").to_pylist(), b.column("text"), b.column("starts").to_pylist(), strict=True):
                words = x.as_py().split()
                halves = np.frombuffer(b"".join(_digest(words[s : s + window]) for s in starts), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(starts), pa.int64()), pa.array(starts, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["dkey", "start", "h1", "h2"])

    return run


def _common_anchors(rows: DataFrame, n_docs: int, window: int, gram: int, bits: int):
    """A broadcast of the anchors with many different windows, by a sample of the documents: at most HOT_LIST numbers."""
    part = max(1, min(1 << 20, (1 << 20) * max(HOT_DOCS, n_docs // HOT_SHARE) // max(1, n_docs)))
    index = rows.where(F.pmod(F.xxhash64("dkey"), F.lit(1 << 20)) < part).mapInArrow(_index_batches(window, gram, bits, None), INDEX_SCHEMA).where("checks IS NOT NULL")
    seen = index.select("h", F.substring("checks", 1, 4).alias("c")).distinct().groupBy("h").agg(F.count("*").alias("n"))
    most = seen.where(F.col("n") >= HOT_SEEN).orderBy(F.desc("n"), "h").limit(HOT_LIST).select("h").toArrow()
    return rows.sparkSession.sparkContext.broadcast(np.sort(most.column("h").to_numpy()))


def duplicate_runs(docs: DataFrame, n_docs: int, window: int = WINDOW, gram: int = GRAM, bits: int = CHECK_BITS) -> DataFrame:
    """(dkey, start, n, src, src_start) of (dkey, text): n windows from start have the checks of earlier ones, from src_start on in src."""
    hot = _common_anchors(docs, n_docs, window, gram, bits)
    index = docs.mapInArrow(_index_batches(window, gram, bits, hot), INDEX_SCHEMA)
    n = common.partitions(docs.sparkSession)
    blocks = index.repartition(n, "h").sortWithinPartitions("h", "dkey", "start")
    return blocks.mapInArrow(_match_batches, RUN_SCHEMA)


def _placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(doc_id, dkey, text) and the number of rows. dkey is the id itself or, where ids are null or repeated, the place of (id, hash of the text) among all."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    got = ids.agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    if got["none"] == 0 and (got["most"] or 1) == 1:
        return rows.withColumn("dkey", F.col("doc_id")), got["rows"] or 0
    spark = docs.sparkSession
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(b""))))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("th")]
    each = rows.select("doc_id", "th").distinct().repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    each, _ = common.written(each.select("doc_id", "th", F.monotonically_increasing_id().alias("m")))
    # One row for each partition.
    sizes = {r["p"]: r["n"] for r in each.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, firsts = 0, []
    for p in sorted(sizes):
        firsts.append((p, before))
        before += sizes[p]
    firsts = spark.createDataFrame(firsts, "p long, before long")
    places = each.join(F.broadcast(firsts), F.shiftright("m", 33) == F.col("p")).select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), (F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("dkey"))
    placed = rows.join(places, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th"))).select("doc_id", "dkey", "text")
    return common.written(placed)[0], got["rows"]


def _cut(rows: DataFrame, found: DataFrame, window: int, texts: bool) -> DataFrame:
    """The result of the rows (doc_id, dkey, text) under the matches, with the hashes of the matches' words and of their sources', written."""
    spans = found.select(F.explode("matches").alias("m")).select("m.src", "m.src_start", (F.col("m.src_start") + F.col("m.n")).alias("stop"))
    cell = F.transform(
        F.sequence(F.floor(F.col("src_start") / CELL).cast("int"), F.floor((F.col("stop") - 1) / CELL).cast("int")),
        lambda c: F.struct(F.greatest(c * CELL, "src_start").alias("at"), (F.least((c + 1) * CELL, "stop") - F.greatest(c * CELL, "src_start")).alias("n")),
    )
    # A source is asked for at most one cell a start and one a stop, besides the pieces within one cell, however many copies it has.
    asked = spans.distinct().select(F.col("src").alias("a_dkey"), F.explode(cell).alias("q")).distinct().groupBy("a_dkey").agg(F.collect_list("q").alias("asked"))
    own = found.withColumnRenamed("dkey", "m_dkey")
    joined = rows.join(own, F.col("dkey") == F.col("m_dkey"), "left").join(asked, F.col("dkey") == F.col("a_dkey"), "left").select("doc_id", "dkey", "text", "matches", "asked")
    schema = f"doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, dkey long, proofs {_PROOF}" + ", kept_text string" * texts
    return common.written(joined.mapInArrow(_cut_batches(window, texts), schema))[0]


def _true_runs(rows: DataFrame, found: DataFrame, bad: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Runs, one for each window, of the documents with matches on ``bad`` cells (src, at, size), and those documents: windows of good cells are as found,
    the others are told by 128 bits of their words."""
    each = found.select("dkey", F.explode("matches").alias("m")).select("dkey", "m.*")
    wrong = each.join(bad, "src").where((F.col("at") < F.col("src_start") + F.col("n")) & (F.col("at") + F.col("size") > F.col("src_start")))
    docs = wrong.select("dkey").distinct()
    window_of = lambda c: F.explode(F.sequence(F.lit(0), F.col("n") - window)).alias(c)
    all_windows = each.join(docs, "dkey", "left_semi").select("*", window_of("k")).select("dkey", (F.col("start") + F.col("k")).alias("start"), "src", (F.col("src_start") + F.col("k")).alias("src_start"))
    low = F.greatest(F.col("src_start"), F.col("at") - window + 1)
    high = F.least(F.col("src_start") + F.col("n") - window, F.col("at") + F.col("size") - 1)
    doubtful = wrong.where(low <= high).select("dkey", "start", "src", "src_start", F.explode(F.sequence(low, high)).alias("s"))
    doubtful = doubtful.select("dkey", (F.col("start") + F.col("s") - F.col("src_start")).alias("start"), "src", F.col("s").alias("src_start")).distinct()
    doubtful, _ = common.written(doubtful)
    wanted = doubtful.select("dkey", "start").union(doubtful.select("src", "src_start")).distinct()
    wanted = wanted.groupBy(F.col("dkey").alias("w_dkey"), F.floor(F.col("start") / 4096).alias("part")).agg(F.collect_list("start").alias("starts"))
    texts = rows.join(wanted, F.col("dkey") == F.col("w_dkey")).select("dkey", "text", "starts")
    hashed, _ = common.written(texts.mapInArrow(_window_batches(window), "dkey long, start int, h1 long, h2 long").distinct())
    first = hashed.groupBy("h1", "h2").agg(F.min(F.struct("dkey", "start")).alias("f"))
    again = hashed.join(first, ["h1", "h2"]).where(F.struct("dkey", "start") > F.col("f")).select("dkey", "start", F.col("f.dkey").alias("src"), F.col("f.start").alias("src_start"))
    good = all_windows.join(doubtful, ["dkey", "start"], "left_anti")
    runs = good.unionByName(again.join(docs, "dkey", "left_semi"))
    return runs.select("dkey", "start", F.lit(1).alias("n"), "src", "src_start"), docs


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, texts: bool = False, check_bits: int = CHECK_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_factors[, kept_text]) for every row."""
    common.bound_batches(docs.sparkSession)
    rows, n_docs = _placed(docs, id_col, text_col)
    found, _ = common.written(matched(duplicate_runs(rows.select("dkey", "text"), n_docs, window, gram, check_bits), window))
    done = _cut(rows, found, window, texts)
    public = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"] + ["kept_text"] * texts
    proofs = done.select(F.explode("proofs").alias("p")).select("p.*")
    differ = proofs.groupBy("src", "at", "n").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("h1", "h2")])
    bad, _ = common.written(differ.where("min_h1 <> max_h1 OR min_h2 <> max_h2").select("src", "at", F.col("n").alias("size")))
    if bad.isEmpty():
        return done.select(*public)
    runs, again = _true_runs(rows, found, bad, window)
    mended, _ = common.written(matched(runs, window))
    again, _ = common.written(again)
    kept = done.join(again, "dkey", "left_anti").select(*public)
    return kept.unionByName(_cut(rows.join(again, "dkey", "left_semi"), mended, window, texts).select(*public))


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("n_factors")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 19), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
d AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS at FROM d),
x AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
l AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.at WHERE c.at IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(l.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN l ON w.doc_id = l.doc_id
"""
