"""Operator 2: best-fit packing into sequences of a fixed number of tokens.

Documents are tokenized whole, end with id 0, and are cut only where longer than a sequence; the
pieces are what is packed. Best fit runs in bulk-synchronous rounds. In a round, all pieces that have no place yet and all open gaps are sorted by size, the largest first, and dealt
to tasks by ranges of sizes. A task sweeps through its range: a gap goes on a stack, and a piece takes the gap on its top, which is the successor of its length, the smallest of those that hold
it. Pieces of one length want the same gaps: by rank, a gap that holds q of them takes the next q (it would stay the smallest that holds one), the next gap the ones after those. Pieces that find no
gap in their range, and gaps that no piece took, go to a second sweep over what all ranges left, which gives what one sweep over everything would. Then gaps shrink by what they took and the next
round follows, until no piece is left. At the start as many sequences are
opened as the tokens or the pieces of over half a sequence need at least; when a round places nothing, as many more as what is left needs.

Since lengths are whole numbers up to the capacity, pieces and gaps of equal size are runs: "pieces r0..r1 of length L", "sequences b0..b1 with a gap of g". Rounds work on runs. A round makes at
most as many runs of gaps more as there are lengths, so their number depends on the capacity and not on the number of documents; the driver keeps
them between the rounds, and a task that is lost is run again from there. Rows never leave the executors: they get their rank within their length from counts of hash ranges and a
running number within each, and look their run up in the rounds' matches.

``schedule`` is sequential best-fit decreasing on the same runs, by which the tests judge the number of sequences.

Defined results: a null or empty text is the single id 0; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from . import common

CAPACITY = 2048
#: Pieces that one hash range of a length holds on average; a length that many pieces share has many ranges.
RANGE_ROWS = 200
#: Ranges of sizes that a round is dealt to.
SIZE_RANGES = 8
#: Words of these characters only need no canonical composition, hold no white space and have plain lower case.
_PLAIN = r"^[!-~\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}]*$"
_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of the texts whose words are looked up together; a longer text stands alone.
TEXTS_BYTES = 4 << 20

_encoders: dict = {}


def byte_ranks(model: dict) -> tuple[dict[bytes, int], list[int]] | None:
    """A word BPE model's tokens as bytes, a line feed for the end of a word, with their ranks in order of merging, and the id of each rank; None where merging whatever
    two tokens make one of the least rank could differ from the model, which merges only the pairs that it lists.

    It cannot where each token has one pair, that of earlier tokens, and the model makes of a token's characters that token: were two others to make it within a word, no merge had crossed its ends, and
    its characters alone would have come to those two as well."""
    from tokenizers import models

    shown = _shown()
    byte = {c: bytes([b]) for b, c in shown.items()}
    end, vocab = "</w>", model["vocab"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != end or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    names = [*shown.values(), *(c + end for c in shown.values())]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    known = set(names)
    for a, b in merges:
        if a not in known or b not in known or a.endswith(end) or a + b in known:
            return None
        known.add(a + b)
        names.append(a + b)
    if not known <= vocab.keys():
        return None
    inner, last = models.BPE(vocab, merges), models.BPE(vocab, merges, end_of_word_suffix=end)
    for t in names[512:]:
        got = last.tokenize(t.removesuffix(end)) if t.endswith(end) else inner.tokenize(t)
        if [x.value for x in got] != [t]:
            return None
    ranks = {b"".join(map(byte.__getitem__, t.removesuffix(end))) + b"\n" * t.endswith(end): i for i, t in enumerate(names)}
    return (ranks, [vocab[t] for t in names]) if len(ranks) == len(names) else None


def _shown() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _WordEncoder:
    """Ids of white-space-separated words for the lower-casing word BPE.

    That tokenizer's pre-tokens never hold white space and its normalization never crosses it, so a
    text's ids are its words' ids in order. The distinct words of some texts are found, lower-cased and cut into pre-tokens by Arrow, and their pre-tokens are merged in one call, where they are of plain
    characters; all others take the tokenizer's whole way, as all do where ``byte_ranks`` finds that the call could differ from the tokenizer."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            found = byte_ranks(json.load(f)["model"])
        self.merge = None
        if found:
            from tiktoken import _tiktoken

            self.merge = _tiktoken.CoreBPE(found[0], {}, r"[^\n]+\n").encode_to_tiktoken_buffer
            self.ids = np.array(found[1], "<u4")
            self.ends = np.array([t.endswith(b"\n") for t in found[0]])
        self.odd = common.WordMemo(None, 150_000, "packing", self._whole)

    def _whole(self, word: str) -> bytes:
        return array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain characters, one after the other, and where each word's end."""
        cut = pc.replace_substring_regex(pc.utf8_lower(words), _PRE_TOKEN, "\\0\n")
        at = np.frombuffer(cut.buffers()[1], np.int64)[cut.offset : cut.offset + len(cut) + 1]
        text = str(memoryview(cut.buffers()[2] or b"")[at[0] : at[-1]], "utf-8")
        ranks = np.frombuffer(self.merge(text, set()), np.uint32) if text else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ranks]) + 1])
        return self.ids[ranks], ends[np.cumsum(pc.count_substring(cut, "\n").to_numpy())]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word begin and end."""
        plain = pc.match_substring_regex(words, _PLAIN) if self.merge else pa.array([False] * len(words))
        if self.merge:
            plain = pc.and_not(plain, pc.match_substring(words, "<|"))
        is_plain = plain.to_numpy(zero_copy_only=False)
        ids, ends = self._merged(words.filter(plain)) if self.merge else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if is_plain.all():
            return ids, np.concatenate([[0], ends[:-1]]), ends
        whole = list(map(self.odd.getter(), words.filter(pc.invert(plain)).to_pylist()))
        more = len(ids) + np.cumsum([len(x) // 4 for x in whole])
        begin, end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[is_plain], end[is_plain] = np.concatenate([[0], ends])[: len(ends)], ends
        begin[~is_plain], end[~is_plain] = np.concatenate([[len(ids)], more[:-1]]), more
        return np.concatenate([ids, np.frombuffer(b"".join(whole), "<u4")]), begin, end

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null one has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        ids, begin, end = self._distinct(coded.dictionary)
        code = coded.indices.to_numpy()
        n = (end - begin)[code]
        to = np.cumsum(n)
        # The place of each id among the distinct words' ids: steps of one within a word.
        place = np.repeat(begin[code] - to + n, n)
        place += np.arange(len(place))
        ends = np.concatenate([[0], to])[np.cumsum(pc.list_value_length(words).to_numpy())]
        return np.split(ids[place], ends)[:-1]

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text], pa.string()))[0].tobytes()


def encoder(path: str) -> _WordEncoder:
    if path not in _encoders:
        _encoders[path] = _WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of texts in a row that hold ``TEXTS_BYTES`` at most, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, TEXTS_BYTES + (ends[at - 1] if at else 0), side="right")))
        yield at, end
        at = end


def _cut_batches(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or default_tokenizer())
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            docs, texts = b.column(0).to_pylist(), b.column(1)
            for first, end in _groups(texts):
                for doc, own in zip(docs[first:end], encode.many(texts.slice(first, end - first)), strict=True):
                    ids = own.tobytes() + b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for col, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; tokenizer: the file's path on the executors
    (None: the public word BPE, looked up there)."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_cut_batches(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def schedule(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over runs: (length, first rank, pieces, first sequence, offset), where the k-th of these pieces goes
    to the k-th sequence from the first; the histogram gives the number of pieces of each length."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap size: runs (first sequence, sequences), the earliest on top
    sizes: list[int] = []
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            heappush(gaps[gap], (first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                gap = sizes[i]
                first, n = heappop(gaps[gap])
                used = min(n, left)
                if used < n:
                    heappush(gaps[gap], (first + used, n - used))
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(i)
                plan.append((length, rank, used, first, capacity - gap))
                add(gap - length, first, used)
                rank, left = rank + used, left - used
                continue
            # No gap holds it. Best fit would fill a new sequence with this length before it opens the next.
            per = capacity // length
            full, rest = divmod(left, per)
            for k in range(per):
                if full:
                    plan.append((length, rank + k * full, full, opened, k * length))
            add(capacity - per * length, opened, full)
            rank, opened = rank + per * full, opened + full
            for k in range(rest):
                plan.append((length, rank + k, 1, opened, k * length))
            if rest:
                add(capacity - rest * length, opened, 1)
                opened += 1
            left = 0
    return plan


_RUNS = "kind int, size int, first long, n long, seq long, gap int"
_RUN = pa.schema([("kind", pa.int32()), ("size", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("seq", pa.int64()), ("gap", pa.int32())])
GAP, PIECES, MATCH, SHRUNK = 0, 1, 2, 3


def sweep(runs: list[tuple[int, int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """(matches, runs) of runs (kind, size, first, n) in order of size, the largest first, gaps before pieces: what is left, and the gaps that shrank. A match is (length, first rank,
    n, first sequence, gap), where the k-th piece from that rank goes to the k-th sequence."""
    stack: list[list[int]] = []
    matches, left, shrunk = [], [], []
    for kind, size, first, n in runs:
        if kind == GAP:
            stack.append([size, first, n])
            continue
        while n and stack:
            gap, seq, open_ = stack[-1]
            each = min(gap // size, n)
            took = min(n // each, open_)
            matches += [(size, first + j * took, took, seq, gap - j * size) for j in range(each)]
            shrunk.append((SHRUNK, gap - each * size, seq, took))
            first, n = first + each * took, n - each * took
            if took == open_:
                stack.pop()
            else:
                stack[-1] = [gap, seq + took, open_ - took]
        if n:
            left.append((PIECES, size, first, n))
    return matches, left + [(GAP, *g) for g in stack] + shrunk


def _sweep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of one or more ranges to matches and what is left in each range; what an earlier sweep matched and shrank passes."""
    parts: dict[int, list] = {}
    for b in batches:
        kind = b.column("kind").to_numpy()
        done = pa.array(kind >= MATCH)
        yield pa.RecordBatch.from_arrays([b.column(c).filter(done) for c in _RUN.names], schema=_RUN)
        rows = zip(*(b.column(c).to_pylist() for c in ("part", "kind", "size", "first", "n")), strict=True)
        for part, k, *rest in rows:
            if k < MATCH:
                parts.setdefault(part, []).append((k, *rest))
    for runs in parts.values():
        matches, left = sweep(runs)
        out = [(MATCH, length, first, n, seq, gap) for length, first, n, seq, gap in matches] + [(*r, None, None) for r in left]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RUN.types, strict=True)], schema=_RUN)


def _round(spark, gaps: list[tuple[int, int, int]], pieces: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(matches, gaps, pieces left) of one round over runs (size, first, n)."""
    runs = sorted([(GAP, *g) for g in gaps] + [(PIECES, *p) for p in pieces], key=lambda r: (-r[1], r[0], r[2]))
    step = -(-len(runs) // SIZE_RANGES)
    # A range begins where a size does.
    part, parts = 0, []
    for i, r in enumerate(runs):
        if i >= (part + 1) * step and r[1] != runs[i - 1][1]:
            part = i // step
        parts.append(part)
    columns = [pa.array(parts, pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*runs, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))]
    table_ = spark.createDataFrame(pa.table(columns, ["part", "kind", "size", "first", "n"])).withColumns({"seq": F.lit(None).cast("long"), "gap": F.lit(None).cast("int")})
    order = [F.desc("size"), "kind", "first"]
    ranges = table_.repartition(SIZE_RANGES, "part").sortWithinPartitions("part", *order).mapInArrow(_sweep_batches, _RUNS)
    whole = ranges.withColumn("part", F.lit(0)).repartition(1).sortWithinPartitions(*order).mapInArrow(_sweep_batches, _RUNS)
    got = whole.toArrow()
    rows = list(zip(*(got.column(c).to_pylist() for c in _RUN.names), strict=True))
    return [r[1:] for r in rows if r[0] == MATCH], [r[1:4] for r in rows if r[0] in (GAP, SHRUNK)], [r[1:4] for r in rows if r[0] == PIECES]


def _joined(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs with those that go on where another of their size ends as one."""
    out: list[tuple[int, int, int]] = []
    for size, first, n in sorted(runs):
        if out and out[-1][0] == size and out[-1][1] + out[-1][2] == first:
            out[-1] = (size, out[-1][1], out[-1][2] + n)
        else:
            out.append((size, first, n))
    return out


def rounds(histogram: dict[int, int], capacity: int, round_) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): the matches of all rounds, by ``round_``(gaps, pieces)."""
    plan, gaps, pieces, opened = [], [], [], 0
    for length in sorted(histogram, reverse=True):
        if 2 * length > capacity:  # no two of these fit together
            plan.append((length, 0, histogram[length], opened, 0))
            gaps.append((capacity - length, opened, histogram[length]))
            opened += histogram[length]
        else:
            pieces.append((length, 0, histogram[length]))
    more = max(0, -(-sum(k * n for k, n in histogram.items()) // capacity) - opened)
    while pieces:
        if more:
            gaps.append((capacity, opened, more))
            opened += more
        least = min(p[0] for p in pieces)
        matches, gaps, pieces = round_([g for g in _joined(gaps) if g[0] >= least], pieces)
        plan += [(length, rank, n, seq, capacity - gap) for length, rank, n, seq, gap in matches]
        more = 0 if matches else -(-sum(k * n for k, _, n in pieces) // capacity)
    return plan


def _place_batches(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, first, offset = plan.value
        key = (length << 44) + rank  # lengths up to 2**19, ranks up to 2**44
        order = np.argsort(key, kind="stable")
        key, rank, first, offset = key[order], rank[order], first[order], offset[order]
        for b in batches:
            own, at = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run_ = np.searchsorted(key, (own << 44) + at, side="right") - 1
            seq = first[run_] + at - rank[run_]
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(seq, pa.int64()), pa.array(offset[run_], pa.int64())], [*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. Pieces are read twice: give a written table."""
    spark = pieces.sparkSession
    # Only the histogram and the rounds' runs come to the driver.
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    plan = rounds(histogram, capacity, lambda gaps, left: _round(spark, gaps, left))
    cols = np.array(plan, np.int64).reshape(-1, 5).T
    shared = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(c) for c in cols))
    sizes = spark.createDataFrame([(k, -(-n // RANGE_ROWS)) for k, n in histogram.items()], "h_length long, ranges long")
    rows = pieces.join(F.broadcast(sizes), F.col("length") == F.col("h_length"))
    rows = rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("ranges"))).drop("h_length", "ranges")
    per = rows.groupBy("length", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("length").alias("p_length"), F.col("range").alias("p_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "range").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("at", F.row_number().over(within) - 1)
    ranked = rows.join(per, (F.col("length") == F.col("p_length")) & (F.col("range") == F.col("p_range")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place_batches(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, **params) -> DataFrame:
    pieces, _ = common.written(tokenized_pieces(docs, **params))
    return pack(pieces, params.get("capacity", CAPACITY))


def op2_pack(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
