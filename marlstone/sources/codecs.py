"""Binary formats: vectors, postings, benchmark vector files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_vector(v: Sequence[float]) -> bytes:
    """The length as 32 bits, then 32-bit floats, all little-endian (SRC-14)."""
    a = np.asarray(v, "<f4")
    return len(a).to_bytes(4, "little") + a.tobytes()


def decode_vector(data: bytes | None) -> list[float] | None:
    """None for anything whose length does not fit."""
    if data is None or len(data) < 4 or len(data) != 4 + 4 * int.from_bytes(data[:4], "little"):
        return None
    return np.frombuffer(data, "<f4", offset=4).tolist()


def decoded_vectors(data: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda d: decode_vector(None if d is None else bytes(d))), "array<float>")(data)


def encoded_vectors(vec: Column) -> Column:
    return F.pandas_udf(_encode_series, "binary")(vec)


def _encode_series(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else encode_vector(v))


def _put(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _take(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def encode_postings(postings: Sequence[tuple[int, Sequence[int]]]) -> bytes | None:
    """Postings (document, positions), ascending, as variable-length differences (SRC-15); nothing gives None."""
    if not postings:
        return None
    out, last = [_put(len(postings))], 0
    for doc, positions in postings:
        out += [_put(doc - last), _put(len(positions))]
        last, at = doc, 0
        for p in positions:
            out.append(_put(p - at))
            at = p
    return b"".join(out)


def decode_postings(data: bytes | None) -> list[tuple[int, list[int]]]:
    if not data:
        return []
    n, at = _take(data, 0)
    out, doc = [], 0
    for _ in range(n):
        d, at = _take(data, at)
        doc += d
        count, at = _take(data, at)
        positions, p = [], 0
        for _ in range(count):
            step, at = _take(data, at)
            p += step
            positions.append(p)
        out.append((doc, positions))
    return out


def read_fvecs(spark: SparkSession, path: str, whole_numbers: bool = False) -> DataFrame:
    """(path, row, v) of .fvecs files (.ivecs with ``whole_numbers``): each row is its dimension as 32 bits and as many 32-bit values (SRC-12)."""
    return decoded_fvecs(spark.read.format("binaryFile").load(path), whole_numbers)


def decoded_fvecs(files: DataFrame, whole_numbers: bool = False) -> DataFrame:
    """(path, row, v) of the contents of such files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = np.frombuffer(content, "<i4")
                if not len(raw):
                    continue
                rows = raw.reshape(-1, raw[0] + 1)[:, 1:]
                rows = rows if whole_numbers else rows.view("<f4")
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096].astype(float)
                    yield pd.DataFrame({"path": p, "row": np.arange(i, i + len(part)), "v": list(part)})

    return files.select("path", "content").mapInPandas(run, "path string, row long, v array<double>")


def vector_files(vecs: DataFrame, path: Column, order: str, with_ids: bool, vec_col: str = "embedding", rows_per_file: int = 4096) -> DataFrame:
    """(path, content): files of up to ``rows_per_file`` places of a whole-number column each. Segment files (``with_ids``, SRC-13) hold an id of 8 bytes and the 32-bit
    components a row; without, each row begins with its dimension as in .fvecs files (SRC-12). All vectors of a file have one dimension."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        parts = []
        for i, v in zip(pdf["place"], pdf["v"], strict=True):
            parts += [int(i).to_bytes(8, "little", signed=True) if with_ids else len(v).to_bytes(4, "little"), np.asarray(v, "<f4").tobytes()]
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [b"".join(parts)]})

    rows = vecs.where(F.col(vec_col).isNotNull()).withColumn("path", F.concat_ws("-", path, F.size(vec_col).cast("string"), F.floor(F.col(order) / rows_per_file).cast("string")))
    return rows.select("path", F.col(order).cast("long").alias("place"), F.col(vec_col).alias("v")).groupBy("path").applyInPandas(run, "path string, content binary")


def decoded_segments(files: DataFrame, dim: int) -> DataFrame:
    """(path, vec_id, embedding) of segment files of one dimension (SRC-13)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype([("id", "<i8"), ("v", "<f4", (dim,))])
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = np.frombuffer(content, kind)
                yield pd.DataFrame({"path": p, "vec_id": rows["id"], "embedding": list(rows["v"])})

    return files.select("path", "content").mapInPandas(run, "path string, vec_id long, embedding array<float>")


def coded_postings(postings: DataFrame, term: str = "term", doc: str = "doc_id", positions: str = "positions", docs_per_block: int = 65_536) -> DataFrame:
    """(term, block, code): postings as variable-length differences, in blocks of documents so a common term has no row without bound (SRC-15)."""
    block = F.floor(F.col(doc) / docs_per_block).alias("block")
    rows = postings.groupBy(term, block).agg(F.array_sort(F.collect_list(F.struct(F.col(doc).alias("d"), F.col(positions).alias("p")))).alias("l"))
    code = F.pandas_udf(lambda s: s.map(lambda l: encode_postings([(x["d"], x["p"]) for x in l])), "binary")  # noqa: E741
    return rows.select(term, "block", code("l").alias("code"))


def decoded_postings(coded: DataFrame) -> DataFrame:
    """(term, doc_id, positions)."""
    read = F.pandas_udf(lambda s: s.map(lambda b: [{"doc_id": d, "positions": p} for d, p in decode_postings(bytes(b))]), "array<struct<doc_id:long,positions:array<int>>>")
    return coded.select("term", F.explode(read("code")).alias("p")).select("term", "p.doc_id", "p.positions")
