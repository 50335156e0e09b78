"""Embedding providers: functions from a text column to a vector column, by name (EMB-02 to EMB-04, UDF-10).

A provider is built for a dimension and used as a column function, so batches are Arrow batches. ``remote`` wraps any client that maps a
list of texts to a list of vectors; it is called once per block of texts on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Provider = Callable[[Column], Column]


def text_hash(text: str) -> int:
    """The sum of (character + its byte offset) * 31^(characters after it), modulo 2**32."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    values = points + (np.cumsum(sizes) - sizes).astype(np.uint32)
    return int((values * _powers_of_31(len(points))[::-1]).sum(dtype=np.uint32))


_powers = np.ones(1, np.uint32)


def _powers_of_31(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(1 << n.bit_length(), 31, np.uint32)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps, dtype=np.uint32)
    return _powers[:n]


def _seeded_vector(text: str, dim: int, legacy: bool) -> list[float]:
    """A polynomial hash per dimension. The seed only enters as seed * 31^n, so the text is read once for all dimensions."""
    shared, power = text_hash(text), pow(31, len(text), 1 << 32)
    hashes = (np.arange(dim, dtype=np.uint64) * np.uint64(power) + np.uint64(shared)) % np.uint64(2**32)
    v = ((hashes % np.uint64(10000)).astype(np.int64) - 5000).astype(np.float32) / np.float32(10000)
    square = float(np.sum(v.astype(np.float64) ** 2))
    if square:
        v = v / (square if legacy else square**0.5)
    return v.astype(float).tolist()


def seeded(dim: int = 64, legacy: bool = False) -> Provider:
    """EMB-02: a deterministic vector of unit norm; ``legacy`` divides by the squared norm instead (D10). Null gives null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _seeded_vector(t, dim, legacy))

    return F.pandas_udf(run, "array<double>")


def remote(client: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], block: int = 64) -> Provider:
    """EMB-03: ``client`` makes a connection in each Python worker; texts go through it in blocks, null texts not at all."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = client()
        for texts in batches:
            out: list = [None] * len(texts)
            wanted = [i for i, t in enumerate(texts) if t is not None]
            for start in range(0, len(wanted), block):
                part = wanted[start : start + block]
                answers = ask([texts.iloc[i] for i in part])
                if len(answers) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(answers)} vectors")
                for i, v in zip(part, answers):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")


PROVIDERS: dict[str, Callable[..., Provider]] = {"seeded": seeded, "remote": remote}


def provider(name: str, **options) -> Provider:
    """EMB-04: the provider of that name."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; known are {sorted(PROVIDERS)}")
    return PROVIDERS[name](**options)
