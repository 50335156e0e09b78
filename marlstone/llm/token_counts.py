"""Operator 8: token counts by trie-shared dynamic programming.

A unigram tokenizer's best segmentation of a word needs, for each of its prefixes, the best
score of any segmentation of that prefix: the score at depth d is the best of score(d - l) plus the score of the
piece that ends there with l characters. That state depends on the prefix alone, so the distinct new words
of a batch go into a trie and the scores are computed once per trie node, that is once per shared prefix;
the node where a word ends stores its token count. A document's count is the sum over its words.

Pieces and their ranks come from the public 32k vocabulary file; its scores are mere ranks, so a piece's score is
Zipf's log probability of its rank. Characters outside the vocabulary cost one token per UTF-8 byte, as with byte fallback.
Words are the runs without ASCII white space, each with the word-start mark in front. Ties of the best
score take fewer tokens.

Defined results: null and empty texts count 0; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from . import common

MARK = "▁"
_counters: dict = {}


class Counter:
    """Counts of words (bytes), one instance per vocabulary and worker."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
        self.score = {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}
        self.longest = max(map(len, pieces))
        self.byte = min(self.score.values()) - 10.0
        # The lengths that pieces ending in each character have, longest possible first.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for p in pieces:
            self.lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: tuple(sorted(v)) for c, v in self.lengths.items()}
        self.memo = common.WordMemo(self.counts, 400_000, "token_counts")

    def counts(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """Token counts of distinct words. The words in order are a walk through their trie: the path to the
        current node is kept, and a word goes back to the node where it leaves the one before it."""
        out = {}
        score, lengths, byte = self.score, self.lengths, self.byte
        path, best, count, ends = "", [0.0], [0], {}
        for text, word in sorted((MARK + w.decode("utf-8", "replace"), w) for w in words):
            shared = 0
            for a, b in zip(path, text):  # noqa: B905  the path and the word differ in length
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for d in range(shared, len(text)):
                c = text[d]
                top, n = best[d] + byte * (k := len(c.encode("utf-8", "replace"))), count[d] + k
                for l in lengths.get(c, ()):  # noqa: E741
                    if l > d + 1:
                        break
                    s = score.get(text[d + 1 - l : d + 1])
                    if s is not None and ((s := s + best[d + 1 - l]) > top or s == top and count[d + 1 - l] + 1 < n):
                        top, n = s, count[d + 1 - l] + 1
                best.append(top)
                count.append(n)
            path = text
            out[word] = count[-1]
        return out

    def __call__(self, text: bytes) -> tuple[int, int]:
        words = text.split()
        counts = self.memo.table(words)
        return len(words), sum([counts[w] for w in words])


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _count_batches(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or default_vocabulary())
        for b in batches:
            got = [count(x.as_py() or b"") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens); vocabulary: the file's path on the executors (None: the public one, looked up there)."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count_batches(vocabulary), "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
