"""What the operators of this subpackage share: the shared folder, written
intermediate tables and bounded word memos."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from itertools import filterfalse

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: No Arrow batch sent to Python holds much more than this, however long the texts.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where it is unset and all tasks run on this machine, as in tests."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there and
    a lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`written` that no plan reads any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Words(dict):
    """A generation of a memo; a word that is not in it is looked for in the older one, or computed."""

    def __init__(self, memo: WordMemo):
        self.memo = memo

    def __missing__(self, word):
        return self.memo.missed(word)


class WordMemo:
    """Memo of a pure function of a word in two generations of at most about ``cap`` words each, none longer than ``LONGEST``, so a
    worker's memory is bounded whatever the vocabulary. ``many`` computes a set of new words, ``one`` a single word.

    A worker serves one operator after the other, and only the one at work keeps its memos: the first use by another
    ``owner`` empties them."""

    #: Characters or bytes of the longest word that is remembered.
    LONGEST = 64
    active = ""
    every: list[WordMemo] = []

    def __init__(self, many: Callable[[Iterable], dict] | None, cap: int = 200_000, owner: str = "one", one: Callable | None = None):
        self.many, self.cap, self.owner = many, cap, owner
        self.one = one or (lambda word: many([word])[word])
        self.new: dict = _Words(self)
        self.old: dict = {}
        self.long: list = []
        WordMemo.every.append(self)

    def _turn(self) -> None:
        if WordMemo.active != self.owner:
            WordMemo.active = self.owner
            for m in WordMemo.every:
                if m.owner != self.owner:
                    m.new, m.old, m.long = _Words(m), {}, []
        for w in self.long:
            self.new.pop(w, None)
        self.long = []
        if len(self.new) > self.cap:
            self.old, self.new = self.new, _Words(self)

    def missed(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.one(word)
        if len(word) <= self.LONGEST:
            self.new[word] = found
        return found

    def getter(self) -> Callable:
        """The function, for the words of one text (which may take the memo beyond ``cap``)."""
        self._turn()
        return self.new.__getitem__

    def table(self, words: list) -> dict:
        """A dict that holds every word of ``words``; the new ones are computed together."""
        self._turn()
        new, old = self.new, self.old
        missing = set(filterfalse(new.__contains__, words))
        if missing:
            fresh = []
            for w in missing:
                if w in old:
                    new[w] = old[w]
                else:
                    fresh.append(w)
            if fresh:
                new.update(self.many(fresh))
            self.long = [w for w in missing if len(w) > self.LONGEST]
        return new
