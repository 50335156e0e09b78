"""The simplified English stemmer (FTS-03), applied once per distinct term of a batch. Letters outside ASCII count as consonants that are never doubled."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = frozenset("aeiou")  # y never counts as a vowel

# The suffixes of steps 2, 3 and 4, in the order in which they are tried.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v and c for each run of vowels or consonants."""
    out = ""
    for ch in word:
        kind = "v" if ch in VOWELS else "c"
        if not out.endswith(kind):
            out += kind
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _has_vowel(word: str) -> bool:
    return any(ch in VOWELS for ch in word)


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    if len(word) < 3:
        return False
    a, b, c = word[-3:]
    return a not in VOWELS and b in VOWELS and c.isascii() and c not in VOWELS and c not in "wxy"


def _swap(word: str, table) -> str:
    for suffix, other in table:
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            return root + other if _measure(root) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word.encode()) <= 2:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                root = w[: -len(suffix)]
                if _has_vowel(root):
                    if root.endswith(("at", "bl", "iz")):
                        w = root + "e"
                    elif len(root) >= 2 and root[-1] == root[-2] and root[-1].isascii() and root[-1] not in VOWELS and root[-1] not in "lsz":
                        w = root[:-1]
                    elif _measure(root) == 1 and _short_end(root):
                        w = root + "e"
                    else:
                        w = root
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP_2), STEP_3)
    for suffix in STEP_4:
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root[-1:] in ("s", "t")):
                w = root
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: Stems of terms in a worker, of TERMS terms at most.
_known: dict[str, str] = {}
TERMS = 500_000


def _looked_up(terms: pa.Array) -> pa.Array:
    """The stems of an array of terms, each distinct one computed once."""
    if len(_known) > TERMS:
        _known.clear()
    coded = terms.dictionary_encode()
    out = []
    for t in coded.dictionary.to_pylist():
        found = _known.get(t)
        if found is None:
            found = stem(t)
            if len(t) <= 64:
                _known[t] = found
        out.append(found)
    return pa.array(out, pa.string()).take(coded.indices)


def stemmed(terms: Column | str) -> Column:
    """The stem of each term; null of null."""

    def run(x: pa.Array) -> pa.Array:
        return _looked_up(x)

    return F.arrow_udf(run, "string")(terms)


def stemmed_lists(tokens: Column) -> Column:
    """The stems of lists of terms, in order; null of null."""

    def run(x: pa.Array) -> pa.Array:
        counts = pa.compute.fill_null(pa.compute.list_value_length(x), 0)
        ends = pa.compute.cumulative_sum(counts).to_pylist()
        offsets = pa.array([0, *ends], pa.int32())
        return pa.ListArray.from_arrays(offsets, _looked_up(x.flatten().cast(pa.string())), mask=x.is_null() if x.null_count else None)

    return F.arrow_udf(run, "array<string>")(tokens)
