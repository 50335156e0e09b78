"""Column functions for full-text search: tokens, snippets, highlights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it",
    "its", "of", "on", "that", "the", "to", "was", "were", "will", "with",
)


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased runs of letters and decimal digits, without stop words and without tokens of one byte, in order (FTS-01, FTS-02).
    A null text has no tokens."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    if not stop_words:
        return F.filter(runs, lambda t: F.octet_length(t) > 1)
    return F.filter(runs, lambda t: (F.octet_length(t) > 1) & ~t.isin(*stop_words))


_RUN = r"[\p{L}\p{Nd}]"


def _by_first(words: Sequence[str]) -> str:
    """A pattern for any of the words, one branch per first letter."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(quoted(w[1:]))
    return "|".join(f"{quoted(c)}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in sorted(groups.items()))


def token_count(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The number of :func:`tokens`, counted by one pattern: no list of tokens is filtered element by element."""
    dropped = f"(?:{_by_first(stop_words)}|[0-9a-z])" if stop_words else "[0-9a-z]"
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<!{_RUN})(?!{dropped}(?!{_RUN})){_RUN}++"))


def _common_start(words: Sequence[str]) -> str:
    a, b = min(words), max(words)
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def term_count(text: Column, forms: Sequence[str]) -> Column:
    """How often any of these tokens occurs; texts without their common start are told apart by a plain substring search."""
    if not forms:
        return F.lit(0)
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = "|".join(quoted(w) for w in sorted(forms, reverse=True))
    return F.when(low.contains(_common_start(forms)), F.regexp_count(low, F.lit(f"(?<!{_RUN})(?:{pattern})(?!{_RUN})"))).otherwise(0)


def tokens_like(text: Column, starts: Sequence[str]) -> Column:
    """The distinct lower-cased runs that begin with one of ``starts``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = "|".join(quoted(w) for w in sorted(starts, reverse=True))
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?<!{_RUN})((?:{pattern}){_RUN}*+)"), F.lit(1)))


def query_tokens(text: str, stop_words: Sequence[str] = STOP_WORDS) -> list[str]:
    """The distinct tokens of a query string, in order of appearance, by the rules of :func:`tokens`."""
    out: dict[str, None] = {}
    run = ""
    for c in text.lower() + " ":
        if c.isalpha() or c.isdecimal():
            run += c
        else:
            if len(run.encode()) > 1 and run not in stop_words:
                out[run] = None
            run = ""
    return list(out)


def snippet(text: Column, terms: Sequence[str], size: int = 100) -> Column:
    """``size`` characters around the earliest case-insensitive occurrence of a term, with ellipses; the head where there is none (FTS-12)."""
    low = F.lower(text)
    hits = [F.nullif(F.instr(low, t.lower()), F.lit(0)) for t in terms]
    first = F.coalesce(F.least(*hits) if len(hits) > 1 else hits[0], F.lit(0)) if hits else F.lit(0)
    # As least() skips nulls, no hit at all gives 0 here.
    start = F.greatest(F.lit(0), F.when(first > 0, first - 1 - size // 2).otherwise(0))
    end = F.least(F.length(text), start + size)
    body = F.substring(text, start + 1, end - start)
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when(F.length(text) <= size, text).otherwise(cut)


def quoted(text: str) -> str:
    """A regular expression, for Java and RE2 alike, that matches exactly this text."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


def highlight(text: Column, terms: Sequence[str]) -> Column:
    """Every case-insensitive occurrence of each term in <em>, term after term (FTS-13)."""
    return reduce(lambda c, t: F.regexp_replace(c, f"(?i)({quoted(t)})", "<em>$1</em>"), terms, text)


def fragments(highlighted: Column) -> Column:
    """The <em> fragments of a highlighted text (FTS-14)."""
    return F.regexp_extract_all(highlighted, F.lit("(?s)(<em>.*?</em>)"), F.lit(1))


def truncated(text: Column, size: int) -> Column:
    """The first ``size`` bytes and an ellipsis, if the text is longer (PRJ-04); a cut character gives U+FFFD."""
    return F.when(F.octet_length(text) > size, F.concat(F.substring(text.cast("binary"), 1, size).cast("string"), F.lit("..."))).otherwise(text)


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """One term's BM25 score (FTS-04): 0 without documents or occurrences; an average length of 0 counts as 1."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    score = idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / F.when(avgdl == 0, 1.0).otherwise(avgdl)))
    return F.when((n == 0) | (df == 0) | (tf == 0), F.lit(0.0)).otherwise(score)
