"""Predicates compiled to columns: globs, event patterns, CIDR ranges, filter strings, and two small languages."""

from __future__ import annotations

import functools
import ipaddress
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars


def glob_regex(glob: Column) -> Column:
    """The anchored regular expression of a glob with ``*`` and ``?`` (FLT-13); every other character stands for itself."""
    quoted = F.regexp_replace(glob, r"([^A-Za-z0-9*?])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def glob_match(value: Column, glob: Column | str) -> Column:
    """The plain forms (any, a prefix and a star, no wildcard at all) need no regular expression."""
    glob = F.lit(glob) if isinstance(glob, str) else glob
    head = F.regexp_replace(glob, r"\*$", "")
    plain = ~(head.contains("*") | head.contains("?"))
    return F.when(glob == "*", True).when(plain & glob.endswith("*"), value.startswith(head)).when(plain, value == glob).otherwise(F.regexp_like(value, glob_regex(glob)))


def event_type_match(event_type: Column, pattern: Column) -> Column:
    """Equal, or the pattern ends in ``:*`` and the type begins with what stands before the star (FLT-10)."""
    return (event_type == pattern) | (pattern.endswith(":*") & event_type.startswith(F.regexp_replace(pattern, r"\*$", "")))


def rule_match(event_type: Column, bucket: Column, key: Column, rule: dict[str, Column]) -> Column:
    """FLT-11 and the bucket test of JON-06: ``rule`` has patterns (array), bucket, prefix and suffix; empty means any."""
    kinds = F.exists(rule["patterns"], lambda p: event_type_match(event_type, p))
    return kinds & ((rule["bucket"] == "*") | (rule["bucket"] == bucket)) & key.startswith(rule["prefix"]) & key.endswith(rule["suffix"])


def capability_match(granted: Column, wanted: Column) -> Column:
    """Equal, or granted is a scope above the wanted one, or ends in a star that covers it (FLT-14)."""
    return (granted == wanted) | wanted.startswith(F.concat(granted, F.lit(":"))) | (granted.endswith("*") & wanted.startswith(F.regexp_replace(granted, r"\*$", "")))


def ipv4_number(ip: Column) -> Column:
    part = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("long")
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*[part(i) for i in (1, 2, 3, 4)]) < 256)
    return F.when(ok, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def ip_in_range_v4(ip: Column, cidr: Column) -> Column:
    """SCL-17 for IPv4: a star takes any address, without a slash only the same one."""
    net, bits = F.split_part(cidr, F.lit("/"), F.lit(1)), F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2), 32 - bits).cast("long")
    inside = F.floor(ipv4_number(ip) / size) == F.floor(ipv4_number(net) / size)
    return F.when(cidr == "*", True).when(~cidr.contains("/"), ip == cidr).otherwise(F.coalesce(inside & bits.between(0, 32), F.lit(False)))


def ip_in_range(ip: Column, cidr: Column) -> Column:
    """SCL-17 for IPv4 and IPv6."""
    return F.pandas_udf(_ip_in_range, "boolean")(ip, cidr)


@functools.lru_cache(10_000)
def _network(text: str):
    try:
        return ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None


@functools.lru_cache(100_000)
def _address(text: str):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def _ip_in_range(ip: pd.Series, cidr: pd.Series) -> pd.Series:
    def one(a, c):
        if a is None or c is None:
            return False
        if c == "*":
            return True
        if "/" not in c:
            return a == c
        net, own = _network(c), _address(a)
        return net is not None and own is not None and own in net

    return pd.Series([one(a, c) for a, c in zip(ip, cidr, strict=True)])


def url_allowed(url: Column, tier: Column, patterns: Column) -> Column:
    """FLT-15: tier 0 nothing, tier 2 anything, tier 1 what a pattern matches once default ports are dropped."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^(https://[^/:]+):443(?=/|$)", "$1"), r"^(http://[^/:]+):80(?=/|$)", "$1")
    listed = F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: glob_match(plain, p))
    return F.when(tier == 2, True).when(tier == 1, listed).otherwise(False)


def parse_equalities(text: str) -> dict[str, str]:
    """``k=v&k2=v2``; parts that do not split in exactly two are dropped (FLT-03)."""
    return dict(p.split("=") for p in text.split("&") if p.count("=") == 1)


def all_equal(columns: dict[str, Column], wanted: dict[str, str]) -> Column:
    """FLT-01, FLT-02: every named value equals the wanted one; a missing name or a null rejects."""
    tests = [F.coalesce(columns[k].cast("string") == v, F.lit(False)) if k in columns else F.lit(False) for k, v in wanted.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def content_type_match(value: Column, pattern: str) -> Column:
    """``*`` and ``*/*`` any, ``type/*`` and a trailing star by prefix, else a substring (FLT-08)."""
    if pattern in ("*", "*/*"):
        return F.lit(True)
    if pattern.endswith("*"):
        return value.startswith(pattern[:-1])
    return value.contains(pattern)


class SyntaxUnsupported(ValueError):
    """A filter or condition that the compiler does not take."""


class _Parser:
    """Precedence climbing over a token list; subclasses give the operands."""

    tokens: re.Pattern
    either: tuple[str, ...]
    both: tuple[str, ...]
    no: tuple[str, ...]

    def __init__(self, text: str):
        self.text, self.items, at = text, [], 0
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            m = self.tokens.match(text, at)
            if not m:
                raise SyntaxUnsupported(f"at {at}: {text}")
            self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.items[self.at][1] if self.at < len(self.items) else ""

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise SyntaxUnsupported(f"ends early: {self.text}")
        self.at += 1
        return self.items[self.at - 1]

    def expect(self, what: str) -> None:
        if self.next()[1] != what:
            raise SyntaxUnsupported(f"{what} expected: {self.text}")

    def whole(self) -> Column:
        out = self.any_of()
        if self.at != len(self.items):
            raise SyntaxUnsupported(f"{self.peek()} not expected: {self.text}")
        return out

    def any_of(self) -> Column:
        out = self.all_of()
        while self.peek().lower() in self.either:
            self.next()
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.single()
        while self.peek().lower() in self.both:
            self.next()
            out = out & self.single()
        return out

    def single(self) -> Column:
        if self.peek() in self.no:
            self.next()
            return ~self.single()
        if self.peek() == "(":
            self.next()
            out = self.any_of()
            self.expect(")")
            return out
        return self.test()

    def test(self) -> Column:
        raise NotImplementedError


class _Filter(_Parser):
    tokens = re.compile(r"(?P<str>'[^']*'|\"[^\"]*\")|(?P<op>==|!=|>=|<=|=|>|<|~|\(|\))|(?P<word>[^\s()=!<>'\"]+)")
    either, both, no = ("or", "||"), ("and", "&&"), ()

    def __init__(self, text: str, content_type: Column, size: Column, metadata: Column):
        super().__init__(text)
        self.content_type, self.size, self.metadata = content_type, size, metadata

    def test(self) -> Column:
        kind, name = self.next()
        op = self.next()[1]
        kind, value = self.next()
        if kind == "str":
            value = value[1:-1]
        if name in ("content_type", "content-type"):
            hit = content_type_match(self.content_type, value)
            return {"==": hit, "=": hit, "~": hit, "!=": ~hit}.get(op) if op in ("==", "=", "~", "!=") else self.bad(op)
        if name == "size":
            limit = int(re.match(r"\d+", value)[0]) if re.fullmatch(r"\d+", value) else None
            bytes_ = F.lit(limit) if limit is not None else scalars.parse_size(F.lit(value))
            return self.compare(self.size, op, bytes_)
        if name.startswith("metadata."):
            return F.coalesce(self.compare(F.try_element_at(self.metadata, F.lit(name.removeprefix("metadata."))), op, F.lit(value)), F.lit(op == "!="))
        raise SyntaxUnsupported(f"unknown name {name}: {self.text}")

    def bad(self, op: str):
        raise SyntaxUnsupported(f"operator {op}: {self.text}")

    def compare(self, a: Column, op: str, b: Column) -> Column:
        table: dict[str, Callable[[], Column]] = {"==": lambda: a == b, "=": lambda: a == b, "!=": lambda: a != b, ">": lambda: a > b, ">=": lambda: a >= b, "<": lambda: a < b, "<=": lambda: a <= b}
        return table[op]() if op in table else self.bad(op)


def compile_filter(text: str, content_type: Column, size: Column, metadata: Column) -> Column:
    """The pipeline filter language (FLT-07, FLT-08, D12 to D15): tests of content_type, size and metadata.<k> joined by and / or."""
    return F.lit(True) if not text.strip() else _Filter(text, content_type, size, metadata).whole()


class _Condition(_Parser):
    """FLT-12: a subset of a common expression language over named typed columns."""

    tokens = re.compile(r"(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>\d+(?:\.\d+)?)|(?P<op>\|\||&&|==|!=|>=|<=|>|<|!|\(|\)|\[|\]|\.|,)|(?P<word>[A-Za-z_]\w*)")
    either, both, no = ("||",), ("&&",), ("!",)

    def __init__(self, text: str, columns: dict[str, Column], kinds: dict[str, str]):
        super().__init__(text)
        self.columns, self.kinds = columns, kinds

    def single(self) -> Column:
        if self.peek() == "!":
            self.next()
            return ~self.single()
        mark = self.at
        if self.peek() == "(":
            self.next()
            out = self.any_of()
            self.expect(")")
            return out
        self.at = mark
        return self.test()

    def test(self) -> Column:
        a, kind = self.value()
        op = self.peek()
        if op in ("==", "!=", ">=", "<=", ">", "<"):
            self.next()
            b, other = self.value()
            if kind != other:
                raise SyntaxUnsupported(f"{kind} against {other}: {self.text}")
            return {"==": a == b, "!=": a != b, ">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b}[op]
        if op == "in":
            self.next()
            return a.isin(*self.listed())
        if kind != "bool":
            raise SyntaxUnsupported(f"not a boolean: {self.text}")
        return a

    def listed(self) -> list:
        self.expect("[")
        out = []
        while self.peek() != "]":
            kind, x = self.next()
            out.append(x[1:-1] if kind == "str" else float(x))
            if self.peek() == ",":
                self.next()
        self.next()
        return out

    def value(self) -> tuple[Column, str]:
        kind, x = self.next()
        if kind == "str":
            out, t = F.lit(x[1:-1]), "string"
        elif kind == "num":
            out, t = F.lit(float(x)), "number"
        elif x in ("true", "false"):
            out, t = F.lit(x == "true"), "bool"
        elif x == "size" and self.peek() == "(":
            self.next()
            inner, t0 = self.value()
            self.expect(")")
            out, t = (F.length(inner) if t0 == "string" else F.size(inner)).cast("double"), "number"
        elif x in self.columns:
            out, t = self.columns[x], self.kinds[x]
            if t == "number":
                out = out.cast("double")
        else:
            raise SyntaxUnsupported(f"unknown name {x}: {self.text}")
        while self.peek() in (".", "["):
            if self.next()[1] == "[":
                kind, key = self.next()
                self.expect("]")
                if t != "map" or kind != "str":
                    raise SyntaxUnsupported(f"index: {self.text}")
                out, t = F.coalesce(F.try_element_at(out, F.lit(key[1:-1])), F.lit("")), "string"
                continue
            name = self.next()[1]
            self.expect("(")
            if name == "getHours" and t == "time":
                self.expect(")")
                out, t = F.hour(out).cast("double"), "number"
                continue
            kind, arg = self.next()
            self.expect(")")
            tests = {"startsWith": out.startswith, "endsWith": out.endswith, "contains": out.contains, "matches": out.rlike}
            if t != "string" or kind != "str" or name not in tests:
                raise SyntaxUnsupported(f"{name}: {self.text}")
            out, t = tests[name](arg[1:-1]), "bool"
        return out, t


def compile_condition(text: str, columns: dict[str, Column], kinds: dict[str, str]) -> Column:
    """kinds: string, number, bool, map or time for each column. An empty condition holds; anything unknown or not boolean is refused."""
    return F.lit(True) if not text.strip() else _Condition(text, columns, kinds).whole()
