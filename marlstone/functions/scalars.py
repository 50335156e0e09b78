"""Scalar column functions of the object lake: masking, sizes, checksums, keys, scores, delays."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")
#: Ways in which four groups of four digits are joined, in the order tried.
_SEPARATORS = (r"", r"[-\s]")


def mask_string(s: Column) -> Column:
    """Four stars for up to four characters, else the first and last two with stars between (SCL-01)."""
    return F.when(F.length(s) <= 4, F.lit("****")).otherwise(F.concat(F.substring(s, 1, 2), F.repeat(F.lit("*"), F.length(s) - 4), F.right(s, F.lit(2))))


def pii_rules() -> list[tuple[str, str]]:
    """(pattern, replacement) pairs, applied in order (SCL-02); group 1 and 2 are the digits that stay. The forms with optional separators are
    spelled out, since the stars stand for each masked character."""
    rules = [(r"\b(\d{2})\d{11}(\d{2})\b", 11), (r"\b(\d{2})\d{14}(\d{2})\b", 14), (r"\b(1[3-9])\d{7}(\d{2})\b", 7)]
    for n in range(8):
        seps = [_SEPARATORS[n >> (2 - i) & 1] for i in range(3)]
        rules.append((rf"\b(\d{{2}})\d{{2}}{seps[0]}\d{{4}}{seps[1]}\d{{4}}{seps[2]}\d{{2}}(\d{{2}})\b", 12 + sum(bool(s) for s in seps)))
    return [(p, "*" * stars) for p, stars in rules]


def redact_pii(text: Column) -> Column:
    for pattern, stars in pii_rules():
        text = F.regexp_replace(text, pattern, f"$1{stars}$2".replace("*", r"\*").replace(r"\*", "*"))
    return text


def parse_size(s: Column) -> Column:
    """Bytes of a size like ``10GB``: 1024-based, any case, whole numbers; 0 for empty, null for anything else (SCL-03)."""
    t = F.upper(F.trim(s))
    number = F.regexp_extract(t, r"^(\d+)\s*(B|KB|MB|GB|TB)$", 1)
    unit = F.regexp_extract(t, r"^(\d+)\s*(B|KB|MB|GB|TB)$", 2)
    scale = F.lit(None).cast("long")
    for i, u in reversed(list(enumerate(UNITS))):
        scale = F.when(unit == u, F.lit(1024**i)).otherwise(scale)
    return F.when(t == "", F.lit(0).cast("long")).otherwise(F.nullif(number, F.lit("")).cast("long") * scale)


def format_size(n: Column) -> Column:
    """The largest unit that gives at least 1, by whole division (SCL-04)."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for i in range(1, len(UNITS)):
        out = F.when(n >= 1024**i, F.concat(F.floor(n / 1024**i).cast("long").cast("string"), F.lit(UNITS[i]))).otherwise(out)
    return out


def crc32_hex(data: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")


def _table(poly: int, mask: int) -> list[int]:
    out = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (poly if c & 1 else 0)
        out.append(c & mask)
    return out


#: Bytes that one step of a long checksum takes.
_STEP = 256


class _Checksum:
    """A reflected CRC. It is linear, so the bytes of a block are looked up by their places and joined at once, and the register goes over a block by its own bytes."""

    def __init__(self, poly: int, width: int):
        self.mask = (1 << width) - 1
        self.table = _table(poly, self.mask)
        kind = np.uint32 if width == 32 else np.uint64
        one = np.array(self.table, kind)
        self.places = np.empty((_STEP, 256), kind)
        self.places[-1] = one
        for i in range(_STEP - 2, -1, -1):
            after = self.places[i + 1]
            self.places[i] = one[(after & kind(0xFF)).astype(np.int64)] ^ (after >> kind(8))
        self.over = []
        for j in range(width // 8):
            row = []
            for x in range(256):
                c = x << (8 * j)
                for _ in range(_STEP):
                    c = self.table[c & 0xFF] ^ c >> 8
                row.append(c)
            self.over.append(row)

    def __call__(self, data: bytes) -> int:
        c, table = self.mask, self.table
        head = len(data) % _STEP
        for x in data[:head]:
            c = table[(c ^ x) & 0xFF] ^ c >> 8
        for at in range(head, len(data), _STEP << 12):
            blocks = np.frombuffer(data, np.uint8, min(_STEP << 12, len(data) - at), at).reshape(-1, _STEP)
            for own in np.bitwise_xor.reduce(self.places[np.arange(_STEP), blocks], axis=1).tolist():
                over = own
                for row in self.over:
                    over ^= row[c & 0xFF]
                    c >>= 8
                c = over
        return c ^ self.mask


@functools.cache
def _checksum(poly: int, width: int) -> _Checksum:
    return _Checksum(poly, width)


def crc32c_hex(data: Column) -> Column:
    """CRC-32C (Castagnoli) in hexadecimal (SCL-05)."""
    return F.pandas_udf(_crc32c_hex, "string")(data)


def _crc32c_hex(data: pd.Series) -> pd.Series:
    crc = _checksum(0x82F63B78, 32)
    return data.map(lambda d: None if d is None else f"{crc(bytes(d)):08x}")


def crc64_hex(data: Column) -> Column:
    """CRC-64 (ECMA, reflected) in hexadecimal (SCL-05)."""
    return F.pandas_udf(_crc64_hex, "string")(data)


def _crc64_hex(data: pd.Series) -> pd.Series:
    crc = _checksum(0xC96C5795D7870F42, 64)
    return data.map(lambda d: None if d is None else f"{crc(bytes(d)):016x}")


def hmac_sha256_hex(data: Column, key: Column) -> Column:
    """The webhook signature of a body (SCL-24)."""
    return F.pandas_udf(_hmac_sha256_hex, "string")(data, key)


def _hmac_sha256_hex(data: pd.Series, key: pd.Series) -> pd.Series:
    import hashlib
    import hmac

    return pd.Series([None if d is None or k is None else hmac.new(str(k).encode(), str(d).encode(), hashlib.sha256).hexdigest() for d, k in zip(data, key, strict=True)])


def document_id_hex(bucket: Column, key: Column, version: Column) -> Column:
    """The first 8 bytes of SHA-256 of ``bucket#key#version``, in hexadecimal (FTS-06)."""
    return F.substring(F.sha2(F.concat_ws("#", bucket, key, version), 256), 1, 16)


def parent_prefix(key: Column) -> Column:
    """The key through its last slash, or the empty string (SCL-07)."""
    return F.regexp_extract(key, "^(.*/)", 1)


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """The key through the first delimiter after the prefix; null if there is none (SCL-08)."""
    rest = F.substring(key, len(prefix) + 1, 1 << 30)
    at = F.instr(rest, delimiter)
    return F.when(key.startswith(prefix) & (at > 0), F.concat(F.lit(prefix), F.substring(rest, F.lit(1), at + len(delimiter) - 1)))


def byte_range(content: Column, spec: str) -> Column:
    """The bytes of a range ``bytes=a-b``, ``bytes=a-`` or ``bytes=-n`` (SRC-10); null if it cannot be met."""
    a, _, b = spec.removeprefix("bytes=").partition("-")
    if not spec.startswith("bytes=") or not (a or b):
        raise ValueError(f"no byte range: {spec}")
    size = F.octet_length(content)
    if not a:
        return F.when(F.lit(int(b)) > 0, F.substring(content, F.greatest(size - int(b), F.lit(0)) + 1, F.lit(int(b))))
    last = F.least(size - 1, F.lit(int(b))) if b else size - 1
    return F.when((size > int(a)) & (last >= int(a)), F.substring(content, F.lit(int(a) + 1), last - int(a) + 1))


def status_class(code: Column) -> Column:
    """1xx to 4xx by range, anything else 5xx (AGG-17)."""
    out = F.lit("5xx")
    for k in (4, 3, 2, 1):
        out = F.when((code >= 100 * k) & (code < 100 * (k + 1)), F.lit(f"{k}xx")).otherwise(out)
    return out


def retry_delay_ms(attempt: Column, base_ms: int, cap_ms: int, offset: int = 0) -> Column:
    """min(cap, base * 2 ** (attempt - offset)) (SCL-19); the queue uses offset 1, dead letters 0."""
    return F.least(F.lit(float(cap_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), (attempt - offset).cast("double"))).cast("long")


def recency_score(age_seconds: Column) -> Column:
    """100, 80, 50 or 20 below an hour, a day, a week and 30 days; else 0, also for never (SCL-20)."""
    return F.when(age_seconds < 3600, 100.0).when(age_seconds < 86_400, 80.0).when(age_seconds < 7 * 86_400, 50.0).when(age_seconds < 30 * 86_400, 20.0).otherwise(0.0)


def content_score(content_type: Column) -> Column:
    """SCL-21."""
    return F.when(content_type.startswith("image/"), 80.0).when(content_type.startswith("video/"), 60.0).when(content_type.startswith("text/"), 70.0).otherwise(50.0)


def size_score(size: Column) -> Column:
    """The smaller, the higher, as the reference formula has it (SCL-21, D25)."""
    return F.when(size < 1 << 20, 80.0).when(size < 100 << 20, 60.0).when(size < 1 << 30, 40.0).otherwise(20.0)


def tier_of(score: Column) -> Column:
    """TIR-02."""
    return F.when(score > 80, F.lit("HOT")).when(score > 60, F.lit("WARM")).when(score > 20, F.lit("COLD")).otherwise(F.lit("ARCHIVE"))


def content_kind(mime: Column) -> Column:
    """SCL-23."""
    return F.when(mime.startswith("image/"), F.lit("image")).when(mime.startswith("video/"), F.lit("video")).when(mime.startswith("audio/"), F.lit("audio")).when(mime == "application/pdf", F.lit("pdf"))


def output_path(pattern: Column, key: Column, uuid: Column, mime: Column) -> Column:
    """A pipeline output's key from its template (SCL-10), with an extension for known types where the template has none."""
    ext = F.when(mime == "image/jpeg", ".jpg").when(mime == "image/png", ".png").when(mime == "image/webp", ".webp").when(mime == "text/plain", ".txt").when(mime == "application/json", ".json").when(mime == "application/pdf", ".pdf").otherwise("")
    path = F.replace(F.replace(pattern, F.lit("{key}"), key), F.lit("{uuid}"), F.substring(uuid, 1, 8))
    return F.when(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1) == "", F.concat(path, ext)).otherwise(path)


def fnv1a_worker(key: Column, workers: int = 16) -> Column:
    """The worker of a key: FNV-1a of 32 bits, modulo the number of workers (SCL-11)."""
    digits = F.sequence(F.lit(0), F.octet_length(key) - 1)
    data = F.hex(key.cast("binary"))
    step = lambda h, i: F.pmod(F.expr("1L") * (h.bitwiseXOR(F.conv(F.substring(data, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))) * F.lit(16777619), F.lit(4294967296))
    h = F.aggregate(digits, F.lit(2166136261).cast("long"), step)
    return F.when(F.octet_length(key) > 0, F.pmod(h, F.lit(workers))).otherwise(F.pmod(F.lit(2166136261), F.lit(workers))).cast("int")


def label_key(labels: Column) -> Column:
    """A map's entries, sorted, as one string (SCL-26)."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def sensitive_equal(a: Column, b: Column) -> Column:
    """Both tags non-empty and equal (SCL-25)."""
    return F.coalesce((a != "") & (a == b), F.lit(False))


def truncated_sum(x: Column) -> Column:
    return F.round(x, 6)


def resource_name(bucket: Column, key: Column, prefix: str = "arn:aws:s3:::") -> Column:
    """SCL-12: without a key, the bucket's own name."""
    return F.when(F.coalesce(key, F.lit("")) == "", F.concat(F.lit(prefix), bucket)).otherwise(F.concat(F.lit(prefix), bucket, F.lit("/"), key))


def resource_parts(arn: Column, prefix: str = "arn:aws:s3:::") -> tuple[Column, Column]:
    """SCL-12: (bucket, key); both empty for names of another kind."""
    rest = F.when(arn.startswith(prefix), F.substring(arn, len(prefix) + 1, 2**31 - 1)).otherwise("")
    bucket = F.substring_index(rest, "/", 1)
    return bucket, F.substring(rest, F.length(bucket) + 2, F.lit(2**31 - 1))


def shard_sizes(size: Column, data_shards: int = 4) -> tuple[Column, Column]:
    """SNK-13: (bytes of one shard, padding of the last) for content with its 8-byte length before it."""
    one = F.ceil((size + 8) / data_shards)
    return one, one * data_shards - size - 8
