"""Keys of several fields, where a table is placed, and the short ids by which a log knows a repeat.

The column forms stay in the JVM; the plain ones serve the driver, which places tables, not rows.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote_from_bytes, unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.errors import Invalid

PLAIN = re.compile(r"[A-Za-z0-9_-]")
WORD = (1 << 64) - 1

# The longest id kept verbatim; FNV-1a of 64 bits; the finalizer of splitmix64; the multiplier of
# the jump consistent hash (Lamping and Veach, 2014).
LONGEST_ID = 1024
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
JUMP = 2862933555777941757


def escape(field: str) -> str:
    """ASCII letters, digits, _ and - as they are, every other byte of the UTF-8 as %XX."""
    return quote_from_bytes(field.encode(), safe="").replace(".", "%2E").replace("~", "%7E")


def unescape(field: str) -> str:
    if re.search(r"%(?![0-9A-Fa-f]{2})", field):
        raise Invalid(f"bad escape in {field!r}")
    return unquote_to_bytes(field).decode()


def separator(sep: str) -> str:
    if len(sep) != 1 or PLAIN.match(sep) or sep == "%" or not sep.isascii():
        raise ValueError(f"{sep!r} can't separate fields")
    return sep


def join(sep: str, *fields: str) -> str:
    if not fields:
        raise ValueError("a key needs a field")
    return separator(sep).join(map(escape, fields))


def split(key: str, sep: str) -> list[str]:
    return [unescape(f) for f in key.split(separator(sep))]


def stored_id(record: str) -> str:
    """The id as keys hold it: escaped, or # and its SHA-256 if that is too long."""
    text = escape(record)
    return text if len(text) <= LONGEST_ID else "#" + hashlib.sha256(record.encode()).hexdigest()


def record_key(tenant: str, table: str, record: str) -> str:
    return f"{tenant}/{escape(table)}/{stored_id(record)}"


def idempotency(tenant: str, table: str, record: str) -> str:
    """128 bits of the key's SHA-256, in hex."""
    return hashlib.sha256(record_key(tenant, table, record).encode()).hexdigest()[:32]


def escape_column(field: Column) -> Column:
    """escape() by Java's form encoder, which keeps . and * and writes a blank as a plus sign."""
    out = F.url_encode(field)
    for plain, hexed in ((".", "%2E"), ("*", "%2A"), ("+", "%20")):
        out = F.replace(out, F.lit(plain), F.lit(hexed))
    return out


def record_key_column(tenant: str, table: str, record: Column) -> Column:
    """record_key() of each row; null without an id."""
    text = escape_column(record)
    held = F.when(F.length(text) <= LONGEST_ID, text).otherwise(F.concat(F.lit("#"), F.sha2(record.cast("binary"), 256)))
    return F.concat(F.lit(f"{tenant}/{escape(table)}/"), held)


def idempotency_column(tenant: str, table: str, record: Column) -> Column:
    return F.substring(F.sha2(record_key_column(tenant, table, record).cast("binary"), 256), 1, 32)


def fnv(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & WORD
    return h


def mix(h: int) -> int:
    """Another hash, independent of the one it's made from."""
    h = (h ^ h >> 30) * MIX_1 & WORD
    h = (h ^ h >> 27) * MIX_2 & WORD
    return h ^ h >> 31


def jump(h: int, buckets: int) -> int:
    """Bucket of a hash: one bucket more takes keys only into itself."""
    last, following = 0, 0
    while following < buckets:
        last = following
        h = (h * JUMP + 1) & WORD
        following = int((last + 1) * ((1 << 31) / ((h >> 33) + 1)))
    return last


def route(tenant: str, table: str, partitions: int, shards: int) -> tuple[int, int]:
    """Partition and shard of a table; its scopes go with it."""
    h = fnv(f"{tenant}.{escape(table)}".encode())
    return jump(h, partitions), jump(mix(h), shards)
