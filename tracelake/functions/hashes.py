"""Short ids: FNV-1a modulo 2^28, so that no product leaves 64 bits and all stays in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits: offset basis and prime (fixed values).
BASIS, PRIME = 14695981039346656037, 1099511628211
_MASK = (1 << 28) - 1  # the low bits of a product depend on the low bits of its factors alone


def short_hash_text(package: str, name: str) -> str:
    """Seven hex digits of FNV-1a over package, a colon that is mixed in without a product, and name."""
    h = BASIS
    for part, mark in ((package, 58), (name, None)):
        for byte in part.encode():
            h = ((h ^ byte) * PRIME) & 0xFFFFFFFFFFFFFFFF
        h ^= mark or 0
    return f"{h & _MASK:07x}"


def _bytes(text: Column) -> Column:
    raw = F.encode(text, "UTF-8")
    one = lambda i: F.ascii(F.decode(F.substring(raw, i, 1), "ISO-8859-1")).cast("long")
    return F.when(F.octet_length(text) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(text)), one)).otherwise(F.array().cast("array<bigint>"))


def short_hash(package: Column, name: Column) -> Column:
    step = lambda h, c: (h.bitwiseXOR(c) * (PRIME & _MASK)).bitwiseAND(F.lit(_MASK))
    first = F.aggregate(_bytes(package), F.lit(BASIS & _MASK).cast("long"), step)
    return F.lower(F.lpad(F.hex(F.aggregate(_bytes(name), first.bitwiseXOR(F.lit(58)), step)), 7, "0"))
