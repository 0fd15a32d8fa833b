"""Keyed deterministic partition of entities."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(key: bytes) -> tuple[str, str]:
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in padded).hex(), bytes(b ^ 0x5C for b in padded).hex()


def keyed_digest(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text column, as hex."""
    inner, outer = _pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def digest_modulus(digest: Column, modulus: int) -> Column:
    """A 256-bit hex number modulo a small integer, folded over 60-bit pieces."""
    out = F.lit(0).cast("long")
    for start in range(1, 65, 15):
        width = min(15, 65 - start)
        piece = F.conv(F.substring(digest, start, width), 16, 10).cast("long")
        out = (out * F.lit(pow(16, width, modulus)) + piece % modulus) % modulus
    return out


def partition_label(value: Column, key: bytes, basis_points: int, low: str = "calibration", high: str = "held_out") -> Column:
    """Partition of an entity; a function of its id, so events need no join."""
    if len(key) < 16:
        raise ValueError("the partition key needs at least 16 bytes")
    return F.when(digest_modulus(keyed_digest(value, key), 10_000) < basis_points, low).otherwise(high)
