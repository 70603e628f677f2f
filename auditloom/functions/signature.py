"""HMAC-SHA256 as a column expression."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(secret: bytes) -> tuple[bytes, bytes]:
    key = hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(body: Column, secret: bytes) -> Column:
    """Lower-case hex digest of a binary column."""
    inner, outer = _pads(secret)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), body), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def signature_state(body: Column, header: Column, secret: bytes) -> Column:
    """missing, malformed, wrong or valid, for a `scheme=hex` header."""
    parts = F.split(header, "=")
    return (
        F.when(header.isNull() | (header == ""), "missing")
        .when((F.size(parts) != 2) | (parts[0] != "sha256"), "malformed")
        .when(parts[1] != hmac_sha256(body, secret), "wrong")
        .otherwise("valid")
    )
