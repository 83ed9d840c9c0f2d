"""Digests and digest-derived random draws.

Draws depend only on their label, so a lost task that runs again repeats its
numbers, and any SQL engine with md5 can reproduce them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS_PER_DIGEST = 4
_HEX_PER_DRAW = 8


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def text_key(text: Column) -> Column:
    """Fixed-width stand-in for a lower-cased text, so shuffles carry no second copy of it."""
    return F.unhex(sha256(F.lower(text)))


def seeded_key(seed: int, value: Column) -> Column:
    """Random-looking, repeatable sort key of a group name."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")))


def digest(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw(digest_hex: Column, position: int, bound: Column) -> Column:
    """Draw ``position`` (0..3) of a digest, as an integer in ``[0, bound)``."""
    piece = F.substring(digest_hex, 1 + _HEX_PER_DRAW * position, _HEX_PER_DRAW)
    return F.conv(piece, 16, 10).cast("long") % bound
