"""Byte forms of numbers and terms, little-endian, for exchange with indexes that store terms as bytes."""

from __future__ import annotations

import struct


def int_to_bytes(i: int) -> bytes:
    """1, 2 or 4 bytes, by the absolute value."""
    size = abs(i)
    return struct.pack("<b" if size < 1 << 7 else "<h" if size < 1 << 15 else "<i", i)


def int_from_bytes(b: bytes) -> int:
    return struct.unpack({1: "<b", 2: "<h", 4: "<i"}[len(b)], b)[0]


def ints_to_bytes(ints, prefix: int | None = None) -> bytes:
    all_ints = ([] if prefix is None else [prefix]) + list(ints)
    return struct.pack(f"<{len(all_ints)}i", *all_ints)


def ints_from_bytes(b: bytes, offset: int = 0, length: int | None = None) -> list[int]:
    n = (len(b) - offset if length is None else length) // 4
    return list(struct.unpack_from(f"<{n}i", b, offset))


def floats_to_bytes(floats) -> bytes:
    return struct.pack(f"<{len(floats)}f", *floats)


def floats_from_bytes(b: bytes, offset: int = 0, length: int | None = None) -> list[float]:
    n = (len(b) - offset if length is None else length) // 4
    return list(struct.unpack_from(f"<{n}f", b, offset))
