"""Byte encodings of numbers and places whose byte order is theirs, for exchange with slots that hold them."""

from __future__ import annotations

import math
import struct


def sortable(x: float) -> bytes:
    """Bytes that compare as the numbers do: a big-endian float with its sign folded in, without trailing zeros.

    Minus infinity is empty; plus infinity is nine bytes of 0xff; zero is one byte, 0x80."""
    if x == -math.inf:
        return b""
    if x == math.inf:
        return b"\xff" * 9
    if x == 0:
        return b"\x80"
    n = struct.unpack(">Q", struct.pack(">d", x))[0]
    n = ~n & 2**64 - 1 if n >> 63 else n | 1 << 63
    return struct.pack(">Q", n).rstrip(b"\0") or b"\0"


def number(b: bytes) -> float:
    if not b:
        return -math.inf
    if b == b"\xff" * 9:
        return math.inf
    n = struct.unpack(">Q", b[:8].ljust(8, b"\0"))[0]
    if b == b"\x80":
        return 0.0
    n = n & ~(1 << 63) if n >> 63 else ~n & 2**64 - 1
    return struct.unpack(">d", struct.pack(">Q", n))[0]


def composite_key(values: list[bytes], reverse: list[bool]) -> bytes:
    """One key for several values: parts end in two zero bytes, zeros within are escaped, descending parts are complemented."""
    out = []
    for i, (v, r) in enumerate(zip(values, reverse)):
        body = v.replace(b"\0", b"\0\xff")
        if r:
            out.append(bytes(255 - c for c in body) + b"\xff\xff")
        else:
            out.append(body + (b"\0\0" if i + 1 < len(values) else b""))
    return b"".join(out)
