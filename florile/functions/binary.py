"""Numbers and marks in bytes, and bytes of numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts(c: Column, text: bytes, at: int = 0) -> Column:
    return F.substring(c, at + 1, len(text)) == F.lit(bytearray(text))


def number(c: Column, at: int | Column, size: int, little: bool = False) -> Column:
    """An unsigned whole number of the bytes at a place; null past the end."""
    raw = F.substring(c, at + 1, size) if isinstance(at, int) else F.substring(c, at + 1, F.lit(size))
    hexed = F.hex(raw)
    if little:
        hexed = F.concat(*[F.substring(F.hex(raw), 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    return F.when(F.octet_length(raw) == size, F.conv(hexed, 16, 10).try_cast("long"))


def big(c: Column, size: int) -> Column:
    """A whole number as so many bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(c), 2 * size, "0"))


def little(c: Column, size: int) -> Column:
    """A whole number as so many bytes, the lowest first."""
    hexed = F.lpad(F.hex(c), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in range(size - 1, -1, -1)]))


def raw(*parts: Column | str | bytes) -> Column:
    """Bytes and UTF-8 texts after each other."""
    own = [F.lit(bytearray(p)) if isinstance(p, bytes) else F.lit(bytearray(p.encode())) if isinstance(p, str) else p for p in parts]
    return F.concat(*[p.cast("binary") for p in own])
