"""Key arithmetic and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_end(prefix):
    """The smallest key above all keys with a prefix, or None if there is none; for text, of code points below U+10FFFF."""
    top = chr(0x10FFFF) if isinstance(prefix, str) else b"\xff"
    cut = prefix.rstrip(top)
    if not cut:
        return None
    if isinstance(prefix, str):
        following = ord(cut[-1]) + 1
        return cut[:-1] + chr(0xE000 if following == 0xD800 else following)
    return cut[:-1] + bytes([cut[-1] + 1])


def successor(key: bytes, most: int) -> bytes | None:
    """The smallest key above one, among keys of at most so many bytes."""
    return key + b"\0" if len(key) < most else prefix_end(key)


def successor_of(key: Column) -> Column:
    """The smallest binary key above a key that may grow."""
    return F.concat(key, F.unhex(F.lit("00")))


def decimal_key(number: Column, digits: int = 16) -> Column:
    return F.lpad(number.cast("string"), digits, "0")


def tick_bytes(tick: Column) -> Column:
    """Eight big-endian bytes of a tick."""
    return F.unhex(F.lpad(F.hex(tick), 16, "0"))


def tick_of(key: Column) -> Column:
    """The tick that a key begins with."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, 10).cast("long")


def recorder_key(tick: Column, kind: Column, number: Column) -> Column:
    """Tick, kind letter and sensor number."""
    return F.concat(tick_bytes(tick), kind.cast("binary"), F.unhex(F.lpad(F.hex(number), 2, "0")))


def key_kind(key: Column) -> Column:
    return F.substring(key, 9, 1).cast("string")


def key_number(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 10, 1)), 16, 10).cast("int")


def unsigned(raw: Column) -> Column:
    """The unsigned number of eight little-endian bytes, as decimal."""
    digits = F.concat(*[F.substring(F.hex(raw), 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def temperature(raw: Column) -> Column:
    """Degrees of a sensor value: 15 and hundredths of its number modulo 2000."""
    return F.lit(15.0) + (unsigned(raw) % F.lit(2000)).cast("double") / F.lit(100.0)


#: The name of an archived segment's object, by its number.
OBJECT_NAME = "tables/%010d"


def object_name(number: Column) -> Column:
    return F.format_string(OBJECT_NAME, number)
