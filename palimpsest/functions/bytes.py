"""Column expressions over BINARY: fixed-width readers, checksums, Latin-1 text, name folding and hashing.

Everything is a built-in expression, so decoding stays in the JVM. Reads past the end give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 4294967296


def part(data: Column, offset, size: int) -> Column:
    """`size` bytes at a byte offset (int or column), null if the value ends before."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return F.when((at >= 0) & (F.octet_length(data) >= at + size), F.substring(data, at + 1, F.lit(size)))


def unsigned(data: Column, offset, size: int) -> Column:
    """Big-endian unsigned number of up to 7 bytes, as BIGINT."""
    return F.conv(F.hex(part(data, offset, size)), 16, 10).cast("bigint")


def u8(data: Column, offset) -> Column:
    return unsigned(data, offset, 1)


def u16(data: Column, offset) -> Column:
    return unsigned(data, offset, 2)


def u32(data: Column, offset) -> Column:
    return unsigned(data, offset, 4)


def i16(data: Column, offset) -> Column:
    x = u16(data, offset)
    return F.when(x >= 32768, x - 65536).otherwise(x)


def i32(data: Column, offset) -> Column:
    x = u32(data, offset)
    return F.when(x >= WORD // 2, x - WORD).otherwise(x)


def u16_le(data: Column, offset) -> Column:
    return u8(data, offset) + 256 * u8(data, offset + 1)


def u32_le(data: Column, offset) -> Column:
    return u16_le(data, offset) + 65536 * u16_le(data, offset + 2)


def longs(data: Column) -> Column:
    """All whole 32-bit numbers of a value."""
    n = F.octet_length(data)
    each = F.transform(F.sequence(F.lit(0), n - 4, F.lit(4)), lambda o: F.conv(F.hex(F.substring(data, o + 1, F.lit(4))), 16, 10).cast("bigint"))
    return F.when(n >= 4, each).otherwise(F.array().cast("array<bigint>"))


def sum32(data: Column) -> Column:
    return F.aggregate(longs(data), F.lit(0).cast("bigint"), lambda a, v: (a + v) % WORD)


def sums_to_zero(data: Column) -> Column:
    return sum32(data) == 0


def block_checksum(data: Column, field: int) -> Column:
    """What the checksum long at `field` must be for the block's longs to sum to zero."""
    return F.pmod(u32(data, field) - sum32(data), F.lit(WORD))


def boot_checksum(data: Column) -> Column:
    """Complement of the end-around-carry sum of all longs but the second."""
    rest = F.concat(F.slice(longs(data), 1, 1), F.slice(longs(data), 3, 1 << 20))
    total = F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, v: F.when(a + v >= WORD, a + v - WORD + 1).otherwise(a + v))
    return F.lit(WORD - 1) - total


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def counted_text(data: Column, at, most: int) -> Column:
    """Latin-1 text after a length byte, at most `most` characters."""
    n = F.least(u8(data, at), F.lit(most)).cast("int")
    start = at if isinstance(at, Column) else F.lit(at)
    return latin1(F.substring(data, start + 2, n))


_LOWER = "".join(chr(c) for c in range(ord("a"), ord("z") + 1))
_INTL = "".join(chr(c) for c in range(224, 255) if c != 247)


def fold(name: Column, international: bool) -> Column:
    """Upper case as the file systems take it: a-z, and with `international` also 224 to 254 without 247."""
    source = _LOWER + (_INTL if international else "")
    return F.translate(name, source, "".join(chr(ord(c) - 32) for c in source))


def name_hash(name: Column, table_size, international: bool = False) -> Column:
    """Slot of a name in a directory's hash table."""
    letters = F.filter(F.split(fold(name, international), ""), lambda c: c != "")
    h = F.aggregate(letters, F.length(name).cast("bigint"), lambda a, c: (a * 13 + F.ascii(c)).bitwiseAND(2047))
    return h % (table_size if isinstance(table_size, Column) else F.lit(table_size))


def datestamp(days: Column, minutes: Column, ticks: Column) -> Column:
    """Days since 1978-01-01, minutes, fiftieths of a second as struct(date, hour, minute, second, faults); out-of-range parts are told, not mended."""
    faults = F.filter(
        F.array(
            F.when(days == 0, "day-zero"), F.when((minutes < 0) | (minutes >= 1440), "minutes-range"), F.when((ticks < 0) | (ticks >= 3000), "ticks-range")
        ),
        lambda x: x.isNotNull(),
    )
    return F.struct(
        F.date_add(F.lit("1978-01-01").cast("date"), days.cast("int")).alias("date"), F.floor(minutes / 60).cast("int").alias("hour"),
        (minutes % 60).cast("int").alias("minute"), F.floor(ticks / 50).cast("int").alias("second"), faults.alias("faults"),
    )


def host_name(name: Column) -> Column:
    """A name that any host takes: %XX for separators, controls and the special names."""
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    code = lambda c: F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))
    out = F.array_join(F.transform(letters, lambda c: F.when(c.isin("/", "%") | (F.ascii(c) < 32) | (F.ascii(c) == 127), code(c)).otherwise(c)), "")
    return F.when(name == "", "%00").when(name == ".", "%2E").when(name == "..", "%2E%2E").otherwise(out)


def printable_runs(data: Column, least: int = 10) -> Column:
    return F.regexp_extract_all(latin1(data), F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0))


def bare_name_in(text: Column, name: str) -> Column:
    """Whether a name stands in a text with no name character before it."""
    import re

    return F.regexp_like(text, F.lit("(?<![A-Za-z0-9_.])" + re.escape(name)))


def u64(data: Column, offset) -> Column:
    """As DECIMAL(20, 0), since BIGINT is signed."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return (u32(data, at).cast("decimal(20,0)") * WORD + u32(data, at + 4)).cast("decimal(20,0)")


def big_endian(number: Column, size: int) -> Column:
    """The lowest `size` bytes (up to 8) of a whole number."""
    return F.unhex(F.substring(F.lpad(F.hex(number.cast("bigint")), 16, "0"), 17 - 2 * size, 2 * size))


def put(data: Column, offset: int, number: Column, size: int) -> Column:
    """The bytes with a number written at a place; null where it doesn't fit."""
    fits = F.octet_length(data) >= offset + size
    return F.when(fits, F.concat(F.substring(data, 1, offset), big_endian(number, size), F.substring(data, offset + size + 1, 1 << 30)))


def repeated_long(data: Column) -> Column:
    """Whether all of a block's longs are equal, as in one that was never written."""
    return F.hex(data) == F.repeat(F.hex(F.substring(data, 1, 4)), (F.octet_length(data) / 4).cast("int"))


def quoted(text: Column) -> Column:
    """Text in double quotes with escapes."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for letter, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(letter), F.lit(name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def wordlike(data: Column) -> Column:
    """Whether bytes read like text: at most a quarter above ASCII, at least four letters of which seven tenths are letters, digits or spaces."""
    s = latin1(data)
    n = F.length(s)
    high = n - F.length(F.regexp_replace(s, "[\\x80-\\xFF]", ""))
    good = F.length(F.regexp_replace(s, "[^A-Za-z0-9 ]", ""))
    return (n >= 4) & (4 * high <= n) & (10 * good >= 7 * n)
