"""Binary decoding with Spark SQL expressions alone.

reverse(binary) reverses UTF-8 characters, not bytes, so byte order is turned in the hexadecimal text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: 100-nanosecond ticks between 1601-01-01 and 1970-01-01.
FILETIME_EPOCH = 116444736000000000


def _turned_hex(data: Column) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))), "")


def le_uint(data: Column) -> Column:
    """Little-endian unsigned integer of up to 8 bytes as decimal(20, 0); null for no bytes."""
    return F.when(F.octet_length(data) > 0, F.conv(_turned_hex(data), 16, 10).cast("decimal(20,0)"))


def le_uint_at(data: Column, offset: int, size: int) -> Column:
    """le_uint of `size` bytes at a zero-based offset, as long (sizes to 7 bytes)."""
    return le_uint(F.substring(data, offset + 1, size)).cast("long")


def le_int32(data: Column) -> Column:
    """Signed 32-bit little-endian integer."""
    raw = le_uint(data).cast("long")
    return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw).cast("int")


def tag_code(tag: Column) -> Column:
    """Upper half of a 32-bit property tag."""
    return F.shiftrightunsigned(tag.cast("long"), 16).bitwiseAND(F.lit(0xFFFF)).cast("int")


def tag_type(tag: Column) -> Column:
    """Lower half of a 32-bit property tag."""
    return tag.cast("long").bitwiseAND(F.lit(0xFFFF)).cast("int")


def parse_hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def hex4(code: Column) -> Column:
    """A code as four lower-case hex digits, more if it has more."""
    digits = F.lower(F.hex(code.cast("long")))
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))


def guid_text(data: Column) -> Column:
    """The usual text of a 16-byte GUID: three little-endian groups, then two in byte order."""
    part = lambda at, n: F.lower(_turned_hex(F.substring(data, at, n)))
    plain = lambda at, n: F.lower(F.hex(F.substring(data, at, n)))
    return F.when(F.octet_length(data) == 16, F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2), plain(9, 2), plain(11, 6)))


def filetime(ticks: Column) -> Column:
    """Timestamp of a FILETIME."""
    return F.timestamp_micros(F.floor((ticks.cast("decimal(20,0)") - F.lit(FILETIME_EPOCH).cast("decimal(20,0)")) / 10).cast("long"))


def filetime_div(ticks: Column) -> Column:
    """As filetime, for ticks that are a long, by integer division."""
    return F.timestamp_micros(F.floor((ticks - F.lit(FILETIME_EPOCH)) / 10).cast("long"))


def utf16(data: Column) -> Column:
    return F.decode(data, "UTF-16LE")


def chomp_nul(text: Column) -> Column:
    """Without one trailing NUL."""
    return F.regexp_replace(text, r"\x00$", "")


def base64_lines(data: Column, width: int = 60) -> Column:
    """Base64 in lines of `width` characters, each ended by CRLF."""
    flat = F.regexp_replace(F.base64(data), r"\s", "")
    return F.regexp_replace(flat, f"(.{{1,{width}}})", "$1\r\n")


def entry_id_node(data: Column) -> Column:
    """Node id in a store entry id: 4 bytes, a GUID, then the id."""
    return le_uint_at(data, 20, 4)


def heap_reference(ref: Column) -> Column:
    """kind (none, subnode, heap, bad), block and slot of a heap reference."""
    low, high = ref.bitwiseAND(F.lit(0xF)), F.shiftrightunsigned(ref, 4)
    odd = (low != 0) | (high.bitwiseAND(F.lit(1)) != 0)
    kind = F.when(ref == 0, "none").when(low == 0xF, "subnode").when(odd, "bad").otherwise("heap")
    heap = kind == "heap"
    return F.struct(kind.alias("kind"), F.when(heap, F.floor(high / 4096).cast("int")).alias("block"), F.when(heap, F.floor((high % 4096) / 2).cast("int")).alias("slot"))


def class_name(stream: Column) -> Column:
    """Class name in an OLE \\1CompObj stream: what stands from byte 32 to a NUL."""
    return F.nullif(F.regexp_extract(F.decode(stream, "ISO-8859-1"), r"(?s)^.{32}([^\x00]+)", 1), F.lit(""))


def metafile_size(data: Column) -> Column:
    """width and height at 96 dots an inch, of a placeable metafile; null for other data."""
    at = lambda i: F.when(le_uint_at(data, i, 2) >= 32768, le_uint_at(data, i, 2) - 65536).otherwise(le_uint_at(data, i, 2))
    inch = le_uint_at(data, 14, 2)
    size = F.struct(F.floor((at(10) - at(6)) * 96 / inch).cast("int").alias("width"), F.floor((at(12) - at(8)) * 96 / inch).cast("int").alias("height"))
    return F.when((le_uint_at(data, 0, 4) == 0x9AC6CDD7) & (inch > 0), size)


def pairs(offsets: Column) -> Column:
    """[from, to) ranges of consecutive offsets."""
    return F.arrays_zip(F.slice(offsets, 1, F.greatest(F.size(offsets) - 1, F.lit(0))).alias("from"), F.slice(offsets, 2, F.greatest(F.size(offsets) - 1, F.lit(0))).alias("to"))


def le_hex(digits: Column, at: Column | int, size: int) -> Column:
    """Little-endian unsigned integer of `size` bytes at a zero-based byte offset of hexadecimal text; null where the text is too
    short, or the number is none that a long holds. For many numbers of one text."""
    at = F.lit(at) if isinstance(at, int) else at
    turned = F.concat(*[F.substring(digits, (at + (size - 1 - i)) * 2 + 1, F.lit(2)) for i in range(size)])
    return F.when(F.length(digits) >= (at + size) * 2, F.conv(turned, 16, 10).try_cast("long"))


def le_long(data: Column) -> Column:
    """Signed 64-bit little-endian integer of the first 8 bytes."""
    return F.conv(_turned_hex(F.substring(data, 1, 8)), 16, -10).cast("long")


def le_double(data: Column) -> Column:
    """The number of 8 bytes in the usual binary form, from its sign, exponent and digits."""
    h = F.hex(data)
    low, high = le_hex(h, 0, 4), le_hex(h, 4, 4)
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
    digits = high.bitwiseAND(F.lit(0xFFFFF)) * F.lit(1 << 32) + low
    finite = F.when(exponent > 0, digits + F.lit(1 << 52)).otherwise(digits).cast("double") * F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) - 1075)
    size = F.when(exponent < 0x7FF, finite).when(digits == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(high >= 1 << 31, -size).otherwise(size)


#: What the bytes 0x80 to 0x9F mean in Windows-1252, where ISO-8859-1 has control characters.
_WINDOWS = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))


def text8(data: Column) -> Column:
    """An 8-bit string without one trailing NUL: UTF-8 if it is that, else Windows-1252."""
    size = F.octet_length(data)
    bare = F.when((size > 0) & (F.hex(F.substring(data, size, F.lit(1))) == "00"), F.substring(data, F.lit(1), size - 1)).otherwise(data)
    windows = F.translate(F.decode(bare, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), _WINDOWS)
    return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string")).otherwise(windows)


def utf16_text(data: Column) -> Column:
    """UTF-16LE text; what is no character, such as half of a pair or an odd last byte, becomes U+FFFD."""
    size = F.octet_length(data)
    even = F.substring(data, F.lit(1), size - size % 2)
    units = F.regexp_extract_all(F.hex(even), F.lit("(....)"), F.lit(1))
    high, low = (lambda u: u.rlike("^..D[89AB]")), (lambda u: u.rlike("^..D[CDEF]"))
    next_ = lambda i: F.coalesce(F.get(units, i + 1), F.lit(""))
    before = lambda i: F.coalesce(F.get(units, i - 1), F.lit(""))
    mended = F.transform(units, lambda u, i: F.when((high(u) & ~low(next_(i))) | (low(u) & ~high(before(i))), F.lit("FDFF")).otherwise(u))
    whole = F.decode(F.when(F.hex(even).rlike("D[89A-F]"), F.unhex(F.array_join(mended, ""))).otherwise(even), "UTF-16LE")
    return F.when(size % 2 == 1, F.concat(whole, F.lit("\ufffd"))).otherwise(whole)


def heap_table(block: Column, at: Column) -> Column:
    """Allocation ranges of a heap block whose table starts at a zero-based offset: a count n, a number that is no offset,
    and n + 1 offsets. The first range is that of the number and the first offset, so that slots count from 1. Null if the block
    ends before its table."""
    h = F.hex(block)
    count = le_hex(h, at, 2)
    offsets = F.transform(F.sequence(F.lit(0).cast("long"), count + 1), lambda i: le_hex(h, at + 2 + 2 * i, 2).cast("int"))
    return F.when(at + 2 + 2 * (count + 2) <= F.octet_length(block), pairs(offsets))


def multi_value(data: Column) -> Column:
    """Pieces of a counted multi-value blob: a count, as many offsets, and pieces that end where the next starts. Null if the count is
    more than the blob holds offsets."""
    h, size = F.hex(data), F.octet_length(data)
    count = le_hex(h, 0, 4)
    start = lambda i: le_hex(h, 4 * i + 4, 4).cast("int")
    end = lambda i: F.when(i + 1 < count, start(i + 1)).otherwise(size)
    cut = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.substring(data, start(i) + 1, F.greatest(end(i) - start(i), F.lit(0))))
    return F.when(4 * count + 4 > size, F.lit(None).cast("array<binary>")).when(count > 0, cut).otherwise(F.array().cast("array<binary>"))
