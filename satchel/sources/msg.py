"""MSG files: one message as a compound file. Properties are streams named by code and type, a table of fixed-size values, and
a map that gives codes from 0x8000 on their names."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..dictionary import PS_MAPI, PS_PUBLIC_STRINGS
from . import compound
from .rows import from_filetime, scan, typed

_STREAM = re.compile(r"^__substg1\.0_([0-9A-F]{4})([0-9A-F]{4})(?:-([0-9A-F]{8}))?$")
_PART = re.compile(r"^__(substg1|properties_version1|nameid_version1|attach_version1|recip_version1)\.0")
#: Pieces of a multi-valued property that may be missing before its number is taken for a fault.
MOST_GAPS = 4096
_STREAMED = {0x0102, 0x001E, 0x001F, 0x101E, 0x101F, 0x000D, 0x1102}


def guid_text(raw: bytes) -> str:
    a, b, c = struct.unpack_from("<IHH", raw)
    tail = raw[8:16].hex()
    return f"{a:08x}-{b:04x}-{c:04x}-{tail[:4]}-{tail[4:]}"


def name_map(storage: compound.Entry | None) -> dict[int, tuple[int | None, str | None, str]]:
    """Named keys (code, name, namespace) by the codes that stand for them in this file."""
    if storage is None:
        return {}
    data = lambda code: (c.data if (c := storage.child(f"__substg1.0_{code:04X}0102")) and c.data else b"")
    spaces, entries, strings = data(2), data(3), data(4)
    guids = {1: PS_MAPI, 2: PS_PUBLIC_STRINGS} | {k + 3: guid_text(spaces[16 * k : 16 * k + 16]) for k in range(len(spaces) // 16)}
    found = {}
    for at in range(0, len(entries) - 7, 8):
        key, flags, offset = struct.unpack_from("<IHH", entries, at)
        guid = guids.get(flags >> 1, PS_MAPI)
        if flags & 1:
            (n,) = struct.unpack_from("<I", strings, key)
            found[0x8000 + offset] = (None, strings[key + 4 : key + 4 + n].decode("utf-16-le", "replace"), guid)
        else:
            found[0x8000 + offset] = (key & 0xFFFF, None, guid)
    return found


def text8(raw: bytes) -> str:
    """An 8-bit string without one trailing NUL: UTF-8 if it is that, else Windows-1252."""
    raw = raw[:-1] if raw.endswith(b"\0") else raw
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def decode_stream(kind: int, raw: bytes) -> object:
    if kind == 0x001F:
        return raw.decode("utf-16-le", "replace").removesuffix("\0")
    if kind == 0x001E:
        return text8(raw)
    return raw


def fixed_values(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """(code, type, value) of the table of fixed-size values; types that are streams elsewhere are skipped."""
    for at in range(len(raw) % 16, len(raw) - 15, 16):
        (tag,) = struct.unpack_from("<I", raw, at)
        code, kind = tag >> 16, tag & 0xFFFF
        value = raw[at + 8 : at + 16]
        if code == 0 or kind in _STREAMED:
            continue
        if kind == 0x0002:
            yield code, kind, struct.unpack("<h", value[:2])[0]
        elif kind in (0x0003, 0x000A):
            yield code, kind, struct.unpack("<i", value[:4])[0]
        elif kind == 0x000B:
            yield code, kind, struct.unpack("<H", value[:2])[0] != 0
        elif kind == 0x0040:
            yield code, kind, from_filetime(struct.unpack("<Q", value)[0])
        elif kind == 0x0014:
            yield code, kind, struct.unpack("<q", value)[0]
        elif kind == 0x0004:
            yield code, kind, struct.unpack("<f", value[:4])[0]
        elif kind in (0x0005, 0x0007):
            yield code, kind, struct.unpack("<d", value)[0]
        elif kind == 0x0006:
            yield code, kind, struct.unpack("<q", value)[0] / 10_000


def properties(storage: compound.Entry, names: dict) -> Iterator[dict]:
    """Property rows of a storage, in the order of its streams; pieces of multi-valued ones are put together."""
    ord_, pieces = 0, {}

    def row(code: int, kind: int, value: object) -> dict:
        nonlocal ord_
        ord_ += 1
        real = names.get(code) if code >= 0x8000 else None
        own, name, guid = real or (code, None, PS_MAPI)
        return {"ord": ord_ - 1, "code": own, "name": name, "guid": guid, "ptype": kind, **typed(value)}

    for c in storage.children:
        if not c.is_stream:
            continue
        if c.name == "__properties_version1.0":
            for code, kind, value in fixed_values(c.data):
                yield row(code, kind, value)
        elif m := _STREAM.match(c.name):
            code, kind = int(m[1], 16), int(m[2], 16)
            if kind & 0x1000:
                if m[3]:
                    pieces.setdefault((code, kind), {})[int(m[3], 16)] = decode_stream(kind & 0xEFFF, c.data)
                continue
            yield row(code, kind, decode_stream(kind, c.data))
    for (code, kind), found in pieces.items():
        if max(found) > 2 * len(found) + MOST_GAPS:
            yield {"owner": "error", "v_str": f"piece {max(found)} of {len(found)} of property 0x{code:04x}"}
            continue
        yield row(code, kind, [found.get(i) for i in range(max(found) + 1)])


def class_name(storage: compound.Entry) -> str | None:
    stream = storage.child("\x01CompObj")
    return stream.data[32:].split(b"\0")[0].decode("latin-1") or None if stream and stream.data else None


def is_message(storage: compound.Entry) -> bool:
    """True if more than two of a storage's children are named as parts of messages."""
    return sum(bool(_PART.match(c.name)) for c in storage.children) > 2


def message_rows(storage: compound.Entry, item_id: str, names: dict, parent_id: str | None = None) -> Iterator[dict]:
    """Rows of a message, its recipients and attachments; embedded messages are items `item/attachment`, at any depth."""
    waiting = [(storage, item_id, names, parent_id)]
    while waiting:
        storage, item_id, names, parent_id = waiting.pop()
        names = name_map(storage.child("__nameid_version1.0")) or names
        for p in properties(storage, names):
            yield {"item_id": item_id, "parent_id": parent_id, "owner": "message", **p}
        for owner, mark in (("recipient", "__recip_version1.0_"), ("attachment", "__attach_version1.0_")):
            places = [c for c in storage.children if not c.is_stream and c.name.startswith(mark)]
            for ix, place in enumerate(places):
                found = list(properties(place, names))
                if not found and owner == "attachment":
                    continue
                for p in found:
                    yield {"item_id": item_id, "parent_id": parent_id, "owner": owner, "child_ix": ix, **p}
                inner = place.child("__substg1.0_3701000D")
                if inner is not None and not inner.is_stream and is_message(inner):
                    waiting.append((inner, f"{item_id}/{ix}", names, item_id))


def parse(name: str, content: bytes) -> Iterator[dict]:
    return message_rows(compound.read(content), name, {})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Property rows of all MSG files under path; any path that Spark reads. One message is in memory at a time."""
    return scan(spark, path, "*.[mM][sS][gG]", parse)
