"""Small stores, built byte by byte."""

import struct

from satchel.sources.compound import Entry, write

#: A rule that gives a permutation of all byte values.
CIPHER = bytes((i * 167 + 41) % 256 for i in range(256))
DECIPHER = bytes(CIPHER.index(i) for i in range(256))


def stream(code: int, kind: int, data: bytes, place: int | None = None) -> Entry:
    return Entry(f"__substg1.0_{code:04X}{kind:04X}" + (f"-{place:08X}" if place is not None else ""), data)


def fixed(*values: tuple[int, int, bytes], pad: int = 0) -> Entry:
    return Entry("__properties_version1.0", bytes(pad) + b"".join(struct.pack("<II", code << 16 | kind, 6) + data.ljust(8, b"\0") for code, kind, data in values))


def utf16(text: str) -> bytes:
    return text.encode("utf-16-le")


def message_file() -> bytes:
    """A note with two recipients, an attachment, an empty attachment, an embedded message, named and multi-valued properties."""
    address = bytes.fromhex("0420060000000000C000000000000046")
    names = Entry("__nameid_version1.0", None, [
        Entry("__substg1.0_00020102", address),
        Entry("__substg1.0_00030102", struct.pack("<IHH", 0x8005, 3 << 1, 0) + struct.pack("<IHH", 0, 2 << 1 | 1, 1)),
        Entry("__substg1.0_00040102", struct.pack("<I", 16) + utf16("Keywords")),
    ])
    recipient = lambda i, kind, name: Entry(f"__recip_version1.0_#{i:08X}", None, [stream(0x3001, 0x1F, utf16(name)), stream(0x39FE, 0x1E, f"r{i}@example.com\0".encode()), fixed((0x0C15, 3, struct.pack("<i", kind)), pad=8)])
    attachment = Entry("__attach_version1.0_#00000000", None, [stream(0x3707, 0x1F, utf16("a b.bin")), stream(0x3701, 0x0102, bytes(range(256)) * 20)])
    inner = Entry("__substg1.0_3701000D", None, [stream(0x0037, 0x1F, utf16("inner")), stream(0x1000, 0x1F, utf16("inner body")), fixed()])
    nested = Entry("__attach_version1.0_#00000002", None, [stream(0x3001, 0x1F, utf16("nested")), inner])
    return write(Entry("Root Entry", None, [
        names, recipient(0, 1, "'Ann'"), recipient(1, 2, "Bob"), attachment, Entry("__attach_version1.0_#00000001", None, []), nested,
        stream(0x001A, 0x1F, utf16("IPM.Note")), stream(0x0037, 0x1F, utf16("Grüße")), stream(0x0C1E, 0x1F, utf16("SMTP")), stream(0x0C1F, 0x1F, utf16("s@example.com")),
        stream(0x1000, 0x1E, b"line\r\nFrom here\0"), stream(0x8000, 0x1F, utf16("filed")), stream(0x8001, 0x101F, b"", None), stream(0x8001, 0x101F, utf16("one"), 0), stream(0x8001, 0x101F, utf16("two"), 1),
        fixed((0x0017, 3, struct.pack("<i", -2)), (0x0029, 0x0B, b"\x01\x00\xff\xff"), (0x0E06, 0x40, struct.pack("<Q", 116444736000000000 + 10_000_000 * 86400)), pad=8),
    ]))


def nested_file(depth: int) -> bytes:
    """A note that holds a note, and so on, `depth` levels down."""

    def parts(level: int) -> list[Entry]:
        own = [stream(0x001A, 0x1F, utf16("IPM.Note")), stream(0x0037, 0x1F, utf16(f"level {level}")), stream(0x1000, 0x1F, utf16(f"body {level}")), fixed(pad=8)]
        if level < depth:
            own.append(Entry("__attach_version1.0_#00000000", None, [stream(0x3001, 0x1F, utf16("nested")), Entry("__substg1.0_3701000D", None, parts(level + 1))]))
        return own

    return write(Entry("Root Entry", None, parts(0)))


def contact_file() -> bytes:
    return write(Entry("Root Entry", None, [stream(0x001A, 0x1F, utf16("IPM.Contact")), stream(0x0037, 0x1F, utf16("Ann Ex")), stream(0x3A11, 0x1F, utf16("Ex")), stream(0x3A06, 0x1F, utf16("Ann"))]))


def heap(kind: int, values: list[bytes]) -> bytes:
    """A heap block; value k has the reference k << 5, counted from 1, and value 1 is the header."""
    body = struct.pack("<HHI", 8 + sum(map(len, values)), kind, 1 << 5) + b"".join(values)
    offsets, at = [0, 8], 8
    for v in values:
        at += len(v)
        offsets.append(at)
    return body + struct.pack(f"<H{len(offsets)}H", len(values), *offsets)


def property_list(values: list[tuple[int, int, int | bytes]]) -> bytes:
    tuples, data = b"", []
    for code, kind, value in values:
        if isinstance(value, bytes):
            data.append(value)
            value = (2 + len(data)) << 5
        tuples += struct.pack("<HHI", code, kind, value)
    return heap(0xBCEC, [struct.pack("<II", 0x000602B5, 2 << 5), tuples, *data])


def table(columns: list[tuple[int, int, int]], rows: list[list[bytes | int]], wide: bool) -> bytes:
    """columns: (type, code, width); wide values go to the heap."""
    size, schema, at, data, cells = sum(c[2] for c in columns), b"", 0, [], b""
    for i, (kind, code, width) in enumerate(columns):
        schema += struct.pack("<3HBB", kind, code, at, width, i)
        at += width
    for row in rows:
        for (kind, code, width), value in zip(columns, row):
            if isinstance(value, bytes):
                data.append(value)
                value = (3 + len(data)) << 5
            cells += value.to_bytes(width, "little")
    head = struct.pack("<BB4HII", 0x7C, len(columns), 0, 0, 0, size, 2 << 5, 3 << 5).ljust(22, b"\0")
    return heap(0x7CEC, [head + schema, struct.pack("<II", 0x000404B5 if wide else 0x000204B5, 0), cells, *data])


def store_file(version: int, encode: bool = False, chain: bool = False) -> bytes:
    """A store of a root, the top folder, two folders in it, one in the first of these with a message of two recipients and an
    attachment, and a node without data."""
    wide = version == 2003
    word = "Q" if wide else "I"
    blocks: dict[int, bytes] = {
        4: property_list([(0x3001, 0x1E, b"Store"), (0x35E0, 0x0102, bytes(20) + struct.pack("<I", 0x8042)), (0x35E3, 0x0102, bytes(20) + struct.pack("<I", 0x8062))]), 8: property_list([(0x3001, 0x1E, b"Inbox"), (0x3602, 3, 1), (0x360A, 0x0B, 0)]),
        36: property_list([(0x3001, 0x1E, b"Top"), (0x3602, 3, 0)]), 40: property_list([(0x3001, 0x1E, b"Deleted"), (0x3602, 3, 0)]), 44: property_list([(0x3001, 0x1E, b"Lists"), (0x3602, 3, 0)]),
        12: property_list([(0x0037, 0x1E, b"\x01\x05RE: x"), (0x001A, 0x1E, b"IPM.Note"), (0x0017, 3, 0xFFFFFFFE), (0x0E06, 0x40, struct.pack("<Q", 116444736000000000)), (0x802B, 0x101E, struct.pack("<3I", 2, 12, 15) + b"onetwo!")]),
        16: table([(3, 0x0C15, 4), (0x1E, 0x3001, 4)], [[1, b"Ann"], [2, b"Bob"]], wide), 20: table([(3, 0x67F2, 4), (0x1E, 0x3704, 4)], [[0x700F, b"short.txt"]], wide),
        24: property_list([(0x3704, 0x1E, b"long name.txt"), (0x3701, 0x0102, b"data")]),
    }
    sub = [(0x692, 16), (0x671, 20), (0x700F, 24), (0x692, 4)]
    rows = b"".join(struct.pack("<II2Q", a, 0, b, 0) if wide else struct.pack("<3I", a, b, 0) for a, b in sub)
    blocks[30] = struct.pack("<HH", 2, len(sub)).ljust(8 if wide else 4, b"\0") + rows
    if chain:
        blocks[34] = struct.pack("<BBHI", 1, 1, 1, 0) + struct.pack(f"<{word}", 12)
    nodes = [(0x21, 4, 0, 0x21), (0x8022, 8, 0, 0x8042), (0x8042, 36, 0, 0x21), (0x8062, 40, 0, 0x8042), (0x8082, 44, 0, 0x8022), (0x200024, 34 if chain else 12, 30, 0x8082), (0x61, 0, 0, 0x999)]
    body, places = b"", {}
    for i, data in blocks.items():
        places[i] = (2560 + len(body), len(data))
        body += data.translate(CIPHER) if encode and not i & 2 else data
    block_form, node_form, inner_form = (("<QQHHI", "<3QII", "<3Q") if wide else ("<IIHH", "<4I", "<3I"))
    extra = (0,) if wide else ()

    def page(records: list[bytes], level: int) -> bytes:
        out = bytearray(b"".join(records).ljust(512, b"\0"))
        out[0x1E8 if wide else 0x1F0], out[0x1EB if wide else 0x1F3] = len(records), level
        return bytes(out)

    block_page = page([struct.pack(block_form, i, *places[i], 1, *extra) for i in sorted(blocks)], 0)
    node_page = page([struct.pack(node_form, *n, *extra) for n in nodes], 0)
    index = page([struct.pack(inner_form, 0x21, 0, 1536)], 1)
    # places of the published header: in the wide one the maps from 0x100 to 0x200 are filled with 0xFF
    head, word = bytearray(1024), "<Q" if wide else "<I"
    if wide:
        head[0x100:0x200] = b"\xff" * 256
        head[0x200] = 0x80
    head[:4], head[0x0A], head[0x201 if wide else 0x1CD] = b"!BDN", 0x17 if wide else 0x0E, int(encode)
    struct.pack_into(word, head, 0xE0 if wide else 0xBC, 2048)
    struct.pack_into(word, head, 0xF0 if wide else 0xC4, 1024)
    struct.pack_into(word, head, 0xB8 if wide else 0xA8, 2560 + len(body))
    return bytes(head) + block_page + node_page + index + body
