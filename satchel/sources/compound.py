"""Compound files (storages and streams in one file), by the published format [MS-CFB]: a reader, and a writer for fixtures."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE, _END, _FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
_MINI_CUTOFF = 4096


@dataclass
class Entry:
    """A stream (data) or storage (children)."""

    name: str
    data: bytes | None = None
    children: list[Entry] = field(default_factory=list)
    created: int = 0
    modified: int = 0

    @property
    def is_stream(self) -> bool:
        return self.data is not None

    def child(self, name: str) -> Entry | None:
        return next((c for c in self.children if c.name == name), None)

    def walk(self) -> Iterator[Entry]:
        yield self
        for c in self.children:
            yield from c.walk()


def read(data: bytes) -> Entry:
    """The root storage of a compound file; ValueError for other data."""
    if data[:8] != SIGNATURE or len(data) < 512:
        raise ValueError("not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    fat_count, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
    cutoff, first_mini, mini_count, first_difat, difat_count = struct.unpack_from("<5I", data, 56)
    size = 1 << shift
    per = size // 4

    def sector(n: int) -> bytes:
        return data[(n + 1) * size : (n + 2) * size].ljust(size, b"\0")

    where = list(struct.unpack_from("<109I", data, 76))
    n = first_difat
    for _ in range(difat_count):
        if n >= _FAT:
            break
        *more, n = struct.unpack(f"<{per}I", sector(n))
        where += more
    table: list[int] = []
    for s in [x for x in where if x < _FAT][:fat_count]:
        table += struct.unpack(f"<{per}I", sector(s))

    def chain(start: int, links: list[int]) -> Iterator[int]:
        seen = 0
        while start < _FAT and start < len(links) and seen <= len(links):
            yield start
            start, seen = links[start], seen + 1

    whole = lambda start: b"".join(sector(s) for s in chain(start, table))
    directory = whole(first_dir)
    raw_mini = whole(first_mini) if mini_count else b""
    mini_links = list(struct.unpack(f"<{len(raw_mini) // 4}I", raw_mini))
    raw = [directory[i : i + 128] for i in range(0, len(directory) - 127, 128)]
    mini_stream = whole(struct.unpack_from("<I", raw[0], 116)[0])

    def stream(start: int, length: int) -> bytes:
        if length < cutoff:
            step = 1 << mini_shift
            return b"".join(mini_stream[s * step : (s + 1) * step] for s in chain(start, mini_links))[:length]
        return whole(start)[:length]

    def entry(i: int, depth: int) -> Entry:
        r = raw[i]
        kind, (child,) = r[66], struct.unpack_from("<I", r, 76)
        name = r[: max(0, struct.unpack_from("<H", r, 64)[0] - 2)].decode("utf-16-le", "replace")
        created, modified = struct.unpack_from("<QQ", r, 100)
        if kind == 2:
            start, length = struct.unpack_from("<IQ", r, 116)
            return Entry(name, stream(start, length & 0xFFFFFFFF), [], created, modified)
        return Entry(name, None, [entry(k, depth + 1) for k in siblings(child)] if depth < 64 else [], created, modified)

    def siblings(i: int) -> list[int]:
        """Ids of a sibling tree in order."""
        out, stack, seen, now = [], [], set(), i
        while stack or now < len(raw):
            while now < len(raw) and now not in seen:
                seen.add(now)
                stack.append(now)
                now = struct.unpack_from("<I", raw[now], 68)[0]
            if not stack:
                break
            now = stack.pop()
            out.append(now)
            now = struct.unpack_from("<I", raw[now], 72)[0]
        return out

    return entry(0, 0)


def write(root: Entry) -> bytes:
    """A compound file of 512-byte sectors with a root storage; siblings hang in a chain to the right."""
    entries: list[tuple[Entry, int]] = []  # entry, id of its first child
    order: list[Entry] = []

    def add(e: Entry) -> int:
        order.append(e)
        return len(order) - 1

    add(root)
    links: dict[int, tuple[int, int]] = {}  # id -> (right, child)
    queue = [0]
    while queue:
        i = queue.pop(0)
        ids = [add(c) for c in sorted(order[i].children, key=lambda c: (len(c.name), c.name.upper()))]
        for a, b in zip(ids, [*ids[1:], _FREE]):
            links[a] = (b, _FREE)
        links[i] = (links.get(i, (_FREE, _FREE))[0], ids[0] if ids else _FREE)
        queue += ids
    del entries
    mini, mini_fat, sectors, fat, place = bytearray(), [], [], [], {}

    def store(body: bytes) -> int:
        """Sectors of a chain; its first."""
        if not body:
            return _END
        first = len(sectors)
        parts = [body[k : k + 512].ljust(512, b"\0") for k in range(0, len(body), 512)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), _END])
        return first

    for i, e in enumerate(order):
        if e.data is None:
            place[i] = (0, 0) if i else (None, 0)
        elif len(e.data) < _MINI_CUTOFF:
            first = len(mini) // 64
            count = -(-len(e.data) // 64)
            mini += e.data.ljust(64 * count, b"\0")
            mini_fat += [*range(first + 1, first + count), _END] if count else []
            place[i] = (first if count else _END, len(e.data))
        else:
            place[i] = (store(e.data), len(e.data))
    place[0] = (store(bytes(mini)), len(mini))
    raw_mini = b"".join(struct.pack("<I", x) for x in mini_fat)
    first_mini = store(raw_mini.ljust(-(-len(raw_mini) // 512) * 512, b"\xff"))
    directory = b""
    for i, e in enumerate(order):
        name = e.name.encode("utf-16-le") + b"\0\0"
        right, child = links.get(i, (_FREE, _FREE))
        kind = 5 if i == 0 else 2 if e.is_stream else 1
        directory += name.ljust(64, b"\0") + struct.pack("<HBB3I16xIQQIQ", len(name), kind, 1, _FREE, right, child, 0, e.created, e.modified, *place[i])
    directory = directory.ljust(-(-len(directory) // 512) * 512, b"\0")
    first_dir = store(directory)
    count = 1
    while count * 128 < len(sectors) + count:
        count += 1
    if count > 109:
        raise ValueError("too large for a fixture")
    own = list(range(len(sectors), len(sectors) + count))
    full = fat + [_FAT] * count
    full += [_FREE] * (count * 128 - len(full))
    sectors += [struct.pack("<128I", *full[128 * k : 128 * k + 128]) for k in range(count)]
    head = SIGNATURE + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, count, first_dir, 0, _MINI_CUTOFF, first_mini, -(-len(raw_mini) // 512), _END, 0, own[0])
    head += struct.pack("<108I", *own[1:], *[_FREE] * (109 - count))
    return head + b"".join(sectors)
