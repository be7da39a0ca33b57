"""PST stores, versions 1997 (32-bit) and 2003 (64-bit): header, block and node trees, sub-node maps, property lists, tables.

A store is read as a whole by one task (binaryFile rows are limited to 2 GB); many stores are read side by side.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..dictionary import PS_MAPI
from .msg import text8
from .rows import from_filetime, scan, typed

MAGIC = b"!BDN"
ROOT_NODE = 0x21
ATTACHMENTS, RECIPIENTS, ATTACHMENT_ID = 0x671, 0x692, 0x67F2
SUBTREE, WASTEBASKET, FINDER = 0x35E0, 0x35E3, 0x35E7
SUBJECT = 0x0037


@dataclass(frozen=True)
class Layout:
    """Places and record formats that differ between the versions. A record's first fields are its id and what follows."""

    root_nodes: int
    root_blocks: int
    size_at: int
    count_at: int
    level_at: int
    encryption_at: int
    block: struct.Struct
    node: struct.Struct
    inner: struct.Struct
    sub: struct.Struct
    sub_at: int
    word: str
    most: tuple[int, int, int]


#: Fixed values by version: file offsets, record formats, and the most blocks, nodes and inner records of a page.
LAYOUTS = {
    0x0E: Layout(0xBC, 0xC4, 0xA8, 0x1F0, 0x1F3, 0x1CD, struct.Struct("<IIHH"), struct.Struct("<4I"), struct.Struct("<3I"), struct.Struct("<3I"), 4, "I", (41, 31, 41)),
    0x17: Layout(0xE0, 0xF0, 0xB8, 0x1E8, 0x1EB, 0x201, struct.Struct("<QQHHI"), struct.Struct("<3QII"), struct.Struct("<3Q"), struct.Struct("<II2Q"), 8, "Q", (20, 15, 20)),
}


class Store:
    """A store in memory. cipher: the table that decodes data blocks, or none for plain stores."""

    def __init__(self, data: bytes, cipher: bytes | None = None):
        if data[:4] != MAGIC:
            raise ValueError("bad signature")
        self.data, self.kind = data, data[0x0A]
        if self.kind not in LAYOUTS:
            raise ValueError(f"unknown index type 0x{self.kind:02x}")
        self.layout = LAYOUTS[self.kind]
        self.encryption = data[self.layout.encryption_at]
        if self.encryption not in (0, 1):
            raise ValueError(f"unknown encryption {self.encryption}")
        if self.encryption and cipher is None:
            raise ValueError("the store is encoded; give the cipher's table")
        self.cipher = cipher if self.encryption else None
        self.size = struct.unpack_from(f"<{self.layout.word}", data, self.layout.size_at)[0]
        if self.size != len(data):
            raise ValueError(f"the header says {self.size} bytes, the file has {len(data)}")

    @property
    def version(self) -> int:
        return 2003 if self.kind == 0x17 else 1997

    def _tree(self, root_at: int, record: struct.Struct, most: int) -> Iterator[tuple]:
        (offset,) = struct.unpack_from(f"<{self.layout.word}", self.data, root_at)
        stack = [(offset, None, 0)]
        while stack:
            offset, start, depth = stack.pop()
            page = self.data[offset : offset + 512]
            if len(page) < 512 or depth > 16:
                raise ValueError(f"bad index page at {offset}")
            count, leaf = page[self.layout.count_at], page[self.layout.level_at] == 0
            form = record if leaf else self.layout.inner
            if count > (most if leaf else self.layout.most[2]):
                raise ValueError(f"too many records in the index page at {offset}")
            rows = []
            for i in range(count):
                row = form.unpack_from(page, i * form.size)
                if row[0] == 0:
                    break
                rows.append(row)
            if rows and start and rows[0][0] != start:
                raise ValueError(f"index page at {offset} starts with another id")
            if leaf:
                yield from rows
            else:
                stack += [(r[2], r[0], depth + 1) for r in reversed(rows)]

    @functools.cached_property
    def blocks(self) -> dict[int, tuple[int, int]]:
        """(offset, size) by id; of a repeated id the last."""
        return {r[0]: (r[1], r[2]) for r in self._tree(self.layout.root_blocks, self.layout.block, self.layout.most[0])}

    @functools.cached_property
    def nodes(self) -> list[tuple[int, int, int, int]]:
        """(node, data block, sub-node block, parent) in order; of a repeated node the last."""
        found = {r[0]: (r[0], r[1], r[2], r[3]) for r in self._tree(self.layout.root_nodes, self.layout.node, self.layout.most[1])}
        return list(found.values())

    def raw(self, block: int) -> bytes:
        if block not in self.blocks:
            raise ValueError(f"no block {block}")
        offset, size = self.blocks[block]
        data = self.data[offset : offset + size]
        return data.translate(self.cipher) if self.cipher and not block & 2 else data

    def chain(self, block: int, inside: tuple[int, ...] = ()) -> list[int]:
        """Data blocks behind a block: itself, or those that a chain lists, level by level."""
        if not block & 2:
            return [block]
        if block in inside:
            raise ValueError(f"chain block {block} is inside itself")
        data = self.raw(block)
        kind, levels, count = struct.unpack_from("<BBH", data)
        if kind != 1:
            return [block]
        ids = struct.unpack_from(f"<{count}{self.layout.word}", data, 8)
        return list(ids) if levels == 1 else [b for i in ids for b in self.chain(i, (*inside, block))]

    def chunks(self, block: int) -> list[bytes]:
        return [self.raw(b) for b in self.chain(block)]

    def submap(self, block: int) -> dict[int, int]:
        """Blocks by sub-node id; of a repeated id the first."""
        out: dict[int, int] = {}
        stack, seen = [block], set()
        while stack:
            now = stack.pop(0)
            if now in seen:
                continue
            seen.add(now)
            data = self.raw(now)
            kind, count = struct.unpack_from("<HH", data)
            if kind != 2:
                raise ValueError(f"block {now} is no sub-node map")
            nested = []
            for i in range(count):
                row = self.layout.sub.unpack_from(data, self.layout.sub_at + i * self.layout.sub.size)
                out.setdefault(row[0], row[-2])
                if row[-1]:
                    nested.append(row[-1])
            stack = nested + stack
        return out


class Heap:
    """The values of a node: data chunks with allocation tables, and a map of sub-nodes."""

    def __init__(self, store: Store, block: int, sub: dict[int, int]):
        self.store, self.sub, self.chunks = store, sub, store.chunks(block)
        table_at, self.kind, self.first = struct.unpack_from("<HHI", self.chunks[0])
        self.ranges = []
        for i, chunk in enumerate(self.chunks):
            at = table_at if i == 0 else struct.unpack_from("<H", chunk)[0]
            (count,) = struct.unpack_from("<H", chunk, at)
            offsets = struct.unpack_from(f"<{count + 2}H", chunk, at + 2)
            self.ranges.append(list(zip(offsets, offsets[1:])))

    def get(self, ref: int) -> bytes | None:
        """The bytes behind a reference: none for 0, empty for a bad one."""
        if ref == 0:
            return None
        if ref & 0xF == 0xF:
            return b"".join(self.store.chunks(self.sub[ref])) if ref in self.sub else b""
        high = ref >> 4
        if ref & 0xF or high & 1:
            return b""
        block, slot = high // 4096, high % 4096 // 2
        if block >= len(self.chunks) or slot >= len(self.ranges[block]):
            return b""
        a, b = self.ranges[block][slot]
        return self.chunks[block][a:b] if a <= b else b""

    def value(self, code: int, kind: int, raw: int | bytes) -> object:
        """A typed value from an immediate number, a reference, or the bytes themselves."""
        if kind == 0x000B:
            return raw != 0
        if kind == 0x0002:
            return struct.unpack("<h", struct.pack("<I", raw)[:2])[0]
        if kind in (0x0003, 0x000A):
            return struct.unpack("<i", struct.pack("<I", raw))[0]
        data = self.get(raw) if isinstance(raw, int) else raw
        if data is None or kind == 0x0001:
            return None
        if kind == 0x001E or kind == 0x001F:
            text = text8(data) if kind == 0x001E else data.decode("utf-16-le", "replace")
            return text[2:] if code == SUBJECT and text.startswith("\x01") else text
        if kind == 0x0040 and len(data) == 8:
            return from_filetime(struct.unpack("<Q", data)[0])
        if kind == 0x0014 and len(data) == 8:
            return struct.unpack("<q", data)[0]
        if kind == 0x0005 and len(data) == 8:
            return struct.unpack("<d", data)[0]
        if kind == 0x000D and len(data) >= 4:
            inner = struct.unpack_from("<I", data)[0]
            return b"".join(self.store.chunks(self.sub[inner])) if inner in self.sub else data
        if kind in (0x101E, 0x101F, 0x1102) and len(data) >= 4:
            (n,) = struct.unpack_from("<I", data)
            ends = [*struct.unpack_from(f"<{n}I", data, 4), len(data)]
            pieces = [data[a:b] for a, b in zip(ends, ends[1:])]
            return pieces if kind == 0x1102 else [p.decode("utf-16-le", "replace") if kind == 0x101F else text8(p) for p in pieces]
        return data

    def properties(self) -> Iterator[tuple[int, int, object]]:
        """(code, type, value) of a property list."""
        head = self.get(self.first) or b""
        if self.kind != 0xBCEC or len(head) < 8:
            raise ValueError("no property list")
        signature, index = struct.unpack_from("<II", head)
        if signature != 0x000602B5:
            raise ValueError(f"unknown property list 0x{signature:08x}")
        data = self.get(index) or b""
        for at in range(0, len(data) - 7, 8):
            code, kind, raw = struct.unpack_from("<HHI", data, at)
            yield code, kind, self.value(code, kind, raw)

    def rows(self) -> Iterator[list[tuple[int, int, object]]]:
        """The rows of a table, each as (code, type, value)."""
        head = self.get(self.first) or b""
        if self.kind != 0x7CEC or len(head) < 22:
            raise ValueError("no table")
        mark, count, *_, size, index, data_ref = struct.unpack_from("<BB4HII", head)
        columns = [struct.unpack_from("<3HBB", head, 22 + 8 * i) for i in range((len(head) - 22) // 8)]
        if mark != 0x7C or count != len(columns) or size <= 0:
            raise ValueError("bad table header")
        kinds = {1997: 0x000204B5, 2003: 0x000404B5}
        head2 = self.get(index) or b""
        if len(head2) < 8 or struct.unpack_from("<I", head2)[0] != kinds[self.store.version]:
            raise ValueError("unknown table index")
        if data_ref & 0xF == 0xF and data_ref in self.sub:
            data = b"".join(c[: len(c) // size * size] for c in self.store.chunks(self.sub[data_ref]))
        else:
            data = self.get(data_ref) or b""
        for at in range(0, len(data) - size + 1, size):
            row = []
            for kind, code, offset, width, _ in columns:
                cell = data[at + offset : at + offset + width]
                row.append((code, kind, self.value(code, kind, int.from_bytes(cell, "little") if width <= 4 else cell)))
            yield row


def _rows(values: list[tuple[int, int, object]], **base: object) -> Iterator[dict]:
    for i, (code, kind, value) in enumerate(values):
        yield {**base, "ord": i, "code": code, "guid": PS_MAPI, "ptype": kind, **typed(value)}


def node_rows(store: Store, node: tuple[int, int, int, int]) -> Iterator[dict]:
    """Rows of a node's properties, recipients and attachments (the attachment's own list laid over its table row)."""
    node_id, block, sub_block, parent = node
    base = {"item_id": str(node_id), "parent_id": str(parent)}
    if not block:
        return
    sub = store.submap(sub_block) if sub_block else {}
    yield from _rows(list(Heap(store, block, sub).properties()), **base, owner="message")
    if RECIPIENTS in sub:
        for ix, row in enumerate(Heap(store, sub[RECIPIENTS], sub).rows()):
            yield from _rows(row, **base, owner="recipient", child_ix=ix)
    if ATTACHMENTS in sub:
        for ix, row in enumerate(Heap(store, sub[ATTACHMENTS], sub).rows()):
            merged = {code: (code, kind, value) for code, kind, value in row}
            own = merged.get(ATTACHMENT_ID)
            if own and isinstance(own[2], int) and own[2] in sub:
                merged |= {p[0]: p for p in Heap(store, sub[own[2]], sub).properties()}
            yield from _rows(list(merged.values()), **base, owner="attachment", child_ix=ix)


def parser(cipher: bytes | None):
    def parse(name: str, content: bytes) -> Iterator[dict]:
        store = Store(content, cipher)
        for node in store.nodes:
            try:
                yield from node_rows(store, node)
            except (ValueError, IndexError, KeyError, struct.error) as e:
                yield {"item_id": str(node[0]), "parent_id": str(node[3]), "owner": "error", "v_str": f"{type(e).__name__}: {e}"}

    return parse


def read(spark: SparkSession, path: str, cipher: bytes | None = None) -> DataFrame:
    """Property rows of all stores under path; items that can't be read are error rows."""
    return scan(spark, path, "*.[pP][sS][tT]", parser(cipher))
