"""RTF: LZFu compression, text and HTML extraction. Sequential byte machines, so Arrow UDFs over plain Python functions."""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType

#: Fixed value: what the compression dictionary starts with, per the published format of compressed RTF.
PREFILL = (
    rb"{\rtf1\ansi\mac\deff0\deftab720{\fonttbl;}{\f0\fnil \froman \fswiss \fmodern \fscript \fdecor MS Sans SerifSymbolArial"
    rb"Times New RomanCourier{\colortbl\red0\green0\blue0" b"\n\r" rb"\par \pard\plain\f0\fs20\b\i\u\tab\tx"
)
STORED, PACKED, RING = 0x414C454D, 0x75465A4C, 4096
_HEADER = struct.Struct("<4I")
#: Places that the compressor looks at for a match.
_TRIES = 8
#: What a control byte stands for: numbers of bytes to take as they are, 0 for a reference to the ring.
_RUNS = [[len(r) if r[0] == "0" else 0 for r in re.findall("0+|1", f"{c:08b}"[::-1])] for c in range(256)]


def _earlier(data: bytes) -> list[int]:
    """For each place the nearest earlier one with the same three bytes, else -1."""
    found = np.full(len(data), -1, np.int64)
    if len(data) > 3:
        b = np.frombuffer(data, np.uint8).astype(np.uint64)
        ordered = np.sort((b[:-2] << np.uint64(56)) | (b[1:-1] << np.uint64(48)) | (b[2:] << np.uint64(40)) | np.arange(len(b) - 2, dtype=np.uint64))
        same = ordered[1:] >> np.uint64(40) == ordered[:-1] >> np.uint64(40)
        place = (ordered & np.uint64((1 << 40) - 1)).astype(np.int64)
        found[place[1:][same]] = place[:-1][same]
    return found.tolist()


def decompress(data: bytes) -> bytes:
    """The RTF in a compressed-RTF property; ValueError for another kind of data."""
    if len(data) < _HEADER.size:
        raise ValueError("no compressed RTF header")
    _, size, kind, _ = _HEADER.unpack_from(data)
    body = data[_HEADER.size :]
    if kind == STORED:
        out = body[:size]
    elif kind == PACKED:
        # all that the ring ever held, one byte after another: place k of the ring is the last one of k, k + RING, k + 2 * RING, ...
        found, at, size_in = bytearray(RING) + PREFILL, 0, len(body)
        start = len(found)
        while len(found) - start < size and at < size_in:
            control, at = body[at], at + 1
            for literals in _RUNS[control]:
                end = len(found)
                room = size - (end - start)
                if room <= 0 or at >= size_in:
                    break
                if literals:
                    piece = body[at : at + min(literals, room)]
                    at += len(piece)
                elif at + 1 >= size_in:
                    at = size_in
                    break
                else:
                    word, at = body[at] << 8 | body[at + 1], at + 2
                    first, many = end - 1 - (end - 1 - (word >> 4)) % RING, (word & 15) + 2
                    piece = found[first : first + many]
                    if len(piece) < many:  # a copy that runs into itself
                        piece = (piece * (many // len(piece) + 1))[:many]
                found += piece
        out = bytes(found[start:])
    else:
        raise ValueError(f"unknown compression 0x{kind:08x}")
    return out[:-1] if out.endswith(b"\0") else out


def compress(plain: bytes, stored: bool = False) -> bytes:
    """A compressed-RTF property. At each place the longest match with the ring is taken, of 3 bytes or more, out of the _TRIES nearest
    places with the same three bytes."""
    if stored:
        return _HEADER.pack(len(plain) + 12, len(plain), STORED, 0) + plain
    history, tokens = PREFILL + plain, []
    before, now, end = _earlier(history), len(PREFILL), len(PREFILL) + len(plain)
    while now < end:
        most, low = min(17, end - now), now - RING + 20
        best, where, at = 2, 0, before[now]
        for _ in range(_TRIES):
            if at < 0 or at < low or best >= most:
                break
            if history[at : at + best + 1] == history[now : now + best + 1]:
                where, best = at, best + 1
                while best < most and history[at + best] == history[now + best]:
                    best += 1
            at = before[at]
        if best > 2:
            tokens.append(((where % RING) << 4 | (best - 2)).to_bytes(2))
            now += best
        else:
            tokens.append(history[now : now + 1])
            now += 1
    out = bytearray()
    for at in range(0, len(tokens), 8):
        eight = tokens[at : at + 8]
        out.append(sum((len(t) - 1) << bit for bit, t in enumerate(eight)))
        out += b"".join(eight)
    return _HEADER.pack(len(out) + 12, len(plain), PACKED, 0) + bytes(out)


#: Fixed values, by the RTF specification: destinations whose text is not the document's.
_HIDDEN = frozenset(
    "author buptim colortbl comment creatim doccomm factoidname fldinst fonttbl footer footerf footerl footerr footnote ftncn ftnsep ftnsepc generator header headerf headerl headerr "
    "info keywords latentstyles listoverridetable listtable object operator pict pntext printim private revtbl revtim rsidtbl stylesheet subject tc themedata title txe xe xmlnstbl".split()
)
#: Control words that stand for characters, in plain text; dashes, quotes and spaces in their plain form.
_CHARACTERS = {
    "par": "\n", "line": "\n", "page": "\n", "sect": "\n", "row": "\n", "tab": "\t", "cell": "\t", "endash": "-", "emdash": "-", "emspace": " ", "enspace": " ", "qmspace": " ",
    "ldblquote": '"', "rdblquote": '"', "lquote": "'", "rquote": "'", "bullet": "*",
}
_SYMBOLS = {"~": " ", "_": "-", "\\": "\\", "{": "{", "}": "}", "\n": "\n", "\r": "\n"}
_LEXEME = re.compile(r"(?P<open>\{)|(?P<close>\})|\\(?P<word>[A-Za-z]+)(?P<number>-?\d+)? ?|(?P<bytes>(?:\\'[0-9a-fA-F]{2})+)|\\(?P<symbol>[^A-Za-z])|(?P<text>[^\\{}\r\n]+)", re.S)


@dataclass(frozen=True)
class _Format:
    """What a group hands down to the groups inside it."""

    hidden: bool = False
    bold: bool = False
    italic: bool = False
    fallback: int = 1  # characters that follow a Unicode escape for readers that don't know it
    rendering: bool = False  # inside \htmlrtf: what stands for HTML that is given elsewhere
    tag: str | None = None  # of an HTML tag group: m for a replacement, and its number


class _Reader:
    r"""Text of an RTF stream with the format it stands in, by the specification's reading rules: groups save the format, a
    control word after \* that isn't known hides its group, \u is followed by a fallback, \bin by raw data."""

    def __init__(self, rtf: str):
        self.rtf, self.page = rtf, "cp1252"
        self.now, self.outer, self.starred, self.drop = _Format(), [], False, 0

    def __iter__(self) -> Iterator[tuple[str, _Format]]:
        at = 0
        while m := _LEXEME.search(self.rtf, at):
            at, kind, found = m.end(), m.lastgroup, ""
            if kind == "open":
                self.outer.append(self.now)
            elif kind == "close":
                self.now = self.outer.pop() if self.outer else self.now
            elif m["word"]:
                number = int(m["number"]) if m["number"] else None
                found = self._word(m["word"], number)
                if m["word"] == "bin" and number:
                    at += number
            elif kind == "bytes":
                raw = bytes.fromhex(m["bytes"].replace("\\'", ""))
                skipped = min(self.drop, len(raw))
                self.drop -= skipped
                found = raw[skipped:].decode(self.page, "replace")
            elif kind == "symbol":
                self.starred = m["symbol"] == "*"
                found = _SYMBOLS.get(m["symbol"], "")
            else:
                found = m["text"][self.drop :]
                self.drop = max(0, self.drop - len(m["text"]))
            if kind in ("open", "close"):
                self.drop, self.starred = 0, False
            if found:
                yield found, self.now

    def _word(self, word: str, number: int | None) -> str:
        starred, self.starred = self.starred, False
        on = number != 0
        if word in ("htmltag", "mhtmltag"):
            self.now = replace(self.now, tag=f"{word[:-7]}{'' if number is None else number}", hidden=False)
        elif starred or word in _HIDDEN:
            self.now = replace(self.now, hidden=True)
        elif word == "b":
            self.now = replace(self.now, bold=on)
        elif word == "i":
            self.now = replace(self.now, italic=on)
        elif word == "plain":
            self.now = replace(self.now, bold=False, italic=False)
        elif word == "htmlrtf":
            self.now = replace(self.now, rendering=on)
        elif word == "uc" and number is not None:
            self.now = replace(self.now, fallback=max(number, 0))
        elif word == "ansicpg" and number:
            self.page = _code_page(number)
        elif word == "u" and number is not None:
            self.drop = self.now.fallback
            code = number % 65536
            return "�" if 0xD800 <= code < 0xE000 else chr(code)
        return _CHARACTERS.get(word, "")


def _code_page(number: int) -> str:
    try:
        return codecs.lookup(f"cp{number}").name
    except LookupError:
        return "cp1252"


def to_text(rtf: str, html: bool = False) -> str:
    """Readable text of RTF: all text but that of hidden destinations and HTML tags; as HTML with line breaks, bold and italic."""
    body = ((found, f) for found, f in _Reader(rtf) if not f.hidden and f.tag is None)
    if not html:
        return "".join(found for found, _ in body)
    out, tags = ["<html>\n<body>"], ""
    for found, f in body:
        wanted = "b" * f.bold + "i" * f.italic
        if wanted != tags:
            out += [f"</{t}>" for t in reversed(tags)] + [f"<{t}>" for t in wanted]
            tags = wanted
        out.append(escape(found, quote=False).replace('"', "&quot;").replace("'", "&apos;").replace("\n", "\n<br>"))
    return "".join([*out, *(f"</{t}>" for t in reversed(tags)), "</body>\n</html>\n"])


def embedded_html(rtf: str) -> str | None:
    """The HTML that RTF made from HTML carries: its tag groups, and the text between them that is not for rendering as RTF.
    A replacement tag stands in for the next tag of its number. Null if there is none."""
    if not re.search(r"\\fromhtml(?![A-Za-z])", rtf):
        return None
    out, replaced, dropped, begun = [], set(), None, False
    for found, f in _Reader(rtf):
        if f.hidden or f.rendering:
            continue
        begun = begun or f.tag is not None
        if f.tag is not None and f.tag.startswith("m"):
            replaced.add(f.tag[1:])
            out.append(found)
        elif f.tag in replaced:  # the first text of a tag group whose replacement has been given
            replaced.discard(f.tag)
            dropped = f
        elif begun and f is not dropped:
            out.append(found.replace("\n", "\r\n"))
    text = "".join(out)
    return text if text.strip() else None


def body_rtf(data: bytes | None) -> str | None:
    """Decompressed RTF as text; null where it can't be read."""
    try:
        return None if data is None else decompress(data).decode("cp1252", "replace")
    except (ValueError, IndexError):
        return None


def body_html(rtf: str | None) -> str | None:
    """The HTML that RTF carries, else HTML made from it."""
    return None if rtf is None else embedded_html(rtf) or to_text(rtf, html=True)


def _udf(function: Callable, kind: DataType) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else v)).astype(object)

    return run


rtf_column = _udf(body_rtf, StringType())
text_column = _udf(to_text, StringType())
html_column = _udf(body_html, StringType())


def _pack(text: str) -> bytes:
    return compress(text.encode("cp1252", "replace"))


pack_column = _udf(_pack, BinaryType())
