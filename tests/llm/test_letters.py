"""Pre-tokens where the Unicode versions of Python's regex package and of tiktoken differ, in six places of a line each."""

import base64

import pyarrow as pa
import pytest
import regex
import tiktoken

from satchel.llm import op05_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_code_points_of_other_versions():
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library, codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), op05_bpe.Codec(path, pattern)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    single = {bytes([i]): i for i in range(256)}
    differ = set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = tiktoken.Encoding("one", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        differ |= set(regex.findall(name, every)) ^ set(bytes(theirs).decode())
    near = {chr(ord(c) + d) for c in differ for d in (-1, 1) if not 0xD800 <= ord(c) + d < 0xE000}
    assert "\U00016eb1" in differ
    lines = [f"{c}'s a{c} {c}1 1{c} {c}! x  {c}\n" for c in sorted(differ | near | set(every[::997]))]
    for k in range(0, len(lines), 200):
        text = "".join(lines[k : k + 200])
        assert codec.encode(pa.array([text]))[0].tolist() == library.encode_ordinary(text), lines[k]
