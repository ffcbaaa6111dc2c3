"""Word and shingle streams over UTF-8 bytes in bounded blocks.

``bytes.lower`` changes A-Z only and ``bytes.split`` splits on
``\\x20\\x09-\\x0D`` only, so no locale or Unicode table takes part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(rb"[\t-\r ]")
BLOCK_BYTES = 1 << 20


def blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Slices of about ``size`` bytes that never cut a word."""
    if len(data) <= size:
        yield data
        return
    start = 0
    while start < len(data):
        found = _SPACE.search(data, start + size)
        end = found.start() if found else len(data)
        yield data[start:end]
        start = end


def word_blocks(data: bytes, overlap: int, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lower-cased words; each block repeats the last ``overlap`` words of the one before."""
    kept: list[bytes] = []
    for part in blocks(data, size):
        words = kept + part.lower().split()
        yield words
        kept = words[-overlap:] if overlap else []


def shingles(words: list[bytes], n: int) -> Iterator[bytes]:
    """Space-joined ``n``-word shingles, repeats included."""
    return map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))


#: A-Z to a-z, bytes that part alphanumeric words (ASCII other than 0-9, a-z) to a space.
_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def alnum_blocks(data: bytes, overlap: int, size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes], bool]]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, a block at a time.

    Gives (index of the block's first word, words, whether it is the last block);
    each block begins with the last ``overlap`` words of the one before.
    """
    flat = data.translate(_ALNUM)
    if len(flat) <= size:
        yield 0, flat.split(), True
        return
    at, kept, parts = 0, [], blocks(flat, size)
    part = next(parts)
    while part is not None:
        coming = next(parts, None)
        words = kept + part.split()
        yield at, words, coming is None
        kept = words[-overlap:] if overlap else []
        at += len(words) - len(kept)
        part = coming
