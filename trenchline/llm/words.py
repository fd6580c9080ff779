"""Cutting texts of any length into words, a bounded piece at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

PIECE_BYTES = 1_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """`text` cut at white space into pieces of about `limit` bytes; a longer word is not cut."""
    start = 0
    while len(text) - start > limit and (cut := _SPACE.search(text, start + limit)):
        yield text[start:cut.start()]
        start = cut.end()
    yield text[start:] if start else text
