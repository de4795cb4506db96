"""Words of whole texts as byte strings, a bounded piece of a text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from tablereview.llm.words import text_bytes

#: Bytes of text that are cut into words at a time; a single longer word goes whole.
PIECE = 1 << 20


def blank_table(is_word: list[bool], lower: bool) -> bytes:
    """For ``bytes.translate``: bytes outside words become spaces, A-Z become a-z if asked."""
    out = bytearray(b if is_word[b] else 32 for b in range(256))
    if lower:
        for b in range(65, 91):
            out[b] = b + 32
    return bytes(out)


def word_pieces(data: bytes, table: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Lists of the words of a text, in order; a cut only falls on a blank."""
    at = 0
    while at < len(data):
        stop = at + size
        held = [data[at:stop].translate(table)]
        while stop < len(data) and not held[-1].endswith(b" "):
            more = data[stop : stop + size].translate(table)
            cut = more.find(b" ") + 1 or len(more)
            held.append(more[:cut])
            stop += cut
        yield b"".join(held).split()
        at = stop


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    data, offsets = text_bytes(column)
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[first:last].tobytes()
