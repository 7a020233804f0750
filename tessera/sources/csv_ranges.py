"""Record borders of a large CSV file, found in parallel.

Whether a line end ends a record depends on all before it. So a range of bytes is first read as a function
from the parser's state at its begin to that at its end; ranges do that side by side. The functions that
bytes can make form a small monoid, so a range is reduced by table lookups, two neighbours at a time. The
driver puts the functions of a file's ranges together in order (one number a range), after which each task
knows where the first record of its range begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import BinaryIO

import numpy as np

# States: begin of a record, of another field, within a field, within quotes, after an escape, after one
# within quotes, after a quote within quotes, after a CR that ended a record.
RECORD, FIELD, INSIDE, QUOTED, ESCAPED, QUOTED_ESCAPED, CLOSING, RETURN = range(8)
# Classes of bytes.
OTHER, DELIMITER, QUOTE, ESCAPE, CR, LF = range(6)

#: Bytes a task reduces or parses at once.
PIECE = 4 << 20
#: Bytes read at once in search of a record's end.
LOOK = 1 << 16


def _step(state: int, byte: int) -> int:
    if state == ESCAPED:
        return INSIDE
    if state == QUOTED_ESCAPED:
        return QUOTED
    if state == QUOTED:
        return {QUOTE: CLOSING, ESCAPE: QUOTED_ESCAPED}.get(byte, QUOTED)
    if byte == QUOTE:
        return INSIDE if state == INSIDE else QUOTED
    return {OTHER: INSIDE, DELIMITER: FIELD, ESCAPE: ESCAPED, CR: RETURN, LF: RECORD}[byte]


@cache
def _monoid() -> tuple[np.ndarray, list[tuple[int, ...]], np.ndarray]:
    """Number of each byte class's function, all functions, and the number of the one made of two in turn."""
    single = [tuple(_step(s, c) for s in range(8)) for c in range(6)]
    known = {tuple(range(8)): 0}
    todo = list(known)
    for f in todo:
        for g in single:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    product = np.array([[known[tuple(g[s] for s in f)] for g in todo] for f in todo], np.uint16)
    return np.array([known[f] for f in single], np.uint16), todo, product


def classes(delimiter: str, quote: str, escape: str) -> bytes:
    """Table for ``bytes.translate``; the three are ASCII."""
    table = bytearray(256)
    for char, kind in ((delimiter, DELIMITER), (quote, QUOTE), (escape, ESCAPE), ("\r", CR), ("\n", LF)):
        table[ord(char)] = kind
    return bytes(table)


def effect(data: bytes, table: bytes) -> tuple[int, ...]:
    """State after ``data`` for each state before it."""
    first, functions, product = _monoid()
    kinds = np.frombuffer(data.translate(table), np.uint8)
    kinds = kinds[(kinds != OTHER) | (np.concatenate([[1], kinds[:-1]]) != OTHER)]  # further others change nothing
    x = first[kinds]
    while len(x) > 1:
        pairs = product[x[: len(x) // 2 * 2 : 2], x[1::2]]
        x = np.append(pairs, x[-1]) if len(x) % 2 else pairs
    return functions[x[0] if len(x) else 0]


def range_effect(f: BinaryIO, begin: int, end: int, table: bytes) -> list[int]:
    """:func:`effect` of a range of a file."""
    out = list(range(8))
    for at in range(begin, end, PIECE):
        f.seek(at)
        one = effect(f.read(min(PIECE, end - at)), table)
        out = [one[s] for s in out]
    return out


def first_record(f: BinaryIO, at: int, state: int, table: bytes) -> int:
    """Where the first record at or after ``at`` begins, given the state there; the file's size if none does."""
    f.seek(at)
    while state != RECORD:
        look = f.read(LOOK)
        if not look:
            return at
        for kind in look.translate(table):
            if state == RETURN and kind != LF:
                return at
            state = _step(state, kind)
            at += 1
            if state == RECORD:
                break
    return at


def pieces(f: BinaryIO, begin: int, end: int, before: int, after: int, table: bytes) -> Iterator[tuple[int, bytes]]:
    """Whole records that begin in a range, in pieces with their places."""
    at, stop = first_record(f, begin, before, table), first_record(f, end, after, table)
    while at < stop:
        cut = stop
        if at + PIECE < end:
            f.seek(at)
            cut = first_record(f, at + PIECE, effect(f.read(PIECE), table)[RECORD], table)
        f.seek(at)
        yield at, f.read(cut - at)
        at = cut
