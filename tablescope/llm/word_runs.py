"""Words of whole texts in buffers of bounded size, so that runs of words across a cut are still seen once.

A text is cut between words. Each cut piece is followed by the first `ahead` words of the next one;
runs that start in those belong to the next piece. Texts, and pieces of a text
that a separator divides, never share a run.
"""

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

PIECE = 1 << 20
BLANK, SEPARATOR = 32, 10


class Words(NamedTuple):
    """The words of one buffer: text of each word, bytes, starts, ends, run of each word, whether runs may start here."""

    owner: np.ndarray
    bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    run: np.ndarray
    own: np.ndarray

    def starts_of(self, size: int) -> np.ndarray:
        """Words at which a run of `size` words starts that counts here."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.run[:n] == self.run[size - 1:]) & self.own[:n])


def _cut(raw: bytes, ahead: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of them are the piece's own) of a text of words, blanks and separators."""
    at = 0
    while len(raw) - at > PIECE:
        end = max(raw.rfind(b" ", at, at + PIECE), raw.rfind(b"\n", at, at + PIECE))
        if end <= at:  # a word longer than a piece
            ends = [p for p in (raw.find(b" ", at + PIECE), raw.find(b"\n", at + PIECE)) if p >= 0]
            if not ends:
                break
            end = min(ends)
        stop = end
        for _ in range(ahead):
            while stop < len(raw) and raw[stop] in (BLANK, SEPARATOR):
                stop += 1
            while stop < len(raw) and raw[stop] not in (BLANK, SEPARATOR):
                stop += 1
        yield raw[at:stop], end - at
        at = end
    yield raw[at:], len(raw) - at


def words(texts: Sequence[bytes | None], table: bytes, ahead: int) -> Iterator[Words]:
    """Buffers of about a megabyte; `table` lower-cases, and turns bytes outside words into blanks or separators."""
    group, size = [], 0
    for i, raw in enumerate(texts):
        for piece, own in _cut((raw or b"").translate(table), ahead):
            if group and size + len(piece) > PIECE:
                yield _gather(group)
                group, size = [], 0
            group.append((i, piece, own))
            size += len(piece) + 1
    if group:
        yield _gather(group)


def _gather(group) -> Words:
    buf = np.frombuffer(b"\n".join(piece for _, piece, _ in group), np.uint8)
    at = np.zeros(len(group), np.int64)
    np.cumsum([len(piece) + 1 for _, piece, _ in group[:-1]], out=at[1:])
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = (buf != BLANK) & (buf != SEPARATOR)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.searchsorted(at, starts, side="right") - 1
    own_to = at + np.array([own for _, _, own in group], np.int64)
    owner = np.array([i for i, _, _ in group], np.int64)
    run = np.cumsum(buf == SEPARATOR, dtype=np.int64)[starts] if len(buf) else starts
    return Words(owner[piece], buf, starts, ends, run, starts < own_to[piece])
