"""Words, shingles and sets of whole texts as 64-bit hashes, computed with numpy over many texts at once.

Two different strings share a hash with odds of about 2**-64. Texts are taken in
pieces of about a megabyte cut between words, so memory does not follow their length.
"""

from collections.abc import Iterator, Sequence

import numpy as np

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE + (1 << 16))
        for name, step in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"]


def ascii_words_table() -> bytes:
    """Lower-cases A-Z and blanks all ASCII but letters and digits."""
    keep = b"0123456789abcdefghijklmnopqrstuvwxyz"
    return bytes(c if c >= 128 or c in keep else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def spaced_words_table() -> bytes:
    """Lower-cases A-Z and blanks white space (space, tab to carriage return)."""
    return bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(texts: Sequence[bytes | None], table: bytes) -> Iterator[tuple[int, bytes]]:
    """(index of the text, piece); a text has one piece or more, none is cut inside a word."""
    for i, raw in enumerate(texts):
        raw = (raw or b"").translate(table)
        at = 0
        while len(raw) - at > PIECE:
            end = raw.rfind(b" ", at, at + PIECE)
            if end <= at:  # a word longer than a piece
                end = raw.find(b" ", at + PIECE)
                end = len(raw) if end < 0 else end
            yield i, raw[at:end]
            at = end
        yield i, raw[at:] if at else raw


def _hash_buffer(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word in a buffer of words and blanks."""
    buf = np.frombuffer(joined, np.uint8)
    word = np.empty(len(buf) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = buf != 32
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mix(h), starts, ends


def batches(texts: Sequence[bytes | None], table: bytes) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """Pieces gathered to about a megabyte: (text of each piece, joined bytes, start of each piece)."""
    group, size = [], 0
    for i, piece in pieces(texts, table):
        if group and size + len(piece) > PIECE:
            yield _join(group)
            group, size = [], 0
        group.append((i, piece))
        size += len(piece) + 1
    if group:
        yield _join(group)


def _join(group):
    at = np.zeros(len(group), np.int64)
    np.cumsum([len(p) + 1 for _, p in group[:-1]], out=at[1:])
    return [i for i, _ in group], b" ".join(p for _, p in group), at


def word_hashes(texts: Sequence[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of the texts in order, and the offsets of each text (one more than texts)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for owners, joined, at in batches(texts, table):
        h, starts, _ = _hash_buffer(joined)
        per = np.diff(np.append(np.searchsorted(starts, at), len(starts)))
        np.add.at(counts, owners, per)
        hashes.append(h)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), offsets


def words_with_ends(texts: Sequence[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `word_hashes`, and the last two bytes of each word as one number."""
    hashes, tails, counts = [], [], np.zeros(len(texts), np.int64)
    for owners, joined, at in batches(texts, table):
        h, starts, ends = _hash_buffer(joined)
        buf = np.frombuffer(joined, np.uint8)
        last = buf[ends - 1].astype(np.int32) if len(ends) else np.zeros(0, np.int32)
        before = np.where(ends - starts > 1, buf[np.maximum(ends - 2, 0)], 0) if len(ends) else last
        tails.append(before.astype(np.int32) * 256 + last)
        np.add.at(counts, owners, np.diff(np.append(np.searchsorted(starts, at), len(starts))))
        hashes.append(h)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    if not hashes:
        return np.zeros(0, np.uint64), offsets, np.zeros(0, np.int32)
    return np.concatenate(hashes), offsets, np.concatenate(tails)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; fewer words, but not none, are one run."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - size + 1)
    width = min(size, len(words))
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(_BASE) + words[k:k + n]
    return mix(h)


def sliced(batch, text_column: int, budget: int = 8 << 20) -> Iterator:
    """An Arrow batch in slices of at most `budget` bytes of text (or one row)."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(total):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw_texts(column) -> list[bytes | None]:
    """The values of an Arrow string column as bytes."""
    import pyarrow as pa
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span of a buffer of at most a few megabytes."""
    up, down = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, at: np.ndarray, size: int, salt: np.ndarray) -> np.ndarray:
    """Hashes of the runs of exactly `size` words that start at `at`, salted run by run."""
    h = salt + np.uint64(size)
    for k in range(size):
        h = h * np.uint64(_BASE) + words[at + k]
    return mix(h)
