"""Words, shingles and their 64-bit hashes, with numpy over runs of texts."""

from __future__ import annotations

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
PIECE = 1 << 20
RUN = 1 << 17  # bytes of short texts that are hashed together


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``size`` of each."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(size, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_held = powers(0)


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """``powers`` of at least ``size``; a worker holds one table, which grows with its longest run of bytes."""
    global _held
    if len(_held[0]) < size:
        _held = powers(1 << max(19, int(size).bit_length()))
    return _held


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans from prefix sums (see ``prefix_sums``)."""
    _, inverse = _tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    power, _ = _tables(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=out[1:])
    return out


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = _IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def pieces(text: bytes, limit: int = PIECE) -> list[bytes]:
    """A very long text in pieces of about ``limit`` bytes, cut at white space only."""
    if len(text) <= 2 * limit:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(at + limit, len(text))
        while end < len(text) and text[end] not in SPACE:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of ``texts`` in order, and where each text's words begin (one more)."""
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    run: list[bytes] = []
    first = 0

    def flush(upto: int) -> None:
        nonlocal run, first
        if run:
            buf = np.frombuffer(b"\n".join(run).lower(), np.uint8)
            start, end = word_spans(buf)
            hashes.append(spans_hash(prefix_sums(buf), start, end))
            edges = np.cumsum([0] + [len(t) + 1 for t in run])
            counts[first + 1 : upto + 1] += np.diff(np.searchsorted(start, edges))
        run, first = [], upto

    size = 0
    for i, text in enumerate(texts):
        parts = pieces(text)
        if len(parts) > 1:
            flush(i)
            for part in parts:
                run, first = [part], i
                flush(i + 1)
            size = 0
            continue
        run.append(text)
        size += len(text)
        if size > RUN:
            flush(i + 1)
            size = 0
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct ``width``-word shingles; a shorter text is one shingle."""
    words, at = word_hashes(texts)
    rolled = words
    for k in range(1, width):
        rolled = mix(rolled[: max(0, len(words) - k)] * np.uint64(0x2545F4914F6CDD1D) + words[k:])
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        if n >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            h = words[a : a + 1]
            for w in words[a + 1 : b]:
                h = mix(h * np.uint64(0x2545F4914F6CDD1D) + w)
            out.append(mix(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
