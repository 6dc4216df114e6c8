"""Vectorised 64-bit hashing of words and shingles of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)
_BASE, _SEGMENT = 0x5851F42D4C957F2D, 1 << 20
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        n = max(n, _SEGMENT + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(n, _BASE, U), np.full(n, inverse, U)
        up[0] = down[0] = 1
        _POWERS[:] = [(np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))]
    return _POWERS[0]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each run of bytes that are not white space."""
    space = _SPACE[data]
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(U) * _ODD[0]), begin


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of all words, in order.  Texts are joined into
    segments of about a MB; a longer text is cut at white space."""
    hashes, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    held: list[bytes] = []
    first = size = 0

    def flush(upto: int):
        nonlocal held, first, size
        if held:
            data = np.frombuffer(b" ".join(held), np.uint8)
            offsets = np.cumsum([0] + [len(t) + 1 for t in held[:-1]])
            got, begin = _hash_words(data)
            hashes.append(got)
            owners.append(np.searchsorted(offsets, begin, side="right") - 1 + first)
        held, first, size = [], upto, 0

    for n, text in enumerate(texts):
        if size + len(text) > _SEGMENT:
            flush(n)
        if len(text) <= _SEGMENT:
            held.append(text)
            size += len(text) + 1
            continue
        data, at = np.frombuffer(text, np.uint8), 0
        while at < len(data):
            stop = min(len(data), at + _SEGMENT)
            while stop < len(data) and not _SPACE[data[stop]]:
                ahead = np.flatnonzero(_SPACE[data[stop : stop + 65536]])
                stop += int(ahead[0]) if len(ahead) else min(65536, len(data) - stop)
            got, _ = _hash_words(data[at:stop])
            hashes.append(got)
            owners.append(np.full(len(got), n, np.int64))
            at = stop
        held, first, size = [], n + 1, 0
    flush(len(texts))
    return np.concatenate(hashes), np.concatenate(owners)


def shingles_of(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(element, index of its text), sorted within each text, for at most 2**16 texts.

    An element stands for a run of ``words`` words and its how-manieth occurrence in
    the text, so the Jaccard similarity of elements is the weighted one of the runs'
    counts.  A text of fewer words has one run, of all its words."""
    if len(texts) > 1 << 16:
        raise ValueError("too many texts at once")
    hashes, owner = words_of(texts)
    count = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    runs, run_owner = np.zeros(0, U), np.zeros(0, np.int64)
    if len(hashes) >= words:
        total = np.zeros(len(hashes) - words + 1, U)
        for k in range(words):
            total += hashes[k : len(hashes) - words + 1 + k] * _ODD[k]
        whole = owner[: len(total)] == owner[words - 1 :]
        runs, run_owner = mix(total[whole]), owner[: len(total)][whole]
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        starts = np.concatenate([[0], np.cumsum(count)])
        short = np.array([np.add.reduce(hashes[starts[n] : starts[n + 1]] * _ODD[: count[n]]) ^ U(count[n]) for n in few], U)
        runs, run_owner = np.concatenate([runs, mix(short)]), np.concatenate([run_owner, few])
    key = np.sort((run_owner.astype(U) << U(48)) | (runs >> U(16)))
    owner = (key >> U(48)).astype(np.int64)
    if len(key):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        nth = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
        key = mix((key & U((1 << 48) - 1)) + nth.astype(U) * _ODD[1] + _ODD[2])
    return key, owner


def batches_of(texts: list[bytes], most_bytes: int = _SEGMENT, most_texts: int = 4096):
    """Ranges of texts that are worked on together."""
    begin = size = 0
    for n, text in enumerate(texts):
        if n > begin and (size + len(text) > most_bytes or n - begin >= most_texts):
            yield begin, n
            begin, size = n, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)
