"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memo.

A byte-level BPE vocabulary works inside pre-tokens, so a text may be cut wherever a
pre-token surely begins: before a single space or line feed between two characters
that are not white space, after such a line feed, and between an ASCII letter and a
plain mark.  Cuts are found on the bytes of many texts at once, the pieces between
them are looked up by a 64-bit hash in a table of ids, and only pieces that are not
in it are given to the library: plain words to its BPE model, all else to ``encode``.
Texts with unusual white space or special tokens go to ``encode`` whole.  The ids
equal those of ``encode`` on the whole text, which the tests compare.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .hashing import _ODD, U, _powers, batches_of, mix

_SEGMENT = 1 << 20
_LONG = 64  # bytes of a piece that is remembered, at most
# White space beyond space, tab and line ends; a text that has any is encoded whole.
_UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+\Z")

_SPACE, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_SPACE[[9, 10, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[ord(c) for c in ".,;:!?"]] = True

_LOADED: dict[tuple[str, int], "Encoder"] = {}


def encoder(path: str, slot_bits: int = 22) -> "Encoder":
    """The process's encoder for a tokenizer file."""
    key = (path, slot_bits)
    if key not in _LOADED:
        _LOADED[key] = Encoder(path, slot_bits)
    return _LOADED[key]


class Table:
    """Open addressing from 64-bit hashes to rows of ids; all steps work on arrays."""

    def __init__(self, bits: int, kind):
        self.bits, self.kind = bits, kind
        self.clear()

    def clear(self):
        self.keys = np.zeros(1 << self.bits, U)
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.count = self.used = 0
        self.begin, self.length = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool = np.zeros(8192, self.kind)

    def full(self) -> bool:
        return self.count > 5 << (self.bits - 3) or self.used > 1 << 28

    def room(self) -> int:
        """Keys that may still be entered; an eighth of the slots stays free."""
        return (7 << (self.bits - 3)) - self.count

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of keys, -1 where there is none.  Keys are never 0."""
        slot = (keys >> U(64 - self.bits)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def append(self, ids: list[int]) -> int:
        """A new row; it is found by no key until ``put``."""
        n = len(ids)
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if self.count == len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.pool[self.used : self.used + n] = ids
        self.begin[self.count], self.length[self.count] = self.used, n
        self.used, self.count = self.used + n, self.count + 1
        return self.count - 1

    def put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Enter distinct new keys."""
        slot = (keys >> U(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several that want a slot the last gets it
            won = self.keys[slot] == keys
            self.rows[slot[won]] = rows[won]
            keys, rows, slot = keys[~won], rows[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)


class Encoder:
    def __init__(self, path: str, slot_bits: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        state = bytes(pre.__getstate__()).decode() if pre is not None else ""
        self.by_piece = (
            isinstance(pre, pre_tokenizers.ByteLevel)
            and '"add_prefix_space":false' in state
            and '"use_regex":true' in state
            and self.tokenizer.normalizer is None
            and self.tokenizer.post_processor is None
        )
        kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.table = Table(slot_bits, kind)
        # byte-level alphabet: printable bytes stand for themselves, the others move up to 256 and beyond
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(kept)]
        self.alphabet = {b: b for b in kept} | {b: 256 + n for n, b in enumerate(moved)}
        self.tokenize = self.tokenizer.model.tokenize

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        if not _WORD.match(piece):
            return self.whole(piece)
        mapped = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.tokenize(mapped)]

    def _joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts without unusual white space."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        first = np.zeros(n + 1, bool)  # where a text begins
        first[starts[sizes > 0]] = True
        first[n] = True
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~_SPACE[data]
        alone = solid[:-2] & solid[2:] & ~first[:-1] & ~first[1:]  # between two characters of the text
        feed = alone & (data == 10)
        cut = first[:-1] | feed | (alone & (data == 32))
        cut[1:] |= feed[:-1]
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], n)
        up, down = _powers(n + 1)
        prefix = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:n], out=prefix[1:])
        keys = mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(U) * _ODD[0]) | U(1)
        table = self.table
        if table.full():
            table.clear()
        rows = table.find(keys)
        count, used = table.count, table.used
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[at]
            long = end[at] - begin[at] > _LONG
            got = np.zeros(len(new), np.int64)
            # long pieces, and what is over the table's room, are forgotten again
            order = np.argsort(long, kind="stable")
            kept = order[: min(int((~long).sum()), table.room())]
            for group in (kept, order[len(kept) :]):
                for k, a, b in zip(group.tolist(), begin[at[group]].tolist(), end[at[group]].tolist(), strict=True):
                    got[k] = table.append(self._piece(raw[a:b].decode()))
                if group is kept:
                    table.put(new[kept], got[kept])
                    count, used = table.count, table.used
            rows[missing] = got[back]
        lengths = table.length[rows].astype(np.int64)
        ends = np.cumsum(lengths)
        place = np.repeat(table.begin[rows] - (ends - lengths), lengths) + np.arange(int(ends[-1]))
        ids = table.pool[place].astype(np.uint32)
        table.count, table.used = count, used
        total = np.concatenate([[0], ends])
        return ids, total[np.searchsorted(begin, starts + sizes)] - total[np.searchsorted(begin, starts)]

    def _segments(self, text: str) -> list[str]:
        """A long text in parts that begin where a pre-token does."""
        parts, at = [], 0
        while len(text) - at > _SEGMENT:
            found = _SAFE_CUT.search(text, at + _SEGMENT - 1)
            if not found:
                break
            parts.append(text[at : found.start()])
            at = found.start()
        return [*parts, text[at:]]

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids (unsigned 32-bit) of each whole text; null counts as empty."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts: list[bytes] = []
        owner: list[int] = []
        for n, text in enumerate(texts):
            if not text:
                continue
            if not self.by_piece or _UNUSUAL.search(text) or any(s in text for s in self.specials):
                out[n].append(np.array(self.whole(text), np.uint32))
                continue
            for part in self._segments(text) if len(text) > _SEGMENT else (text,):
                parts.append(part.encode())
                owner.append(n)
        for a, b in batches_of(parts, _SEGMENT):
            ids, counts = self._joined(parts[a:b])
            for n, got in zip(owner[a:b], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[n].append(got)
        none = np.zeros(0, np.uint32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]
