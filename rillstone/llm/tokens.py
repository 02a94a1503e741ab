"""Exact ids of a byte-level BPE tokenizer, a few times faster than encoding each text by itself.

Merges never cross the borders of pre-tokens, so a text's ids are its pre-tokens' ids in turn. Texts are cut, by the
classes of their bytes, where a pre-token ends whatever stands around: before white space, between letters, digits and other
marks of ASCII, and after a single new line. The library encodes every distinct unit that this leaves, unless it is in a
bounded cache of the worker process, many units at a time.
"""

from __future__ import annotations

from functools import cache
from itertools import chain, compress, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: Half of the entries of a worker process's cache; when it is full, the half that was used latest stays.
CACHE_ENTRIES = 300_000
#: Bytes of the longest unit that is kept in the cache; units that the library encodes as one text.
LONGEST, TOGETHER = 64, 200
#: Classes of bytes. Where it is open whether something is white space, or it is so beyond ASCII, texts are not cut.
OPEN, WHITE, LINE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(8)


def _classes() -> np.ndarray:
    found = np.full(256, OTHER, np.uint8)
    found[:128] = MARK
    for class_, members in ((WHITE, b" \t\v\f\r"), (LINE, b"\n"), (OPEN, b"\x1c\x1d\x1e\x1f"), (DIGIT, b"0123456789"), (APOSTROPHE, b"'")):
        found[list(members)] = class_
    found[[x for x in range(128) if chr(x).isalpha()]] = LETTER
    return found


def _ends() -> np.ndarray:
    """Whether a pre-token ends between two bytes, by 8 * the one's class + the other's. An apostrophe may begin one with letters."""
    found = np.zeros((8, 8), bool)
    found[LETTER:, [WHITE, LINE]] = True
    for before, after in ((LETTER, [DIGIT, MARK, APOSTROPHE]), (DIGIT, [LETTER, MARK, APOSTROPHE]), (MARK, [LETTER, DIGIT])):
        found[before, after] = True
    return found.ravel()


CLASSES, ENDS = _classes(), _ends()
#: White space beyond ASCII as UTF-8, and what some take for it.
WHITE_2, WHITE_3 = ([int.from_bytes(chr(x).encode()) for x in own] for own in ((0x85, 0xA0), (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))


def cuts(b: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 whether a pre-token surely ends before it."""
    classes = CLASSES[b]
    two = np.flatnonzero(b[:-1] == 0xC2)
    two = two[np.isin(b[two].astype(np.int64) << 8 | b[two + 1], WHITE_2)]
    three = np.flatnonzero((b[:-2] >= 0xE1) & ((b[:-2] <= 0xE3) | (b[:-2] == 0xEF)))
    three = three[np.isin(b[three].astype(np.int64) << 16 | b[three + 1].astype(np.int64) << 8 | b[three + 2], WHITE_3)]
    classes[np.concatenate((two, two + 1, three, three + 1, three + 2))] = OPEN
    found = np.zeros(len(b), bool)
    found[1:] = ENDS[classes[:-1] << 3 | classes[1:]]
    solid = classes >= LETTER
    found[2:] |= (classes[1:-1] == LINE) & solid[:-2] & solid[2:]
    return found


def _parts(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[begin : begin + size]`` of each part, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Units:
    """The ids of up to twice ``entries`` units, of which the latest used half stays when there are more. Ids are in one array, at ``begin`` and ``size`` of a unit's row."""

    def __init__(self, entries: int):
        self.entries = entries
        self.rows: dict[bytes, int] = {}
        self.begin, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")
        self.filled = self.calls = 0

    def find(self, units: list[bytes]) -> np.ndarray:
        """The row of each unit, -1 for those that are not there."""
        self.calls += 1
        rows = np.fromiter(map(self.rows.get, units, repeat(-1)), np.int64, len(units))
        self.used[rows[rows >= 0]] = self.calls
        return rows

    def add(self, units: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n, end = len(self.rows), self.filled + len(ids)
        if n + len(units) > len(self.begin):
            more = max(n // 2, len(units), 1000)
            self.begin, self.size, self.used = (np.concatenate((x[:n], np.zeros(more, x.dtype))) for x in (self.begin, self.size, self.used))
        if end > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.filled], np.zeros(max(self.filled // 2, len(ids), 1000), "<u4")))
        new = slice(n, n + len(units))
        self.begin[new], self.size[new], self.used[new] = self.filled + np.cumsum(size) - size, size, self.calls
        self.ids[self.filled : end], self.filled = ids, end
        self.rows.update(zip(units, range(n, n + len(units)), strict=True))

    def trim(self) -> None:
        n = len(self.rows)
        if n > 2 * self.entries:
            keep = np.sort(np.argpartition(self.used[:n], n - self.entries)[n - self.entries :])
            flags = np.zeros(n, bool)
            flags[keep] = True
            self.ids = _parts(self.ids, self.begin[keep], self.size[keep])
            self.rows = dict(zip(compress(self.rows, flags.tolist()), range(len(keep)), strict=True))
            self.size, self.used, self.filled = self.size[keep], self.used[keep], len(self.ids)
            self.begin = np.cumsum(self.size) - self.size


class PieceEncoder:
    """Encodes whole texts with the tokenizer file at ``path``, without special tokens being added."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = _Units(entries)
        blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]  # how the vocabulary writes it
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(blank)]] = True
        ((self.line,),) = (e.ids for e in self.tokenizer.encode_batch_fast(["\n"], add_special_tokens=False))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts by the library, and how many each has."""
        flat, size = [np.zeros(0, "<u4")], []
        for at in range(0, len(texts), 10_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 10_000], add_special_tokens=False)]
            size += map(len, ids)
            flat.append(np.fromiter(chain.from_iterable(ids), "<u4"))
        return np.concatenate(flat), np.array(size, np.int64)

    def _joined(self, units: list[str], line: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of units with no white space but a blank that begins each, or with none and a ``line`` between them, many in a text.

        Of a unit's ids only the first begins with a blank; a new line is an id by itself.
        """
        ids, _ = self._ids([line + line.join(units[at : at + TOGETHER]) for at in range(0, len(units), TOGETHER)])
        begin = np.flatnonzero(ids == self.line if line else self.begins[ids])
        if len(begin) != len(units):
            raise AssertionError("each unit has one place where it begins")
        size = np.diff(begin, append=len(ids)) - len(line)
        return (ids[ids != self.line] if line else ids), size

    def _new(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any units."""
        texts = [x.decode() for x in units]
        plain = [x.split() for x in texts]  # parts without white space
        kind = np.array([0 if x[0] == " " and p == [x[1:]] else 1 if p == [x] else 2 for x, p in zip(texts, plain, strict=True)], np.int8)
        own = [list(compress(texts, (kind == k).tolist())) for k in range(3)]
        (a, m), (b, n), (c, o) = self._joined(own[0], ""), self._joined(own[1], "\n"), self._ids(own[2])
        size = np.zeros(len(units), np.int64)
        in_turn = np.argsort(kind, kind="stable")
        size[in_turn] = np.concatenate((m, n, o))
        begin = np.zeros(len(units), np.int64)
        begin[in_turn] = np.cumsum(size[in_turn]) - size[in_turn]
        return _parts(np.concatenate((a, b, c)), begin, size), size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids for each text."""
        if not texts:
            return []
        self.units.trim()
        special = [any(s in t for s in self.specials) for t in texts]  # a special token crosses pre-tokens
        whole = pa.array(["" if s else t for t, s in zip(texts, special, strict=True)], pa.large_string())
        offsets = np.frombuffer(whole.buffers()[1], np.int64, len(texts) + 1)
        data = whole.buffers()[2] or pa.py_buffer(b"")
        bytes_ = np.frombuffer(data, np.uint8, int(offsets[-1]))
        flags = np.append(cuts(bytes_), True)
        flags[offsets] = True
        starts = np.flatnonzero(flags)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), data]).dictionary_encode()
        at, units = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        rows = self.units.find(units)
        known = rows >= 0
        missing = np.flatnonzero(~known)
        new = [units[i] for i in missing.tolist()]
        new_ids, new_size = self._new(new)
        rows = rows[known]
        ids = np.concatenate((_parts(self.units.ids, self.units.begin[rows], self.units.size[rows]), new_ids))
        size, begin = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        size[known], size[missing] = self.units.size[rows], new_size
        in_turn = np.concatenate((np.flatnonzero(known), missing))
        begin[in_turn] = np.cumsum(size[in_turn]) - size[in_turn]
        short = np.fromiter((len(x) <= LONGEST for x in new), bool, len(new))
        self.units.add(list(compress(new, short.tolist())), _parts(new_ids, (np.cumsum(new_size) - new_size)[short], new_size[short]), new_size[short])
        take = size[at]
        flat = _parts(ids, begin[at], take)
        bounds = np.concatenate(([0], np.cumsum(take)))[np.searchsorted(starts, offsets)].tolist()
        return [self._ids([t])[0] if s else flat[lo:hi] for t, s, lo, hi in zip(texts, special, bounds[:-1], bounds[1:], strict=True)]


@cache
def encoder(path: str | None = None, entries: int = CACHE_ENTRIES) -> PieceEncoder:
    """The worker process's encoder for a tokenizer file; by default the 50k byte-level BPE. A smaller cache takes less memory and more time."""
    return PieceEncoder(path or public_tokenizers.path(VOCABULARY), entries)
