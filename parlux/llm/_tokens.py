"""Tokens of whole texts by way of their distinct parts.

A tokenizer's rules cut every text at the same places whatever stands around them (before the white space that follows a word), so a
text's tokens are those of its parts, one after the other. Texts are cut with numpy, each distinct part is encoded once and kept in a
bounded table, and the texts' ids are put together from the table."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from parlux.llm import _grams as G

#: Bytes that one worker's table holds; when it is full it is emptied.
TABLE = 32 << 20
#: Bytes of text that are cut and put together at a time.
PIECE = 1 << 18


class Table:
    """Part (by 64-bit hash) -> a few numbers, by a function that gets the parts it doesn't hold yet. Keys are sorted; new ones gather
    in a small table of their own until it is worth merging."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], dtype=np.uint16):
        self.encode, self.dtype = encode, dtype
        self.clear()

    def clear(self) -> None:
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))] * 2  # keys, start, size: old and new ones
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def bytes(self, more: int = 0) -> int:
        """Memory with so many more parts."""
        return 16 * (sum(len(keys) for keys, _, _ in self.runs) + more) + self.pool.nbytes

    def find(self, hashes: np.ndarray, part: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(start in the pool, how many numbers) for each hash; part(i) is the i-th part's bytes."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        start, size, held = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        for keys, starts, sizes in self.runs:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                here = keys[at] == distinct
                start[here], size[here] = starts[at[here]], sizes[at[here]]
                held |= here
        if not held.all():
            new = np.flatnonzero(~held)
            if self.used and self.bytes(len(new)) > TABLE:
                self.clear()
                return self.find(hashes, part)
            found = self.encode([part(int(i)) for i in first[new]])
            size[new] = np.fromiter(map(len, found), np.int64, len(found))
            total = int(size[new].sum())
            if self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(total, self.used // 2), self.dtype)])
            self.pool[self.used : self.used + total] = np.fromiter((x for ids in found for x in ids), self.dtype, total)
            start[new] = self.used + np.cumsum(size[new]) - size[new]
            self.used += total
            self.runs[1] = self._merged(self.runs[1], (distinct[new], start[new].astype(np.int32), size[new].astype(np.int32)))
            if len(self.runs[1][0]) > max(1 << 14, len(self.runs[0][0]) // 8):
                self.runs = [self._merged(*self.runs), (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        return start[back], size[back]

    @staticmethod
    def _merged(old: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        at = np.searchsorted(old[0], new[0])
        return tuple(np.insert(a, at, b) for a, b in zip(old, new, strict=True))


def _odd_docs(data: np.ndarray, offs: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which documents hold one of the byte sequences."""
    out = np.zeros(len(offs) - 1, bool)
    lead = {m[0] for m in marks}
    if not np.isin(data, list(lead)).any():
        return out
    text = data.tobytes()
    for mark in marks:
        at = text.find(mark)
        while at >= 0:
            doc = int(np.searchsorted(offs, at, "right")) - 1
            out[doc] = True
            at = text.find(mark, int(offs[doc + 1]))
    return out


#: White space beyond the six ASCII characters (Unicode property White_Space), as UTF-8.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class ByteBpe:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file, special strings handled as its default.

    Parts are runs of white space with the word that follows. A text with white space beyond ASCII is encoded as one part."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.table = Table(self._encode, np.uint16 if self.width == 2 else np.uint32)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}
        blank = chr(self.shown[32])
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(blank)]] = True

    def _encode(self, parts: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(parts)
        joined, alone = [], []
        tokenize, shown = self.model.tokenize, self.shown
        for k, part in enumerate(parts):
            text = part.decode()
            if len(part) < 100 and text[0] == " " and text[1:].isalpha() and max(text) < "ɐ":  # one word: no cut inside
                out[k] = [x.id for x in tokenize(part.decode("latin-1").translate(shown))]
            elif text[0] == " " and len(text) > 1 and not text[1].isspace() and len(part) < 200:
                joined.append(k)
            else:
                alone.append(k)
        for lo in range(0, len(joined), 1000):
            run = joined[lo : lo + 1000]
            ids = self.tok.encode(b"".join(parts[k] for k in run).decode(), add_special_tokens=False).ids
            cuts = np.flatnonzero(self.opens[np.array(ids)])
            if len(cuts) != len(run) or cuts[0] != 0:
                alone += run
                continue
            for k, a, b in zip(run, cuts, np.append(cuts[1:], len(ids)), strict=True):
                out[k] = ids[a:b]
        for k in alone:
            out[k] = self.tok.encode(parts[k].decode(), add_special_tokens=False).ids
        return out  # type: ignore[return-value]

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of these rows' texts one after the other, where each row's ids start, and their end)."""
        for lo, hi, data, offs in G.pieces(column, PIECE):
            solid = ~G.IS_SPACE[data]
            n = len(data)
            first = np.zeros(n, bool)
            first[1:] = ~solid[1:] & solid[:-1]
            first[offs[:-1][offs[:-1] < n]] = True
            odd = _odd_docs(data, offs, WIDE_SPACES)
            start = np.flatnonzero(first)
            doc = np.searchsorted(offs, start, "right") - 1
            if odd.any():
                keep = ~odd[doc] | (start == offs[doc])
                start, doc = start[keep], doc[keep]
            end = np.append(start[1:], n)
            hashes = G.Spans(data).hash(start, end)
            at, size = self.table.find(hashes, lambda i, data=data, start=start, end=end: data[start[i] : end[i]].tobytes())
            count = np.bincount(doc, size, hi - lo).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(count)])
            ids = self.table.pool[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(ends[-1])]
            yield lo, hi, ids, ends


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a file, loaded once a worker (until forget)."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def forget() -> None:
    """Lets go of the tokenizers and their tables."""
    _loaded.clear()
