"""Byte-level BPE ids for whole Arrow batches.

Text is cut into pre-tokens with array operations on code points (the tokenizer's split
pattern only asks for the class of a character and of its neighbours); a pre-token's ids
come from a bounded cache keyed by its hash, and only pre-tokens not in the cache are merged
one by one. Ids equal those of ``tokenizers`` on ``byte_bpe_50k.json``: the string of its special
token is cut out first and is one id of its own, what stands between is text of its own.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa

from tessera.llm._text import parts, span_hashes

# String and id of the vocabulary's special token.
SPECIAL, SPECIAL_ID = b"<|endoftext|>", 50256

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    global _classes
    if _classes is None:
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kind[c] = _LETTER
            elif k == "N":
                kind[c] = _NUMBER
        # The code points with the Unicode property White_Space.
        kind[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _classes = kind
    return _classes


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of each text; those of text i are first[i]:first[i+1]."""
    n_bytes = len(data)
    if n_bytes == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    begins = np.searchsorted(lead, offsets)
    first_char = np.zeros(n + 1, bool)
    first_char[begins] = True
    kind = classes()[cp]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[first_char] = True
    # The last space before other text stands alone, or leads it if it is U+0020.
    last_space = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first_char[1:n])
    start[last_space] = True
    start[last_space[cp[last_space] == 0x20] + 1] = False
    marks = np.flatnonzero((cp == 0x27) & start[:n])
    if len(marks):
        padded = np.append(cp, [0, 0, 0]).astype(np.int64)
        texts_end = begins[np.searchsorted(begins, marks, side="right")]
        a, b = padded[marks + 1], padded[marks + 2]
        a, b = np.where(marks + 1 < texts_end, a, 0), np.where(marks + 2 < texts_end, b, 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for found, length in ((marks[one], 2), (marks[two], 3)):
            start[found + 1] = False
            start[found + length] = True
    at = np.flatnonzero(start[:n])
    starts = lead[at]
    return starts, np.append(starts[1:], n_bytes), np.searchsorted(at, begins)


class Encoder:
    """Ids of pre-tokens, with a cache of fixed size: two possible slots a key, the newer wins."""

    def __init__(self, ranks_path: str, slots: int = 1 << 20, pool: int = 1 << 23) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.slots, self.size = slots, pool
        self.clear()

    def clear(self) -> None:
        self.key, self.value = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.pool, self.used = np.zeros(self.size, np.uint16), 0
        self.begin, self.count, self.entries = np.zeros(self.size // 2, np.int32), np.zeros(self.size // 2, np.int32), 0

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each pre-token."""
        h = span_hashes(data, starts, ends)
        mask = np.uint64(self.slots - 1)
        s1, s2 = (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)
        first = self.key[s1] == h
        slot = np.where(first, s1, s2)
        entry = self.value[slot]
        missing = np.flatnonzero(~first & (self.key[s2] != h))
        if len(missing):
            new, index, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            raw = data.tobytes()
            ids = [self.merge(raw[starts[k] : ends[k]]) for k in missing[index]]
            total = sum(map(len, ids))
            if self.used + total > self.size or self.entries + len(new) > len(self.begin):
                self.clear()
                if total > self.size or len(new) > len(self.begin):
                    self.size = 4 * max(total, len(new))
                    self.clear()
                return self.encode(data, starts, ends)
            counts = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint16, total)
            self.pool[self.used : self.used + total] = flat
            span = slice(self.entries, self.entries + len(new))
            self.begin[span], self.count[span] = self.used + np.cumsum(counts) - counts, counts
            number = np.arange(self.entries, self.entries + len(new), dtype=np.int32)
            entry[missing] = number[inverse]
            n1, n2 = (new & mask).astype(np.int64), ((new >> np.uint64(32)) & mask).astype(np.int64)
            put = np.where(self.key[n1] == 0, n1, n2)
            self.key[put], self.value[put] = new, number
            self.used, self.entries = self.used + total, self.entries + len(new)
        counts = self.count[entry]
        shift = self.begin[entry].astype(np.int64) - (np.cumsum(counts, dtype=np.int64) - counts)
        return self.pool[np.repeat(shift, counts) + np.arange(counts.sum())], counts


_encoders: dict[str, Encoder] = {}


def _with_special(text: bytes, ranks_path: str) -> np.ndarray:
    """Ids of one text that holds the special token."""
    between = pa.array([x.decode("utf-8", "replace") for x in text.split(SPECIAL)])
    out: list[np.ndarray] = []
    for ids in encode_batch(between, ranks_path):
        out += [ids, np.array([SPECIAL_ID], np.uint32)]
    return np.concatenate(out[:-1])


def encode_batch(array: pa.Array, ranks_path: str):
    """Yields the ids (uint32) of each text in turn."""
    encoder = _encoders.get(ranks_path) or _encoders.setdefault(ranks_path, Encoder(ranks_path))
    for _, _, data, offsets in parts(array):
        special = set()
        raw = data.tobytes()
        at = raw.find(SPECIAL)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(SPECIAL) <= offsets[k + 1]:
                special.add(k)
            at = raw.find(SPECIAL, at + 1)
        try:
            starts, ends, first = pre_tokens(data, offsets)
        except UnicodeDecodeError:  # invalid bytes become U+FFFD
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            yield from encode_batch(pa.array(texts), ranks_path)
            continue
        ids, counts = encoder.encode(data, starts, ends)
        ids = ids.astype(np.uint32)
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[first]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            yield _with_special(raw[offsets[k] : offsets[k + 1]], ranks_path) if k in special else ids[a:b]
