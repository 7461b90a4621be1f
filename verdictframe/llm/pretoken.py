"""Splits texts for byte-level BPE into pretokens, many at once, and encodes each distinct pretoken once with the tokenizers library.

The split is that of a `ByteLevel` pre-tokenizer with its pattern: contractions, runs of letters, numbers or other signs with at
most one space before them, and runs of white space. The class of a code point is asked of the library itself when it first appears,
so its Unicode version holds. Added special tokens are found first, as the library does by default.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from verdictframe.llm.common import SliceHasher, ranges, worker_table

LETTER, NUMBER, SPACE, WHITE, OTHER, UNKNOWN = range(6)
#: Ends of the contractions that the pattern takes after an apostrophe; fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pretokens that a worker keeps with their ids; beyond it the cache starts anew.
CACHE_WORDS = 1 << 21
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 20
#: Bytes of a pretoken that is kept with its ids; longer ones go through the library each time.
CACHED_BYTES = 256
#: Pretokens that the library encodes at once.
LEARN_WORDS = 16384


class Splitter:
    """Finds pretokens in a buffer of UTF-8 texts."""

    def __init__(self, tokenizer_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        spec = json.loads(open(tokenizer_path, encoding="utf-8").read())
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        #: Whether the split below is what this tokenizer does; else whole texts go to the library.
        self.exact = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not spec.get("normalizer") and not any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip"))
        )
        self.special = [(a["content"].encode(), a["id"]) for a in added]
        self.spec = spec
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[[9, 10, 11, 12, 13]] = WHITE
        self.classes[32] = SPACE
        self._probe(np.array([c for c in range(128) if self.classes[c] == UNKNOWN]))

    def _probe(self, points: np.ndarray) -> None:
        """Letters join an 'a', numbers a '1', other signs a '!'; what joins none of them is white space."""
        for c in points.tolist():
            ch = chr(c)
            parts = {span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{ch}1{ch}!")}
            self.classes[c] = LETTER if (0, 2) in parts else NUMBER if any(s <= 1 and e >= 3 for s, e in parts) else OTHER if any(s <= 3 and e == 5 for s, e in parts) else WHITE

    def _code_points(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The code points whose first bytes stand at `at`."""
        lead = buf[at]
        cp = lead.astype(np.int64)
        n = len(buf)
        for low, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            pick = np.flatnonzero((lead >= low) & (lead < (0xE0, 0xF0, 0x100)[more - 1]))
            if len(pick):
                value = (lead[pick] & mask).astype(np.int64)
                for k in range(1, more + 1):
                    value = (value << 6) | (buf[np.minimum(at[pick] + k, n - 1)] & 0x3F)
                cp[pick] = np.minimum(value, 0x10FFFF)
        return cp

    def segments(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, rows and special ids (-1: ordinary text) of the stretches that are split on their own."""
        cuts: list[tuple[int, int, int]] = []
        raw = None
        for content, ident in self.special:
            raw = buf.tobytes() if raw is None else raw
            at = raw.find(content)
            while at >= 0:
                cuts.append((at, at + len(content), ident))
                at = raw.find(content, at + len(content))
        start, end, row = off[:-1], off[1:], np.arange(len(off) - 1)
        special = np.full(len(row), -1, np.int64)
        if cuts:
            s, e, r, k, used = [], [], [], [], 0
            cuts.sort()
            for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
                while used < len(cuts) and cuts[used][0] < a:
                    used += 1
                while used < len(cuts) and cuts[used][1] <= b:
                    x, y, ident = cuts[used]
                    used += 1
                    if x < a:
                        continue
                    s += [a, x]
                    e += [x, y]
                    r += [i, i]
                    k += [-1, ident]
                    a = y
                s.append(a), e.append(b), r.append(i), k.append(-1)
            start, end, row, special = (np.array(v, np.int64) for v in (s, e, r, k))
        keep = start < end
        return start[keep], end[keep], row[keep], special[keep]

    def starts(self, buf: np.ndarray, seg_start: np.ndarray, seg_end: np.ndarray) -> np.ndarray:
        """First bytes of the pretokens of these stretches (of ordinary text), in order."""
        if not len(seg_start):
            return np.empty(0, np.int64)
        whole = bool((seg_start[1:] == seg_end[:-1]).all()) and seg_start[0] == 0 and seg_end[-1] == len(buf)
        char = (buf & 0xC0) != 0x80
        if not whole:
            inside = np.zeros(len(buf) + 1, np.int8)
            np.add.at(inside, seg_start, 1)
            np.add.at(inside, seg_end, -1)
            char &= np.cumsum(inside[:-1]) > 0
        at = np.flatnonzero(char)
        lead = buf[at]
        kind = self.classes[lead]
        wide = np.flatnonzero(lead >= 0x80)
        if len(wide):
            points = self._code_points(buf, at[wide])
            unknown = np.unique(points[self.classes[points] == UNKNOWN])
            self._probe(unknown)
            kind[wide] = self.classes[points]
        n = len(at)
        new_seg = np.zeros(n + 1, bool)  # the first character of a stretch; n counts as one
        new_seg[np.searchsorted(at, seg_start)] = True
        new_seg[n] = True
        white = (kind == SPACE) | (kind == WHITE)
        before = np.empty(n, np.uint8)
        before[0], before[1:] = UNKNOWN, kind[:-1]
        before[new_seg[:n]] = UNKNOWN
        before_white = (before == SPACE) | (before == WHITE)
        # the last of a run of white space, when something follows, stands alone or leads what follows
        follows = np.zeros(n, bool)
        follows[:-1] = ~white[1:]
        follows &= ~new_seg[1:]
        start = np.where(white, ~before_white | follows, (before != SPACE) & (before != kind))
        start[new_seg[:n]] = True
        for i in np.flatnonzero(start & (lead == 39)).tolist():
            for tail in CONTRACTIONS:
                k = len(tail)
                if i + k < n and not new_seg[i + 1 : i + k + 1].any() and bytes(lead[i + 1 : i + k + 1]) == tail.encode():
                    start[i + 1 : i + k + 1] = False
                    if i + k + 1 < n:
                        start[i + k + 1] = True
                    break
        return at[start]


class WordEncoder(Splitter):
    """ids of whole texts: each distinct pretoken goes through the tokenizers library once, and its ids are kept.

    Pretokens are looked up by a 64-bit hash, and their bytes are then compared: one whose hash another one has goes through the library.
    """

    def __init__(self, tokenizer_path: str) -> None:
        super().__init__(tokenizer_path)
        self.spec = None  # the library's own copy is enough
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.uint32)
        self.at = np.zeros(1, np.uint32)
        self.pool = np.empty(0, np.uint32)
        self.text, self.text_at = np.empty(0, np.uint8), np.zeros(1, np.int64)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        counts, pools = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for k in range(0, len(words), LEARN_WORDS):
            got = [e.ids for e in encode(words[k : k + LEARN_WORDS], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            pools.append(np.fromiter(chain.from_iterable(got), np.uint32, int(counts[-1].sum())))
        return np.concatenate(counts), np.concatenate(pools)

    def _learn(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> None:
        parts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        count, pool = self._ids([p.decode("utf-8", "replace") for p in parts])
        slot = np.concatenate([self.slot, np.arange(len(self.at) - 1, len(self.at) - 1 + len(count), dtype=np.uint32)])
        self.at = np.concatenate([self.at, (int(self.at[-1]) + np.cumsum(count)).astype(np.uint32)])
        self.pool = np.concatenate([self.pool, pool])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(parts), np.uint8)])
        self.text_at = np.concatenate([self.text_at, int(self.text_at[-1]) + np.cumsum(end - start)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slot[order]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows as unsigned 32-bit numbers, and the n + 1 offsets of the rows among them."""
        rows = len(off) - 1
        if not self.exact:
            got = [e.ids for e in self.tokenizer.encode_batch([bytes(buf[a:b]).decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])], add_special_tokens=False)]
            count = np.fromiter(map(len, got), np.int64, rows)
            return np.fromiter((i for ids in got for i in ids), np.uint32, int(count.sum())), np.concatenate([[0], np.cumsum(count)])
        s0, s1, row, special = self.segments(buf, off)
        plain = special < 0
        start = self.starts(buf, s0[plain], s1[plain])
        end = np.empty_like(start)
        if len(start):
            end[:-1] = start[1:]
            end[-1] = s1[plain][-1]
            if not plain.all():  # a pretoken before a special token ends there
                stretch = np.searchsorted(s0[plain], start, side="right") - 1
                end = np.minimum(end, s1[plain][stretch])
        length = end - start
        h = SliceHasher(buf).of(start, end)
        known, first, back = np.unique(h, return_index=True, return_inverse=True)
        # those that differ from the first of their hash, and long ones, are encoded each for itself
        direct = (length > CACHED_BYTES) | (length != length[first[back]])
        look = np.flatnonzero(~direct & (length >= SliceHasher.RUN) & (first[back] != np.arange(len(back))))
        direct[look] = ~same_bytes(buf, start[look], buf, start[first[back[look]]], length[look])
        if len(self.keys) > CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, known)
        missing = np.ones(len(known), bool)
        ok = at < len(self.keys)
        missing[ok] = self.keys[at[ok]] != known[ok]
        held = np.flatnonzero(~missing & ~direct[first])
        if len(held):
            slot = self.slot[at[held]].astype(np.int64)
            size = length[first[held]]
            fits = self.text_at[slot + 1] - self.text_at[slot] == size
            look = np.flatnonzero(fits & (size >= SliceHasher.RUN))
            fits[look] = same_bytes(buf, start[first[held[look]]], self.text, self.text_at[slot[look]], size[look])
            other = np.zeros(len(known), bool)
            other[held[~fits]] = True
            direct |= other[back]
        raw = buf.tobytes() if missing.any() or direct.any() else b""
        missing &= ~direct[first]
        if missing.any():
            pick = first[missing]
            self._learn(known[missing], raw, start[pick], end[pick])
        at = np.minimum(np.searchsorted(self.keys, known), max(0, len(self.keys) - 1))
        pool = self.pool
        if len(self.keys):
            slot = self.slot[at]
            from_ = self.at[slot].astype(np.int64)[back]
            count = self.at[slot + 1].astype(np.int64)[back] - from_
        else:
            from_, count = np.zeros(len(back), np.int64), np.zeros(len(back), np.int64)
        alone = np.flatnonzero(direct)
        if len(alone):
            count[alone], more = self._ids([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[alone].tolist(), end[alone].tolist())])
            from_[alone] = len(pool) + np.cumsum(count[alone]) - count[alone]
            pool = np.concatenate([pool, more])
        ids = pool[ranges(from_, count)]
        where = np.searchsorted(start, off)
        upto = np.concatenate([[0], np.cumsum(count)])
        bounds = upto[where]
        if plain.all():
            return ids, bounds
        # set the special ids between
        position = upto[np.searchsorted(start, s0[~plain])]
        ids = np.insert(ids, position, special[~plain].astype(np.uint32))
        extra = np.searchsorted(s0[~plain], off)
        return ids, bounds + extra


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether slices (none of them empty) of two buffers are the same."""
    if not len(length):
        return np.empty(0, bool)
    differ = a[ranges(a_start, length)] != b[ranges(b_start, length)]
    return ~np.logical_or.reduceat(differ, np.cumsum(length) - length)


def encoder(tokenizer_path: str) -> WordEncoder:
    """This worker's encoder; workers are used again, and their caches with them."""
    return worker_table("encoder", tokenizer_path, lambda: WordEncoder(tokenizer_path))
