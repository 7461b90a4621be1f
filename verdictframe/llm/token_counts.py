"""Token counts by a compiled finite-state transducer (operator 8).

Byte-level BPE has a left-to-right form: the last token of the encoding of a prefix `p` of a pretoken is the only token `t` that
ends `p` and may follow the last token of what stands before it (two tokens may stand side by side if their joint bytes encode to
just these two). So a deterministic automaton can read a pretoken byte by byte. A state holds, for each suffix of the prefix that
some token begins with, the last token before that suffix and how many tokens fewer the text before it has; a transition is
annotated with the change of the token count. States are made when a text first needs them and kept as dense rows of a table; when
they outgrow its limit, even inside a text, only those that some stretch is in stay.

A text is cut into chunks of a fixed number of bytes, whose state maps send the state at their start to the state at their end and the
tokens emitted. Where a pretoken starts within a chunk, all entry states meet in the root, so the map is a constant after a head. A
stretch of chunks inside one pretoken is cut into pieces; the map of a piece is found for the states that its start may have (those
that a few starts shortly before it lead to), all pieces at once, and the maps are composed in a tree, level by level. The state at
the start of the stretch then goes down the tree; a part whose map lacks the state that it gets is run from it. All stretches step
together, one table lookup for each byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdictframe.llm.common import id_text, map_blocks, worker_table
from verdictframe.llm.pretoken import Splitter

#: Bytes of a chunk, and chunks of a piece of a long pretoken.
CHUNK, PIECE_CHUNKS = 96, 16
#: Starts before a piece that give the states that it may begin in, and how far before it the last of them is (in chunks).
GUESSES, GUESS_CHUNKS = 4, 1
#: States of the table (1 KB each) above which only those in use are kept.
MAX_STATES = 120_000
#: Stretches up to which a loop over bytes beats steps over all stretches.
FEW = 3
ROOT = 0
_NONE = -1
_ENDLESS = 1 << 62


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: visible Latin-1 signs are themselves, the rest follow 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class CountingTransducer(Splitter):
    """Counts the tokens of texts without making them."""

    def __init__(self, tokenizer_path: str, chunk: int = CHUNK, max_states: int = MAX_STATES) -> None:
        super().__init__(tokenizer_path)
        self.chunk, self.max_states = chunk, max_states
        back = _byte_of_char()
        special = {a["id"] for a in self.spec.get("added_tokens") or []}
        model = self.spec["model"]
        raw = lambda s: bytes(back[c] for c in s)
        self.exact = self.exact and model.get("dropout") is None and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if not self.exact:
            return
        ids = {raw(s): i for s, i in model["vocab"].items() if i not in special}
        #: (left, right) -> place among the merges
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, list[tuple[int, int, int]]] = {}
        formed = {ids[bytes([b])]: _NONE for b in range(256) if bytes([b]) in ids}
        self.exact = len(formed) == 256
        for rank, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.exact = self.exact and left in formed and right in formed  # parts are made before their whole
            formed.setdefault(whole, rank)
            self.rank[left, right] = rank
            parts.setdefault(whole, []).append((rank, left, right))
        self.spec = None
        if not self.exact:
            return
        self.pairs: dict[int, bool] = {}
        #: For each token the pieces at its left and at its right edge, from a byte to itself, each with the rank at which it is taken up.
        self.left_edge: dict[int, tuple] = {t: ((t, _ENDLESS),) for t, r in formed.items() if r == _NONE}
        self.right_edge = dict(self.left_edge)
        for whole in sorted(parts, key=lambda t: parts[t][0][0]):
            for rank, a, b in parts[whole]:  # the first way to make it whose parts stay apart until then
                if a in self.left_edge and b in self.left_edge and self._apart(a, b, rank):
                    self.left_edge[whole] = (*self.left_edge[a][:-1], (a, rank), (whole, _ENDLESS))
                    self.right_edge[whole] = (*self.right_edge[b][:-1], (b, rank), (whole, _ENDLESS))
                    break
        # a trie of the tokens; those that merges never make can't be the last token of anything
        self.child: dict[int, int] = {}
        self.token, self.inner = [_NONE], [True]
        for t, i in ids.items():
            node = 0
            for byte in t:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(_NONE)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.child[key]
            if i in self.left_edge:
                self.token[node] = i
        self._restart()

    def _apart(self, a: int, b: int, below: int = _ENDLESS) -> bool:
        """Whether merges of a rank less than `below` leave the joint bytes of two tokens as these two.

        The pieces at the seam grow with the rank; where two that meet have a merge that comes before either is taken up, they join. Of
        equal merges the left one comes first.
        """
        left, right, i, j = self.right_edge[a], self.left_edge[b], 0, 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            q = self.rank.get((x, y), _ENDLESS)
            if q < below and q < until_x and q <= until_y:
                return False
            if until_x == until_y == _ENDLESS:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def _beside(self, a: int, b: int) -> bool:
        if a == _NONE:
            return True
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self._apart(a, b)
        return found

    def _restart(self, keep: list[tuple] | None = None) -> None:
        #: Each state: its open suffixes, longest first, as node of the trie, last token before it, tokens there less tokens here; the empty one is last.
        self.states: list[tuple[tuple[int, int, int], ...]] = keep or [((0, _NONE, 0),)]
        self.state_of = {s: i for i, s in enumerate(self.states)}
        self.limit = max(self.max_states, 2 * len(self.states))
        if len(self.pairs) > 4 * self.max_states:
            self.pairs.clear()
        #: Next state * 256 + change of the count + 128; -1: not made yet.
        self.table = np.full((max(1024, 1 << len(self.states).bit_length()), 256), -1, np.int64 if self.max_states >= 1 << 22 else np.int32)
        #: Arrays of states that are in use.
        self.held: list[np.ndarray] = getattr(self, "held", [])

    def _hold(self, states: np.ndarray) -> np.ndarray:
        self.held.append(states)
        return states

    def _compact(self) -> None:
        """Drop the states that no array in use has, and number the rest anew in these arrays."""
        kept = np.unique(np.concatenate([[ROOT], *(h[h >= 0] for h in self.held)]))
        for h in self.held:
            h[h >= 0] = np.searchsorted(kept, h[h >= 0])
        self._restart([self.states[k] for k in kept.tolist()])

    def _transition(self, state: int, byte: int) -> int:
        last, less, grown = _NONE, 0, []
        for node, before, delta in self.states[state]:
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token[child]
            if last == _NONE and token != _NONE and self._beside(before, token):
                last, less = token, delta
            if self.inner[child]:
                grown.append((child, before, delta))
        change = less + 1
        key = (*((n, t, d - change) for n, t, d in grown), (0, last, 0))
        new = self.state_of.setdefault(key, len(self.states))
        if new == len(self.states):
            self.states.append(key)
            if new >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        self.table[state, byte] = out = new * 256 + change + 128
        return out

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        at = state * 256 + byte
        got = self.table.ravel()[at]
        miss = got < 0
        if miss.any():
            for key in np.unique(at[miss]).tolist():
                self._transition(key >> 8, key & 255)
            got = self.table.ravel()[at]
        return got

    def _run(self, buf: np.ndarray, opens: np.ndarray, at: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States at `end` and tokens emitted, for stretches that start in `state`; a pretoken's first byte is read from the root."""
        order = np.argsort(at - end, kind="stable")  # longest first, so that those still running are a prefix
        at, length, state = at[order], (end - at)[order], self._hold(state[order].astype(np.int64))
        count = np.zeros(len(at), np.int64)
        if len(at) <= FEW:
            for i, (a, n) in enumerate(zip(at.tolist(), length.tolist())):
                s, c = int(state[i]), 0
                for byte, first in zip(buf[a : a + n].tolist(), opens[a : a + n].tolist()):
                    if len(self.states) > self.limit:
                        state[i] = s
                        self._compact()
                        s = int(state[i])
                    s = ROOT if first else s
                    got = int(self.table[s, byte])
                    got = self._transition(s, byte) if got < 0 else got
                    s, c = got >> 8, c + (got & 255) - 128
                state[i], count[i] = s, c
        else:
            live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if len(length) else 1), side="right")
            for k, n in enumerate(live.tolist()):
                if len(self.states) > self.limit:
                    self._compact()
                here = at[:n] + k
                got = self._step(np.where(opens[here], ROOT, state[:n]), buf[here])
                state[:n] = got >> 8
                count[:n] += (got & 255) - 128
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return self._hold(state[back]), count[back]

    def _through(self, buf: np.ndarray, opens: np.ndarray, at: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_run for stretches inside a pretoken each: long ones by composed maps of their pieces."""
        size = self.chunk * PIECE_CHUNKS
        guess = self.chunk * GUESS_CHUNKS
        exits, counts = self._hold(np.full(len(at), ROOT)), np.zeros(len(at), np.int64)
        long = end - at > 3 * size
        short = np.flatnonzero(~long)
        exits[short], counts[short] = self._run(buf, opens, at[short], end[short], state[short])
        long = np.flatnonzero(long)
        if not len(long):
            return exits, counts
        n = -(-(end[long] - at[long]) // size)
        first = np.cumsum(n) - n
        chain = np.repeat(long, n)
        a = at[chain] + size * (np.arange(len(chain)) - np.repeat(first, n))
        b = np.minimum(a + size, end[chain])
        # the states that a piece may begin in: from starts before it, or, for the first, that of the stretch
        inner = np.setdiff1d(np.arange(len(a)), first)
        piece = np.repeat(inner, GUESSES)
        begin = a[piece] - guess - np.tile(np.arange(GUESSES), len(inner))
        entry, _ = self._run(buf, opens, begin, a[piece], np.zeros(len(piece), np.int64))
        piece, entry = np.concatenate([piece, first]), np.concatenate([entry, state[long]])
        order = np.lexsort((entry, piece))
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(piece[order]) != 0) | (np.diff(entry[order]) != 0)
        piece, entry = piece[order[once]], self._hold(entry[order[once]])
        out, count = self._run(buf, opens, a[piece], b[piece], entry)
        # states don't change from here to the way down, so keys of piece and state stay
        levels = [self._level(piece, entry, out, count)]
        while len(levels[-1][0]) and int(n.max()) > 1 << (len(levels) - 1):
            levels.append(self._composed(levels[-1], first, n, len(levels)))
        for c, f, m in zip(long.tolist(), first.tolist(), n.tolist()):
            s, total, p = int(state[c]), 0, 0
            while p < m:
                for k in range(len(levels) - 1, -1, -1):  # the largest part that begins here, is whole, and knows the state
                    if p % (1 << k) == 0 and p + (1 << k) <= m and (hit := levels[k][1].get((f + p, s))) is not None:
                        s, total, p = hit[0], total + hit[1], p + (1 << k)
                        break
                else:
                    if len(self.states) > 2 * self.max_states:  # the maps know little of this text; go on without them
                        here, levels = self._hold(np.array([s])), []
                        self._compact()
                        s = int(here[0])
                    s, more = self._alone(buf, opens, int(a[f + p]), int(b[f + p]), s, drop=not levels)
                    total, p = total + more, p + 1
            exits[c], counts[c] = s, total
        return exits, counts

    def _alone(self, buf: np.ndarray, opens: np.ndarray, at: int, end: int, state: int, drop: bool) -> tuple[int, int]:
        """_run for one stretch, which drops states only if `drop`."""
        limit = self.limit
        if not drop:
            self.limit = _ENDLESS
        out, count = self._run(buf, opens, np.array([at]), np.array([end]), np.array([state]))
        if not drop:
            self.limit = limit
        return int(out[0]), int(count[0])

    @staticmethod
    def _level(piece: np.ndarray, entry: np.ndarray, out: np.ndarray, count: np.ndarray) -> tuple[list, dict]:
        """The maps of all parts of one length: rows (first piece, entry, exit, tokens), and exit and tokens by first piece and entry."""
        rows = list(zip(piece.tolist(), entry.tolist(), out.tolist(), count.tolist()))
        return rows, {(p, e): (x, c) for p, e, x, c in rows}

    @staticmethod
    def _composed(level: tuple[list, dict], first: np.ndarray, n: np.ndarray, k: int) -> tuple[list, dict]:
        """Maps of parts of 1 << k pieces from those of half the length, where the right half knows the state that the left one gives."""
        half, known, rows = 1 << (k - 1), level[1], []
        start = np.repeat(first, n)  # of each piece's stretch
        for p, e, x, c in level[0]:
            if (p - int(start[p])) % (1 << k) == 0 and (hit := known.get((p + half, x))) is not None:
                rows.append((p, e, hit[0], c + hit[1]))
        return rows, {(p, e): (x, c) for p, e, x, c in rows}

    def count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        rows = len(off) - 1
        if not self.exact:
            got = self.tokenizer.encode_batch([bytes(buf[a:b]).decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])], add_special_tokens=False)
            return np.fromiter((len(e.ids) for e in got), np.int64, rows)
        s0, s1, row, special = self.segments(buf, off)
        total = np.bincount(row[special >= 0], minlength=rows).astype(np.int64)
        s0, s1, row = s0[special < 0], s1[special < 0], row[special < 0]
        start = self.starts(buf, s0, s1)
        if not len(start):
            return total
        self.held = []
        opens = np.zeros(len(buf), bool)
        opens[start] = True
        n_chunks = -(-(s1 - s0) // self.chunk)
        first = np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        k = np.arange(len(first)) - first
        a = np.repeat(s0, n_chunks) + k * self.chunk
        b = np.minimum(a + self.chunk, np.repeat(s1, n_chunks))
        meet = start[np.minimum(np.searchsorted(start, a), len(start) - 1)]  # where the entry states of a chunk meet
        meet = np.where((meet < a) | (meet >= b), b, meet)
        constant = meet < b
        exit_state = self._hold(np.full(len(a), -1, np.int64))
        count = np.zeros(len(a), np.int64)
        body = np.flatnonzero(constant)
        exit_state[body], count[body] = self._run(buf, opens, meet[body], b[body], np.zeros(len(body), np.int64))
        # stretches of chunks inside one pretoken, each after a chunk with a constant map; the first chunk of a segment is one
        through = np.flatnonzero(~constant)
        if len(through):
            head = through[np.concatenate([[True], np.diff(through) > 1])]
            tail = through[np.concatenate([np.diff(through) > 1, [True]])]
            exit_state[tail], count[head] = self._through(buf, opens, a[head], b[tail], self._hold(exit_state[head - 1]))
        heads = np.flatnonzero(constant & (meet > a))
        _, more = self._run(buf, opens, a[heads], meet[heads], exit_state[heads - 1])
        count[heads] += more
        self.held = []
        return total + np.bincount(np.repeat(row, n_chunks), count, minlength=rows).astype(np.int64)


def transducer(tokenizer_path: str, chunk: int = CHUNK, max_states: int = MAX_STATES) -> CountingTransducer:
    """This worker's transducer; its states stay for later tasks."""
    key = (tokenizer_path, chunk, max_states)
    return worker_table("transducer", key, lambda: CountingTransducer(*key))


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row, without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; rows that repeat are counted each; other columns are ignored, whatever they are
    called. Added special tokens inside a text count as one token, as the library takes them. Tokenizers that are not plain byte-level
    BPE are counted by the library itself. An empty table gives an empty result. A pretoken of any length is read in memory that its
    bytes and MAX_STATES bound.
    """

    def make():
        t = transducer(tokenizer_path)

        def f(batch, buf, off):
            n = t.count(buf, off)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return f

    return map_blocks(id_text(docs, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", keep="transducer")
