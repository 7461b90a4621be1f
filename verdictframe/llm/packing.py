"""Packing along a space-filling curve (operator 5).

Every document's words are hashed to a vector of a few dimensions, its place on a Hilbert curve through that space is its key, and the
documents are range-sorted by key, so that neighbours on the curve are packed together. Each range is packed on its own: the token
stream is cut at every `length` ids, and what is left of a range at its end is cut into powers of two, which need no padding. Given a
column of languages, the order is by language and then by key, and a range's stream also ends where its language does.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import SliceHasher, lower_ascii, map_blocks, word_spans
from verdictframe.llm.pretoken import ENCODE_BYTES, encoder

#: Dimensions of the hashed vectors, and bits of each in the key.
DIMS, BITS = 4, 12
#: Documents from which the bounds of the ranges are estimated, at most about so many; every document is packed.
BOUND_SAMPLE = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A place in the order of the documents: language (null comes first) and key.
Place = tuple[str | None, int]


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell coordinates (each below 2 ** bits), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level, from the top
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The Hilbert key of each row: the mean of its words' hashed directions, scaled by the root of their number and squashed to cells."""
    start, end, first = word_spans(buf, off)
    lower = lower_ascii(buf)
    h = SliceHasher(lower).of(start, end)
    mean = np.zeros((len(off) - 1, DIMS))
    count = np.maximum(1, np.diff(first))
    for d in range(DIMS):
        part = ((h >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) - 32767.5
        total = np.concatenate([[0.0], np.cumsum(part)])
        mean[:, d] = (total[first[1:]] - total[first[:-1]]) / 32767.5 / np.sqrt(count)
    cells = np.clip((np.tanh(mean * 0.8) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_index(cells, BITS)


def _places(langs: list[str | None], at: np.ndarray, key: np.ndarray, known: list[str]) -> np.ndarray:
    """Numbers in the order of language (row i's is langs[at[i]]) and key; languages between two neighbours in `known` count as one."""
    rank = []
    for g in langs:
        i = 0 if g is None else bisect_left(known, g)
        rank.append(0 if g is None else 1 + 2 * i + (known[i : i + 1] == [g]))
    return (np.array(rank, np.int64)[at] << (DIMS * BITS)) + key if len(at) else key


def _with_keys(docs: DataFrame, bounds: list[Place] | None = None) -> DataFrame:
    """doc_id, text, lang, key and, given the inner bounds of the ranges, the range `part`. Rows whose place is itself a bound, however
    many, are spread by a hash over all the ranges that it bounds."""

    def make():
        known = sorted({g for g, _ in bounds or [] if g is not None})
        edge = np.array([_places([g], np.zeros(1, np.int64), np.array([k], np.int64), known)[0] for g, k in bounds or []], np.int64)

        def f(batch, buf, off):
            key = curve_keys(buf, off)
            lang = batch.column(2).dictionary_encode(null_encoding="encode")
            place = _places(lang.dictionary.to_pylist(), lang.indices.to_numpy(), key, known)
            low, high = np.searchsorted(edge, place, "left"), np.searchsorted(edge, place, "right")
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
            with np.errstate(over="ignore"):
                spread = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            part = low + spread % (high - low + 1)
            yield pa.record_batch([*batch.columns, pa.array(key), pa.array(part.astype(np.int32))], ["doc_id", "text", "lang", "key", "part"])

        return f

    return map_blocks(docs, make, "doc_id long, text string, lang string, key long, part int")


def curve_bounds(docs: DataFrame, parts: int, sample: int = BOUND_SAMPLE) -> list[Place]:
    """Inner bounds of `parts` ranges of about equal bytes, by language and along the curve, from a bounded sample of the documents."""
    n = docs.count()
    step = max(1, n // sample)
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(step)) == 0)
    rows = [((r.lang, r.key), r.size) for r in _with_keys(picked).select("lang", "key", F.length("text").alias("size")).limit(4 * sample).collect()]
    if not rows or parts < 2:
        return []
    rows.sort(key=lambda r: (r[0][0] is not None, r[0][0] or "", r[0][1], r[1]))
    size = np.cumsum([n + 1 for _, n in rows])
    return [rows[min(len(rows) - 1, int(np.searchsorted(size, size[-1] * k / parts)))][0] for k in range(1, parts)]


class _Packer:
    """Cuts a stream of documents into sequences; holds only what the open sequence has so far."""

    def __init__(self, part: int, length: int) -> None:
        self.part, self.length, self.sequence, self.lang = part, length, 0, None
        self.ids = np.empty(0, np.uint32)
        self.doc: list = []
        self.meta = np.empty((0, 3), np.int64)  # start, length, tokens of the document

    def turn(self, lang: str | None):
        """Documents of this language follow: what is left of another one ends here."""
        if lang != self.lang:
            yield from self.finish()
            self.lang = lang

    def add(self, doc: list, ids: np.ndarray, count: np.ndarray):
        self.doc = self.doc + doc
        self.meta = np.concatenate([self.meta, np.stack([np.zeros_like(count), count, count], 1)])
        self.ids = np.concatenate([self.ids, ids])
        full = len(self.ids) // self.length
        if full:
            yield self._cut(np.full(full, self.length, np.int64))

    def finish(self):
        rest = len(self.ids)
        if rest:
            yield self._cut(np.array([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64))

    def _cut(self, lengths: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        at = np.concatenate([[0], np.cumsum(self.meta[:, 1])])
        cuts = np.union1d(ends, at[(at > 0) & (at <= total)])
        begin = np.concatenate([[0], cuts[:-1]])
        owner = np.searchsorted(at, begin, side="right") - 1
        seq = np.searchsorted(ends, begin, side="right")
        raw = memoryview(np.ascontiguousarray(self.ids[:total], "<u4")).cast("B")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((begin * 4).tolist(), (cuts * 4).tolist())]
        columns = [
            pa.array([self.doc[i] for i in owner.tolist()], pa.int64()), pa.array(self.meta[owner, 0] + begin - at[owner]), pa.array(cuts - begin), pa.array(crc, pa.int64()),
            pa.array(self.meta[owner, 2]), pa.array((np.int64(self.part) << 32) + self.sequence + seq), pa.array(begin - (ends - lengths)[seq]),
            pa.array([self.lang] * len(cuts), pa.string()),
        ]
        self.sequence += len(lengths)
        keep = int(np.searchsorted(at, total, side="right")) - 1  # the document that the last cut leaves open, or the next one
        left = self.meta[keep:].copy()
        if len(left):
            left[0, 0] += total - at[keep]
            left[0, 1] -= total - at[keep]
        self.doc, self.meta, self.ids = self.doc[keep:], left, self.ids[total:]
        return pa.record_batch(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "lang"])


def pack_along_curve(
    docs: DataFrame, tokenizer_path: str, *, length: int = 2048, end_id: int = 1, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None,
) -> DataFrame:
    """Pieces of documents in sequences of at most `length` ids; see PIECES.

    A document is its ids and then end_id, so a null or empty text is the end id alone. Every id lies in exactly one piece. Rows that
    repeat are documents of their own and may share a doc_id; columns besides those named are ignored; an empty table has no pieces.
    Only the last sequences of a range are shorter than `length`, and those have a power of two of ids each. With `lang_col`, a sequence
    has documents of one language only (null is one of its own), a language's last sequences in a range may be as short, and pieces have
    their language as `lang`.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    keyed = _with_keys(source, curve_bounds(source, n))
    ordered = keyed.repartitionById(n, F.col("part")).sortWithinPartitions("lang", "key", "doc_id")

    def make():
        from pyspark import TaskContext

        e, packer = encoder(tokenizer_path), _Packer(TaskContext.get().partitionId(), length)

        def f(batch, buf, off):
            ids, at = e.encode(buf, off)
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            doc, lang = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            cut = [0, *(i for i in range(1, len(lang)) if lang[i] != lang[i - 1]), len(lang)]
            for a, b in zip(cut, cut[1:]):
                yield from packer.turn(lang[a])
                yield from packer.add(doc[a:b], ids[at[a] : at[b]], np.diff(at[a : b + 1]))

        return f, packer.finish

    pieces = map_blocks(ordered, make, PIECES + ", lang string", limit=ENCODE_BYTES, keep="encoder")
    return pieces if lang_col else pieces.drop("lang")
