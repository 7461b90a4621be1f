"""Toxicity by class-conditional Kneser-Ney models (operator 4).

Two models, one of toxic and one of ordinary text, hold continuation counts of word pairs (after how many different words a pair
stands), back off to those of words in their class, and these to the continuation counts of both classes together. Copies of a document
add nothing to such counts. Every count of either class is discounted by the same DISCOUNT, so a word that is rare in both falls back to the
shared counts in both and says nothing. A document's evidence is the
difference of the two log-likelihoods, normalised by length, over the whole text and over its TELLING most telling distinct words; a
logistic curve fitted to labelled documents that the counts don't include turns their sum into a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import SliceHasher, as_signed, id_text, map_blocks, materialize, mix64, within_bound
from verdictframe.llm.language_id import folded

#: Labelled documents that the model is fitted on, at most about so many of each class.
FIT_DOCS = 12_000
#: Characters of each of these documents, at most: of a longer one a piece whose place a hash decides.
FIT_CHARS = 20_000
#: Taken from every count of either class, whatever the size of the sample. Kneser-Ney's own discounts are below 1; with those, pairs that
#: the smaller class has once or twice by chance drown the rest (chosen on folds of training labels).
DISCOUNT = 3.0
#: Distinct words whose mean log-ratio counts besides that of the whole text: one pair by chance is not enough.
TELLING = 3
#: One labelled document in so many calibrates the curve instead of being counted.
CALIBRATE = 4
THRESHOLD = 0.3
#: Bytes that a label counts in a broadcast.
LABEL_BYTES = 24


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the folded words of all rows, and the n + 1 offsets of the rows among them."""
    text = folded(buf)
    if not len(text):
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    inside = text != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] |= inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return SliceHasher(text).of(start, end), np.searchsorted(start, off)


def _pairs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the word before it in its row (0 at a row's start), and the key of the two."""
    before = np.zeros_like(words)
    before[1:] = words[:-1]
    before[at[:-1][at[:-1] < at[1:]]] = 0
    with np.errstate(over="ignore"):
        return before, mix64(before * np.uint64(0x9E3779B97F4A7C15) ^ words)


class KneserNey:
    """log P(toxic) - log P(ordinary) of words in context. Arrays of both classes have the toxic one first."""

    def __init__(self, word: np.ndarray, cont: np.ndarray, shared: np.ndarray, total: tuple[float, float], backoff: float, pair: np.ndarray, pair_share: np.ndarray, context: np.ndarray, context_backoff: np.ndarray) -> None:
        order = np.argsort(word)
        self.word, self.base = word[order], (cont / np.maximum(1.0, np.array(total))[:, None] + backoff * shared)[:, order]
        self.own = (cont > 0).any(axis=0)[order]
        order = np.argsort(pair)
        self.pair, self.pair_share = pair[order], pair_share[:, order]
        order = np.argsort(context)
        self.context, self.context_backoff = context[order], context_backoff[:, order]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def evidence(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each row, the mean log-ratio of its words and that of its TELLING distinct words with the largest, added; 0 without words."""
        words, at = _words(buf, off)
        out = np.zeros(len(off) - 1)
        if not len(words):
            return out
        i, known = self._find(self.word, words)
        ratio = np.zeros(len(words))
        hit = np.flatnonzero(known)
        if len(hit):
            before, pair = _pairs(words, at)
            p = self.base[:, i[hit]]
            c, seen = self._find(self.context, before[hit])
            if seen.any():
                p = p * np.where(seen, self.context_backoff[:, c], 1.0)
            j, both = self._find(self.pair, pair[hit])
            if both.any():
                p = p + np.where(both, self.pair_share[:, j], 0.0)
            # a word that both classes take from the shared counts says nothing, unless its pair does
            ratio[hit] = np.where(self.own[i[hit]] | both, np.log(p[0]) - np.log(p[1]), 0.0)
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((-ratio, words, row))  # of a word that stands several times, the place with the largest ratio
        w, r = words[order], row[order]
        order = order[np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])])]
        order = order[np.lexsort((-ratio[order], row[order]))]
        distinct = np.bincount(row[order], minlength=len(n))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(distinct) - distinct, distinct)
        top = order[rank < TELLING]
        some = n > 0
        telling = np.bincount(row[top], ratio[top], minlength=len(n))[some] / np.minimum(distinct[some], TELLING)
        out[some] = telling + np.bincount(row, ratio, minlength=len(n))[some] / n[some]
        return out


def fit_model(source: DataFrame, marks: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[KneserNey | None, float, float]:
    """The model and the curve's slope and intercept, from (doc_id, text) and (doc_id, toxic) rows; of many labels, a sample by hash of the
    doc_id, bounded for each class and drawn before any text is joined."""
    rows = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    pos, neg = rows.get(1, 0), rows.get(0, 0)
    prior = (pos + 1) / (pos + neg + 2)
    if not pos or not neg:
        return None, 0.0, float(np.log(prior / (1 - prior)))
    step = F.when(F.col("toxic") == 1, F.lit(max(1, pos // fit_docs))).otherwise(F.lit(max(1, neg // fit_docs)))
    h = F.xxhash64(F.lit(5), "doc_id")
    drawn = marks.where(F.pmod(h, step) == 0).select("doc_id", "toxic", (F.pmod(F.shiftrightunsigned(h, 20), F.lit(CALIBRATE)) == 0).alias("held"))
    joined = source.join(within_bound(drawn, LABEL_BYTES), "doc_id")
    sample = materialize(joined.select("doc_id", fit_piece("text").alias("text"), "toxic", "held"), "toxicity-sample")

    def make():
        def f(batch, buf, off):
            words, at = _words(buf, off)
            before, _ = _pairs(words, at)
            earlier, _ = _pairs(before, at)
            toxic = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), np.diff(at)).astype(np.int64)
            key = mix64(mix64(mix64(earlier) ^ before) ^ words) * np.uint64(2) + toxic.astype(np.uint64)
            first = np.unique(key, return_index=True)[1] if len(key) else np.empty(0, np.int64)
            yield pa.record_batch([*(pa.array(as_signed(x[first])) for x in (earlier, before, words)), pa.array(toxic[first])], ["u", "v", "w", "toxic"])

        return f

    triples = map_blocks(sample.where("not held").select("doc_id", "text", "toxic"), make, "u long, v long, w long, toxic long")
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = triples.repartition(parts, "v", "w").groupBy("v", "w", "u").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("o"))
    pairs = materialize(once.groupBy("v", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "toxicity-pairs")
    sums = pairs.agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.sum((F.col("t") > 0).cast("long")).alias("ct"), F.sum((F.col("o") > 0).cast("long")).alias("co"), F.count(F.lit(1)).alias("c")).first()
    if not sums.c or not sums.t or not sums.o:
        return None, 0.0, float(np.log(prior / (1 - prior)))
    conts = pairs.groupBy("w").agg(F.sum((F.col("t") > 0).cast("long")).alias("t"), F.sum((F.col("o") > 0).cast("long")).alias("o"), F.count(F.lit(1)).alias("c"))
    above = lambda c, d: F.greatest(F.col(c) - F.lit(d), F.lit(0.0))
    kept = conts.select("w", "c", above("t", DISCOUNT).alias("t"), above("o", DISCOUNT).alias("o"))
    mass = kept.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    backoff = max(1e-6, 1 - (mass.t / sums.ct + mass.o / sums.co) / 2)
    strong = pairs.select("v", "w", above("t", DISCOUNT).alias("t"), above("o", DISCOUNT).alias("o")).where("t > 0 or o > 0")
    # words with a count or a pair left: at most one for each DISCOUNT events of the bounded sample
    words = kept.join(strong.select("w", F.lit(True).alias("paired")).distinct(), "w", "left").where("t > 0 or o > 0 or paired").collect()
    context = pairs.groupBy("v").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    taken = strong.groupBy("v").agg(F.sum("t").alias("st"), F.sum("o").alias("so")).join(context, "v").collect()
    pair_rows = strong.join(context.select("v", F.col("t").alias("nt"), F.col("o").alias("no")), "v").collect()
    u64 = lambda v: np.array(v, np.int64).view(np.uint64) if len(v) else np.empty(0, np.uint64)
    v, w = u64([r.v for r in pair_rows]), u64([r.w for r in pair_rows])
    with np.errstate(over="ignore"):
        keys = mix64(v * np.uint64(0x9E3779B97F4A7C15) ^ w)
    model = KneserNey(
        u64([r.w for r in words]), np.array([[r.t for r in words], [r.o for r in words]], float).reshape(2, -1), np.array([r.c for r in words], float) / sums.c, (sums.ct, sums.co), backoff,
        keys, np.array([[r.t / max(1, r.nt) for r in pair_rows], [r.o / max(1, r.no) for r in pair_rows]], float).reshape(2, -1),
        u64([r.v for r in taken]), np.array([[1 - r.st / max(1, r.t) for r in taken], [1 - r.so / max(1, r.o) for r in taken]], float).reshape(2, -1),
    )
    checked = _evidence(sample.where("held").select("doc_id", "text", "toxic"), model, "toxic").collect()
    slope, intercept = fit_curve(np.array([r.evidence for r in checked]), np.array([r.toxic for r in checked]), prior)
    return model, slope, intercept


def fit_piece(text: str) -> Column:
    place = F.pmod(F.xxhash64(F.lit(6), text), F.greatest(F.length(text) - FIT_CHARS + 1, F.lit(1))).cast("int") + 1
    return F.substring(text, place, F.lit(FIT_CHARS))


def fit_curve(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of y over x, with a small ridge, by Newton's method."""
    if len(x) < 4 or y.min(initial=1) == y.max(initial=0):
        return 4.0, float(np.log(prior / (1 - prior))) - 2.0
    a, b = 1.0, float(np.log(prior / (1 - prior)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.02 * a, (p - y).sum() + 0.002 * b])
        s = p * (1 - p)
        hess = np.array([[(s * x * x).sum() + 0.02, (s * x).sum()], [(s * x).sum(), s.sum() + 0.002]])
        move = np.linalg.solve(hess, g)
        scale = min(1.0, 4.0 / max(1e-9, np.abs(move).max()))
        a, b = a - scale * move[0], b - scale * move[1]
    return float(max(a, 0.0)), float(b)


def _evidence(rows: DataFrame, model: KneserNey, *more: str) -> DataFrame:
    def make():
        def f(batch, buf, off):
            yield pa.record_batch([batch.column(0), pa.array(model.evidence(buf, off)), *(batch.column(i) for i in range(2, batch.num_columns))], ["doc_id", "evidence", *batch.schema.names[2:]])

        return f

    kinds = dict(rows.dtypes)
    return map_blocks(rows, make, ", ".join(["doc_id long", "evidence double", *(f"{c} {kinds[c]}" for c in more)]))


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(modulus)) == remainder, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.3) of every row; fitted on labelled rows that are not held out.

    Null and empty texts have no evidence and get the curve's value there. Of several labels of a document the greatest counts; null
    labels don't. Rows that repeat stay, a null doc_id is not held out, other columns are ignored. Without labels of both classes every
    score is the share of toxic labels.
    """
    source = id_text(docs, id_col, text_col)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    model, slope, intercept = fit_model(source, materialize(marks.where(~held_out("doc_id")), "toxicity-labels"), fit_docs)
    scored = _evidence(source, model) if model is not None else source.select("doc_id", F.lit(0.0).alias("evidence"))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(intercept))))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))
