"""Language identification by cross-parsing (operator 10).

Each language is a suffix automaton of some labelled text. A text is parsed greedily: a phrase is the longest match with the language's
text, and the language that needs the fewest phrases for each byte, weighed by what a phrase costs (the logarithm of the length of the
language's text), is its language. Texts are cut into stretches, which all step through the automata together from a guessed state; then
the state at the end of a stretch is handed to the next one, which is read again until it meets the state that it had before, so that
the phrases are those of the whole text.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import blocks, bound_batches, drop_tables, id_text, map_blocks, text_buffer, worker_table

#: Bytes of labelled text in a language's automaton, at most, and in all automata together; a language is learned from a sample of its
#: labelled documents, a piece of at most PIECE_CHARS characters of each.
REFERENCE_BYTES, ALL_BYTES, PIECE_CHARS = 96_000, 800_000, 2_000
#: Languages that are learned: the most frequent ones.
MAX_LANGUAGES = 1000
#: Bytes of a stretch, and between the places where the states of two readings are compared.
STRETCH, MEET = 512, 64
UNDETERMINED = "und"


def folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 in lower case, and every ASCII sign that is no letter as a space."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    out = table[buf]
    if len(buf) > 1:
        capital = np.zeros(len(buf), bool)
        capital[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[capital] += 0x20
    return out


def suffix_automaton(text: list[int], width: int) -> array:
    """Next states (rows) by symbol (columns), flat, of the smallest automaton that reads every substring of `text` from state 0; -1: none."""
    none = array("i", [-1]) * width
    step = array("i", none)
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(link)
        step.extend(none)
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and step[p * width + c] < 0:
            step[p * width + c] = cur
            p = link[p]
        if p >= 0:
            q = step[p * width + c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(link)
                step.extend(step[q * width : (q + 1) * width])
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = twin
                while p >= 0 and step[p * width + c] == q:
                    step[p * width + c] = twin
                    p = link[p]
        last = cur
    return step


class CrossParser:
    """Counts the phrases of texts against the texts of several languages."""

    def __init__(self, references: dict[str, bytes]) -> None:
        self.languages = sorted(references)
        self.symbols, self.widths, self.tables, self.cost = [], [], [], []
        for g in self.languages:
            text = folded(np.frombuffer(references[g], np.uint8))
            # each language has its own alphabet; bytes that it doesn't have share the last symbol
            used = np.unique(text)
            symbol, width = np.full(256, len(used), np.uint16), len(used) + 1
            symbol[used] = np.arange(len(used))
            step = suffix_automaton(symbol[text].tolist(), width)
            before = len(step) // width
            step.extend(array("i", [0]) * width)
            # entries: next state * width * 2 + whether a phrase begins. Where the automaton can't read on, one begins with this byte;
            # the state after the last is that before a text, and after a byte that the language doesn't have
            flat = np.frombuffer(step, np.int32)
            start = np.where(flat[:width] >= 0, flat[:width], before) * (width * 2) + 1
            none = np.flatnonzero(flat < 0)
            np.multiply(flat, width * 2, out=flat)
            flat[none] = start[none % width]
            flat[-width:] = start
            self.symbols.append(symbol)
            self.widths.append(width)
            self.tables.append(flat)
            self.cost.append(np.log2(len(text) + 1))

    @staticmethod
    def _read(table: np.ndarray, symbols: np.ndarray, at: np.ndarray, n: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after n symbols from `at`, and the phrases that began among them."""
        order = np.argsort(-n, kind="stable")  # longest first, so that those still read are a prefix
        at, n, state = at[order], n[order], state[order]
        count = np.zeros(len(at), np.int64)
        live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1 if len(n) else 1), side="right")
        for k, m in enumerate(live.tolist()):
            got = table[state[:m] + symbols[at[:m] + k]]
            count[:m] += got & 1
            state[:m] = got >> 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def phrases(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each row (first axis) for each language (second axis)."""
        rows, size = len(off) - 1, np.diff(off)
        text = folded(buf)
        n = -(-size // STRETCH)
        row = np.repeat(np.arange(rows), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(off[:-1], n) + STRETCH * place
        length = np.minimum(STRETCH, off[1:][row] - at)
        follows = place > 0
        out = np.zeros((rows, len(self.languages)))
        for j, (table, symbol, width) in enumerate(zip(self.tables, self.symbols, self.widths)):
            count = self._stretches(table, symbol[text], at, length, follows, len(table) - width)
            out[:, j] = np.bincount(row, count, minlength=rows)
        return out

    def _stretches(self, table: np.ndarray, symbols: np.ndarray, at: np.ndarray, length: np.ndarray, follows: np.ndarray, before: int) -> np.ndarray:
        """Phrases that begin in each stretch; one that follows goes on from where the one before it ends."""
        marks = STRETCH // MEET
        seen, upto = np.zeros((marks, len(at)), np.int64), np.zeros((marks, len(at)), np.int64)  # state and phrases after each MEET bytes
        entry = np.full(len(at), before, np.int64)
        leaves, total = entry.copy(), np.zeros(len(at), np.int64)
        todo, again = np.arange(len(at)), False
        while len(todo):
            lanes, state, count = todo, entry[todo], np.zeros(len(todo), np.int64)
            changed = np.zeros(len(at), bool)
            for k in range(marks):
                state, more = self._read(table, symbols, at[lanes] + k * MEET, np.clip(length[lanes] - k * MEET, 0, MEET), state)
                count += more
                if again:  # where this reading meets the one before, the rest is the same
                    met = state == seen[k, lanes]
                    gain = count[met] - upto[k, lanes[met]]
                    upto[k:, lanes[met]] += gain
                    total[lanes[met]] += gain
                    lanes, state, count = lanes[~met], state[~met], count[~met]
                seen[k, lanes], upto[k, lanes] = state, count
                over = length[lanes] <= (k + 1) * MEET
                done = lanes[over]
                seen[k:, done], upto[k:, done] = state[over], count[over]
                leaves[done], total[done], changed[done] = state[over], count[over], True
                lanes, state, count = lanes[~over], state[~over], count[~over]
                if not len(lanes):
                    break
            after = np.flatnonzero(changed[:-1] & follows[1:]) + 1
            todo = after[entry[after] != leaves[after - 1]]
            entry[todo], again = leaves[todo - 1], True
        return total

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the number of its language, a score (how much dearer, of its own cost, the next language is) and its cost in bits a byte."""
        rate = self.phrases(buf, off) * np.array(self.cost) / np.maximum(1, np.diff(off))[:, None]
        best = rate.argmin(axis=1)
        low = rate[np.arange(len(rate)), best]
        others = rate.copy()
        others[np.arange(len(rate)), best] = np.inf
        second = others.min(axis=1) if rate.shape[1] > 1 else np.full(len(rate), max(self.cost))
        return best, np.clip(1 - low / np.maximum(second, 1e-9), 0, 1), low


def held_out(id_col: str | Column, modulus: int = 3, remainder: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8") if isinstance(id_col, str) else id_col), F.lit(modulus)) == remainder, F.lit(False))


def shares(sizes: dict[str, int], each: int, total: int) -> int:
    """The largest number of bytes, `each` at most, that every language may have up to, so that all together have at most `total`."""
    left, bound = total, 0
    for i, size in enumerate(sorted(min(s, each) for s in sizes.values())):
        rest = len(sizes) - i
        if size * rest > left:
            return left // rest
        left, bound = left - size, size
    return max(bound, 1)


def learn(docs: DataFrame, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """Labelled text for each language, from documents that are not held out: of each of a sample by a hash of the text, whatever its
    length, a piece whose place a hash decides, in the order of that hash, up to the bounds above. A text counts once, however often it stands;
    of every language one piece at least is taken. Reruns learn the same."""
    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    part = part.where("lang is not null and text <> ''").where(~held_out("doc_id")).select("lang", "text", F.xxhash64("text").alias("h"))
    place = F.pmod(F.xxhash64(F.lit(3), "text"), F.greatest(F.length("text") - PIECE_CHARS + 1, F.lit(1))).cast("int") + 1
    pieces = part.select("lang", "h", F.substring("text", place, F.lit(PIECE_CHARS)).alias("piece"))
    found = pieces.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts"), F.avg(F.octet_length("piece")).alias("size"), F.min(F.struct("h", "piece")).alias("least"))
    found = found.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not found:
        return {}
    each = min(REFERENCE_BYTES, max(4 * ALL_BYTES // len(found), PIECE_CHARS))
    step = {r.lang: max(1, int(r.texts * r.size / (1.5 * each))) for r in found}
    every = F.create_map(*[x for g, k in step.items() for x in (F.lit(g), F.lit(k))])[F.col("lang")]
    picked = pieces.where(F.pmod("h", every) == 0).groupBy("lang", "h").agg(F.min("piece").alias("piece")).sort("lang", "h").collect()
    taken: dict[str, list[bytes]] = {r.lang: [] for r in found}
    for r in picked:
        if sum(map(len, taken[r.lang])) < each:
            taken[r.lang].append(r.piece.encode() + b" ")
    texts = {r.lang: b"".join(taken[r.lang]) or r.least.piece.encode() for r in found}
    bound = shares({g: len(t) for g, t in texts.items()}, each, ALL_BYTES)
    return {g: t[:bound] for g, t in texts.items()}


def _parser(references: dict[str, bytes]) -> CrossParser:
    return worker_table("cross-parser", hash(tuple(sorted(references.items()))), lambda: CrossParser(references))


def lettered(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row has a letter, of any script."""
    letter = np.concatenate([[0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))])
    out = letter[off[1:]] > letter[off[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(ch.isalpha() for ch in bytes(buf[off[i] : off[i + 1]]).decode("utf-8", "replace"))
    return out


def decide(buf: np.ndarray, off: np.ndarray, references: dict[str, bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and cost of each row; `und`, 0 and 0 where a row has no letter, or nothing was learned."""
    n = len(off) - 1
    names, score, bits = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
    if references:
        p = _parser(references)
        best, score, bits = p.predict(buf, off)
        names = [p.languages[i] for i in best.tolist()]
    for i in np.flatnonzero(~lettered(buf, off)).tolist():
        names[i], score[i], bits[i] = UNDETERMINED, 0.0, 0.0
    return names, score, bits


def identify(docs: DataFrame, references: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and bits (cost in bits a byte) of every row."""

    def make():
        def f(batch, buf, off):
            yield pa.record_batch([batch.column(0), *(pa.array(x) for x in decide(buf, off, references))], ["doc_id", "lang_pred", "score", "bits"])

        return f

    return map_blocks(id_text(docs, id_col, text_col), make, "doc_id long, lang_pred string, score double, bits double", keep="cross-parser")


def determined_rows(docs: DataFrame, references: dict[str, bytes], *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose text has a letter; those with a null text or without a letter go, whatever was learned.

    A null language becomes the one that cross-parsing finds, if any was learned; everything else stays unchanged.
    """

    def run(batches):
        drop_tables("cross-parser")
        for batch in batches:
            for part, buf, off in blocks(batch, text_col):
                part = part.filter(pa.array(lettered(buf, off)))
                at = part.schema.get_field_index(lang_col)
                if references and at >= 0 and part.column(at).null_count:
                    lang = part.column(at)
                    names, _, _ = decide(*text_buffer(part.filter(lang.is_null()).column(part.schema.get_field_index(text_col))), references)
                    part = part.set_column(at, part.schema.field(at), pc.replace_with_mask(lang, lang.is_null(), pa.array(names, pa.string()).cast(lang.type)))
                yield part

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits of every row; learned from the rows with a language that are not held out.

    A null doc_id is not held out. Texts of any length are parsed whole. Rows that repeat stay; ties go to the language first in the alphabet; other columns are ignored.
    """
    found = identify(docs, learn(docs, lang_col=lang_col, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits")
