"""Pretokens, token counts, token files and packing against the tokenizers library."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from verdictframe.llm import packing, pretoken, token_counts, token_files
from verdictframe.llm.common import SliceHasher, blocks

ALPHABET = list("aZé1٣ '\n\t\r\u0085　!?.,s t re ve 中文՘\U0001F600édlm'") + ["<|endoftext|>", "'ll", "'re ", "  ", "\n\n"]


def random_texts(n: int, seed: int, longest: int = 40) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(longest))) for _ in range(n)] + ["", "<|endoftext|><|endoftext|>", "a" * 700, "the" * 300, " " * 400, "ab" * 900 + " x"]


@pytest.mark.parametrize("limit", [1, 500, 1 << 20])
def test_ids_and_counts_of_any_text(vocabulary, tokenizer, limit):
    e, t = pretoken.WordEncoder(vocabulary), token_counts.CountingTransducer(vocabulary, chunk=7, max_states=3000)
    batch = pa.record_batch({"text": pa.array(random_texts(500, limit))})
    for part, buf, off in blocks(batch, limit=limit):
        ids, at = e.encode(buf, off)
        n = t.count(buf, off)
        for i, text in enumerate(part.column(0).to_pylist()):
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[at[i] : at[i + 1]].tolist() == want and n[i] == len(want), text


def thue_morse(n: int, a: str, b: str) -> tuple[str, str]:
    """Two words that plain polynomial hashes modulo a power of two can't tell apart."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("a, b, n", [("a", "b", 1024), ("a", "b", 128), ("aaaaaaaa", "bbbbbbbb", 1 << 14)])
def test_ids_of_words_that_hash_alike(vocabulary, tokenizer, a, b, n, monkeypatch):
    words, proper = thue_morse(n, a, b), pretoken.SliceHasher.of
    for long in (None, 0, 1):  # words of 8 bytes and more all hash alike, or by their length
        if long is not None:
            monkeypatch.setattr(pretoken.SliceHasher, "of", lambda self, start, end, by=long: np.where(end - start < 8, proper(self, start, end), ((end - start) * by).astype(np.uint64)))
        e = pretoken.WordEncoder(vocabulary)
        for text in ([*words, " ".join(words), f"{words[0]} the of {words[1]} the"], ["the", *words, "fox" * 200]):
            (_, buf, off), = blocks(pa.record_batch({"text": pa.array(text)}))
            ids, at = e.encode(buf, off)
            assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in text]


@pytest.mark.parametrize("max_states, chunk", [(120_000, 96), (500, 5), (3000, 96)])
def test_counts_of_long_pretokens(vocabulary, tokenizer, max_states, chunk):
    rng = random.Random(8)
    long = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcdefghijklmnop", 20_000), ("ab", 9000), ("中文é", 5000))]
    long += ["a" * 30_001, "=" * 12_345, "".join(rng.choice(["the", "quick", "fox", "over"]) for _ in range(6000)), "x" * 7000 + " y " + "-" * 8000, thue_morse(1 << 13, "a", "b")[0]]
    t = token_counts.CountingTransducer(vocabulary, chunk=chunk, max_states=max_states)
    (_, buf, off), = blocks(pa.record_batch({"text": pa.array(long)}))
    assert t.count(buf, off).tolist() == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in long]
    assert len(t.states) <= max(3 * max_states, 60_000) and not t.held
    once = np.zeros(len(buf), bool)
    once[0] = True  # a composed map is the run over all of its bytes
    whole = t._run(buf[:9000], once, np.array([0]), np.array([9000]), np.array([0]))
    parts = t._through(buf[:9000], once, np.array([1]), np.array([9000]), t._run(buf, once, np.array([0]), np.array([1]), np.array([0]))[0])
    assert whole[1][0] == parts[1][0] + 1


def test_counts(spark, docs, texts, odd_docs, vocabulary, tokenizer):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, vocabulary).collect()}
    for i, text in texts.items():
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 512)
    odd = token_counts.count_tokens(odd_docs, vocabulary).collect()
    assert len(odd) == 13 and {r.n_tokens for r in odd if r.doc_id in (3, 4)} == {0} and [r.n_tokens for r in odd if r.doc_id == 11] == [1]
    assert token_counts.count_tokens(docs.limit(0), vocabulary).count() == 0


def _want(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_round_trip(spark, docs, texts, vocabulary, tokenizer):
    uri, shards = token_files.write_token_files(docs, vocabulary, shards=3)
    rows, start = sorted(token_files.read_token_files(uri, shards).collect(), key=lambda r: r.doc_id), 0
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = _want(tokenizer, texts[r.doc_id], 0)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), _crc(ids))
        start += len(ids)
    assert shards.agg({"tokens": "sum"}).first()[0] == start


def test_files_of_odd_rows(odd_docs, docs, vocabulary, tokenizer):
    uri, shards = token_files.write_token_files(odd_docs, vocabulary)
    rows = sorted(token_files.read_token_files(uri, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] and [r.n_tokens for r in rows if r.doc_id in (3, 4)] == [1, 1]
    uri, shards = token_files.write_token_files(docs.limit(0), vocabulary)
    assert token_files.read_token_files(uri, shards).count() == 0


def _check_pieces(pieces, docs_of, tokenizer):
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    lengths = []
    for seq in by_seq.values():
        seq.sort(key=lambda p: p.offset)
        assert [p.offset for p in seq] == [0, *np.cumsum([p.length for p in seq])[:-1].tolist()]
        lengths.append(sum(p.length for p in seq))
    assert all(n == 2048 or (n < 2048 and n & (n - 1) == 0) for n in lengths)
    for doc_id, parts in by_doc.items():
        ids = _want(tokenizer, docs_of[doc_id], 1)
        parts.sort(key=lambda p: p.start)
        assert {p.doc_tokens for p in parts} == {len(ids)}
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1].tolist()] and sum(p.length for p in parts) == len(ids)
        assert all(p.ids_crc32 == _crc(ids[p.start : p.start + p.length]) for p in parts)


def test_packing(docs, texts, vocabulary, tokenizer):
    pieces = packing.pack_along_curve(docs, vocabulary, parts=3).collect()
    assert {p.doc_id for p in pieces} == set(texts)
    _check_pieces(pieces, texts, tokenizer)


def brute_key(text: str) -> tuple[int, ...]:
    """The cell of a text: words hashed one by one."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    hashes = [int(SliceHasher(np.frombuffer(w, np.uint8)).of(np.array([0]), np.array([len(w)]))[0]) for w in words]
    out = []
    for d in range(packing.DIMS):
        mean = sum(((h >> 16 * d) & 0xFFFF) - 32767.5 for h in hashes) / 32767.5 / math.sqrt(max(1, len(words)))
        out.append(min((1 << packing.BITS) - 1, max(0, int((math.tanh(mean * 0.8) + 1) / 2 * (1 << packing.BITS)))))
    return tuple(out)


def test_documents_follow_the_curve(docs, texts, vocabulary):
    """Keys are the places of hashed vectors on the curve, and each range's sequences hold its documents in the order of their keys."""
    ids = sorted(texts)
    (_, buf, off), = blocks(pa.record_batch({"text": pa.array([texts[i] for i in ids])}), limit=1 << 30)
    keys = dict(zip(ids, packing.curve_keys(buf, off).tolist()))
    cells = np.array([brute_key(texts[i]) for i in ids[:60]])
    assert packing.hilbert_index(cells, packing.BITS).tolist() == [keys[i] for i in ids[:60]]
    pieces = sorted(packing.pack_along_curve(docs, vocabulary, parts=3).collect(), key=lambda p: (p.sequence_id, p.offset))
    for part in range(3):
        order = [(keys[p.doc_id], p.doc_id) for p in pieces if p.sequence_id >> 32 == part]
        assert order == sorted(order) and order
    ends = [[keys[p.doc_id] for p in pieces if p.sequence_id >> 32 == part] for part in range(3)]
    assert all(a[-1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_packing_odd_rows(odd_docs, docs, vocabulary, tokenizer):
    once = odd_docs.dropDuplicates(["doc_id"])
    _check_pieces(packing.pack_along_curve(once, vocabulary).collect(), {r.doc_id: r.text for r in once.collect()}, tokenizer)
    assert len({p.sequence_id for p in packing.pack_along_curve(odd_docs, vocabulary, parts=1).collect()}) > 2
    assert packing.pack_along_curve(docs.limit(0), vocabulary).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_packing_by_language(spark, docs, texts, vocabulary, tokenizer, parts):
    lang = {i: (None, "", "de", "en", "xx")[i % 5 if i % 11 else 0] for i in texts}
    rows = spark.createDataFrame([(i, t, lang[i]) for i, t in texts.items()], "doc_id long, text string, lang string")
    pieces = packing.pack_along_curve(rows, vocabulary, parts=parts, lang_col="lang").collect()
    assert {p.doc_id for p in pieces} == set(texts) and all(p.lang == lang[p.doc_id] for p in pieces)
    _check_pieces(pieces, texts, tokenizer)
    (_, buf, off), = blocks(pa.record_batch({"text": pa.array(list(texts.values()))}), limit=1 << 30)
    keys = dict(zip(texts, packing.curve_keys(buf, off).tolist()))
    pieces.sort(key=lambda p: (p.sequence_id, p.offset))
    place = [(lang[p.doc_id] is not None, lang[p.doc_id] or "", keys[p.doc_id], p.doc_id) for p in pieces]
    assert [x[:3] for x in place] == sorted(x[:3] for x in place)  # over all ranges
    within: dict[int, list] = {}
    for p in pieces:
        within.setdefault(p.sequence_id, []).append(p)
    assert all(len({p.lang for p in s}) == 1 for s in within.values())
    short: dict[tuple, list[int]] = {}
    for i, s in within.items():
        if (n := sum(p.length for p in s)) < 2048:
            short.setdefault((i >> 32, s[0].lang), []).append(n)
    assert all(len(set(x)) == len(x) for x in short.values())  # the binary digits of one rest


def test_hilbert_curve_visits_neighbours():
    bits = 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_index(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
