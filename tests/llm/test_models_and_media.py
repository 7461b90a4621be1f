"""Mixing, media, toxicity and language identification."""

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from verdictframe.llm import chunking, language_id, media, mixing, toxicity
from tests.llm.conftest import prose


def brute_targets(sizes, weights, total, cap):
    """Round after round: share what is left by weight, clamp what is above."""
    fixed = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        share = {i: Fraction(left) * weights[i] / weight for i in free}
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: Fraction(cap * sizes[i]) for i in over}


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 50], [0, 7, 3, 900], [5], [3, 3, 3, 3, 1000, 1, 1]])
def test_water_filling(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total = Fraction(sum(sizes)) * Fraction(3, 2)
    got = mixing.water_fill(sizes, weights, total, 2)
    assert got == brute_targets(sizes, weights, total, 2) and sum(got) == total


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(docs):
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    source = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    assert set(rows) == set(source)
    names = sorted({s for s, _ in source.values()})
    size = {n: sum(_words(t) for s, t in source.values() if s == n) for n in names}
    targets = dict(zip(names, mixing.water_fill([size[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], Fraction(sum(size.values())) * Fraction(3, 2), 2)))
    for n in names:
        mine = [rows[i] for i, (s, _) in source.items() if s == n]
        longest = max(r.size for r in mine)
        assert {(r.source_size, r.target) for r in mine} == {(size[n], float(targets[n]))} and abs(sum(r.taken for r in mine) - targets[n]) <= longest
    assert all(r.size == _words(source[i][1]) and r.taken <= 2 * r.size for i, r in rows.items())
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in rows.items()}
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in rows.values())


def test_mix_of_odd_rows(odd_docs, docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 13 and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed_rows(odd_docs).columns == odd_docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def brute_media(text) -> tuple[bytes, bytes, str]:
    """Payload, stored file (by the standard library) and feature of a text."""
    raw = (text or "").encode()
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000)
        w.writeframes(payload)
    n, total = len(payload), sum(payload)
    over = [x * n > total for x in payload]
    bands = [sum(x // 32 == k for x in payload) for k in range(8)]
    spread = max(0.0, sum(x * x for x in payload) / n - (total / n) ** 2) ** 0.5
    return payload, out.getvalue(), f"mean={total / n:.4f};rms={spread:.4f};crossings={sum(a != b for a, b in zip(over, over[1:]))};bands=" + ",".join(map(str, bands))


def test_media(docs, texts):
    for r in media.media_features(docs).collect():
        payload, stored, feature = brute_media(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), feature)


def test_media_chunks_are_stored_once(spark):
    """Every distinct chunk has one owner, and the lists give back every file, with texts and doc_ids that many rows share."""
    shared = prose(50, 400)
    rows = [(i, prose(60 + i, 30) + shared + prose(70 + i, 30)) for i in range(5)] + [(9, shared), (10, shared), (10, shared), (11, None), (None, shared), (None, None), (10, "x")] + [(100 + i, shared) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, store = media.store_media(df, bits=6)
    files = {r.media_id: r for r in store.collect()}
    want = {hashlib.sha256(f).hexdigest(): f for f in (brute_media(t)[1] for _, t in rows)}
    assert files.keys() == want.keys()
    held = {}
    for r in files.values():
        for d, c in zip(r.digests, r.data):
            if c is not None:
                assert held.setdefault(bytes(d), (r.media_id, bytes(c))) == (r.media_id, bytes(c)) and hashlib.blake2b(c, digest_size=16).digest() == bytes(d)
    for name, r in files.items():
        assert b"".join(held[bytes(d)][1] for d in r.digests) == want[name]
        ends = set(np.cumsum([len(held[bytes(d)][1]) for d in r.digests]).tolist())
        assert ends == brute_cuts(want[name], 6)
    assert sum(len(c) for _, c in held.values()) < sum(map(len, want.values())) / 2
    got = media.media_features(df, bits=6).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.media_sha256) for r in got) == sorted((i is None, i or 0, hashlib.sha256(brute_media(t)[1]).hexdigest()) for i, t in rows)


def brute_cuts(raw: bytes, bits: int) -> set[int]:
    """Ends of chunks, by the gear hash of each window on its own."""
    w, out = chunking.WINDOW, {len(raw)}
    for i in range(w, len(raw) + 1):
        h = 0
        for b in raw[i - w : i]:
            h = (h << 1) + int(chunking.GEAR[b])
        if (h >> (w - bits)) & ((1 << bits) - 1) == 0:
            while i < len(raw) and raw[i] & 0xC0 == 0x80:
                i += 1
            out.add(i)
    assert max(np.diff([0, *sorted(out)])) <= media.LONGEST
    return out


def test_media_of_odd_rows(odd_docs, docs):
    rows = media.media_features(odd_docs).collect()
    assert len(rows) == 13 and {r.payload_bytes for r in rows if r.doc_id in (3, 4)} == {64}
    assert media.media_features(docs.limit(0)).count() == 0


def _labelled(spark, n=400):
    rng = np.random.Generator(np.random.PCG64(5))
    rows, marks = [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        words = prose(1000 + i, 60).split()
        if toxic:
            words.insert(int(rng.integers(0, 60)), str(rng.choice(["vile", "rotten", "awful"])))
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark):
    df, labels = _labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out]
    assert sum(t == p for t, p in held) >= 0.95 * len(held)


def test_toxicity_ignores_what_it_must_not_see(spark):
    df, labels = _labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 4) = 2 then 1 - toxic else toxic end as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(df, x).collect()} for x in (labels, flipped))
    assert a == b


def test_the_toxicity_model_against_plain_counts(spark):
    """The log-ratios of the fitted model, from counts in dictionaries of words."""
    from pyspark.sql import functions as F

    df, labels = _labelled(spark, 300)
    h = F.xxhash64(F.lit(5), "doc_id")
    held = {r.doc_id for r in df.where(F.pmod(F.shiftrightunsigned(h, 20), F.lit(toxicity.CALIBRATE)) == 0).collect()}
    model, _, _ = toxicity.fit_model(df, labels)
    text, mark = {r.doc_id: r.text for r in df.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    words = lambda t: re.findall("[a-zà-ÿ]+", t.lower())
    triples = {(c, *x) for i, t in text.items() if i not in held for w in [["", "", *words(t)]] for x in zip(w, w[1:], w[2:]) for c in [mark[i]]}
    pair = Counter((c, v, w) for c, _, v, w in triples)
    cont, context, shared = Counter((c, w) for c, _, w in pair), Counter(), Counter(w for _, w in {(v, w) for _, v, w in pair})
    for (c, v, _), n in pair.items():
        context[c, v] += n
    total, d = {c: sum(n for (k, _), n in cont.items() if k == c) for c in (0, 1)}, toxicity.DISCOUNT
    left = {c: sum(max(n - d, 0) for (k, _), n in cont.items() if k == c) / total[c] for c in (0, 1)}
    backoff, types = 1 - (left[0] + left[1]) / 2, sum(shared.values())

    def ratio(v, w):
        if not any(max(cont[c, w] - d, 0) + max((n - d for (k, _, x), n in pair.items() if k == c and x == w), default=0) > 0 for c in (0, 1)):
            return 0.0
        p = []
        for c in (0, 1):
            base = max(cont[c, w] - d, 0) / total[c] + backoff * shared[w] / types
            kept = sum(max(n - d, 0) for (k, x, _), n in pair.items() if (k, x) == (c, v))
            n = context[c, v]
            p.append((1 - kept / n if n else 1) * base + (max(pair[c, v, w] - d, 0) / n if n else 0))
        told = any(cont[c, w] > d for c in (0, 1)) or any(pair[c, v, w] > d for c in (0, 1))
        return math.log(p[1] / p[0]) if told else 0.0

    for i in sorted(text)[:25]:
        w = words(text[i])
        each = [ratio(a, b) for a, b in zip(["", *w], w)]
        best = {}
        for x, r in zip(w, each):
            best[x] = max(r, best.get(x, -math.inf))
        top = sorted(best.values(), reverse=True)[: toxicity.TELLING]
        raw = np.frombuffer(text[i].encode(), np.uint8)
        assert abs(model.evidence(raw, np.array([0, len(raw)]))[0] - (sum(each) / len(each) + sum(top) / len(top))) < 1e-9


def test_toxicity_by_rare_expressions(spark):
    """An expression of a few toxic documents counts, and a word that is as common in both classes doesn't, however much larger one is."""
    rng = np.random.Generator(np.random.PCG64(8))
    rows, truth = [], {}

    def name(stem, n):
        return stem + "".join("abcdefghij"[int(d)] for d in f"{int(rng.integers(n)):02d}")

    for i in range(1500):
        truth[i] = int(i % 10 == 0)
        words = prose(5000 + i, 60).split() + [name("topic", 10) for _ in range(2)]
        if truth[i]:
            words += [name("vile", 30) for _ in range(2)]
        rows.append((i, " ".join(str(w) for w in rng.permutation(words))))
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    found = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("held_out").collect()
    hits = [r.predicted for r in found if truth[r.doc_id]]
    assert sum(hits) >= 0.8 * len(hits) and sum(r.predicted for r in found) - sum(hits) <= 0.03 * len(found)


def test_a_pair_tells_where_its_word_alone_does_not(spark):
    """`grim` stands in all documents, `gutter` after it only and in toxic ones only: one context, but many before the pair."""
    rows, truth = [], {}
    for i in range(600):
        truth[i] = int(i % 5 == 0)
        words = prose(9000 + i, 40).split()
        words[i % 37 + 1 : i % 37 + 1] = ["grim", "gutter"] if truth[i] else ["grim"]
        rows.append((i, " ".join(words)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    held = [(truth[r.doc_id], r.predicted) for r in toxicity.toxicity(df, labels).where("held_out").collect()]
    assert sum(t == p for t, p in held) >= 0.95 * len(held)


def test_toxicity_of_odd_rows(odd_docs, docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert len({r.score for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()}) == 1


def test_suffix_automaton_reads_exactly_the_substrings():
    text = b"abcbcabba"
    step = np.array(language_id.suffix_automaton([c - 97 for c in text], 3)).reshape(-1, 3)

    def reads(s):
        at = 0
        for c in s:
            at = step[at, c - 97]
            if at < 0:
                return False
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(map(reads, subs)) and not any(reads(s) for s in (b"aa", b"cc", b"abcc", b"bac"))


def brute_phrases(text: bytes, reference: bytes) -> int:
    text, reference = (language_id.folded(np.frombuffer(x, np.uint8)).tobytes() for x in (text, reference))
    n = at = 0
    while at < len(text):
        to = at + 1
        while to < len(text) and text[at : to + 1] in reference and text[at:to] in reference:
            to += 1
        n, at = n + 1, to
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    ref = {"a": b"hello there world and others", "b": b"guten tag die welt und mehr " * 60, "c": b"ab" * 900, "d": bytes(rng.choice(b"abc") for _ in range(3000))}
    p = language_id.CrossParser(ref)
    texts = [b"hello world", b"Guten Tag, Welt", b"", b"xyz", b"o" * 600, b"ab" * 1500 + b"x" + b"ba" * 700, b"guten tag die welt und mehr " * 80, bytes(rng.choice(b"abc") for _ in range(7000)), ref["d"][17:2900], b"ab" * 256, b"b" + b"ab" * 256]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = p.phrases(np.frombuffer(b"".join(texts), np.uint8), off)
    assert got.tolist() == [[brute_phrases(t, ref[g]) for g in "abcd"] for t in texts]


def test_learning_and_the_winner(spark):
    """What is learned, and who wins, against plain Python over whole texts."""
    from pyspark.sql import functions as F

    words = {"xx": "lorem dolor amet elit sed magna", "yy": "ekki vera hafa koma fara sjá", "zz": "olla voida tulla mennä nähdä saada"}
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(words[g].split()) for _ in range(rng.choice([3, 30, 6000]) if g != "zz" else 5000)), g) for i, g in enumerate(rng.choice(["xx", "yy", "zz"]) for _ in range(60))]
    rows += [(100 + i, "unus unus unus", "rare") for i in range(9)] + [(200, None, "xx"), (201, "", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.learn(df)
    hashed = {r.text: (r.h, r.p) for r in df.where("text <> ''").select("text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(3), "text").alias("p")).collect()}
    want = {}
    for g in ("xx", "yy", "zz", "rare"):
        mine = sorted({(hashed[t][0], t) for i, t, lang in rows if t and lang == g and zlib.crc32(str(i).encode()) % 3 != 1})
        pieces = []
        for _, t in mine:
            at = hashed[t][1] % max(len(t) - language_id.PIECE_CHARS + 1, 1)
            pieces.append(t[at : at + language_id.PIECE_CHARS].encode() + b" ")
        want[g] = b"".join(pieces)[: language_id.REFERENCE_BYTES]
    assert got == want
    for r in language_id.language_id(df).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        if text:
            cost = {g: brute_phrases(text.encode(), ref) * np.log2(len(ref) + 1) / len(text.encode()) for g, ref in got.items()}
            assert r.lang_pred == min(sorted(cost), key=cost.get) and abs(r.bits - min(cost.values())) < 1e-9
        else:
            assert r.lang_pred == "und"
    assert {r.lang_pred for r in language_id.language_id(df).where("doc_id < 60").collect()} == {"xx", "yy", "zz"}


def test_shares():
    assert language_id.shares({"a": 10, "b": 100}, 1000, 50) == 40 and language_id.shares({"a": 10, "b": 100}, 1000, 500) == 100
    assert language_id.shares({"a": 10, "b": 100, "c": 100}, 60, 1000) == 60


def test_language_accuracy_on_held_out_documents(docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.language_id(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(odd_docs, docs, spark):
    rows = language_id.language_id(odd_docs).collect()
    assert len(rows) == 13 and {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 7)} == {"und"}
    assert language_id.language_id(docs.limit(0)).count() == 0
    unlabelled = odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).na.replace("", None, "lang")
    assert {r.lang_pred for r in language_id.language_id(unlabelled).collect()} == {"und"}
    kept = language_id.determined_rows(odd_docs, language_id.learn(odd_docs))
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 1, 2, 6, 8, 9, 10, 11]
