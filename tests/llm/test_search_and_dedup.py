"""Top-k, SimHash and substring deduplication against brute force."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from verdictframe.llm import chunking, simhash, substring_dedup, topk
from tests.llm.conftest import prose


def brute_top(ids, vectors, k, every):
    out = []
    for i, q in enumerate(ids):
        if q % every == 0:
            s = vectors @ vectors[i]
            rest = [j for j in np.lexsort((ids, -s)) if j != i][:k]
            out += [(int(q), n, int(ids[j]), int(s[j])) for n, j in enumerate(rest, 1)]
    return sorted(out)


def test_top_k_is_exact(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS_ROWS", 16)  # many pivots and annuli on few rows
    monkeypatch.setattr(topk, "SEED_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK", 20)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = df.toPandas()
    v = np.floor(64 * np.stack(p.embedding.values).astype(float)).astype(np.int64)
    got = sorted(tuple(r) for r in topk.nearest_of_every(df, 20, 20).collect())
    assert got == brute_top(p.vec_id.values, v, 20, 20)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.5], "z"), (1, [1.0, 0.5], "z"), (2, [1.0, 0.5], "z"), (3, None, "z"), (4, [None, 1.0], "z"), (5, [float("nan"), 0.0], "z"), (6, [float("inf"), 0.0], "z"), (7, [-2.0, 0.0], "z"), (20, [0.0, 0.0], "z"), (9, [1.0], "z"), (None, [1.0, 1.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dist string")
    got = sorted(tuple(r) for r in topk.nearest_of_every(df, 3, 20).collect())
    ids = np.array([0, 1, 2, 7, 20])
    v = np.floor(64 * np.array([[1, 0.5], [1, 0.5], [1, 0.5], [-2, 0], [0, 0]])).astype(np.int64)
    assert got == brute_top(ids, v, 3, 20)
    assert topk.nearest_of_every(df.limit(0)).count() == 0 and topk.nearest_of_every(df.where("vec_id = 20")).count() == 0


def test_top_k_of_several_lengths_and_shared_ids(spark):
    """Each length for itself, rows that share an id each for itself, components of any size; a vector too long for 64 bits takes no part."""
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(int(i), rng.integers(-3, 4, d).astype(float).tolist()) for d in (0, 1, 3, 700) for i in rng.choice([0, 1, 20, 21, 40, 41], 9)] + [(20, [3e7, 4.0, -2e6]), (5, [-1e7, 2.5e7, 9.0]), (60, [1e300, 1.0, 1.0]), (60, [-1e18, 0.0, 0.0])]
    got = sorted(tuple(r) for r in topk.nearest_of_every(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 20).collect())
    want = []
    for d in (0, 1, 3, 700):
        mine = [(i, v) for i, v in rows if len(v) == d and max(map(abs, v), default=0) < 1e17]
        want += brute_top(np.array([i for i, _ in mine]), np.floor(64 * np.array([v for _, v in mine])).astype(np.int64).reshape(len(mine), d), 5, 20)
    assert got == sorted(want)


def test_a_vector_of_many_rows(spark, monkeypatch):
    """Ties go to the smaller id, and what a task gives doesn't grow with the copies."""
    for name, value in (("ANNULUS_ROWS", 16), ("SEED_ROWS", 40), ("BLOCK", 16), ("SLOT_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.Generator(np.random.PCG64(4))
    v = [[1.0, 2.0, -1.0] if i % 2 else rng.normal(size=3).round(2).tolist() for i in range(600)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.nearest_of_every(df, 20, 20).collect())
    assert got == brute_top(np.arange(600), np.floor(64 * np.array(v)).astype(np.int64), 20, 20)


def brute_fingerprint(text) -> int:
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: list[int], ids: list[int], radius: int = 4) -> list[int]:
    label = list(range(len(fps)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            label[find(int(j))] = find(i)
    roots = [find(i) for i in range(len(f))]
    return [min(ids[j] for j in range(len(f)) if roots[j] == roots[i]) for i in range(len(f))]


def test_fingerprints_and_components(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in ids] == brute_components(fps, ids)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = prose(5, 3000)
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_PIECE", 97)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


@pytest.mark.parametrize("split_above", [3, 8192])
def test_links_of_dense_groups(spark, split_above):
    rng = np.random.Generator(np.random.PCG64(3))
    base = rng.integers(0, 1 << 63, 6, dtype=np.int64).view(np.uint64)
    fps = {int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(60)} | {int(x) for x in rng.integers(0, 1 << 63, 200)}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    pairs = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), split_above=split_above)).collect()
    root = {r.node: r.component for r in pairs}
    want = brute_components(fps, list(range(len(fps))))
    label = [root.get(s, s) for (s,) in signed]
    assert len(set(zip(want, label))) == len(set(want)) == len(set(label))


def test_plan_covers_the_radius():
    rng = np.random.Generator(np.random.PCG64(1))
    sample = rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64)
    for n in (10, 10**5, 10**8):
        layout = simhash.plan(sample, n)
        assert sum(t + 1 for _, t in layout) == 5
    assert sorted(b for p in simhash.correlated_parts(sample, 3) for b in p) == list(range(64))


def test_simhash_of_odd_rows(odd_docs, docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 13 and {r.fingerprint for r in rows if r.doc_id in (3, 4, 5)} == {"0" * 16} and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7, 8, 9, 10, 11] and kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


def brute_chunks(text: bytes):
    """Cuts by the hash of each window on its own."""
    g, w, bits = chunking.GEAR, chunking.WINDOW, substring_dedup.CUT_BITS
    out, begin = [], 0
    ends = set()
    for i in range(w, len(text) + 1):
        h = 0
        for b in text[i - w : i]:
            h = (h << 1) + int(g[b])
        if h >> (w - bits) & ((1 << bits) - 1) == 0:
            j = i
            while j < len(text) and text[j] & 0xC0 == 0x80:
                j += 1
            ends.add(j)
    for e in sorted(ends | {len(text)}):
        while e - begin > substring_dedup.LONGEST:
            j = begin + substring_dedup.LONGEST
            while text[j] & 0xC0 == 0x80:
                j += 1
            out.append((begin, j))
            begin = j
        if e > begin:
            out.append((begin, e))
        begin = e
    return out


def brute_spans(texts: dict[int, str]):
    seen, spans = {}, []
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        chunks = brute_chunks(raw)
        units = [(a, b) for (a, _), (_, b) in zip(chunks, chunks[1:])] or chunks
        run = []
        for a, b in [*units, (len(raw) + 1, len(raw) + 2)]:
            repeated = b <= len(raw) and seen.setdefault(raw[a:b], (i, a)) != (i, a)
            if not repeated or (run and a >= run[-1][1]):
                short = lambda c: c[1] - c[0] < substring_dedup.EDGE and c[0] > 0 and c[1] < len(raw)  # noqa: B023, E731
                while run and short(run[0]):
                    run.pop(0)
                while run and short(run[-1]):
                    run.pop()
                if run and run[-1][1] - run[0][0] >= substring_dedup.MIN_BYTES and (len(run) >= substring_dedup.UNITS or (run[0][0], run[-1][1]) == (0, len(raw))):
                    spans.append((i, run[0][0], run[-1][1] - run[0][0]))
                run = []
            if repeated:
                run.append((a, b))
    return sorted(spans)


@pytest.mark.parametrize("parts", [1, 4, 61])
def test_repeated_spans(spark, docs, texts, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check_spans(docs, texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def check_spans(docs, texts):
    short = {i: t for i, t in texts.items() if len(t) < 4000}
    part = docs.where("length(text) < 4000")
    got = substring_dedup.repeated_spans(part).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in got) == brute_spans(short)
    for r in got:
        n = substring_dedup.EDGE
        assert texts[r.doc_id].encode()[r.at :][:n] == texts[r.first_doc_id].encode()[r.first_start :][:n] and r.start <= r.at < r.start + r.length


def test_shared_passages_are_found_after_insertions(spark):
    passage = " ".join(f"w{i}x{i * 7 % 13}" for i in range(60))
    rows = [(i, prose(100 + i, 40 + i) + " " + passage + " " + prose(200 + i, 30)) for i in range(1, 6)] + [(9, prose(300, 80) + "unique")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in substring_dedup.repeated_spans(df).collect()} == {2, 3, 4, 5}
    kept = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    assert kept[1] == rows[0][1] and kept[9] == rows[-1][1] and all(len(kept[i]) < len(rows[i - 1][1]) - 200 for i in (2, 3, 4, 5))


def test_most_of_a_passage_of_51_words_is_found(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passages = [text(51) for _ in range(200)]
    rows = [(2 * i + k, f"{text(rng.randint(20, 90))} {p} {text(30)}") for i, p in enumerate(passages) for k in (0, 1)]
    found = {}
    for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id // 2] = found.get(r.doc_id // 2, 0) + r.length
    assert sum(len(p) - found.get(i, 0) > 100 for i, p in enumerate(passages)) <= 20 and len(found) >= 198


def test_a_unit_of_many_rows_reaches_over_partitions(spark):
    line = prose(900, 70)
    rows = [(i, line if i % 3 else prose(1000 + i, 50) + line) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    try:
        got = sorted((r.doc_id, r.start, r.length) for r in substring_dedup.repeated_spans(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute_spans(dict(rows)) and {i for i, _, _ in got} == set(range(2, 400))


def test_repeats_of_a_common_unit_grow_in_proportion(spark):
    line, made = prose(901, 70), {}
    for n in (50, 100, 200):
        df = spark.createDataFrame([(i, prose(2000 + i, 4) + " " + line) for i in range(n)], "doc_id long, text string").repartition(8)
        spark.conf.set("spark.sql.shuffle.partitions", 37)
        try:
            later = substring_dedup.repeated_units(df)
            rows = later.collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        made[n] = len(rows)
        assert len({(r.doc_id, r.spot) for r in rows}) == len(rows) and all((r.first_doc_id, r.first_spot) < (r.doc_id, r.spot) for r in rows)
        # repeats that a partition begins with go through the same join as the rest, and the table is read once
        plan = later._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "Union" not in plan and plan.count("parquet") == 1
    assert made[200] - made[100] <= 2.2 * (made[100] - made[50])


def test_rows_that_share_a_doc_id_are_cut_each_for_itself(spark):
    a, b, c = prose(500, 60), prose(501, 60), prose(502, 60)
    rows = [(1, a + " " + b), (2, c), (2, b + " " + c), (2, b + " " + c), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.repeated_spans(df).collect()
    kept = [(r.doc_id, r.text) for r in substring_dedup.remove_repeats(df).collect()]
    assert len({r.tag for r in spans}) >= 1 and (None, a) in kept and len(kept) == 5
    for i, t in kept:
        assert any(i == j and (t == u or len(t) < len(u)) for j, u in rows)


def test_removal_of_odd_rows(odd_docs, docs):
    kept = substring_dedup.remove_repeats(odd_docs, length_col="n_chars")
    assert kept.columns == odd_docs.columns
    by = {r.doc_id: r for r in kept.collect()}
    assert 2 not in by and by[3].text is None and by[4].text == "" and by[9].text.startswith("Ünïcode") and all(r.text is None or r.n_chars == len(r.text) for r in by.values())
    assert substring_dedup.repeated_spans(docs.limit(0)).count() == 0 and substring_dedup.remove_repeats(docs.limit(0)).count() == 0
