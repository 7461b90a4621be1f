"""SimHash near-duplicates by the generalised pigeonhole principle (operator 6).

Equal fingerprints are merged first. The 64 bits are grouped, correlated ones together, into m parts, and part i gets a threshold t_i of
at least -1 (not looked at) with sum(t_i + 1) = radius + 1. Two fingerprints within the radius then differ in at most t_i bits of some
part i. The number of parts and the thresholds come from dynamic programming over candidate counts that a bounded sample predicts for
the number of fingerprints at hand. A fingerprint is dealt to one key for each way to leave t_i bits of part i open; fingerprints that
share a key are compared in full, and a key gives only the links of a spanning forest, never all its pairs. Keys with very many
fingerprints are split by the same principle over their other bits. Links become components by alternating star steps.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import free_names, id_text, join_split, map_blocks, materialize, remove_table, within_bound

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints from which correlations and candidate counts are estimated, at most; all fingerprints are joined.
PLAN_SAMPLE = 2048
#: A dealt row costs as much as so many comparisons.
ROW_COST = 200
#: Fingerprints of a key above which it is split, and how often.
SPLIT_ABOVE, SPLIT_DEPTH = 8192, 3
#: Keys of up to so many fingerprints are compared by shifting the sorted rows against themselves.
SHIFT_LIMIT = 256
#: Bytes that a doc_id counts in a broadcast.
ID_BYTES = 16
#: A node with more than this share of all edges is a hub; there are at most 1 / HUB_SHARE.
HUB_SHARE = 0.001
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE = 1 << 20


def _pieces(raw: bytes):
    """Stretches of a long text that end at white space."""
    at = 0
    while at < len(raw):
        to = at + _PIECE
        while to < len(raw) and raw[to] not in b" \t\n\v\f\r":
            to += 1
        yield raw[at:to]
        at = to


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: a bit is 1 if more than half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest as x

    count, n, words = np.zeros(BITS, np.int64), 0, []
    for piece in _pieces(raw.translate(_LOWER)):
        words += piece.split()
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: len(ends) - shingle])]
        h = np.fromiter([x(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64, len(starts))
        for k in range(0, len(h), 1 << 14):
            count += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        words = words[len(words) - shingle + 1 :] if shingle > 1 else []
    if not n:
        if not words:
            return 0
        return x(b" ".join(words), seed)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number) of every row."""

    def make():
        def f(batch, buf, off):
            raw = buf.tobytes()
            fp = np.fromiter((fingerprint(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

        return f

    return map_blocks(id_text(docs, id_col, text_col), make, "doc_id long, fp long")


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """m parts of the bit positions, of nearly equal sizes, each filled with the bits that correlate most with those it has."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(axis=0)
    bits = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    corr = np.abs(bits.T @ bits) / max(1, len(bits))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        part = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.discard(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def _mask(part: list[int]) -> int:
    return sum(1 << b for b in part)


def allocate(parts: list[list[int]], sample: np.ndarray, n: int, radius: int = RADIUS) -> tuple[float, list[int]]:
    """The cheapest thresholds for these parts, and what they cost for n fingerprints, by dynamic programming over the parts."""
    cost: list[dict[int, float]] = []
    for part in parts:
        value = sample & np.uint64(_mask(part))
        hist = np.zeros(BITS + 1)
        for k in range(0, len(value), 256):
            hist += np.bincount(np.bitwise_count(value[k : k + 256, None] ^ value[None, :]).ravel(), minlength=BITS + 1)
        hist[0] -= len(value)
        share = np.cumsum(hist) / max(1, len(value) * (len(value) - 1))
        cost.append({t: 0.0 if t < 0 else n * comb(len(part), t) * ROW_COST + share[t] * n * (n - 1) / 2 for t in range(-1, min(radius, len(part)) + 1)})
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, more in c.items():
                u = used + t + 1
                if u <= radius + 1 and (u not in nxt or total + more < nxt[u][0]):
                    nxt[u] = (total + more, [*chosen, t])
        best = nxt
    return best[radius + 1]


def plan(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Parts with their thresholds for n fingerprints."""
    found = []
    for m in range(2, radius + 2):
        parts = correlated_parts(sample, m)
        total, thresholds = allocate(parts, sample, n, radius)
        found.append((total, m, list(zip(parts, thresholds))))
    return [(p, t) for p, t in min(found, key=lambda x: x[:2])[2] if t >= 0]


def _key_masks(layout: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(tag, bits that a key keeps) for each way to leave a part's threshold of bits open."""
    out = []
    for part, t in layout:
        for opened in combinations(part, t):
            out.append((len(out), _mask([b for b in part if b not in opened])))
    return out


def _mixed(tag: int, value: np.ndarray) -> np.ndarray:
    """A key of its tag and kept bits; keys that collide only meet in one comparison more."""
    with np.errstate(over="ignore"):
        h = value * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tag + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _deal(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(k, fp) rows: each fingerprint under each of its keys."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for tag, keep in masks:
                yield pa.record_batch([pa.array(_mixed(tag, fp & np.uint64(keep)).view(np.int64)), batch.column(0)], ["k", "fp"])

    return fps.select("fp").mapInArrow(run, "k long, fp long")


def _split(rows: DataFrame, depth: int, radius: int) -> DataFrame:
    """Rows of keys that are too large, dealt again under parts of all their bits, with the old key mixed in."""
    shift = 7 * (depth + 1)  # other parts at each depth
    parts = [sorted((b * 5 + shift) % BITS for b in range(i, BITS, radius + 1)) for i in range(radius + 1)]
    masks = [_mask(p) for p in parts]

    def run(batches):
        for batch in batches:
            k, fp = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            for tag, keep in enumerate(masks):
                yield pa.record_batch([pa.array(_mixed(tag, (fp & np.uint64(keep)) ^ _mixed(depth, k)).view(np.int64)), batch.column(1)], ["k", "fp"])

    return rows.mapInArrow(run, "k long, fp long")


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Of links (two columns), those that join what was apart."""
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        while (p := parent.setdefault(a, a)) != a:
            parent[a] = a = parent.setdefault(p, p)
        return a

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(i)
    return pairs[kept]


def _large_group(fp: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest of one key's fingerprints, breadth first: each is compared with those not reached yet."""
    rest, out = np.unique(fp), []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            u = frontier.pop()
            near = np.bitwise_count(rest ^ u) <= radius
            if near.any():
                new = rest[near]
                rest = rest[~near]
                frontier += list(new)
                out.append(np.stack([np.full(len(new), u), new], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _links_of(k: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Links among rows that are sorted by key; every key is whole."""
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    size = np.diff(edge)
    out = [_large_group(fp[a : a + s], radius) for a, s in zip(edge[:-1][size > SHIFT_LIMIT].tolist(), size[size > SHIFT_LIMIT].tolist())]
    left = np.repeat(np.where(size > SHIFT_LIMIT, 0, size), size) - 1 - (np.arange(len(k)) - np.repeat(edge[:-1], size))  # rows after it in its key
    at, by = np.flatnonzero(left > 0), 1
    small = []
    while len(at):
        near = at[np.bitwise_count(fp[at] ^ fp[at + by]) <= radius]
        if len(near):
            small.append(np.stack([fp[near], fp[near + by]], 1))
        by += 1
        at = at[left[at] >= by]
    if small:
        pairs = np.concatenate(small)
        out.append(_forest(pairs[pairs[:, 0] != pairs[:, 1]]))
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """u, v: links among the fingerprints of each key."""

    def run(batches):
        k_left, fp_left = np.empty(0, np.int64), np.empty(0, np.uint64)

        def give(k, fp):
            links = _links_of(k, fp, radius) if len(k) > 1 else np.empty((0, 2), np.uint64)
            if len(links):
                yield pa.record_batch([pa.array(np.ascontiguousarray(links[:, i]).view(np.int64)) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            k = np.concatenate([k_left, batch.column(0).to_numpy()])
            fp = np.concatenate([fp_left, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            yield from give(k[:cut], fp[:cut])
            k_left, fp_left = k[cut:], fp[cut:]
        yield from give(k_left, fp_left)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "k").sortWithinPartitions("k").mapInArrow(run, "u long, v long")


def links(fps: DataFrame, radius: int = RADIUS, *, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """u, v: pairs of distinct fingerprints within the radius; their components are those of all such pairs. `fps` has one column, fp, of distinct values."""
    n = fps.count()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "u long, v long")
    step = max(1, n // PLAN_SAMPLE)
    picked = fps.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).limit(2 * PLAN_SAMPLE).collect()
    sample = np.array([r.fp for r in picked] or [0], np.int64).view(np.uint64)
    rows, found = _deal(fps, _key_masks(plan(sample, n, radius))), None
    for depth in range(SPLIT_DEPTH):
        crowded = rows.groupBy("k").count().where(F.col("count") > split_above).select("k")
        crowded = materialize(crowded, "crowded")
        if crowded.isEmpty():
            break
        small = _linked(rows.join(crowded, "k", "left_anti"), radius)
        found = small if found is None else found.unionByName(small)
        rows = _split(rows.join(crowded, "k", "left_semi").select("k", "fp"), depth, radius)
    rest = _linked(rows, radius)
    return rest if found is None else found.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of `edges` (u long, v long), by alternating star steps.

    A step aggregates the smallest neighbour of each node before it shuffles and joins it back, so that no node's neighbours are
    gathered; hubs are joined by broadcast. Each round is written to the shared folder, and the one before it deleted.
    """
    pairs = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "lowest")
        joined = _join_lowest(both, low)
        large = materialize(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")  # larger neighbours go to the smallest
        remove_table(low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "lowest")
        joined = _join_lowest(large, low)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))  # so do smaller ones, and the node itself
        new = materialize(small.where("u <> v").distinct(), "edges")
        settled = new.count() == pairs.count() and new.join(pairs, ["u", "v"], "left_anti").isEmpty()
        for done in (pairs, large, low):
            remove_table(done)
        pairs = new
        if settled:
            break
    root = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return root.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _join_lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges with each node's smallest neighbour (u, m, n edges): nodes with very many edges, which are few, meet it by broadcast."""
    rows = low.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HUB_SHARE * rows, 64)
    hubs = F.broadcast(low.where(hot).select("u", "m"))
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(low.where(~hot).select("u", "m"), "u"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, *, id_col: str = "doc_id", text_col: str = "text", split_above: int = SPLIT_ABOVE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable by links) of every row.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat stay; null doc_ids are linked, but are no
    component_id unless a component has no other. Columns besides the two named are ignored; an empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(links(classes.select("fp"), radius, split_above=split_above))
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = materialize(joined.join(smallest, "component").select("fp", "component_id"), "component-ids")
    return join_split(marked, by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with its columns, less those whose doc_id is not the smallest of its component.

    Rows that repeat (same doc_id and text) stay once. Rows without a doc_id can't be named and all stay.
    """
    key = F.col(f"`{id_col}`").cast("long")
    gone, twice = free_names(docs.columns, "dropped_id", "repeated_id")
    marked = materialize(near_duplicates(docs, radius, id_col=id_col, text_col=text_col), "marked")
    dropped = marked.where("doc_id > component_id").select("doc_id").distinct()
    kept = docs.join(within_bound(dropped.withColumnRenamed("doc_id", gone), ID_BYTES), key == F.col(gone), "left_anti")
    repeated = materialize(marked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice)), "repeated")
    if repeated.isEmpty():
        return kept
    again = key == F.col(twice)
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates([id_col, text_col]))
