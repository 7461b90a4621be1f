"""Exact top-k inner products by a pivot-distance index (operator 1).

Vectors of whole numbers get one coordinate more, which lifts all of them onto a sphere of the longest one's length; the largest inner
products are then the smallest distances to the query. Each vector is keyed by its nearest pivot and the distance to it, and each
pivot's distances are cut into annuli, packed as blocks of bounded size. A query first expands the annuli that may lie nearest, until
they hold enough vectors; the k-th best score found bounds its radius, and by the triangle inequality only annuli whose distances come
within that radius of its own distance to their pivot are searched. Queries travel in groups to the blocks that they need; the blocks of
an annulus with many are dealt to several slots. A task keeps the k best rows of each query that it meets, and gives them at its end.

The pivots come from a bounded sample; every vector is indexed, and the results are exact for any choice of pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.common import bound_batches, materialize

#: Vectors from which pivots are chosen, at most about so many.
PIVOT_SAMPLE = 8192
#: Pivots and annuli of each, at most; both grow with the root of the number of rows. Rows that an annulus has at least where the table has them.
PIVOTS, ANNULI, ANNULUS_ROWS = 256, 64, 1024
#: Vectors of a block, queries of a group, blocks of a slot, and vectors that a query's first annuli hold at least.
BLOCK, GROUP, SLOT_BLOCKS, SEED_ROWS = 2048, 256, 16, 1024
#: Queries whose best rows a task holds; beyond it they are given early.
HELD = 100_000
#: Squared lengths reach this bound no more, so that every inner product is a 64-bit number.
LARGEST = 1 << 62


def whole_numbers(vectors: DataFrame, scale: int = 64, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row (a number of its own), vec_id, dims, v (64-bit little-endian numbers floor(scale * x)) and norm (squared) of the rows that take
    part: those with a vec_id whose vector is not null, has no null and no non-finite component, and is shorter than the root of LARGEST."""
    raw = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    raw = raw.where("vec_id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('inf'))")

    def run(batches):
        for batch in batches:
            x = batch.column(2)
            sizes = x.value_lengths().to_numpy()
            flat = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False))
            at = np.concatenate([[0], np.cumsum(sizes)])
            with np.errstate(over="ignore"):
                length = np.concatenate([[0.0], flat * flat])
            fits = np.array([length[a + 1 : b + 1].sum() < LARGEST for a, b in zip(at[:-1].tolist(), at[1:].tolist())], bool)
            flat[np.repeat(~fits, sizes)] = 0
            v = [flat[a:b].astype("<i8") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([int((r * r).sum()) for r in v], pa.int64())]
            yield pa.record_batch(columns, ["row", "vec_id", "dims", "v", "norm"]).filter(pa.array(fits, pa.bool_()))

    return raw.mapInArrow(run, "row long, vec_id long, dims int, v binary, norm long")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), dims)


class Pivots:
    """Pivots on the sphere of squared radius `top`, and distances to them."""

    def __init__(self, sample: np.ndarray, top: int, count: int) -> None:
        self.top = float(top)
        lifted = self.lift(sample)
        chosen = [0]
        far = ((lifted - lifted[0]) ** 2).sum(axis=1)
        while len(chosen) < min(count, len(lifted)) and far.max() > 0:  # the farthest from those chosen
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
        center = lifted[chosen]
        for _ in range(5):  # then to the middle of what is nearest
            near = self._distances(lifted, center).argmin(axis=1)
            center = np.stack([lifted[near == i].mean(axis=0) if (near == i).any() else center[i] for i in range(len(center))])
        self.center = center

    def lift(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        return np.concatenate([v, np.sqrt(np.maximum(0.0, self.top - (v * v).sum(axis=1)))[:, None]], axis=1)

    @staticmethod
    def _distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (center * center).sum(axis=1)[None, :] - 2 * x @ center.T))

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        return self._distances(self.lift(v), self.center)

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        return self._distances(np.concatenate([v.astype(float), np.zeros((len(v), 1))], axis=1), self.center)


class Annuli:
    """Bounds (cell, low, high) and row counts of all annuli; at most PIVOTS * ANNULI."""

    def __init__(self, edges: list[list[float]]) -> None:
        self.edges = edges  # for each cell, the inner bounds
        self.first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
        self.cell = np.repeat(np.arange(len(edges)), np.diff(self.first))
        self.low = np.concatenate([[0.0, *e] for e in edges])
        self.high = np.concatenate([[*e, np.inf] for e in edges])
        self.count = np.zeros(len(self.cell), np.int64)

    def of(self, cell: np.ndarray, dist: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), np.int64)
        for c in np.unique(cell).tolist():
            pick = cell == c
            out[pick] = self.first[c] + np.searchsorted(self.edges[c], dist[pick], side="right")
        return out

    def reach(self, to_pivots: np.ndarray) -> np.ndarray:
        """For each query (first axis) and annulus the least distance that the triangle inequality allows."""
        d = to_pivots[:, self.cell]
        return np.maximum(0.0, np.maximum(self.low - d, d - self.high))


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score and then rising id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= least)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _products(q: np.ndarray, v: np.ndarray, top: int) -> np.ndarray:
    """Inner products, exact: by floating point where no partial sum can leave its whole numbers."""
    return (q.astype(float) @ v.astype(float).T).astype(np.int64) if top < 1 << 52 else q @ v.T


def top_k(vectors: DataFrame, queries: DataFrame, dims: int, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query the k other rows of `vectors` with the largest inner products, ties to the
    smaller vec_id. Both tables are as whole_numbers writes them, of `dims` components; a query's own row is that with its number. Rows
    that share a vec_id are candidates and queries each for itself. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    schema = "query_id long, rank int, vec_id long, score long"
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).first()
    if not stats.n:
        return spark.createDataFrame([], schema)
    n, top = stats.n, int(max(stats.top, queries.agg(F.max("norm")).first()[0] or 0))
    step = max(1, n // PIVOT_SAMPLE)
    picked = vectors.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).limit(2 * PIVOT_SAMPLE).select("row", "v").collect() or vectors.limit(1).select("row", "v").collect()
    sample = np.stack([np.frombuffer(r.v, "<i8") for r in sorted(picked, key=lambda r: r.row)])
    pivots = Pivots(sample, top, int(np.clip(min(n // (4 * ANNULUS_ROWS), 2 * n**0.5), 1, PIVOTS)))
    near = pivots.of_vectors(sample)
    cell, dist = near.argmin(axis=1), near.min(axis=1)
    edges = []
    for c in range(len(pivots.center)):
        own = np.sort(dist[cell == c])
        parts = int(np.clip(len(own) * n / len(sample) // ANNULUS_ROWS, 1, ANNULI))
        edges.append(sorted({float(own[len(own) * i // parts]) for i in range(1, parts)}))
    annuli = Annuli(edges)
    slack, seed_rows = 1e-6 * (1 + np.sqrt(top)), SEED_ROWS

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                near = pivots.of_vectors(_matrix(batch.column(2), dims))
                cell, dist = near.argmin(axis=1), near.min(axis=1)
                yield pa.record_batch([*batch.columns, pa.array(annuli.of(cell, dist)), pa.array(dist)], ["row", "vec_id", "v", "annulus", "dist"])

    def packed(size: int, tag: str):
        """Consecutive rows of an annulus as one row: annulus, block (unique), n, rows, ids, v."""

        def run(batches):
            from pyspark import TaskContext

            part, made = TaskContext.get().partitionId(), 0
            held: list[pa.RecordBatch] = []
            rows = 0

            def give(final: bool):
                nonlocal held, rows, made
                table = pa.Table.from_batches(held).combine_chunks()
                a = table.column("annulus").to_numpy()
                cut = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
                bounds = [(x, min(x + size, e)) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()) for x in range(s, e, size)]
                if not final and bounds[-1][1] - bounds[-1][0] < size:
                    held, bounds = table.slice(bounds[-1][0]).to_batches(), bounds[:-1]
                else:
                    held = []
                rows = sum(b.num_rows for b in held)
                own, ids, v = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), table.column("v").to_pylist()
                if bounds:
                    out = [(int(a[s]), (part << 40) + made + i, e - s, own[s:e].astype("<i8").tobytes(), ids[s:e].astype("<i8").tobytes(), b"".join(v[s:e])) for i, (s, e) in enumerate(bounds)]
                    made += len(out)
                    yield pa.record_batch([pa.array(c) for c in zip(*out)], ["annulus", tag, "n", "rows", "ids", "v"])

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    rows += batch.num_rows
                    if rows >= 4 * size:
                        yield from give(False)
            if rows:
                yield from give(True)

        return run

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_schema = "row long, vec_id long, v binary, annulus long, dist double"
    block_schema = "annulus long, {} long, n long, rows binary, ids binary, v binary"

    def index(df: DataFrame, size: int, tag: str) -> DataFrame:
        order = ("annulus", "dist", "vec_id", "row")
        ranged = df.select("row", "vec_id", "v").mapInArrow(keyed, key_schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        return materialize(ranged.mapInArrow(packed(size, tag), block_schema.format(tag)), tag)

    blocks = index(vectors, BLOCK, "block")
    slots = np.ones(len(annuli.cell), np.int64)
    for r in blocks.groupBy("annulus").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).collect():  # at most PIVOTS * ANNULI rows
        annuli.count[r.annulus], slots[r.annulus] = r.n, -(-r.blocks // SLOT_BLOCKS)
    dealt = spark.createDataFrame([(a, s) for a, s in enumerate(slots.tolist())], "annulus long, slots long")
    blocks = blocks.join(F.broadcast(dealt), "annulus").select("annulus", F.pmod(F.xxhash64("block"), F.col("slots")).alias("slot"), "rows", "ids", "v")
    groups = index(queries, GROUP, "grp").select("grp", F.col("rows").alias("qrows"), F.col("ids").alias("qids"), F.col("v").alias("qv"))
    none = np.iinfo(np.int64).min

    def route(bounded: bool):
        """Rows for the slots of the annuli that some query of a group needs, with just these queries and their k-th best so far."""

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    qrows, qids = np.frombuffer(r["qrows"], "<i8"), np.frombuffer(r["qids"], "<i8")
                    q = np.frombuffer(r["qv"], "<i8").reshape(len(qids), dims)
                    reach = annuli.reach(pivots.of_queries(q))
                    least, least_id = np.full(len(qids), none), np.full(len(qids), none)
                    if bounded:
                        known = {b["q"]: (b["score"], b["vec_id"]) for b in r["bounds"]}
                        least, least_id = (np.array([known.get(x, (none, none))[i] for x in qrows.tolist()], np.int64) for i in (0, 1))
                        radius = np.sqrt(np.maximum(0.0, (q.astype(float) ** 2).sum(axis=1) + top - 2.0 * least)) + slack
                        radius[least == none] = np.inf
                        need = (reach <= radius[:, None]) & (annuli.count > 0)
                    else:  # nearest first, until enough vectors lie in them
                        order = np.argsort(reach, axis=1, kind="stable")
                        held = np.cumsum(annuli.count[order], axis=1)
                        take = np.concatenate([np.ones((len(q), 1), bool), held[:, :-1] < seed_rows], axis=1)
                        need = np.zeros_like(take)
                        np.put_along_axis(need, order, take, axis=1)
                        need &= annuli.count > 0
                    for a in np.flatnonzero(need.any(axis=0)).tolist():
                        pick = need[:, a]
                        cells = [x[pick].tobytes() for x in (qrows, qids, q, least, least_id)]
                        for slot in range(int(slots[a])):
                            yield pa.record_batch([pa.array([x]) for x in (a, slot, *cells)], ["annulus", "slot", "qrows", "qids", "qv", "least", "least_id"])

        return run

    def search(batches):
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # for each query its id, and scores and vec_ids of the best so far

        def give():
            rows = [(q, i, ids, score) for q, (i, score, ids) in held.items() if len(ids)]
            held.clear()
            if rows:
                size = [len(r[2]) for r in rows]
                columns = [np.repeat([r[0] for r in rows], size), np.repeat([r[1] for r in rows], size), np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["q", "query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                qrows, qids, least, least_id, rows, ids = (np.frombuffer(r[c], "<i8") for c in ("qrows", "qids", "least", "least_id", "rows", "ids"))
                least, least_id = least.copy(), least_id.copy()
                if len(held) > HELD:
                    yield from give()
                for i, x in enumerate(qrows.tolist()):  # what this task has already bounds a query too
                    mine = held.get(x)
                    if mine is not None and len(mine[1]) == k and (mine[1][-1], -mine[2][-1]) > (least[i], -least_id[i]):
                        least[i], least_id[i] = mine[1][-1], mine[2][-1]
                q, v = np.frombuffer(r["qv"], "<i8").reshape(len(qids), dims), np.frombuffer(r["v"], "<i8").reshape(len(ids), dims)
                score = _products(q, v, top)
                for i in np.flatnonzero((score >= least[:, None]).any(axis=1)).tolist():
                    fit = np.flatnonzero((score[i] > least[i]) | ((score[i] == least[i]) & (ids <= least_id[i])))
                    fit = fit[rows[fit] != qrows[i]]
                    _, s, d = held.get(int(qrows[i]), (0, np.empty(0, np.int64), np.empty(0, np.int64)))
                    s, d = np.concatenate([s, score[i][fit]]), np.concatenate([d, ids[fit]])
                    best = _top(s, d, k)
                    held[int(qrows[i])] = (int(qids[i]), s[best], d[best])
        yield from give()

    def searched(routed: DataFrame) -> DataFrame:
        joined = routed.join(blocks, ["annulus", "slot"]).select("qrows", "qids", "qv", "least", "least_id", "rows", "ids", "v")
        return joined.mapInArrow(search, "q long, query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    routed_schema = "annulus long, slot long, qrows binary, qids binary, qv binary, least binary, least_id binary"
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    bound = materialize(searched(groups.mapInArrow(route(False), routed_schema)).where(F.col("rank") == k).select("q", "score", "vec_id"), "bounds")
    members = groups.select("grp", "qrows").mapInArrow(_members, "grp long, q long").join(bound, "q")
    known = members.groupBy("grp").agg(F.collect_list(F.struct("q", "score", "vec_id")).alias("bounds"))  # GROUP entries at most
    empty = F.array().cast("array<struct<q:long,score:long,vec_id:long>>")
    known = groups.join(known, "grp", "left").select("qrows", "qids", "qv", F.coalesce("bounds", empty).alias("bounds"))
    return searched(known.mapInArrow(route(True), routed_schema)).select("query_id", "rank", "vec_id", "score")


def _members(batches):
    for batch in batches:
        for r in batch.to_pylist():
            rows = np.frombuffer(r["qrows"], "<i8")
            yield pa.record_batch([pa.array(np.full(len(rows), r["grp"])), pa.array(rows.astype(np.int64))], ["grp", "q"])


def nearest_of_every(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """top_k with the rows whose id is divisible by `every` as queries, against all rows of as many components: others have no inner
    product with them. Tables hold vectors of few lengths; each is searched for itself. Vectors of any length are taken, also of none."""
    made = materialize(whole_numbers(vectors, scale, id_col=id_col, vector_col=vector_col), "vectors")
    asked = F.pmod("vec_id", F.lit(every)) == 0
    out = None
    for r in made.groupBy("dims").agg(F.count_if(asked).alias("queries")).where("queries > 0").sort("dims").collect():
        mine = made.where(F.col("dims") == r.dims)
        found = top_k(mine, mine.where(asked), r.dims, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else made.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
