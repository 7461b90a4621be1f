"""Substring deduplication by content-defined chunks (operator 2).

Texts are cut where a gear rolling hash of the last bytes says so, so an insertion moves only the cuts near it. A unit is a chunk with
the chunk after it, known by a 64-bit digest; units overlap, so that a match is long enough to be no chance while its ends are as fine as
the chunks. Of the places where a unit stands, the first (by doc_id, then position) keeps it and the others repeat it. Repeated units that
overlap make a span, and spans of at least `min_bytes` and UNITS units, whose digests must all agree, are removed.

Units are shuffled once, range-sorted by digest and place, so that one that stands in a third of all documents is spread over many
partitions; the first place of a digest that reaches into a partition comes from a table of one row for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.chunking import cuts
from verdictframe.llm.common import BROADCAST_BYTES, SliceHasher, as_signed, free_names, id_text, map_blocks, materialize

#: 2 ** CUT_BITS bytes are the mean length of a chunk; LONGEST is the greatest; MIN_BYTES, UNITS the least that a removed span has.
CUT_BITS, LONGEST, MIN_BYTES, UNITS = 4, 512, 160, 3
#: A span's first and last units have so many bytes, or begin and end with their text: shorter ones may be common by chance.
EDGE = 24
#: In place of a null doc_id, which comes first.
NULL_ID = np.iinfo(np.int64).min
#: Bits of a spot, which is a unit's start, its length and whether its text ends there.
_SIZE_BITS = 12
UNIT_COLUMNS = "doc_id long, tag long, digest array<long>, spot array<long>"
FOUND = "part int, kind int, doc_id long, tag long, spot long, first_doc_id long, first_tag long, first_spot long, low long, high long"
SPANS = "doc_id long, tag long, start long, length long, units long, at long, first_doc_id long, first_start long"
_REPEAT, _LEADING, _SUMMARY = range(3)


def units(docs: DataFrame, *, bits: int = CUT_BITS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag, digest, spot of every unit of every row. A text of one chunk is a unit.

    The tag is 0 where every doc_id stands for one row, and else a hash of the row's text, so that rows which share a doc_id stay apart.
    """
    if 2 * (longest + 3) >= 1 << _SIZE_BITS:
        raise ValueError("longest is too long")
    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NULL_ID))))
    alone = source.groupBy("doc_id").count().where("count > 1").isEmpty()
    tagged = source.select("doc_id", "text", (F.lit(0).cast("long") if alone else F.xxhash64("text")).alias("tag"))

    def make():
        def f(batch, buf, off):
            end = cuts(buf, off, bits, longest)
            begin = np.concatenate([[0], end[:-1]]) if len(end) else end
            row = np.searchsorted(off, begin, side="right") - 1
            final = end == off[row + 1]
            far = end.copy()  # where the next chunk of the row ends
            far[:-1] = np.where(final[:-1], end[:-1], end[1:])
            keep = ~final
            keep[1:] |= final[:-1]  # the last chunk of a row is in the unit before it, unless it is alone
            keep[:1] = True
            begin, far, row = begin[keep], far[keep], row[keep]
            digest = as_signed(SliceHasher(buf).of(begin, far))
            spot = ((begin - off[row]) << (_SIZE_BITS + 1)) | ((far - begin) << 1) | (far == off[row + 1])
            at = np.searchsorted(begin, off).astype(np.int32)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(at), pa.array(v, pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(2), lists(digest), lists(spot)], ["doc_id", "tag", "digest", "spot"])

        return f

    made = map_blocks(tagged, make, UNIT_COLUMNS)
    return made.select("doc_id", "tag", F.explode(F.arrays_zip("digest", "spot")).alias("c")).select("doc_id", "tag", "c.digest", "c.spot")


def _later(batches):
    """From units in the order of digest and place: FOUND rows of those that aren't the first of their digest. Whether that holds for the
    partition's first digest depends on the partitions before it: its units all come, marked, and a summary of the partition last."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    low = high = None
    lead: tuple[int, int, int] | None = None
    first: tuple[int, int, int] = (0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, tag, digest, spot = (batch.column(i).to_numpy() for i in range(4))
        new = np.empty(len(digest), bool)
        new[0] = high is None or digest[0] != high
        new[1:] = digest[1:] != digest[:-1]
        if low is None:
            low, lead = int(digest[0]), (int(doc[0]), int(tag[0]), int(spot[0]))
        # the place of each row's first, from this batch or from the one before
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        carried = at < 0
        first_of = [np.where(carried, f, v[at]) for f, v in zip(first, (doc, tag, spot))]
        leading = digest == low
        keep = leading | (doc != first_of[0]) | (tag != first_of[1]) | (spot != first_of[2])
        high, first = int(digest[-1]), tuple(int(v[-1]) for v in first_of)
        if keep.any():
            n = int(keep.sum())
            none = pa.nulls(n, pa.int64())
            kind = np.where(leading[keep], _LEADING, _REPEAT).astype(np.int32)
            yield pa.record_batch([pa.array(np.full(n, part, np.int32)), pa.array(kind), *(pa.array(v[keep]) for v in (doc, tag, spot, *first_of)), none, none], [c.split()[0] for c in FOUND.split(", ")])
    if low is not None:
        cells = (part, _SUMMARY, *lead, *first, low, high)
        kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 8)
        yield pa.record_batch([pa.array([v], t) for v, t in zip(cells, kinds)], [c.split()[0] for c in FOUND.split(", ")])


def repeated_units(docs: DataFrame, **options) -> DataFrame:
    """doc_id, tag, spot, first_doc_id, first_spot of the units that stand earlier too, in another document or in their own. Rows with the
    same doc_id and text are one place: none of them repeats another."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = units(docs, **options).repartitionByRange(n, "digest", "doc_id", "tag", "spot").sortWithinPartitions("digest", "doc_id", "tag", "spot")
    found = materialize(placed.select("doc_id", "tag", "digest", "spot").mapInArrow(_later, FOUND), "repeated-units")
    # one row for each partition: where its first digest stands first of all
    leads, before = [], None
    for r in sorted(found.where(F.col("kind") == _SUMMARY).collect(), key=lambda r: r.part):
        own = (r.doc_id, r.tag, r.spot)
        lead = before[1] if before is not None and before[0] == r.low else own
        leads.append((r.part, *lead))
        before = (r.high, lead if r.low == r.high else (r.first_doc_id, r.first_tag, r.first_spot))
    side = F.broadcast(spark.createDataFrame(leads, "part int, l_doc long, l_tag long, l_spot long"))
    # every row meets its partition's row, so as many come out as went in, less each lead itself
    led = F.col("kind") == _LEADING
    placed = found.where(F.col("kind") != _SUMMARY).join(side, "part").where(~led | F.expr("not (doc_id = l_doc and tag = l_tag and spot = l_spot)"))
    first = lambda own, lead: F.when(led, F.col(lead)).otherwise(F.col(own)).alias(own)
    return placed.select("doc_id", "tag", "spot", first("first_doc_id", "l_doc"), first("first_spot", "l_spot"))


def repeated_spans(docs: DataFrame, *, min_bytes: int = MIN_BYTES, **options) -> DataFrame:
    """One row for each span to remove: doc_id, tag, start, length (bytes), units, and at, first_doc_id, first_start: where its longest
    unit stands, here and first.

    Null and empty texts have no chunks; rows with the same doc_id and text are one place; null doc_ids come before all others; a text of
    any length has its units in order in one partition, which holds no more of them than a run of repeats has.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    later = repeated_units(docs, **options)

    def spans(doc, tag, spot, fdoc, fspot):
        """Spans among rows in the order of doc_id, tag and spot, whose runs are whole."""
        start, length, final = spot >> (_SIZE_BITS + 1), (spot >> 1) & ((1 << _SIZE_BITS) - 1), (spot & 1).astype(bool)
        end = start + length
        new = np.ones(len(start), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] >= end[:-1])
        head = np.flatnonzero(new)
        i = np.arange(len(start))
        edge = (length >= EDGE) | (start == 0) | final
        first = np.minimum.reduceat(np.where(edge, i, len(i)), head)
        last = np.maximum.reduceat(np.where(edge, i, -1), head)
        some = last >= 0
        first, last = first[some], last[some]
        keep = (end[last] - start[first] >= min_bytes) & ((last - first + 1 >= UNITS) | ((start[first] == 0) & final[last]))
        first, last = first[keep], last[keep]
        run_of = np.cumsum(new) - 1
        best = np.lexsort((i, -length, run_of))[head][run_of[first]]  # the longest unit of each run, the first of several
        ids = lambda v: pa.array(v, mask=v == NULL_ID)
        columns = [ids(doc[first]), *(pa.array(v) for v in (tag[first], start[first], end[last] - start[first], last - first + 1, start[best])), ids(fdoc[best]), pa.array(fspot[best] >> (_SIZE_BITS + 1))]
        return pa.record_batch(columns, [c.split()[0] for c in SPANS.split(", ")])

    def run(batches):
        held = [np.empty(0, np.int64)] * 5
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(5)]
            rows = [np.concatenate([h, x]) for h, x in zip(held, new)]
            if not len(rows[0]):
                continue
            same = np.zeros(len(rows[0]), bool)  # a place that came twice, for rows that repeat
            same[1:] = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1]) & (rows[2][1:] == rows[2][:-1])
            doc, tag, spot = (x[~same] for x in rows[:3])
            rows = [x[~same] for x in rows]
            start, end = spot >> (_SIZE_BITS + 1), (spot >> (_SIZE_BITS + 1)) + ((spot >> 1) & ((1 << _SIZE_BITS) - 1))
            edge = np.flatnonzero((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] >= end[:-1]))
            cut = int(edge[-1]) + 1 if len(edge) else 0  # the last run may go on
            if cut:
                yield spans(*(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
        if len(held[0]):
            yield spans(*held)

    ordered = later.repartition(n, "doc_id", "tag").sortWithinPartitions("doc_id", "tag", "spot")
    return ordered.select("doc_id", "tag", "spot", "first_doc_id", "first_spot").mapInArrow(run, SPANS)


#: Bytes that a span counts in a broadcast.
SPAN_BYTES = 40


def remove_repeats(docs: DataFrame, *, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = True, length_col: str | None = None, **options) -> DataFrame:
    """`docs` with its columns, less the repeated spans of its texts; rows of which nothing but white space is left go if `drop_empty`.

    Texts without repeated spans stay byte for byte, nulls and texts that were empty before too. `length_col`, if given, gets the
    length of the new text. Columns of any name are kept.
    """
    spans = materialize(repeated_spans(docs, min_bytes=min_bytes, id_col=id_col, text_col=text_col, **options), "spans")
    cut_id, cut_tag, cut_spans, is_cut, new = free_names(docs.columns, "cut_id", "cut_tag", "cut_spans", "is_cut", "new_text")
    per = spans.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias(cut_spans)).withColumnsRenamed({"doc_id": cut_id, "tag": cut_tag})
    side = materialize(per.withColumn(is_cut, F.lit(True)), "spans")
    small = spans.count() * SPAN_BYTES <= BROADCAST_BYTES
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(cut_id)) & ((F.col(cut_tag) == 0) | (F.col(cut_tag) == F.xxhash64(text.cast("string"))))
    joined = docs.join(F.broadcast(side) if small else side, same, "left")
    # what lies between the spans, cut from the bytes of the text
    raw = F.encode(text, "utf-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut_spans, lambda s: s["start"] + s["length"]))
    ends = F.concat(F.transform(cut_spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.decode(F.substring(raw, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")), "utf-8"))
    untouched = F.col(is_cut).isNull()
    out = joined.withColumn(new, F.when(untouched, text).otherwise(F.array_join(kept, "")))
    if drop_empty:
        out = out.where(untouched | F.col(new).rlike(r"\S"))
    own = lambda c: F.col(f"`{c}`")
    columns = [F.col(new).alias(c) if c == text_col else F.when(untouched, own(c)).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c) if c == length_col else own(c) for c in docs.columns]
    return out.select(*columns)
