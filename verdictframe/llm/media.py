"""Media columns as chunks that are stored once (operator 7).

A payload is stored without loss as the samples of an 8-bit mono WAV file. The file's bytes are cut by a rolling gear hash, and its
media column is the ordered list of its chunks' digests. Digests are deduplicated by Spark joins: of the places where a chunk stands,
the first owns it. The store has a row for each distinct file, with its chunk list and the bytes of the chunks that it owns; chunks
that another file owns are fetched by digest when the file is put together again. What is read back is verified against the file's
SHA-256 before anything is computed from it.

Only digests, and the bytes of chunks that several files share, are shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.chunking import cuts
from verdictframe.llm.common import fresh_path, id_text, join_split, map_blocks, materialize, within_bound

#: 2 ** CUT_BITS bytes are the mean length of a chunk and LONGEST the greatest.
CUT_BITS, LONGEST = 12, 32768
#: Payloads are padded to a multiple of so many bytes.
UNIT = 64
RATE = 8000
HEADER = 44
#: Bytes that a file's entry counts in a broadcast besides its digests, and how many such bytes are broadcast.
ENTRY_BYTES, BROADCAST_BYTES = 120, 64 << 20
#: Bytes that a digest counts in a broadcast.
DIGEST_BYTES = 24
STORE = "media_id string, n_bytes long, digests array<binary>, data array<binary>"
FEATURES = "media_id string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def wav_header(n: int) -> bytes:
    """The 44 bytes before n samples of 8-bit mono PCM."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def to_media(payload: bytes) -> bytes:
    """The payload, padded with zero bytes to a positive multiple of UNIT, as a WAV file."""
    n = max(UNIT, -(-len(payload) // UNIT) * UNIT)
    return wav_header(n) + payload + bytes(n - len(payload))


def samples(media: bytes) -> bytes:
    """The samples of a file that to_media made."""
    n = struct.unpack_from("<I", media, HEADER - 4)[0]
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or len(media) != HEADER + n:
        raise ValueError("not a stored media file")
    return media[HEADER:]


def feature(payload: bytes) -> str:
    """Mean, root mean square about it, crossings of the mean, and shares of 8 bands of sample values."""
    x = np.frombuffer(payload, np.uint8)
    total, n = int(x.sum(dtype=np.int64)), len(x)
    square = int((x.astype(np.int64) ** 2).sum())
    above = x.astype(np.int64) * n > total
    bands = np.bincount(x >> 5, minlength=8)
    return f"mean={total / n:.4f};rms={max(0.0, square / n - (total / n) ** 2) ** 0.5:.4f};crossings={int((above[1:] != above[:-1]).sum())};bands=" + ",".join(map(str, bands.tolist()))


def _split(media: bytes, bits: int = CUT_BITS) -> list[bytes]:
    buf = np.frombuffer(media, np.uint8)
    ends = cuts(buf, np.array([0, len(buf)]), bits, LONGEST).tolist()
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunk_lists(docs: DataFrame, *, bits: int = CUT_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (a hash of the text), media_id (the file's SHA-256), n_bytes and digests (in order) of every row."""

    def make():
        def f(batch, buf, off):
            raw, ids, lists = buf.tobytes(), [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                media = to_media(raw[a:b])
                ids.append(hashlib.sha256(media).hexdigest())
                lists.append([_digest(c) for c in _split(media, bits)])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(ids), pa.array(np.diff(off)), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "tag", "media_id", "n_bytes", "digests"])

        return f

    return map_blocks(_tagged(docs, id_col, text_col), make, "doc_id long, tag long, media_id string, n_bytes long, digests array<binary>")


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))


def _describe(media_id: str, media: bytes) -> tuple:
    if hashlib.sha256(media).hexdigest() != media_id:
        raise ValueError(f"media {media_id} was not read back whole")
    payload = samples(media)
    return media_id, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), feature(payload)


def store_media(docs: DataFrame, *, bits: int = CUT_BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, store): the media column of every row (doc_id, media_id, n_bytes), and the written store (STORE).

    Of the files with the same bytes one is stored. `data` holds a file's chunks in order, null where another file owns the chunk.
    """
    listed = materialize(chunk_lists(docs, bits=bits, id_col=id_col, text_col=text_col), "chunk-lists")
    files = materialize(listed.groupBy("media_id").agg(F.min(F.struct("doc_id", "tag")).alias("owner"), F.count(F.lit(1)).alias("n"), F.min("digests").alias("digests")), "media-files")
    # rows whose file another row stores, and chunks that another file owns
    copies = files.where("n > 1").select("media_id", F.col("owner.doc_id").alias("owner_doc"), F.col("owner.tag").alias("owner_tag"))
    copied = join_split(listed.select("doc_id", "tag", "media_id"), copies, "media_id").where("not (doc_id <=> owner_doc and tag = owner_tag)")
    skip = materialize(copied.select("doc_id", "tag", "media_id", F.lit(True).alias("skip"), F.lit(None).cast("array<binary>").alias("borrowed")).distinct(), "media-skip")
    each = materialize(files.select("media_id", F.explode(F.array_distinct("digests")).alias("digest")), "media-digests")
    shared = materialize(each.groupBy("digest").agg(F.min("media_id").alias("lender"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "lender"), "media-shared")
    lend = join_split(each, shared, "digest").where("media_id <> lender").groupBy("media_id").agg(F.collect_list("digest").alias("borrowed"))
    owners = files.select("media_id", F.col("owner.doc_id").alias("doc_id"), F.col("owner.tag").alias("tag"))
    lend = materialize(lend.join(owners, "media_id").select("doc_id", "tag", "media_id", F.lit(False).alias("skip"), "borrowed"), "media-lend")

    # entries by row: the file that it must not store, or the chunks of it; several only where different texts share doc_id and hash
    entries = skip.unionByName(lend).groupBy(F.col("doc_id").alias("entry_doc"), F.col("tag").alias("entry_tag")).agg(F.collect_list(F.struct("media_id", "skip", "borrowed")).alias("entry"))
    entries = materialize(entries, "media-entries")
    size = entries.agg(F.sum(F.aggregate("entry", F.lit(0).cast("long"), lambda n, e: n + ENTRY_BYTES + DIGEST_BYTES * F.greatest(F.size(e["borrowed"]), F.lit(0))))).first()[0] or 0
    same = F.col("doc_id").eqNullSafe(F.col("entry_doc")) & (F.col("tag") == F.col("entry_tag"))
    source = _tagged(docs, id_col, text_col).join(F.broadcast(entries) if size <= BROADCAST_BYTES else entries, same, "left").select("doc_id", "text", "entry")

    def make():
        def f(batch, buf, off):
            raw = buf.tobytes()
            out: list[list] = [[], [], [], []]
            for a, b, entry in zip(off[:-1].tolist(), off[1:].tolist(), batch.column(2).to_pylist()):
                media = to_media(raw[a:b])
                name = hashlib.sha256(media).hexdigest()
                mine = [e for e in entry or [] if e["media_id"] == name]
                if any(e["skip"] for e in mine):
                    continue
                others = {d for e in mine for d in e["borrowed"] or []}
                parts = _split(media, bits)
                digests = [_digest(c) for c in parts]
                for column, value in zip(out, (name, b - a, digests, [None if d in others else c for d, c in zip(digests, parts)])):
                    column.append(value)
            if out[0]:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())))], ["media_id", "n_bytes", "digests", "data"])

        return f

    spark = docs.sparkSession
    path = fresh_path(spark, "media-store")
    map_blocks(source, make, STORE).write.option("compression", "zstd").parquet(path)
    return listed.select("doc_id", "media_id", "n_bytes"), spark.read.schema(STORE).parquet(path)


def read_media(store: DataFrame) -> DataFrame:
    """The distinct files of a store, put together again, verified and described (FEATURES)."""

    def whole(batches):
        for batch in batches:
            rows = [_describe(name, b"".join(parts)) for name, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([pa.array(v) for v in zip(*rows)], ["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]) if rows else None

    def run(batches):
        return (b for b in whole(batches) if b is not None)

    complete = store.where(~F.exists("data", lambda c: c.isNull())).select("media_id", "data")
    # files that borrow: their chunks by digest, joined with the owners' bytes, in order again
    partial = store.where(F.exists("data", lambda c: c.isNull()))
    pieces = partial.select("media_id", F.posexplode(F.arrays_zip("digests", "data")).alias("at", "c")).select("media_id", "at", F.col("c.digests").alias("digest"), F.col("c.data").alias("data"))
    lacking = materialize(pieces.where("data is null").select("media_id", "at", "digest"), "media-lacking")
    asked = lacking.select("digest").distinct()
    owned = store.select(F.explode(F.arrays_zip("digests", "data")).alias("c")).where("c.data is not null").select(F.col("c.digests").alias("digest"), F.col("c.data").alias("data"))
    lent = materialize(owned.join(within_bound(asked, DIGEST_BYTES), "digest", "left_semi").groupBy("digest").agg(F.min("data").alias("data")), "media-lent")
    filled = pieces.where("data is not null").select("media_id", "at", "data").unionByName(join_split(lacking, lent, "digest").select("media_id", "at", "data"))
    mended = filled.groupBy("media_id").agg(F.array_sort(F.collect_set(F.struct("at", "data"))).alias("c")).select("media_id", F.col("c.data").alias("data"))
    return complete.mapInArrow(run, FEATURES).unionByName(mended.mapInArrow(run, FEATURES)).dropDuplicates(["media_id"])


def media_features(docs: DataFrame, *, bits: int = CUT_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every row, from what the
    store gives back. Null and empty texts are payloads of 64 zero bytes; equal texts share a file; rows that repeat stay; an empty
    table gives no rows; columns besides the two named are ignored."""
    listed, store = store_media(docs, bits=bits, id_col=id_col, text_col=text_col)
    return join_split(listed, materialize(read_media(store), "media-features"), "media_id").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("media_id").alias("media_sha256"), "feature")
