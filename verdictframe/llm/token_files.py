"""Token ids as flat binary files with 64-bit document offsets (operator 9).

A range of documents, in ascending doc_id order, makes one shard of three files in a store that all executors reach:

    <shard>.bin   the ids of its documents one after the other, unsigned little-endian, 16 bits if every id fits, else 32
    <shard>.off   unsigned 64-bit little-endian: where each document starts among the shard's ids, and their number
    <shard>.doc   signed 64-bit little-endian: the doc_id of each document (the smallest number stands for null)

The first id of a shard within the whole corpus is the prefix sum of the counts of the shards before it; the shard table carries it.
Readers map the files into memory and touch only the documents they need.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import fresh_path, id_text, map_blocks, open_store
from verdictframe.llm.pretoken import ENCODE_BYTES, encoder

NULL_ID = np.iinfo(np.int64).min
SHARDS = "shard long, name string, bits int, documents long, tokens long, base long"
#: Documents of a record batch that a reader returns.
READ_ROWS = 8192


def id_bits(tokenizer_path: str, *extra_ids: int) -> int:
    from tokenizers import Tokenizer

    return 16 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), *(i + 1 for i in extra_ids)) <= 1 << 16 else 32


def write_token_files(docs: DataFrame, tokenizer_path: str, *, uri: str | None = None, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write the files below `uri` (a new folder of the shared one, if none is given); return it with the table of shards.

    Null texts are empty: their document is the end id alone. Null doc_ids come first. Rows with the same doc_id are ordered by
    a hash of their text; rows that repeat are documents of their own. Columns besides the two named are ignored. A shard that a
    second attempt writes again has another name, and the table names the one that counts. The table has a row for each shard, as
    many as `shards` or spark.sql.shuffle.partitions says, so that the driver can add them up.
    """
    spark = docs.sparkSession
    uri = uri or fresh_path(spark, "tokens")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = id_bits(tokenizer_path, end_id)

    def make():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        e = encoder(tokenizer_path)
        store, folder = open_store(uri)
        store.create_dir(folder, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex[:12]}"
        files = {kind: store.open_output_stream(f"{folder}/{name}.{kind}") for kind in ("bin", "off", "doc")}
        done = [0, 0]  # documents, tokens

        def f(batch, buf, off):
            ids, at = e.encode(buf, off)
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            files["bin"].write(ids.astype(f"<u{bits // 8}").tobytes())
            files["off"].write((at[:-1] + done[1]).astype("<u8").tobytes())
            files["doc"].write(batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            done[0] += len(at) - 1
            done[1] += len(ids)
            return ()

        def last():
            files["off"].write(np.array([done[1]], "<u8").tobytes())
            for x in files.values():
                x.close()
            yield pa.record_batch([pa.array([v]) for v in (part, name, bits, done[0], done[1], 0)], ["shard", "name", "bits", "documents", "tokens", "base"])

        return f, last

    source = id_text(docs, id_col, text_col)
    ordered = source.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = sorted((r.shard, r.name, r.bits, r.documents, r.tokens) for r in map_blocks(ordered, make, SHARDS, limit=ENCODE_BYTES, keep="encoder").collect())
    base, table = 0, []
    for r in rows:
        table.append((*r, base))
        base += r[-1]
    store, folder = open_store(uri)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/shards.json") as out:
        out.write(json.dumps([dict(zip(("shard", "name", "bits", "documents", "tokens", "base"), r)) for r in table]).encode())
    return uri, spark.createDataFrame(table, SHARDS)


def open_shard(uri: str, name: str, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids, offsets and doc_ids of a shard, mapped into memory where the store is a local one."""
    store, folder = open_store(uri)
    out = []
    for kind, dtype in (("bin", f"<u{bits // 8}"), ("off", "<u8"), ("doc", "<i8")):
        with store.open_input_file(f"{folder}/{name}.{kind}") as f:
            out.append(np.frombuffer(f.read_buffer(), dtype))
    return out[0], out[1].astype(np.int64), out[2]


def read_token_files(uri: str, shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, off, doc = open_shard(uri, r["name"], r["bits"])
                for a in range(0, len(doc), READ_ROWS):
                    b = min(a + READ_ROWS, len(doc))
                    part = ids[off[a] : off[b]].astype("<u4")
                    view, at = memoryview(part).cast("B"), (off[a : b + 1] - off[a]) * 4
                    crc = [zlib.crc32(view[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.record_batch(
                        [pa.array(doc[a:b].astype(np.int64), mask=doc[a:b] == NULL_ID), pa.array(off[a:b] + r["base"]), pa.array(np.diff(off[a : b + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, shards.count())
    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
