"""Token ids as flat unsigned integer files, memory-mapped on reading.

A part holds a range of documents in ascending order, as three flat little-endian files:

    part-XXXXX.ids      unsigned integers, the ids of all its documents in turn
    part-XXXXX.offsets  unsigned 64-bit, where each document begins, counted in ids, and the end
    part-XXXXX.docs     signed 64-bit document ids; the least such number stands for null

The index, a small table with one row per part, adds each part's base: the ids and
documents of all parts before it, by prefix sums of the parts' totals. Document d of a
part therefore begins at base + offsets[d] of the whole corpus.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapeforge.llm.common import slices
from tapeforge.llm.tokens import encoder
from tapeforge.session import cut_lineage

PART_BYTES = 64 << 20  # text per part, on average
NO_ID = -(1 << 63)
INDEX = "part int, file string, n_docs long, n_ids long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _writer(folder: str, tokenizer: str, end_id: int, width: int):
    """Write a partition's rows, which come sorted. Every attempt has file names of its own; only the names that a
    finished task returns get into the index, so a lost or repeated attempt leaves nothing but unused files."""

    def run(batches):
        store, at = _open(folder)
        store.create_dir(at, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}"
        docs = ids = 0
        end = np.array([end_id], "<u4").tobytes()
        with (store.open_output_stream(f"{at}/{name}.ids") as f_ids,
              store.open_output_stream(f"{at}/{name}.offsets") as f_offsets,
              store.open_output_stream(f"{at}/{name}.docs") as f_docs):
            for b in slices(batches):
                encoded = [e + end for e in encoder(tokenizer, True).encode_batch(b.column(1).to_pylist())]
                sizes = np.array([len(e) // 4 for e in encoded], np.uint64)
                f_offsets.write((ids + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
                f_docs.write(b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                raw = b"".join(encoded)
                f_ids.write(raw if width == 4 else np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes())
                docs, ids = docs + b.num_rows, ids + int(sizes.sum())
            f_offsets.write(np.array([ids], "<u8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([ids], pa.int64())],
            ["part", "file", "n_docs", "n_ids"])

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, width: int | None = None, parts: int | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the index (part, file, width, n_docs, n_ids, base, doc_base).

    ``width`` is 2 or 4 bytes per id, by default the least that holds the vocabulary. Null and empty texts are the
    end id alone. Rows that repeat a doc_id follow each other, by text; rows with a null doc_id come first and are
    read back as null. An empty table gives an index without documents.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES), rows.sparkSession.sparkContext.defaultParallelism * 4)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    largest = max(end_id, *encoder(tokenizer, True).tokenizer.get_vocab(with_added_tokens=True).values())
    if width is None:
        width = 2 if largest < 1 << 16 else 4
    if largest >> 8 * width:
        raise ValueError(f"ids up to {largest} don't fit into {width} bytes")
    written = ordered.mapInArrow(_writer(folder, tokenizer, end_id, width), INDEX)
    index = cut_lineage(written.withColumn("width", F.lit(width)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return cut_lineage(index.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n)
                                           for c, n in (("n_ids", "base"), ("n_docs", "doc_base"))]))


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as numbers: memory-mapped where the store is the machine's own file system, else read as one buffer."""
    if store.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that the index names."""

    def run(batches):
        store, at = _open(folder)
        for b in batches:
            for r in b.to_pylist():
                ids = _mapped(store, f"{at}/{r['file']}.ids", f"<u{r['width']}")
                offsets = _mapped(store, f"{at}/{r['file']}.offsets", "<u8")
                names = _mapped(store, f"{at}/{r['file']}.docs", "<i8")
                for i in range(0, len(names), 4096):
                    cuts = offsets[i:i + 4097].astype(np.int64)
                    crc = [zlib.crc32(ids[a:z].astype("<u4", copy=False)) for a, z in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[i:i + 4096].astype(np.int64), mask=names[i:i + 4096] == NO_ID), pa.array(cuts[:-1] + r["base"]),
                         pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, min(index.count(), 4096))
    return index.repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
