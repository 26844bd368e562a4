"""Line dedup by sorted ranges of line hashes; the result is a compressed bitmap of kept lines per document.

A line's key is the line without white space at both ends, A-Z in lower case. Keys of ``least_chars`` code
points at least go as 128-bit hashes with document and position into ranges of (hash, document), sorted
within by hash, document from the largest down, position. One pass streams over a range: the first document
of a hash is the one that keeps its lines, all later ones lose theirs once ``least_docs`` documents were seen.
At most ``least_docs - 1`` documents of a hash are held back until then. A hash that many documents share is
cut into several ranges by its documents; what a range can't decide (its first hash, and its last unless
decided) is settled by a table of at most two rows a range, which is broadcast.

Defined results: null and empty texts have one empty line; rows with one id count as one document, null ids
as one document smaller than any other; a document that keeps a key keeps all its lines of that key;
repeated rows have equal bitmaps; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import materialise, n_tasks, text_chunks
from pitchlake.llm.repeats import NO_ID, real_id

LINE = "hi long, lo long, doc_id long, text_key long, line int"
DROPPED, OPEN, GROUP = 0, 1, 2


def line_hashes(least_chars: int):
    """(hash, document, text, line) of each line whose key is long enough."""

    def long_enough(key: bytes) -> bool:
        return len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode()) >= least_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, data, bounds in text_chunks(batch.column(2)):
                low, digests, rows, places = data.tobytes().lower(), [], [], []
                for i in range(len(bounds) - 1):
                    for at, line in enumerate(low[bounds[i]:bounds[i + 1]].split(b"\n")):
                        line = line.strip()  # of bytes: exactly [\x20\x09-\x0D]
                        if long_enough(line):
                            digests.append(xxhash.xxh3_128_digest(line))
                            rows.append(first + i)
                            places.append(at)
                halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids[rows]), pa.array(texts[rows]), pa.array(places, pa.int32())],
                    names=["hi", "lo", "doc_id", "text_key", "line"],
                )

    return run


def stream_first(least_docs: int):
    """One pass over a sorted range: rows that go, rows that it can't decide, and how the hashes at its ends stand."""

    def table(columns: np.ndarray, kind: int, n_docs: int = 0) -> pa.RecordBatch:
        n = columns.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), *[pa.array(c) for c in columns[:4]], pa.array(columns[4].astype(np.int32)), pa.array(np.full(n, n_docs, np.int64))],
            names=["kind", "hi", "lo", "doc_id", "text_key", "line", "n_docs"],
        )

    def group_row(hi: int, lo: int, top: int, n_docs: int) -> pa.RecordBatch:
        return table(np.array([[hi], [lo], [top], [0], [0]], np.int64), GROUP, n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)  # all rows of the last hash, while it has too few documents
        key = top = last = None  # or the last hash, whose rows are out, its first and its latest document
        seen, at_start = 0, True  # its documents; the range's first hash may have begun before the range
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            hi, lo, doc = rows[:3]
            goes_on = key == (hi[0], lo[0])
            if key is not None and not goes_on and at_start:
                yield group_row(*key, top, seen)
                at_start = False
            fresh = np.concatenate(([not goes_on], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            new_doc = fresh | np.concatenate(([not goes_on or doc[0] != last], doc[1:] != doc[:-1]))
            group = np.cumsum(fresh) - int(fresh[0])
            tops = doc[fresh] if fresh[0] else np.concatenate(([top], doc[fresh]))
            n_docs = np.bincount(group, new_doc).astype(np.int64)
            if goes_on:
                n_docs[0] += seen
            full = n_docs >= least_docs
            goes = full[group] & (doc != tops[group])
            if at_start:
                goes &= group > 0
                yield table(rows[:, group == 0], OPEN)
                if group[-1] > 0:
                    yield group_row(hi[0], lo[0], tops[0], n_docs[0])
                    at_start = False
            yield table(rows[:, goes], DROPPED)
            if full[-1] or at_start:
                held, key, top, last, seen = held[:, :0], (hi[-1], lo[-1]), tops[-1], doc[-1], n_docs[-1]
            else:
                held, key = rows[:, group == group[-1]], None
        if held.shape[1]:
            yield table(held, OPEN)
            yield group_row(*held[:3, 0], len(np.unique(held[2])))
        elif key is not None:
            yield group_row(*key, top, seen)

    return run


def pack(lines: np.ndarray) -> bytes:
    """A compressed bitmap with a zero for each line that goes; lines beyond its end stay."""
    bits = np.ones((int(lines.max()) // 8 + 1) * 8, np.uint8)
    bits[lines] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of a document's lines stay."""
    keep = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        keep[:len(bits)] = bits
    return keep


def _id(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(NO_ID)).alias("doc_id")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def keep_bitmaps(docs: DataFrame, least_docs: int = 5, least_chars: int = 40) -> DataFrame:
    """(doc_id, text_key, n_dropped, keep) of the documents that lose lines; ``text_key`` is ``xxhash64(text)``."""
    spark = docs.sparkSession
    texts = docs.select(_id("doc_id"), F.xxhash64(_text("text")).alias("text_key"), _text("text").alias("text"))
    lines = materialise(texts.mapInArrow(line_hashes(least_chars), LINE), "lines")
    ranges = lines.repartitionByRange(n_tasks(spark), "hi", "lo", F.desc("doc_id"))
    ordered = ranges.sortWithinPartitions("hi", "lo", F.desc("doc_id"), "line")
    marked = materialise(ordered.mapInArrow(stream_first(least_docs), f"kind byte, {LINE}, n_docs long"), "marked")
    ends = marked.where(F.col("kind") == GROUP).groupBy("hi", "lo").agg(F.max("doc_id").alias("top"), F.sum("n_docs").alias("docs"))
    # two rows a range at most
    unsure = marked.where(F.col("kind") == OPEN).join(F.broadcast(ends.where(F.col("docs") >= least_docs)), ["hi", "lo"]).where("doc_id <> top")
    gone = marked.where(F.col("kind") == DROPPED).select("doc_id", "text_key", "line").unionByName(unsure.select("doc_id", "text_key", "line"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x.values.to_numpy() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in lists], pa.int64()), pa.array([pack(x) for x in lists], pa.binary())],
                names=["doc_id", "text_key", "n_dropped", "keep"],
            )

    # a document's own lines, once however often its row is repeated
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines")).mapInArrow(encode, "doc_id long, text_key long, n_dropped long, keep binary")


def line_dedup(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, with_text: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, kept]), one row per row of ``docs``: the bitmaps applied to the texts."""
    bitmaps = keep_bitmaps(docs, least_docs, least_chars)
    texts = docs.select(_id("doc_id"), F.xxhash64(_text("text")).alias("text_key"), _text("text").alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, bitmap in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                kept = text.as_py().encode()
                n = kept.count(b"\n") + 1
                keep = unpack(bitmap, n)
                if bitmap:
                    lines = kept.split(b"\n")
                    kept = b"\n".join([lines[i] for i in np.flatnonzero(keep)])
                rows.append((real_id(doc), n, n - int(keep.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if with_text else [])]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", *(["kept"] if with_text else [])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_text
    return texts.join(bitmaps, ["doc_id", "text_key"], "left").select("doc_id", "text", "keep").mapInArrow(apply, schema)
