"""Suffix-array dedup: bytes covered by a 50-byte string that a smaller document has too are removed.

Method: a depth-limited radix sort. Sorting the suffixes at every byte would shuffle several times the
corpus, so the first pass (the most significant digit, a gram of 16 bytes) sorts a sparse set of suffixes:
the window minimizers, of which equal 50-byte windows have the same at the same offset. Groups of one are
dropped; what is left is refined by further digits down to depth 50 and no deeper, see ``repeats``.
Equal groups at that depth are exactly the repeated windows.

Defined results: null texts are empty; a text of fewer than 50 bytes loses nothing; repeats within one
document only, and repeated rows of one id, lose nothing; a null id is smaller than any other; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitchlake.llm.repeats import Repeats, covered_texts, real_id, removal_mask
from pitchlake.llm.common import text_chunks


def _sliding(values: np.ndarray, n: int, pick) -> np.ndarray:
    """Least or greatest of every n consecutive values, by doubling."""
    size = 1
    while size * 2 <= n:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:len(values) - (n - size)], values[n - size:]) if size < n else values


def minimizers(width: int, gram: int):
    """Positions whose gram hash is the least in some window of ``width`` symbols within a row."""
    n = width - gram + 1

    def anchors(symbols: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(grams) < n:
            return np.zeros(0, np.int64)
        least = _sliding(grams, n, np.minimum)
        inside = np.zeros(len(least) + 1, np.int8)
        starts, ends = bounds[:-1], bounds[1:] - width + 1
        ok = ends > starts
        inside[starts[ok]] += 1
        inside[ends[ok]] -= 1
        least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))
        padded = np.zeros(len(least) + 2 * (n - 1), np.uint64)
        padded[n - 1:n - 1 + len(least)] = least
        return np.flatnonzero(_sliding(padded, n, np.maximum) == grams)

    return anchors


def byte_symbols(data: np.ndarray, bounds: np.ndarray):
    return data, bounds


def spec_for(width: int, gram: int, hot: int = 20_000) -> Repeats:
    return Repeats(width, gram, byte_symbols, minimizers(width, gram), earlier=True, digit=8, hot=hot)


def suffix_dedup(docs: DataFrame, width: int = 50, gram: int = 16, with_text: bool = False, hot: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per document; ``kept`` is binary.

    ``hot`` (see ``Repeats``) changes the route of a gram, never the result.
    """
    spec = spec_for(width, gram, hot)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0).to_pylist(), batch.column(2)
            for first, data, bounds in text_chunks(batch.column(1)):
                rows = []
                for i in range(len(bounds) - 1):
                    own = data[bounds[i]:bounds[i + 1]]
                    found = spans[first + i].values
                    gone = removal_mask(len(own), None if found is None else found.to_numpy(), spec)
                    kept = own[~gone].tobytes()
                    n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    rows.append((real_id(ids[first + i]), len(own), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return covered_texts(docs, spec, np.uint8, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
