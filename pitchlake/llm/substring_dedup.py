"""Substring dedup with difference-cover anchors.

Windows are 35 words. The residues {0, 1, 4, 14, 16} modulo 21 are a perfect difference set: for any two
positions some shift of less than 21 brings both onto it. Grams of 15 words are hashed at those positions
only, so any two equal windows share an anchor at the same offset; from there ``repeats`` extends.

Defined results: null texts have no words; fewer than 35 words lose nothing; windows that repeat within
one document count; repeated rows are documents of their own; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitchlake.llm.common import WordHashes, text_chunks
from pitchlake.llm.repeats import Repeats, covered_texts, real_id, removal_mask

#: A perfect difference set and its modulus.
COVER, PERIOD = (0, 1, 4, 14, 16), 21
_hashes = WordHashes()


def word_symbols(data: np.ndarray, bounds: np.ndarray):
    """Word hashes; bytes.split() cuts at exactly [\\x20\\x09-\\x0D]+."""
    raw = data.tobytes()
    rows = [_hashes.array(raw[a:b].split()) for a, b in zip(bounds[:-1], bounds[1:])]
    return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def cover_anchors(symbols: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    place = np.arange(len(grams))
    row = np.searchsorted(bounds, place, "right") - 1
    return place[on[(place - bounds[row]) % PERIOD]]


def spec_for(width: int, hot: int = 20_000) -> Repeats:
    if width < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words at least")
    return Repeats(width, width - PERIOD + 1, word_symbols, cover_anchors, earlier=False, digit=5, hot=hot)


def substring_dedup(docs: DataFrame, width: int = 35, with_text: bool = False, hot: int = 20_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]), one row per document.

    ``hot`` (see ``Repeats``) changes the route of a gram, never the result.
    """
    spec = spec_for(width, hot)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0).to_pylist(), batch.column(2)
            for first, data, bounds in text_chunks(batch.column(1)):
                rows = []
                for i in range(len(bounds) - 1):
                    words = data[bounds[i]:bounds[i + 1]].tobytes().split()
                    found = spans[first + i].values
                    gone = removal_mask(len(words), None if found is None else found.to_numpy(), spec)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
                    rows.append((real_id(ids[first + i]), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if with_text else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])])

    return covered_texts(docs, spec, np.uint64, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
