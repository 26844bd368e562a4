"""Windows that repeat across a corpus, found from sampled anchors: the part that suffix and substring dedup share.

A text is a row of symbols (bytes or word hashes) and a window is ``width`` consecutive symbols of one
document. Both operators sample anchor positions so that any two equal windows hold equal grams of
``gram`` symbols at the same offset at least once. Then:

1. ``_sample``: each task packs its anchors by bucket of the gram's hash, as (gram, context, document, key,
   position). The context reaches ``width - gram`` symbols to either side: all windows through the anchor
   lie in it. Anchors with equal contexts within a task are settled there, so that a passage which a third
   of all documents share sends one entry a task and not one a document.
2. ``_settle``: in each bucket equal contexts are settled; grams with several contexts are left over.
3. ``_contexts`` and ``_refine``: only left-over anchors send their context; a depth-limited radix sort
   (``repeated_windows``: groups of one are dropped after each digit) leaves the groups of equal windows.
4. A gram with more than ``hot`` open contexts isn't refined in one place: its anchors send the hashes of all
   windows through them instead, which spread over the buckets; equal windows within a task are settled there.
5. The covered intervals of each document are collected and handed to a function over its text.

Buckets grow in number with the corpus, so that one holds a bounded share of it.

Ids may be null or repeated, so places are kept by id and key: a 64-bit hash of the text, or 0 for ids that one row
has. Rows that agree in both are equal and have the same places; the id alone only says which document is smaller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import BASE, gram_hashes, materialise, mix, n_tasks, text_chunks

#: Stands for a null id: smaller than any other.
NO_ID = -(1 << 63)
#: Entries that a task gathers before it sends them.
GATHER = 1_000_000
BUCKET_BYTES = 4 << 20
#: Repeated ids that may be listed in an expression.
FEW = 1000
COVERED, OPEN, HOT = 0, 1, 2
#: Rows of the second shuffle: contexts to refine, windows to compare, windows that their own task has settled.
CONTEXTS, WINDOWS, SETTLED = 0, 1, 2
EDGE_A, EDGE_B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Repeats:
    """What to look for.

    width: symbols of a window; gram: symbols of an anchor's gram. symbols: (bytes, row bounds) to
    (symbols, row bounds). anchors: (symbols, gram hashes, row bounds) to anchor positions.
    earlier: a window counts where a smaller document id has it too; otherwise where it starts anywhere else too.
    digit: symbols of one radix digit. hot: open contexts beyond which a gram is split by windows.
    """

    width: int
    gram: int
    symbols: Callable
    anchors: Callable
    earlier: bool
    digit: int
    hot: int = 20_000

    @property
    def margin(self) -> int:
        return self.width - self.gram


def context_matrix(symbols: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, spec: Repeats) -> np.ndarray:
    """Symbols around each position, 0 where the document has ended; real symbols count from 1."""
    m, span = spec.margin, spec.gram + 2 * spec.margin
    where = at[:, None] + np.arange(-m, spec.gram + m)
    inside = (np.arange(span) >= (m - left)[:, None]) & (np.arange(span) < (m + spec.gram + right)[:, None])
    out = symbols[np.clip(where, 0, len(symbols) - 1)].astype(np.uint64) + np.uint64(1)
    out[~inside] = 0
    return out


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, BASE, np.uint64))[::-1]


def _anchors(symbols: np.ndarray, bounds: np.ndarray, spec: Repeats):
    """Anchor positions in a run of rows, with the hash of gram and context, row and position in it."""
    long_enough = np.diff(bounds) >= spec.width
    if not long_enough.any():
        return None
    grams = mix(gram_hashes(symbols, spec.gram))
    at = spec.anchors(symbols, grams, bounds)
    row = np.searchsorted(bounds, at, "right") - 1
    keep = long_enough[row] & (at + spec.gram <= bounds[row + 1])
    at, row = at[keep], row[keep]
    if not len(at):
        return None
    m, span = spec.margin, spec.gram + 2 * spec.margin
    left = np.minimum(m, at - bounds[row])
    right = np.minimum(m, bounds[row + 1] - at - spec.gram)
    whole = (left == m) & (right == m)
    context = np.empty(len(at), np.uint64)
    context[whole] = gram_hashes(symbols, span)[at[whole] - m] if whole.any() else 0
    edge = np.flatnonzero(~whole)
    powers = _powers(span)
    for i in range(0, len(edge), 20_000):
        e = edge[i:i + 20_000]
        matrix = context_matrix(symbols, at[e], left[e], right[e], spec)
        context[e] = (matrix * powers).sum(axis=1) + left[e].astype(np.uint64) * EDGE_A + right[e].astype(np.uint64) * EDGE_B
    return grams[at], mix(context), row, at - bounds[row]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _group_first(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[np.flatnonzero(new)][np.cumsum(new) - 1]


def planes(values: np.ndarray) -> bytes:
    """The first byte of all values, then the second: ids and positions differ in few of them, which compresses."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def _equal_contexts(gram, context, doc, key, pos, spec: Repeats):
    """Sorts the entries; marks those settled as covered by an equal context, and those that speak for their context."""
    order = np.lexsort((pos, doc, context, gram))
    gram, context, doc, key, pos = (x[order] for x in (gram, context, doc, key, pos))
    new = _firsts(gram, context)
    if spec.earlier:
        speaks = doc == _group_first(new, doc)
        covered = ~speaks
    else:
        sizes = np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]
        covered, speaks = sizes > 1, new
    return gram, context, doc, key, pos, covered, speaks


def _packed(spec: Repeats, n_buckets: int, gram, context, doc, key, pos) -> Iterator[tuple]:
    """(bucket, gram, context, doc, key, pos, settled): entries as bytes, those that an equal one settles apart from the rest."""
    gram, context, doc, key, pos, covered, speaks = _equal_contexts(gram, context, doc, key, pos, spec)
    bucket = (gram >> np.uint64(32)) % np.uint64(n_buckets)

    def packed(x, gram, context, settled: bool) -> tuple:
        # half of the gram's hash will do: the bucket holds the rest of it, and what is left over is compared by symbols
        return int(bucket[x[0]]), gram.astype(np.uint32).tobytes(), context.tobytes(), planes(doc[x]), planes(key[x]), planes(pos[x].astype(np.uint32)), settled

    local = np.flatnonzero(covered)
    for i in range(0, len(local), 50_000):
        yield packed(local[i:i + 50_000], gram[:0], context[:0], True)
    sent = np.flatnonzero(speaks)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    cuts = np.flatnonzero(_firsts(bucket[sent])) if len(sent) else []
    for x in np.split(sent, cuts[1:]) if len(sent) else []:
        x = x[np.lexsort((pos[x], key[x], doc[x]))]  # neighbours in a text stay together, which compresses
        yield packed(x, gram[x], context[x], False)


def _sample(spec: Repeats, n_buckets: int):
    out_type = pa.schema([("bucket", pa.int32()), ("gram", pa.binary()), ("context", pa.binary()), ("doc", pa.binary()), ("key", pa.binary()), ("pos", pa.binary()), ("settled", pa.bool_())])

    def send(parts: list) -> pa.RecordBatch:
        rows = _packed(spec, n_buckets, *(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out_type.types)], schema=out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for first, data, bounds in text_chunks(batch.column(2), 1 << 18):
                symbols, bounds = spec.symbols(data, bounds)
                found = _anchors(symbols, bounds, spec)
                if found is not None:
                    gram, context, row, pos = found
                    parts.append((gram, context, ids[first + row], keys[first + row], pos))
                    n += len(gram)
                if n >= GATHER:
                    yield send(parts)
                    parts, n = [], 0
        if n:
            yield send(parts)

    return run, "bucket int, gram binary, context binary, doc binary, key binary, pos binary, settled boolean"


def _settle(spec: Repeats):
    out_type = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("kind", pa.int8())])

    def run(table: pa.Table) -> pa.Table:
        parts, done = [], []
        for gram, context, doc, key, pos, settled in zip(*(table.column(c).to_pylist() for c in ("gram", "context", "doc", "key", "pos", "settled"))):
            doc, key, pos = from_planes(doc, np.int64), from_planes(key, np.int64), from_planes(pos, np.uint32)
            if settled:
                done.append((doc, key, pos))
            else:
                parts.append((np.frombuffer(gram, np.uint32), np.frombuffer(context, np.uint64), doc, key, pos))
        out = [(d, k, p, np.zeros(len(d), np.int8)) for d, k, p in done]
        if parts:
            gram, context, doc, key, pos, covered, speaks = _equal_contexts(*(np.concatenate(x) for x in zip(*parts)), spec)
            out.append((doc[covered], key[covered], pos[covered], np.full(covered.sum(), COVERED, np.int8)))
            new_gram, new_context = _firsts(gram), _firsts(gram, context)
            group = np.cumsum(new_gram) - 1
            n_contexts = np.bincount(group, new_context)[group]
            left = (n_contexts > 1) & speaks
            out.append((doc[left], key[left], pos[left], np.where(n_contexts[left] > spec.hot, HOT, OPEN).astype(np.int8)))
        doc, key, pos, kind = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((pos, key, doc))
        doc, key, pos, kind = doc[order], key[order], pos[order], kind[order]
        return pa.table([pa.array(doc), pa.array(key), pa.array(pos.astype(np.int32)), pa.array(kind)], schema=out_type)

    return run, "doc_id long, key long, pos int, kind byte"


def _windows_of(symbols, bounds, row, pos, spec: Repeats):
    """Two hashes, row and start of every window through anchors at ``pos``, each start once."""
    at = np.repeat(bounds[row] + pos, spec.margin + 1)
    start = at - np.tile(np.arange(spec.margin + 1), len(pos))
    row = np.repeat(row, spec.margin + 1)
    fits = (start >= bounds[row]) & (start + spec.width <= bounds[row + 1])
    start = np.unique(start[fits])
    row = np.searchsorted(bounds, start, "right") - 1
    one, other = gram_hashes(symbols, spec.width)[start], gram_hashes(mix(symbols.astype(np.uint64) ^ EDGE_A), spec.width)[start]
    return mix(one), mix(other), row, start - bounds[row]


def _contexts(spec: Repeats, n_buckets: int):
    out_type = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("gram", pa.binary()), ("doc", pa.binary()), ("key", pa.binary()), ("pos", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("symbols", pa.binary())])
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out_type.types)], schema=out_type)

    def send(parts: list) -> pa.RecordBatch:
        """Windows of hot grams; their second hash stands in the column of left ends."""
        rows = _packed(spec, n_buckets, *(np.concatenate(x) for x in zip(*parts)))
        return table([(bucket, SETTLED if settled else WINDOWS, gram, doc, key, pos, context, b"", b"") for bucket, gram, context, doc, key, pos, settled in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_parts = [], 0
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for first, data, bounds in text_chunks(batch.column(2), 1 << 20):
                symbols, bounds = spec.symbols(data, bounds)
                n = len(bounds) - 1
                numbers = np.arange(n)

                def places(column: int) -> tuple[np.ndarray, np.ndarray]:
                    lists = batch.column(column).slice(first, n)
                    return np.repeat(numbers, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

                row, pos = places(4)
                if len(pos):
                    one, other, row, pos = _windows_of(symbols, bounds, row, pos, spec)
                    parts.append((one, other, ids[first + row], keys[first + row], pos))
                    n_parts += len(pos)
                    if n_parts >= GATHER:
                        yield send(parts)
                        parts, n_parts = [], 0
                row, pos = places(3)
                if not len(pos):
                    continue
                at = bounds[row] + pos
                left = np.minimum(spec.margin, pos)
                right = np.minimum(spec.margin, bounds[row + 1] - at - spec.gram)
                grams = mix(gram_hashes(symbols, spec.gram))[at]
                bucket = (grams >> np.uint64(32)) % np.uint64(n_buckets)
                order = np.argsort(bucket, kind="stable")
                for x in np.split(order, np.flatnonzero(_firsts(bucket[order]))[1:]):
                    matrix = context_matrix(symbols, at[x], left[x], right[x], spec)
                    matrix = (matrix - np.uint64(1)).astype(symbols.dtype)  # past the ends any value will do
                    yield table([(int(bucket[x[0]]), CONTEXTS, grams[x].astype(np.uint32).tobytes(), planes(ids[first + row[x]]), planes(keys[first + row[x]]), planes(pos[x].astype(np.uint32)),
                                  left[x].astype(np.uint8).tobytes(), right[x].astype(np.uint8).tobytes(), matrix.tobytes())])
        if n_parts:
            yield send(parts)

    return run, "bucket int, kind byte, gram binary, doc binary, key binary, pos binary, left binary, right binary, symbols binary"


def equal_windows(digits: Callable[[int, np.ndarray], np.ndarray], n_digits: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radix sort by further digits: (indices that survive, their group), groups of equal ones side by side.

    ``digits(i, rows)`` gives digit i of ``rows``. Each pass orders every group by its next digit and drops what is
    then alone.
    """
    rows = np.arange(len(group))
    for i in range(-1, n_digits):
        if i >= 0:
            digit = digits(i, rows)
            order = np.lexsort((digit, group))
            rows, group, digit = rows[order], group[order], digit[order]
            new = _firsts(group, digit)
        else:
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            new = _firsts(group)
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        rows, group = rows[several], number[several]
    return rows, group


def repeated_windows(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, spec: Repeats) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, entries, group) of the windows through the entries' anchors that equal another one.

    ``symbols`` holds the entries' contexts. A window begins ``offset`` symbols before the gram, 0 to the margin;
    all windows of a range of offsets share some symbols on either side of the gram. The range is halved again and
    again; each half sorts by the symbols that its windows share besides, and drops groups of one, until at a single
    offset the whole window is sorted, and no symbol beyond it.
    """
    m = spec.margin

    def sorted_by(entries: np.ndarray, group: np.ndarray, first: int, last: int):
        def digit(i: int, rows: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rows), np.uint64)
            for column in range(first + i * spec.digit, min(first + (i + 1) * spec.digit, last)):
                out = out * (np.uint64(256) if symbols.dtype == np.uint8 else BASE) + symbols[entries[rows], column].astype(np.uint64)
            return out

        rows, group = equal_windows(digit, -(-(last - first) // spec.digit), group)
        return entries[rows], group

    ranges = [(0, m, *sorted_by(np.arange(len(group)), group, m, m + spec.gram))]
    while ranges:
        low, high, entries, group = ranges.pop()
        if not len(entries):
            continue
        if low == high:
            yield low, entries, group
            continue
        middle = (low + high) // 2
        fits = right[entries] >= m - middle
        ranges.append((low, middle, *sorted_by(entries[fits], group[fits], spec.gram + 2 * m - high, spec.gram + 2 * m - middle)))
        fits = left[entries] > middle
        ranges.append((middle + 1, high, *sorted_by(entries[fits], group[fits], m - middle - 1, m - low)))


def _refine(spec: Repeats, dtype):
    out_type = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("span", pa.int64())])
    m, width, span = spec.margin, spec.width, spec.gram + 2 * spec.margin
    dtype = np.dtype(dtype)

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()

        def get(column: str, dtype, kinds=(CONTEXTS,), read=np.frombuffer) -> np.ndarray:
            return np.concatenate([read(x, dtype) for x in table.column(column).take(pa.array(np.flatnonzero(np.isin(kind, kinds)))).to_pylist()] or [np.zeros(0, dtype)])

        found_doc, found_key, found_span = [], [], []
        for kinds in ((SETTLED,), (WINDOWS,)):
            doc, key = (get(c, np.int64, kinds, from_planes) for c in ("doc", "key"))
            pos = get("pos", np.uint32, kinds, from_planes).astype(np.int64)
            if kinds == (WINDOWS,) and len(doc):
                _, _, doc, key, pos, covered, _ = _equal_contexts(get("gram", np.uint32, kinds), get("left", np.uint64, kinds), doc, key, pos, spec)
                doc, key, pos = doc[covered], key[covered], pos[covered]
            found_doc.append(doc)
            found_key.append(key)
            found_span.append((pos << 32) | (pos + width))
        gram, doc, key = get("gram", np.uint32), get("doc", np.int64, read=from_planes), get("key", np.int64, read=from_planes)
        pos = get("pos", np.uint32, read=from_planes).astype(np.int64)
        left, right = get("left", np.uint8).astype(np.int64), get("right", np.uint8).astype(np.int64)
        symbols = get("symbols", dtype).reshape(-1, span)
        names = np.unique(gram, return_inverse=True)[1]
        order = np.argsort(names, kind="stable")
        starts = np.flatnonzero(_firsts(names[order])) if len(order) else []
        # whole groups of one gram at a time, about 200,000 anchors together
        cuts = starts[np.flatnonzero(np.diff(starts // 200_000, prepend=-1))] if len(starts) else []
        # windows through one anchor overlap each other: their union is one interval
        lowest, highest = np.full(len(doc), m + 1), np.full(len(doc), -1)
        for part in np.split(order, cuts[1:]):
            for offset, entries, group in repeated_windows(symbols[part], left[part], right[part], names[part], spec):
                entries = part[entries]
                if spec.earlier:
                    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
                    np.minimum.at(least, group, doc[entries])
                    entries = entries[doc[entries] > least[group]]
                lowest[entries] = np.minimum(lowest[entries], offset)
                highest[entries] = np.maximum(highest[entries], offset)
        hit = np.flatnonzero(highest >= 0)
        found_doc.append(doc[hit])
        found_key.append(key[hit])
        found_span.append(((pos[hit] - highest[hit]) << 32) | (pos[hit] - lowest[hit] + width))
        return pa.table([pa.array(np.concatenate(x)) for x in (found_doc, found_key, found_span)], schema=out_type)

    return run, "doc_id long, key long, span long"


def covered_texts(docs: DataFrame, spec: Repeats, dtype, finish: Callable, schema: str) -> DataFrame:
    """Rows that ``finish`` makes of each batch: (doc ids, texts, lists of (start << 32 | end) or null).

    The lists hold intervals of symbols; an end of 0 stands for a settled anchor at start.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = [r[0] for r in texts.groupBy("doc_id").count().where("count > 1").select("doc_id").limit(FEW + 1).collect()]
    key = F.xxhash64("text")  # zeros pack to nothing, so ids of one row have them while the others are few enough to be named
    texts = texts.select("doc_id", (key if len(repeated) > FEW else F.when(F.col("doc_id").isin(repeated), key).otherwise(0)).alias("key"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(4 * n_tasks(docs.sparkSession), size // BUCKET_BYTES + 1)
    sample, sampled = _sample(spec, n_buckets)
    settle, settled = _settle(spec)
    first = materialise(texts.mapInArrow(sample, sampled).groupBy("bucket").applyInArrow(settle, settled), "anchors")
    contexts, contexted = _contexts(spec, n_buckets)
    refine, refined = _refine(spec, dtype)
    of_kind = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("pos")))
    left_over = first.where(F.col("kind") != COVERED).groupBy("doc_id", "key").agg(of_kind(OPEN).alias("places"), of_kind(HOT).alias("hot"))
    spans = texts.join(left_over, ["doc_id", "key"]).select("doc_id", "key", "text", "places", "hot").mapInArrow(contexts, contexted).groupBy("bucket").applyInArrow(refine, refined)
    settled_spans = first.where(F.col("kind") == COVERED).select("doc_id", "key", F.shiftleft(F.col("pos").cast("long"), 32).alias("span"))
    spans = settled_spans.unionByName(spans).groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans"))
    return texts.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(finish, schema)


def removal_mask(n: int, spans, spec: Repeats) -> np.ndarray:
    """True for the symbols of a document of n symbols that the spans cover."""
    if spans is None or not len(spans):
        return np.zeros(n, bool)
    spans = np.asarray(spans, np.int64)
    start, end = spans >> 32, spans & 0xFFFFFFFF
    anchor = end == 0
    end = np.where(anchor, np.minimum(start + spec.gram + spec.margin, n), end)
    start = np.where(anchor, np.maximum(start - spec.margin, 0), start)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:n] > 0


def real_id(doc_id: int):
    return None if doc_id == NO_ID else doc_id
