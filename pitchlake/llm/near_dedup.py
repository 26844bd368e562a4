"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds its distinct 5-word shingles. Documents with equal sets form a class, named by a 64-bit
hash of the set; only one document of each goes on, so thousands of copies cost one row, and ids may be null or
repeated. Signatures have 128 ranks in 32 bands of 4: two sets of similarity 0.75 miss all bands with probability
5e-6.

Documents that share a band are candidates. Rather than emit all pairs of a bucket, each round compares a
bucket's members with one hub (first the one whose buckets are the fullest, which lies in the middle of its
family), on full sets, and merges what is linked; buckets that lie in one component are done.

What is left are members of a family that are too far from its hubs. A shingle that no other such document has
can be in no intersection, so a document with too few shared shingles for any partner of another component
drops out of a bucket; that is counted, for all documents together, without forming pairs. Only what remains
is compared pair by pair: first by how many shingles fall into each of 256 cells, which bounds the intersection from
above and so loses no link, then on full sets. Every link is confirmed on full sets.

Defined results: null and empty texts have no set: size 0, a component of their own; fewer than five words
form one shingle; rows that repeat an id are documents of their own, by their texts, and named by that id; a null
id is smaller than any other; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import WordHashes, gram_hashes, materialise, mix, text_chunks

RANKS, BANDS, DEPTH = 128, 32, 4
CELLS = 256
ROUNDS = 1
NO_ID = -(1 << 63)
KEY = np.uint64(0x5851F42D4C957F2D)
_hashes = WordHashes()


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    raw = data.tobytes().lower()  # bytes: A-Z only
    symbols = [_hashes.array(raw[a:b].split()) for a, b in zip(bounds[:-1], bounds[1:])]
    ends = np.concatenate(([0], np.cumsum([len(s) for s in symbols])))
    grams = mix(gram_hashes(np.concatenate(symbols), words))
    out = []
    for s, a, b in zip(symbols, ends[:-1], ends[1:]):
        if len(s) >= words:
            own = np.sort(grams[a:b - words + 1])
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            out.append(own[new])
        else:
            out.append(mix(gram_hashes(s, len(s)) + np.uint64(len(s))) if len(s) else np.zeros(0, np.uint64))
    return out


def superminhash(elements: np.ndarray, row: np.ndarray, n_rows: int, ranks: int = RANKS) -> np.ndarray:
    """SuperMinHash signatures (n_rows x ranks). A value holds its level above 56 bits of a random rank.

    At level j every element draws a fraction and one of the places from j on of its own permutation, so its
    ranks differ from place to place. A row stops at the level that can improve none of its places.
    """
    signature = np.full(n_rows * ranks, np.iinfo(np.uint64).max, np.uint64)

    def draw(e: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        r = mix(e + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = level + (mix(r) % np.uint64(ranks - level)).astype(np.int64)
        return place, (np.uint64(level) << np.uint64(56)) | (r >> np.uint64(8))

    place, value = draw(elements, 0)
    np.minimum.at(signature, row * ranks + place, value)
    worst = signature.reshape(n_rows, ranks).max(axis=1)
    unfinished = (worst >> np.uint64(56)) >= 1
    rest = np.flatnonzero(unfinished[row])
    # about 20,000 elements together, for the permutations' memory
    for part in np.split(rest, range(20_000, len(rest), 20_000)):
        e, r, first = elements[part], row[part], place[part]
        permutation = np.tile(np.arange(ranks, dtype=np.int16), (len(e), 1))
        at = np.arange(len(e))
        permutation[at, first], permutation[at, 0] = permutation[at, 0], first.astype(np.int16)
        for level in range(1, ranks):
            active = np.flatnonzero((signature.reshape(n_rows, ranks).max(axis=1) >> np.uint64(56))[r] >= level)
            if not len(active):
                break
            if len(active) < len(e):
                e, r, permutation = e[active], r[active], permutation[active]
                at = np.arange(len(e))
            k, value = draw(e, level)
            chosen = permutation[at, k]
            permutation[at, k] = permutation[at, level]
            permutation[at, level] = chosen
            np.minimum.at(signature, r * ranks + chosen, value)
    return signature.reshape(n_rows, ranks)


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each set."""
    n = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    one, other = (np.add.reduceat(np.append(x, np.uint64(0)), starts) for x in (elements, mix(elements ^ KEY)))
    one[n == 0], other[n == 0] = 0, 0
    return mix(one ^ mix(other + n.astype(np.uint64))).view(np.int64)


def cell_counts(elements: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """How many elements of each row fall into each cell (n_rows x CELLS), cut at 32,767."""
    cell = (elements >> np.uint64(32)).astype(np.int64) % CELLS
    return np.minimum(np.bincount(row * CELLS + cell, minlength=n_rows * CELLS), 32_767).reshape(n_rows, CELLS).astype(np.int16)


def _features(words: int):
    out_type = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("doc", pa.int64()), ("bands", pa.list_(pa.int64())), ("cells", pa.list_(pa.int16()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in text_chunks(batch.column(2), 1 << 21):
                sets = shingle_sets(data, bounds, words)
                n = np.array([len(s) for s in sets])
                elements, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
                signature = superminhash(elements, row, len(sets))
                band = gram_hashes(signature.ravel(), DEPTH)[::DEPTH].reshape(len(sets), BANDS)
                band = mix(band + np.arange(BANDS, dtype=np.uint64))
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0))))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(first, len(sets)) for c in (0, 1)), pa.array(n), pa.array(set_names(sets)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(band[n > 0].ravel().view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(offsets * (CELLS // BANDS), pa.int32()), pa.array(cell_counts(elements, row, len(sets))[n > 0].ravel())),
                ], schema=out_type)

    return run, "doc_id long, key long, n_shingles long, doc long, bands array<long>, cells array<short>"


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in text_chunks(batch.column(0), 1 << 21):
                sets = shingle_sets(data, bounds, words)
                yield pa.RecordBatch.from_arrays([pa.array(set_names(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "shingles"])

    return run, "doc long, shingles binary"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(shingles.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), doc)), pa.array(own)], names=["doc", "token"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run, "a long, b long, linked boolean"


def connected(edges: DataFrame) -> DataFrame:
    """(doc, comp): the smallest document that each document on an edge (a, b) can reach.

    Union by the smaller label along edges, then the labels' own labels (path halving), until nothing changes.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", few=True)
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "doc"), "labels", few=True)
    while True:
        offered = both.join(labels.select(F.col("doc").alias("b"), F.col("comp").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        joined = labels.join(offered.withColumnRenamed("a", "doc"), "doc").select("doc", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        onward = joined.join(labels.select(F.col("doc").alias("comp"), F.col("comp").alias("onward")), "comp", "left")
        labels = materialise(onward.select("doc", F.least("comp", "onward").alias("comp"), "old"), "labels", few=True)
        changed = labels.where("comp <> old").limit(1).count()
        labels = labels.select("doc", "comp")
        if not changed:
            return labels


def _between(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    several = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return members.join(several, "bucket")


def _rest(live: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket that can still be linked."""
    tokens = sets.join(live.select("doc").distinct(), "doc", "left_semi").mapInArrow(_tokens, "doc long, token long")
    again = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    common = tokens.join(again, "token", "left_semi").groupBy("doc").agg(F.count(F.lit(1)).alias("common"))
    sized = live.join(common, "doc").join(sets.select("doc", (F.octet_length("shingles") / 8).cast("long").alias("size")), "doc")
    rows = materialise(sized.where((F.col("common") * 100 >= F.col("size") * percent)).select("bucket", "doc", "comp", "common", "size"), "sized")
    # the smallest possible partner: an intersection needs percent / (100 + percent) of both sizes together
    smallest = rows.groupBy("bucket", "comp").agg(F.min("size").alias("size"))
    first = smallest.groupBy("bucket").agg(F.min(F.struct("size", "comp")).alias("first"))
    second = smallest.join(first, "bucket").where("comp <> first.comp").groupBy("bucket").agg(F.min("size").alias("second"), F.first("first").alias("first"))
    partner = F.when(F.col("comp") == F.col("first.comp"), F.col("second")).otherwise(F.col("first.size"))
    able = rows.join(second, "bucket").where(F.col("common") * (100 + percent) >= (F.col("size") + partner) * percent).select(rows.columns)
    able = materialise(_between(able).join(classes.select("doc", "bands", "cells"), "doc"), "able")
    other = able.select(*[F.col(c).alias(f"other_{c}") for c in ("bucket", "doc", "comp", "common", "size", "bands", "cells")])
    fits = (F.col("comp") < F.col("other_comp")) & (F.least("common", "other_common") * (100 + percent) >= (F.col("size") + F.col("other_size")) * percent)
    once = F.element_at(F.array_intersect("bands", "other_bands"), 1) == F.col("bucket")  # a pair counts in the first band that it shares
    # of each cell the intersection has the lesser count at most; sets so large that a count may be cut go to the full test
    most = F.aggregate(F.zip_with("cells", "other_cells", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda n, x: n + x)
    possible = (most * (100 + percent) >= (F.col("size") + F.col("other_size")) * percent) | (F.least("size", "other_size") > 32_767)
    return able.join(other, (F.col("bucket") == F.col("other_bucket")) & fits & once & possible).select(F.least("doc", "other_doc").alias("a"), F.greatest("doc", "other_doc").alias("b"))


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, key), NO_ID for null, one row per document; ``key`` is a hash of the text."""
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    features, featured = _features(words)
    rows = materialise(texts.mapInArrow(features, featured), "signatures")
    of_class = (F.min("doc_id").alias("least_id"), F.min_by(F.struct(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"), "bands", "cells"), F.struct("doc_id", "key")).alias("s"))
    classes = materialise(rows.where("n_shingles > 0").groupBy("doc").agg(*of_class).select("doc", "least_id", "s.*"), "classes")
    banded = classes.select(F.explode("bands").alias("bucket"), "doc")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = banded.join(shared, "bucket")
    fullness = buckets.groupBy("doc").agg(F.sum("n").alias("fullness"))
    buckets = materialise(buckets.drop("n").join(fullness, "doc"), "buckets")
    full, fulled = _full_sets(words)
    confirm, confirmed = _confirm(percent)
    wanted = classes.join(buckets.select("doc").distinct(), "doc", "left_semi").select(F.col("of_id").alias("doc_id"), F.col("of_key").alias("key"))
    # rows that agree in id and text have one set
    sets = texts.join(wanted, ["doc_id", "key"], "left_semi").select("text").mapInArrow(full, fulled)
    sets = materialise(sets.groupBy("doc").agg(F.max("shingles").alias("shingles")), "sets")

    def links_of(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("of_a"))
        right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("of_b"))
        fit = F.least(F.octet_length("of_a"), F.octet_length("of_b")) * 100 >= F.greatest(F.octet_length("of_a"), F.octet_length("of_b")) * percent
        return pairs.join(left, "a").join(right, "b").where(fit).select("a", "b", "of_a", "of_b").mapInArrow(confirm, confirmed).where("linked").select("a", "b")

    edges, live = None, buckets.withColumn("comp", F.col("doc"))
    for step in range(ROUNDS + 1):
        if step:
            labelled = buckets.join(connected(edges), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
            live = materialise(_between(labelled), "live")
        if step < ROUNDS:
            order = -F.col("fullness") if not step else F.xxhash64("doc", F.lit(step))
            hubs = live.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "doc", "comp")).alias("hub"))
            pairs = live.join(hubs, "bucket").where("comp <> hub.comp").select(F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b"))
        else:
            pairs = _rest(live, sets, classes, percent)
        found = materialise(links_of(pairs.distinct()), "links")
        edges = found if edges is None else edges.unionByName(found)
    labels = connected(edges)
    named = classes.select("doc", "least_id").join(labels, "doc", "left").select("doc", "least_id", F.coalesce("comp", "doc").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = materialise(named.join(least, "comp").select("doc", "component_id"), "named", few=True)
    out = rows.select("doc_id", "key", "n_shingles", "doc").join(named, "doc", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "key")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document."""
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return _components(docs, words, percent).select(real("doc_id"), "n_shingles", real("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays for its group, with all their columns.

    Of rows with one id, those whose texts are in the component that the id names stay.
    """
    kept = _components(docs, 5, 75).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    return docs.join(kept, (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == kept["kept_id"]) & (F.xxhash64(docs["text"]) == kept["kept_key"]), "left_semi")
