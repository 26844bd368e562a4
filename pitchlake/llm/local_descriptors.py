"""Cropped and edited copies of images, by local descriptors.

An image column holds binary portable greymaps (P5, one byte a pixel). On a pyramid of scales (steps of 1.25,
so that a rescaled copy meets a level at most an eighth off) the strongest Harris corners are kept, as many as
the level's area allows (one in ``AREA`` pixels, ``LEAST`` at least: the feature's own density). A corner's
orientation is the direction of its patch's centroid of brightness. 256 comparisons of pixel pairs that lie
across that direction give the descriptor: each is as often one as zero, and neither brightness nor contrast
nor turning changes it.

Five disjoint words of 51 bits key five tables. The queries, the smaller side, ask with each word and with all
changes of its ``UNSURE`` bits whose two pixels differ least, since an edit turns those first; the next word
is compared within the join. Pairs of images with two meetings or more, of different corners of the query and turned
alike (by ``TURN`` 256ths of a circle), are candidates: their corners are compared with each other on all bits (``NEAR_BITS`` at most), each match proposes
a turn, a scale and a shift, which is refitted to those that agree with it, and pairs with ``consensus`` agreeing
places or more are copies. The tables are a search of high recall, not an exact one: the tests hold it against
brute force over all pairs of images, for crops, rescaled, turned, blurred and noisy copies (0.9 at least).

Images with the same bytes form a class; its smallest id is searched and returned, so large groups of copies
cost one row. Queries are a stated set; everything else is joined by key, with no cap on a bucket.

Defined results: a null, empty or unreadable image has no corners, no class, and matches nothing; a flat or tiny
image has a class and matches nothing; repeated rows join their class, and of rows with one id and different
images one is searched; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import materialise, n_tasks

LEAST, AREA, LEVELS, STEP, RADIUS = 16, 576, 5, 1.25, 9
TABLES, WORD_BITS, UNSURE = 5, 51, 5
TURN, NEAR_BITS, NEXT_BITS = 20, 36, 6
DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])


def crossing_pairs(n: int, radius: float, apart: float = 2.5) -> np.ndarray:
    """(y1, y2, x) of n pairs of points within the patch's circle that lie at one place along the orientation."""
    rng = np.random.default_rng(7)
    x, y1, y2 = rng.uniform(-radius, radius, (3, 40 * n))
    fits = (np.abs(y1 - y2) >= apart) & (x * x + np.maximum(y1 * y1, y2 * y2) <= radius * radius)
    return np.stack([y1, y2, x], axis=1)[fits][:n].astype(np.float32)


TESTS = crossing_pairs(256, RADIUS)


def to_greymap(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def read_greymap(data: bytes | None) -> np.ndarray | None:
    head = (data or b"").split(maxsplit=3)[:3]
    if len(head) < 3 or head[0] != b"P5" or not (head[1].isdigit() and head[2].isdigit()):
        return None
    width, height = int(head[1]), int(head[2])
    if not width * height or len(data) < width * height:
        return None
    return np.frombuffer(data[-width * height:], np.uint8).reshape(height, width).astype(np.float32)


def box(image: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1)^2 pixels, edges repeated."""
    n = 2 * r + 1
    padded = np.pad(image, ((r + 1, r), (r + 1, r)), mode="edge").astype(np.float64)
    total = padded.cumsum(axis=0).cumsum(axis=1)
    return (total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / (n * n)


def shrink(image: np.ndarray, factor: float) -> np.ndarray:
    height, width = (max(1, int(s / factor)) for s in image.shape)
    y = np.minimum(((np.arange(height) + 0.5) * factor - 0.5).clip(0), image.shape[0] - 1)
    x = np.minimum(((np.arange(width) + 0.5) * factor - 0.5).clip(0), image.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), image.shape[0] - 2).clip(0), np.minimum(x.astype(int), image.shape[1] - 2).clip(0)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def between_pixels(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Brightness at places between pixels."""
    y0, x0 = y.astype(np.int32), x.astype(np.int32)
    fy, fx = y - y0, x - x0
    flat, at, width = image.ravel(), y0 * image.shape[1] + x0, image.shape[1]
    top = flat[at] + (flat[at + 1] - flat[at]) * fx
    low = flat[at + width] + (flat[at + width + 1] - flat[at + width]) * fx
    return top + (low - top) * fy


def corners_of(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the strongest corners of one level, strongest first."""
    height, width = image.shape
    edge = RADIUS + 2
    gy, gx = np.gradient(image)
    a, b, c = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
    response = a * b - c * c - 0.05 * (a + b) ** 2
    inner = response[edge:height - edge, edge:width - edge]
    best = inner > max(1.0, 1e-4 * inner.max())
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                best &= inner >= response[edge + dy:height - edge + dy, edge + dx:width - edge + dx]
    y, x = np.nonzero(best)
    order = np.argsort(-inner[y, x], kind="stable")[:max(LEAST, height * width // AREA)]
    return y[order] + edge, x[order] + edge


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle) in the image's own pixels, their bits (n x 256) and how far each bit is from turning."""
    points, bits, sure = [np.zeros((0, 4), np.float32)], [np.zeros((0, 256), bool)], [np.zeros((0, 256), np.float32)]
    for level in range(LEVELS if image is not None else 0):
        scale = STEP ** level
        here = image if not level else shrink(box(image, 1), scale)
        if min(here.shape) < 2 * RADIUS + 6:
            break
        smooth = box(here, 1).astype(np.float32)
        y, x = corners_of(smooth)
        if not len(y):
            continue
        patch = smooth[y[:, None] + DISC[:, 0], x[:, None] + DISC[:, 1]]
        patch = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2((patch * DISC[:, 0]).sum(axis=1), (patch * DISC[:, 1]).sum(axis=1))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        one, other = (between_pixels(smooth, y[:, None] + sin * TESTS[:, 2] + cos * across, x[:, None] + cos * TESTS[:, 2] - sin * across) for across in (TESTS[:, 0], TESTS[:, 1]))
        points.append(np.stack([x * scale, y * scale, np.full(len(x), scale), angle], axis=1).astype(np.float32))
        bits.append(one > other + 1e-3)
        sure.append(np.abs(one - other).astype(np.float32))
    return tuple(np.concatenate(part) for part in (points, bits, sure))


def packed(bits: np.ndarray) -> np.ndarray:
    """256 bits as four 64-bit words."""
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64).reshape(-1, 4)


PLACE = np.uint64(1) << np.arange(WORD_BITS, dtype=np.uint64)


def table_words(bits: np.ndarray) -> np.ndarray:
    """(n x TABLES) words of WORD_BITS disjoint bits."""
    return (bits[:, :TABLES * WORD_BITS].reshape(-1, TABLES, WORD_BITS) * PLACE).sum(axis=2, dtype=np.uint64)


def probes(bits: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """(n x TABLES x 2**UNSURE) words to ask with: all changes of each word's least sure bits."""
    words = table_words(bits)
    weak = np.argsort(sure[:, :TABLES * WORD_BITS].reshape(-1, TABLES, WORD_BITS), axis=2, kind="stable")[:, :, :UNSURE]
    changed = np.zeros((*words.shape, 1), np.uint64)
    for k in range(UNSURE):
        changed = np.concatenate([changed, changed ^ PLACE[weak[:, :, k]][:, :, None]], axis=2)
    return words[:, :, None] ^ changed


IMAGES = "id long, digest binary, points binary, words binary"
KEYS = "key long, next long, id long, place long"


def descriptors(media: DataFrame, unsure: bool = False) -> DataFrame:
    """(id, digest, points, words[, sure]) of each readable image of (id, image); the pixels themselves go no further.

    ``points`` holds the corners as 32-bit floats, ``words`` their bits, ``sure`` how sure each bit is, a byte each.
    """
    names = ["id", "digest", "points", "words", *(["sure"] if unsure else [])]
    types = [pa.int64(), *[pa.binary()] * (len(names) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 250):
                rows = []
                for i, image in zip(*(c.slice(first, 250) for c in batch.columns)):
                    pixels = read_greymap(image.as_py())
                    if pixels is not None:
                        points, bits, sure = describe(pixels)
                        grades = [np.minimum(sure * 4, 255).astype(np.uint8).tobytes()] if unsure else []
                        rows.append((i.as_py(), hashlib.sha256(image.as_py()).digest(), points.tobytes(), packed(bits).tobytes(), *grades))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return media.select("id", "image").mapInArrow(run, IMAGES + ", sure binary" * unsure)


def unpacked(points: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(points, bits as four words) of a stored image."""
    return np.frombuffer(points, np.float32).reshape(-1, 4), np.frombuffer(words, np.uint64).reshape(-1, 4)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table keys of images (id, points, words[, sure]): of a query, which has ``sure``, with all its probes.

    A key holds the table above the word; a place holds the corner's number above its angle in 256ths of a circle.
    """
    tables = np.arange(TABLES, dtype=np.uint64)[:, None] << np.uint64(56)
    for batch in batches:
        for i, points, words, *sure in zip(*(c.to_pylist() for c in batch.columns)):
            at, whole = unpacked(points, words)
            if not len(at):
                continue
            bits = np.unpackbits(np.ascontiguousarray(whole).view(np.uint8).reshape(len(at), 32), axis=1).astype(bool)
            own = table_words(bits)
            word = probes(bits, np.frombuffer(sure[0], np.uint8).reshape(-1, 256)) if sure else own[:, :, None]
            following = np.broadcast_to(np.roll(own, -1, axis=1)[:, :, None], word.shape)
            place = np.arange(len(at), dtype=np.int64) << 8 | (np.rint(at[:, 3] * (128 / np.pi)).astype(np.int64) & 255)
            yield pa.RecordBatch.from_arrays([
                pa.array((word | tables).ravel().view(np.int64)), pa.array(following.ravel().view(np.int64)),
                pa.array(np.full(word.size, i)), pa.array(np.repeat(place, word[0].size)),
            ], names=["key", "next", "id", "place"])


def consensus_of(q: np.ndarray, p: np.ndarray, pixels: float = 3.0) -> tuple[int, float, float, float, float]:
    """(agreeing places, scale, turn, dx, dy) of matched corners q and p (x, y, scale, angle): the proposal that most agree with.

    A match's own turn and scale find those that roughly agree with it; the turn, scale and shift that fit these
    best are then held against all. Places are squares of six pixels, so one corner on several levels counts once.
    """
    if not len(q):
        return 0, 1.0, 0.0, 0.0, 0.0
    a, b = q[:, 0] + 1j * q[:, 1], p[:, 0] + 1j * p[:, 1]
    turn = (p[:, 3] - q[:, 3]).astype(np.float64)
    factor = (p[:, 2] / q[:, 2]).astype(np.float64) * np.exp(1j * turn)
    away = np.abs(a[None] - a[:, None])
    like = np.abs((turn[None] - turn[:, None] + np.pi) % (2 * np.pi) - np.pi) < 0.5
    agree = like & (np.abs(b[None] - b[:, None] - factor[:, None] * (a[None] - a[:, None])) <= pixels + 0.25 * away)
    shift = b - factor * a
    limit = pixels * np.maximum(q[:, 2], p[:, 2])
    for _ in range(2):
        n = agree.sum(axis=1)
        mean_a, mean_b = (agree @ a) / np.maximum(n, 1), (agree @ b) / np.maximum(n, 1)
        spread = agree @ np.abs(a) ** 2 - n * np.abs(mean_a) ** 2
        fitted = (agree @ (np.conj(a) * b) - n * np.conj(mean_a) * mean_b) / np.maximum(spread, 1e-9)
        factor = np.where(spread > 1, fitted, factor)
        shift = mean_b - factor * mean_a
        agree = like & (np.abs(factor[:, None] * a[None] + shift[:, None] - b[None]) <= limit[None])
    place = (q[:, 0] // 6).astype(np.int64) << 32 | (q[:, 1] // 6).astype(np.int64)
    squares = np.unique(place, return_inverse=True)[1]
    counts = np.zeros((len(q), squares.max() + 1), bool)
    row, column = np.nonzero(agree)
    counts[row, squares[column]] = True
    best = int(counts.sum(axis=1).argmax())
    f = factor[best]
    return int(counts[best].sum()), float(np.abs(f)), float(np.angle(f)), float(shift[best].real), float(shift[best].imag)


def compare(q_points, q_words, p_points, p_words) -> tuple:
    """(matches, agreeing, scale, turn, dx, dy) of two images: each corner of the query with its nearest one."""
    if not len(q_points) or not len(p_points):
        return 0, 0, 1.0, 0.0, 0.0, 0.0
    apart = np.bitwise_count(q_words[:, None] ^ p_words[None]).sum(axis=2)
    nearest = apart.argmin(axis=1)
    near = apart[np.arange(len(nearest)), nearest] <= NEAR_BITS
    return int(near.sum()), *consensus_of(q_points[near], p_points[nearest[near]])


COPIES = "query_id long, match_id long, matches long, agreeing long, scale double, turn double, dx double, dy double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for q, m, *stored in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append((q, m, *compare(*unpacked(*stored[:2]), *unpacked(*stored[2:]))))
        types = [pa.int64()] * 4 + [pa.float64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=["query_id", "match_id", "matches", "agreeing", "scale", "turn", "dx", "dy"])


def classes_of(described: DataFrame) -> DataFrame:
    """(digest, class_id): images with the same bytes and their smallest id."""
    return described.groupBy("digest").agg(F.min("id").alias("class_id"))


def search(asked: DataFrame, held: DataFrame, consensus: int = 5) -> DataFrame:
    """Copies among described images: (query_id, match_id, ...) where an image of ``asked`` was made from one of ``held``."""
    held = held.join(classes_of(held).select(F.col("class_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    asked = asked.dropDuplicates(["id"])
    q = asked.select("id", "points", "words", "sure").mapInArrow(_keys, KEYS)
    m = held.select("id", "points", "words").mapInArrow(_keys, KEYS)
    q, m = q.withColumnsRenamed({c: c + "_q" for c in q.columns}), m.withColumnsRenamed({c: c + "_m" for c in m.columns})
    fits = F.bit_count(F.col("next_q").bitwiseXOR(F.col("next_m"))) <= NEXT_BITS
    meeting = F.struct(F.shiftright("place_q", 8).alias("corner"), F.pmod(F.col("place_m") - F.col("place_q"), F.lit(256)).alias("turn"))
    apart = lambda x, y: F.pmod(x["turn"] - y["turn"] + TURN, F.lit(256))
    turned_alike = F.exists("met", lambda x: F.exists("met", lambda y: (x["corner"] != y["corner"]) & (apart(x, y) <= 2 * TURN)))
    # the hint: estimates don't see that an image becomes many rows, so they would be broadcast
    met = q.hint("merge").join(m, (F.col("key_q") == F.col("key_m")) & fits).groupBy("id_q", "id_m").agg(F.collect_set(meeting).alias("met"))
    pairs = materialise(met.where(turned_alike).select("id_q", "id_m"), "pairs", few=True)
    left = asked.select(F.col("id").alias("id_q"), F.col("points").alias("points_q"), F.col("words").alias("words_q"))
    right = held.select(F.col("id").alias("id_m"), F.col("points").alias("points_m"), F.col("words").alias("words_m"))
    both = pairs.join(left, "id_q").join(right, "id_m").select("id_q", "id_m", "points_q", "words_q", "points_m", "words_m")
    return both.mapInArrow(_compared, COPIES).where(F.col("agreeing") >= consensus)


def find_copies(media: DataFrame, queries: DataFrame, consensus: int = 5) -> DataFrame:
    """(query_id, match_id, matches, agreeing, scale, turn, dx, dy): images of (id, image) that a query (id, image) was made from.

    match_id is the smallest id of the images with the same bytes.
    """
    return search(materialise(descriptors(queries, True), "asked"), materialise(descriptors(media), "held"), consensus)


# --- stand-in media ----------------------------------------------------------------------------------------


def rendered(vector, size: int = 96) -> np.ndarray:
    """A picture of waves and rectangles that depends on the vector only: the tables hold no images of their own."""
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(np.asarray(vector, np.float32).tobytes()))
    at = np.arange(size)[:, None]
    waves = np.cos(rng.uniform(0.05, 0.9, (2, 10))[:, None] * at + rng.uniform(0, 2 * np.pi, (2, 10))[:, None])
    out = 128 + (waves[0] * rng.uniform(6, 16, 10)) @ waves[1].T
    for y, x, h, w, grey in zip(*rng.integers(0, size, (2, 20)), *rng.integers(6, 34, (2, 20)), rng.integers(-70, 70, 20)):
        out[y:y + h, x:x + w] += grey
    return out.clip(0, 255).astype(np.uint8)


def warped(pixels: np.ndarray, scale: float, turn: float, shift: tuple[float, float]) -> np.ndarray:
    """The middle three quarters of a picture, rescaled and turned about a shifted middle; blurred first where it shrinks."""
    source = (box(pixels, 1) if scale < 1 else pixels).astype(np.float32)
    size = source.shape[0]
    side = size * 3 // 4
    y, x = np.mgrid[0:side, 0:side].astype(np.float32) - side / 2
    c, s = np.cos(turn) / scale, np.sin(turn) / scale
    at = [np.clip(v + size / 2 + d, 0, size - 1.01) for v, d in ((y * c + x * s, shift[0]), (x * c - y * s, shift[1]))]
    return between_pixels(source, *at)


#: The stated edits, each on a crop of three quarters: how a copy is made.
EDITS = ("paler", "quarter turn", "smaller", "larger", "turned", "turned and smaller", "blurred", "noisy")


def edited(pixels: np.ndarray, n: int) -> np.ndarray:
    """A copy: cropped at a place that depends on n, and changed by the n-th of the stated edits in turn."""
    size = pixels.shape[0]
    side = size * 3 // 4
    y, x = n * 7 % (size - side + 1), n * 11 % (size - side + 1)
    crop, shift = pixels[y:y + side, x:x + side].astype(np.float32), (n * 7 % 9 - 4, n * 11 % 9 - 4)
    match EDITS[n % len(EDITS)]:
        case "paler":
            return crop * 0.75 + 30
        case "quarter turn":
            return np.rot90(crop) * 0.75 + 30
        case "smaller":
            return warped(pixels, 0.8, 0.0, shift)
        case "larger":
            return warped(pixels, 1.2, 0.0, shift)
        case "turned":
            return warped(pixels, 1.0, 0.3, shift)
        case "turned and smaller":
            return warped(pixels, 0.9, 0.7, shift)
        case "blurred":
            return box(crop, 1)
        case _:
            return (crop + np.random.default_rng(n).normal(0, 6, crop.shape)).clip(0, 255)


def vector_images(vectors: DataFrame, edit: bool) -> DataFrame:
    """(id, image) of (id, vector); edited copies if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first in range(0, len(ids), 250):
                part = [(i, None if v is None else to_greymap(edited(rendered(v), (i or 0) // 100) if edit else rendered(v))) for i, v in zip(ids[first:first + 250], batch.column(1).slice(first, 250).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.binary()))], names=["id", "image"])

    return vectors.select("id", "vector").mapInArrow(run, "id long, image binary")


def edited_copies(embeddings: DataFrame) -> DataFrame:
    """The search over images rendered from (vec_id, embedding): every id divisible by 100 asks with an edited copy.

    Rows of kind "member" give each image's class (null without an image), rows of kind "copy" the classes that the
    edited copy of an image was found in.
    """
    vectors = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).repartition(n_tasks(embeddings.sparkSession))
    held = materialise(descriptors(vector_images(vectors, False)), "held")
    asked = materialise(descriptors(vector_images(vectors.where(F.col("id") % 100 == 0), True), True), "asked")
    found = search(asked, held)
    named = held.select("id", "digest").join(classes_of(held), "digest").select("id", "class_id").distinct()
    members = embeddings.select("vec_id").join(named, F.col("vec_id").eqNullSafe(F.col("id")), "left").select(F.lit("member").alias("kind"), "vec_id", "class_id")
    copies = found.select(F.lit("copy").alias("kind"), F.col("query_id").alias("vec_id"), F.col("match_id").alias("class_id"), "matches", "agreeing", "scale", "turn", "dx", "dy")
    return members.unionByName(copies, allowMissingColumns=True)
