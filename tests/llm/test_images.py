"""Local descriptors: found copies against brute force over all pairs of images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import local_descriptors as ld

SIZE = 120


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(0, SIZE * 100, 100)]
    extra = [(7, rows[3][1]), (7, rows[3][1]), (8, rows[4][1]), (9, None), (None, rows[5][1])]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>").withColumns({"label": F.lit(0), "image": F.lit("x"), "class_id": F.lit(1)})


def brute_force(vectors):
    """Agreeing places of every query with every distinct picture, by comparing all corners."""
    by_id = {r["vec_id"]: r["embedding"] for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] is not None}
    read = lambda pixels: ld.describe(ld.read_greymap(ld.to_greymap(pixels)))
    held = {i: read(ld.rendered(v)) for i, v in by_id.items() if i % 100 == 0}
    found = set()
    for i in held:
        points, bits, _ = read(ld.edited(ld.rendered(by_id[i]), i // 100))
        for m, (p_points, p_bits, _) in held.items():
            if ld.compare(points, ld.packed(bits), p_points, ld.packed(p_bits))[1] >= 5:
                found.add((i, m))
    return found


def test_search_finds_what_brute_force_finds(spark, vectors):
    rows = ld.edited_copies(vectors).collect()
    classes = {(r["vec_id"], r["class_id"]) for r in rows if r["kind"] == "member"}
    assert {(7, 7), (300, 7), (8, 8), (400, 8), (0, 0), (9, None), (None, 500)} <= classes
    assert sum(r["kind"] == "member" for r in rows) == SIZE + 5
    name = {300: 7, 400: 8}
    truth = {(i, name.get(m, m)) for i, m in brute_force(vectors)}
    found = {(r["vec_id"], r["class_id"]) for r in rows if r["kind"] == "copy"}
    assert found <= truth  # the comparison of a pair is the same, so nothing else may be found
    assert len(found) >= 0.9 * len(truth)
    sources = {(i, name.get(i, i)) for i in range(0, SIZE * 100, 100)}
    assert len(found & sources) >= 0.85 * SIZE


def test_empty_table(spark, vectors):
    assert ld.edited_copies(vectors.limit(0)).collect() == []


def test_probes_hold_the_word_and_differ_in_unsure_bits():
    rng = np.random.default_rng(1)
    bits, sure = rng.random((3, 256)) < 0.5, rng.random((3, 256)).astype(np.float32)
    words, asked = ld.table_words(bits), ld.probes(bits, sure)
    assert (asked[:, :, 0] == words).all() and asked.shape == (3, ld.TABLES, 2 ** ld.UNSURE)
    for row in range(3):
        for t in range(ld.TABLES):
            weak = np.sort(np.argsort(sure[row, t * ld.WORD_BITS:(t + 1) * ld.WORD_BITS])[:ld.UNSURE])
            changed = np.bitwise_or.reduce(asked[row, t] ^ words[row, t])
            assert [i for i in range(64) if int(changed) >> i & 1] == weak.tolist()
            assert len(set(asked[row, t].tolist())) == 2 ** ld.UNSURE


@pytest.mark.parametrize("data", [None, b"", b"P5", b"P5\n9 9\n255\n", b"P6\n2 2\n255\n0123", ld.to_greymap(np.zeros((5, 5))), ld.to_greymap(np.zeros((64, 64)))])
def test_unreadable_flat_and_tiny_images_have_no_corners(data):
    assert len(ld.describe(ld.read_greymap(data))[0]) == 0


def test_corners_grow_with_the_image():
    rng = np.random.default_rng(3)
    large = rng.integers(0, 255, (400, 400)).astype(np.float32)
    assert len(ld.describe(large)[0]) > 4 * len(ld.describe(large[:150, :150])[0])


def test_turning_and_brightness_keep_descriptors():
    image = ld.rendered([1.0, 2.0]).astype(np.float32)
    a, b = ld.packed(ld.describe(image)[1]), ld.packed(ld.describe(np.rot90(image) * 0.5 + 20)[1])
    assert (np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2).min(axis=1) <= ld.NEAR_BITS).mean() > 0.5
