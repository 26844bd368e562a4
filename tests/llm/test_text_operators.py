"""The text operators against brute force, the tokenizers library and held-out accuracy, edge cases included."""

import collections
import fractions
import functools
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import bpe, chat_format, exact_dedup, knn_quality, license_scan, near_dedup, pfair_mix, repeats, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, bucket int"
rnd = random.Random(11)


def documents(spark, texts):
    """Rows with clashing extra columns; ids with gaps."""
    return spark.createDataFrame([(i * 3, t, None, ["a", "b", None][i % 3], 0, 1, 2) for i, t in enumerate(texts)], SCHEMA)


def awkward_texts():
    words = ["The", "of", "mit", "License", "x" * 40, "naïve", "Σας", "<|endoftext|>"]
    phrase = [" ".join(rnd.choice(words) + str(rnd.randint(0, 9)) for _ in range(60)) for _ in range(3)]
    texts = [None, "", " \t\n", "a", "a  b\tc", "a b c", "The MIT License.", "general\npublic license, Apache license"]
    for _ in range(40):
        parts = [rnd.choice([rnd.choice(phrase), rnd.choice(phrase)[rnd.randint(0, 99):], "be " * rnd.randint(1, 90), rnd.choice(words)]) for _ in range(rnd.randint(1, 5))]
        texts.append(rnd.choice([" ", "\n"]).join(parts))
    return texts + texts[9:14] + [" ".join(rnd.choice(words) for _ in range(20_000))]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = awkward_texts()
    return documents(spark, texts).repartition(3).cache(), {i * 3: t or "" for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, []).where("false")


def test_exact_dedup(corpus):
    df, texts = corpus
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts.items()}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df, heavy=2).collect()}
    assert len(got) == len(texts)
    for i, t in norm.items():
        own = groups[t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(own), len(own), i == min(own))
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.drop_duplicates(df).count() == len(groups)


def test_license_scan(corpus):
    df, texts = corpus
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [j for j in range(len(w) - len(p) + 1) if w[j:j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_license_templates_survive_an_inserted_word(spark):
    df = documents(spark, ["foo This work is fully licensed under the GNU General Public License, version 3", "nothing at all"])
    got = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    assert got[0]["labels"] == "gpl,gpl-3.0" and got[3]["labels"] == "" and got[3]["score"] == 0.0


def brute_chain(words, template, slack=3):
    """Distinct template pairs covered by hits in order whose diagonals differ by slack at most."""
    w = template.split()
    pairs = list(zip(w, w[1:]))
    hits = [(i, at) for i, x in enumerate(zip(words, words[1:])) for at, y in enumerate(pairs) if x == y]

    @functools.cache
    def longest(i, at, low, high):
        return max((1 + longest(j, b, min(low, j - b), max(high, j - b)) for j, b in hits
                    if j > i and b > at and max(high, j - b) - min(low, j - b) <= slack), default=0)

    return max((1 + longest(i, at, i - at, i - at) for i, at in hits), default=0) / len(pairs)


def test_license_spans_are_verified(spark):
    rnd = random.Random(5)
    release, apache = license_scan.TEMPLATES["mit-release"], license_scan.TEMPLATES["apache-2.0"]
    texts = ["under the bed under the table under the sofa", " ".join(["licensed under"] * 5), " ".join(reversed(apache.split())),
             "the mit license is a thing released under the sun", f"{release} {release}", "licensed x y z u under the apache license a b c version 2 d e f 0"]
    for _ in range(60):
        w = rnd.choice(list(license_scan.TEMPLATES.values())).split() * rnd.randint(1, 2)
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(w))
            w[at:at + 1] = rnd.choice([["as"], [], [w[at], "so"], [w[at]] * 2, w[at:at + 3] * 2, ["so"]])
        texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in license_scan.license_scan(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        w, r = text.split(), got[i * 3]
        covered = {label: brute_chain(w, t) for label, t in license_scan.TEMPLATES.items()}
        own = {label for label, c in covered.items() if c >= 0.6}
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == own | base
        assert r["score"] == (1.0 if base else max(covered.values()))
        assert {s["template"] for s in r["spans"]} == own and all(0 <= s["from_word"] < s["to_word"] < len(w) for s in r["spans"])
    assert (got[0]["labels"], got[0]["score"], got[3]["labels"]) == ("", 0.25, "")
    assert [(s["from_word"], s["to_word"], s["covered"]) for s in got[12]["spans"]] == [(0, 4, 1.0), (5, 9, 1.0)]


def test_license_votes_are_of_one_row(spark):
    halves = [(4, "general public"), (4, "x public license"), (None, "released under the"), (None, "x x the mit"), (None, "mit license"), (None, "mit license")]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(halves, "doc_id long, text string")).collect()}
    assert (got[4]["n_base"], got[4]["labels"], got[4]["n_words"]) == (0, "", 5)
    assert (got[None]["n_base"], got[None]["labels"]) == (2, "mit")


def brute_suffix(texts, width=50):
    least = {}
    for i in sorted(texts):
        b = texts[i].encode()
        for p in range(len(b) - width + 1):
            least.setdefault(b[p:p + width], i)
    out = {}
    for i, t in texts.items():
        b, gone = t.encode(), bytearray(len(t.encode()))
        for p in range(len(b) - width + 1):
            if least[b[p:p + width]] < i:
                gone[p:p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def brute_substring(texts, width=35):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    n = collections.Counter(tuple(w[p:p + width]) for w in words.values() for p in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if n[tuple(w[p:p + width])] > 1:
                gone[p:p + width] = [True] * width
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_suffix_dedup(corpus):
    df, texts = corpus
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(df).collect()}
    want = brute_suffix(texts)
    assert sum(x[1] for x in want.values()) > 1000 and got == want


def test_substring_dedup(corpus):
    df, texts = corpus
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df).collect()}
    want = brute_substring(texts)
    assert sum(x[1] for x in want.values()) > 100 and got == want


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_grams_are_split_by_windows(corpus, hot):
    df, texts = corpus
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(df, hot=hot).collect()}
    assert got == brute_suffix(texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df, hot=hot).collect()}
    assert got == brute_substring(texts)


def test_texts_come_back_from_the_dedups(corpus):
    df, texts = corpus
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.suffix_dedup(df, with_text=True).collect()}
    assert kept[9] == b"a" and kept[0] == b""


def test_radix_sort_leaves_exactly_the_equal_suffixes():
    data = np.array([[1, 2, 3], [1, 2, 3], [1, 2, 4], [9, 9, 9]], np.uint64)
    rows, group = repeats.equal_windows(lambda i, r: data[r, i], 3, np.zeros(4, np.int64))
    assert sorted(rows.tolist()) == [0, 1] and len(set(group.tolist())) == 1


def test_halved_ranges_find_all_equal_windows():
    rng = np.random.default_rng(8)
    spec = suffix_dedup.spec_for(12, 4)
    m, n = spec.margin, 300
    symbols = rng.integers(0, 2, (n, spec.gram + 2 * m)).astype(np.uint8)
    left, right = rng.integers(0, m + 1, (2, n))
    names = rng.integers(0, 3, n)
    got = {(offset, tuple(sorted(entries[group == g].tolist()))) for offset, entries, group in repeats.repeated_windows(symbols, left, right, names, spec) for g in set(group.tolist())}
    want = set()
    for offset in range(m + 1):
        same = collections.defaultdict(list)
        for i in range(n):
            if offset <= left[i] and m - offset <= right[i]:
                same[names[i], symbols[i, m - offset:m - offset + spec.width].tobytes()].append(i)
        want |= {(offset, tuple(x)) for x in same.values() if len(x) > 1}
    assert got == want and want


def test_difference_cover_aligns_any_two_positions():
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_near(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_copies():
    """Chains and stars of edited texts, so that components are wider than links."""
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(300)]
    texts = [" ".join(base)]
    for n in range(25):
        edited = (texts[rnd.randrange(len(texts))] if n % 2 else texts[0]).split()
        for _ in range(rnd.randint(1, 9)):
            edited[rnd.randrange(len(edited))] = f"e{rnd.randint(0, 9999)}"
        texts.append(" ".join(edited))
    return texts + [None, "", "One two", "one TWO", "one two", texts[3]]


def test_near_duplicates(spark):
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute_near({i * 3: t or "" for i, t in enumerate(texts)})


def test_near_duplicates_of_rows_without_an_id_of_their_own(spark):
    texts = near_copies()
    ids = [5 if i % 4 == 0 else None if i % 4 == 1 else i * 3 for i in range(len(texts))]
    numbers = {i: t or "" for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("key", F.lit(1)).repartition(3)
    brute = brute_near(numbers)
    least = {}
    for i, (_, c, _) in brute.items():
        least[c] = min((least.get(c, (True, 1 << 60)), (ids[i] is not None, ids[i] or 0)))
    want = sorted((repr(ids[i]), n, repr(least[c][1] if least[c][0] else None) if n else repr(ids[i])) for i, (n, c, _) in brute.items())
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in near_dedup.near_duplicates(df).collect())
    assert got == want
    assert near_dedup.drop_near_duplicates(df).columns == df.columns


def test_cells_bound_the_intersection():
    rng = np.random.default_rng(4)
    for n in (3, 80, 2000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.where(rng.random(n) < 0.7, a, rng.integers(0, 1 << 63, n, dtype=np.uint64))
        cells = near_dedup.cell_counts(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
        assert np.minimum(cells[0], cells[1]).sum() >= len(np.intersect1d(a, b)) and cells.sum() == 2 * n


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (5, 60, 900):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        b[:n // 5] = rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)
        s = near_dedup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
        assert not (s == np.iinfo(np.uint64).max).any()
        assert abs((s[0] == s[1]).mean() - (n - n // 5) / (n + n // 5)) < 0.12


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_equals_the_library(corpus, tokenizer):
    df, texts = corpus
    path, library = tokenizer
    for n_words in (5, 32_768):
        got = {r["doc_id"]: r for r in bpe.encode_documents(df, path, n_words=n_words).collect()}
        for i, t in texts.items():
            ids = library.encode(t, add_special_tokens=False).ids
            assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_words_merge_as_the_library_does(tokenizer):
    path, library = tokenizer
    model = bpe.load(path)
    words = ["".join(rnd.choice("abehilnorst") for _ in range(n)) for n in (1, 2, 50, 3000, 9000)] + ["ab" * 3000, "国" * 2500]
    for w in words:
        want = library.encode(w, add_special_tokens=False).ids
        assert model.merge_long(w.encode()).tolist() == want
        assert model.merge([w.encode(), b"x"])[0].tolist() == want


def test_every_assigned_or_free_character_is_encoded_as_the_library_does(tokenizer):
    path, library = tokenizer
    encoder = bpe.Encoder(bpe.load(path), bpe.Lexicon(bpe.compile_lexicon({})))
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x33480 or c >= 0x3D000 and c % 97 == 0)]
    for first in range(0, len(texts), 20_000):
        part = texts[first:first + 20_000]
        ours = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)]
        encoder.known.clear()
        assert [e.ids for e in library.encode_batch(part, add_special_tokens=False)] == ours


def test_lexicon_shares_suffixes_and_numbers_words():
    words = {w.encode(): [n, n + 1] for n, w in enumerate(["king", "ring", "rings", "sing", "singing"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    found = lexicon.numbers([*words, b"", b"rin", b"ringss"])
    assert [np.frombuffer(lexicon.ids(n), "<u4").tolist() for n in found[:5]] == list(words.values()) and found[5:].tolist() == [-1, -1, -1]
    assert len(lexicon.keys) < sum(map(len, words))


def test_quality_votes(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = knn_quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scores_equal_naive_votes(spark):
    """Cosines, the nearest and their votes in plain Python, over the learnt vectors."""
    rnd = random.Random(2)
    words = [["good", "plain", "words", "here", "and", "there"], ["BUY", "NOW!!", "99", "c@ll", "x1"]]
    rows = [(i, " ".join(rnd.choice(words[i % 2] if rnd.random() < 0.8 else words[0]) for _ in range(rnd.randint(0, 30)))) for i in range(120)] + [(None, "good words"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(90)] + [(None, 1)], "doc_id long, quality int")
    model = knn_quality.fit(docs, labels, sample=64, rank=8)
    assert 0 < len(model.labels) <= 64
    got = {r["doc_id"]: r for r in knn_quality.score_quality(docs, model, neighbours=7).collect()}
    for i, text in rows:
        counts = knn_quality.term_counts([(text or "").encode()], knn_quality.Terms())
        projected = (knn_quality.weighted(counts, model.idf) @ model.directions)[0].tolist()
        length = sum(x * x for x in projected) ** 0.5
        cosines = [(-round(sum(a * b for a, b in zip(projected, v)) / max(length, 1e-12), 5), n, label) for n, (v, label) in enumerate(zip(model.vectors.tolist(), model.labels.tolist()))]
        near = [(max(-c, 0.0), label) for c, _, label in sorted(cosines)[:7]] if counts.sum() else []
        want = (sum(c * label for c, label in near) + 0.25 * model.prior) / (sum(c for c, _ in near) + 0.25)
        assert abs(got[i]["score"] - want) < 1e-3
    rows = {r["doc_id"]: r for r in knn_quality.classify(docs, labels).collect()}
    assert rows[None]["held_out"] is False and rows[500]["predicted"] in (0, 1)


def test_quality_edge_cases(spark, nothing):
    docs = documents(spark, [None, "", "word " * 5, "WORD!! " * 9])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in knn_quality.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(6, 1), (6, None), (99, 0)], "doc_id long, quality int")
    assert knn_quality.classify(docs, one).count() == 4 and knn_quality.classify(nothing, one).count() == 0


def test_mixture_deviates_by_less_than_a_block(spark):
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"big": 1.0, "s1": 3.0, "s2": 0.5}
    got = pfair_mix.mix_plan(docs, weights, 8).toPandas()
    assert sorted(got["position"].rank().tolist()) == list(range(1, 3001)) and got["position"].is_unique
    sizes = got.groupby("source", dropna=False).size().to_dict()
    blocks = {k: -(-n // 8) for k, n in sizes.items()}
    times, counts = pfair_mix.fluid(blocks, {k: weights.get(k, 1.5) for k in blocks})
    slots = got.drop_duplicates("slot").sort_values("slot")
    assert slots["slot"].tolist() == list(range(sum(blocks.values())))
    for k in blocks:
        own = slots["source"].isna() if not isinstance(k, str) else slots["source"] == k
        ahead = own.cumsum().to_numpy() - np.interp(np.arange(1, len(slots) + 1), times, counts[k])
        assert np.abs(ahead).max() < 1


def naive_pfair(blocks, weights):
    """Slots by earliest deadline first over exact fractions, one slot at a time, no frames."""
    left, have, path, now = dict(blocks), {s: fractions.Fraction(0) for s in blocks}, {s: [(fractions.Fraction(0), fractions.Fraction(0))] for s in blocks}, fractions.Fraction(0)
    while any(left.values()):
        total = sum(weights[s] for s in left if left[s])
        span = min(left[s] * total / weights[s] for s in left if left[s])
        now += span
        for s in left:
            if left[s]:
                step = span * weights[s] / total
                have[s], left[s] = have[s] + step, left[s] - step
            path[s].append((now, have[s]))

    def when(s, k):
        for (t0, f0), (t1, f1) in zip(path[s], path[s][1:]):
            if f0 <= k <= f1 and f1 > f0:
                return t0 + (k - f0) / (f1 - f0) * (t1 - t0)

    jobs = sorted((math.floor(when(s, k)), math.ceil(when(s, k + 1)), str(s), k, s) for s in blocks for k in range(blocks[s]))
    out, ready, at = [], [], 0
    for slot in range(sum(blocks.values())):
        while at < len(jobs) and jobs[at][0] <= slot:
            ready.append(jobs[at][1:])
            at += 1
        best = min(ready)
        ready.remove(best)
        assert best[0] >= slot + 1  # no deadline is missed
        out.append((best[3], best[2], slot))
    return out


@pytest.mark.parametrize("blocks, weights", [({0: 40, 1: 9, 2: 25}, {0: 4, 1: 2, 2: 1}), ({0: 1, 1: 100}, {0: 1, 1: 1}), ({0: 30, 1: 30, 2: 30, 3: 7}, {0: 3, 1: 5, 2: 7, 3: 2})])
def test_schedule_equals_exact_fractions(blocks, weights):
    times, counts = pfair_mix.fluid(blocks, {s: float(w) for s, w in weights.items()})
    got = pfair_mix.schedule_frame(0, sum(blocks.values()), times, counts, blocks)
    assert got == naive_pfair(blocks, {s: fractions.Fraction(w) for s, w in weights.items()})


def test_mixing_keeps_clashing_columns_and_empty_tables(spark):
    names = ["_bucket", "_start", "_place", "_slot", "_name", "_block", "_position", "row", "id", "name", "source_n", "bucket", "start", "place", "block", "slot", "position", "count"]
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "doc_id long, source string").withColumns({n: F.lit(77 + i) for i, n in enumerate(names)})
    rows = pfair_mix.mix_sources(docs, {"a": 2.0}, 4).collect()
    assert len(rows) == 20 and {tuple(r[n] for n in names) for r in rows} == {tuple(range(77, 77 + len(names)))}
    assert pfair_mix.mix_sources(docs.where("false"), {"a": 2.0}, 4).collect() == []
    assert pfair_mix.mix_plan(docs, {}, 4).count() == 20


def test_frames_join_without_deviation():
    blocks, weights = {0: 9000, 1: 3000, 2: 5}, {0: 3.0, 1: 1.0, 2: 0.5}
    times, counts = pfair_mix.fluid(blocks, weights)
    total, out = sum(blocks.values()), []
    for f in range(0, total, pfair_mix.FRAME):
        out += pfair_mix.schedule_frame(f, min(f + pfair_mix.FRAME, total), times, counts, blocks)
    assert len({(s, b) for s, b, _ in out}) == total
    for s in blocks:
        c = np.cumsum([x[0] == s for x in out])
        assert np.abs(c - np.interp(np.arange(1, total + 1), times, counts[s])).max() < 1


def test_mixing_keeps_rows_and_columns(corpus):
    df, texts = corpus
    mixed = pfair_mix.mix_sources(df, {"a": 2.0}, 4)
    assert mixed.columns == df.columns and mixed.count() == len(texts)
    with pytest.raises(ValueError):
        pfair_mix.mix_sources(df, {"a": 0.0})


def test_the_loss_mask_is_what_is_read(spark):
    turns = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "<tell> & [more]"), (None, 0, "user", "x"), (None, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat_format.digest_of(out).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(b"<tell> & [more]").hexdigest() and (got[None]["n_turns"], got[None]["loss_chars"]) == (2, 0)
    masked = out.withColumn("segments", F.transform("segments", lambda s: F.struct(s["role"], s["text"], F.lit(False).alias("loss"))))
    assert all(r["loss_chars"] == 0 for r in chat_format.digest_of(masked).collect())


def test_rows_stay_by_id_and_text(spark):
    docs = spark.createDataFrame([(3, "b"), (5, "a"), (5, "b"), (None, "c"), (7, "c"), (None, "a  a"), (9, None), (9, "")], "doc_id long, text string").withColumn("kept", F.lit(1))
    got = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(docs).collect()), key=repr)
    assert got == [(3, "b"), (5, "a"), (9, ""), (9, None), (None, "a  a"), (None, "c")]


def test_good_rows_stay_by_id_and_text(spark):
    texts = ["Plain words make a calm and useful sentence here. " * 8, "x9$ zz!! @@ 11 BUY!!! " * 20]
    docs = spark.createDataFrame([(i, texts[i % 2] + str(i)) for i in range(80)] + [(500, texts[0]), (500, texts[1]), (None, texts[0]), (None, texts[1])], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    got = [(r["doc_id"], r["text"][:5]) for r in knn_quality.keep_good(docs, labels).collect() if r["doc_id"] in (500, None)]
    assert sorted(got, key=repr) == [(500, "Plain"), (None, "Plain")]


def test_ties_in_the_mixture_are_ordered_by_text(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i}", "a") for i in range(40)], "doc_id long, text string, source string")
    place = lambda df: {r["row"]["text"]: r["position"] for r in pfair_mix.mixed_positions(df, {}, 4, tie=F.xxhash64("text")).collect()}
    assert place(docs.repartition(5)) == place(docs.repartition(2, "text")) and sorted(place(docs).values()) == list(range(40))


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a &lt; b &amp; <s>", "", None, "line\nbreak & [x]", "<<SYS>>"]
    rows = [(c, t, r, rnd.choice(said)) for c in range(30) for t, r in enumerate(rnd.choices(["user", "assistant", "system", "to<ol>", None], k=rnd.randint(1, 6)))]
    rows += [(99, 0, "system", "s"), (99, 1, "user", "u"), (99, 2, "assistant", "a"), (98, 0, "assistant", "a"), (99, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.chat_digest(df).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert not got[98]["valid"] and not got[99]["valid"]  # an assistant first; an assistant turn twice


@pytest.mark.parametrize("run", [
    exact_dedup.exact_dedup, license_scan.license_scan, suffix_dedup.suffix_dedup, substring_dedup.substring_dedup, near_dedup.near_duplicates, pfair_mix.mix_plan,
])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


def test_empty_table_bpe(nothing, tokenizer):
    assert bpe.encode_documents(nothing, tokenizer[0]).count() == 0


def test_empty_table_chat(spark):
    assert chat_format.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_bpe_with_clashing_columns_and_null_ids(spark, tokenizer):
    df = spark.createDataFrame([(None, "one two", 7, "x"), (None, None, 8, "y"), (3, "", 9, "z")], "doc_id long, text string, ids int, n_tokens string")
    got = sorted((repr(r["doc_id"]), r["n_tokens"]) for r in bpe.encode_documents(df, tokenizer[0], with_ids=True).collect())
    assert got == [("3", 0), ("None", 0), ("None", 2)]


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, "other")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(df).collect()), key=repr)
    size = len(text)
    assert rows == sorted([(None, 0), (5, size), (5, size), (7, 0)], key=repr)
    assert {r["doc_id"] for r in exact_dedup.exact_dedup(df).where("kept").collect()} == {None, 7}  # a null id is the smallest
    assert near_dedup.near_duplicates(df).where("component_id IS NULL").count() == 3
    ids = {r["doc_id"] for r in license_scan.license_scan(df).collect()}
    assert ids == {None, 5, 7}


def test_working_tables_are_dropped(spark, corpus):
    from pitchlake.llm import common

    common.drop_working_tables(spark)
    exact_dedup.exact_dedup(corpus[0]).count()
    paths = common.working_tables()
    assert paths
    common.drop_working_tables(spark, paths[:1])
    assert common.working_tables() == paths[1:]
    common.drop_working_tables(spark)
    assert common.working_tables() == []


def test_rows_without_an_id_of_their_own_keep_their_places(spark):
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    shared, edited = words("s", 60), words("s", 60)
    edited[45] = "other"  # an anchor's context differs while a window repeats
    long, short = words("l", 200) + shared, words("k", 40)
    rows = [(None, long), (None, short), (None, edited), (9, shared + words("t", 5)), (9, words("u", 300) + edited), (9, short), (9, words("v", 36)), (9, words("v", 36)), (None, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    n = collections.Counter(tuple(w[p:p + 35]) for _, w in rows for p in range(len(w) - 34))
    want = []
    for i, w in rows:
        gone = {q for p in range(len(w) - 34) if n[tuple(w[p:p + 35])] > 1 for q in range(p, p + 35)}
        want.append((i, len(w), len(gone)))
    for hot in (1, 20_000):
        got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(df, hot=hot).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    least = {}
    for i, w in rows:
        b, i = " ".join(w), -1 if i is None else i
        for p in range(len(b) - 49):
            least[b[p:p + 50]] = min(i, least.get(b[p:p + 50], i))
    want = []
    for i, w in rows:
        b = " ".join(w)
        gone = {q for p in range(len(b) - 49) if least[b[p:p + 50]] < (-1 if i is None else i) for q in range(p, p + 50)}
        want.append((i, len(b), len(gone)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
