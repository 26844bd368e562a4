"""Line dedup, periodic runs and spelling variants against brute force."""

import collections
import fractions
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pitchlake.llm import line_dedup, periodic_runs, queries, spelling_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hi int, word string, n int, keep int"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(i, t, None, None, 0, 1, "w", 2, 3) for i, t in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# lines


def brute_lines(rows, least_docs=5, least_chars=40):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: float("-inf") if i is None else i
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least_docs or order(i) == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def line_rows(seed):
    rnd = random.Random(seed)
    common = ["Everywhere " * 4 + str(k) for k in range(6)] + ["é" * 40, "é" * 39, "ÀÉ" * 20 + "X", "a" * 39 + " ", " " * 50]
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, "x" * 40 + "\r\n" + "X" * 40 + " \t")]
    for i in range(4, 400):
        lines = [rnd.choice(common) if rnd.random() < 0.4 else f"line {rnd.randint(0, 120)} " + "z" * rnd.choice([5, 30, 60]) for _ in range(rnd.choice([1, 3, 9]))]
        lines += [common[0]] * (rnd.random() < 0.7)
        rows.append((rnd.choice([i, i, i, i // 2, None]), "\n".join(rnd.choice([x, x.upper() if x.isascii() else x, f"\t{x} \r"]) for x in lines)))
    return rows + rows[50:60] + [(9999, "\n".join(rnd.choice(common) for _ in range(5000)))]


@pytest.mark.parametrize("least_docs", [2, 5, 150])
def test_lines_equal_brute_force(spark, least_docs):
    rows = line_rows(least_docs)
    got = line_dedup.line_dedup(frame(spark, rows).repartition(3), least_docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_lines(rows, least_docs), key=repr)


def test_a_line_of_all_documents_is_cut_into_ranges(spark):
    """One hot hash spans many ranges; each is one task."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(i, f"own line {i} " + "y" * 40 + "\n" + "the line that all documents share, of enough letters") for i in range(3000)]
        assert sorted(map(tuple, line_dedup.line_dedup(frame(spark, rows)).collect())) == brute_lines(rows)
        assert line_dedup.keep_bitmaps(frame(spark, rows)).count() == 2999
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bitmaps_are_small(spark):
    rows = [(i, "\n".join(f"shared line number {k} with letters enough to count" for k in range(4000))) for i in range(6)]
    maps = line_dedup.keep_bitmaps(frame(spark, rows)).collect()
    assert len(maps) == 5 and all(m["n_dropped"] == 4000 and len(m["keep"]) < 40 for m in maps)
    kept = line_dedup.line_dedup(frame(spark, rows), with_text=True).where("doc_id = 5").first()
    assert kept["kept"] == rows[5][1]


def test_no_rows(spark):
    nothing = frame(spark, []).where("false")
    assert line_dedup.line_dedup(nothing).count() == 0
    assert periodic_runs.periodic_runs(nothing).count() == 0
    assert spelling_groups.spelling_groups(nothing).count() == 0
    assert spelling_groups.spelling_groups(frame(spark, [(None, None), (1, ""), (2, " \n")])).count() == 0


# runs


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words, exponent=4, least=6):
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i:i + length]
            if length >= max(least, exponent * q) and not any(all(stretch[x] == stretch[x + p] for x in range(length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected_runs(i, words, exponent=4, least=6):
    runs = brute_runs(words, exponent, least)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for x, w in enumerate(words) if x not in gone)))


def planted(i, text):
    words = split(text)
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if i is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if x < a else words[a + (x - a) % p] for x, w in enumerate(words)]


def run_texts():
    rnd = random.Random(5)
    texts = [None, "", " \n", "a", "a a a a a a", "a a a a a", "a b a b a b a b", "a b c " * 4, "é è " * 9 + "é", "x y x x y x y x x y x x y"]
    for _ in range(250):
        words = []
        while len(words) < rnd.choice([8, 40, 150]):
            unit = [rnd.choice("abc") for _ in range(rnd.randint(1, 9))]
            words += (unit * rnd.choice([1, 1, 4, 7]))[:rnd.randint(1, 50)]
        texts.append(rnd.choice([" ", "\t", "\r\n"]).join(words))
    return texts + texts[20:25] + [" ".join(rnd.choice("abcdefghijkl") for _ in range(3000)), "word " * 4000, "p q r s t u v " * 3000]


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 1), (3, 10)])
def test_runs_equal_brute_force(spark, exponent, least):
    rows = [(i, t) for i, t in enumerate(run_texts()) if len(t or "") < 2000] + [(None, "z z z z z z z"), (7, "b b b b b b b")]
    got = periodic_runs.periodic_runs(frame(spark, rows).repartition(3), exponent, least).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected_runs(i, split(t), exponent, least) for i, t in rows), key=repr)


def test_planted_runs_and_long_texts(spark):
    rows = list(enumerate(run_texts()))
    docs = frame(spark, [*rows, (None, "a b c")])
    words = {r["doc_id"]: split(r["text"]) for r in periodic_runs.with_planted_runs(docs).collect()}
    assert words == {i: planted(i, t) for i, t in rows} | {None: ["a", "b", "c"]}
    long = [r for r in periodic_runs.periodic_runs(docs, with_runs=True).collect() if r["doc_id"] in (len(rows) - 2, len(rows) - 1)]
    assert [(r["n_runs"], r["length"], r["period"], r["collapsed"]) for r in sorted(long)] == [(1, 4000, 1, "word"), (1, 21000, 7, "p q r s t u v")]
    assert long[0]["runs"][0]["start"] == 0


def test_op12_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    chosen = [(i, t) for i, t in rows if len(split(t)) < 800]
    assert len(chosen) > 100 and all(got[i] == expected_runs(i, planted(i, t)) for i, t in chosen)
    assert any(r[1] for r in got.values())


# spelling


def brute_words(rows, spoil=31, least_length=7, least_count=2):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def brute_groups(counts):
    """By the deletions that two words share, then by distance; another way than halves."""
    by_gap = collections.defaultdict(set)
    for w in counts:
        for v in {w} | {w[:x] + w[x + 1:] for x in range(len(w))}:
            by_gap[v].add(w)
    near = {w: set() for w in counts}
    for members in by_gap.values():
        for a in members:
            near[a] |= {b for b in members if b != a and edits(a, b) == 1}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def edits(a, b):
    row = list(range(len(b) + 1))
    for x, c in enumerate(a, 1):
        before, row[0] = row[0], x
        for y, d in enumerate(b, 1):
            before, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, before + (c != d))
    return row[-1]


def spelling_rows(seed):
    rnd = random.Random(seed)
    stems = ["running", "Läufer×ÿöx", "aaaaaaa", "abababab", "international", "zzzzzzzz", "éééééééé"] + ["".join(rnd.choice("ab") for _ in range(rnd.randint(7, 10))) for _ in range(12)]

    def vary(w):
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
            at = rnd.randint(0, len(w))
            w = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice("abzé") + w[at:], w[:at] + rnd.choice("abzé") + w[at + 1:]])
        return rnd.choice([w, w, w.upper() if w.isascii() else w])

    rows = [(None, None), (1, ""), (None, "running running Running_running"), (2, "1234567 中文")]
    for i in range(3, 300):
        rows.append((i, rnd.choice([" ", ", ", "\n", "9"]).join(vary(rnd.choice(stems)) for _ in range(rnd.choice([1, 20, 80])))))
    return rows + rows[20:30] + [(5000, "international " * 30_000)]


@pytest.mark.parametrize(("hot", "shard"), [(256, 30_000), (2, 100), (0, 10_000)])
def test_spelling_equals_brute_force(spark, hot, shard):
    rows = spelling_rows(3)
    got = spelling_groups.spelling_groups(frame(spark, rows).repartition(3), hot=hot, shard=shard).collect()
    want = brute_groups(brute_words(rows))
    assert len(want) > 300 and any(r[1] for r in want)
    assert sorted(map(tuple, got)) == want


def test_a_half_of_all_words_is_halved_on(spark):
    """Words that all begin alike: no automaton lists more than a few of one piece, no link is lost."""
    rnd = random.Random(1)
    words = {"shared" + "".join(rnd.choice("abcdef") for _ in range(rnd.choice([5, 6]))) for _ in range(3000)}
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {r["word"]: r["n_near"] for r in spelling_groups.neighbours(vocabulary, hot=50).collect()}
    assert got == {r[0]: r[4] for r in brute_groups(dict.fromkeys(words, 2)) if r[4]}


def test_chains_reach_their_root(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}", 10 ** (k + 1)) for k in range(12)], "word string, form string, n long")
    assert {tuple(r) for r in spelling_groups.roots(forms, 10).collect()} == {(f"w{k}", "w12") for k in range(12)}


def test_op13_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_spelling_groups(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_groups(brute_words(rows))
