"""Spelling variants: words one edit apart, found with automata over word halves.

Of two words one edit apart, one leaves a half of the other whole: its first half in front or its second half
at the end. Every word's two halves go to automaton shards by their hash; a word is sent to the shards of the
halves that it may hold (its ends, cut for words of one letter less, as many and one more). Halves are written
around a ``$``, ``$first`` and ``second$``, and the word ``w`` is scanned as ``w$w``: the mark pins a half's
offset. Hits of compatible length are verified by their distance.

A half that more than ``hot`` words hold is halved on: its words meet again by that half and half of what is
left of them (``tail$head`` in the ``w$w`` form), until the groups are small or nothing is left to halve, where
all but one letter agree. So no group is large, and no link is lost. A pair counts where the first of its
matching halves was taken at each cut, so once. Shards give one row a word: how many neighbours, and the best.

A word's form is its neighbour of largest count (ties: first in code-point order) if that is ``factor`` times
the word's own at least; counts grow by that along forms, so a few rounds of pointer doubling reach the root.

Defined results: null and empty texts have no words; null ids are written as an empty string; repeated rows
count again; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import materialise, n_tasks

MARK = "$"


def count_words(runs: str, spoil: int, least_length: int, most: int = 200_000):
    """(word, n) of a task's texts. ``spoil``: of one run in so many, by its hash with the id, a letter is deleted; 0: of none."""
    pattern = re.compile(f"{runs}{{{least_length},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found = pattern.findall(text.encode().lower().decode())  # of bytes: only A-Z
                if not spoil:
                    counts.update(found)
                else:
                    own = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), own)
                        if h % spoil == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_length:
                                continue
                        counts[word] += n
                if len(counts) > most:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return task


def word_counts(docs: DataFrame, runs: str = "[A-Za-zÀ-ÿ]", spoil: int = 31, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    parts = docs.select("doc_id", "text").mapInArrow(count_words(runs, spoil, least_length), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def halves(length: int, tail: int, head: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """A word of ``length`` letters, ``head`` in front and ``tail`` at the end taken: (tail, head) with half of the rest in front, or at the end; one letter isn't cut."""
    rest = length - tail - head
    if rest <= 1:
        return (tail, head), (tail, head)
    return (tail, head + rest // 2), (tail + rest - rest // 2, head)


def piece(word: str, tail: int, head: int) -> str:
    return f"{word[len(word) - tail:]}{MARK}{word[:head]}"


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def first_way(word: str, other: str, tail: int, head: int) -> bool:
    """Whether halving ``other``, the front first, leads to this place for ``word``."""
    at_tail, at_head = 0, 0
    while at_tail + at_head < tail + head and len(other) - at_tail - at_head > 1:
        front, back = halves(len(other), at_tail, at_head)
        fits = front[0] + front[1] <= len(word) and word[:front[1]] == other[:front[1]]
        at_tail, at_head = front if fits else back
    return (at_tail, at_head) == (tail, head)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, tail, head, listed): the next halves of each place. Listed ones are halves of the word itself, others of possible neighbours."""
    for batch in batches:
        words, counts, listed = [], [], []
        pieces, tails, heads = [], [], []
        for word, n, tail, head, own in zip(*(c.to_pylist() for c in batch.columns)):
            m = len(word)
            places = set()
            for length in (m,) if own else (m - 1, m, m + 1):
                if length - tail - head >= 0:
                    places.update(p for p in halves(length, tail, head) if sum(p) <= m and sum(p) <= length)
            for t, h in places:
                words.append(word)
                counts.append(n)
                tails.append(t)
                heads.append(h)
                listed.append(own)
                pieces.append(piece(word, t, h))
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(tails, pa.int32()), pa.array(heads, pa.int32()), pa.array(listed, pa.bool_()), pa.array(pieces, pa.string())],
            names=["word", "n", "tail", "head", "listed", "piece"],
        )


CUT = "word string, n long, tail int, head int, listed boolean, piece string"


def scan_shard(table: pa.Table) -> pa.Table:
    """(word, near, form_n, form): the words of a shard scanned by the automaton of its pieces."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    listed: dict[str, list[tuple[str, int, int, int]]] = {}
    words = set()
    for word, n, tail, head, own, text in zip(*(table.column(c).to_pylist() for c in ("word", "n", "tail", "head", "listed", "piece"))):
        if own:
            listed.setdefault(text, []).append((word, n, tail, head))
        else:
            words.add(word)
    for text, members in listed.items():
        machine.add_word(text, members)
    out = []
    if listed:
        machine.make_automaton()
        for word in words:
            m, near, best = len(word), 0, None
            for _, members in machine.iter(f"{word}{MARK}{word}"):
                for other, n, tail, head in members:
                    if -1 <= len(other) - m <= 1 and tail + head <= m and one_edit(word, other) and first_way(word, other, tail, head):
                        near += 1
                        if best is None or (-n, other) < best:
                            best = (-n, other)
            if near:
                out.append((word, near, -best[0], best[1]))
    columns = list(zip(*out)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "form_n", "form"])


def neighbours(vocabulary: DataFrame, hot: int = 256, shard: int = 30_000) -> DataFrame:
    """(word, n_near, form_n, form): of every word with neighbours, their number and the best of them.

    ``vocabulary`` (word, n) has a word once. ``hot`` and ``shard`` (rows in one automaton) change the work, never the result.
    """
    found, level = None, 0
    rows = vocabulary.select("word", "n", F.lit(0).alias("tail"), F.lit(0).alias("head"), F.explode(F.array(F.lit(True), F.lit(False))).alias("listed"))
    while True:
        pieces = materialise(rows.mapInArrow(cut, CUT), "pieces")
        # of a piece that can be cut on; where at most one letter is left, all members are neighbours of each other but for a few
        large = (
            pieces.where("listed").groupBy("piece").agg(F.count(F.lit(1)).alias("members"), F.max(F.char_length("word") - F.col("tail") - F.col("head")).alias("rest"))
            .where((F.col("members") > hot) & (F.col("rest") > 1)).select("piece")
        )
        large = materialise(large, "large", few=True)
        none_large = large.isEmpty()
        small = pieces if none_large else pieces.join(large, "piece", "left_anti")
        n_shards = max(n_tasks(vocabulary.sparkSession), math.ceil(pieces.count() / shard))
        dealt = small.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(n_shards)))
        part = dealt.groupBy("shard").applyInArrow(scan_shard, "word string, near long, form_n long, form string")
        part = materialise(part, f"near{level}")
        found = part if found is None else found.unionByName(part)
        if none_large:
            break
        rows = pieces.join(large, "piece", "left_semi").select("word", "n", "tail", "head", "listed")
        level += 1
    best = F.min(F.struct((-F.col("form_n")).alias("o"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.o")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame, factor: int) -> DataFrame:
    """(word, root) for the (word, form, n) whose words have a form."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    most = forms.agg(F.max("n")).first()[0] or 1
    # no word's count is above its form's / factor, so this many forms follow each other at most
    longest = int(math.log(most, factor)) + 2
    for _ in range(max(1, math.ceil(math.log2(longest)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        links = materialise(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "forms")
    return links


def spelling_groups(docs: DataFrame, factor: int = 10, hot: int = 256, shard: int = 30_000, **words: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word; ``words`` are parameters of ``word_counts``."""
    if factor < 2:
        raise ValueError("a form has twice its variants' count at least")
    vocabulary = materialise(word_counts(docs, **words), "words")
    near = neighbours(vocabulary, hot, shard)
    known = vocabulary.join(near, "word", "left")
    enough = F.col("form_n") >= factor * F.col("n")
    known = materialise(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n"), F.when(enough, F.col("form")).alias("form")), "known"
    )
    linked = roots(known.where("form IS NOT NULL").select("word", "form", F.col("form_n").alias("n")), factor)
    return known.join(linked, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
