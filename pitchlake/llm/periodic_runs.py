"""Periodic runs of words, from suffix automata whose sets of end positions are merged small to large.

A run is a stretch of words with smallest period q and at least ``exponent`` periods and ``least`` words that
can't be made longer. In the automaton of a stretch, two neighbouring end positions of one state at a distance
d not above the state's length end a square of period d. A pair of positions becomes neighbouring once, in the
state of their longest common suffix; so each state's new neighbours are looked at when its set is whole, and
a seed is extended to its run in both directions. Neighbours never have a period that isn't the smallest: a
shorter one would put another end position between them. A run of ``exponent`` periods has a seed with
(exponent - 1) * d not above the state's length, so only such seeds are taken.

Before that an exact filter cuts texts into stretches: every word of a run lies in a gram of a few words that
comes again within ``length / exponent`` words. Most prose has no such place and needs no automaton.

Defined results: null texts and texts of white space have no words and no runs; repeated rows have equal
results, null ids too; empty tables give no rows; other columns are ignored. Documents are independent, so
nothing is shuffled; memory is bounded by the longest document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import WordHashes, gram_hashes, mix, text_chunks

_hashes = WordHashes()


class Positions:
    """An ordered set of positions in blocks, so that an insertion moves few of them."""

    __slots__ = ("blocks", "heads", "size")
    BLOCK = 1024

    def __init__(self, position: int):
        self.blocks, self.heads, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> None:
        at = max(bisect_right(self.heads, position) - 1, 0)
        block = self.blocks[at]
        insort(block, position)
        self.heads[at] = block[0]
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            self.blocks[at:at + 1] = [block[:self.BLOCK], block[self.BLOCK:]]
            self.heads[at:at + 1] = [block[0], block[self.BLOCK]]

    def around(self, position: int) -> tuple[int | None, int | None]:
        """The neighbours of a member."""
        at = bisect_right(self.heads, position) - 1
        block = self.blocks[at]
        i = bisect_left(block, position)
        before = block[i - 1] if i else self.blocks[at - 1][-1] if at else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[at + 1][0] if at + 1 < len(self.blocks) else None
        return before, after


class Automaton:
    """The suffix automaton of a sequence: length, suffix link and own end position (or -1) of every state.

    A state's first transition is kept in two lists, further ones in a dictionary: most states have one.
    """

    def __init__(self, symbols: list[int]):
        self.length, self.link, self.own = [0], [-1], [-1]
        symbol, target, more = [-1], [-1], {}
        last = 0
        for position, c in enumerate(symbols):
            state = len(self.length)
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.own.append(position)
            symbol.append(-1)
            target.append(-1)
            p, last = last, state
            while p >= 0:
                if symbol[p] == c:
                    q = target[p]
                    break
                if symbol[p] < 0:
                    symbol[p], target[p] = c, state
                else:
                    others = more.setdefault(p, {})
                    q = others.setdefault(c, state)
                    if q != state:
                        break
                p = self.link[p]
            else:
                continue
            if self.length[p] + 1 == self.length[q]:
                self.link[state] = q
                continue
            twin = len(self.length)
            self.length.append(self.length[p] + 1)
            self.link.append(self.link[q])
            self.own.append(-1)
            symbol.append(symbol[q])
            target.append(target[q])
            if q in more:
                more[twin] = dict(more[q])
            while p >= 0:
                if symbol[p] == c:
                    if target[p] != q:
                        break
                    target[p] = twin
                else:
                    others = more.get(p)
                    if others is None or others.get(c) != q:
                        break
                    others[c] = twin
                p = self.link[p]
            self.link[q] = self.link[state] = twin


def seeds(symbols: list[int], exponent: int, floor: int) -> Iterator[tuple[int, int]]:
    """(period, end): squares from new neighbours in states of ``floor`` symbols at least."""
    machine = Automaton(symbols)
    lengths = np.array(machine.length)
    order = np.argsort(-lengths, kind="stable")
    sets = [Positions(p) if p >= 0 else None for p in machine.own]
    new = {}
    for state in order[:int((lengths >= floor).sum())].tolist():
        whole, length = sets[state], machine.length[state]
        for position in new.pop(state, ()):
            before, after = whole.around(position)
            if before is not None and (exponent - 1) * (position - before) <= length:
                yield position - before, position
            if after is not None and (exponent - 1) * (after - position) <= length:
                yield after - position, after
        sets[state] = None
        parent = machine.link[state]
        if machine.length[parent] < floor:
            continue
        other = sets[parent]
        if other is None:
            sets[parent] = whole
            continue
        large, small = (whole, other) if whole.size > other.size else (other, whole)
        arrived = list(small)
        for position in arrived:
            large.add(position)
        sets[parent] = large
        # what was new in the parent's set before is either in `small` or still listed
        if large is whole:
            new[parent] = arrived
        else:
            new.setdefault(parent, []).extend(arrived)


def least_match(exponent: int, least: int) -> int:
    """How many words of a run agree at least with those one period before."""
    return max(1, min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1)))


def runs_of(symbols: list[int], exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    known: dict[int, tuple[list[int], list[int]]] = {}
    found = []
    n = len(symbols)
    for period, end in seeds(symbols, exponent, least_match(exponent, least)):
        starts, ends = known.setdefault(period, ([], []))
        at = bisect_right(starts, end - period)
        if at and ends[at - 1] >= end:
            continue
        first, last = end - period, end
        while first > 0 and symbols[first - 1] == symbols[first - 1 + period]:
            first -= 1
        while last + 1 < n and symbols[last + 1] == symbols[last + 1 - period]:
            last += 1
        starts.insert(at, first)
        ends.insert(at, last)
        if last - first + 1 >= max(least, exponent * period):
            found.append((first, last - first + 1, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(symbols: np.ndarray, bounds: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(row, first, end) of the stretches that may hold runs: no run lies outside or across them."""
    k = least_match(exponent, least)
    grams = gram_hashes(symbols, k)
    if not len(grams):
        return []
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(grams))
    inside = row[start] == row[start + k - 1]
    with np.errstate(over="ignore"):
        keyed = mix(grams ^ mix(row[start].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed, kind="stable")
    same = (keyed[order][1:] == keyed[order][:-1]) & inside[order][1:] & inside[order][:-1]
    gap = np.where(same, np.diff(order), len(symbols) + 1)
    nearest = np.full(len(grams), len(symbols) + 1)
    nearest[order[:-1]] = gap
    nearest[order[1:]] = np.minimum(nearest[order[1:]], gap)
    room = sizes[row[start]]
    keep = inside & (nearest <= room // exponent)
    while True:
        edge = np.zeros(len(symbols) + 1, np.int64)
        at = np.flatnonzero(keep)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
        covered = np.cumsum(edge[:-1]) > 0
        opens = covered.copy()
        opens[1:] &= ~covered[:-1] | (row[1:] != row[:-1])
        number = np.cumsum(opens) - 1
        length = np.bincount(number[covered], minlength=number[-1] + 1 if len(number) else 0)
        still = keep.copy()
        still[at] = nearest[at] <= length[number[at]] // exponent
        if (still == keep).all():
            break
        keep = still
    first = np.flatnonzero(opens)
    return [(int(row[f]), int(f - bounds[row[f]]), int(f - bounds[row[f]] + n)) for f, n in zip(first, length[:len(first)]) if n >= least]


def run_rows(exponent: int, least: int, with_runs: bool):
    """The task: words, stretches, automata, results of each document."""

    def digest(doc: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        best, listed, gone = None, [], np.zeros(len(words), bool)
        for start, length, period in runs:
            listed.append(f"{start},{length},{period}\n")
            gone[start + period:start + length] = True
            # in order of start and period, so only a greater exponent replaces
            if best is None or length * best[2] > best[1] * period:
                best = (start, length, period)
        kept = [w for w, g in zip(words, gone.tolist()) if not g] if runs else words
        row = (
            doc, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(listed).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
        )
        return (*row, [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(kept).decode()) if with_runs else row

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    types = [pa.int64()] * 6 + [pa.string()] * 2
    if with_runs:
        names, types = [*names, "runs", "collapsed"], [*types, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, at in text_chunks(batch.column(1)):
                raw = data.tobytes()
                rows = [raw[a:b].split() for a, b in zip(at[:-1], at[1:])]  # of bytes: at exactly [\x20\x09-\x0D]+
                bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
                symbols = np.concatenate([_hashes.array(r) for r in rows])
                runs = [[] for _ in rows]
                for i, begin, end in stretches(symbols, bounds, exponent, least):
                    names_of: dict[bytes, int] = {}
                    coded = [names_of.setdefault(w, len(names_of)) for w in rows[i][begin:end]]
                    runs[i] += [(begin + s, n, p) for s, n, p in runs_of(coded, exponent, least)]
                out = [digest(ids[first + i], words, runs[i]) for i, words in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return task


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, with_runs: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs, collapsed]), one row per row.

    The single run is that of the greatest length by period; a collapsed text keeps each run's first period.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string" * with_runs
    return docs.select("doc_id", "text").mapInArrow(run_rows(exponent, least, with_runs), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where a tenth of the documents repeats some of its words to the end.

    With h the crc32 of the decimal id, g = h / 10, n words: if 10 divides h, word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8). Null ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    planned = parts.select("doc_id", "text", "words", n.alias("n"), F.when(n > 0, a).alias("a"), F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("g") % 8)).cast("int")).alias("p"))
    altered = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))),
    )
    return planned.select("doc_id", F.when(F.col("n") > 0, F.array_join(altered, " ")).otherwise(F.col("text")).alias("text"))
