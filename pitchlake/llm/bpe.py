"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The corpus's words are counted over all documents; the most frequent are encoded once and compiled into a
minimal acyclic automaton: words share prefixes and suffixes, and the number of words that a path leaves
behind is its word's number, which indexes the ids (the outputs). Tasks memory-map the compiled lexicon
and look up all unknown words of a batch together; a word that isn't in it is merged exactly by rank.

Reads tokenizer files of the BPE kind with word ends: normaliser NFC, white space to one space, lower case;
words split by the file's pattern; bytes as characters; ``end_of_word_suffix``; no decoder, so that decoding
joins the tokens by spaces. Special tokens of the file are cut out of the raw text first.

Defined results: null texts are empty and have no ids; repeated rows are encoded each; very long texts are
encoded whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import materialise

#: White space for str.split() that the tokenizers' \s doesn't know.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"\s+")
# The tokenizers' classes are those of Unicode 16, the ``regex`` module's those of Unicode 17, and lower
# case is Unicode 17's there and Unicode 15's in Python.
#: Letters and numbers of Unicode 17 that Unicode 16 hasn't.
NEWER_RANGES = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER = regex.compile("[" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in NEWER_RANGES.split()) + "]")
#: Lower case of capitals that Python doesn't know.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Words that a task remembers before it starts anew.
REMEMBER = 1_000_000
#: Texts whose new words are learnt together.
TOGETHER = 1000
#: Cells of a matrix of words that are merged together, and bytes beyond which a word is merged by itself.
CELLS, LONG = 1 << 22, 4096
#: The rank of a pair that no merge has.
NEVER = 1 << 40


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b) or chr(b) for b in range(256)]


class Model:
    """What a tokenizer file says."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = (tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"])
        pairs = list(merges)
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        splits = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in splits if s["type"] == "Split"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        characters = byte_characters()
        self.byte_ids = np.array([self.vocab[c] for c in characters])
        self.end_ids = np.array([self.vocab[c + self.end] for c in characters])
        self.size = max(self.vocab.values()) + 1
        codes = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs] or [-1], np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs] or [-1], np.int64)
        self.code_rank = np.argsort(codes, kind="stable")
        self.codes = codes[self.code_rank]
        tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self.merged_ids(words)]

    def merged_ids(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words together: in each word always the pair of lowest rank, the leftmost first.

        The ids of each word as little-endian unsigned 32-bit integers.
        """
        out: list = [self.merge_long(w).tobytes() if len(w) > LONG else None for w in words]
        order = sorted((i for i in range(len(words)) if out[i] is None), key=lambda i: len(words[i]))  # words of like length side by side
        while order:
            width = len(words[order[-1]])
            n = max(1, min(8192, CELLS // (width + 1)))
            part, order = order[-n:], order[:-n]
            symbols = np.full((len(part), width + 1), -1, np.int64)
            ends = np.array([len(words[i]) for i in part]) - 1
            inside = np.arange(width + 1) <= ends[:, None]
            symbols[inside] = self.byte_ids[np.frombuffer(b"".join([words[i] for i in part]), np.uint8)]
            last = np.array([words[i][-1] for i in part])
            symbols[np.arange(len(part)), ends] = self.end_ids[last]
            ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
            rows = np.arange(len(part))
            columns = np.arange(width + 1)
            while True:
                best = ranks[rows].argmin(axis=1)
                rank = ranks[rows, best]
                some = rank < NEVER
                rows, best, rank = rows[some], best[some], rank[some]
                if not len(rows):
                    break
                moved = np.minimum(columns + (columns > best[:, None]), width)  # what follows the pair moves up
                now = np.take_along_axis(symbols[rows], moved, axis=1)
                now[np.arange(len(rows)), best] = self.merged[rank]
                now[:, -1] = -1
                symbols[rows] = now
                new = np.take_along_axis(ranks[rows], np.minimum(moved[:, :-1], width - 1), axis=1)
                at = np.arange(len(rows))
                new[at, best] = self._ranks(now[at, best], now[at, best + 1])
                before = np.maximum(best - 1, 0)
                new[at, before] = np.where(best > 0, self._ranks(now[at, before], now[at, before + 1]), new[at, before])
                new[:, -1] = NEVER
                ranks[rows] = new
            some = symbols >= 0
            ids, ends = symbols[some].astype("<u4").tobytes(), (4 * np.cumsum(some.sum(axis=1))).tolist()
            for i, a, b in zip(part, [0, *ends], ends):
                out[i] = ids[a:b]
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length: a heap of pairs over a linked list, n log n steps."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        ids[-1] = self.end_ids[word[-1]]
        n = len(ids)
        heap = [(rank, i) for i, rank in enumerate(self._ranks(ids[:-1], ids[1:]).tolist()) if rank < NEVER]
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        by_code = dict(zip(self.codes.tolist(), self.code_rank.tolist()))

        def rank_at(i: int) -> int:
            return by_code.get(ids[i] * self.size + ids[after[i]], NEVER) if i >= 0 and after[i] < n else NEVER

        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or rank_at(i) != rank:
                continue  # one of the pair has been merged since
            gone = after[i]
            ids[i], ids[gone], after[i] = int(self.merged[rank]), -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if (new := rank_at(at)) < NEVER:
                    heapq.heappush(heap, (new, at))
        return np.array([x for x in ids if x >= 0], "<u4")

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NEVER where it isn't merged."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.code_rank[at], NEVER)

    def words(self, chunk: str) -> list[bytes]:
        """The words of a piece of text without white space or special tokens."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # letter by letter: no final sigma
            chunk = chunk.translate(LOWER)
            if NEWER.search(chunk):
                known = NEWER.sub("\ue000", chunk)  # a character of no class, as the tokenizers see them
                return [chunk[m.start():m.end()].encode() for m in self.pattern.finditer(known)]
        return [w.encode() for w in self.pattern.findall(chunk.lower())]

    def pieces(self, chunk: str) -> list:
        """Words (bytes) and ids of special tokens (int) of a chunk between white space."""
        if self.cut is None or "<" not in chunk:
            return self.words(chunk)
        out: list = []
        for part in self.cut.split(chunk):
            out += [self.special[part]] if part in self.special else self.words(part)
        return out


def load(path: str) -> Model:
    with open(path, encoding="utf-8") as f:
        return Model(json.load(f))


def chunks(text: str) -> list[str]:
    """The text between white space, as the tokenizer understands white space."""
    return [c for c in SPACE.split(text) if c] if SEPARATORS.search(text) else text.split()


# --- the lexicon -----------------------------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton over the sorted words, with outputs, as flat arrays.

    State s has the arcs first[s] to first[s+1]: label, target, and how many words precede those beyond it
    (``before``). A word's number is the sum of ``before`` over its arcs; out_at[number] points into its ids.
    """
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)) of minimised states

    def freeze(node: list) -> int:
        key = (node[0], tuple((label, child) for label, child in node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in ordered:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for i in range(len(last), common, -1):  # what the new word doesn't share is complete
            state = freeze(path.pop())
            path[-1][1][-1] = (last[i - 1], state)
        for label in word[common:]:
            path[-1][1].append((label, None))
            path.append([False, []])
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        state = freeze(path.pop())
        path[-1][1][-1] = (last[i - 1], state)
    root = freeze(path[0])
    below = np.zeros(len(states), np.int32)  # children come before their parents
    first, labels, targets, before = [0], [], [], []
    for s, (final, arcs) in enumerate(states):
        n = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            before.append(n)
            n += below[target]
        below[s] = n
        first.append(len(labels))
    out_at = np.concatenate(([0], np.cumsum([len(words[w]) for w in ordered])))
    out = np.array([i for w in ordered for i in words[w]], np.int32)
    # arcs as a hash-free lookup: sorted keys state * 256 + label
    keys = np.repeat(np.arange(len(states)), np.diff(first)).astype(np.int64) * 256 + np.array(labels, np.int64)
    arrays = [keys, np.array(targets, np.int32), np.array(before, np.int32), np.array([s[0] for s in states], np.uint8), out_at.astype(np.int32), out, np.array([root], np.int32)]
    head = json.dumps([[str(a.dtype), len(a)] for a in arrays]).encode()
    body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)
    return len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8) + body


class Lexicon:
    """A compiled lexicon, memory-mapped from an unnamed file of this task's own."""

    def __init__(self, compiled: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(compiled)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        at, arrays = 8 + n + (-n % 8), []
        for kind, length in json.loads(self.map[8:8 + n]):
            arrays.append(np.frombuffer(self.map, kind, length, at))
            at += arrays[-1].nbytes + (-arrays[-1].nbytes % 8)
        self.keys, self.targets, self.before, self.final, self.out_at, self.out, self.root = arrays
        self.at, self.bytes = (4 * self.out_at).tolist(), self.out.astype("<u4").tobytes()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon doesn't have it; all words walk together."""
        n = len(words)
        state, number = np.full(n, self.root[0], np.int64), np.zeros(n, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        alive = np.flatnonzero(lengths > 0)
        step = 0
        while len(alive) and len(self.keys):
            key = state[alive] * 256 + data[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            state[alive[~known]] = -1
            alive, arc = alive[known], arc[known]
            state[alive] = self.targets[arc]
            number[alive] += self.before[arc]
            step += 1
            alive = alive[lengths[alive] > step]
        ok = (state >= 0) & (lengths > 0)
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok, number, -1)

    def ids(self, number: int) -> bytes:
        return self.bytes[self.at[number]:self.at[number + 1]]


class Encoder:
    """Encodes the chunks of texts; remembers those it has seen."""

    def __init__(self, model: Model, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon
        self.known: dict[str, bytes] = {}

    def learn(self, unseen: list[str]) -> None:
        pieces = [self.model.pieces(c) for c in unseen]
        words = list({w for p in pieces for w in p if not isinstance(w, int)})
        numbers = self.lexicon.numbers(words).tolist()
        ids = {w: self.lexicon.ids(n) for w, n in zip(words, numbers) if n >= 0}
        rare = [w for w, n in zip(words, numbers) if n < 0]
        ids.update(zip(rare, self.model.merged_ids(rare)))
        for chunk, p in zip(unseen, pieces):
            if len(p) == 1 and not isinstance(p[0], int):
                self.known[chunk] = ids[p[0]]
                continue
            self.known[chunk] = b"".join([ids[w] if not isinstance(w, int) else w.to_bytes(4, "little") for w in p])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; what is new in all of them is learnt together."""
        parts = [chunks(t) for t in texts]
        unseen = set().union(*parts) - self.known.keys()
        if len(self.known) + len(unseen) > REMEMBER:
            self.known.clear()
            unseen = set().union(*parts)
        self.learn(list(unseen))
        for p in parts:
            yield b"".join(map(self.known.__getitem__, p))


def decode(model: Model, ids: bytes) -> str:
    return " ".join(map(model.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


# --- the jobs --------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): how often each word occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = load(path), Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in seen.items():
                for w in model.pieces(chunk):
                    if not isinstance(w, int):
                        words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(chunks(text))
            if len(seen) > REMEMBER:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, path: str, n_words: int) -> bytes:
    """At most ``n_words`` of the most frequent words of all texts, compiled: what the driver and the broadcast hold is bounded by it.

    The bound is a least count, from the histogram of counts, so that no task sends more words than are used.
    """
    counts = materialise(word_counts(docs, path), "words")
    so_far = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    least = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("words", F.sum("words").over(so_far)).where(F.col("words") <= n_words).agg(F.min("n")).first()[0]
    words = [bytes(r["word"]) for r in counts.where(F.col("n") >= least).select("word").collect()] if least is not None else []
    return compile_lexicon({w: ids.tolist() for w, ids in zip(words, load(path).merge(words))})


def encode_documents(docs: DataFrame, path: str, n_words: int = 32_768, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, carried columns]), one row per row of ``docs``."""
    compiled = docs.sparkSession.sparkContext.broadcast(frequent_lexicon(docs, path, n_words))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if with_ids else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(load(path), Lexicon(compiled.value))
            for first in range(0, batch.num_rows, TOGETHER):
                rows, part = [], batch.slice(first, TOGETHER)
                texts = [text or "" for text in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    decoded = decode(encoder.model, ids)
                    rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([ids] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), types)), *part.columns[2:]], names=[*names, *carry])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    carried = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *carry).mapInArrow(encode, schema + carried)
