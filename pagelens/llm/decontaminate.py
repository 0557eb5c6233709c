"""Benchmark decontamination by latent semantic retrieval.

Items and documents are cut into passages: windows of `window` words, half overlapping. A passage's
vector has the square root of the term frequency times the inverse document frequency, counted over all
documents, of the words that the benchmark has. A randomised SVD of the items' passages (Gaussian sketch,
power iterations, all products summed from per-task parts) gives the latent space; its directions with a
squared singular value under TAIL are left out, so every passage keeps at least 1 - TAIL of its squared
length. Document windows are searched in that space. They go on for half a window, so one of them holds a
copied passage whole, wherever it begins.

The score of a window is its dot product with an item's passage, over the passage's length and the smaller
of that and the window's own (its first `window` words, no words that the benchmark lacks). So a copy has 1
whatever stands around it, however many documents there are and have it, and a text that holds only a part
of a passage has its cosine. Only the latent space retrieves pairs of a window and a passage: a window is
folded and multiplied with a passage at once by the latent associations of its words, from lists without
those under FAINT. What truncation and lists take from a passage has a known length, which times the
window's bounds the loss of their product; pairs that are under the limit even with it are dropped. Before
that, windows are left out whose words could not reach the limit together.

A retrieved pair is a candidate if its latent score is at least `cosine`, or its exact sparse one, which is
computed for retrieved pairs alone and stands as the score if it reaches the limit. So truncation loses no
exact candidate and adds windows that are near a passage only in the latent space.

Candidates are checked on the words around them, if these hold enough informative words in any order: the
longest common subsequence with the item has to hold `share` of the item's words and of its informative
words, and `answer` of its last quarter, where a question's answer stands. So exact copies, and paraphrases
that keep the order of most words, are confirmed, and passages that merely share vocabulary are not.

The benchmark is read in blocks of `block_items`. Frequencies are counted once for such a block; its items
are then cut into spaces of at most `rank` passages, so short items are not lost among long ones. An item with more
passages has a space by itself.

Defined results
  * null and empty texts, and items without words, have no passage and match nothing;
  * texts are lowered; words are runs of ASCII letters and digits and of bytes over 127; whole texts count;
  * a null doc_id is searched like others (its pairs have a null doc_id); a null item_id is not searched;
  * one row for each (row of docs, item): repeated rows give repeated pairs, equal items each their own;
  * empty tables give no pairs; other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.shared import give_back, stored, text_batches
from pagelens.llm.shingles import _LOWER, bytes_of, text_parts, words

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SLOTS = 1 << 18
TAIL = 0.1
FAINT = 0.01


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = bytes_of(texts)
    return words(raw, offsets, _GAP, _LOWER)


class Vocabulary:
    """Words of a benchmark block by number, found through a slot table."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.unique(ids)
        self.slots = np.full(SLOTS, -1, np.int32)
        self.slots[(self.ids & np.uint64(SLOTS - 1)).astype(np.int64)] = np.arange(len(self.ids))
        at = self.slots[(self.ids & np.uint64(SLOTS - 1)).astype(np.int64)]
        self.crowded = np.flatnonzero(self.ids[at] != self.ids)  # share a slot with another word

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for others."""
        if not len(self.ids):
            return np.full(len(ids), -1, np.int64)
        at = self.slots[(ids & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.int64)
        wrong = np.flatnonzero((at >= 0) & (self.ids[at] != ids))
        if len(wrong):
            k = np.searchsorted(self.ids, ids[wrong])
            k = np.minimum(k, len(self.ids) - 1)
            at[wrong] = np.where(self.ids[k] == ids[wrong], k, -1)
        return at


def window_starts(count: int, window: int) -> range:
    """Starts of half overlapping windows; the last one may be shorter."""
    return range(0, max(1, count - window // 2), window // 2) if count else range(0)


def passages(numbers: np.ndarray, counts: np.ndarray, idf: np.ndarray, other: float, window: int, reach: np.ndarray | None = None, more: int = 0, shortest: float = np.inf):
    """(text, start, end, norm, w, word, weight) of the windows that hold known words.

    w, word and weight are the entries of the sparse rows: window, word number, sqrt(tf) * idf; they go on
    for `more` words, the norm does not. With `reach` (the most that an occurrence of each word adds to any
    cosine, times the norm) windows are left out in which even the sum of the reaches is under the norm and
    under `shortest`.
    """
    edges = np.concatenate([[0], np.cumsum(counts)])
    half = window // 2
    per = np.where(counts > 0, np.maximum(1, -(-(counts - half) // half)), 0)
    text = np.repeat(np.arange(len(counts)), per)
    start = edges[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * half
    end = np.minimum(start + window, edges[text + 1])
    value = np.where(numbers >= 0, np.append(idf, 0.0)[numbers], 0.0) ** 2
    known = np.concatenate([[0.0], np.cumsum(value)])
    total = known + np.concatenate([[0.0], np.cumsum(numbers < 0)]) * other**2
    norm2 = total[end] - total[start]
    keep = (norm2 > 0) & (known[end] - known[start] > 1e-9)
    end = np.minimum(start + window + more, edges[text + 1])
    if reach is not None:
        most = np.concatenate([[0.0], np.cumsum(np.append(reach, 0.0)[numbers])])
        keep &= most[end] - most[start] >= np.minimum(np.sqrt(norm2), shortest) * (1 - 1e-6)
    text, start, end, norm2 = text[keep], start[keep], end[keep], norm2[keep]
    size = end - start
    w = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size) + start[w]
    seen = numbers[at] >= 0
    key, tf = np.unique(w[seen] * (len(idf) + 1) + numbers[at[seen]], return_counts=True)
    w, word = np.divmod(key, len(idf) + 1)
    return text, start, end, np.sqrt(norm2), w, word, np.sqrt(tf) * idf[word]


def summed(w: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Sums of `rows` by ascending w."""
    out = np.zeros((count, rows.shape[1]), rows.dtype)
    if len(w):
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        out[w[head]] = np.add.reduceat(rows, head, axis=0)
    return out


class Postings:
    """Rows of passages by word: words in many passages as a matrix, the others as lists."""

    def __init__(self, w: np.ndarray, word: np.ndarray, value: np.ndarray, count: int, size: int, most: int = 12):
        held = np.bincount(word, minlength=size)
        wide = np.flatnonzero(held > most)
        self.count, self.column = count, np.full(size, -1, np.int64)
        self.column[wide] = np.arange(len(wide))
        self.matrix = np.zeros((len(wide), count), np.float32)
        many = held[word] > most
        self.matrix[self.column[word[many]], w[many]] = value[many]
        w, word, value = w[~many], word[~many], value[~many]
        order = np.argsort(word, kind="stable")
        self.passage, self.value = w[order], value[order].astype(np.float32)
        self.edges = np.concatenate([[0], np.cumsum(np.where(held > most, 0, held))])

    def products(self, w: np.ndarray, word: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
        """Dot products of `count` sparse rows with all passages."""
        wide = self.column[word] >= 0
        dense = np.zeros((count, len(self.matrix)), np.float32)
        dense[w[wide], self.column[word[wide]]] = weight[wide]
        out = dense @ self.matrix
        w, word, weight = w[~wide], word[~wide], weight[~wide]
        size = self.edges[word + 1] - self.edges[word]
        at = np.arange(size.sum()) + np.repeat(self.edges[word] - (np.cumsum(size) - size), size)
        np.add.at(out.reshape(-1), np.repeat(w, size) * self.count + self.passage[at], np.repeat(weight.astype(np.float32), size) * self.value[at])
        return out


def pair_products(w: np.ndarray, word: np.ndarray, weight: np.ndarray, r: np.ndarray, p: np.ndarray, count: int, *tables: np.ndarray) -> list[np.ndarray]:
    """For each table (words x passages) the dot products of sparse rows r (none empty) with its columns p."""
    edges, step = np.searchsorted(w, np.arange(count + 1)), 1 << 16
    out = [np.zeros(len(r), np.float32) for _ in tables]
    for k in range(0, len(r), step):
        rows = r[k : k + step]
        size = edges[rows + 1] - edges[rows]
        head = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(edges[rows] - head, size)
        column = np.repeat(p[k : k + step], size)
        for table, products in zip(tables, out):
            products[k : k + step] = np.add.reduceat(table[word[at], column] * weight[at], head)
    return out


@dataclass(frozen=True)
class Space:
    """What the tasks need to search for some items of the benchmark.

    `entries` are the passages' unit rows (passage, word, value); `postings` the latent associations without the faint
    ones, and as the word after the last the length of what these lack of each passage, in units of `spread` for each word.
    """

    vocabulary: Vocabulary
    idf: np.ndarray
    other: float
    basis: np.ndarray
    latent: np.ndarray
    length: np.ndarray
    entries: tuple[np.ndarray, np.ndarray, np.ndarray]
    postings: Postings
    spread: np.ndarray
    reach: np.ndarray
    passage_item: np.ndarray
    items: list[tuple[int, list[int]]]
    window: int
    cosine: float
    share: float
    answer: float
    informative: np.ndarray

    @cached_property
    def associations(self) -> np.ndarray:
        """Latent scores of each word with each passage."""
        return self.basis @ self.latent.T

    @cached_property
    def units(self) -> np.ndarray:
        """The passages' unit rows as columns."""
        out = np.zeros((len(self.idf), len(self.length)), np.float32)
        out[self.entries[1], self.entries[0]] = self.entries[2]
        return out

    @cached_property
    def telling(self) -> np.ndarray:
        """How often each item has each informative word; the last column is for words that the benchmark lacks."""
        out = np.zeros((len(self.items), len(self.idf) + 1), np.int32)
        for row, (_, sequence) in zip(out, self.items):
            np.add.at(row, np.array(sequence, np.int64), self.informative[np.array(sequence, np.int64)])
        return out


def lcs(a: list[int], positions: dict[int, int], length: int) -> int:
    """Length of the longest common subsequence of `a` and a text given by the bit positions of its words."""
    full = (1 << length) - 1
    s = full
    for x in a:
        m = positions.get(x)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return length - s.bit_count()


def bit_positions(text: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(text):
        out[x] = out.get(x, 0) | 1 << k
    return out


def ratio(a: list[int], item: list[int]) -> float:
    return lcs(a, bit_positions(item), len(item)) / len(item) if item else 1.0


class Check:
    """Whether words can hold the shares of an item that are asked for, in any order."""

    def __init__(self, sequence: list[int], space: Space):
        self.positions = bit_positions(sequence)
        self.telling = sum(1 << k for k, x in enumerate(sequence) if space.informative[x])
        self.least, self.least_telling = space.share * len(sequence), space.share * self.telling.bit_count()

    def possible(self, near: list[int]) -> bool:
        held = 0
        for x in self.positions.keys() & near:
            held |= self.positions[x]
        return held.bit_count() >= self.least - 1e-9 and (held & self.telling).bit_count() >= self.least_telling - 1e-9


def search(texts: pa.Array, block: list[Space]) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item_id, cosine, lcs_share, answer_share) of the confirmed pairs; the spaces of a block have one vocabulary."""
    at = 0
    for part in text_parts(texts):
        ids, counts = text_words(part)
        numbers = block[0].vocabulary.numbers(ids)
        for space in block:
            for k, *rest in search_part(numbers, counts, space):
                yield (at + k, *rest)
        at += len(part)


def most_held(numbers: np.ndarray, first: np.ndarray, last: np.ndarray, item: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """No less than the informative words of each item that the words from first to last hold, in any order."""
    out = np.zeros(len(item), np.int64)
    step = max(1, (1 << 20) // int((last - first).max(initial=1)))
    for k in range(0, len(item), step):
        a = first[k : k + step]
        size = last[k : k + step] - a
        head = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(a - head, size)
        out[k : k + step] = np.add.reduceat(telling[np.repeat(item[k : k + step], size), numbers[at]], head, dtype=np.int64)
    return out


def retrieved(norm: np.ndarray, w: np.ndarray, word: np.ndarray, weight: np.ndarray, space: Space, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, passage, score) of the candidates that the latent space retrieves, for `step` windows at a time."""
    limit = np.float32(space.cosine * (1 - 1e-3))
    for at in range(0, len(norm), step):
        a, e = np.searchsorted(w, [at, at + step])
        own, rows = norm[at : at + step].astype(np.float32), (w[a:e] - at, word[a:e], weight[a:e].astype(np.float32))
        each, whole = np.arange(len(own)), np.sqrt(np.bincount(rows[0], (rows[2] * space.spread[rows[1]]) ** 2, len(own)))
        most = space.postings.products(*(np.concatenate(c) for c in zip(rows, (each, np.full(len(own), len(space.idf)), whole))), len(own))
        r, p = np.divmod(np.flatnonzero(most >= np.minimum(limit * own[:, None], limit * space.length)), len(space.length))
        latent, exact = (v / np.minimum(own[r], space.length[p]) for v in pair_products(*rows, r, p, len(own), space.associations, space.units))
        good = np.flatnonzero((latent >= space.cosine) | (exact >= space.cosine))
        yield r[good] + at, p[good], np.where(exact >= space.cosine, exact, latent)[good]


def search_part(numbers: np.ndarray, counts: np.ndarray, space: Space) -> Iterator[tuple[int, int, float, float, float]]:
    edges = np.concatenate([[0], np.cumsum(counts)])
    if not len(space.latent):
        return
    text, start, end, norm, w, word, weight = passages(numbers, counts, space.idf, space.other, space.window, space.reach, space.window // 2, space.length.min())
    found: list[tuple[int, int, float]] = []
    checks: dict[int, Check] = {}

    def near(k: int, item: int) -> list[int]:
        """The words around window k, as far as the item goes."""
        n = len(space.items[item][1])
        return numbers[max(int(edges[text[k]]), int(start[k]) - n) : min(int(edges[text[k] + 1]), int(end[k]) + n)].tolist()

    def check(item: int) -> Check:
        if item not in checks:
            checks[item] = Check(space.items[item][1], space)
        return checks[item]

    lengths = np.array([len(sequence) for _, sequence in space.items])
    for k, p, score in retrieved(norm, w, word, weight, space):
        item = space.passage_item[p]
        first, last = np.maximum(edges[text[k]], start[k] - lengths[item]), np.minimum(edges[text[k] + 1], end[k] + lengths[item])
        good = np.flatnonzero(most_held(numbers, first, last, item, space.telling) >= space.share * space.telling.sum(axis=1)[item] - 1e-9)
        found += zip(k[good].tolist(), item[good].tolist(), score[good].tolist())
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    tried: set[tuple[int, int]] = set()
    for k, item, cos in sorted(found, key=lambda f: -f[2]):
        pair = (int(text[k]), item)
        if pair in best or (k, item) in tried:
            continue
        tried.add((k, item))
        sequence = space.items[item][1]
        n = len(sequence)
        around = near(k, item)
        if not check(item).possible(around):
            continue
        share = ratio(around, sequence)
        if share < space.share:
            continue
        telling = [x for x in sequence if space.informative[x]]
        if ratio([x for x in around if x >= 0 and space.informative[x]], telling) < space.share:
            continue
        answer = ratio(around, sequence[-max(3, n // 4) :])
        if answer >= space.answer:
            best[pair] = (min(1.0, cos), share, answer)
    for (t, item), (cos, share, answer) in best.items():
        yield t, space.items[item][0], cos, share, answer


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that have each word; one row of counts per task."""
    size = len(vocabulary.ids)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(size + 1, np.int64)
        for rb in it:
            for part in text_parts(rb.column(0)):
                ids, counts = text_words(part)
                total += len(counts)
                numbers = vocabulary.numbers(ids)
                known = numbers >= 0
                text = np.repeat(np.arange(len(counts)), counts)[known]
                seen += np.bincount(np.unique(text * (size + 1) + numbers[known]) % (size + 1), minlength=size + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([seen[:size].tolist()], pa.list_(pa.int64()))], ["total", "seen"])

    parts = docs.select(F.lower(docs["text"].cast("string")).alias("text")).mapInArrow(batches, "total long, seen array<long>")
    each = parts.select("total", F.posexplode("seen").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    df, total = np.zeros(size, np.int64), 0
    for r in each.collect():  # one row for each word of the block
        df[r["word"]], total = r["n"], r["total"]
    return total, df


def randomised_svd(items: DataFrame, size: int, entries, rank: int, iterations: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(basis, singular values) of the passage matrix A, whose rows `entries(batch)` makes in the tasks.

    Every iteration sums A'(AX) over the tasks for the current basis X and makes it orthonormal; the
    last one rotates the basis by the eigenvectors of the small matrix X'A'AX.
    """
    width = min(size, rank + 8)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]

    def product(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = np.zeros((size, width))
            for rb in it:
                count, w, word, weight = entries(rb)
                y = summed(w, x[word] * weight[:, None], count)
                np.add.at(z, word, y[w] * weight[:, None])
            used = np.flatnonzero(z.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([v.tobytes() for v in z[used].astype(np.float32)], pa.binary())], ["word", "z"])

        out = np.zeros((size, width))
        for r in items.mapInArrow(batches, "word long, z binary").toLocalIterator():  # bounded by the block's vocabulary
            out[r["word"]] += np.frombuffer(r["z"], np.float32)
        give_back()
        return out

    for _ in range(iterations):
        x = np.linalg.qr(product(x))[0]
    values, vectors = np.linalg.eigh(x.T @ product(x))
    order = np.argsort(-values)[:rank]
    return x @ vectors[:, order], np.sqrt(np.maximum(values[order], 0.0))


def counted(docs: DataFrame, block: list[tuple[int, str]]) -> tuple[Vocabulary, int, np.ndarray]:
    """The words of a block and their frequencies over all of `docs`."""
    text_batches(docs.sparkSession)
    vocabulary = Vocabulary(text_words(pa.array([t for _, t in block], pa.string()))[0])
    return vocabulary, *(document_frequencies(docs, vocabulary) if len(vocabulary.ids) else (0, np.zeros(0, np.int64)))


def by_passages(block: list[tuple[int, str]], window: int, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items that have words, in order, in runs of at most `most` passages or of one item."""
    _, counts = text_words(pa.array([t for _, t in block], pa.string()))
    run, held = [], 0
    for item, count in zip(block, counts.tolist()):
        n = len(window_starts(count, window))
        if run and held + n > most:
            yield run
            run, held = [], 0
        if n:
            run, held = [*run, item], held + n
    if run:
        yield run


def latent_space(docs: DataFrame, block: list[tuple[int, str]], window: int, rank: int, iterations: int, cosine: float, share: float, answer: float, known: tuple[Vocabulary, int, np.ndarray] | None = None) -> Space | None:
    """The truncated latent space of items; `known` has the words and frequencies, else they are counted."""
    spark = docs.sparkSession
    ids, counts = text_words(pa.array([t for _, t in block], pa.string()))
    if not len(ids):
        return None
    vocabulary, total, df = known or counted(docs, block)
    idf = np.log((total + 1.0) / (df + 1.0)) + 1e-3
    other = 0.0  # words that the benchmark lacks
    numbers = vocabulary.numbers(ids)
    edges = np.concatenate([[0], np.cumsum(counts)])
    items = [(i, numbers[a:e].tolist()) for (i, _), a, e in zip(block, edges[:-1], edges[1:])]
    table = spark.createDataFrame([(t,) for _, t in block], "text string").repartition(max(1, len(block) // 500))

    def entries(rb: pa.RecordBatch):
        got, n = text_words(rb.column(0))
        text, _, _, norm, w, word, weight = passages(vocabulary.numbers(got), n, idf, other, window)
        return len(text), w, word, weight / norm[w]

    text, _, _, norm, w, word, weight = passages(numbers, counts, idf, other, window)
    value = (weight / norm[w]).astype(np.float32)
    basis, singular = randomised_svd(table, len(vocabulary.ids), entries, len(text), iterations)
    basis = basis[:, singular**2 >= TAIL].astype(np.float32)
    latent = summed(w, basis[word] * value[:, None], len(text))
    most, lost, lists = np.zeros(len(idf)), [], []
    for k in range(0, len(text), 256):
        a, e = np.searchsorted(w, [k, k + 256])
        near = basis @ latent[k : k + 256].T
        unit = np.zeros_like(near)
        unit[word[a:e], w[a:e] - k] = value[a:e]
        most = np.maximum(most, np.maximum(np.abs(near), unit).max(axis=1))
        told = np.where(np.abs(near) >= FAINT, near, 0)
        lost.append(np.maximum(np.abs(unit - told), np.abs(near - told)))
        x, y = np.nonzero(told)
        lists.append((y + k, x, told[x, y]))
    spread = np.sqrt(np.max([d.max(axis=1) for d in lost], axis=0) + 1e-3)
    missing = np.concatenate([np.linalg.norm(d / spread[:, None], axis=0) for d in lost])
    lists.append((np.arange(len(text)), np.full(len(text), len(idf)), missing))
    postings = Postings(*(np.concatenate(c) for c in zip(*lists)), len(text), len(idf) + 1)
    return Space(vocabulary, idf, other, basis, latent, norm.astype(np.float32), (w, word, value), postings, spread, idf * most / cosine, text, items, window, cosine, share, answer, df <= 0.02 * total + 1)


def benchmark_blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks, by item_id; each block is read by itself."""
    known = benchmark.select(F.col("item_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text")).where("item_id is not null and text is not null")
    last = None
    while True:
        rest = known if last is None else known.where(F.col("item_id") > last)
        ends = rest.select("item_id").orderBy("item_id").limit(block_items).agg(F.max("item_id")).first()[0]
        if ends is None:
            return
        yield [(r["item_id"], r["text"]) for r in rest.where(F.col("item_id") <= ends).orderBy("item_id", "text").collect()]
        last = ends


def spaces(docs: DataFrame, benchmark: DataFrame, window: int, rank: int, iterations: int, cosine: float, share: float, answer: float, block_items: int) -> Iterator[list[Space]]:
    """The spaces of each block of the benchmark that has words."""
    for block in benchmark_blocks(benchmark, block_items):
        known = counted(docs, block)
        got = [latent_space(docs, run, window, rank, iterations, cosine, share, answer, known) for run in by_passages(block, window, rank)]
        if got:
            yield got


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 16, rank: int = 500, iterations: int = 2, cosine: float = 0.3, share: float = 0.6, answer: float = 0.5, block_items: int = 250
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share): one row for each document and item that it holds."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, cosine double, lcs_share double, answer_share double"
    narrow = docs.select("doc_id", F.lower(docs["text"].cast("string")).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in spaces(docs, benchmark, window, rank, iterations, cosine, share, answer, block_items):

        def batches(it: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for rb in it:
                rows = list(search(rb.column(1), block))
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        out = out.unionByName(stored(narrow.mapInArrow(batches, schema), "benchmark-leaks"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 16, rank: int = 500, iterations: int = 2, cosine: float = 0.3, share: float = 0.6, answer: float = 0.5, block_items: int = 250) -> DataFrame:
    """`docs` without the rows that hold a benchmark item; every other row stays as it is."""
    kept = docs
    for block in spaces(docs, benchmark, window, rank, iterations, cosine, share, answer, block_items):
        kept = kept.where(F.pandas_udf(clean_texts(block), "boolean")(F.lower(kept["text"].cast("string"))))
        del block  # the plan has its own copy
        give_back()
    return kept


def clean_texts(block: list[Space]):
    """A Series function: whether each text holds no item of the block."""

    def clean(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            hit = {t for t, *_ in search(pa.array(texts, pa.string(), from_pandas=True), block)}
            yield pd.Series([k not in hit for k in range(len(texts))], dtype=bool)

    clean.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return clean
