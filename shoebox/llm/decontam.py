"""Benchmark decontamination by latent semantic retrieval, verified by longest common subsequences.

The benchmark is the stated query set; it is searched against all documents in blocks of about ``BLOCK_ITEMS`` items, so
that what a task holds is bounded whatever the benchmark's size. For a block:

1. Document frequencies of its words are counted over all documents.
2. A randomised SVD (subspace iteration) of the block's TF-IDF passages gives a latent space; its products with the passages
   are summed per task and by key.
3. Every document is cut into overlapping word windows. A window's cosine with an item passage is the product of their latent
   vectors over the norm of the window's words that the block has; a window that holds the passage's own share of the product is
   a candidate, too, whatever stands beside it. Where a stretch lacks too many words of an item for a match, it is not projected.
4. Candidates are verified on the words around the window: length of the longest common subsequence with the item, or, where
   that is too short, of those with its clauses, each in a stretch of about its own length, in any order; and whether the item's
   last words (its answer) stand there in a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.llm.common import columns_of, free_name, map_batches, texts_as_bytes

BLOCK_ITEMS = 256
RANK = 256
OVERSAMPLE = 16
ROUNDS = 2
SCALES = ((32, 16), (12, 6))  # words in a window, and from one window to the next
STRETCH = 32  # windows that are projected at once
FEW = 32  # up to so many passages, words are multiplied with them before they are summed (the same product)
COSINE = 0.3
COMMON = 0.6  # share of an item's words in the common subsequence, or in those of its clauses
COMMON_WITH_ANSWER = 0.55
ANSWER_WORDS = 5
CLAUSE_WORDS = 8  # words of a clause of an item, and the share that counts for one
CLAUSE_COMMON = 0.75

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and all other than ASCII characters."""
    return text.translate(_WORDS).split()


def starts(n: int, width: int, step: int) -> np.ndarray:
    """Starts of the windows that cover n words; the last one ends with them."""
    if n <= width:
        return np.zeros(1, np.int64)
    out = np.arange(0, n - width + 1, step)
    return out if out[-1] == n - width else np.append(out, n - width)


@dataclass
class Block:
    """A block of the benchmark, its vocabulary and latent space."""

    ids: list
    items: list[list[bytes]]
    vocabulary: dict[bytes, int]
    weight: np.ndarray = field(default=None)  # idf of each word, 1 at least
    basis: np.ndarray = field(default=None)  # words x rank
    passages: dict = field(default_factory=dict)  # scale number -> (item number, unit latent vectors, their lengths before)

    @cached_property
    def times(self) -> np.ndarray:
        """(words + 1, items): how often a word stands in an item; the last row is for words outside the vocabulary."""
        out = np.zeros((len(self.vocabulary) + 1, len(self.items)), np.float32)
        for i, words in enumerate(self.items):
            np.add.at(out, ([self.vocabulary[w] for w in words], i), 1)
        return out

    @cached_property
    def scaled(self) -> np.ndarray:
        return self.weight[:, None] * self.basis

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(words) for words in self.items], np.float64)


def read_block(items: DataFrame) -> Block:
    rows = items.select("item_id", "text").collect()
    kept = [(r["item_id"], w) for r in rows if (w := words_of((r["text"] or "").encode()))]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in kept for w in ws}))}
    return Block([i for i, _ in kept], [w for _, w in kept], vocabulary)


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and how many have each word; all documents are counted."""

    def count(batches):
        known, total, n = vocabulary.keys(), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for text in texts_as_bytes(batch.column(0)):
                n += 1
                hit = known & set(words_of(text))
                if hit:
                    total[[vocabulary[w] for w in hit]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(at, len(total)), pa.int32()), "n": pa.array(np.append(total[at], n), pa.int64())})

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return int(out[-1]), out[:-1]


def _dense(passages: list[list[int]], weight: np.ndarray) -> np.ndarray:
    a = np.zeros((len(passages), len(weight)), np.float32)
    for i, p in enumerate(passages):
        np.add.at(a[i], p, weight[p])
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)


def _cut(words: list[bytes], vocabulary: dict[bytes, int], scale: tuple[int, int] = SCALES[0]) -> list[list[int]]:
    return [[vocabulary[w] for w in words[s : s + scale[0]] if w in vocabulary] for s in starts(len(words), *scale).tolist()]


def latent_space(passages: DataFrame, vocabulary: dict[bytes, int], weight: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """(words, rank) right singular vectors of the TF-IDF rows of ``passages`` (text), by randomised subspace iteration.

    Each round sums, over the passages, the products of their rows with the current basis: per task, then by word.
    """
    size = len(vocabulary)
    width = min(rank + OVERSAMPLE, size)

    def round_of(basis: np.ndarray) -> np.ndarray:
        def products(batches):
            total = np.zeros((size, width), np.float64)
            for batch in batches:
                rows = [p for text in texts_as_bytes(batch.column(0)) for p in _cut(words_of(text), vocabulary) if p]
                for at in range(0, len(rows), 256):
                    a = _dense(rows[at : at + 256], weight)
                    total += a.T @ (a @ basis)
            flat = pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * width, pa.array(total.ravel()))
            yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(size), pa.int32()), "part": flat})

        rows = passages.select("text").mapInArrow(products, "word int, part array<double>").select("word", F.posexplode("part").alias("j", "x"))
        summed = rows.groupBy("word", "j").agg(F.sum("x").alias("x")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("v"))
        out = np.zeros((size, width))
        for r in summed.select("word", "v.x").collect():
            out[r["word"]] = r["x"]
        return out

    basis = np.random.default_rng(seed).normal(size=(size, width))
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(round_of(basis))
    values, turn = np.linalg.eigh(basis.T @ round_of(basis))
    return (basis @ turn[:, ::-1][:, :rank]).astype(np.float32)


def prepare(spark: SparkSession, docs: DataFrame, items: DataFrame, rank: int = RANK) -> Block:
    """The block of ``items`` with weights from all of ``docs`` and its latent space."""
    block = read_block(items)
    if not block.items:
        return block
    n, df = document_frequencies(docs, block.vocabulary)
    block.weight = (1.0 + np.log((n + 1.0) / (df + 1.0))).astype(np.float32)
    block.basis = latent_space(items.select("text").filter("text is not null"), block.vocabulary, block.weight, rank)
    short = [len(w) < SCALES[0][0] // 2 for w in block.items]
    for k, scale in enumerate(SCALES):
        owner, rows = [], []
        for i, words in enumerate(block.items):
            if short[i] == (k == 1):
                cut = _cut(words, block.vocabulary, scale)
                owner += [i] * len(cut)
                rows += cut
        if rows:
            latent = np.stack([block.weight[p] @ block.basis[p] for p in rows])
            length = np.linalg.norm(latent, axis=1)
            block.passages[k] = (np.array(owner), (latent / np.maximum(length[:, None], 1e-9)).astype(np.float32), length)
    return block


def common_length(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        m = places.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return len(item) - (v & full).bit_count()


def clause_share(item: list[bytes], words: list[bytes]) -> float:
    """Share of an item's words in common subsequences of its clauses with stretches of one and a half clauses' length, in any
    order; a clause of which less than CLAUSE_COMMON is found counts nothing."""
    found, total = 0, len(item)
    left = total
    for a in range(0, total, CLAUSE_WORDS):
        clause = item[a : a + CLAUSE_WORDS]
        width, own = len(clause) + CLAUSE_WORDS // 2, set(clause)
        # stretches start at words of the clause; another start has no more of it
        best = max((common_length(clause, words[s : s + width]) for s, w in enumerate(words) if w in own), default=0)
        found += best if best >= CLAUSE_COMMON * len(clause) else 0
        left -= len(clause)
        if found + left < COMMON * total:
            return found / total
    return found / total


def _in_a_row(part: list[bytes], words: list[bytes]) -> bool:
    n = len(part)
    return any(words[i : i + n] == part for i in range(len(words) - n + 1))


def places_of(words: list[bytes], block: Block) -> np.ndarray:
    """Number of each word in the block's vocabulary, -1 outside of it."""
    get = block.vocabulary.get
    return np.array([get(w, -1) for w in words], np.int64)


def _norms(hit: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Norms of the weighted word counts of the windows hit[a:b]; repeated words are summed before they are squared."""
    n = b - a
    window = np.repeat(np.arange(len(n)), n)
    keys, counts = np.unique(window * len(weight) + hit[np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)], return_counts=True)
    return np.sqrt(np.bincount(keys // len(weight), (counts * weight[keys % len(weight)]) ** 2, len(n)))


def candidates(at: np.ndarray, block: Block, threshold: float = COSINE) -> dict[int, list[tuple[float, int, int]]]:
    """Item number -> (cosine, first word, stop word) of every window that reaches ``threshold``.

    Only the block's words count. The product of the latent vectors is held against the smaller one of the window's norm (then
    it is the cosine) and the passage's latent length, so no words beside a whole passage can hide it, however rare they are.
    A stretch of windows is projected only for items of which it and the words around have the share that a match needs."""
    found: dict[int, list[tuple[float, int, int]]] = {}
    for k, (owner, latent, length) in block.passages.items():
        width, step = SCALES[k]
        reach = int(block.sizes[owner].max())
        mark = np.zeros(len(block.times), bool)  # the last place is for words outside the vocabulary
        starting = starts(len(at), width, step)
        for s in range(0, len(starting), STRETCH):
            first = starting[s : s + STRETCH]
            stop = np.minimum(first + width, len(at))
            low, high = int(first[0]), int(stop[-1])
            around = at[max(0, low - reach) : high + reach]
            mark[around] = True
            chosen = np.flatnonzero((block.times[np.flatnonzero(mark)].sum(0) / block.sizes >= COMMON_WITH_ANSWER)[owner])
            mark[around] = False
            place = low + np.flatnonzero(at[low:high] >= 0)
            a, b = np.searchsorted(place, first), np.searchsorted(place, stop)
            full = np.flatnonzero(a < b)
            if not len(chosen) or not len(full):
                continue
            a, b, hit = a[full], b[full], at[place]
            terms, sides = block.scaled[hit], np.stack([a, b], 1).ravel()
            few = len(chosen) <= FEW
            if few:
                terms = terms @ latent[chosen].T
            product = np.add.reduceat(np.concatenate([terms, np.zeros((1, terms.shape[1]), np.float32)]), sides)[::2]
            if not few:
                product = product @ latent[chosen].T
            norm = _norms(hit, a, b, block.weight)
            enough = product >= threshold * np.minimum(norm[:, None], length[chosen])
            for w, j in zip(*(x.tolist() for x in np.nonzero(enough & (product > 0)))):
                at_w = full[w]
                found.setdefault(int(owner[chosen[j]]), []).append((float(product[w, j] / norm[w]), int(first[at_w]), int(stop[at_w])))
    return found


def verify(words: list[bytes], at: np.ndarray, block: Block, found: dict[int, list[tuple[float, int, int]]]) -> list[tuple]:
    """(item number, cosine, common share, answer present, first word, stop word) of the candidates that hold.

    Every window is verified; of an item's windows that hold, the one of largest share (then cosine) is returned. A window
    around which fewer words belong to the item than a match needs cannot hold and is left out before the subsequences."""
    out = []
    for i, windows in sorted(found.items()):
        item, best = block.items[i], None
        own = np.concatenate([[0], np.cumsum(block.times[at, i] > 0)])
        for cosine, a, b in windows:
            lo, hi = max(0, a - len(item)), min(len(words), b + len(item))
            if (own[hi] - own[lo]) / len(item) < COMMON_WITH_ANSWER:
                continue
            region = words[lo:hi]
            share = common_length(item, region) / len(item)
            if share < COMMON:
                share = max(share, clause_share(item, region))
            if share >= COMMON_WITH_ANSWER and (best is None or (share, cosine) > (best[2], best[1])):
                answer = _in_a_row(item[-ANSWER_WORDS:], region)
                if share >= COMMON or answer:
                    best = (i, min(cosine, 1.0), share, answer, lo, hi)
        if best:
            out.append(best)
    return out


def search_block(docs: DataFrame, block: Block, threshold: float = COSINE) -> DataFrame:
    schema = "doc_id long, item_id long, cosine double, common_share double, answer boolean, first_word long, stop_word long"
    if not block.items:
        return docs.sparkSession.createDataFrame([], schema)

    def make():
        def step(batch):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                places = places_of(words, block)
                if words and (found := candidates(places, block, threshold)):
                    rows += [(doc_id, block.ids[i], *rest) for i, *rest in verify(words, places, block, found)]
            names = [x.split()[0] for x in schema.split(", ")]
            yield {k: [r[j] for r in rows] for j, k in enumerate(names)}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, make)


def leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, threshold: float = COSINE, rank: int = RANK) -> DataFrame:
    """One row for each document row and benchmark item (row) that it contains: doc_id, item_id, cosine, common_share, answer
    and the words around the match (first_word, stop_word).

    Null or empty texts on either side match nothing. Repeated rows on either side repeat their matches; null ids are
    carried. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    blocks = max(1, -(-items.count() // block_items))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for k in range(blocks):
        found = search_block(docs, prepare(spark, docs, numbered.filter(F.col("block") == k), rank), threshold)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item; same columns.

    Rows are told apart by id and text, so a null or repeated id drops nothing else."""
    own = free_name(docs, "row_key")
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    leaked = leaks(docs.select(key.alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias(own)).distinct()
    return docs.withColumn(own, key).join(leaked, own, "left_anti").select(*columns_of(docs))
