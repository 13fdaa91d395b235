"""Benchmark passages in documents, found by SimHash windows of the size of each item.

For an item of L words, every window of L words of a document (the whole document, if it is shorter)
that shares a shingle with the item's benchmark is fingerprinted (SimHash over shingles by the square
roots of their weights: the cosine that it estimates then has the weights themselves). Fingerprints meet in a multi-index: two
fingerprints within ``RADIUS`` bits agree in at least one of ``BLOCKS`` blocks to ``RADIUS // BLOCKS``
bits, so looking each block up with all its near variants misses none of them. Candidates
are then compared exactly: the weight of shared shingles over the weight of all.

A benchmark is cut into blocks of ``ITEMS`` items. One block is shipped to the tasks (its size
is bounded by ``ITEMS`` and ``ITEM_WORDS``), and the documents are read once for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import lean, whole_text
from quaero.llm.words import hashed_shingles, hashed_words, shingles

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4  # of 16 bits
ITEMS = 20_000  # items of a block
BLOCK_WORDS = 4_000_000  # ... and words


@cache
def near_variants() -> np.ndarray:
    """Patterns of up to ``RADIUS // BLOCKS`` of 16 bits."""
    bits = [0]
    for k in range(1, RADIUS // BLOCKS + 1):
        bits += [sum(1 << b for b in c) for c in combinations(range(16), k)]
    return np.array(bits, dtype=np.uint16)


def fingerprints(sh: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the ``n`` shingles from each start: the sign of the weighted sum of each bit."""
    signs = np.unpackbits(sh.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    sums = np.vstack([np.zeros((1, 64)), np.cumsum((2 * signs - 1) * weights[:, None], axis=0)])
    positive = np.round(sums[starts + n] - sums[starts], 6) > 0
    return np.packbits(positive, axis=1).view(">u8").astype(np.uint64).ravel()


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        words = list(hashed_words(texts))
        keep = [k for k, w in enumerate(words) if len(w) >= SHINGLE]
        self.ids = [ids[k] for k in keep]
        self.sets = [np.unique(shingles(words[k], SHINGLE)) for k in keep]
        self.lengths = np.array([len(words[k]) for k in keep], dtype=np.int64)
        every = np.concatenate(self.sets) if keep else np.zeros(0, dtype=np.uint64)
        self.known, df = np.unique(every, return_counts=True)
        # rare shingles weigh more; one that no item holds weighs like one that a single item holds
        self.most = 1 + math.log(max(1, len(keep)))
        self.weights = 1 + np.log(max(1, len(keep)) / df)
        owner = np.repeat(np.arange(len(keep)), [len(s) for s in self.sets])
        order = np.argsort(every, kind="stable")
        self.owners = owner[order]
        self.owner_from = np.r_[0, np.cumsum(df)]
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        prints = []
        for k in keep:
            sh = shingles(words[k], SHINGLE)
            prints.append(fingerprints(sh, np.sqrt(self.weigh(sh)), np.array([0]), len(sh))[0])
        self.prints = np.array(prints, dtype=np.uint64)
        self.blocks = []  # for each block: items by value, and where each value's items begin
        for b in range(BLOCKS):
            values = self.block(self.prints, b)
            begin = np.r_[0, np.cumsum(np.bincount(values, minlength=1 << 16))]
            self.blocks.append((begin, np.argsort(values, kind="stable")))

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(16 * b)).astype(np.uint16)

    def weigh(self, sh: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(sh), self.most)
        at = np.minimum(np.searchsorted(self.known, sh), len(self.known) - 1)
        return np.where(self.known[at] == sh, self.weights[at], self.most)

    def windows(self, sh: np.ndarray) -> dict[int, np.ndarray]:
        """For each item length, the starts of windows that share a shingle with such an item."""
        near = np.flatnonzero(self.bits[(sh & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(near):
            return {}
        at = np.minimum(np.searchsorted(self.known, sh[near]), len(self.known) - 1)
        real = self.known[at] == sh[near]
        found: dict[int, list[np.ndarray]] = {}
        for p, a in zip(near[real], at[real]):
            owners = self.owners[self.owner_from[a] : self.owner_from[a + 1]]
            for length in np.unique(self.lengths[owners]):
                n = min(length - SHINGLE + 1, len(sh))
                found.setdefault(int(length), []).append((max(0, p - n + 1), min(p, len(sh) - n)))
        out = {}
        for length, spans in found.items():
            edge = np.zeros(len(sh) + 1, dtype=np.int64)
            for a, b in spans:
                if a <= b:
                    edge[a] += 1
                    edge[b + 1] -= 1
            out[length] = np.flatnonzero(np.cumsum(edge))
        return out

    def candidates(self, prints: np.ndarray, length: int) -> set[tuple[int, int]]:
        """(window, item) pairs within the radius, by the multi-index."""
        pairs = set()
        for b, (begin, items) in enumerate(self.blocks):
            used = begin[1:] > begin[:-1]
            probes = self.block(prints, b)[:, None] ^ near_variants()[None, :]
            for w, v in zip(*np.nonzero(used[probes])):
                value = int(probes[w, v])
                for item in items[begin[value] : begin[value + 1]]:
                    if self.lengths[item] == length and int(prints[w] ^ self.prints[item]).bit_count() <= RADIUS:
                        pairs.add((int(w), int(item)))
        return pairs

    def similarity(self, window: np.ndarray, item: int) -> float:
        own = self.sets[item]
        shared = np.intersect1d(window, own)
        both = self.weigh(shared).sum()
        return float(both / (self.weigh(np.unique(window)).sum() + self.weigh(own).sum() - both))

    def search(self, sh: np.ndarray) -> list[tuple]:
        """``(item, first word, words, similarity)`` of the best window of each item among shingles."""
        best: dict[int, tuple[float, int]] = {}
        roots = np.sqrt(self.weigh(sh))
        for length, starts in (self.windows(sh) if len(self.known) and len(sh) else {}).items():
            n = min(length - SHINGLE + 1, len(sh))
            for at in range(0, len(starts), 256):
                some = starts[at : at + 256]
                low, high = some[0], some[-1] + n
                part = sh[low:high] if high - low <= 64 * (256 + n) else None
                if part is None:  # windows far apart
                    prints = np.concatenate([fingerprints(sh[s : s + n], roots[s : s + n], np.array([0]), n) for s in some])
                else:
                    prints = fingerprints(part, roots[low:high], some - low, n)
                for w, item in self.candidates(prints, length):
                    s = int(some[w])
                    score = self.similarity(sh[s : s + n], item)
                    if score >= SIMILARITY and (item not in best or (-score, s) < (-best[item][0], best[item][1])):
                        best[item] = (score, s)
        return sorted(
            ((self.ids[i], s, min(int(self.lengths[i]), len(sh) + SHINGLE - 1), score) for i, (score, s) in best.items()),
            key=lambda x: (x[1], str(x[0])),
        )


def _blocks(items: DataFrame, id: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of bounded size, one on the driver at a time."""
    ids, texts, n = [], [], 0
    chosen = items.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    for r in chosen.orderBy("i", "t").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        n += len(r["t"]) // 4
        if len(ids) >= ITEMS or n >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


MATCHES = "array<struct<item_id:long,first_word:long,n_words:long,similarity:double>>"


def _search(block: Broadcast):
    @F.pandas_udf(MATCHES)
    @lean
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(*block.value)
        names = ("item_id", "first_word", "n_words", "similarity")
        for series in batches:
            words = hashed_shingles(series, SHINGLE, False)
            yield pd.Series([[dict(zip(names, m)) for m in items.search(sh)] for sh in words], dtype=object)

    return search


def benchmark_matches(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "matches",
) -> DataFrame:
    """All rows and columns, and ``matches``: the benchmark items found in the text, and where.

    A column named like ``out`` is replaced. Null and empty texts have no matches (an empty array),
    nor has any text when the benchmark is empty. Items without text or of fewer than ``SHINGLE``
    words are not searched for. Repeated rows stay; repeated items are all reported.
    """
    sc = df.sparkSession.sparkContext
    # each block is bounded by ITEMS and BLOCK_WORDS
    blocks = [sc.broadcast(block) for block in _blocks(benchmark, item_id, item_text)]
    found = [_search(block)(whole_text(text)) for block in blocks]
    none = F.array().cast(MATCHES)
    return df.withColumn(out, reduce(lambda a, b: F.concat(a, b), found, none))
