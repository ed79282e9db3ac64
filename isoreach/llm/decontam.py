"""Benchmark decontamination by SimHash windows.

Words are lower-cased and stripped of punctuation at their ends; shingles are
five words. Over a document slides a window of each item's size in words, or of
the whole document where that is shorter, and gets a SimHash of its shingles.
An index of eight Hamming blocks of eight bits finds all items within RADIUS
bits: at most RADIUS / 8 bits differ in one of the blocks, and a table holds,
for each byte, the items that near. What it finds is verified by the exact
weighted Jaccard similarity of the shingles.

Only windows that share a shingle with the item can reach any similarity above
zero, so windows are laid around shared shingles alone; none else is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.common import CACHES, map_arrow, materialize

WIDTH, LEAST, RADIUS = 5, 0.8, 23
#: Words of benchmark items that one pass holds; more items are passed in blocks.
ITEM_WORDS = 2_000_000
CACHE = 80_000
#: Pairs of window and item that are marked at once.
_CELLS = 1 << 21
_STRIP = " .,;:!?'\"()[]{}«»“”‘’…-"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_seen: dict[str, int] = {}
CACHES.append(_seen)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word; words of punctuation alone count as words."""
    words = (text or "").lower().split()
    if len(_seen) > CACHE:
        _seen.clear()
    out = []
    for w in words:
        h = _seen.get(w)
        if h is None:
            h = _seen[w] = xxhash.xxh64_intdigest((w.strip(_STRIP) or w).encode())
        out.append(h)
    return np.array(out, np.uint64)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash of each run of ``width`` words; of the whole where it is shorter."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(width, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        h += words[j : len(words) - n + 1 + j] * _MIX[j % 5]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def windows(sh: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of sh[s : s + size] for each start, by running counts of the bits."""
    lo, hi = int(starts.min()), int(starts.max()) + size
    bits = np.unpackbits(sh[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    run = np.zeros((hi - lo + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=run[1:])
    sums = run[starts - lo + size] - run[starts - lo]
    return np.packbits(sums * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


_POP = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class Index:
    """Items by size in words, with their fingerprints in Hamming blocks."""

    def __init__(self, items: list[tuple[int, np.ndarray]], radius: int = RADIUS, width: int = WIDTH) -> None:
        self.radius, self.width = radius, width
        self.items = [(i, w, shingles(w, width)) for i, w in items if len(w)]
        size = np.array([len(w) for _, w, _ in self.items], np.int64)
        self.kinds = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
        self.fps = np.array([int(windows(s, np.zeros(1, np.int64), len(s))[0]) for _, _, s in self.items], np.uint64)
        near = radius // 8
        self.tables = {n: [_POP[:, (self.fps[k] >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)] <= near for b in range(8)] for n, k in self.kinds.items()}
        # shared shingles, by the shingle's width: short items are shingles of their own length
        self.seeds = {}
        for w in sorted({min(width, int(n)) for n in self.kinds}):
            mine = [j for j, x in enumerate(self.items) if min(width, len(x[1])) == w]
            flat = np.concatenate([self.items[j][2] for j in mine])
            of = np.repeat(size[mine], [len(self.items[j][2]) for j in mine])
            order = np.lexsort((of, flat))
            flat, of = flat[order], of[order]
            first = np.ones(len(flat), bool)
            first[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
            flat, of = flat[first], of[first]
            bloom = np.zeros(1 << 22, bool)
            bloom[flat & np.uint64((1 << 22) - 1)] = True
            self.seeds[w] = (flat, of, bloom)

    def candidates(self, fps: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, Hamming distance) of all items of n words within the radius."""
        out, step = [], max(1, _CELLS // len(self.kinds[n]))
        for s in range(0, len(fps), step):
            part = fps[s : s + step]
            hit = np.zeros((len(part), len(self.kinds[n])), bool)
            for b, t in enumerate(self.tables[n]):
                hit |= t[(part >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)]
            w, i = np.nonzero(hit)
            i = self.kinds[n][i]
            d = np.bitwise_count(part[w] ^ self.fps[i])
            ok = d <= self.radius
            out.append((w[ok] + s, i[ok], d[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def search(self, words: np.ndarray, least: float = LEAST) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, Hamming distance, similarity): of each item the best windows that don't overlap."""
        found = []
        for w, (flat, of, bloom) in self.seeds.items():
            if len(words) < w:
                continue
            sh = shingles(words, w)
            maybe = np.flatnonzero(bloom[sh & np.uint64((1 << 22) - 1)])
            lo, hi = np.searchsorted(flat, sh[maybe], "left"), np.searchsorted(flat, sh[maybe], "right")
            maybe, lo, hi = (x[hi > lo] for x in (maybe, lo, hi))
            if not len(maybe):
                continue
            reps = hi - lo
            place = np.repeat(maybe, reps)
            sizes = of[np.repeat(lo - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
            for n in np.unique(sizes).tolist():
                m = min(n - w + 1, len(sh))  # shingles of a window: the whole document where it is shorter than the item
                if m < least * (n - w + 1):
                    continue
                size = m + w - 1
                p = place[sizes == n]
                cover = np.zeros(len(sh) + 1, np.int32)
                np.add.at(cover, np.maximum(p - m + 1, 0), 1)
                np.add.at(cover, p + 1, -1)
                starts = np.flatnonzero(np.cumsum(cover[:-1])[: len(sh) - m + 1] > 0)
                for i in range(0, len(starts), 20_000):
                    s = starts[i : i + 20_000]
                    for part in np.split(s, np.flatnonzero(np.diff(s) > 4 * m) + 1):
                        if len(part):
                            for x, j, d in zip(*self.candidates(windows(sh, part, m), n), strict=True):
                                a = int(part[x])
                                sim = similarity(sh[a : a + m], self.items[j][2])
                                if sim >= least:
                                    found.append((int(j), a, size, int(d), sim))
        out: list[tuple[int, int, int, int, float]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for j, a, n, d, sim in sorted(found, key=lambda f: (-f[4], f[1], f[0])):
            if all(a >= e or a + n <= b for b, e in taken.get(j, [])):
                taken.setdefault(j, []).append((a, a + n))
                out.append((self.items[j][0], a, n, d, sim))
        return out


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, hamming, similarity) of every benchmark passage in every whole text.

    Items come to the driver in blocks of at most about ``item_words`` words,
    each block against all documents. Items and texts that are null or have no
    words match nothing; items of under five words match as a whole; repeated
    rows of docs give repeated rows, repeated items give a row each.
    """
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text IS NOT NULL")
    words = b.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-words // item_words) or 1
    idt = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", "text")

    def against(items: list[tuple[int, np.ndarray]]) -> DataFrame:
        held: list[Index] = []

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if not held:
                held.append(Index(items, radius))
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    for r in held[0].search(word_hashes(t), least):
                        at.append(i)
                        rows.append(r)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())))], ["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"])

        return map_arrow(d, run, f"doc_id {idt}, item_id long, first_word long, n_words int, hamming int, similarity double")

    out = None
    if blocks > 1:  # dealt by row, for many rows may have one id
        b = materialize(b.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "items")
    for k in range(blocks):
        part = b if blocks == 1 else b.filter(F.col("block") == k)
        found = against([(r["item_id"], word_hashes(r["text"])) for r in part.collect()])
        out = found if out is None else out.unionByName(found)
    return out
