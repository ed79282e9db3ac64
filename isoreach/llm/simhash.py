"""SimHash near-duplicates by an inverted index on byte positions.

A fingerprint has eight bytes. Two that differ in at most three bits share at
least five of them in place, so they share three of the first four or three of
the last four: the index keeps, for each such triple of positions, the
fingerprints by the three bytes there. Its lists are the intersections of
single-byte lists, which would each hold a 256th of all rows. In a list the
shared positional bytes of each pair are tallied, pairs with fewer than five
are dropped, and the rest is verified by Hamming distance. A list gives a
spanning forest of its links and not all pairs. A list of over MOST
fingerprints is dealt anew by five bytes; those that share five bytes differ
in 24 bits only. Short lists of those are compared pair by pair; for long ones
a table of the 24-bit values, one for all lists of a task, finds all links in
time linear in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.common import components, hot_join, map_arrow, map_batches, materialize, run_bounds, texts_of

TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Fingerprints of a list that are compared pair by pair.
MOST = 1024
RADIUS, LEAST_BYTES = 3, 5
#: Hashes whose bits are counted at once.
_BLOCK = 100_000


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of `width` words, ASCII lower case; of the whole sequence where there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(b" ".join(words), seed)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -width]]).tolist()
    return [h(joined[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def vote(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is set where over half of the run has it; an empty run gives 0."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(counts[full])[:-1]]), axis=0, dtype=np.int32)
        out[full] = np.packbits(sums * 2 > counts[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints_of(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    at, total, held, counts = 0, 0, [], []
    for i, t in enumerate(texts):
        if len(t) > 8 * _BLOCK:  # a long text is voted on block by block
            out[i] = _long(t, width, seed)
            held.append([])
        else:
            held.append(shingle_hashes(t, width, seed))
        counts.append(len(held[-1]))
        total += counts[-1]
        if total >= _BLOCK or i == len(texts) - 1:
            flat = np.array([x for h in held for x in h], np.uint64)
            votes = vote(flat, np.array(counts))
            short = np.array(counts) > 0
            out[at : i + 1][short] = votes[short]
            at, total, held, counts = i + 1, 0, [], []
    return out


def _long(text: bytes, width: int, seed: int) -> int:
    hashes = np.array(shingle_hashes(text, width, seed), np.uint64)
    sums = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        sums += np.unpackbits(hashes[i : i + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. A null text is empty and gets 0."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(texts_of(b, "text"), width, seed).view(np.int64))], ["id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, fp long")


def _byte(i: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def _keyed(fps: DataFrame) -> DataFrame:
    """A row for each list of the index that a fingerprint stands in."""
    keys = [F.lit(t << 24) + _byte(a) * 65536 + _byte(b) * 256 + _byte(c) for t, (a, b, c) in enumerate(TRIPLES)]
    return fps.select("fp", "node", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))


def forest(fps: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest linked node) that span the links of one list."""
    x = fps[:, None] ^ fps[None, :]
    shared = (np.ascontiguousarray(x).view(np.uint8).reshape(len(fps), len(fps), 8) == 0).sum(2)
    near = shared >= LEAST_BYTES
    near[near] = np.bitwise_count(x[near]) <= RADIUS
    return _spread(near, nodes)


def _spread(near: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = nodes.copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            break
        label = new
    far = label != nodes
    return nodes[far], label[far]


_FLIPS = np.array([0, *[sum(1 << b for b in c) for n in range(1, RADIUS + 1) for c in combinations(range(24), n)]], np.uint32)


def forest24(values: np.ndarray, nodes: np.ndarray, tables: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As forest, for 24-bit values: up to MOST are compared pair by pair; of more, each looks up its neighbours in a table of all values, which ``tables`` keeps for the next list."""
    if len(values) <= MOST:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= RADIUS
        return _spread(near, nodes)
    tables = [] if tables is None else tables
    if not tables:
        tables.append(np.full(1 << 24, np.iinfo(np.int64).max, np.int64))
    table = tables[0]
    np.minimum.at(table, values, nodes)
    label = table[values]
    while True:
        new = label.copy()
        for i in range(0, len(values), 4096):
            part = values[i : i + 4096, None] ^ _FLIPS[None, :]
            new[i : i + 4096] = table[part].min(1)
        if (new == label).all():
            break
        label = new
        table[values] = label
    table[values] = np.iinfo(np.int64).max
    far = label != nodes
    return nodes[far], label[far]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Key, fingerprint, node of whole runs of batches sorted by key, and where runs start; a run may span batches."""
    held: list[list[np.ndarray]] = []

    def cut(parts):
        k, f, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return k, f, n, run_bounds(k)

    for b in batches:
        if not b.num_rows:
            continue
        k, f, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        last = int(np.searchsorted(k, k[-1]))
        if last == 0 and held and held[-1][0][-1] == k[-1]:
            held.append([k, f, n])
            continue
        if held or last:
            yield cut([*held, [k[:last], f[:last], n[:last]]])
        held = [[k[last:], f[last:], n[last:]]]
    if held:
        yield cut(held)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v, 0); members of long lists as (fp, node, list + 1)."""
    for key, fp, node, at in _runs(batches):
        out: list[tuple] = []
        for i in np.flatnonzero(np.diff(at) > 1):
            f, n = fp[at[i] : at[i + 1]].view(np.uint64), node[at[i] : at[i + 1]]
            if len(f) > MOST:
                out.append((f.view(np.int64), n, np.full(len(f), (key[at[i]] >> 24) + 1)))
            else:
                u, v = forest(f, n)
                out.append((u, v, np.zeros(len(u), np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["u", "v", "kind"])


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of lists that share five bytes; the key's top byte says which, the value is in the other three."""
    tables: list[np.ndarray] = []
    for key, value, node, at in _runs(batches):
        out = [forest24(value[at[i] : at[i + 1]].astype(np.uint32), node[at[i] : at[i + 1]], tables) for i in np.flatnonzero(np.diff(at) > 1)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["u", "v"])


FIVES = list(combinations(range(8), 5))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints (fp, node) just as all pairs within three bits would."""
    first = materialize(map_batches(_keyed(nodes).repartition("key").sortWithinPartitions("key").select("key", "fp", "node"), _first, "u long, v long, kind long"), "links")
    edges = first.filter("kind = 0").select("u", "v")
    if not first.filter("kind > 0").limit(1).count():
        return edges
    long = first.filter("kind > 0").select(F.col("u").alias("fp"), F.col("v").alias("node"), "kind")
    out = []
    for t, triple in enumerate(TRIPLES):
        for n, five in enumerate(FIVES):
            if set(triple) <= set(five):
                rest = [i for i in range(8) if i not in five]
                key = sum((_byte(p) * (1 << 8 * j) for j, p in enumerate(five)), F.lit(n << 40).cast("long"))
                out.append((t + 1, F.struct(key.cast("long").alias("key"), sum((_byte(p) * (1 << 8 * j) for j, p in enumerate(rest)), F.lit(0)).cast("long").alias("value"))))
    arrays = None
    for t in range(1, len(TRIPLES) + 1):
        a = F.array(*[s for k, s in out if k == t])
        arrays = F.when(F.col("kind") == t, a) if arrays is None else arrays.when(F.col("kind") == t, a)
    keyed = long.select("node", F.explode(arrays).alias("s")).select("s.key", "s.value", "node").distinct()
    return edges.unionByName(map_batches(keyed.repartition("key").sortWithinPartitions("key"), _second, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Rows of one fingerprint are one node, named by its smallest id, so copies
    are never paired. Null texts are empty; texts without words have the
    fingerprint zero and link like any other. A null id keeps its row; where a
    fingerprint has null ids only, its component is null. Repeated ids keep a
    row each. Other columns of docs play no part.
    """
    fp = materialize(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    nodes = materialize(fp.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("rows")), "nodes")
    comp = components(links(nodes.filter("node IS NOT NULL").select("fp", "node")))
    named = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "rows")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return hot_join(fp, named, "fp", "rows").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")
