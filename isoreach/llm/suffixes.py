"""Exact substring deduplication by a merge of sorted suffix runs.

Two equal strings of LENGTH bytes hold equal GRAM-byte strings at the same
place, and so agree on the one whose hash is least: their anchor. A suffix is
needed at anchors only, about one byte in thirteen, with as much text around it
as the strings that chose it. Steps, none of which gathers more than a chunk or
a hash range:

1. Documents are packed into chunks. A chunk sends the sorted hashes of its
   anchors, delta-coded, to hash ranges, and learns which occur elsewhere.
2. It sends the suffixes at those, sorted, each distinct one once with its
   least document, front-coded.
3. A range merges the runs of all chunks with a loser tree that knows how much
   of each head equals the last output and compares from there on only.
   Equal suffixes meet; within a gram, strings that lie differently in their
   suffixes are compared as well.
4. A chunk learns which strings of its suffixes stand in a smaller document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.common import CACHES, map_arrow, map_batches, materialize, texts_of

LENGTH, GRAM = 50, 26
SPAN = LENGTH - GRAM + 1
#: Bytes of a chunk, windows hashed at once, anchors of a hash range.
CHUNK, BLOCK, RANGE = 4 << 20, 1 << 18, 1 << 18
FULL = (1 << SPAN) - 1
#: Stands for a null id: larger than all ids.
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []
CACHES.append(_powers)


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(n, np.uint64)
            p[1:] = x & 0xFFFFFFFFFFFFFFFF
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(b: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` items of b (unsigned integers)."""
    n = len(b) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _pow(len(b) + 1)
    p = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=p[1:])
    h = (p[size:] - p[:-size]) * down[:n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w."""
    size, m = 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size :]) if size < w else m


def anchors(b: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, hash of 40 bits) of the windows of ``length`` items within documents that end at ``ends``."""
    n, out = len(b) - length + 1, []
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.diff(np.concatenate([[0], ends]))
    inside = np.repeat(ends, sizes) - np.arange(len(b)) >= length
    low = np.uint64((1 << 24) - 1)
    for s in range(0, n, BLOCK):
        e = min(n, s + BLOCK)
        h = gram_hashes(b[s : e + length - 1], gram)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        m = window_min(key, length - gram + 1)
        p = np.flatnonzero(inside[s:e])
        if not len(p):
            continue
        a = (m[p] & low).astype(np.int64)
        cut = np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]) - 1
        out.append((a[first] + s, p[first] + s, p[last] + s, (h[a[first]] >> np.uint64(24)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def _pack(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _unpack(data: bytes) -> bytes:
    return zstandard.decompress(data)


def pack(docs: DataFrame, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, ids, sizes, data): whole documents in chunks of about ``chunk`` bytes, written to the shared folder, so that a chunk stays what it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        total = 0

        def row() -> pa.RecordBatch:
            ids, sizes = (np.array(x, np.int64).tobytes() for x in zip(*((i, len(t)) for i, t in held), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.binary()), pa.array([sizes], pa.binary()), pa.array([_pack(b"".join([t for _, t in held]))], pa.binary())], ["chunk", "ids", "sizes", "data"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts_of(b, "text"), strict=True):
                held.append((LAST if i is None else i, t))
                total += len(t)
                if total >= chunk or len(held) >= 200_000:
                    yield row()
                    held, total = [], 0
        if held:
            yield row()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(map_batches(d, run, "chunk string, ids binary, sizes binary, data binary"), "packed")


def unpacked(ids: bytes, sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, bytes) of a chunk."""
    return np.frombuffer(ids, np.int64), np.cumsum(np.frombuffer(sizes, np.int64)), np.frombuffer(_unpack(data), np.uint8)


def _deltas(x: np.ndarray) -> bytes:
    """A sorted array, compressed: differences, by byte planes."""
    d = np.diff(x, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8)
    return _pack(np.ascontiguousarray(d.T).tobytes())


def _undelta(b: bytes) -> np.ndarray:
    d = np.frombuffer(_unpack(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(d.T).view("<i8").ravel())


def send_hashes(h: np.ndarray, who: np.ndarray, ranges: int, bits: int = 40) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, sorted distinct hashes, flags of those of several documents) of a chunk's anchors."""
    if not len(h):
        return
    order = np.lexsort((who, h))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(h)) - 1
    many, h = who[at] != who[last], h[at]
    r = h * ranges >> bits
    cut = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):  # only ranges that it has hashes in
        yield int(r[i]), _deltas(h[i:j]), _pack(np.packbits(many[i:j]).tobytes())


def answer_hashes(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one range: which hashes of each chunk occur in another chunk or in several documents, as bits."""
    arrays = [_undelta(b) for b in pdf["h"]]
    flat = np.sort(np.concatenate(arrays))
    shared = np.unique(flat[1:][flat[1:] == flat[:-1]])
    own = [a[np.unpackbits(np.frombuffer(_unpack(m), np.uint8), count=len(a)).astype(bool)] for a, m in zip(arrays, pdf["many"], strict=True)]
    shared = np.union1d(shared, np.concatenate(own))
    out = []
    for c, a in zip(pdf["chunk"], arrays, strict=True):
        hit = a[np.isin(a, shared, assume_unique=True)]
        if len(hit):
            out.append((c, _deltas(hit)))
    return pd.DataFrame(out, columns=["chunk", "hits"])


def hits_of(blobs: list[bytes] | None) -> np.ndarray:
    return np.concatenate([_undelta(b) for b in blobs]) if blobs is not None and len(blobs) else np.zeros(0, np.int64)


class Entries:
    """The suffixes of one chunk at shared anchors: distinct ones sorted, with the least document of each."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, b: np.ndarray, hits: np.ndarray) -> None:
        a, lo, hi, h = anchors(b, ends)
        keep = np.isin(h, hits) if len(hits) else np.zeros(len(h), bool)
        self.a, self.lo, self.hi, h = (x[keep] for x in (a, lo, hi, h))
        self.doc = ids[np.searchsorted(ends, self.a, side="right")] if len(self.a) else np.zeros(0, np.int64)
        raw = b.tobytes()
        keys = [raw[a : a + GRAM] + bytes((e + LENGTH - a - GRAM, a - s)) + raw[a + GRAM : e + LENGTH] + raw[s:a][::-1] for a, s, e in zip(self.a.tolist(), self.lo.tolist(), self.hi.tolist(), strict=True)]
        self.keys = sorted(set(keys))
        place = {k: i for i, k in enumerate(self.keys)}
        self.of = np.array([place[k] for k in keys], np.int64)
        self.least = np.full(len(self.keys), LAST, np.int64)
        np.minimum.at(self.least, self.of, self.doc)
        self.hash = np.zeros(len(self.keys), np.int64)
        self.hash[self.of] = h

    def runs(self, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
        """(range, numbers of its suffixes in sorted order)."""
        r = self.hash * ranges >> 40
        order = np.argsort(r, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(r[order])) + 1):
            if len(part):
                yield int(r[part[0]]), part


def front_code(keys: list[bytes]) -> bytes:
    """Each key as the bytes that it shares with the one before, how many follow, and these."""
    out, last = [], b""
    for k in keys:
        n, m = 0, min(len(last), len(k))
        if last[: m // 2] == k[: m // 2]:
            n = m // 2
        while n < m and last[n] == k[n]:
            n += 1
        out.append(bytes((n, len(k) - n)) + k[n:])
        last = k
    return _pack(b"".join(out))


def front_decode(data: bytes) -> tuple[list[bytes], list[int]]:
    """(keys, bytes shared with the one before)."""
    raw, at, last, keys, shared = _unpack(data), 0, b"", [], []
    while at < len(raw):
        n, m = raw[at], raw[at + 1]
        last = last[:n] + raw[at + 2 : at + 2 + m]
        at += 2 + m
        keys.append(last)
        shared.append(n)
    return keys, shared


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, run, number in it, bytes shared with the output before) in order, by a loser tree.

    lcp[r] is how much of run r's head equals the last output. Of two heads the
    one with more in common is less; only where both have as much are bytes
    compared, from there on, and the loser then knows its part in common with
    the winner, which is the next output that it will be held against.
    """
    k = max(1, len(runs))
    size = 1 << (k - 1).bit_length()
    pos, lcp = [0] * size, [0] * size
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    tree = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser)."""
        hx, hy = head[x], head[y]
        if hx is None or hy is None:
            return (y, x) if hx is None else (x, y)
        lx, ly = lcp[x], lcp[y]
        if lx != ly:
            return (x, y) if lx > ly else (y, x)
        n, m = lx, min(len(hx), len(hy))
        while n < m and hx[n] == hy[n]:
            n += 1
        less = (hx[n] < hy[n]) if n < m else (len(hx) < len(hy) or len(hx) == len(hy) and x < y)
        w, lo = (x, y) if less else (y, x)
        lcp[lo] = n
        return w, lo

    win = list(range(size))
    level = size // 2
    while level:
        nxt = []
        for i in range(level):
            w, lo = play(win[2 * i], win[2 * i + 1])
            tree[level + i] = lo
            nxt.append(w)
        win, level = nxt, level // 2
    w = win[0]
    while head[w] is not None:
        yield head[w], w, pos[w], lcp[w]
        keys, shared = runs[w]
        pos[w] += 1
        if pos[w] < len(keys):
            head[w], lcp[w] = keys[pos[w]], shared[pos[w]]
        else:
            head[w] = None
        i = (size + w) // 2
        while i:
            w, tree[i] = play(w, tree[i])
            i //= 2


def _strings(key: bytes) -> list[tuple[int, bytes]]:
    """(anchor's place, string) of each window of a suffix."""
    right, left = key[GRAM], key[GRAM + 1]
    text = key[: -left - 1 : -1] + key[:GRAM] + key[GRAM + 2 : GRAM + 2 + right] if left else key[:GRAM] + key[GRAM + 2 :]
    return [(left - i, text[i : i + LENGTH]) for i in range(len(text) - LENGTH + 1)]


def judge(runs: list[tuple[list[bytes], list[int]]], docs: list[np.ndarray]) -> list[np.ndarray]:
    """For each suffix of each run: of its strings, by the anchor's place, those that stand in a smaller document than the run's least."""
    out = [np.zeros(len(k), np.int32) for k, _ in runs]
    group: list[tuple[bytes, list[tuple[int, int]]]] = []

    def close() -> None:
        least = [min(int(docs[r][i]) for r, i in m) for _, m in group]
        for (_, members), low in zip(group, least, strict=True):
            for r, i in members:
                if docs[r][i] > low:
                    out[r][i] = FULL
        if len(group) > 1 and len(set(least)) > 1:
            best: dict[tuple[int, bytes], int] = {}
            each = [_strings(k) for k, _ in group]
            for low, strings in zip(least, each, strict=True):
                for s in strings:
                    if low < best.get(s, LAST + 1):
                        best[s] = low
            for (_, members), low, strings in zip(group, least, each, strict=True):
                mask = 0
                for s in strings:
                    if best[s] < low:
                        mask |= 1 << s[0]
                for r, i in members:
                    out[r][i] |= mask

    for key, r, i, n in merge(runs):
        if group and n >= GRAM:
            if n == len(key) == len(group[-1][0]):
                group[-1][1].append((r, i))
            else:
                group.append((key, [(r, i)]))
        else:
            if group:
                close()
            group = [(key, [(r, i)])]
    if group:
        close()
    return out


def removed(ids: np.ndarray, ends: np.ndarray, b: np.ndarray, e: Entries, masks: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk are covered."""
    diff = np.zeros(len(b) + LENGTH + 1, np.int32)
    m = masks[e.of]
    m = np.where(e.doc > e.least[e.of], FULL, m)
    full = m == FULL
    np.add.at(diff, e.lo[full], 1)
    np.add.at(diff, e.hi[full] + LENGTH, -1)
    part = np.flatnonzero((m != 0) & ~full)
    for o in range(SPAN):
        p = e.a[part] - o
        ok = (m[part] >> o & 1 == 1) & (p >= e.lo[part]) & (p <= e.hi[part])
        np.add.at(diff, p[ok], 1)
        np.add.at(diff, p[ok] + LENGTH, -1)
    return np.cumsum(diff[: len(b)]) > 0


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, per_range: int = RANGE, kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept where it is wanted): of every document, what stays once the strings that also stand in a smaller document are removed.

    A null text is empty. A null id is larger than all others; rows with equal
    ids take nothing from one another. Texts of under LENGTH bytes stay whole.
    """
    packed = pack(docs, chunk, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(8, int(total // (13 * per_range)) + 1)

    def first(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c, ids, sizes, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            i, ends, x = unpacked(ids, sizes, data)
            a, _, _, h = anchors(x, ends)
            rows = list(send_hashes(h, i[np.searchsorted(ends, a, side="right")] if len(a) else a, ranges))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([c] * len(rows)), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["r", "chunk", "h", "many"])

    sent = map_arrow(packed, first, "r int, chunk string, h binary, many binary")
    hits = materialize(sent.groupBy("r").applyInPandas(answer_hashes, "chunk string, hits binary"), "hits")
    mine = packed.join(hits.groupBy("chunk").agg(F.collect_list("hits").alias("hits")), "chunk", "left")

    def second(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c, ids, sizes, data, hit in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            e = Entries(*unpacked(ids, sizes, data), hits_of(hit))
            rows = [(r, c, front_code([e.keys[i] for i in part.tolist()]), _pack(e.least[part].tobytes())) for r, part in e.runs(ranges)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["r", "chunk", "run", "docs"])

    def third(pdf: pd.DataFrame) -> pd.DataFrame:
        runs, docs_ = [front_decode(x) for x in pdf["run"]], [np.frombuffer(_unpack(x), np.int64) for x in pdf["docs"]]
        return pd.DataFrame({"chunk": pdf["chunk"], "r": pdf["r"], "masks": [_pack(m.tobytes()) for m in judge(runs, docs_)]})

    columns = ["chunk", "ids", "sizes", "data", "hits"]
    sorted_runs = map_arrow(mine.select(*columns), second, "r int, chunk string, run binary, docs binary")
    masks = materialize(sorted_runs.groupBy("r").applyInPandas(third, "chunk string, r int, masks binary"), "masks")
    told = hits.groupBy("chunk").agg(F.collect_list("hits").alias("hits")).join(masks.groupBy("chunk").agg(F.collect_list(F.struct("r", "masks")).alias("masks")), "chunk", "left")
    last = packed.join(told, "chunk", "left").select(*columns, "masks")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept]
    types = {"kept_sha256": pa.string(), "kept": pa.binary()}

    def fourth(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, sizes, data, hit, mask in zip(*(b.column(k).to_pylist() for k in range(1, 6)), strict=True):
            i, ends, x = unpacked(ids, sizes, data)
            e = Entries(i, ends, x, hits_of(hit))
            m = np.zeros(len(e.keys), np.int32)
            got = {y["r"]: y["masks"] for y in mask or ()}
            for r, part in e.runs(ranges):
                m[part] = np.frombuffer(_unpack(got[r]), np.int32)
            gone = removed(i, ends, x, e, m)
            begin = np.concatenate([[0], ends[:-1]])
            rows = []
            for s, t in zip(begin.tolist(), ends.tolist(), strict=True):
                g = gone[s:t]
                stays = x[s:t][~g].tobytes()
                edge = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if t > s else 0
                rows.append((t - s, int(g.sum()), edge, hashlib.sha256(stays).hexdigest(), stays))
            yield pa.RecordBatch.from_arrays([pa.array(i, mask=i == LAST), *(pa.array([r[k] for r in rows], types.get(name, pa.int64())) for k, name in enumerate(names))], ["doc_id", *names])

    return map_arrow(last, fourth, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept)


def digest(docs: DataFrame) -> DataFrame:
    """spans without the bytes that stay."""
    return spans(docs, kept=False)
