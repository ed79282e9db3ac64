import hashlib
import random

import numpy as np

from isoreach.llm import suffixes as sx


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            key = sx.LAST if i is None else i
            first[s] = min(first.get(s, key), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (sx.LAST if i is None else i):
                gone[p : p + 50] = True
        g = np.concatenate([[False], gone])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((-1 if i is None else i, len(b), int(gone.sum()), int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def case():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcd é") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 70, 120, 400)]
    rows = [(i, text(r.choice([0, 10, 49, 50, 200])) + "".join(r.choice(shared) + text(r.choice([0, 1, 30])) for _ in range(r.choice([0, 1, 2, 3])))) for i in range(100, 60, -1)]
    base = text(600)
    for i in range(15):
        at = r.randrange(590)
        rows.append((i * 7, base[:at] + "X" + base[at + 1 :]))
    rows += [(200 + i, base) for i in range(5)]
    rows += [(5, None), (6, ""), (3, "x" * 300), (2, "x" * 60), (9, "ab" * 100), (9, "ab" * 100), (None, base), (1000, "é" * 100)]
    return rows


def test_against_brute_force(spark):
    rows = case()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, chunk string, r int").repartition(3)
    want = brute(rows)
    for kw in ({}, {"chunk": 300, "per_range": 50}):
        got = sorted(((-1 if r[0] is None else r[0]), *r[1:5]) for r in sx.spans(docs, **kw).collect())
        assert got == want
    assert sx.spans(docs.limit(0)).count() == 0


def test_blocks(monkeypatch):
    r = np.random.default_rng(0)
    b = r.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([1000, 1000, 1040, 3000, 5000])
    a, lo, hi, _ = sx.anchors(b, ends)
    monkeypatch.setattr(sx, "BLOCK", 333)
    a2, lo2, hi2, _ = sx.anchors(b, ends)
    flat = lambda a, lo, hi: [(x, p) for x, s, e in zip(a, lo, hi, strict=True) for p in range(s, e + 1)]
    assert flat(a, lo, hi) == flat(a2, lo2, hi2)
    assert all(0 <= x - p <= 24 for x, p in flat(a, lo, hi))


def test_merge_and_front_coding():
    r = random.Random(1)
    runs = []
    for _ in range(7):
        keys = sorted({bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(0, 40))})
        runs.append(sx.front_decode(sx.front_code(keys)))
        assert runs[-1][0] == keys
    out = list(sx.merge(runs))
    assert [o[0] for o in out] == sorted(k for ks, _ in runs for k in ks)
    for (x, *_), (y, _, _, n) in zip(out[:-1], out[1:], strict=True):
        common = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert n == common
    assert list(sx.merge([])) == [] and list(sx.merge([([], [])])) == []
