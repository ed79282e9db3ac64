import re

import numpy as np
import xxhash

from isoreach.llm import simhash


def brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 3 and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def compare(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = {r[0]: brute_fp(r[1]) for r in rows}
    label = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", label[i]) for i in fps}


def test_documents(spark):
    base = [f"word{i} Alpha{i * 7 % 13}" for i in range(80)]
    rows = [(1, " ".join(base), "x", 1), (2, " ".join(base), None, 2), (3, " ".join([*base[:-1], "changed"]), "", 3), (4, None, "x", None), (5, "", "x", 4), (6, " \t\n ", "x", 4), (7, "one", "", 1), (8, "One  TWO", "", 1), (9, "ÄRGER Ünder É", "", 0), (10, "a b c " * 3000, "", 0)]
    compare(spark, rows)
    compare(spark, [])
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    compare(spark, [(r["doc_id"], r["text"], "", 0) for r in sample])


def test_long_text_in_blocks(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 997) for i in range(5000))
    want = simhash.fingerprints_of([text])
    monkeypatch.setattr(simhash, "_BLOCK", 500)
    assert simhash.fingerprints_of([text, b"", text]).tolist() == [want[0], 0, want[0]]


def test_links_with_long_lists(spark, monkeypatch):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds[:8]:
        for _ in range(12):
            x = int(s)
            for b in rng.integers(0, 63, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = dict(enumerate(sorted(fps)))
    want = brute_components(fps)
    for most in (1024, 3):
        monkeypatch.setattr(simhash, "MOST", most)
        monkeypatch.setattr(simhash._first, "__module__", "local", raising=False)
        nodes = spark.createDataFrame([(f, i) for i, f in fps.items()], "fp long, node long")
        comp = {r[0]: r[1] for r in simhash.components(simhash.links(nodes)).collect()}
        assert {i: comp.get(i, i) for i in fps} == want


def test_forest24_is_forest():
    rng = np.random.default_rng(2)
    v = np.unique(rng.integers(0, 1 << 11, 60)).astype(np.uint32)
    n = rng.permutation(len(v)).astype(np.int64)
    a, b = simhash.forest(v.astype(np.uint64), n), simhash.forest24(v, n)
    assert dict(zip(*map(list, a), strict=True)) == dict(zip(*map(list, b), strict=True))


def test_components_of_long_paths(spark):
    """A path of nodes in mixed order, a hub of many, and their hub joins by broadcast."""
    rng = np.random.default_rng(3)
    order = rng.permutation(400).tolist()
    edges = list(zip(order[:-1], order[1:], strict=True)) + [(1000, k) for k in range(1001, 1300)]
    got = {r[0]: r[1] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 400), 0), **dict.fromkeys(range(1001, 1300), 1000)}


def test_hot_join(spark, monkeypatch):
    """Keys over the bound meet a broadcast, the others a shuffle; inner and left give what a plain join gives."""
    from isoreach.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    big = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(60)] + [(99, 1), (None, 2)], "k long, x long")
    small = big.filter("k <> 99").groupBy("k").agg({"x": "min", "*": "count"}).toDF("k", "n", "low")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "k", how).select("k", "x", "n", "low").collect()))
        assert sorted(map(str, common.hot_join(big, small, "k", "n", how).select("k", "x", "n", "low").collect())) == want
