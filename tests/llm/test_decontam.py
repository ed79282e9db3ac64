import random

import numpy as np
import pytest

from isoreach.llm import decontam as dc


def brute(text, items, least=0.8):
    """Documents' items that some window of the item's size resembles."""
    words = dc.word_hashes(text)
    out = set()
    for i, t in items:
        w = dc.word_hashes(t)
        for a in range(len(words) - len(w) + 1 if len(w) else 0):
            if dc.similarity(dc.shingles(words[a : a + len(w)]), dc.shingles(w)) >= least:
                out.add(i)
    return out


def case():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 5, 30, 50, 60])))) for i in range(30)]
    docs = []
    for d in range(60):
        words = [r.choice(vocab) for _ in range(r.choice([0, 10, 80, 300]))]
        if d % 2:
            item = r.choice(items)[1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                item[r.randrange(len(item))] = r.choice(vocab)
            if d % 3 == 0:
                item = [x.upper() + "," for x in item]
            at = r.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((d, " ".join(words)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    want = {(d, i) for d, t in docs for i in brute(t, items)}
    d = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, item_id long, similarity string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    rows = dc.matches(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(want) > 15
    assert all(r["similarity"] >= 0.8 and r["hamming"] <= dc.RADIUS for r in rows)
    assert sorted(map(tuple, dc.matches(d, b, item_words=100).collect())) == sorted(map(tuple, rows))


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(0)
    idx = dc.Index([(i, rng.integers(0, 1 << 63, 12, np.uint64)) for i in range(40)])
    for _ in range(50):
        flips = rng.choice(64, rng.integers(0, 30), replace=False)
        fp = idx.fps[rng.integers(0, 40)] ^ np.uint64(sum(1 << int(f) for f in flips))
        _, i, _ = idx.candidates(np.array([fp]), 12)
        assert set(i.tolist()) == {j for j in range(40) if bin(int(fp ^ idx.fps[j])).count("1") <= dc.RADIUS}


def test_edges(spark):
    p = " ".join(f"v{i}" for i in range(40))
    d = spark.createDataFrame([(1, None), (2, ""), (3, p), (3, p), (None, p), (4, "z " * 20000 + p + " z" * 20000 + " " + p), (5, "a a a a a a a a a a")], "doc_id long, text string")
    b = spark.createDataFrame([(7, p), (8, None), (9, ""), (10, "  "), (7, p), (11, "a a a a a a a")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["first_word"]) for r in dc.matches(d, b).collect())
    assert got == sorted([(3, 7, 0)] * 4 + [(0, 7, 0)] * 2 + [(4, 7, 20000)] * 2 + [(4, 7, 40040)] * 2 + [(5, 11, 0)])
    assert dc.matches(d, b.limit(0)).count() == 0 and dc.matches(d.limit(0), b).count() == 0


@pytest.mark.parametrize("n", [1, 4, 5, 9])
def test_shingles(n):
    w = dc.word_hashes(" ".join("abcdefghi"[:n]))
    assert len(dc.shingles(w)) == max(1, n - 4)


def brute_short(text, items, least=0.8):
    """As brute, with the whole document as the window where it is shorter than the item."""
    words = dc.word_hashes(text)
    out = brute(text, items, least)
    for i, t in items:
        w = dc.word_hashes(t)
        if 0 < len(words) < len(w) and dc.similarity(dc.shingles(words, min(5, len(w))), dc.shingles(w)) >= least and len(words) >= min(5, len(w)):
            out.add(i)
    return out


def test_documents_shorter_than_the_item(spark):
    r = random.Random(11)
    items = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(r.choice([4, 5, 6, 30, 50, 60])))) for i in range(20)]
    docs = []
    for i, t in items:
        words = t.split()
        for a, b in ((0, 1), (1, 0), (2, 3), (4, 7), (6, 9)):
            docs.append((len(docs), " ".join(words[a : len(words) - b])))
    want = {(d, i) for d, t in docs for i in brute_short(t, items)}
    assert len(want) > 30
    rows = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows} == want
    assert all(x["first_word"] == 0 and x["n_words"] == len(docs[x["doc_id"]][1].split()) for x in rows if (x["doc_id"], x["item_id"]) in want - {(d, i) for d, t in docs for i in brute(t, items)})
