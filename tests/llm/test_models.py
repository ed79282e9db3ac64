import numpy as np
from pyspark.sql import functions as F

from isoreach.llm import langid, quality

SF = "/root/testdata/sf0.01"


def brute_path(s, penalty):
    n, k = s.shape
    v = [[s[0, j] for j in range(k)]]
    for t in range(1, n):
        v.append([max(v[-1][i] - penalty * (i != j) for i in range(k)) + s[t, j] for j in range(k)])
    return max(v[-1])


def value(s, path, penalty):
    return sum(s[t, k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path[1:], path[:-1], strict=True))


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(0, 2, (rng.integers(1, 30), 3)).astype(np.float32)
        s[len(s) // 2 :, rng.integers(0, 3)] += rng.choice([0, 2])
        m = langid.Model(["a", "b", "c"], None, None, penalty=3.0)
        assert abs(value(s, m.path(s), 3.0) - brute_path(s, 3.0)) < 1e-4


def test_viterbi_of_all_paths():
    """Few words and any penalty, the best of all paths; two stretches that pay together but not alone too."""
    import itertools

    rng = np.random.default_rng(5)
    cases = [(np.array([[2.8, -10, 0], [-10, 2.8, 0]], np.float32), 3.0)]
    for _ in range(2000):
        s = rng.normal(0, 3, (rng.integers(1, 6), rng.integers(1, 4))).round(1).astype(np.float32)
        cases.append((s, float(rng.choice([1, 3, 6]))))
    for s, penalty in cases:
        m = langid.Model(["a", "b", "c"][: s.shape[1]], None, None, penalty=penalty)
        best = max(value(s, p, penalty) for p in itertools.product(range(s.shape[1]), repeat=len(s)))
        assert abs(value(s, m.path(s), penalty) - best) < 1e-4
    assert langid.Model(["a", "b", "c"], None, None, penalty=3.0).path(cases[0][0]).tolist() == [0, 1]


def test_identify_by_brute_force(spark):
    """Each row's language and share from a path over all words by plain dynamic programming."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", F.lit(0.5).alias("score"), F.lit("x").alias("lang_pred"))
    long = " ".join(["the of and to in"] * 30_000)
    docs = docs.unionByName(spark.createDataFrame([(10**9, long, None, 0.0, ""), (10**9 + 1, "½ ② ³ 12", None, 0.0, "")], docs.schema))
    model = langid.fit(docs, langid.crc_rest("doc_id", 5) != 0)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for r in docs.collect():
        words = (r["text"] or "").lower().split()
        s, has = model.scores(words) if words else (None, np.zeros(0, bool))
        if not has.any():
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        v, back = s[0].astype(float), []
        for t in range(1, len(s)):
            step = v[:, None] - model.penalty * (1 - np.eye(len(v)))
            back.append(step.argmax(0))
            v = step.max(0) + s[t]
        k, path = int(v.argmax()), []
        for b in [*back[::-1], None]:
            path.append(k)
            k = int(b[k]) if b is not None else k
        count = np.bincount(np.array(path[::-1])[has], minlength=len(model.langs))
        assert count[model.langs.index(got[r["doc_id"]]["lang_pred"])] == count.max()
        assert 0 <= got[r["doc_id"]]["score"] <= count.max() / count.sum() + 1e-9
    assert got[10**9 + 1]["lang_pred"] == "und" and got[10**9]["lang_pred"] != "und"


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    n, right = out.filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / n > 0.97
    model = langid.fit(docs)
    de, en = (docs.filter(f"lang = '{x}' AND n_chars > 2000").orderBy("doc_id").first()["text"].split()[:120] for x in ("de", "en"))
    spans = model.spans(" ".join(en + de))
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[0][1] - 120) < 6


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 --- 4", "fr"), (4, "the cat sat", "en"), (5, "мир да", "ru"), (6, "the cat", None), (None, "the", "en"), (4, "the cat sat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"]): r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[5]["lang_pred"] == "ru" and got[6]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = docs.limit(0)
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    assert langid.identify(docs).count() == 8


def auc(y, p):
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_gradient():
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 1, (rng.integers(1, 5), quality.FEATURES)).astype(np.float32) for _ in range(300)]
    y = np.array([float(b[:, 0].max() > 1) for b in bags], np.float32)
    m = quality.train(bags, y, epochs=40)
    at = np.cumsum([0, *[len(b) for b in bags]])
    p = m.forward(np.concatenate(bags), at[:-1])["p"]
    assert auc(y, p) > 0.95  # one passage decides the bag: attention must find it


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").toPandas()
    assert auc(out["quality"].to_numpy(), out["score"].to_numpy()) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "good words here", 0), (4, "### $$$ %%%", None), (4, "### $$$ %%%", None), (None, "x " * 1000, 1)], "doc_id long, text string, quality int")
    for rows in ([], [(3, 1, 0)], [(1, 0, 0), (3, 1, 0), (4, 0, 0), (4, 0, 0), (9, None, 0), (None, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, text int")
        got = quality.classify(docs, labels).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_many_languages(spark):
    """No language is left out, however many there are and however rare it is."""
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x", f"l{i:03}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs).langs == [r[2] for r in rows]
    more = spark.range(40_000).selectExpr("id AS doc_id", "'the cat sat' AS text", "'en' AS lang").unionByName(spark.createDataFrame([(10**6, "мир", "ru")], docs.schema))
    m = langid.fit(more, fit_rows=1000)
    assert m.langs == ["en", "ru"] and m.predict("мир")[0] == "ru" and m.uses[3].tolist() == [False, True]
