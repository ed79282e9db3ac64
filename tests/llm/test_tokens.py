import numpy as np

from isoreach.llm import tokens


def brute(ids):
    out, n = [], 0
    for x in ids:
        if x == tokens.EOD:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] * (n > 0)


def test_flat_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    cases = [[], [tokens.EOD], [1], [tokens.EOD] * 9, [1] * 40, [*[1] * 23, tokens.EOD, *[2] * 30, tokens.EOD], *[np.where(rng.random(90) < p, tokens.EOD, 7).tolist() for p in (0.02, 0.1, 0.5)]]
    sizes = {}
    for i, c in enumerate(cases):
        (tmp_path / f"f{i}").write_bytes(np.array(c, "<u2").tobytes())
        sizes[f"file://{tmp_path}/f{i}"] = 2 * len(c)
    files = spark.createDataFrame(list(sizes.items()), "file string, size long")
    for block in (1, 4, 10, 100):
        got: dict = {}
        for r in tokens.count(tokens.read_flat(files, block)).collect():
            got.setdefault(r["file"], {})[r["ordinal"]] = r["n_tokens"]
        for (p, _), c in zip(sizes.items(), cases, strict=True):
            have = got.get(p, {})
            assert [have[k] for k in range(len(have))] == brute(c), (block, c)


def test_documents(spark, monkeypatch):
    rows = [(1, None, "a"), (2, "", "b"), (3, "the cat <|endoftext|> sat" * 50, "c"), (3, "the cat", "d"), (None, "x", None), (7, "Éé 😀 " * 3000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    enc = tokens.encoding()
    want = sorted((r[0] or 0, len(enc.encode_ordinary(r[1] or ""))) for r in rows)
    for block in (16, tokens.BLOCK):
        assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.token_counts(docs, block=block).collect()) == want
    assert tokens.token_counts(docs.limit(0)).count() == 0
    many = spark.range(500).selectExpr("id AS doc_id", "repeat('tok ', cast(id % 37 as int)) AS text")
    files, order = tokens.pack(many.coalesce(1), file=1000)
    paths = {r["file"]: r["size"] for r in files.collect()}
    assert len(paths) > 3
    for p, n in paths.items():  # true flat files: ids and separators, nothing else
        ids = np.fromfile(p.removeprefix("file://"), "<u2")
        want = [len(enc.encode_ordinary("tok " * (r["doc_id"] % 37))) for r in order.filter(order.file == p).orderBy("ordinal").collect()]
        assert 2 * len(ids) == n and brute(ids.tolist()) == want
    got = {r["doc_id"]: r["n_tokens"] for r in order.join(tokens.count(tokens.read_flat(files, 8)), ["file", "ordinal"]).collect()}
    assert got == {i: len(enc.encode_ordinary("tok " * (i % 37))) for i in range(500)}
