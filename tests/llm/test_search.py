"""Exact top-k, lexical search and whitening against brute force, and on the odd cases that their docstrings define."""
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import inner_products, lexical, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows, parts=5):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS).repartition(parts)


def brute_products(rows, asks, k=5, scale=256):
    """All pairs of rows with different ids, of one dimension, ranked for each query id."""
    fine = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    pairs = {}
    for q, a in fine:
        if asks(q):
            pairs.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))
    return {(q, r + 1, i, -s) for q, found in pairs.items() for r, (s, i) in enumerate(sorted(found)[:k])}


def products(df, k=5, scale=256.0):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in inner_products.top_products(df, F.col("vec_id") % 10 == 0, k, scale).collect()}


def test_products_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((400, 12))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    sets = {
        "like lengths": unit,
        "lengths over four decades": unit * 10 ** rng.uniform(-2, 2, 400)[:, None],
        "tight clusters": unit[rng.integers(0, 6, 400)] + rng.normal(0, 0.003, (400, 12)),
        "small integers, many ties": rng.integers(-2, 3, (400, 3)) / 256,
        "all negative products": np.abs(unit) * np.where(np.arange(400) % 10 == 0, -1, 1)[:, None],
    }
    for name, values in sets.items():
        rows = list(enumerate(values.tolist()))
        assert products(vectors(spark, rows)) == brute_products(rows, lambda q: q % 10 == 0), name


def test_products_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    same = rng.standard_normal(4)
    rows = [(i, same) for i in range(60)]  # a vector that fills most of the table, and asks
    rows += [(20, same), (21, same), (21, same), (30, rng.standard_normal(4))]  # ids that repeat
    rows += [(100, None), (101, [1, None, 2, 3]), (110, [1, float("nan"), 2, 3]), (120, [float("inf"), 0, 0, 0])]
    rows += [(130, [0, 0, 0, 0]), (131, [0, 0, 0, 0]), (140, [1.0, 2.0]), (141, [3.0, 1.0]), (150, []), (151, [])]
    rows += [(None, [1, 1, 1, 1]), (160, [3e6, -2e6, 1e6, 5e5]), (161, [2.5e6, 1e6, 1e6, 1e6])]
    df = vectors(spark, rows).withColumns({"id": F.lit("x"), "values": F.lit(1), "floor": F.lit(None).cast("int")})
    assert products(df) == brute_products(rows, lambda q: q % 10 == 0)
    assert products(df, k=200) == brute_products(rows, lambda q: q % 10 == 0, k=200)
    assert products(df.limit(0)) == set()
    big = vectors(spark, [(0, [3e38, 3e38]), (1, [3e38, 3e38]), (2, [-3e38, 0.0])])
    assert products(big) == {(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 2)}


def test_products_in_groups_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(inner_products, "GROUP_BYTES", 500)
    monkeypatch.setattr(inner_products, "ROWS", 32)
    monkeypatch.setattr(inner_products, "FEW", 8)
    rng = np.random.default_rng(5)
    rows = list(enumerate((rng.standard_normal((300, 6)) * rng.uniform(0.1, 2, (300, 1))).tolist()))
    assert products(vectors(spark, rows)) == brute_products(rows, lambda q: q % 10 == 0)


def test_both_ways_of_pruning_are_taken():
    rng = np.random.default_rng(6)
    values = rng.standard_normal((512, 8))
    values = np.round(600 * values / np.linalg.norm(values, axis=1)[:, None]).astype("<i8")
    values[500:] = values[0] + rng.integers(-3, 4, (12, 8))
    lengths = np.sqrt((values**2).sum(1).astype(float))
    order = np.argsort(-lengths)
    bucket = inner_products.Bucket(8, np.arange(512, dtype="<i8")[order].tobytes(), lengths[order].tobytes(), values[order].astype("<i2").tobytes())
    group = {"ids": np.array([1000, 1001]), "lengths": lengths[[0, 5]], "values": values[[0, 5]]}
    exact = np.sort(values[[0, 5]] @ values.T, axis=1)[:, ::-1]
    for floors, way in ((exact[:, 4], {"coordinates"}), (np.full(2, 1), {"length"})):
        best, ways = inner_products.Best(floors, 5), set()
        inner_products.scan(bucket, group, best, ways.add)
        assert (best.scores == exact[:, :5]).all()
        assert way <= ways


def test_rows_that_leave_a_bucket(spark):
    """A query meets no bucket whose greatest length is below what its floor needs."""
    rng = np.random.default_rng(7)
    far, near = rng.uniform(5, 6, (40, 4)), rng.uniform(0.1, 0.2, (600, 4))
    rows = list(enumerate(np.concatenate([far, near]).tolist()))
    assert products(vectors(spark, rows)) == brute_products(rows, lambda q: q % 10 == 0)


TERM = re.compile(lexical.TERM)


def brute_ranks(texts, items, k, once=True):
    def terms(t):
        return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in texts]
    counts = [c for c in counts if c[2]]
    n_docs, total = len(counts), sum(c[2] for c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum((1 if once else times) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, times in wanted.items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def ranks(spark, texts, items, k, parts=3, **more):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts).withColumns({"score": F.lit("x"), "item_id": F.lit(1), "id": F.lit(2)})
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "term": F.lit("x")})
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.rank_documents(docs, wanted, k, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    names = ["Alpha", "beta", "γάμμα", "ÀB", "x1", "don't", "a_b", "naïve", "é", "THE", "the", "of", "zz z", "日本"]
    weight = 1 / np.arange(1, len(names) + 1)
    texts = [(i, " ".join(rng.choice(names, rng.integers(1, 60), p=weight / weight.sum()))) for i in range(200)]
    texts += [(i, texts[7][1]) for i in range(200, 260)]  # copies, so ties
    texts += [(300, None), (301, ""), (302, " ,;- "), (303, "the " * 5000), (7, "beta beta"), (7, "beta beta"), (None, "Alpha beta"), (None, texts[7][1])]
    items = [(0, "alpha the OF"), (1, "the the the beta"), (2, "naïve-x1, γάμμα"), (3, None), (4, "!?"), (5, "unknown"), (6, "é"), (6, "日本 é"), (None, "àb ÀB")]
    return texts, items


def test_ranks_equal_brute_force(spark, corpus):
    texts, items = corpus
    for k in (1, 50, 1000):
        assert ranks(spark, texts, items, k) == brute_ranks(texts, items, k)
    assert ranks(spark, texts, items, 20, once=False) == brute_ranks(texts, items, 20, once=False)


def test_ranks_in_small_blocks_pieces_and_groups(spark, corpus, monkeypatch):
    texts, items = corpus
    for name, value in (("DOCUMENTS", 7), ("ENTRIES", 40), ("PIECE", 11), ("GROUP_BYTES", 64)):
        monkeypatch.setattr(lexical, name, value)
    assert ranks(spark, texts, items, 10) == brute_ranks(texts, items, 10)


def test_ranks_of_empty_tables(spark, corpus):
    texts, items = corpus
    assert ranks(spark, [], items, 5) == [] == ranks(spark, texts, [], 5)


def test_impacts_beyond_64_bits():
    sizes = np.array([10**9, 5])
    got = lexical.impacts(np.array([3, 3]), sizes, np.array([7, 7]), 10**12, 10**13)
    assert got.tolist() == [7 * (3 * 10**9 // (3000 + 20 * (50 + 50 * n * 10**12 // 10**13))) for n in sizes.tolist()]


def plain_whitening(rows, m):
    x = np.floor(64 * rows.astype(float)).astype("i8") + 1_000_000
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(0)
    c = (n * u - sums) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), ((n * x - sums) / n) @ q[:, :m] / np.sqrt(e[:m]), e[:m] / e.sum()


def check_whitened(df, rows, m):
    n, deviation, whitened, explained = plain_whitening(rows, m)
    got = df.orderBy("vec_id", "component").toPandas()
    assert got.component.tolist() == list(range(1, m + 1)) * len(rows)
    assert set(got.n) == {n}
    assert (got.deviation.to_numpy().reshape(-1, m) == deviation[:, None]).all()
    w = got.whitened.to_numpy().reshape(-1, m)
    assert np.abs(w * np.sign((w * whitened).sum(0)) - whitened).max() < 1e-9
    assert np.abs(got.explained.to_numpy().reshape(-1, m) / explained - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_equals_a_plain_eigensolver(spark):
    rng = np.random.default_rng(9)
    rows = (rng.standard_normal((500, 40)) * 1.15 ** np.arange(40) @ np.linalg.qr(rng.standard_normal((40, 40)))[0]).astype("f4")
    rows[100:300] = rows[0]  # copies count once in the fit, and are whitened each
    check_whitened(whitening.whiten(vectors(spark, list(enumerate(rows.tolist())))), rows, 16)
    check_whitened(whitening.whiten(vectors(spark, list(enumerate(rows[:, :5].tolist()))), components=16), rows[:, :5], 5)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(10)
    good = rng.standard_normal((50, 6)).astype("f4")
    rows = list(enumerate(good.tolist())) + [(60, None), (61, [1, None, 1, 1, 1, 1]), (62, [float("nan")] * 6), (63, [float("-inf")] * 6), (64, [1.0, 2.0]), (65, [])]
    df = vectors(spark, rows).withColumns({"n": F.lit("x"), "component": F.lit(1), "v": F.lit(2), "x": F.lit(3)})
    check_whitened(whitening.whiten(df), good, 6)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(0, [1, 2]), (1, [1, 2])])).count() == 0  # no variance
    assert whitening.whiten(vectors(spark, [(0, []), (1, None)])).count() == 0
    line = whitening.whiten(vectors(spark, [(0, [1, 2]), (1, [2, 4]), (None, [3, 6]), (1, [2, 4])])).collect()  # variance along one line
    assert {r.component for r in line} == {1} and len(line) == 4 and {r.n for r in line} == {3}
    assert abs(line[0].explained - 1) < 1e-12
    huge = whitening.whiten(vectors(spark, [(0, [1e30, 1]), (1, [0, 2]), (2, [0, 3])])).collect()
    assert {r.vec_id: r.deviation for r in huge} == {0: None, 1: None, 2: None} and all(math.isfinite(r.whitened) for r in huge)


def test_block_lanczos_on_hard_spectra():
    rng = np.random.default_rng(11)
    turn = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    spectra = {
        "flat": np.linspace(1.2, 1, 400),
        "fast": 0.8 ** np.arange(400),
        "low rank, so blocks vanish": np.r_[[5, 5, 5, 2, 1], np.zeros(395)],
        "clusters": np.r_[np.full(30, 3.0), np.full(370, 1.0)],
    }
    for name, values in spectra.items():
        matrix = (turn * values) @ turn.T
        found, vectors_, passes = whitening.block_lanczos(lambda b, m=matrix: m @ b, 400, 8, width=10, basis_blocks=6)
        assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-10, name
        assert np.abs(vectors_.T @ vectors_ - np.eye(8)).max() < 1e-10, name
        assert np.linalg.norm(matrix @ vectors_ - vectors_ * found, axis=0).max() < 1e-8, name
