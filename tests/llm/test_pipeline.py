"""The pipeline's stages one after another against plain Python."""
import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import minhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_equal_plain_python(spark, tmp_path):
    rng = np.random.default_rng(11)
    common = "the and of to in is that was for with".split()

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))

    clean = [prose(int(n)) for n in rng.integers(60, 200, 30)]
    near = [t + " tail" for t in clean[:4]] + clean[4:6]
    junk = ["one two", " ".join(["% $ #"] * 30), " ".join(["spam"] * 100)]
    secret = [prose(40) + " token = abcdefghijklmnop " + prose(40)]
    texts = clean + near + junk + secret + [None]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = lambda name: Counter(r.doc_id for r in seen[name])
    good = set(range(len(clean) + len(near))) | {len(texts) - 2}
    assert set(ids("quality_rules")) == good

    def shingles(t):
        w = words(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    label = {i: i for i in good}
    for i in sorted(good):
        for j in sorted(good):
            a, b = shingles(texts[i]), shingles(texts[j])
            if j < i and len(a & b) >= minhash.SIMILARITY * len(a | b):
                label = {k: min(label[i], label[j]) if v in (label[i], label[j]) else v for k, v in label.items()}
    alone = {i for i, c in label.items() if i == c}
    assert ids("near_duplicates") == Counter(alone) and ids("secret_scan") == Counter(alone)
    assert [r.text for r in seen["secret_scan"] if "<assign>" in r.text] == [re.sub("token = [a-z]+", "<assign>", secret[0])]
    assert all(r.n_chars == len(r.text) for r in seen["secret_scan"])
    size = {r.doc_id: len(words(r.text)) for r in seen["secret_scan"]}
    taken = ids("mixing")
    assert set(taken) <= alone and max(taken.values()) <= 2
    assert abs(sum(size[i] * n for i, n in taken.items()) - 1.5 * sum(size.values())) <= max(size.values())
    assert Counter(r.doc_id for r in seen["packing"] if r.piece == 0) == taken
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_stages_take_odd_rows(spark):
    """Empty tables, null ids and texts, repeated rows and columns that clash with the stages' own."""
    long = " ".join(["the and of to in"] * 9 + [f"word{i}" for i in range(60)])
    rows = [(1, long), (1, long), (None, long + " more"), (2, None), (None, None), (3, ""), (4, long.upper() + " tail " * 3)]
    odd = spark.createDataFrame([(i, t, "en", None if i == 4 else "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = odd.withColumns({c: F.lit("clash") for c in ("_key", "_row", "_at", "_copies", "size", "spans", "kept", "n_words", "key", "bucket", "_base", "length")})
    for df in (odd, clash, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "")
            got = out.collect()
            if name != "packing":
                assert out.columns == df.columns, name
            if name == "secret_scan":
                assert len(got) == df.count()
