"""Fits the ensemble of `pii.py`: python -m lanewise.llm.pii_training writes pii_model.json.

The sample is made by rule (SAMPLE lines, the bound): half hold personal data in many formats, half look-alikes such as order numbers, versions,
and dates, with and without words around that tell. Every fifth line is held out; it sets each kind's threshold, the least at which
precision is MIN_PRECISION.
"""
from __future__ import annotations

import json
import random
from pathlib import Path

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.pii import FEATURES, GENERATORS, features, probability
from lanewise.llm.spans import matches

SAMPLE = 12_000
TREES, DEPTH = 12, 4
MIN_PRECISION = 0.98
SEED = 5


def sample_line(rng: random.Random) -> tuple[str, str, int]:
    """Kind, text, label."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))

    def card(good: bool) -> str:
        while True:
            d = rng.choice("3456" if good else "0123456789") + digits(rng.choice((15, 15, 15, 13, 12)))
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            if (total % 10 == 0) == good:
                return d

    s = rng.choice((" ", "-", "."))
    good = rng.random() < 0.5
    kind = rng.choice(("phone", "email", "ip", "card", "ssn", "iban"))
    if kind == "phone":
        body = rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{s}{digits(3)}{s}{digits(4)}", f"0{digits(2)}{s}{digits(4)}{s}{digits(4)}"))
        cue, other = ("phone", "call", "tel", "mobile", "fax"), ("order", "part", "serial", "score", "lot")
        if not good:
            body = rng.choice((body, f"{digits(4)} {digits(4)}", f"{digits(4)}-{digits(3)}", f"{digits(3)} {digits(3)} {digits(3)}"))
    elif kind == "email":
        at, dot = rng.choice((("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), (" [at] ", "."), (" [AT] ", " [DOT] "), ("(AT)", "."), (" AT ", " DOT ")))
        body = f"{word()}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}" if good else f"{word()} at {word()}. {word()}"
        cue, other = ("mail", "contact", "write to", "reach"), ("page", "line", "model", "batch")
    elif kind == "ip":
        group = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 4) if good else 2))
        words = ("add", "bead", "cafe", "dead", "face", "feed", "fade", "abc", "bad")
        body = ":".join(group() for _ in range(8))
        if rng.random() < 0.6:  # around a double colon; look-alikes are names of code
            front, back = rng.randint(1, 4), rng.randint(1, 3)
            body = f"{rng.choice(('2001', '2a02', 'fe80', 'fd00', group()))}:{':'.join(group() for _ in range(front))}::{':'.join(group() for _ in range(back))}" if good else f"{rng.choice(words)}::{rng.choice(words)}"
        cue, other = ("host", "server", "address"), ("serial", "build", "batch", "version")
    elif kind == "card":
        body = card(good)
        body = rng.choice((body, " ".join(body[i : i + 4] for i in range(0, len(body), 4))))
        cue, other = ("card", "visa", "credit"), ("tracking", "isbn", "serial", "invoice")
    elif kind == "ssn":
        body = f"{digits(3)}-{digits(2)}-{digits(4)}"
        cue, other = ("ssn", "social", "security"), ("part", "order", "ref", "model")
    else:
        body = rng.choice(("DE", "FR", "GB", "ES")) + digits(2) + "".join(" " + digits(4) for _ in range(4 if good else 2))
        cue, other = ("iban", "account", "bank"), ("part", "serial", "lot")
    hint = rng.choice(cue if good else other) + rng.choice((" ", ": ", " no ")) if rng.random() < 0.6 else ""
    if kind in ("ssn", "phone") and not hint:
        good = good and kind == "phone" and body.startswith("(")
    return kind, f"{prose()} {hint}{body} {prose()}", int(good)


def candidates(spark: SparkSession, n: int = SAMPLE) -> DataFrame:
    rng = random.Random(SEED)
    lines = spark.createDataFrame([(i, *sample_line(rng)) for i in range(n)], "id int, kind string, text string, label int")
    out = None
    for kind, pattern in GENERATORS:
        # Every generator proposes on every line, so that parts of another kind's numbers are look-alikes too.
        own = (F.col("kind") == kind).cast("int") * F.col("label")
        rows = lines.select("id", F.lit(kind).alias("kind"), own.alias("label"), F.explode(matches(F.col("text"), pattern)).alias("x"))
        values = features(F.lit(kind), F.col("x"))
        rows = rows.select("id", "kind", F.col("label").cast("double").alias("label"), F.struct(*[values[f].alias(f) for f in FEATURES]).alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out


def as_dict(node) -> dict:
    if node.subtreeDepth() == 0:
        return {"p": round(node.prediction(), 4)}
    split = node.split()
    return {"f": FEATURES[split.featureIndex()], "t": round(split.threshold(), 4), "l": as_dict(node.leftChild()), "r": as_dict(node.rightChild())}


def fit(spark: SparkSession, n: int = SAMPLE) -> dict:
    rows = candidates(spark, n).withColumn("features", array_to_vector(F.array(*[F.col("v")[f] for f in FEATURES]))).cache()
    train = rows.filter("id % 5 > 0")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=SEED).fit(train)
    out = {"weights": [round(w, 4) for w in model.treeWeights], "trees": [as_dict(t._call_java("rootNode")) for t in model.trees], "thresholds": {}}
    held = rows.filter("id % 5 = 0").withColumn("p", probability(F.col("v"), out)).select("kind", "label", "p").collect()
    for kind, _ in GENERATORS:
        own = sorted(((r.p, r.label) for r in held if r.kind == kind), reverse=True)
        good, best = 0, 1.01
        for i, (p, label) in enumerate(own):
            good += label
            if (i + 1 == len(own) or own[i + 1][0] < p) and good >= MIN_PRECISION * (i + 1):
                best = p
        out["thresholds"][kind] = int(best * 1e4) / 1e4
        found = [label for p, label in own if p >= out["thresholds"][kind]]
        print(kind, len(own), "held out; threshold", out["thresholds"][kind], "precision", sum(found) / max(1, len(found)), "recall", sum(found) / max(1, sum(x for _, x in own)))
    return out


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    (Path(__file__).parent / "pii_model.json").write_text(json.dumps(fit(session), indent=1) + "\n")
