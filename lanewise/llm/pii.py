"""Personal data: broad generators propose spans, boosted trees judge them. Built-in functions only.

Four base patterns with their checks (addresses, IPv4, cards by Luhn, international phones) always count. Beside them
generators with high recall propose spans that may overlap: national phones, spelled-out addresses, IPv6, card-like numbers, social
security numbers, IBANs. Each gets features of its format and of 40 characters on both sides. A small boosted ensemble, fitted by
`pii_training.py` on a bounded labelled sample and kept in `pii_model.json`, becomes one nested CASE expression a tree.
A span counts if its probability reaches the threshold calibrated for its kind; of overlapping ones the most probable stays.

Defined cases: a null or empty text has no spans; texts are read whole; repeated rows give equal results; an empty table gives an empty
result. Columns named like the added ones (email_spans, ip_spans, card_spans, phone_spans, added_spans, spans) are replaced, others stay;
redact_pii and pii_report touch none.
"""
from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import let
from lanewise.llm.spans import SPANS, apart, as_spans, listed, matches, redacted, scanned

#: Possessive, and started only where a run starts, where that changes no match: long runs cost no backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: At most 255 with any leading zeros; zeros alone are 0.
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|(?<=0))"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Eight groups, or fewer around a double colon.
IPV6 = r"(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}|(?:[0-9a-fA-F]{1,4}:){1,7}:|:(?::[0-9a-fA-F]{1,4}){1,7})"
#: Kind of the proposed span, pattern.
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?(?![0-9A-Za-z])"),
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\}|(?<=\x20)at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\[dot\]|\(dot\)|\{dot\}|(?<=\x20)dot\x20|\.)\x20?[A-Za-z]{2,12}\b"),
    ("ip", rf"(?<![0-9A-Za-z:.]){IPV6}(?![0-9A-Za-z:.]*+[0-9A-Za-z:])"),
    ("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
)
KINDS = (*BASE, "ssn", "iban")
CUES = r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|contact|e-?mail|mail|write to|reach|ssn|social|security|iban|account|bank|card|visa|mastercard|credit|host|server|address)\b"
COUNTER_CUES = r"(?i)\b(?:order|invoice|version|isbn|issn|part|serial|sku|build|lot|page|line|ref|reference|ticket|tracking|score|total|doi|batch|model|years?)\b"
FEATURES = ("digits", "letters", "length", "separators", "distinct", "luhn", "lead", "cue", "counter_cue", "digits_before", "digits_after", "is_phone", "is_email", "is_ip", "is_card", "is_ssn", "is_iban")
#: A span with its probability.
PROPOSED = "array<struct<p:double,s:int,e:int,k:string,o:int>>"
MODEL = json.loads((Path(__file__).parent / "pii_model.json").read_text())


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the check sum."""

    def check(d: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            c = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
            return acc + F.when(c > 9, c - 9).otherwise(c)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0

    return let(_digits(m), lambda d: F.when(F.length(d) > 0, check(d)).otherwise(F.lit(False)))


def base_spans(text: Column) -> dict[str, Column]:
    count = lambda m: F.length(_digits(m))
    keeps = {
        "email": (EMAIL, None),
        "ip": (IP, lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": (CARD, lambda m: count(m).between(14, 19) & luhn(m)),
        "phone": (PHONE, lambda m: count(m).between(10, 15)),
    }
    return {k: as_spans(matches(text, *keeps[k]), k, i) for i, k in enumerate(BASE)}


def features(kind: Column, x: Column) -> dict[str, Column]:
    """Format and context of a proposed span; x is an element of matches()."""
    digits = _digits(x.m)
    around = F.concat(x.before, F.lit(" | "), x.after)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    number = lambda c: c.cast("double")
    values = {
        "digits": number(F.length(digits)),
        "letters": number(F.length(F.regexp_replace(x.m, "[^A-Za-z]+", ""))),
        "length": number(F.length(x.m)),
        "separators": number(F.length(F.regexp_replace(x.m, "[A-Za-z0-9]+", ""))),
        "distinct": number(F.size(F.array_distinct(F.split(digits, "")))),
        "luhn": flag(luhn(x.m)),
        "lead": F.coalesce(F.when(F.length(digits) > 0, number(F.left(digits, F.lit(1)))), F.lit(-1.0)),
        "cue": flag(around.rlike(CUES)),
        "counter_cue": flag(around.rlike(COUNTER_CUES)),
        "digits_before": flag(x.before.rlike(r"[0-9][A-Z]{0,3}[\x20-]?$")),
        "digits_after": flag(x.after.rlike(r"^[\x20-]?[0-9]")),
    }
    return values | {f"is_{k}": flag(kind == k) for k in ("phone", "email", "ip", "card", "ssn", "iban")}


def tree_score(node: dict, values: Column) -> Column:
    """node: {"p": value} or {"f": feature, "t": threshold, "l": node, "r": node}."""
    if "p" in node:
        return F.lit(node["p"])
    return F.when(values[node["f"]] <= node["t"], tree_score(node["l"], values)).otherwise(tree_score(node["r"], values))


def probability(values: Column, model: dict) -> Column:
    total = F.lit(0.0)
    for weight, tree in zip(model["weights"], model["trees"], strict=True):
        total += F.lit(weight) * tree_score(tree, values)
    return 1 / (1 + F.exp(-2 * total))


def proposed(text: Column, model: dict) -> Column:
    """Array of struct(p, s, e, k, o) of the proposed spans that reach their kind's threshold."""

    def named(kind: str, pattern: str) -> Column:
        fields = ("s", "e", "m", "before", "after")
        return F.transform(matches(text, pattern), lambda x: F.struct(*[x[f].alias(f) for f in fields], F.lit(kind).alias("k"), F.lit(KINDS.index(kind)).alias("o")))

    def judged(x: Column) -> Column:
        values = F.struct(*[v.alias(n) for n, v in features(x.k, x).items()])
        return F.struct(let(values, lambda v: probability(v, model)).alias("p"), x.s.alias("s"), x.e.alias("e"), x.k.alias("k"), x.o.alias("o"))

    def enough(y: Column) -> Column:
        bound = F.lit(2.0)
        for kind, threshold in model["thresholds"].items():
            bound = F.when(y.k == kind, threshold).otherwise(bound)
        return y.p >= bound

    found = F.concat(*[named(k, p) for k, p in GENERATORS])
    return F.filter(F.transform(found, judged), enough).cast(PROPOSED)


def find_pii(df: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """df with email_spans, ip_spans, card_spans, phone_spans (base), added_spans and spans, their union."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({f"{k}_spans": v for k, v in base_spans(body).items()})
    base = F.concat(*[f"{k}_spans" for k in BASE])
    added = apart(proposed(body, model or MODEL), base, PROPOSED)
    out = out.withColumn("added_spans", let(added, lambda a: F.when(F.size(a) > 0, most_probable(a)).otherwise(F.array().cast(SPANS))))
    return out.withColumn("spans", F.concat(base, "added_spans").cast(SPANS))


def most_probable(found: Column) -> Column:
    """Of overlapping elements of PROPOSED the most probable stays, the next unless it overlaps one that stays, and so on.

    A walk by start parts the spans into runs that don't touch; each run is settled for itself.
    """
    order = lambda a, b: F.when(a.p > b.p, -1).when(a.p < b.p, 1).when(a.s != b.s, F.signum((a.s - b.s).cast("double")).cast("int")).otherwise(a.o - b.o)
    span = lambda x: F.struct(x.s.alias("s"), x.o.alias("o"), x.e.alias("e"), x.k.alias("k"))
    keep = lambda acc, x: F.when(F.exists(acc, lambda y: (x.s < y.e) & (y.s < x.e)), acc).otherwise(F.concat(acc, F.array(span(x))))
    settled = lambda run: F.aggregate(F.array_sort(run, order), F.array().cast(SPANS), keep)

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        ends = x.s >= state.end
        after = F.struct(F.greatest(state.end, x.e).alias("end"), F.when(ends, F.array(x)).otherwise(F.concat(state.run, F.array(x))).alias("run"))
        return after, F.when(ends & (F.size(state.run) > 0), settled(state.run)).otherwise(F.array().cast(SPANS))

    last = F.struct(F.lit(2.0).alias("p"), F.lit(2**31 - 1).alias("s"), F.lit(2**31 - 1).alias("e"), F.lit("").alias("k"), F.lit(0).alias("o"))
    by_start = F.array_sort(found, lambda a, b: F.signum((a.s - b.s).cast("double")).cast("int"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(PROPOSED).alias("run"))
    return let(F.concat(by_start, F.array(last).cast(PROPOSED)), lambda items: scanned(items, start, SPANS, step))


def redact_pii(df: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """df with every found span of text replaced by <kind>."""
    spans = find_pii(df.select(F.col(text), F.struct("*").alias("_row")), text, model)
    return spans.select(*[(redacted(F.col(text), F.col("spans")) if c == text else F.col("_row")[c]).alias(c) for c in df.columns])


def pii_report(df: DataFrame) -> DataFrame:
    """The digest columns: counts of base spans, their hash, and all spans as one string."""
    return find_pii(df.select("doc_id", "text")).select(
        "doc_id",
        *[F.size(f"{k}_spans").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.concat(*[f"{k}_spans" for k in BASE])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
