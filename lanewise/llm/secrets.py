"""Secret scans: sliding-window Shannon entropy of candidate strings by incremental counts, with an allow-list. Built-in functions only.

Three base patterns (assignments, access keys, long hex runs) always count. Beside them, candidate strings of
the hex or base-64 alphabet are scanned by a window of 20 characters. The window's counts of each character and its sum of
count * log2(count) are kept as it slides: the character that leaves and the one that enters change one count and one term each.
A string counts as a secret if its highest entropy reaches its class's threshold, after what the allow-list knows was taken out of it.

Defined cases: a null or empty text has no spans; texts are read whole; repeated rows give equal results; an empty table gives an empty
result. A candidate inside a base span adds nothing; one that reaches beyond is a span of its own. Columns named like the added ones
(assign_spans, access_spans, hex_spans, entropy_spans, spans) are replaced, others stay; redact_secrets and secrets_report touch none.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import let
from lanewise.llm.spans import FOUND, SPANS, apart, as_spans, listed, matches, redacted

#: Possessive or bounded where that changes no match, so that long runs cost no backtracking.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: The characters of candidates; a count each.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Class: (what its strings look like, least bits of a window). Tested in this order. Digits that stand among letters, three times or more,
#: part keys of one case from words and dates.
CLASSES = {
    "hex": (r"^(?:[0-9A-F]++|[0-9a-f]++)$", 3.0),
    "base64": (r"^(?=[^0-9]*+[0-9])(?=[^A-Z]*+[A-Z])(?=[^a-z]*+[a-z])", 3.9),
    "lower": (r"^(?=(?:[a-z]*+[0-9]++[a-z]){3})[a-z0-9]++$", 3.5),
    "upper": (r"^(?=(?:[A-Z]*+[0-9]++[A-Z]){3})[A-Z0-9]++$", 3.5),
}
#: Known harmless parts: placeholders, alphabets, the canonical form of UUIDs; and known harmless wholes: numbers and paths.
ALLOW = r"(?i)example|placeholder|changeme|lorem|abcdefgh|01234567|12345678|xxxxxx+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|^[0-9_=/+-]++$|^/?(?:[A-Za-z_-]++/)+[A-Za-z_-]*+$"


def _term(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def _least(codes: Column, window: int) -> Column:
    """The least sum of count * log2(count) among the windows of an array of places in ALPHABET, at least one window long."""
    places = F.sequence(F.lit(1), F.lit(len(ALPHABET)))
    first = F.slice(codes, 1, window)
    counts = F.transform(places, lambda c: F.size(F.filter(first, lambda x: x == c)))

    def step(acc: Column, i: Column) -> Column:
        gone, come = F.get(codes, i), F.get(codes, i + window)

        def moved(x: Column) -> Column:
            """x: counts before of the character that leaves and, without that one, of the character that enters."""
            total = acc.total - (_term(x.out) - _term(x.out - 1)) + (_term(x.into + 1) - _term(x.into))
            counts = F.transform(acc.counts, lambda n, c: n - (c + 1 == gone).cast("int") + (c + 1 == come).cast("int"))
            return let(total, lambda t: F.struct(F.when(gone == come, acc.counts).otherwise(counts).alias("counts"), t.alias("total"), F.least(acc.least, t).alias("least")))

        into = F.get(acc.counts, come - 1) - (gone == come).cast("int")
        return let(F.struct(F.get(acc.counts, gone - 1).alias("out"), into.alias("into")), moved)

    start = let(counts, lambda n: let(total_of(n), lambda t: F.struct(n.alias("counts"), t.alias("total"), t.alias("least"))))
    steps = F.when(F.size(codes) > window, F.sequence(F.lit(0), F.size(codes) - window - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda acc: acc.least)


def total_of(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + _term(n))


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest entropy in bits among the windows of a string over ALPHABET; null where it is shorter than one window."""
    codes = F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.when(F.length(value) >= window, F.log2(F.lit(float(window))) - let(codes, lambda x: _least(x, window)) / window)


def is_secret(value: Column) -> Column:
    """Whether any part of value that the allow-list leaves, a window long or longer, reaches the threshold of its class."""

    def high(part: Column) -> Column:
        least = F.lit(None).cast("double")
        for pattern, bits in reversed(CLASSES.values()):
            least = F.when(part.rlike(pattern), F.lit(bits)).otherwise(least)
        return F.when(least.isNull(), F.lit(False)).otherwise(F.coalesce(peak_entropy(part) >= least, F.lit(False)))

    return F.exists(F.split(value, ALLOW), high)


def base_spans(text: Column) -> dict[str, Column]:
    group2 = lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 12
    found = {"assign": matches(text, ASSIGN, group2), "access": matches(text, ACCESS, lambda m: F.length(m) >= 18), "hex": matches(text, HEX)}
    return {k: as_spans(v, k, i) for i, (k, v) in enumerate(found.items())}


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with assign_spans, access_spans, hex_spans, entropy_spans and spans, their union, each an array of spans."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = base_spans(body)
    out = df.withColumns({f"{k}_spans": v for k, v in base.items()})
    extra = apart(matches(body, CANDIDATE, is_secret), F.concat(*[f"{k}_spans" for k in base]), FOUND, inside=True)
    out = out.withColumn("entropy_spans", as_spans(extra, "entropy", len(base)))
    return out.withColumn("spans", F.concat(*[f"{k}_spans" for k in base], "entropy_spans").cast(SPANS))


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every secret in text replaced by <kind>; no row goes, other columns stay."""
    spans = scan_secrets(df.select(F.col(text), F.struct("*").alias("_row")), text)
    return spans.select(*[(redacted(F.col(text), F.col("spans")) if c == text else F.col("_row")[c]).alias(c) for c in df.columns])


def secrets_report(df: DataFrame) -> DataFrame:
    """The digest columns: counts of base spans, their hash, and all spans as one string."""
    kinds = ("assign", "access", "hex")
    return scan_secrets(df.select("doc_id", "text")).select(
        "doc_id",
        *[F.size(f"{k}_spans").cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(listed(F.concat(*[f"{k}_spans" for k in kinds])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
