"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id. A copy of a document finishes at the virtual time
(words of its source up to and with it) / (target of its source); a second pass over a source goes on where the first
ended. All copies are ordered by virtual time and the order is cut where its words reach the budget. At virtual time 1
every source has given its target, so the cut is near 1 and each source is within a document of its target.

Running totals are taken in two steps: totals of hash ranges (a small table) and totals inside a range. So no task holds
a source, however large, and no task holds the whole order: only the range of virtual times in which the cut falls is
sorted. The driver sees the range of virtual time with the cut, what is left for it, and the key of the cut.

Defined cases: a null or empty text has size 0 and is taken 0 times; null is a source of its own, the last; rows that
are equal in id, source and text are documents of their own: they stand in the queue one behind the other, and which of them is taken
more often than another makes no difference; an empty table gives an empty result; reruns agree; mix gives back docs' own columns, whatever
their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import word_count, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEATS = 2
#: Ranges of virtual time up to 2. At least so many, and one for each ROWS_PER_RANGE rows.
TIME_RANGES = 4096
ROWS_PER_RANGE = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_ix, source_size, target, one row a source.

    The budget is shared by weight. Targets stop at repeats * size and what is over goes to the others by
    weight until none is above: sources in order of limit / weight stop one after another while the share that a
    unit of weight would get exceeds that ratio, so prefix sums give the last share.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("source_ix", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_ix") % len(weights) + 1)
    per = per.withColumns({"weight": weight, "limit": (repeats * F.col("source_size")).cast("double")})
    order = Window.orderBy(F.col("limit") / F.col("weight"), "source_ix")
    stopped = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("share", (F.lit(budget) * total - stopped) / left)
    free = F.col("share") * F.col("weight") <= F.col("limit")
    last = F.min(F.when(free, F.struct(F.col("limit") / F.col("weight"), "source_ix", "share"))).over(Window.partitionBy())
    target = F.least(F.col("limit"), F.coalesce(last.share * F.col("weight"), F.col("limit")))
    return per.select("source", "source_ix", "source_size", target.alias("target"))


def running_total(df: DataFrame, within: list[str], span: str, order: list[Column], value: str) -> Column | DataFrame:
    """df with `total`: value summed over the rows of `within` up to and with each, in the order of span, then order."""
    totals = df.groupBy(*within, span).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*within).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*within, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(totals, [*within, span]).withColumn("total", F.col("_before") + F.sum(value).over(inside)).drop("_before")


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    repeats: int = MAX_REPEATS,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """key, source, size, source_size, target, copies (how often the document is taken), taken (its words so taken) and hash, of the row."""
    sizes = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _hash(key, source, text).alias("h"))
    sizes = written(sizes, "mix-sizes")
    rows = sizes.count()
    ranges, slices = max(64, rows // ROWS_PER_RANGE), max(TIME_RANGES, rows // ROWS_PER_RANGE)
    targets = source_targets(sizes, weights, budget, repeats)
    named = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).drop(targets.source)
    named = named.withColumn("range", F.pmod(F.xxhash64("h"), F.lit(ranges)))
    queued = written(running_total(named, ["source_ix"], "range", [F.col("h"), F.col("key")], "size").drop("range"), "mix-queue")

    def finish(k: int) -> Column:
        time = (k * F.col("source_size") + F.col("total")) / F.col("target")
        return F.struct(time.alias("time"), F.col("source_ix").alias("ix"), F.lit(k).alias("k"), F.col("total").alias("total"), F.col("h").alias("h"), F.col("key").alias("key"))

    copies = queued.filter("size > 0").select("size", F.explode(F.array(*[finish(k) for k in range(repeats)])).alias("at"))
    end = 2.0  # the budget ends near virtual time 1
    copies = copies.filter(F.col("at.time") <= end).withColumn("slice", F.floor(F.col("at.time") * slices / end).cast("int"))
    words = copies.groupBy("slice").agg(F.sum("size").alias("words"))  # at most slices + 1 rows
    words = words.withColumn("upto", F.sum("words").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    left = budget * (sizes.agg(F.sum("size")).first()[0] or 0)
    first = words.filter(F.col("upto") > left).agg(F.min(F.struct("slice", "words", "upto")).alias("at")).first()["at"]
    cut = first and first["slice"]
    if cut is not None:
        left -= first["upto"] - first["words"]
        inner = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        part = copies.filter(F.col("slice") == cut).withColumn("sum", F.sum("size").over(inner))
        last = part.filter(F.col("sum") <= left).agg(F.max("at").alias("at")).first()["at"]
    taken = F.lit(0)
    for k in range(repeats):
        at = finish(k)
        now = F.floor(at.time * slices / end).cast("int")
        take = at.time <= end
        if cut is not None:
            inside = F.lit(False)
            if last is not None:
                # The last copy that fits, field by field.
                key_type = queued.schema["key"].dataType
                names = (("time", "double"), ("ix", "int"), ("k", "int"), ("total", "long"), ("h", "long"), ("key", key_type))
                inside = at <= F.struct(*[F.lit(last[n]).cast(t).alias(n) for n, t in names])
            take = (now < cut) | ((now == cut) & inside)
        taken += F.when((F.col("size") > 0) & take, 1).otherwise(0)
    out = queued.withColumn("copies", taken)
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("h").alias("hash"))


def _hash(key: str, source: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(source), F.col(text))


def _place(key: str, source: str, hash_: Column) -> list[Column]:
    """What tells rows apart, nulls included, as columns without nulls."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [plain(key).alias("_key"), F.col(key).isNull().alias("_no_key"), plain(source).alias("_source"), F.col(source).isNull().alias("_no_source"), hash_.alias("_hash")]


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", repeats: int = MAX_REPEATS, **settings) -> DataFrame:
    """The mixed documents themselves, each row as often as it is taken.

    Rows equal in id, source and text are numbered: of n that are taken twice and m that are taken once, the first n and the next m stand for them.
    """
    plan = mixed(docs, key=key, text=text, source=source, repeats=repeats, **settings).filter("copies > 0")
    times = [F.count(F.when(F.col("copies") == c, 1)).alias(f"n{c}") for c in range(1, repeats + 1)]
    plan = plan.groupBy(*_place(key, source, F.col("hash"))).agg(*times)
    place = ["_key", "_no_key", "_source", "_no_source", "_hash"]
    rows = docs.select(*_place(key, source, _hash(key, source, text)), F.struct("*").alias("_row"))
    both = rows.join(plan.hint("merge"), place)  # both sides grow with the corpus; what follows keeps their partitions and order
    both = both.withColumn("_tie", F.row_number().over(Window.partitionBy(*place).orderBy("_hash")))
    bound, copies = F.lit(0), F.lit(0)
    for c in range(repeats, 0, -1):
        copies = F.when((F.col("_tie") > bound) & (F.col("_tie") <= bound + F.col(f"n{c}")), c).otherwise(copies)
        bound = bound + F.col(f"n{c}")
    both = both.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return both.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    return mixed(docs).drop("source", "copies", "hash")
