"""Near-duplicates by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidate edges.

1. Each text becomes the set of 64-bit hashes of its word shingles, in tasks. One hash serves all bins (its top bits choose the bin);
   an empty bin borrows from a bin that its own fixed random order names first. Rows of bins make band keys.
2. Texts of equal sets (by a 128-bit digest) are one class, so groups of exact copies shrink to one member by a partial minimum.
3. In each bucket the member with most company over all its buckets is the hub; candidate pairs are hub and member, a row a
   member. Pairs are confirmed on whole sets. Confirmed links give components.
4. A bucket that still holds several components may hide links between members that aren't its hub. Its members meet again in
   blocks of bounded size, with their whole sets: a task counts the shingles that members of different components share, and gives
   a forest of the links it finds, at most a row a member. So every pair of a bucket is linked already or decided on whole sets.

No step gathers a bucket, and nothing but counts goes to the driver. In step 4 members of a bucket's largest component meet only the
others, not each other: rows are linear in a bucket unless many of its members are near misses, in different components to the end. Those
meet block by block, so their rows are their number times their blocks.
Links of similarity at the threshold meet in no bucket with a chance of MISS at most (the rows of a band follow from it): 4e-5 at 0.85 with
bands of 8 rows, 6e-5 at 0.8 with bands of 6.

Defined cases: texts without words have an empty set and are linked with nothing; rows with a null id are linked with nothing, have a
null component and are kept; rows that share an id are one document as to links, each with its own n_shingles; an empty table gives an empty
result; columns beyond id and text don't matter, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import LOWER_BYTES, dropped, small_batches, written
from lanewise.llm.components import connected

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
#: The most that the chance may be that a link at the threshold meets in no bucket.
MISS = 1e-4
#: A block of step 4 holds members of so many shingles together, where each counts for LEAST more.
BLOCK, LEAST = 1 << 19, 512
#: Pairs that one task confirms with the same hub.
SALTED = 1000
SEED = 20_240_607
CACHE = 300_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of 64-bit hashes of the shingles of texts. Words are what the six ASCII white-space characters separate."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        found = (text or b"").translate(LOWER_BYTES).split()
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in found], np.uint64)
        n = min(self.size, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = _mixed(out + h[k : len(h) - n + k + 1] + np.uint64(0x9E3779B97F4A7C15))
        return np.unique(out)


def rows_of(similarity: float, bands: int = BANDS) -> int:
    """The longest bands for which links at the threshold are missed with a chance of MISS at most."""
    return max([r for r in range(1, 33) if (1 - similarity**r) ** bands <= MISS], default=1)


class Signer:
    """Band keys of sets by densified one-permutation signatures."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(SEED)
        self.bins = bands * rows
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1)
        self.odd = rng.integers(0, 2**63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.bands, self.rows = bands, rows

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """shingles: sorted, at least one. The least of a bin is the first that falls into it."""
        bins, first = np.unique(((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32), return_index=True)
        filled, value = np.zeros(self.bins, bool), np.zeros(self.bins, np.uint64)
        filled[bins.astype(np.int64)], value[bins.astype(np.int64)] = True, shingles[first]
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.order[empty]
            value[empty] = value[order[np.arange(len(empty)), filled[order].argmax(1)]]
        value = _mixed(value)
        return _mixed((value.reshape(self.bands, self.rows) * self.odd).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """key, n_shingles, digest (null for the empty set), buckets of docs (key, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(shingle), Signer(bands, rows)
        for batch in batches:
            sets = [shingler(v.as_py()) for v in batch.column(1).cast(pa.binary())]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            buckets = [signer(s) if len(s) else None for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], "i8"), pa.array(digests, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_shingles", "digest", "buckets"])

    return docs.select("key", "text").mapInArrow(sign, "key long, n_shingles long, digest binary, buckets array<long>")


def confirmed(texts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows of pairs (a, b) whose whole sets reach the similarity. Only b's text moves to a's place."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = Shingler(shingle), (None, None)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                left = x.as_py()
                if last[0] != left:
                    last = (left, shingler(left))
                right = shingler(y.as_py())
                both = len(np.intersect1d(last[1], right, assume_unique=True))
                keep.append(100 * both >= percent * (len(last[1]) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A hub with many pairs has its text dealt to several tasks; there are at most 1,000 such hubs, so they are broadcast.
    many = max(SALTED, pairs.count() // 1000)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / many).cast("int").alias("salts")).filter("salts > 1")
    salted = lambda df: df.join(F.broadcast(salts), "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = salted(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = salted(pairs).withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int"))
    right = right.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.drop("salts").join(left.drop("salts"), ["a", "salt"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def with_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, size, hashes (the sorted set as bytes) of texts (key, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            sets = [shingler(v.as_py()) for v in batch.column(1).cast(pa.binary())]
            columns = [batch.column(0), pa.array([len(s) for s in sets], "i8"), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "hashes"])

    return texts.select("key", "text").mapInArrow(make, "node long, size long, hashes binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left shares with each on the right.

    Values that many sets hold are columns of matrices; each pair of sets with a rare value is counted for itself.
    """
    n, m = len(left), len(right)
    values, ids = np.unique(np.concatenate(left + right), return_inverse=True)
    rows = np.repeat(np.arange(n + m), [len(s) for s in left + right])
    in_left = np.bincount(ids[rows < n], minlength=len(values))
    in_right = np.bincount(ids[rows >= n], minlength=len(values))
    pairs = in_left * in_right
    out = np.zeros(n * m, np.float32)
    dense = np.flatnonzero(pairs * 64 > n * m)
    for lo in range(0, len(dense), 2048):
        place = np.full(len(values), -1, np.int32)
        place[dense[lo : lo + 2048]] = np.arange(len(dense[lo : lo + 2048]))
        held = np.flatnonzero(place[ids] >= 0)
        marks = np.zeros((n + m, 2048), np.float32)
        marks[rows[held], place[ids[held]]] = 1
        out += (marks[:n] @ marks[n:].T).ravel()
    rare = (pairs > 0) & (pairs * 64 <= n * m)
    held = np.flatnonzero(rare[ids])
    held = held[np.lexsort((rows[held], ids[held]))]  # by value, left before right
    own, side = ids[held], rows[held]
    first = np.searchsorted(own, own[side < n])  # for each on the left, where its value begins
    times = in_right[own[side < n]]
    begin = first + in_left[own[side < n]]
    other = side[np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())] - n
    out += np.bincount(np.repeat(side[side < n], times) * m + other, minlength=n * m)
    return out.reshape(n, m).astype(np.int64)


def forest(links: np.ndarray, part: dict[int, int]) -> list[tuple[int, int]]:
    """Of links (node, node), those that join components of part not yet joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for a, b in links.tolist():
        x, y = find(part[a]), find(part[b])
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def hidden_links(members: DataFrame, percent: int) -> DataFrame:
    """members: bucket, node, component, size, hashes, of buckets with several components. A forest of each block's links between components."""

    def block_links(group: pa.Table) -> list[tuple[int, int]]:
        nodes, parts, sizes, left, right = (group.column(c).to_numpy() for c in ("node", "component", "size", "left", "right"))
        sets = [np.frombuffer(h.as_py(), np.uint64) for h in group.column("hashes")]
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        if not len(i) or not len(j) or len(np.unique(parts)) < 2:
            return []
        both = common_counts([sets[k] for k in i], [sets[k] for k in j])
        linked = (100 * both >= percent * (sizes[i][:, None] + sizes[j][None] - both)) & (parts[i][:, None] != parts[j][None])
        x, y = np.nonzero(linked)
        x, y = i[x], j[y]
        _, once = np.unique(np.stack([parts[x], parts[y]], 1), axis=0, return_index=True)
        return forest(np.stack([nodes[x[once]], nodes[y[once]]], 1), dict(zip(nodes.tolist(), parts.tolist(), strict=True)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut() -> list[pa.Table]:
            table = pa.Table.from_batches(held)
            keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            return [table.slice(lo, hi - lo) for lo, hi in zip([0, *edges], [*edges, len(keys)], strict=True)]

        def rows(groups: list[pa.Table]) -> pa.RecordBatch:
            found = np.array([x for g in groups for x in block_links(g)], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                *done, rest = cut()
                if done:
                    yield rows(done)
                    held = rest.to_batches()
        if held:
            yield rows(cut())

    weight = F.col("size") + LEAST
    tally = members.groupBy("bucket", "component").agg(F.sum(weight).alias("w"))
    tally = tally.groupBy("bucket").agg(F.max(F.struct("w", "component")).alias("main"), F.sum("w").alias("w"))
    blocks = lambda w: F.ceil(w / BLOCK).cast("int")
    tally = tally.select("bucket", F.col("main.component").alias("main"), blocks(F.col("w") - F.col("main.w")).alias("rests"), blocks(F.col("main.w")).alias("mains"))
    dealt = members.join(tally, "bucket").withColumn("rest", F.col("component") != F.col("main"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    # A block pair is (i, j): both of the rest with i <= j, or the rest's i and the largest component's -1 - j.
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    among = F.transform(numbers(F.col("rests")), lambda o: pair(F.least("own", o), F.greatest("own", o), F.col("own") <= o, F.col("own") >= o))
    with_main = F.transform(numbers(F.col("mains")), lambda o: pair(F.col("own"), -1 - o, F.lit(True), F.lit(False)))
    of_main = F.transform(numbers(F.col("rests")), lambda o: pair(o, -1 - F.col("own"), F.lit(False), F.lit(True)))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("rest"), F.concat(among, with_main)).otherwise(of_main)))
    dealt = dealt.select("bucket", "at.i", "at.j", "at.left", "at.right", "node", "component", "size", "hashes")
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(find, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int | None = None,
) -> DataFrame:
    """key, n_shingles, component_id (the least id reachable) and kept (the id is the component's). Ids are integers."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        found = _near_duplicates(docs, shingle, round(100 * similarity), bands, rows or rows_of(similarity, bands))
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept")
    return found.select(F.col("key").alias(key), "n_shingles", "component_id", kept)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    marks = written(signed(docs, shingle, bands, rows), "signed")
    some = marks.filter("digest is not null and key is not null")
    classes = written(some.groupBy("digest").agg(F.min("key").alias("node"), F.count("*").alias("n"), F.first("buckets").alias("buckets")), "classes")
    # Rows that share an id join their classes.
    twice = some.groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("key")
    twice = some.join(twice, "key").join(classes.select("digest", "node"), "digest").select(F.col("key").alias("a"), F.col("node").alias("b")).distinct()
    entries = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    entries = written(entries.join(shared.select("bucket", "n"), "bucket"), "entries")

    company = entries.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = entries.join(company, "node").groupBy("bucket").agg(F.min(F.struct(-F.col("company"), F.col("node").alias("hub"))).hub.alias("hub"))
    stars = written(entries.join(hubs, "bucket").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    # Both sides of a join with whole texts grow with the corpus, so it is a merge join at every size.
    texts = written(docs.join(entries.select("node").distinct().hint("merge"), F.col("key") == F.col("node"), "left_semi"), "texts")
    links = written(confirmed(texts, stars, shingle, percent).unionByName(twice), "links")
    parts = connected(links)

    labelled = entries.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    members = written(labelled.join(split.select("bucket"), "bucket"), "members")
    open_texts = texts.join(members.select("node").distinct().hint("merge"), texts.key == F.col("node"), "left_semi")
    more = written(hidden_links(members.join(with_sets(open_texts, shingle), "node"), percent), "links")
    if not more.isEmpty():
        dropped(parts)
        parts = connected(links.unionByName(more))

    # Classes with a 2,000th of all documents or more (so 2,000 at most) are broadcast; no task gets all copies of a large class.
    named = classes.join(parts, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    dropped(classes, entries, stars, texts, links, parts, members, more)
    large = named.filter(F.col("n") >= max(2, marks.count() / 2000)).select("digest", F.col("component").alias("large"))
    out = marks.select("key", "n_shingles", "digest").join(F.broadcast(large), "digest", "left")
    own = F.coalesce(F.when(F.col("large").isNull(), F.col("digest")), F.col("key").cast("string").cast("binary"))
    out = out.withColumn("own", own).join(named.select(F.col("digest").alias("own"), "component"), "own", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("large", "component", "key"))
    return out.select("key", "n_shingles", component.alias("component_id"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each group, the one with the least id; all columns stay, and so do rows with a null id.

    Rows that share an id are documents each: those with unlike texts are told apart by the digests of their texts and only linked if the texts are near copies. Of rows with the
    same id and text the one with the least digest of all its columns stays, so reruns agree.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.struct("*").alias("row"))
    has, none = rows.filter("key is not null"), rows.filter("key is null").select("row")
    if has.groupBy("key").count().filter("count > 1").isEmpty():
        out = _kept_rows(has, settings)
    else:
        digest = F.coalesce(F.md5("text"), F.lit(""))
        has = has.withColumn("digest", digest)
        # Numbers in the order of id and digest: the partitions are ranges of them.
        distinct = has.select("key", "digest").distinct().repartitionByRange("key", "digest").sortWithinPartitions("key", "digest")
        numbers = written(distinct.withColumn("number", F.monotonically_increasing_id()), "numbers")
        has = has.join(numbers.hint("merge"), ["key", "digest"]).select(F.col("number").alias("key"), "text", "row")
        out = _kept_rows(has, settings)
        mark = F.xxhash64(F.to_json("row"))
        least = out.groupBy("key").agg(F.min(mark).alias("mark"), F.count("*").alias("n")).filter("n > 1")
        several = out.join(least.select("key", "mark").hint("merge"), "key", "left")
        first = several.filter(F.col("mark").isNull() | (F.xxhash64(F.to_json("row")) == F.col("mark")))
        out = first.filter("mark is null").select("row").unionByName(first.filter("mark is not null").dropDuplicates(["key"]).select("row"))
    out = out.select("row").unionByName(none)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _kept_rows(rows: DataFrame, settings: dict) -> DataFrame:
    """The rows (key, text, row) whose key near_duplicates keeps."""
    kept = near_duplicates(rows, "key", "text", **settings).filter("kept").select("key").distinct()
    return rows.join(kept.hint("merge"), "key", "left_semi")
