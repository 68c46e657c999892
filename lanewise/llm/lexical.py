"""Ranked lexical search by a blocked sparse matrix product in 64-bit integers.

Items by terms, times terms by documents, is items by documents; a score is an entry of the product. Items are few and short beside the corpus.

1. Whole texts become counts of the items' terms inside tasks. Some thousand documents are a block: a sparse matrix by term, with the documents' lengths,
   and the numbers of documents and terms that it stands for. Blocks are a table; texts are read once and never shuffled.
2. Counts of documents by term, of documents and of all terms are sums over blocks, pre-aggregated in tasks. They give a weight for each term.
3. A block's counts become impacts. Each item merges the block's rows of its terms (Gustavson's order: row by row of the left matrix, scaled rows of the right one
   added to one dense row), and the best k of the dense row are all that leaves the block. A task keeps k rows an item over its blocks; a window ranks what tasks give.

A term is a run of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. Its weight is floor(1000 ln((2N + 2) / (2 df + 1))). With n terms in a document
of N that have any, and L terms in all, m is 50 + (50 n N) div L, and an entry is weight * ((10^9 tf) div (1000 tf + 20 m)).

What tasks get whole are the items' terms and weights. Items form groups of GROUP_BYTES of terms (an item lies in one group), with a pass over the texts for each group.
A term that is in every document is one entry a document in its block, as any other; no step gathers a term.

Defined cases: null and empty texts, and texts without terms, count nowhere and are never found; a document of many megabytes is counted piece by piece; rows that share
a doc_id are documents each, and rows without one rank last among equals; items that share an id, nulls included, are one item with the terms of all its rows;
items without terms find nothing; with fewer than k documents of a score above 0 all of those are returned; an empty table on either side gives an empty result; other columns don't matter.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import LOWER, UPPER, dropped, small_batches, written
from lanewise.llm.inner_products import Best

K = 50
#: Documents and entries of a block.
DOCUMENTS, ENTRIES = 8192, 1_000_000
#: Terms of one group of items take about so many bytes.
GROUP_BYTES = 8_000_000
#: A text's bytes that are taken apart at a time.
PIECE = 1_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: For bytes.translate: what parts terms becomes a space, A-Z become a-z. Bytes of characters beyond ASCII stay.
PARTED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK = "known boolean, documents long, terms long, ids binary, sizes binary, held binary, starts binary, rows binary, counts binary"
TYPES = {"ids": "<i8", "sizes": "<i8", "held": "<i4", "starts": "<i8", "rows": "<i4", "counts": "<i4"}


def counted(text: bytes, places: dict[bytes, int]) -> tuple[int, Counter]:
    """The number of a text's terms, and how often each of the known ones occurs."""
    text, n, found, at = text.translate(PARTED), 0, Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        terms = text[at:end].split()
        n += len(terms)
        found.update(filter(places.__contains__, terms))
        at = end
    return n, found


class Blocks:
    """Gathers documents of a task into blocks."""

    def __init__(self, places: dict[bytes, int], known: bool) -> None:
        self.places, self.known = places, known
        self.clear()

    def clear(self) -> None:
        self.documents = self.terms = self.entries = 0
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.columns: list[int] = []
        self.rows: list[int] = []
        self.counts: list[int] = []

    def add(self, key: int, text: bytes) -> None:
        n, found = counted(text, self.places)
        self.documents, self.terms = self.documents + (n > 0), self.terms + n
        if found:
            self.columns.extend(map(self.places.__getitem__, found))
            self.counts.extend(found.values())
            self.rows.extend([len(self.ids)] * len(found))
            self.ids.append(key)
            self.sizes.append(n)

    def full(self) -> bool:
        return len(self.ids) >= DOCUMENTS or len(self.rows) >= ENTRIES

    def block(self) -> pa.RecordBatch:
        columns = np.array(self.columns, "<i4")
        order = np.argsort(columns, kind="stable")
        held, starts = np.unique(columns[order], return_index=True)
        arrays = {"ids": self.ids, "sizes": self.sizes, "held": held, "starts": np.append(starts, len(order)), "rows": np.array(self.rows, "<i4")[order], "counts": np.array(self.counts, "<i4")[order]}
        data = [pa.array([np.asarray(arrays[name], kind).tobytes()], pa.binary()) for name, kind in TYPES.items()]
        out = pa.RecordBatch.from_arrays([pa.array([self.known]), pa.array([self.documents]), pa.array([self.terms]), *data], ["known", "documents", "terms", *TYPES])
        self.clear()
        return out


def impacts(counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Entries of the term by document matrix: counts, and for each the size of its document and the weight of its term."""
    if len(sizes) and 50 * int(sizes.max()) * documents >= 2**63:
        m = np.array([50 + 50 * int(n) * documents // terms for n in sizes], "<i8")
    else:
        m = 50 + (50 * sizes * documents) // terms
    counts = counts.astype("<i8")
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


def merged(block: dict[str, np.ndarray], values: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], best: Best) -> None:
    """Each item's row of the product with a block: rows of its terms added up, of which the best go on."""
    row_of = np.full(1 + max((int(t[-1]) for t, _ in items if len(t)), default=0), -1, np.int64)
    fits = block["held"] < len(row_of)
    row_of[block["held"][fits]] = np.flatnonzero(fits)
    total, starts, k = np.zeros(len(block["ids"]), "<i8"), block["starts"].tolist(), best.k
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (terms, times) in enumerate(items):
        here = row_of[terms]
        total[:] = 0
        for row, time in zip(here[here >= 0].tolist(), times[here >= 0].tolist(), strict=True):
            part = slice(starts[row], starts[row + 1])
            total[block["rows"][part]] += values[part] if time == 1 else time * values[part]
        at = np.flatnonzero(total >= best.floors[i])
        if len(at) > k:
            at = at[total[at] >= np.partition(total[at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((block["ids"][at], -total[at]))[:k]]
        if len(at):
            found.append((i, block["ids"][at], total[at]))
    if found:
        best.add(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]))


def item_terms(items: DataFrame, key: str, text: str, once: bool) -> DataFrame:
    """item, term, times."""
    plain = F.translate(F.col(text), UPPER, LOWER)
    pairs = items.select(F.col(key).cast("long").alias("item"), F.explode(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))).alias("term"))
    return pairs.groupBy("item", "term").agg((F.lit(1) if once else F.count("*")).cast("long").alias("times"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", once: bool = True) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for each item. once: an item's terms count once each, else as often as they occur in it."""
    pairs = written(item_terms(items, item, item_text, once), "terms")
    size = pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    parts = [pairs.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g) for g in range(groups)]
    found = reduce(DataFrame.unionByName, [_pass(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), part, k) for part in parts])
    dropped(pairs)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _pass(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score: the best k of each task for a group of items, whose terms are of bounded size."""
    spark = docs.sparkSession
    rows = pairs.toArrow()
    names = {t: i for i, t in enumerate(sorted(set(rows["term"].to_pylist())))}
    lists: dict[int | None, list[tuple[int, int]]] = {}
    for i, t, n in zip(*(rows[c].to_pylist() for c in ("item", "term", "times")), strict=True):
        lists.setdefault(i, []).append((names[t], n))
    keys = list(lists)
    items = [tuple(np.array(c, np.int64) for c in zip(*sorted(lists[i]), strict=True)) for i in keys]
    places = spark.sparkContext.broadcast({t.encode(): i for t, i in names.items()})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {known: Blocks(places.value, known) for known in (True, False)}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    to = kinds[key is not None]
                    to.add(key or 0, text)
                    if to.full():
                        yield to.block()
        yield from (b.block() for b in kinds.values() if b.documents)

    with small_batches(spark):
        blocks = written(docs.mapInArrow(gather, BLOCK), "postings")

    def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(places.value), "<i8")
        for batch in batches:
            for held, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                df[np.frombuffer(held, "<i4")] += np.diff(np.frombuffer(starts, "<i8"))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    documents, terms = (v or 0 for v in blocks.agg(F.sum("documents"), F.sum("terms")).first())
    weights = np.zeros(len(names), "<i8")
    for r in blocks.select("held", "starts").mapInArrow(held_by, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weights[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
    sent = spark.sparkContext.broadcast((keys, items, weights))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, items, weights = sent.value
        kinds = {known: Best(np.ones(len(items), "<i8"), k) for known in (True, False)}
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: np.frombuffer(batch.column(c)[i].as_py(), kind) for c, (name, kind) in enumerate(TYPES.items(), 1)}
                values = impacts(block["counts"], block["sizes"][block["rows"]], np.repeat(weights[block["held"]], np.diff(block["starts"])), documents, terms)
                merged(block, values, items, kinds[batch.column(0)[i].as_py()])
        named = pa.array(keys, pa.int64())
        for known, best in kinds.items():
            query, ids, scores = best.found()
            yield pa.RecordBatch.from_arrays([named.take(pa.array(query)), pa.array(ids) if known else pa.nulls(len(ids), pa.int64()), pa.array(scores)], ["item_id", "doc_id", "score"])

    with small_batches(spark, rows=16):
        out = written(blocks.select("known", *TYPES).mapInArrow(multiply, "item_id long, doc_id long, score long"), "ranked")
    dropped(blocks)
    places.unpersist()
    sent.unpersist()
    return out
