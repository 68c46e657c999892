"""Best-fit packing of token sequences by patterns that non-negative least squares fits to the histogram of lengths.

1. Texts become token ids inside tasks; only longer documents are cut, into pieces of the sequence length. What goes on is
   a narrow table: id, piece, start, length, checksum.
2. The histogram of piece lengths (as many rows as a sequence has tokens, whatever the corpus) goes to the driver. Lengths are
   rounded up to bins; patterns are the few-document combinations of bins that fill a sequence; repeat counts are fitted by
   non-negative least squares and rounded down. Slots of a pattern get actual lengths in runs, so a plan has a bounded number
   of rows. Short pieces and whatever rounding left are packed by best fit into the gaps, then into new sequences.
3. A piece's rank among those of its length is a two-step running count (no task holds a length, however common). Length and
   rank find the piece's place in the plan, a broadcast of bounded size.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated rows are packed each;
an empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import kept_by_worker, small_batches, written

SEQUENCE = 4096
END_ID = 1
BINS = 64
SLOTS = 4
#: Pieces of up to so many bins are kept for the gaps.
SAND_BINS = 2
#: Different words that a worker remembers, about 200 bytes each.
CACHE = 500_000
#: Which bytes part words: the six ASCII white-space characters.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Letters with one lower-case form, and marks, which the vocabulary takes apart from letters. The apostrophe isn't among them.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_END = "</w>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of many texts at once: distinct words are looked up once a portion, and numpy gathers their ids in order.

    A word of plain letters, perhaps with marks behind, has the ids of its lower-case letters and of the marks. New letters are
    encoded many at a time: each is one run of ids, of which the last alone ends a word. Other words are encoded whole.
    Ids lie in one pool; an entry is a run of it.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        tokens = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(tokens.values()) + 1, bool)
        self.ends[[i for t, i in tokens.items() if t.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.letters: dict[bytes, int] = {}
        self.marks: dict[bytes, int] = {b"": 0}
        self.pool, self.starts, self.lengths, self.entries = np.zeros(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 1

    def keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """New entries of consecutive runs of ids; their numbers."""
        first, at = self.entries, self.starts[self.entries - 1] + self.lengths[self.entries - 1]
        self.entries += len(lengths)
        while self.entries > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[at : at + len(ids)] = ids
        self.lengths[first : self.entries] = lengths
        self.starts[first : self.entries] = at + np.cumsum(lengths) - lengths
        return np.arange(first, self.entries)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after another, and each one's length."""
        lengths = self.lengths[entries]
        shift = self.starts[entries] - np.cumsum(lengths) + lengths
        return self.pool[np.repeat(shift, lengths) + np.arange(lengths.sum())], lengths

    def encoded(self, texts: list[str]) -> np.ndarray:
        """Entries of texts that are encoded each for itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self.keep(np.fromiter((i for ids in found for i in ids), "<u4"), np.array([len(ids) for ids in found], np.int64))

    def learn(self, letters: list[bytes]) -> None:
        for lo in range(0, len(letters), 2000):
            part = letters[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            whole = len(stops) == len(part) and stops[-1] == len(ids)
            made = self.keep(ids, np.diff(stops, prepend=0)) if whole else self.encoded([x.decode() for x in part])
            self.letters.update(zip(part, made.tolist(), strict=True))

    def learn_words(self, new: pa.Array) -> None:
        bare = pc.utf8_rtrim(new, MARKS)
        plain = pc.match_substring_regex(bare, PLAIN)
        odd, new, bare = new.filter(pc.invert(plain)), new.filter(plain), bare.filter(plain)
        words, bare_length = listed(new), pc.binary_length(bare).to_numpy()
        lower = pc.utf8_lower(bare).dictionary_encode()
        letters = listed(lower.dictionary)
        self.learn([x for x in letters if x not in self.letters])
        ends = [w[n:] for w, n in zip(words, bare_length.tolist(), strict=True)]
        marks = sorted(set(ends).difference(self.marks))
        self.marks.update(zip(marks, self.encoded([m.decode() for m in marks]).tolist(), strict=True))
        left = np.fromiter(map(self.letters.__getitem__, letters), np.int64, len(letters))[lower.indices.to_numpy()]
        both = np.stack([left, np.fromiter(map(self.marks.__getitem__, ends), np.int64, len(ends))], 1)
        ids, lengths = self.gather(both.ravel())
        self.words.update(zip(words, self.keep(ids, lengths.reshape(-1, 2).sum(1)).tolist(), strict=True))
        self.words.update(zip(listed(odd), self.encoded(odd.to_pylist()).tolist(), strict=True))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin, the end of the last behind."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = ~SPACE[data]
        first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))  # where words begin
        closed = np.cumsum([len(t) + 1 for t in texts])
        before = np.concatenate([[0], np.searchsorted(first, closed)])  # words before each text
        length = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]])) - first
        places = np.concatenate([[0], np.cumsum(length)])
        squeezed = data[inside]
        split = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(places), pa.py_buffer(squeezed)]).dictionary_encode()
        different = listed(split.dictionary)
        if len(self.words) + len(different) > CACHE:
            self.clear()
        unknown = np.fromiter((w not in self.words for w in different), bool, len(different))
        if unknown.any():
            self.learn_words(split.dictionary.filter(pa.array(unknown)))
        entries = np.fromiter(map(self.words.__getitem__, different), np.int64, len(different))
        ids, lengths = self.gather(entries[split.indices.to_numpy()])
        return ids, np.concatenate([[0], np.cumsum(lengths)])[before]


def listed(strings: pa.Array) -> list[bytes]:
    """The bytes of each string; none is null."""
    if not len(strings):
        return []
    edges = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data, edges = bytes(strings.buffers()[2]), edges.tolist()
    return [data[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def word_ids(vocabulary: str) -> WordIds:
    """One for each Python worker, kept from task to task."""
    return kept_by_worker("word_ids", vocabulary, lambda: WordIds(vocabulary))


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = SEQUENCE) -> DataFrame:
    """key, piece, start, length and ids_crc32 of each piece of each document.

    The vocabulary drops white space and never joins what it separates, so ids of a text are those of its words one after another.
    The path must hold on every executor.
    """
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, width, end = word_ids(vocabulary), 4 * limit, END_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            flat, edges = ids([v.as_py() or b"" for v in batch.column(1).cast(pa.binary())])
            for at, (begin, stop) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                data = flat[begin:stop].tobytes() + end
                rows += [(at, k, lo // 4, min(width, len(data) - lo) // 4, zlib.crc32(data[lo : lo + width])) for k, lo in enumerate(range(0, len(data), width))]
            if rows:
                at, piece, start, length, crc = (np.array(c) for c in zip(*rows, strict=True))
                columns = [batch.column(0).take(pa.array(at)), pa.array(piece.astype("i4")), pa.array(start.astype("i8")), pa.array(length.astype("i8")), pa.array(crc.astype("i8"))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])
    return docs.select(F.col(key), F.col(text)).mapInArrow(encode, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method of Lawson and Hanson on the normal equations."""
    gram, right = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, np.abs(right).max(initial=0))
    for _ in range(rounds):
        slope = np.where(free, -np.inf, right - gram @ x)
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        free[best] = True
        while True:
            on = np.flatnonzero(free)
            trial = np.linalg.lstsq(gram[np.ix_(on, on)], right[on], rcond=None)[0]
            if (trial > 0).all():
                break
            bad = trial <= 0
            share = (x[on][bad] / np.maximum(x[on][bad] - trial[bad], 1e-300)).min()
            x[on] += share * (trial - x[on])
            drop = on[bad & (x[on] <= 1e-12 * max(1.0, x.max()))]
            free[drop if len(drop) else on[bad]] = False
            x[~free] = 0
        x[:] = 0
        x[on] = trial
    return x


def fill_patterns(bins: int, slots: int, least: int) -> list[tuple[int, ...]]:
    """Combinations of up to `slots` bins, each over `least`, that fill a sequence exactly; largest bin first."""
    out = []
    for n in range(1, slots + 1):
        for rest in combinations_with_replacement(range(least + 1, bins + 1), n - 1):
            first = bins - sum(rest)
            if first >= max((*rest, least + 1)):
                out.append((first, *sorted(rest, reverse=True)))
    return sorted(set(out))


class Plan:
    """Places for pieces of each length: rows (length, rank, count, sequence, offset) stand for `count` pieces of consecutive ranks and sequences."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.left, self.used = size, dict(counts), dict.fromkeys(counts, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
        self.sizes: list[int] = []  # the gaps there are, in order

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.used[length], n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def gap(self, space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in self.gaps:
                self.gaps[space] = []
                insort(self.sizes, space)
            self.gaps[space].append((first, n))

    def pattern(self, slots: list[list[tuple[int, int]]]) -> None:
        """One run of sequences; slots: for each place the (length, count) runs that fill it, of equal totals."""
        runs = [list(reversed(s)) for s in slots]
        while runs[0]:
            n = min(r[-1][1] for r in runs)
            first, offset = self.open(n), 0
            for r in runs:
                length, have = r.pop()
                self.put(length, n, first, offset)
                offset += length
                if have > n:
                    r.append((length, have - n))
            self.gap(self.size - offset, first, n)

    def best_fit(self, length: int) -> None:
        """All that is left of a length: into the tightest gaps first, then into new sequences."""
        while self.left[length]:
            k = bisect_left(self.sizes, length)
            if k == len(self.sizes):
                each = self.size // length
                full, rest = divmod(self.left[length], each)
                for n, per in ((full, each), (1 if rest else 0, rest)):
                    first = self.open(n)
                    for j in range(per if n else 0):
                        self.put(length, n, first, j * length)
                    self.gap(self.size - per * length, first, n)
                return
            space = self.sizes[k]
            first, n = self.gaps[space].pop()
            if not self.gaps[space]:
                del self.gaps[space]
                self.sizes.pop(k)
            m = min(n, self.left[length])
            self.put(length, m, first, self.size - space)
            self.gap(space - length, first, m)
            self.gap(space, first + m, n - m)


def make_plan(counts: dict[int, int], size: int = SEQUENCE, bins: int = BINS, slots: int = SLOTS) -> Plan:
    """counts: pieces of each length from 1 to size."""
    plan, width = Plan(counts, size), -(-size // bins)
    in_bin: dict[int, list[int]] = {}
    for length in sorted(counts):
        in_bin.setdefault(-(-length // width), []).append(length)
    patterns = fill_patterns(bins, slots, SAND_BINS)
    a = np.zeros((bins, len(patterns)))
    for j, p in enumerate(patterns):
        np.add.at(a[:, j], np.array(p) - 1, 1)
    want = np.array([sum(counts[x] for x in in_bin.get(b, ())) for b in range(1, bins + 1)], float)
    want[:SAND_BINS] = 0
    times = nnls(a, want) if want.any() else np.zeros(len(patterns))
    for j in np.argsort(-times, kind="stable"):
        each = {b: patterns[j].count(b) for b in patterns[j]}
        have = {b: sum(plan.left[x] for x in in_bin.get(b, ())) for b in each}
        n = min([int(times[j] + 1e-9), *(have[b] // m for b, m in each.items())])
        if n <= 0:
            continue
        taken: dict[int, int] = {}
        runs = []
        for k, b in enumerate(patterns[j]):
            run, need = [], n
            for length in in_bin[b] if k % 2 else reversed(in_bin[b]):
                m = min(need, plan.left[length] - taken.get(length, 0))
                if m:
                    run.append((length, m))
                    taken[length] = taken.get(length, 0) + m
                    need -= m
            runs.append(run)
        plan.pattern(runs)
    for length in sorted(counts, reverse=True):
        plan.best_fit(length)
    return plan


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with rank, from 0, among those of their length; equal rows may swap."""
    ranges = max(16, pieces.count() // 50_000)
    pieces = pieces.withColumn("range", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(ranges)))
    totals = pieces.groupBy("length", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("length", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "range").orderBy("key", "piece", "ids_crc32")
    joined = pieces.join(totals, ["length", "range"])
    return joined.withColumn("rank", F.col("before") + F.row_number().over(inside) - 1).drop("before", "range")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset; a row a piece."""
    with small_batches(docs.sparkSession):
        pieces = written(tokenized(docs, key, text, vocabulary, size), "pack-pieces")
    counts = {length: n for length, n in pieces.groupBy("length").count().collect()}  # at most `size` rows
    rows = np.array(sorted(make_plan(counts, size).rows) or np.zeros((0, 5)), np.int64)
    step = np.int64(1) << np.int64(44)
    starts, lows, first, offsets = rows[:, 0] * step + rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, length.to_numpy() * step + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": first[at] + rank.to_numpy() - lows[at], "offset": offsets[at]})

    out = ranked(pieces).withColumn("_at", place("length", "rank"))
    return out.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
