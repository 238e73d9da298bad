"""Benchmark decontamination: BM25 retrieval of test items with block-max WAND (operator 2).

The test items are the indexed side: an inverted index with BM25 weights, each posting list cut into
blocks that carry their largest weight. Every passage of the training text is a query. Weights are
divided by the item's own best score, so a score is the share of the item that the passage covers and
one threshold fits items of any length. All items at or above it are retrieved; nothing is ranked away.

A retrieved item counts only when both its question and its answer are found in the passage, by the
share of their word 3-grams. The question is the text up to its last question mark, the answer what
follows; without a mark, or with nothing after it, the two halves of the words. An item of under
``LEAST_WORDS`` words is too short to be weighed: it is found where all its words stand in sequence, with score
and shares 1. An item without words is found nowhere.

Index shards are broadcast. A shard holds at most ``SHARD_CHARS`` characters of items, and there are as
many shards as the items need, each with its own pass over the documents.
"""
from __future__ import annotations

import math
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType

from .common import kept, raw

K1, B = 1.2, 0.75
RETRIEVE, OVERLAP = 0.5, 0.6
BLOCK = 32
GRAM = 3
LEAST_WORDS = 4
SHARD_CHARS = 2_000_000
#: Words of one shard fit below this, and three of them with their count in 63 bits.
WORDS = 1 << 20
#: Leading and trailing characters that are not part of a word.
EDGES = b".,;:!?\"'()[]{}<>|#$%&*+-=/\\@^_`~"


def normal(word: bytes) -> bytes:
    """Lower case without marks at either end."""
    return word.strip(EDGES).decode("utf-8", "replace").lower().encode()


def terms(text: bytes) -> list[bytes]:
    return [w for w in map(normal, text.split()) if w]


def split_item(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    head, mark, tail = text.rpartition(b"?")
    question, answer = terms(head), terms(tail)
    if mark and question and answer:
        return question, answer
    words = terms(text)
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


class Words(dict):
    """Index number of each raw word, -1 where the index lacks it; emptied at a million words."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        w = normal(word)
        self[word] = n = self.numbers.get(w, -1) if w else -2
        return n


@dataclass
class Postings:
    """Items of one term in ascending order with weights, block ends and block maxima."""

    items: list[int]
    weights: list[float]
    ends: list[int] = field(default_factory=list)
    tops: list[float] = field(default_factory=list)
    top: float = 0.0

    def close(self) -> None:
        for k in range(0, len(self.items), BLOCK):
            self.ends.append(self.items[min(k + BLOCK, len(self.items)) - 1])
            self.tops.append(max(self.weights[k:k + BLOCK]))
        self.top = max(self.tops)


class Index:
    """Inverted index of test items given as (id, text).

    n_items, mean_words and frequency (items holding a word) describe all shards together.
    Items under ``LEAST_WORDS`` words are kept by the code of their words in sequence, apart from the postings.
    """

    def __init__(self, items: list[tuple], n_items: int, mean_words: float, frequency: dict[bytes, int],
                 threshold: float = RETRIEVE):
        self.threshold = threshold
        self.ids, self.parts, self.longest = [], [], LEAST_WORDS
        self.numbers: dict[bytes, int] = {}
        self.lists: list[Postings] = []
        short: list[tuple[object, list[bytes]]] = []
        for item_id, text in items:
            question, answer = split_item(text)
            words = question + answer
            if len(words) < LEAST_WORDS:
                if words:
                    short.append((item_id, words))
                continue
            counts: dict[bytes, int] = defaultdict(int)
            for w in words:
                counts[w] += 1
            k = K1 * (1 - B + B * len(words) / mean_words)
            weight = {w: math.log1p((n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * (K1 + 1) / (c + k)
                      for w, c in counts.items()}
            own = sum(weight.values())
            for w in counts:
                n = self.numbers.setdefault(w, len(self.numbers))
                if n == len(self.lists):
                    self.lists.append(Postings([], []))
                self.lists[n].items.append(len(self.ids))
                self.lists[n].weights.append(weight[w] / own)
            self.parts.append([self.grams(np.array([self.numbers[w] for w in p])) for p in (question, answer)])
            self.ids.append(item_id)
            self.longest = max(self.longest, len(words))
        for p in self.lists:
            p.close()
        self.short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item_id, words in short:  # their words get numbers above those with postings
            row = np.array([[self.numbers.setdefault(w, len(self.numbers)) for w in words]])
            self.short[len(words)][int(self.code(row)[0])].append(item_id)
        self.short = {n: dict(codes) for n, codes in self.short.items()}
        self._essential()

    def _essential(self) -> None:
        """Words that a passage needs: all others together bring no item to the threshold.

        Words of many items go to the others first, as long as no item gets more than part of the
        threshold from them. ``spare`` is what an item can get from the others; the posting lists of the
        essential words lie in flat arrays.
        """
        self.spare = np.zeros(len(self.ids))
        essential = np.zeros(len(self.numbers) + 2, bool)  # -1 and -2 too
        for n in sorted(range(len(self.lists)), key=lambda n: (-len(self.lists[n].items), n)):
            p = self.lists[n]
            if (self.spare[p.items] + p.weights).max() > 0.7 * self.threshold:
                essential[n] = True
            else:
                self.spare[p.items] += p.weights
        self.essential = essential
        sizes = [len(p.items) if essential[n] else 0 for n, p in enumerate(self.lists)]
        self.at = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        chosen = [p for n, p in enumerate(self.lists) if essential[n]]
        self.flat_items = np.array([i for p in chosen for i in p.items], np.int64)
        self.flat_weights = np.array([w for p in chosen for w in p.weights])

    def worth(self, numbers: np.ndarray) -> np.ndarray:
        """Passages in which some item can reach the threshold, judged by its essential words."""
        at = np.flatnonzero(self.essential[numbers])
        if not len(at):
            return at
        count = len(self.windows(len(numbers)))
        step = at // self.longest
        window, term = np.r_[step, step - 1], np.r_[numbers[at], numbers[at]]
        fits = (window >= 0) & (window < count)
        once = np.unique(window[fits] * len(self.lists) + term[fits])
        window, term = np.divmod(once, len(self.lists))
        sizes = self.at[term + 1] - self.at[term]
        where = np.repeat(self.at[term] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pair, back = np.unique(np.repeat(window, sizes) * len(self.ids) + self.flat_items[where], return_inverse=True)
        mass = np.bincount(back, self.flat_weights[where])
        window, item = np.divmod(pair, len(self.ids))
        return np.unique(window[mass + self.spare[item] >= self.threshold - 1e-9])

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """Distinct word 3-grams (or shorter, for shorter parts) as numbers; unknown words break them."""
        k = min(GRAM, len(numbers)) or 1
        rows = np.lib.stride_tricks.sliding_window_view(numbers, k) if len(numbers) >= k else np.empty((0, k), int)
        return np.unique(self.code(rows))

    @staticmethod
    def code(rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), rows.shape[1], np.int64)
        for col in rows.astype(np.int64).T:
            out = out * WORDS + col
        return out

    def retrieve(self, query: list[int]) -> list[tuple[int, float]]:
        """Items scoring at least the threshold for these distinct words, by block-max WAND."""
        lists, found, theta = [self.lists[n] for n in query], [], self.threshold - 1e-9
        at = [0] * len(lists)
        block = [0] * len(lists)
        live = list(range(len(lists)))
        while live:
            live.sort(key=lambda i: lists[i].items[at[i]])
            total, pivot = 0.0, None
            for rank, i in enumerate(live):
                total += lists[i].top
                if total >= theta:
                    pivot = rank
                    break
            if pivot is None:
                break
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            bound, next_end = 0.0, None
            for i in live[:pivot + 1]:
                p = lists[i]
                while block[i] < len(p.ends) and p.ends[block[i]] < item:
                    block[i] += 1
                if block[i] < len(p.ends):
                    bound += p.tops[block[i]]
                    next_end = p.ends[block[i]] if next_end is None else min(next_end, p.ends[block[i]])
            if bound < theta:
                goal = (next_end if next_end is not None else item) + 1
                if pivot + 1 < len(live):
                    goal = min(goal, lists[live[pivot + 1]].items[at[live[pivot + 1]]])
                goal = max(goal, item + 1)
            elif lists[live[0]].items[at[live[0]]] == item:
                score = sum(lists[i].weights[at[i]] for i in live[:pivot + 1])
                if score >= theta:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for i in live[:pivot + 1]:
                p = lists[i].items
                while at[i] < len(p) and p[at[i]] < goal:
                    at[i] += 1
            live = [i for i in live if at[i] < len(lists[i].items)]
        return found

    def windows(self, n: int) -> list[tuple[int, int]]:
        """Passages of a text of ``n`` words: overlapping, so that each run of ``longest`` words is in one."""
        step = self.longest
        return [(s, min(s + 2 * step, n)) for s in range(0, max(n - step, 1), step)]

    def search(self, numbers: np.ndarray, overlap: float = OVERLAP) -> list[tuple]:
        """(item id, score, question share, answer share) of the verified items of a text, best passage each."""
        numbers = numbers[numbers != -2]
        found = self.said(numbers) if self.short else []
        if not len(numbers) or not self.ids:
            return found
        spans, best = self.windows(len(numbers)), {}
        for k in self.worth(numbers).tolist():
            passage = numbers[slice(*spans[k])]
            query = np.unique(passage[(passage >= 0) & (passage < len(self.lists))])
            for item, score in self.retrieve(query.tolist()):
                shares = [self.share(passage, part) for part in self.parts[item]]
                if min(shares) >= overlap and (item not in best or (score, *shares) > best[item]):
                    best[item] = (score, *shares)
        return [(self.ids[i], *v) for i, v in sorted(best.items())] + found

    def said(self, numbers: np.ndarray) -> list[tuple]:
        """The short items whose words stand in the text in sequence."""
        out = []
        for n, codes in sorted(self.short.items()):
            if len(numbers) >= n:
                rows = np.lib.stride_tricks.sliding_window_view(numbers, n)
                there = np.intersect1d(self.code(rows[(rows >= 0).all(1)]), np.fromiter(codes, np.int64, len(codes)))
                out += [(i, 1.0, 1.0, 1.0) for c in there.tolist() for i in codes[c]]
        return out

    @staticmethod
    def share(passage: np.ndarray, part: np.ndarray) -> float:
        """Share of the part's n-grams found in the passage; the length of a code's n-gram is in the code."""
        if not len(part):
            return 1.0
        k = next(k for k in (1, 2, 3) if part[0] < (k + 1) * WORDS**k)
        if len(passage) < k:
            return 0.0
        rows = np.lib.stride_tricks.sliding_window_view(passage, k)
        return float(np.isin(part, Index.code(rows[(rows >= 0).all(1)])).mean())


def index_shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                shard_chars: int = SHARD_CHARS, threshold: float = RETRIEVE) -> list[tuple]:
    """Arguments of ``Index`` for each shard of the test items, of bounded size; word statistics are over all items."""
    items = benchmark.where(f"{text_col} is not null").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text") + 64).alias("chars")).first()
    n_shards = max(1, math.ceil((size["chars"] or 0) / (shard_chars / 2)))
    words = items.select("text", F.explode(F.array_distinct(_terms(F.col("text")))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    mean = items.agg(F.avg(F.size(_terms(F.col("text")))).alias("m")).first()["m"] or 1.0
    shards = []
    for k in range(n_shards):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_shards)) == k)
        rows = sorted(((r["id"], r["text"].encode()) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))
        own = part.select(F.explode(_terms(F.col("text"))).alias("word")).distinct()
        frequency = {r["word"]: r["n"] for r in counts.join(own, "word").collect()}
        shards.append((rows, size["n"], max(mean, 1.0), frequency, threshold))
    return shards


@F.arrow_udf(ArrayType(BinaryType()))
def _terms(text: pa.Array) -> pa.Array:
    return pa.array([terms(t) for t in raw(text)], pa.list_(pa.binary()))


def _reader(index: Index) -> tuple[Index, Words]:
    return index, Words(index.numbers)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", overlap: float = OVERLAP,
                 shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per (document, test item) found: ids, score, question_overlap, answer_overlap.

    Every window of every whole text is a query. Null or empty texts and null items match nothing; a
    repeated document or item repeats its rows; an item without id keeps a null id. Ids may be of any type.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    spark, found = docs.sparkSession, None
    arrow_item = to_arrow_type(benchmark.schema[item_col].dataType)
    for shard in index_shards(benchmark, item_col, item_text_col, shard_chars):
        held = spark.sparkContext.broadcast(shard)

        def run(batches, held=held, key=uuid.uuid4().hex):
            index, words = kept(("bm25", key), lambda: _reader(Index(*held.value)))
            for batch in batches:
                at, hits = [], []
                for row, text in enumerate(raw(batch.column(1))):
                    parts = text.split()
                    for hit in index.search(np.fromiter(map(words.__getitem__, parts), np.int64, len(parts)), overlap):
                        at.append(row)
                        hits.append(hit)
                cols = list(zip(*hits)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], arrow_item)]
                    + [pa.array(c, pa.float64()) for c in cols[1:]],
                    ["id", "item", "score", "question_overlap", "answer_overlap"])

        part = docs.select(id_col, text_col).mapInArrow(
            run, f"id {kind}, item {item_kind}, score double, question_overlap double, answer_overlap double")
        found = part if found is None else found.union(part)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})
