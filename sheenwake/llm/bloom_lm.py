"""Language-model scoring with a log-frequency Bloom filter (operator 3).

N-gram counts of the training texts are quantised on a logarithmic scale: a count of level q puts the keys
(n-gram, 1) .. (n-gram, q) into a Bloom filter. To read a count, a worker probes level after level until one
is missing; the level reached stands for the mean count of its range. The bigram probability is

    (1 - weight) * (c(w) + 0.5) / (N + 0.5 * (V + 1)) + weight * c(v w) / c(v)

with all three counts from the filter. ``weight`` is the best of a grid on all training texts, each token being
taken out of its own counts; ``train_and_score`` tries the grid in the pass that scores the texts. The
probabilities use quantised counts and so do not sum to exactly one.

Counting: every task counts runs of ``RUN`` tokens, cuts the result by hash into segments and shuffles packed
arrays; a segment is then merged and filled into a filter of its own. The number of segments follows the
characters of the input, so a segment stays small and all n-grams are kept. Segments, with exact counts of
their words for the base score, are written to the shared folder.

Broadcasting: segments go to the workers in waves of at most ``WAVE_BYTES``. A wave is one file in the shared
folder that workers map into memory, so a machine holds it once however many workers read it; where the folder is no
local path, each worker reads it whole. Each wave adds what it knows of every token; after the last one all
counts are there. Where all fits in one wave, as in small corpora, there is one pass; otherwise the tokens'
levels travel from wave to wave as a packed column.
"""
from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..session import _shared_folder, cut_lineage
from .common import kept, lower_words, mix, open_uri, raw, remainder

END, START = b"\n", b" "
STEP = 1.5
HASHES = 8
RUN = 1_000_000
CHARS_A_SEGMENT = 4_000_000
WAVE_BYTES = 256_000_000
KEPT_WORDS = 150_000
#: Slots of a worker's table of the bigrams read last, a power of two.
MEMO = 1 << 20
WEIGHTS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def level_starts(step: float = STEP) -> np.ndarray:
    """Smallest count of each level from 1 on; levels without a whole number are left out."""
    out, x = [1], 1.0
    while out[-1] < 2**62:
        x *= step
        if int(np.ceil(x)) > out[-1]:
            out.append(int(np.ceil(x)))
    return np.array(out, np.int64)


STARTS = level_starts()
#: Count that a level stands for, level 0 being none: the middle of its whole numbers.
MEANT = np.r_[0.0, (STARTS[:-1] + STARTS[1:] - 1) / 2, float(STARTS[-1])]


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STARTS, counts, side="right")


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of each bigram from the hashes of its words."""
    return mix(mix(left) * np.uint64(0xD1342543DE82EF95) + right)


def _cells(keys: np.ndarray, level: int, size: np.ndarray | int):
    """The filter cells of (key, level), one array a hash function."""
    x = mix(keys ^ np.uint64((level * 0xA0761D6478BD642F) & (2**64 - 1)))
    y = mix(x) | np.uint64(1)
    for _ in range(HASHES):
        yield (x % size).astype(np.int64)
        x = x + y


class Filter:
    """Log-frequency Bloom filters of some segments, which begin at the byte ``starts`` of ``bits`` and are read there."""

    def __init__(self, segments: np.ndarray, sizes: np.ndarray, starts: np.ndarray, bits, count: int):
        self.count = np.uint64(count)
        self.size = np.ones(count, np.uint64)
        self.start = np.full(count, -1, np.int64)
        self.start[segments] = starts * 8
        self.size[segments] = sizes
        self.bits = np.frombuffer(bits, np.uint8)
        self.memo_keys = np.zeros(MEMO, np.uint64)
        self.memo_keys[0] = 1  # key 1 has another slot, so that key 0 is not taken for known
        self.memo_levels = np.zeros(MEMO, np.uint8)

    def here(self, keys: np.ndarray) -> np.ndarray:
        """Which keys belong to segments of this filter."""
        return self.start[(keys % self.count).astype(np.int64)] >= 0

    def remembered(self, keys: np.ndarray) -> np.ndarray:
        """``levels``, with those of keys met lately taken from a table of fixed size."""
        slot = (keys & np.uint64(MEMO - 1)).astype(np.int64)
        out = self.memo_levels[slot]
        miss = np.flatnonzero(self.memo_keys[slot] != keys)
        if len(miss):
            new, at = keys[miss], slot[miss]
            out[miss] = level = self.levels(new)
            self.memo_keys[at] = new
            own = self.memo_keys[at] == new
            self.memo_levels[at[own]] = level[own]
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, 0 where it is not in; keys of other segments are 0."""
        out = np.zeros(len(keys), np.uint8)
        at = np.flatnonzero(self.here(keys))
        level = 0
        while len(at):
            level += 1
            live, key = at, keys[at]
            segment = (key % self.count).astype(np.int64)
            size, start = self.size[segment], self.start[segment]
            x = mix(key ^ np.uint64((level * 0xA0761D6478BD642F) & (2**64 - 1)))
            y = mix(x) | np.uint64(1)
            for _ in range(HASHES):
                cell = (x % size).astype(np.int64) + start
                on = np.flatnonzero((self.bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
                if len(on) < len(live):
                    live, x, y, size, start = live[on], x[on], y[on], size[on], start[on]
                x = x + y
            out[live] = level
            at = live
        return out


def fill(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """A filter of these counts: its number of cells and its bytes (1.44 x HASHES bits an entry)."""
    level = levels(counts)
    size = max(64, int(np.ceil(level.sum() * HASHES / np.log(2) / 64)) * 64)
    cells = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in _cells(keys[level >= j], j, np.uint64(size)):
            cells[at] = True
    return size, np.packbits(cells, bitorder="little").tobytes()


class Words(dict):
    """Numbers words as they come, and keeps their hashes in an array."""

    def __init__(self):
        super().__init__()
        self.hash = np.empty(0, np.uint64)
        #: How often the numbering began anew; what is kept by number holds for one generation.
        self.generation = 0

    def clear(self):
        super().clear()
        self.hash = self.hash[:0]
        self.generation += 1

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens of the texts, and the number of tokens of each."""
        import xxhash

        if len(self) > KEPT_WORDS:
            self.clear()
        words = [lower_words(t) + [END] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if len(self) > len(self.hash):
            new = itertools.islice(self, len(self.hash), None)
            self.hash = np.r_[self.hash, np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)]
        return out, sizes


def _before(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of the word in front of each token, the start mark at the first."""
    import xxhash

    out = np.r_[np.uint64(0), hashes[:-1]]
    out[np.cumsum(sizes) - sizes] = np.uint64(xxhash.xxh64_intdigest(START))
    return out


def count_ngrams(docs: DataFrame, text_col: str, segments: int) -> DataFrame:
    """Packed partial counts (segment, order, keys, counts) of words and bigrams of the texts."""
    def run(batches):
        table, held, size = Words(), [], 0

        def flush():
            for order in (1, 2):
                keys = np.concatenate([h[order - 1] for h in held])
                keys.sort()
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                counts = np.diff(first, append=len(keys)).astype(np.uint32)
                keys = keys[first]
                part = (keys % np.uint64(segments)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                keys, counts, part = keys[by], counts[by], part[by]
                ends = np.searchsorted(part, np.arange(segments + 1))
                filled = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(filled, pa.int32()), pa.array([order] * len(filled), pa.int32()),
                     pa.array([keys[ends[k]:ends[k + 1]].tobytes() for k in filled], pa.binary()),
                     pa.array([counts[ends[k]:ends[k + 1]].tobytes() for k in filled], pa.binary())],
                    ["segment", "ngram_order", "keys", "counts"])

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                numbers, sizes = table.tokens(raw(batch.column(0).slice(k, 500)))
                h = table.hash[numbers]
                held.append((h, pair_keys(_before(h, sizes), h)))
                size += len(h)
                if size >= RUN:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(text_col).mapInArrow(run, "segment int, ngram_order int, keys binary, counts binary")


def _merge(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, back = np.unique(np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])).astype(np.int64)


def build_segments(counts: DataFrame) -> DataFrame:
    """One row a segment: tokens, distinct words, filter, and the words' exact counts."""
    def run(batches):
        # row by row, so that no more than a segment is copied out of a batch at once
        rows = (tuple(c[k].as_py() for c in b.columns) for b in batches for k in range(b.num_rows))
        for segment, group in itertools.groupby(rows, key=lambda r: r[0]):
            group = list(group)
            words, n = _merge([r for r in group if r[1] == 1])
            pairs, m = _merge([r for r in group if r[1] == 2])
            size, bits = fill(np.r_[words, pairs], np.r_[n, m])
            yield pa.RecordBatch.from_pylist([{
                "segment": segment, "tokens": int(n.sum()), "words": len(words), "cells": size, "bits": bits,
                "word_keys": words.tobytes(), "word_counts": n.tobytes()}], schema=pa.schema([
                    ("segment", pa.int32()), ("tokens", pa.int64()), ("words", pa.int64()), ("cells", pa.int64()),
                    ("bits", pa.binary()), ("word_keys", pa.binary()), ("word_counts", pa.binary())]))

    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (counts.repartition(n, "segment").sortWithinPartitions("segment", "ngram_order").mapInArrow(
        run, "segment int, tokens bigint, words bigint, cells bigint, bits binary, word_keys binary, word_counts binary"))


def _lay_out(rows, write) -> np.ndarray:
    """Write segments (number, cells, bits, word keys, word counts) end to end; where each lies.

    Columns of the result: number, cells, first byte of the bits, first 8-byte place of the keys, words. Keys are
    sorted, and the counts follow them.
    """
    table, at = [], 0
    for number, cells, bits, keys, counts in rows:
        table.append((number, cells, at, (at + len(bits)) // 8, len(keys) // 8))
        for part in (bits, keys, counts):  # each a whole number of 8 bytes
            write(part)
            at += len(part)
    return np.array(table, np.int64).reshape(-1, 5)


def _find(keys: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``wanted`` is among the sorted keys[low:high] of its own, and its place."""
    at, end = low.copy(), high.copy()
    live = np.flatnonzero(at < end)
    while len(live):
        middle = (at[live] + end[live]) >> 1
        less = keys[middle] < wanted[live]
        at[live[less]] = middle[less] + 1
        end[live[~less]] = middle[~less]
        live = live[at[live] < end[live]]
    hit = at < high
    hit[hit] = keys[at[hit]] == wanted[hit]
    return hit, at


class Wave:
    """What one wave brings: filters and exact word counts of some segments."""

    def __init__(self, packed: tuple, segments: int, room: float, reach: tuple[int, int]):
        self.room, self.segments, self.reach = room, np.uint64(segments), reach
        table, data = packed
        self.filter = Filter(table[:, 0], table[:, 1].astype(np.uint64), table[:, 2], data, segments)
        self.numbers = np.frombuffer(data, np.uint64)
        self.first, self.n_words = np.zeros(segments, np.int64), np.zeros(segments, np.int64)
        self.first[table[:, 0]], self.n_words[table[:, 0]] = table[:, 3], table[:, 4]
        self.words, self.known, self.generation = Words(), None, 0

    @staticmethod
    def pack(rows: list[tuple]) -> tuple:
        """Segments laid out in memory."""
        parts: list[bytes] = []
        return _lay_out(rows, parts.append), b"".join(parts)

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of all tokens, as far as known here: sizes of the texts, whether the training texts hold the word,
        its exact log10 share, its level, the level of the word in front, the level of the bigram.
        """
        numbers, sizes = self.words.tokens(texts)
        if self.known is None or self.generation != self.words.generation:
            self.generation = self.words.generation
            self.known = (np.empty(0, np.uint8), np.empty(0, bool), np.empty(0))
        new = self.words.hash[len(self.known[0]):]
        if len(new):
            part = (new % self.segments).astype(np.int64)
            first, n_words = self.first[part], self.n_words[part]
            hit, at = _find(self.numbers, first, first + n_words, new)
            count = np.zeros(len(new))
            count[hit] = self.numbers[at[hit] + n_words[hit]]
            mine = (part >= self.reach[0]) & (part < self.reach[1])
            share = np.where(mine, np.log10((count + 0.5) / self.room), 0.0)
            self.known = tuple(np.r_[a, b] for a, b in zip(self.known, (self.filter.levels(new), hit, share)))
        h = self.words.hash[numbers]
        level = self.known[0][numbers]
        front = np.r_[np.uint8(0), level[:-1]]
        front[np.cumsum(sizes) - sizes] = 0
        return sizes, self.known[1][numbers], self.known[2][numbers], level, front, self.filter.remembered(pair_keys(_before(h, sizes), h))


def _logs(word, front, pair, first, shape, weight: float, own: float = 0.0) -> np.ndarray:
    """log10 probability of each token from the counts meant by its levels, less ``own`` of each."""
    total, distinct, texts = shape
    w, v, p = (np.maximum(MEANT[x] - own, 0) for x in (word, front, pair))
    v[first] = max(texts - own, 1)
    base = (w + 0.5) / (total + 0.5 * (distinct + 1))
    rate = np.minimum(np.divide(p, v, out=np.zeros_like(p), where=v > 0), 1.0)
    return np.log10((1 - weight) * base + weight * rate)


class Grid:
    """Sums of ``_logs`` over texts for some weights; tokens of the same three levels are worked out once."""

    def __init__(self, sizes: np.ndarray, level: np.ndarray, front: np.ndarray, pair: np.ndarray, shape: tuple):
        self.sizes, self.shape = sizes, shape
        a = int(max(x.max(initial=0) for x in (level, front, pair))) + 1
        front = front.astype(np.int32)
        front[np.cumsum(sizes) - sizes] = a
        self.code = (front * a + level) * a + pair
        self.n_codes = (a + 1) * a * a
        self.met = np.flatnonzero(np.bincount(self.code, minlength=self.n_codes))
        rest, self.pair = np.divmod(self.met, a)
        self.front, self.level = np.divmod(rest, a)
        self.first = np.flatnonzero(self.front == a)
        self.front[self.first] = 0

    def sums(self, weights: tuple[float, ...], own: float = 0.0) -> np.ndarray:
        """One row a text, one column a weight."""
        out, logs = np.empty((len(self.sizes), len(weights))), np.zeros(self.n_codes)
        for k, w in enumerate(weights):
            logs[self.met] = _logs(self.level, self.front, self.pair, self.first, self.shape, w, own)
            out[:, k] = _sums(logs[self.code], self.sizes)
        return out


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)


HEAD = np.dtype([("known", "<i8"), ("base", "<f8")])
PACKED = np.dtype([("level", "u1"), ("front", "u1"), ("pair", "u1")])


class Model:
    """A trained model: its segment table, its totals and the weight of the bigram."""

    def __init__(self, segments: DataFrame, number: int, texts: int):
        self.segments, self.number = segments, number
        found = segments.agg(F.sum("tokens"), F.sum("words")).first()
        self.tokens, self.words, self.texts = found[0] or 0, found[1] or 0, texts
        sizes = sorted((r[0], r[1]) for r in segments.select(
            "segment", F.length("bits") + F.length("word_keys") * 2).collect())
        self.waves: list[list[int]] = []
        room = 0
        for segment, size in sizes:
            if not self.waves or size > room:
                self.waves.append([])
                room = WAVE_BYTES
            self.waves[-1].append(segment)
            room -= size
        self.weight = 0.0
        #: Counts and smoothing together, which the share of a word is taken of.
        self.room = self.tokens + 0.5 * (self.words + 1)
        self.sent: tuple | None = None

    def _send(self, wave: list[int]):
        """Getter of a wave on the workers; the wave sent last is used again."""
        if self.sent is None or self.sent[0] != wave:
            self.sent = None
            self.sent = (wave, self._broadcast(wave))
        return self.sent[1]

    def _broadcast(self, wave: list[int]):
        rows = (self.segments.where(F.col("segment").between(wave[0], wave[-1]))
                .select("segment", "cells", "bits", "word_keys", "word_counts").toLocalIterator())
        key = uuid.uuid4().hex
        path = f"{_shared_folder(self.segments.sparkSession)}/wave-{key}"
        fs, name = open_uri(path)
        with fs.open_output_stream(name) as sink:  # segment by segment; the driver never holds the wave
            table = _lay_out((tuple(r) for r in rows), sink.write)
        # a wave answers for all segments up to the next one's first, those without any n-gram too
        at = self.waves.index(wave)
        reach = (wave[0] if at else 0, self.waves[at + 1][0] if at + 1 < len(self.waves) else self.number)
        number, room = self.number, self.room
        return lambda: kept(("wave", key), lambda: Wave((table, _mapped(path)), number, room, reach))

    def look_up(self, docs: DataFrame, text_col: str, finish, out_type: str) -> DataFrame:
        """``docs`` with ``_lm``: what ``finish(sizes, known, base, level, front, pair)`` returns for each text.

        known and base are sums over the tokens of a text, the others are levels of each token.
        """
        room = self.room
        waves = self.waves or [[]]
        result = _parse_datatype_string(out_type)
        arrow_type = to_arrow_type(result)
        docs = docs.withColumn("_lm", F.lit(None).cast("binary"))
        for n, wave in enumerate(waves):
            get = self._send(wave) if wave else (lambda: Wave(Wave.pack([]), 1, room, (0, 1)))
            last = n == len(waves) - 1

            def run(text: pa.Array, state: pa.Array, get=get, last=last, first=n == 0) -> pa.Array:
                table, out = get(), []
                for k in range(0, len(text), 200):
                    sizes, hit, share, *each = table.look_up(raw(text.slice(k, 200)))
                    known, base = _sums(hit.astype(np.int64), sizes), _sums(share, sizes)
                    if not first:
                        part = state.slice(k, 200).to_pylist()
                        head = np.frombuffer(b"".join(p[:HEAD.itemsize] for p in part), HEAD)
                        old = np.frombuffer(b"".join(p[HEAD.itemsize:] for p in part), PACKED)
                        known, base = known + head["known"], base + head["base"]
                        each = [x + old[c] for x, c in zip(each, PACKED.names)]
                    if last:
                        out += finish(sizes, known, base, *each)
                    else:
                        rows, head = np.empty(len(each[0]), PACKED), np.empty(len(sizes), HEAD)
                        for c, x in zip(PACKED.names, each):
                            rows[c] = x
                        head["known"], head["base"] = known, base
                        ends = np.cumsum(sizes)
                        out += [h.tobytes() + rows[e - s:e].tobytes() for h, s, e in zip(head, sizes, ends)]
                return pa.array(out, arrow_type if last else pa.binary())

            step = F.arrow_udf(_two(run), result if last else "binary")
            docs = docs.withColumn("_lm", step(F.col(text_col), F.col("_lm")))
            if not last:
                docs = cut_lineage(docs)
        return docs


def _two(run):
    def call(text: pa.Array, state: pa.Array) -> pa.Array:
        return run(text, state)
    return call


def _mapped(path: str):
    """The bytes of a file: mapped, and so held once a machine, where it is a local one."""
    fs, name = open_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(name).read_buffer()
    with fs.open_input_file(name) as f:
        return f.read_buffer()


def _count(docs: DataFrame, text_col: str, chars_a_segment: int) -> Model:
    """Model of all the given texts, its weight not chosen yet."""
    size = docs.agg(F.sum(F.length(text_col)), F.count("*")).first()
    segments = max(64, int((size[0] or 0) // chars_a_segment))
    table = cut_lineage(build_segments(count_ngrams(docs, text_col, segments)))
    return Model(table, segments, size[1])


def _best(tried: DataFrame, logs: str) -> int:
    """Place in the grid of the weight whose log probabilities, summed over all rows, are highest."""
    found = tried.agg(*[F.sum(F.col(logs)[k]) for k in range(len(WEIGHTS))]).first()
    return int(np.argmax(found)) if found[0] is not None else 0


def train(docs: DataFrame, text_col: str = "text", chars_a_segment: int = CHARS_A_SEGMENT) -> Model:
    """Model of all the given texts (null: empty)."""
    model = _count(docs, text_col, chars_a_segment)
    shape = (model.tokens, model.words, model.texts)

    def finish(sizes, known, base, level, front, pair):
        return Grid(sizes, level, front, pair, shape).sums(WEIGHTS, 1.0).tolist()

    model.weight = WEIGHTS[_best(model.look_up(docs.select(F.col(text_col).alias("_text")), "_text", finish, "array<double>"), "_lm")]
    return model


def _with_scores(docs: DataFrame, lm_score: Column) -> DataFrame:
    x: Column = F.col("_lm")
    return docs.withColumns({"n_tokens": x["n"], "n_known": x["k"], "base_score": x["b"], "lm_score": lm_score}).drop("_lm")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and lm_score of every whole text.

    Columns of these names are replaced. A null or empty text is the end token alone; an untrained model
    (no text) knows nothing and gives every token its smoothing share.
    """
    shape, weight = (model.tokens, model.words, model.texts), model.weight

    def finish(sizes, known, base, level, front, pair):
        first = np.cumsum(sizes) - sizes
        cols = (sizes, known, base, _sums(_logs(level, front, pair, first, shape, weight), sizes))
        return [dict(zip(("n", "k", "b", "s"), row)) for row in zip(*(c.tolist() for c in cols))]

    found = model.look_up(docs, text_col, finish, "struct<n:bigint,k:bigint,b:double,s:double>")
    return _with_scores(found, F.col("_lm")["s"])


def train_and_score(docs: DataFrame, training: Column, text_col: str = "text",
                    chars_a_segment: int = CHARS_A_SEGMENT) -> tuple[DataFrame, Model]:
    """``score`` by the model of the rows where ``training`` holds, without the text, and that model.

    The waves are sent once: each text gets a score for every weight of the grid and, next to it, its log
    probabilities with its own counts taken out; those of the training texts choose the weight.
    """
    docs = docs.withColumn("_train", training)
    model = _count(docs.where("_train"), text_col, chars_a_segment)
    shape = (model.tokens, model.words, model.texts)

    def finish(sizes, known, base, level, front, pair):
        grid = Grid(sizes, level, front, pair, shape)
        cols = (sizes, known, base, grid.sums(WEIGHTS), grid.sums(WEIGHTS, 1.0))
        return [dict(zip(("n", "k", "b", "s", "t"), row)) for row in zip(*(c.tolist() for c in cols))]

    tried = cut_lineage(model.look_up(
        docs, text_col, finish, "struct<n:bigint,k:bigint,b:double,s:array<double>,t:array<double>>").drop(text_col))
    best = _best(tried.where("_train").select(F.col("_lm")["t"].alias("t")), "t")
    model.weight = WEIGHTS[best]
    return _with_scores(tried, F.col("_lm")["s"][best]).drop("_train"), model


def held_out(id_col: str = "doc_id") -> Column:
    """Texts that the model of the query does not learn from."""
    return remainder(id_col, 5) == 1
