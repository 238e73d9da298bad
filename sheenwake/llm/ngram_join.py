"""N-gram Jaccard join by MinHash banding (operator 9).

1. Every text becomes the set of its hashed word 5-grams. Texts with the same set are one class
   (a digest of the set is its key) and are never compared with each other.
2. ``plan_bands`` picks rows per band and the number of bands for the target recall at the threshold;
   band hashes of the distinct sets are shuffled on, and buckets of two sets or more remain. Buckets
   with equal members are kept once, the earliest band of them.
3. A bucket is cut into blocks of about ``BLOCK`` sets, and each pair of blocks is one row group: its
   members are compared there on their full sets. A pair of sets is compared in the first band it
   shares and nowhere else, so links are counted once, and no pair is ever written: a group returns
   for each member its number of links and the smallest member it is tied to.
4. ``connected`` joins those ties into groups.

A group of any size is thus spread over many row groups of bounded size, and nothing is left out.
"""
from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WordHashes, connected, kept, lower_words, mix, raw

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
BLOCK = 256


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 240) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which at most ``most`` hashes reach ``recall``.

    More rows mean fewer chance candidates; a pair at the threshold is found with probability
    1 - (1 - threshold^rows)^bands.
    """
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands <= 120 and bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding of this size reaches the recall")
    return best


def shingles(words: list[bytes], hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; fewer words than ``width`` are one n-gram."""
    if not words:
        return np.empty(0, np.uint64)
    w = hashes.of(words)
    k = min(width, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out ^ w[i:len(w) - k + 1 + i]) * np.uint64(0xD1342543DE82EF95)
    return np.unique(mix(out))


class Sketcher:
    """Digest and band hashes of shingle sets."""

    def __init__(self, bands: int, rows: int):
        draw = np.random.default_rng(7)
        self.bands, self.rows = bands, rows
        self.a = (draw.integers(0, 2**32, bands * rows, np.uint32) | np.uint32(1))[:, None]
        self.b = draw.integers(0, 2**32, bands * rows, np.uint32)[:, None]

    def bands_of(self, s: np.ndarray) -> np.ndarray:
        """One number a band, the band in its top byte, so that the order of numbers is that of bands."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(low, (x[None, i:i + 1024] * self.a + self.b).min(1), out=low)
        h = np.zeros(self.bands, np.uint64)
        for col in low.reshape(self.bands, self.rows).T.astype(np.uint64):
            h = mix(h ^ col) * np.uint64(0xD1342543DE82EF95)
        return ((np.arange(self.bands, dtype=np.uint64) << np.uint64(56)) | (mix(h) >> np.uint64(8))).astype(np.int64)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketch(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(id, digest, bands) of every text; both null where it has no word."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        hashes, maker = kept(("hashes",), WordHashes), Sketcher(bands, rows)
        for batch in batches:
            sets = [shingles(lower_words(t), hashes) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([maker.bands_of(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["id", "digest", "bands"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, digest binary, bands array<bigint>")


def full_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, n-grams as packed 64-bit numbers) of every text."""
    def run(batches):
        hashes = kept(("hashes",), WordHashes)
        for batch in batches:
            sets = [shingles(lower_words(t), hashes) for t in raw(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "grams"])

    return docs.select(text_col).mapInArrow(run, "digest binary, grams binary")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    values = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    same = values[1:] == values[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    values, owner = values[shared], owner[shared]
    code = np.r_[0, np.cumsum(values[1:] != values[:-1])] if len(values) else np.empty(0, int)
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        part = slice(*np.searchsorted(code, [start, start + 4096]))
        m = np.zeros((len(left) + len(right), 4096), np.float32)
        m[owner[part], code[part] - start] = 1
        out += m[:len(left)] @ m[len(left):].T
    return np.rint(out).astype(int)


def compare(rows: list[tuple], threshold: float) -> list[tuple[bytes, int, bytes]]:
    """(digest, links, smallest digest tied to) of the members of one pair of blocks.

    rows: (bucket, block, other block, own block, digest, bands, grams).
    """
    bucket, first, second = rows[0][:3]
    left = [r for r in rows if r[3] == first]
    right = left if first == second else [r for r in rows if r[3] == second]
    if not left or not right or (left is right and len(left) < 2):
        return []
    band = bucket >> 56
    bl, br = np.array([r[5] for r in left]), np.array([r[5] for r in right])
    new = np.ones((len(left), len(right)), bool)
    for k in range(band):
        new &= bl[:, None, k] != br[None, :, k]
    if left is right:
        new &= np.tri(len(left), k=-1, dtype=bool)
    keep_l, keep_r = np.flatnonzero(new.any(1)), np.flatnonzero(new.any(0))
    if not len(keep_l):
        return []
    gl = [np.frombuffer(left[i][6], np.uint64) for i in keep_l]
    gr = [np.frombuffer(right[i][6], np.uint64) for i in keep_r]
    both = _overlaps(gl, gr)
    total = np.array([len(g) for g in gl])[:, None] + np.array([len(g) for g in gr])[None, :] - both
    linked = np.zeros_like(new)
    linked[np.ix_(keep_l, keep_r)] = both >= threshold * total - 1e-9
    linked &= new
    a, b = np.nonzero(linked)
    if not len(a):
        return []
    names = [r[4] for r in left] + ([] if left is right else [r[4] for r in right])
    b = b + (0 if left is right else len(left))
    links = np.bincount(a, minlength=len(names)) + np.bincount(b, minlength=len(names))
    rank = np.argsort(sorted(range(len(names)), key=names.__getitem__))
    root = rank.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        if (low == root).all():
            break
        root = low
    by_rank = sorted(names)
    return [(names[i], int(links[i]), by_rank[root[i]]) for i in np.flatnonzero(links)]


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """Links and ties of each pair of blocks, by comparing full sets (digest, links, root)."""
    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out = []
        for _, group in itertools.groupby(rows(), key=lambda r: r[:3]):
            out += compare(list(group), threshold)
            if len(out) >= 10_000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    def pack(rows):
        a, b, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()),
                                           pa.array(c, pa.binary())], ["digest", "links", "root"])

    key = ["bucket", "first", "second"]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.select(*key, "block", "digest", "bands", "grams").repartition(n, *key)
            .sortWithinPartitions(*key, "digest")
            .mapInArrow(run, "digest binary, links bigint, root binary"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: id, class_id, n_links, n_copies.

    class_id is the smallest id among all documents reachable over links of Jaccard similarity
    ``threshold`` or more on word 5-grams (A-Z lower-cased); n_links counts the distinct other n-gram
    sets linked with the document's, n_copies the documents with its own set. A text without words, or
    a null one, is alone: its id, 0, 1. Rows without id are returned with a null class. Repeated rows
    are copies of each other; an id with two texts has a row for each. An empty table gives no rows.
    """
    bands, rows = plan_bands(threshold, recall)
    sk = cut_lineage(sketch(docs, id_col, text_col, bands, rows))
    named = sk.where("id is not null and digest is not null")
    sets = cut_lineage(named.groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")))
    cells = sets.select(F.explode("bands").alias("bucket"), "digest")
    filled = (cells.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("who"))
              .where("n > 1"))
    kept = filled.groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = cut_lineage(cells.join(kept, "bucket"))
    wanted = members.select("digest").distinct()
    chosen = sets.join(wanted, "digest").select("digest", "rep", "bands")
    grams = (full_sets(docs.join(chosen.select(F.col("rep").alias(id_col)).distinct(), id_col, "left_semi"),
                       id_col, text_col).dropDuplicates(["digest"]))
    full = chosen.select("digest", "bands").join(grams, "digest")
    parts = F.ceil(F.col("n") / BLOCK)
    blocks = (members.withColumn("parts", parts)
              .withColumn("block", F.pmod(F.xxhash64("digest", "bucket"), F.col("parts")))
              .join(full, "digest")
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
              .withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")))
    ties = cut_lineage(verified(blocks, threshold))
    links = ties.groupBy("digest").agg(F.sum("links").alias("n_links"))
    roots = connected(ties.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    tied = roots.withColumnRenamed("node", "digest").join(sets.select("digest", "rep"), "digest")
    lowest = tied.groupBy("root").agg(F.min("rep").alias("class_id"))
    joined = tied.join(lowest, "root").select("digest", "class_id").join(links, "digest")
    classes = cut_lineage(sets.join(joined, "digest", "left").select(
        "digest", F.coalesce("class_id", "rep").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), "n_copies"))
    own = F.col("digest").isNull() & F.col("id").isNotNull()
    return (sk.select("id", "digest").join(classes, "digest", "left")
            .select(F.col("id").alias(id_col),
                    F.when(own, F.col("id")).when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"),
                    F.when(own, F.lit(0)).when(F.col("id").isNotNull(), F.col("n_links")).cast("bigint").alias("n_links"),
                    F.when(own, F.lit(1)).when(F.col("id").isNotNull(), F.col("n_copies")).cast("bigint").alias("n_copies")))
