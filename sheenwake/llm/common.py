"""Helpers of the text operators: inputs, words, held-out rows, connected classes."""
from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
from collections.abc import Callable
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+:/", uri) else "file://" + os.path.abspath(uri))


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def kept(key: tuple, make: Callable):
    """The object of this key, made once a worker process and kept between its tasks.

    A worker holds one such object: making another lets go of it first, so that the tables of one stage
    do not stay in memory through the next. Code reaches workers by value, so that a module's own globals last for one
    task only.
    """
    store = _store()
    if key not in store:
        forget()
        store[key] = make()
    return store[key]


def forget() -> None:
    """Let go of what the worker keeps, and hand its memory back to the machine."""
    store = _store()
    if store:
        store.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def _store() -> dict:
    return sys.modules.setdefault("_sheenwake_worker", ModuleType("_sheenwake_worker")).__dict__.setdefault("kept", {})


class WordHashes(dict):
    """64-bit hash of every word met; ``hashes[word]`` computes what is new.

    The table is emptied when it holds ``limit`` words, so that its memory is bounded.
    """

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes`` methods treat ASCII alone, as the definition does."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b): columns node, root.

    Every round takes the smallest label among neighbours and then the label of that label, so
    chains shorten geometrically. Labels and edges are only joined and aggregated by key; each
    round is written to the shared folder, and an empty edge table gives an empty result.
    """
    both = cut_lineage(edges.where("a <> b").select("a", "b")
                       .union(edges.where("a <> b").select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"),
                                                F.least("root", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = cut_lineage(step.join(jump, "via", "left").select(
            "node", F.least("via", F.coalesce("far", "via")).alias("root"), "old"))
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
