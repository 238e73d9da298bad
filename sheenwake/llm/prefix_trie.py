"""Trie of conversations that begin alike, rolled up in depth bands (operator 11).

A node is a distinct sequence of the first d turns, d = 0 being the root. Texts never travel: a turn is two
64-bit hashes of (role, text) and its size, and a node's key is its depth and the exclusive or of hashes of
(place, turn), 128 bits in all. Such keys can be put together from parts, so a conversation of any length is
numbered by ranges of the sorted rows and keyed by blocks of ``BLOCK`` turns; one small row a range or block
carries what comes before it. No task holds a conversation.

Subtree sums go up in bands of ``HEIGHT`` depths. Every node adds itself to its ancestors in its own band,
found on the path of its smallest member, at most ``HEIGHT`` rows. The tops of the bands then form a trie of a
``HEIGHT``-th of the depth, which is rolled up the same way, and each completed top adds its total to
its ancestors in the band above. Depth D takes log D rounds to the base of ``HEIGHT``, and a node makes at
most ``HEIGHT`` rows in each.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HEIGHT = 16
BLOCK = 4096
#: Parents of more children than this are sent to all tasks: at most one node in so many is one.
MANY_CHILDREN = 10_000
IDS_A_CHUNK = 1 << 16
KEY = ["depth", "ka", "kb"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, one, two, size) of every conversation, pos from 0, and (conv, n), its number of turns.

    Turns are ordered by ``turn_col``, null first; equal ones by a hash of role and text, the same in every run;
    repeated rows each count. Null role or text is empty. Rows without a conversation number, or with one
    that is no whole number, belong to none and are left out. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    order = [F.col("turn").asc_nulls_first(), "one", "two"]
    narrow = conversations.select(
        F.col(conv_col).try_cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("one"), F.xxhash64(F.lit(2), role, text).alias("two"),
        F.octet_length(text).cast("bigint").alias("size")).where("conv is not null")
    ranges = cut_lineage(narrow.repartitionByRange(_partitions(narrow), "conv", *order)
                         .withColumn("span", F.spark_partition_id()))
    parts = cut_lineage(ranges.groupBy("conv", "span").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    # a range cuts at most one conversation, so this has no more rows than there are ranges
    carried = parts.withColumn("before", F.sum("n").over(earlier)).where("before > 0").drop("n")
    here = F.row_number().over(Window.partitionBy("span", "conv").orderBy(*order))
    turns = (ranges.withColumn("here", here).join(F.broadcast(carried), ["span", "conv"], "left")
             .select("conv", (F.col("here") - 1 + F.coalesce("before", F.lit(0))).cast("bigint").alias("pos"),
                     "one", "two", "size"))
    return turns, parts.groupBy("conv").agg(F.sum("n").alias("n"))


def share_heads(turns: DataFrame, convs: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % ``group``, then c's own after its first h.

    h is the crc32 of c in decimals modulo ``most``. ``turns`` and ``convs`` are those of ``numbered``, and so
    are the results; a rebuilt conversation without turns stays in the second.
    """
    convs = cut_lineage(convs.withColumns({
        "h": F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)),
        "base": F.col("conv") - F.col("conv") % group}))
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = cut_lineage(convs.join(sizes, "base", "left").withColumn(
        "m", F.least("h", F.coalesce("n_base", F.lit(0))).cast("bigint")))
    turns = cut_lineage(turns.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint")))
    # one row a block, so that a long conversation is joined in pieces
    by_block = convs.select("conv", "h", "m", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK).cast("bigint"))).alias("block"))
    own = (turns.join(by_block, ["conv", "block"]).where("pos >= h")
           .select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "one", "two", "size"))
    heads = (turns.where((F.col("pos") < most) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
             .join(convs.select("conv", "base", "h"), "base").where("pos < h")
             .select("conv", "pos", "one", "two", "size"))
    return own.unionByName(heads), convs.select("conv", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _paths(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """One row a conversation and node it belongs to: conv, depth, ka, kb, the parent's pa and pb, size of the last text."""
    rows = cut_lineage(turns.select(
        "conv", F.floor(F.col("pos") / block).cast("bigint").alias("block"), "pos", "size",
        F.xxhash64(F.lit(3), "pos", "one", "two").alias("a"), F.xxhash64(F.lit(4), "pos", "one", "two").alias("b")))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    # what the blocks before add stands in front of a block's rows as one more
    carried = (sums.withColumns({c: F.bit_xor(c).over(earlier) for c in "ab"}).where("block > 0")
               .select("conv", "block", F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("size"), "a", "b"))
    so_far = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    keyed = (rows.unionByName(carried).withColumns({"ka": F.bit_xor("a").over(so_far), "kb": F.bit_xor("b").over(so_far)})
             .where("pos >= 0").select(
                 "conv", (F.col("pos") + 1).alias("depth"), "ka", "kb", F.col("ka").bitwiseXOR(F.col("a")).alias("pa"),
                 F.col("kb").bitwiseXOR(F.col("b")).alias("pb"), "size"))
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), zero.alias("pa"),
                         zero.alias("pb"), zero.alias("size"))
    return keyed.unionByName(roots)


def _to_ancestors(nodes: DataFrame, paths: DataFrame, height: int, bands_up: int) -> DataFrame:
    """Rows of ``nodes`` under the key of each ancestor in the band so many above their own, themselves included at 0."""
    band = F.floor(F.col("depth") / height)
    low = nodes.select("conv", (band - bands_up).alias("band"), F.col("depth").alias("from"), "leaves", "saved")
    return (low.join(paths.select("conv", band.alias("band"), *KEY), ["conv", "band"]).where("depth <= from")
            .select(*KEY, "leaves", "saved", F.when(F.col("from") == F.col("depth"), F.col("conv")).alias("conv")))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("conv").alias("conv"))


def roll_up(nodes: DataFrame, paths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Sums of leaves and saved over the subtree of every node.

    ``nodes``: depth, ka, kb, conv (a member of the node), leaves, saved. ``paths``: conv, depth, ka, kb of all
    nodes that a conversation runs through, from depth 0 without a gap.
    """
    inside = cut_lineage(_sums(_to_ancestors(nodes, paths, height, 0)))
    deepest = inside.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < height:
        return inside
    at_top, level = F.col("depth") % height == 0, (F.col("depth") / height).cast("bigint")
    tops = roll_up(inside.where(at_top).withColumn("depth", level),
                   cut_lineage(paths.where(at_top).select("conv", level.alias("depth"), "ka", "kb")), height)
    done = tops.where("depth > 0").withColumn("depth", F.col("depth") * height)
    return cut_lineage(_sums(inside.unionByName(_to_ancestors(done, paths, height, 1))))


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conversation numbers of every key.

    A digest runs over its text from front to back, but the text is made in ranges: a key of many numbers
    becomes chunks, and one task reads a key's chunks one after the other.
    """
    n = _partitions(ends)
    kind = "depth bigint, ka bigint, kb bigint, first bigint, ids binary"

    def chunks(batches):
        at, ids = None, []
        for batch in batches:
            out = []
            for depth, ka, kb, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, ka, kb) != at or len(ids) >= IDS_A_CHUNK:
                    if ids:
                        out.append((*at, ids))
                    at, ids = (depth, ka, kb), []
                ids.append(conv)
            yield _chunk_rows(out)
        if ids:
            yield _chunk_rows([(*at, ids)])

    def hashed(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for depth, ka, kb, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if (depth, ka, kb) != at:
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, ka, kb), hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield _digest_rows(out)
        if at:
            yield _digest_rows([(*at, state.hexdigest())])

    parts = (ends.select(*KEY, "conv").repartitionByRange(n, *KEY, "conv").sortWithinPartitions(*KEY, "conv")
             .mapInArrow(chunks, kind))
    return (parts.repartition(n, *KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(hashed, "depth bigint, ka bigint, kb bigint, ends_sha256 string"))


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows)] or [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array([x[0] for x in cols[3]], pa.int64()),
         pa.array([",".join(map(str, x)).encode() for x in cols[3]], pa.binary())], [*KEY, "first", "ids"])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows)] or [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [*KEY, "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT, block: int = BLOCK,
                many_children: int = MANY_CHILDREN) -> DataFrame:
    """Every node of the trie of ``turns`` (conv, pos, one, two, size; pos from 0 without gaps) and ``convs`` (conv, n).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Conversations without turns are members of the root. No conversations: no rows, not even a root.
    """
    paths = cut_lineage(_paths(turns, convs, block))
    nodes = cut_lineage(paths.groupBy(*KEY, "pa", "pb").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("size").alias("size")))
    children = (nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
                .agg(F.count("*").alias("n_children")))
    nodes = cut_lineage(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                        .withColumns({"leaves": (F.col("n_children") == 0).cast("bigint"),
                                      "saved": (F.col("n_convs") - 1) * F.col("size")}))
    totals = roll_up(nodes.select(*KEY, "conv", "leaves", "saved"), paths.select("conv", *KEY), height)
    totals = totals.select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = paths.groupBy("conv").agg(F.max("depth").alias("depth"), F.max_by("ka", "depth").alias("ka"),
                                     F.max_by("kb", "depth").alias("kb"))
    whole = nodes.join(totals, KEY).join(_digests(ends), KEY, "left")

    above = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"),
        F.col("conv").alias("parent"), ((F.col("n_children") > many_children) | (F.col("depth") == 0)).alias("many"))
    on = ["depth", "pa", "pb"]
    marked = cut_lineage(whole.join(F.broadcast(above.where("many").drop("many")), on, "left"))
    settled = (F.col("depth") == 0) | F.col("parent").isNotNull()
    found = marked.where(settled).unionByName(
        marked.where(~settled).drop("parent").join(above.where("not many").drop("many"), on))
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
