"""Prefix trie of conversations from mergeable partial tries.

A node is known by a hash of its turns, a sum of hashes of (depth, role, text): such sums of
consecutive turns can be taken piece by piece, so a conversation of any length is cut into
pieces of PIECE turn numbers and no task needs all of it.  Texts are hashed and counted by
the task that scans them and never shuffled.

Partitions of the rebuilt turns emit partial tries, node tables combined in the task; tables
are merged by hashed key, FAN partitions at a time, until one is left, summing members and
joining the lists of conversations that end at a node (in blocks of END_BLOCK ids, so that a
node where a third of all conversations end is many small lists).  Then sums roll up from the
leaves.  A node with one member needs no roll-up, its subtree is a path; for the others the
sums of all descendants fewer than 2^r levels below are doubled in round r, which takes
log2(depth) rounds whatever the shape of the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.llm.scratch import discard, stage
from siftline.llm.textops import word_count

PIECE, FAN, END_BLOCK, HELD_ROWS = 4096, 64, 1 << 16, 1 << 18
#: Characters of a text that order turns of one number; equal ones go by the hash of the whole.
ORDER_CHARS = 64
FAMILY = 20
_LOW = 0xFFFFFFFF
_PARTS = ("a", "b", "c", "d")


def _halves(*what: Column) -> list[Column]:
    """128 bits of hash of the columns as four numbers of 32 bits, whose sums do not overflow."""
    one, two = F.xxhash64(F.lit(1), *what), F.xxhash64(F.lit(2), *what)
    return [x.alias(n) for n, x in zip(_PARTS, (one.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(one, 32), two.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(two, 32)), strict=True)]


def head_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its family: crc32 of its decimal id, modulo 4."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("long")


def _turn_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, piece, turn, role, begin, t1, t2, words, repeats): texts as hashes, equal rows as one with a count."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    t = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, ORDER_CHARS).alias("begin"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"), word_count(text).alias("words")).where("conv is not null")
    piece = F.when(F.col("turn").isNull(), F.lit(-(1 << 62))).otherwise(F.floor(F.col("turn") / PIECE)).cast("long")
    t = t.select("conv", piece.alias("piece"), "turn", "role", "begin", "t1", "t2", "words")
    return stage(t.groupBy("conv", "piece", "turn", "role", "begin", "t1", "t2", "words").agg(F.count(F.lit(1)).alias("repeats")), "turns")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, piece, depth, words, a..d) for every turn of the rebuilt conversations; (conv, length) of each."""
    before = F.sum("n").over(W.partitionBy("conv").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    pieces = turns.groupBy("conv", "piece").agg(F.sum("repeats").alias("n")).withColumn("start", F.coalesce(before, F.lit(0)))
    in_piece = W.partitionBy("conv", "piece").orderBy(F.asc_nulls_first("turn"), "role", "begin", "t1", "t2")
    last = F.sum("repeats").over(in_piece.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = turns.withColumn("first", last - F.col("repeats")).join(pieces, ["conv", "piece"])
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1))
    placed = stage(placed.select("conv", "piece", "role", "t1", "t2", "words", (F.col("start") + F.col("first")).alias("first"), at.alias("again")).select("conv", "piece", "role", "t1", "t2", "words", (F.col("first") + F.col("again")).alias("pos")), "placed-turns")
    lengths = pieces.groupBy("conv").agg(F.sum("n").alias("own"))
    base = F.col("conv") - F.col("conv") % FAMILY
    firsts = lengths.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    plans = lengths.withColumn("h", head_turns(F.col("conv"))).withColumn("base", base).join(firsts, "base", "left")
    plans = plans.withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0)))).withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plans = stage(plans.select("conv", "base", "h", "head", "length"), "conversation-plans")
    heads = placed.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < 3)).select(F.col("conv").alias("base"), "role", "t1", "t2", "words", "pos")
    from_base = plans.join(heads, "base").where("pos < head").select("conv", F.lit(None).cast("long").alias("piece"), (F.col("pos") + 1).alias("depth"), "words", "role", "t1", "t2")
    # a piece reads its conversation's numbers once, so that a long conversation is many keys here as well
    own = placed.join(pieces.select("conv", "piece").join(plans.select("conv", "h", "head"), "conv"), ["conv", "piece"]).where("pos >= h")
    own = own.select("conv", "piece", (F.col("pos") - F.col("h") + F.col("head") + 1).alias("depth"), "words", "role", "t1", "t2")
    rows = from_base.unionAll(own)
    return stage(rows.select("conv", "piece", "depth", "words", *_halves("depth", "role", "t1", "t2")), "rebuilt-turns"), plans.select("conv", "length")


def _node_rows(rebuilt: DataFrame, plans: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, depth, conv, words, ends): the node that each turn of each conversation leads to, the root's for all."""
    piece = F.coalesce("piece", F.lit(-(1 << 63)))
    rows = rebuilt.withColumn("piece", piece)
    sums = rows.groupBy("conv", "piece").agg(*[F.sum(c).alias(f"{c}_all") for c in _PARTS])
    before = W.partitionBy("conv").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("conv", "piece", *[F.coalesce(F.sum(F.col(f"{c}_all").bitwiseAND(F.lit(_LOW))).over(before), F.lit(0)).alias(f"{c}_start") for c in _PARTS]).join(plans, "conv")
    so_far = W.partitionBy("conv", "piece").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = rows.select("*", *[F.sum(c).over(so_far).alias(f"{c}_sum") for c in _PARTS]).join(starts, ["conv", "piece"])
    low = {c: (F.col(f"{c}_sum") + F.col(f"{c}_start")).bitwiseAND(F.lit(_LOW)) for c in _PARTS}
    above = {c: (F.col(f"{c}_sum") + F.col(f"{c}_start") - F.col(c)).bitwiseAND(F.lit(_LOW)) for c in _PARTS}

    def pair(x: dict[str, Column], one: str, two: str) -> Column:
        return F.shiftleft(x[one], 32).bitwiseOR(x[two])

    nodes = met.select(pair(low, "a", "b").alias("k1"), pair(low, "c", "d").alias("k2"), pair(above, "a", "b").alias("p1"), pair(above, "c", "d").alias("p2"), "depth", "conv", "words", (F.col("depth") == F.col("length")).alias("ends"))
    none = F.lit(0).cast("long")
    roots = plans.select(none.alias("k1"), none.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), none.alias("depth"), "conv", none.alias("words"), (F.col("length") == 0).alias("ends"))
    return nodes.unionAll(roots)


_PARTIAL = "part long, k1 long, k2 long, p1 long, p2 long, depth long, conv long, words long, n long, end_block long, ends binary"


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node table of a task, and its lists of ends (rows with ``end_block``); what HELD_ROWS rows give is handed on at once."""
    part = TaskContext.get().partitionId()

    def combined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes = rows.group_by(["k1", "k2", "p1", "p2", "depth", "words"]).aggregate([("conv", "min"), ("conv", "count")])
        n = nodes.num_rows
        cols = {"k1": nodes["k1"], "k2": nodes["k2"], "p1": nodes["p1"], "p2": nodes["p2"], "depth": nodes["depth"], "conv": nodes["conv_min"], "words": nodes["words"], "n": nodes["conv_count"]}
        arrays = [pa.array(np.full(n, part)), *(c.combine_chunks() for c in cols.values()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
        yield from pa.Table.from_arrays(arrays, names=["part", *cols, "end_block", "ends"]).to_batches(8192)
        ended = rows.filter(rows["ends"])
        k1, k2, conv = (ended[c].to_numpy() for c in ("k1", "k2", "conv"))
        block = conv // END_BLOCK
        order = np.lexsort((conv, block, k2, k1))
        k1, k2, conv, block = k1[order], k2[order], conv[order], block[order]
        if len(k1):
            first = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (block[1:] != block[:-1])])
            end = np.r_[first[1:], len(k1)]
            m = len(first)
            lists = pa.array([conv[a:b].tobytes() for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())
            nothing = pa.nulls(m, pa.int64())
            yield from pa.Table.from_arrays([pa.array(np.full(m, part)), pa.array(k1[first]), pa.array(k2[first]), nothing, nothing, nothing, nothing, nothing, nothing, pa.array(block[first]), lists], names=[f.split()[0] for f in _PARTIAL.split(", ")]).to_batches(8192)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD_ROWS:
            yield from combined(pa.Table.from_batches(held))
            held = []
    if held:
        yield from combined(pa.Table.from_batches(held))


def _merged(tables: DataFrame, parts: int) -> DataFrame:
    """Node tables of all partitions as one: FAN at a time by key, sums of members and least conversation."""
    while True:
        parts = -(-parts // FAN)
        keys = ["k1", "k2"] if parts == 1 else ["k1", "k2", F.floor(F.col("part") / FAN).cast("long").alias("part")]
        tables = tables.groupBy(*keys).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.first("words").alias("words"), F.sum("n").alias("n"))
        if parts == 1:
            return tables


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids that end at each node, from rows sorted by key and block of ids."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        out = []
        for k1, k2, _, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (k1, k2):
                if key:
                    out.append((*key, state.hexdigest()))
                key, state, first = (k1, k2), hashlib.sha256(), True
            ids = np.sort(np.concatenate([np.frombuffer(x, np.int64) for x in lists]))
            state.update((("" if first else ",") + ",".join(map(str, ids.tolist()))).encode())
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "digest"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "digest"])


def _rolled_up(shared: DataFrame) -> DataFrame:
    """(k1, k2, leaves, saved): sums of ``leaf`` and ``own`` over the subtree of each node of (k1, k2, p1, p2, depth, leaf, own).

    In round r a node holds the sums of its descendants fewer than 2^r levels below and the
    key of its ancestor 2^r levels above; what the nodes exactly 2^r below hold is added.
    """
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    now = stage(shared.select("k1", "k2", F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("leaf").alias("leaves"), F.col("own").alias("saved")), "roll-up")
    for _ in range(int(deepest).bit_length()):
        given = now.where("u1 is not null").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = now.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("n1"), F.col("u2").alias("n2"))
        after = now.join(given, ["k1", "k2"], "left").join(above, ["u1", "u2"], "left")
        after = after.select("k1", "k2", F.col("n1").alias("u1"), F.col("n2").alias("u2"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        after = stage(after, "roll-up")
        discard(now)
        now = after
    return now.select("k1", "k2", "leaves", "saved")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn number, null first; turns of one number by role, then by the
    first ORDER_CHARS characters of the text, then by its hash, so that reruns agree.  Equal rows are as many equal turns.  A null role
    or text is empty; rows without a conversation are left out.  Texts of any length are read
    whole.  Other columns are ignored, whatever their names; an empty table has no root.
    """
    turns = _turn_rows(conversations, conv_col, turn_col, role_col, text_col)
    rebuilt, plans = _rebuilt(turns)
    partial = stage(_node_rows(rebuilt, plans).mapInArrow(_partial_tries, _PARTIAL), "partial-tries")
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    nodes = stage(_merged(partial.where("end_block is null").select("part", "k1", "k2", "p1", "p2", "depth", "conv", "words", "n"), parts), "trie-nodes")
    lists = partial.where("end_block is not null").groupBy("k1", "k2", "end_block").agg(F.collect_list("ends").alias("lists"))  # at most END_BLOCK ids, each conversation ends once
    digests = lists.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "end_block").mapInArrow(_digests, "k1 long, k2 long, digest string")

    # what children tell their parents: how many they are, and how many of them are paths of one conversation
    counts = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children"), F.sum((F.col("n") == 1).cast("long")).alias("paths"))
    told = stage(nodes.join(counts, ["k1", "k2"], "left").join(digests, ["k1", "k2"], "left").withColumns({"children": F.coalesce("children", F.lit(0)), "paths": F.coalesce("paths", F.lit(0))}), "told-nodes")
    common = told.where("n > 1").select("k1", "k2", "p1", "p2", "depth", (F.col("paths") + (F.col("children") == 0).cast("long")).alias("leaf"), ((F.col("n") - 1) * F.col("words")).alias("own"))
    sums = _rolled_up(common)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    root = nodes.where("depth = 0").limit(1).select(F.col("conv").alias("root_conv"))  # one row
    placed = told.join(sums, ["k1", "k2"], "left")
    below = placed.where("depth > 1").join(parents, ["p1", "p2"])
    top = placed.where("depth <= 1").join(F.broadcast(root)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv"))).drop("root_conv")
    out = below.unionByName(top)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("digest", F.lit(nothing)).alias("ends_sha256"))
