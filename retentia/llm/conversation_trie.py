"""Prefix trie of conversations by truncation peeling.

Every distinct sequence of first turns is a node.  Conversations are written
as sequences of turn digests, equal ones merged, and sorted, so that those with
a common prefix are neighbours.  Each task peels a run of neighbours from the
greatest depth down: conversations that end at a depth are merged with the
nodes that survived from below, the last turn is stripped, and what has become
equal is grouped, with the aggregates carried along.  One pass finds all nodes
of the run.

A node that spans several runs comes out in parts, which one grouping adds up.
For that all aggregates are sums: a task knows of each row how much of it the
row before shares, so it counts a node, a child or a leaf only where it first
appears; what the first row of a partition shares with the last one of the
partition before is known only afterwards and is set right by rows of their own.

Depths are worked through in blocks, deepest first, so that a conversation of
any length is held in pieces of ``BLOCK`` turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.base import join_counted
from retentia.operators.groups import numbered_within
from retentia.session import materialise

BLOCK = 4096
# Turns of a run that is peeled at once; a run has at least one row.
RUN = 1 << 19
FAMILY, HEAD = 5, 9
_MASK = np.uint64(2**63 - 1)
# Odd factors by depth make a prefix's key depend on the order of its turns.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_KEY = ["depth", "k1", "k2"]
PARTIAL = (
    "depth long, k1 long, k2 long, p1 long, p2 long, least long, n_convs long, n_children long, n_leaves long, saved_tokens long"
)


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``pos`` from 0, ``digest`` and ``bytes`` of each turn; texts go no further."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    # The length of the role tells where the text begins.
    digest = F.unhex(F.md5(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said)))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.struct(F.col(turn).alias("turn"), digest.alias("digest")).alias("at"),
        F.octet_length(said[1]).cast("long").alias("bytes"),
    )
    placed = numbered_within(rows, "conv", "at", "pos")
    return materialise(placed.select("conv", "pos", "at.digest", "bytes"), "turns")


def rebuilt(turns: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """``conv``, ``depth`` from 1, ``digest`` and ``bytes`` of the rebuilt conversations; depth 0 for those without a turn.

    Conversation c takes the first crc32(c) mod ``head`` turns of c - c mod
    ``family`` in place of its own.  Lists are of fewer than ``head`` turns.
    """
    base = F.col("conv") - F.col("conv") % family
    first = turns.where((F.col("conv") % family == 0) & (F.col("pos") < head - 1))
    heads = first.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("turns"))
    cut = F.when(F.col("conv") == base, F.lit(0)).otherwise(F.crc32(F.col("conv").cast("string")) % head)
    convs = turns.groupBy("conv").agg(F.max("pos").alias("last")).withColumn("cut", cut.cast("int")).withColumn("base", base)
    none = F.array().cast("array<struct<pos:bigint,digest:binary,bytes:bigint>>")
    taken = F.slice(F.coalesce("turns", none), F.lit(1), F.col("cut"))
    plan = convs.join(heads, "base", "left").select("conv", "cut", "last", taken.alias("taken"))
    plan = materialise(plan, "plan")
    lent = plan.select("conv", F.explode("taken").alias("t")).select("conv", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.bytes")
    moved = plan.select("conv", "cut", F.size("taken").alias("size"))
    own = turns.join(moved, "conv").where("pos >= cut")
    own = own.select("conv", (F.col("size") + F.col("pos") - F.col("cut") + 1).alias("depth"), "digest", "bytes")
    silent = plan.where((F.size("taken") == 0) & (F.col("last") < F.col("cut")))
    silent = silent.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return lent.unionByName(own).unionByName(silent)


def _powers(depths: np.ndarray) -> np.ndarray:
    """The factors to the power of each depth, modulo 2^64."""
    result = np.ones((len(depths), 2), np.uint64)
    square, left = np.tile(_FACTORS, (len(depths), 1)), depths.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        result[odd] *= square[odd]
        square *= square
        left = left >> np.uint64(1)
    return result


def _offsets(column: pa.Array) -> np.ndarray:
    places = column.offsets.to_numpy().astype(np.int64)
    return places - places[0]


def _keyed():
    """Digests of a segment to keys of its prefixes: running sums of digest times factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turns = batch.column("turns")
            at = _offsets(turns)
            flat = turns.flatten()
            digests = b"".join(flat.field("digest").to_pylist())
            values = np.frombuffer(digests, "<u8").astype(np.uint64).reshape(-1, 2)
            depths = flat.field("depth").to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(values * _powers(depths), axis=0, dtype=np.uint64)])
            keys = (sums[1:] - np.repeat(sums[at[:-1]], np.diff(at), axis=0)) & _MASK
            whole = (sums[at[1:]] - sums[at[:-1]]) & _MASK
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.astype(">u8").tobytes())])
            places = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv"), batch.column("block"), pa.ListArray.from_arrays(places, packed.cast(pa.binary())),
                    pa.ListArray.from_arrays(places, flat.field("bytes")), pa.array(whole[:, 0].astype(np.int64)), pa.array(whole[:, 1].astype(np.int64)),
                ],
                ["conv", "block", "seq", "bytes", "s1", "s2"],
            )

    return run


def segments(rows: DataFrame, block: int) -> DataFrame:
    """Rebuilt conversations in pieces of ``block`` turns: prefix keys, bytes, and the key ``e1``, ``e2`` before the piece."""
    turn = F.struct("depth", "digest", "bytes")
    place = F.greatest(F.floor((F.col("depth") - 1) / block), F.lit(0)).cast("int").alias("block")
    listed = rows.groupBy("conv", place).agg(F.sort_array(F.collect_list(F.when(F.col("depth") > 0, turn))).alias("turns"))
    schema = "conv long, block int, seq array<binary>, bytes array<long>, s1 long, s2 long"
    written = materialise(listed.mapInArrow(_keyed(), schema), "segments")
    # One row per piece of a long conversation; the others have a single piece.
    several = written.groupBy("conv").agg(F.max("block").alias("last"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = [F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")).over(before), F.lit(0)) % F.lit(str(2**63)).cast("decimal(38,0)") for c in ("s1", "s2")]
    entered = written.join(several.where("last > 0"), "conv").select(
        "conv", "block", "last", *[t.cast("long").alias(f"e{i}") for i, t in enumerate(total, 1)]
    )
    zero = F.lit(0).cast("long")
    joined = written.drop("s1", "s2").join(entered, ["conv", "block"], "left")
    last, before_it = F.coalesce("last", F.lit(0)), [F.coalesce(c, zero).alias(c) for c in ("e1", "e2")]
    return materialise(joined.select("conv", "block", last.alias("last"), *before_it, "seq", "bytes"), "pieces")


class _Rows:
    """Rows of a run as flat arrays; a row's prefix keys are ``keys[at[i]:at[i + 1]]``."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        seq, length = batch.column("seq"), batch.column("bytes")
        self.at = _offsets(seq)
        self.keys = np.frombuffer(b"".join(seq.flatten().to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        self.bytes = length.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.entry = np.stack([batch.column(c).to_numpy() for c in ("e1", "e2")], axis=1).astype(np.uint64)
        self.size = np.diff(self.at)
        self.least = batch.column("least").to_numpy()
        self.sums = np.stack([batch.column(c).to_numpy() for c in _SUMS], axis=1)

    def shared(self, i: int, j: int) -> int:
        """Turns that rows i and j have in common, -1 if even the key before them differs."""
        return _shared((self.entry[i], self.path(i)), (self.entry[j], self.path(j)))

    def path(self, i: int) -> np.ndarray:
        return self.keys[self.at[i] : self.at[i + 1]]


def _shared(one: tuple, other: tuple) -> int:
    if (one[0] != other[0]).any():
        return -1
    size = min(len(one[1]), len(other[1]))
    differ = (one[1][:size] != other[1][:size]).any(axis=1)
    return int(differ.argmax()) if differ.any() else size


def _peel(rows: _Rows, before: np.ndarray, leaf: np.ndarray, base: int) -> Iterator[pd.DataFrame]:
    """Nodes of a run of sorted rows, deepest first, as parts to be added up.

    ``before`` is what each row shares with the row before it and ``leaf``
    whether no row continues it.  Node rows hold their place among the rows
    (``rep``), their aggregates, and those of the conversations that end there.
    """
    rep = np.zeros(0, np.int64)
    least, sums = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
    by_size = np.argsort(rows.size, kind="stable")
    sizes = rows.size[by_size]
    for depth in range(int(sizes[-1]) if len(sizes) else -1, -1, -1):
        ended = by_size[np.searchsorted(sizes, depth, "left") : np.searchsorted(sizes, depth, "right")]
        own = rows.sums[ended].copy()
        own[:, 2] += leaf[ended]
        rep = np.concatenate([rep, ended])
        order = np.argsort(rep, kind="stable")
        rep, least = rep[order], np.concatenate([least, rows.least[ended]])[order]
        sums = np.concatenate([sums, own])[order]
        key = (rows.entry[rep] + (rows.keys[rows.at[rep] + depth - 1] if depth else np.uint64(0))) & _MASK
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        rep, key = rep[starts], key[starts]
        least, sums = np.minimum.reduceat(least, starts), np.add.reduceat(sums, starts, axis=0)
        fresh = (before[rep] < depth).astype(np.int64)  # the node's first row of all
        if depth:
            length = rows.bytes[rows.at[rep] + depth - 1]
            sums[:, 3] += (sums[:, 0] - fresh) * length
            above = (rows.entry[rep] + (rows.keys[rows.at[rep] + depth - 2] if depth > 1 else np.uint64(0))) & _MASK
        else:
            above = np.zeros_like(key)
        yield _frame(base + depth, key, above, least, sums)
        # Strip the last turn; a node passes its conversations on and is one child where it is new.
        sums = sums.copy()
        sums[:, 1] = fresh


def _frame(depth: int | np.ndarray, key: np.ndarray, above: np.ndarray, least: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    depths = np.full(len(key), depth, np.int64) if np.isscalar(depth) else depth
    columns = {"depth": depths, "k1": key[:, 0], "k2": key[:, 1], "p1": above[:, 0], "p2": above[:, 1], "least": least}
    columns = {k: v.astype(np.int64) for k, v in columns.items()}
    return pd.DataFrame(columns | {name: sums[:, i] for i, name in enumerate(_SUMS)})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        at = 0
        ends = _offsets(batch.column("seq"))[1:] if batch.num_rows else []
        while at < batch.num_rows:
            start = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, start + RUN, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _peeled(base: int):
    """Parts of nodes from a sorted partition, and its first and last row as ``edge``."""
    nodes = pa.schema([(c.split()[0], pa.int64()) for c in PARTIAL.split(", ")])

    def record(frames: list[pd.DataFrame], edge: pd.DataFrame | None = None) -> pa.RecordBatch:
        frame = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: np.zeros(0, np.int64) for c in nodes.names})
        batch = pa.RecordBatch.from_pandas(frame, schema=nodes, preserve_index=False)
        none = pa.nulls(len(frame), pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, none, none], [*nodes.names, "first", "last"]) if edge is None else edge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = held = None
        for batch in _runs(batches):
            # The last row waits for the one after it, which may continue it.
            both = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            rows = _Rows(both)
            if first is None:
                first = (rows.entry[0], rows.path(0), rows.bytes[: rows.size[0]])
            shares = np.array([rows.shared(i - 1, i) for i in range(1, both.num_rows)], np.int64)
            done = both.num_rows - 1
            if done:
                yield record(list(_part(rows, both, done, last, shares, base)))
                last = (rows.entry[done - 1], rows.path(done - 1))
            held = both.slice(done)
        if held is not None:
            rows = _Rows(held)
            yield record(list(_part(rows, held, 1, last, np.zeros(0, np.int64), base)))
            edges = [_pack(*first), _pack(rows.entry[0], rows.path(0), rows.bytes)]
            blank = [pa.nulls(1, pa.int64()) for _ in nodes.names]
            yield pa.RecordBatch.from_arrays([*blank, *[pa.array([e], pa.binary()) for e in edges]], [*nodes.names, "first", "last"])

    return run


def _part(rows: _Rows, batch: pa.RecordBatch, done: int, last: tuple | None, shares: np.ndarray, base: int) -> Iterator[pd.DataFrame]:
    """Peels the first ``done`` rows; ``shares`` reaches to the row after them, if there is one."""
    before = np.concatenate([[-1 if last is None else _shared(last, (rows.entry[0], rows.path(0)))], shares])[:done]
    after = np.full(done, -1, np.int64)
    after[: len(shares)] = shares[:done]
    mine = _Rows(batch.slice(0, done)) if done < batch.num_rows else rows
    leaf = (mine.sums[:, 1] == 0) & (after < mine.size)
    yield from _peel(mine, before, leaf.astype(np.int64), base)


def _pack(entry: np.ndarray, path: np.ndarray, lengths: np.ndarray) -> bytes:
    return entry.astype("<u8").tobytes() + path.astype("<u8").tobytes() + lengths.astype("<i8").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = (len(data) - 16) // 24
    entry, path = np.frombuffer(data, "<u8", 2).astype(np.uint64), np.frombuffer(data, "<u8", 2 * size, 16)
    return entry, path.astype(np.uint64).reshape(-1, 2), np.frombuffer(data, "<i8", size, 16 + 16 * size)


def _corrections(base: int):
    """Takes back what the first row of a partition and the last one of that before it counted twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for last, first in zip(batch["last"], batch["next"], strict=True):
                entry, path, lengths = _unpack(last)
                other = _unpack(first)
                same = _shared((entry, path), other[:2])
                if same < 0:
                    continue
                keys = (entry + np.concatenate([np.zeros((1, 2), np.uint64), path])) & _MASK
                sums = np.zeros((len(path) + 1, 4), np.int64)
                # The shared nodes were counted as new by both.
                sums[:same, 1] = -1
                again = lengths[:same]
                sums[1 : same + 1, 3] = np.cumsum(again[::-1])[::-1]
                sums[0, 3] = again.sum()
                if same == len(path):
                    sums[:, 2] = -1  # the last row is continued, so it was no leaf
                above = np.concatenate([np.zeros((1, 2), np.uint64), keys[:-1]])
                yield _frame(base + np.arange(len(keys)), keys, above, np.full(len(keys), np.iinfo(np.int64).max), sums)

    return run


def _nodes(rows: DataFrame, base: int) -> DataFrame:
    """Nodes of one block of depths, those at depth ``base`` included, from sequences and what continues them."""
    sequence = ["e1", "e2", "seq", "bytes"]
    merged = rows.groupBy(*sequence).agg(F.min("least").alias("least"), *[F.sum(c).alias(c) for c in _SUMS])
    placed = merged.repartitionByRange("e1", "e2", "seq").sortWithinPartitions("e1", "e2", "seq")
    found = placed.mapInArrow(_peeled(base), f"{PARTIAL}, first binary, last binary")
    parts = materialise(found.withColumn("part", F.spark_partition_id()), "peeled")
    # One row per partition that has rows.
    edges = parts.where("first IS NOT NULL").withColumn("next", F.lead("first").over(Window.orderBy("part")))
    mended = edges.where("next IS NOT NULL").select("last", "next").mapInPandas(_corrections(base), PARTIAL)
    both = parts.where("first IS NULL").drop("first", "last", "part").unionByName(mended)
    total = [F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("least").alias("least"), *[F.sum(c).alias(c) for c in _SUMS]]
    return materialise(both.groupBy(*_KEY).agg(*total), "nodes")


def _hashed():
    """SHA-256 of the sorted ids of each sequence; an id at a time, so a node of very many is never held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest, done = None, None, []

        def frame() -> pd.DataFrame:
            return pd.DataFrame(done, columns=[*_KEY, "ends_sha256"])

        for batch in batches:
            rows = zip(batch["conv"], batch["depth"], batch["e1"], batch["e2"], batch["final"], strict=True)
            for conv, depth, e1, e2, final in rows:
                if node != (depth, e1, e2, final):
                    if node is not None:
                        done.append((*_node(*node), digest.hexdigest()))
                    node, digest = (depth, e1, e2, final), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield frame()
            done.clear()
        if node is not None:
            done.append((*_node(*node), digest.hexdigest()))
            yield frame()

    return run


def _node(depth: int, e1: int, e2: int, final: bytes) -> tuple[int, int, int]:
    k1, k2 = np.frombuffer(final, ">u8").tolist()
    return int(depth), (int(e1) + k1) % 2**63, (int(e2) + k2) % 2**63


def _ends(pieces: DataFrame, block: int) -> DataFrame:
    """``ends_sha256`` of every node at which conversations end."""
    last = F.coalesce(F.try_element_at("seq", F.lit(-1)), F.unhex(F.lit("00" * 16)))
    ended = pieces.where("block = last").select(
        "conv", (F.col("block").cast("long") * block + F.size("seq")).alias("depth"), "e1", "e2", last.alias("final")
    )
    sequence = ["depth", "e1", "e2", "final"]
    return ended.repartition(*sequence).sortWithinPartitions(*sequence, "conv").mapInPandas(
        _hashed(), "depth long, k1 long, k2 long, ends_sha256 string"
    )


def trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    family: int = FAMILY, head: int = HEAD, block: int = BLOCK,
) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations.

    ``conv_id`` is the smallest member, ``depth`` the number of turns (0 for the
    root), ``parent_conv_id`` the parent's smallest member; ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` as the
    contract has them.  Turns are ordered by ``turn``, null first; equal ones by
    a digest of role and text, so repeated rows count as turns of their own.  A
    null role or text is empty, and rows without an id belong to no
    conversation.  Texts of any length are hashed where they are read; sequences
    are known by 128-bit digests and 126-bit keys.  Other columns are ignored.
    An empty table has no conversation and gives no row, not even the root.
    """
    pieces = segments(rebuilt(_turns(conversations, conv_id, turn, role, text), family, head), block)
    deepest = pieces.agg(F.max("block")).first()[0]
    zero = F.lit(0).cast("long")
    sums = [F.lit(1).cast("long").alias("n_convs"), *[zero.alias(c) for c in _SUMS[1:]]]
    columns = ["e1", "e2", "seq", "bytes"]
    nodes, below = None, None
    for at in range(deepest or 0, -1, -1):
        here = pieces.where(F.col("block") == at)
        rows = here.where("last = block").select(*columns, F.col("conv").alias("least"), *sums)
        if below is not None:
            # Nodes that survive from the block below, each on a conversation that goes through it.
            going = below.where(F.col("depth") == (at + 1) * block).select(F.col("least").alias("conv"), "least", *_SUMS)
            rows = rows.unionByName(here.select("conv", *columns).join(going, "conv").select(*columns, "least", *_SUMS))
        below = _nodes(rows, at * block)
        mine = below if at == 0 else below.where(F.col("depth") > at * block)
        nodes = mine if nodes is None else nodes.unionByName(mine)
    above = [(F.col("depth") - 1).alias("above"), "p1", "p2"]
    parents = nodes.select(F.col("depth").alias("above"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent"), F.col("n_children").alias("n"))
    linked = join_counted(nodes.select(*_KEY, *above, "least", *_SUMS), parents, ["above", "p1", "p2"], "n")
    joined = linked.join(_ends(pieces, block), _KEY, "left")
    return joined.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), *_SUMS,
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
