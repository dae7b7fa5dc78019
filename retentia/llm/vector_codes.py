"""Codes of vectors by parts: codebooks fitted and parts assigned on a trie.

A vector is cut into equal consecutive parts; each part position has its own
codebook.  The distinct parts of a position, in lexicographic order, are the
leaves of a trie with one level per component.  A traversal in that order
keeps, for the path to the current leaf, the squared distances to all entries
accumulated over the components so far, so parts that begin alike share them.
At a leaf the nearest entry is the first minimum, and the part's components
times its number of copies are added to that entry's sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.base import join_counted
from retentia.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Leaves whose distances are held at once, and components of a piece of a batch.
RUN, PIECE = 4096, 1 << 19
_OFFSET = 1 << 31


def largest(dims: int) -> int:
    """Components are held within this, so that a vector's squared distances fit in 64 bits."""
    return 1 << ((62 - max(1, dims - 1).bit_length()) // 2 - 1)


def _finite(x: Column) -> Column:
    wide = x.cast("double")
    return x.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < float("inf"))


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """``vec_id``, ``label`` and ``v``, the components as integers, of the rows that count."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("x"))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0) & F.forall("x", _finite))
    # The product is taken in double, whose floor is exact for any float.
    held = F.transform("x", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(2**31)), F.lit(-(2**31))))
    written = materialise(rows.select("vec_id", "label", held.alias("v")), "whole")
    first = written.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    size = first[0] if first else parts
    most = largest(size)
    within = F.transform("v", lambda x: F.greatest(F.least(x, F.lit(most)), F.lit(-most)).cast("int"))
    return written.where(F.size("v") == size).select("vec_id", "label", within.alias("v"))


def assign(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each leaf and its squared distance; leaves are distinct and in order.

    Runs of leaves are traversed one after the other.  In a run each level
    computes one vector of distances per node, from that of its parent.
    """
    codes, least = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
    for at in range(0, len(leaves), RUN):
        run = leaves[at : at + RUN]
        fresh = np.ones(len(run), bool)  # leaves that begin a node of this level
        fresh[1:] = False
        far = np.zeros((1, len(book)), np.int64)
        parent = np.zeros(len(run), np.int64)
        for level in range(run.shape[1]):
            fresh[1:] |= run[1:, level] != run[:-1, level]
            first = np.flatnonzero(fresh)
            step = run[first, level][:, None] - book[:, level]
            far = far[parent[first]] + step * step
            parent = np.cumsum(fresh) - 1
        near = far.argmin(axis=1)
        codes[at : at + RUN] = near[parent]
        least[at : at + RUN] = far[np.arange(len(near)), near][parent]
    return codes, least


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, each row's place among them, and their counts."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place, np.bincount(place)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            size = len(batch.column(column)[0])
            step = max(1, PIECE // size)
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                yield piece, _matrix(piece.column(column))


def distinct_parts(whole: DataFrame, parts: int) -> DataFrame:
    """``pos``, ``part`` and its number of copies ``n``, each once, written in order.

    A part is packed into bytes whose order is that of its components.  Copies
    are added up per batch, then per key before and after the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _pieces(batches, "v"):
            width = rows.shape[1] // parts
            for pos in range(parts):
                found, _, counts = _distinct(rows[:, pos * width : (pos + 1) * width])
                packed = (found + _OFFSET).astype(">u4").tobytes()
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(found), [None, pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), pos, np.int32)), keys.cast(pa.binary()), pa.array(counts)], ["pos", "part", "n"]
                )

    counted = whole.select("v").mapInArrow(run, "pos int, part binary, n long")
    counted = counted.groupBy("pos", "part").agg(F.sum("n").alias("n"))
    return materialise(counted.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "parts")


def _sums(books: np.ndarray):
    """Sums of components and copies by entry over the parts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(books.shape, np.int64)
        copies = np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            where = batch.column("pos").to_numpy()
            n = batch.column("n").to_numpy()
            packed = b"".join(batch.column("part").to_pylist())
            leaves = np.frombuffer(packed, ">u4").astype(np.int64).reshape(-1, books.shape[2]) - _OFFSET
            for pos in np.unique(where).tolist():
                mine = where == pos
                codes, _ = assign(leaves[mine], books[pos])
                np.add.at(totals[pos], codes, leaves[mine] * n[mine, None])
                np.add.at(copies[pos], codes, n[mine])
        pos, entry = np.nonzero(copies)
        dims = books.shape[2]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(pos, dims).astype(np.int32)), pa.array(np.repeat(entry, dims).astype(np.int32)),
                pa.array(np.tile(np.arange(dims, dtype=np.int32), len(pos))),
                pa.array(totals[pos, entry].ravel()), pa.array(np.repeat(copies[pos, entry], dims)),
            ],
            ["pos", "entry", "dim", "total", "n"],
        )

    return run


def fit(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks by part, entry and component.

    They start as the parts of the ``entries`` smallest ids, equal ids in the
    order of their vectors, null ids last; with fewer vectors they have fewer
    entries.  Only entries come to the driver: the first ones, and in each
    round a sum per component.
    """
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    start = np.array([r["v"] for r in first], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    leaves = distinct_parts(whole, parts)
    for _ in range(rounds):
        found = leaves.mapInArrow(_sums(books), "pos int, entry int, dim int, total long, n long")
        for r in found.groupBy("pos", "entry", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["pos"], r["entry"], r["dim"]] = r["total"] // r["n"]
    return books


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` and ``error`` of each vector, by the tries of its batch's parts."""
    kind = whole.schema["label"].dataType.simpleString()
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))
    hex_digits = [f"{i:0{digits}x}" for i in range(books.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _pieces(batches, "v"):
            error = np.zeros(len(rows), np.int64)
            codes = np.empty((len(rows), len(books)), np.int64)
            for pos, book in enumerate(books):
                leaves, place, _ = _distinct(rows[:, pos * book.shape[1] : (pos + 1) * book.shape[1]])
                found, least = assign(leaves, book)
                codes[:, pos] = found[place]
                error += least[place]
            text = ["".join([hex_digits[c] for c in row]) for row in codes.tolist()]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    ids = whole.schema["vec_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"vec_id {ids}, label {kind}, code string, error long")


def codebooks_sha256(books: np.ndarray) -> str:
    """Hash of all components in decimal, by part, entry and place in the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of each vector kept.

    Components become floor(``scale`` * x).  Left out are rows whose vector is
    null, is empty, holds a null or a component that isn't finite, doesn't cut
    into ``parts`` equal parts, or is not as long as that of the smallest id.
    Integers beyond ``largest`` (2^27 for 64 components, x of half a million)
    are held at it.  Rows count as often as they repeat; equal distances go to
    the lower entry; null labels are one label.  A ``label_error`` beyond 64
    bits is null.  Other columns are ignored; a table without a vector that
    counts gives no rows.  Vectors of any length work in pieces of a batch.
    """
    whole = whole_vectors(vectors, vec_id, vector, label, parts, scale)
    books = fit(whole, parts, entries, rounds)
    coded = materialise(encode(whole, books), "codes")
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    joined = join_counted(coded, materialise(sums, "labels"), ["label"], "n")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
