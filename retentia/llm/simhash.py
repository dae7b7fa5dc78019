"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are two halves of 32.  Two fingerprints that
differ in at most 3 bits differ in at most 1 bit of one half, so the search
runs per half with threshold 1.  The anchors of a half are the words of a
covering code: the binary Hamming code of length 31, whose covering radius is
1, joined with one free bit.  A half is at most 1 from its *home* anchor and
at most 1 + 1 = 2 from the home anchor of every half within the threshold.
Each fingerprint is therefore copied to all anchors within 2 (2 or 17 of
them), and at every anchor the fingerprints at home there are compared with
all that were copied to it.  No link is missed.

There are 2^27 anchors per half, so random fingerprints hardly meet.  Anchors
that many different fingerprints share (large families of near copies) are cut
into a grid of cells of bounded size.  A cell emits at most one link for each
of its rows, joined to a forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.base import ASCII_LOWER, ASCII_UPPER, pieces
from retentia.llm.components import components
from retentia.session import materialise

THRESHOLD = 3
SHINGLE = 3
# Different fingerprints of one anchor that one task compares at once.
CELL = 4096
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)
_CHUNK = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set; index 0 is the lowest bit.

    Eight byte lanes are summed at a time, at most 255 hashes per lane.
    """
    lanes = (hashes[:, None] >> _SHIFTS) & _LANES
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 8, 8).sum(axis=0, dtype=np.int64).T.ravel()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    joined, counts = b" ".join(words), np.zeros(64, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:last].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, last, _CHUNK):
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)]
        counts += _bit_counts(np.array(hashes, np.uint64))
    return int(((counts * 2 > last).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", into: str = "_fp", shingle: int = SHINGLE) -> DataFrame:
    """The documents' columns but ``text``, with the signed 64-bit fingerprint.

    A null, an empty text and one without words have fingerprint 0.
    """
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + f", {into} long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces(batch):
                found = np.array([fingerprint(x, shingle) for x in part["_text"]], np.uint64)
                yield part[kept].assign(**{into: found.view(np.int64)})

    return docs.select(*kept, F.col(text).cast("binary").alias("_text")).mapInPandas(run, schema)


def _parity_table() -> np.ndarray:
    """Syndrome of a 31-bit word under the Hamming code, by 16-bit pieces."""
    table = np.zeros((2, 1 << 16), np.uint32)
    values = np.arange(1 << 16, dtype=np.uint32)
    for piece in range(2):
        for bit in range(16 if piece == 0 else 15):
            position = np.uint32(piece * 16 + bit + 1)  # column of the check matrix: the position itself
            table[piece] ^= np.where((values >> np.uint32(bit)) & 1, position, np.uint32(0)).astype(np.uint32)
    return table


_SYNDROME = _parity_table()
# Pairs of positions i < j with i ^ j == s, for each syndrome s.
_PAIRS = np.zeros((32, 15), np.uint32)
for _s in range(1, 32):
    _found = [(i, i ^ _s) for i in range(1, 32) if i < i ^ _s]
    _PAIRS[_s] = [(1 << (i - 1)) | (1 << (j - 1)) for i, j in _found]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 32-bit half, its home anchor and the other anchors within 2.

    The first 31 bits are a word of the Hamming code's space, the last is free.
    Unused places of the second result repeat the home anchor.
    """
    word, free = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    syndrome = _SYNDROME[0][word & np.uint32(0xFFFF)] ^ _SYNDROME[1][word >> np.uint32(16)]
    flip = np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    home = (word ^ flip) | free
    others = np.empty((len(half), 16), np.uint32)
    # Two flips inside the code's space reach 15 more code words, unless the word is one itself.
    near = (word[:, None] ^ _PAIRS[syndrome]) | free[:, None]
    others[:, :15] = np.where(syndrome[:, None] > 0, near, home[:, None])
    others[:, 15] = home ^ np.uint32(0x80000000)  # at most one flip inside and the free bit
    return home, others


def _copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = batch["_fp"].to_numpy()
        halves = prints.view(np.uint64)
        for side in range(2):
            home, others = anchors(((halves >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            key = np.int64(side) << np.int64(32)
            yield pd.DataFrame({"anchor": home.astype(np.int64) | key, "fp": prints, "home": True})
            rows, places = np.nonzero(others != home[:, None])
            yield pd.DataFrame({"anchor": others[rows, places].astype(np.int64) | key, "fp": prints[rows], "home": False})


def _linked(prints: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a cell, at most one fewer than its rows.

    Each home row is compared with all rows; of its neighbours in one tree only
    the first is linked, and the trees become one.
    """
    tree = np.arange(len(prints))
    a, b = [], []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= threshold)
        near = near[tree[near] != tree[i]]
        if len(near):
            trees, first = np.unique(tree[near], return_index=True)
            a.append(np.full(len(first), prints[i]))
            b.append(prints[near[first]])
            tree[np.isin(tree, trees)] = tree[i]
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def _compare(threshold: int):
    """Compares the rows of each cell; the rows of a cell come together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
            starts = _starts(rows)
            yield _cells(rows.iloc[: starts[-1]], starts[:-1], threshold)
            left = rows.iloc[starts[-1] :]
        if left is not None:
            yield _cells(left, _starts(left), threshold)

    return run


def _starts(rows: pd.DataFrame) -> np.ndarray:
    cell = rows[["anchor", "row", "col"]].to_numpy()
    return np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1])


def _cells(rows: pd.DataFrame, starts: np.ndarray, threshold: int) -> pd.DataFrame:
    prints, home = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy(bool)
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    if len(starts):
        stops = np.append(starts[1:], len(rows))
        # A cell with one row or without a row at home compares nothing.
        busy = (np.add.reduceat(home.astype(np.int64), starts) > 0) & (stops - starts > 1)
        for s, e in zip(starts[busy].tolist(), stops[busy].tolist(), strict=True):
            found.append(_linked(prints[s:e], home[s:e], threshold))
    a, b = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
    return pd.DataFrame({"a": a, "b": b})


def links(prints: DataFrame, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints within the threshold.

    ``prints`` has distinct values in ``_fp``.  Fingerprints that are linked are
    connected in the result, not necessarily by a pair of their own.  An anchor
    with more than ``cell`` fingerprints becomes a grid: home rows are dealt to
    its rows and all copies to its columns, by hash.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("two halves with radius 1 cover thresholds up to 3")
    copies = materialise(prints.select("_fp").mapInPandas(_copies, "anchor long, fp long, home boolean"), "anchors")
    sizes = copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("used"))
    used = materialise(sizes.where("n > 1 AND used"), "used")
    side = F.ceil(F.col("n") / cell).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("_side")).cast("int")
    rows = copies.join(used.select("anchor", side.alias("_side")), "anchor").withColumn("_own", own)
    lines = F.sequence(F.lit(0), F.col("_side") - 1)
    # As one at home a fingerprint fills a row of the grid, as a copy a column.
    across = F.transform(lines, lambda k: F.struct(F.col("_own").alias("row"), k.alias("col"), F.lit(True).alias("home")))
    down = F.transform(lines, lambda k: F.struct(k.alias("row"), F.col("_own").alias("col"), F.lit(False).alias("home")))
    whole = F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("home").alias("home")))
    grid = F.when(F.col("_side") == 1, whole).when(F.col("home"), F.concat(across, down)).otherwise(down)
    placed = rows.select("anchor", "fp", F.explode(grid).alias("g")).select("anchor", "fp", "g.*")
    cells = placed.repartition("anchor", "row", "col").sortWithinPartitions("anchor", "row", "col")
    return cells.mapInPandas(_compare(threshold), "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD,
    keep: list[str] | None = None,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row,
    ``root``, the signed fingerprint that names its group, and the columns ``keep``.

    Fingerprints that differ in at most ``threshold`` bits are linked;
    ``component_id`` is the smallest id among all documents that links reach,
    the document itself included.  Equal texts meet in one fingerprint before
    the search, so copies cost one row each.  Rows may repeat; rows with a null
    id keep it and count for a component only if it has no other id.  Texts
    without words share fingerprint zero.  Other columns are ignored; an empty
    table gives an empty result.
    """
    keep = keep or []
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    printed = materialise(fingerprints(rows, "_text", "_fp", shingle), "prints")
    prints = materialise(printed.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct")
    members = components(links(prints, threshold))
    rooted = prints.join(members.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn(
        "_root", F.coalesce("root", "_fp")
    )
    rooted = materialise(rooted.select("_fp", "_least", "_root"), "rooted")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("_component"))
    named = materialise(rooted.join(least, "_root").select("_fp", "_component", "_root"), "named")
    return printed.join(named, "_fp").select(
        F.col("_id").alias(doc_id),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
        F.col("_root").alias("root"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )
