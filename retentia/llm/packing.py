"""Token ids in fixed-width bits: shard files, their index, and random access.

A shard is one file::

    magic "TOKBITS1"
    blocks        each of ``block`` ids, ``bits`` bits per id, lowest bit first
    index         int64 arrays: id of each document, its first id's place in
                  the shard (one more at the end), byte place of each block
    nulls         one byte per document, 1 where the id is null
    footer        int64: bits, block, ids, documents, blocks, place of the index
    magic

All integers are little-endian.  A block holds a multiple of eight ids, so it
starts at a whole byte and can be read and unpacked alone.  Shards follow each
other in the order of document ids; where each begins is in the manifest, a
small Parquet table beside them.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.base import ASCII_LOWER, ASCII_UPPER, pieces

MAGIC = b"TOKBITS1"
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
BLOCK = 1 << 16
CACHE = 800_000
_FOOTER = 6 * 8 + len(MAGIC)
Encoder = Callable[[], Callable[[list[bytes]], list[np.ndarray]]]


def width(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits)
    return spread.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class ShardWriter:
    """Writes one shard; ids are held one block at a time."""

    def __init__(self, path: str, bits: int, block: int = BLOCK) -> None:
        if block % 8:
            raise ValueError("a block holds a multiple of eight ids")
        self.fs, self.path = _filesystem(path)
        # Attempts of one task write apart; the first whole file stays, all are alike.
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.bits, self.block, self.total, self.place = bits, block, 0, len(MAGIC)
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.docs, self.nulls, self.starts, self.blocks = [], [], [], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.starts.append(self.total)
        self.total += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            rows = np.concatenate(self.held)
            whole = len(rows) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(rows[at : at + self.block])
            self.held, self.waiting = [rows[whole:]], len(rows) - whole

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.place)
        self.out.write(data)
        self.place += len(data)

    def close(self) -> int:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        if len(rest):
            self._write(rest)
        index = np.array([*self.docs, *self.starts, self.total, *self.blocks], "<i8").tobytes()
        footer = [self.bits, self.block, self.total, len(self.docs), len(self.blocks), self.place]
        self.out.write(index + bytes(self.nulls) + np.array(footer, "<i8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.own, self.path)
        return self.total


class Shard:
    """Random access to a shard: reads its index, then the blocks asked for."""

    def __init__(self, path: str) -> None:
        fs, place = _filesystem(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(_FOOTER, size - _FOOTER)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.bits, self.block, self.total, docs, blocks, at = np.frombuffer(tail[: -len(MAGIC)], "<i8").tolist()
        index = self.file.read_at(size - _FOOTER - at, at)
        numbers = np.frombuffer(index, "<i8", 2 * docs + 1 + blocks)
        self.docs, self.starts = numbers[:docs], numbers[docs : 2 * docs + 1]
        self.blocks = np.append(numbers[2 * docs + 1 :], at)
        self.nulls = np.frombuffer(index[len(numbers) * 8 :], np.uint8).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``, from just the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        count = min((last + 1) * self.block, self.total) - first * self.block
        return unpack(data, self.bits, count)[start - first * self.block : stop - first * self.block]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.starts[place]), int(self.starts[place + 1]))

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, place of the first token and tokens of every document.

        About ``step`` ids are read at once, more only for one long document.
        """
        at = 0
        while at < len(self.docs):
            stop = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + step, "right")) - 1)
            stop = min(stop, len(self.docs))
            base = int(self.starts[at])
            ids = self.ids(base, int(self.starts[stop]))
            for k in range(at, stop):
                start = int(self.starts[k])
                doc = None if self.nulls[k] else int(self.docs[k])
                yield doc, start, ids[start - base : int(self.starts[k + 1]) - base]
            at = stop


def word_encoder(path: str, end: int | None = None) -> Encoder:
    """Encoder of UTF-8 texts by a tokenizer file whose tokens never span white space.

    Texts are cut at ASCII white space and each piece is encoded by the
    tokenizers library once per worker process; pieces seen before come from a
    bounded table.  A text with the string of a special token is encoded whole.
    ``end`` is appended to each text.
    """

    def make() -> Callable[[list[bytes]], list[np.ndarray]]:
        return _word_encoder(path, end)

    return make


def _mark(tokenizer) -> tuple[str, int]:
    """A rare character that is one token by itself, and its id."""
    for mark in "\u00b6\u00a7\u00a4\u00ac#":
        ids = tokenizer.encode(mark, add_special_tokens=False).ids
        if len(ids) == 1:
            return mark, ids[0]
    return " ", -1  # none: pieces are told apart by their offsets


_MADE: dict[tuple[str, int | None], Callable[[list[bytes]], list[np.ndarray]]] = {}


def _word_encoder(path: str, end: int | None) -> Callable[[list[bytes]], list[np.ndarray]]:
    if (path, end) in _MADE:
        return _MADE[path, end]
    # Spark gives each task its core; the library's own threads would only wait for one.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    lowers = "Lowercase" in json.dumps(json.loads(tokenizer.to_str())["normalizer"])
    seen: dict[bytes, bytes] = {}
    tail = np.array([] if end is None else [end], "<u4").tobytes()

    mark, mark_id = _mark(tokenizer)

    def learn(new: list[bytes]) -> None:
        """Encodes pieces as one text, with a mark between them whose id tells where each ends."""
        texts = [w.decode("utf-8", "replace") for w in new]
        ids = np.array(tokenizer.encode_batch_fast([f" {mark} ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == mark_id)
        if len(ends) != len(new) - 1:
            # A piece has the mark in it: a token belongs to the piece in which it begins.
            got = tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
            ids, begins, ends = np.array(got.ids, "<u4"), cuts[:-1], cuts[1:]
        else:
            begins, ends = np.concatenate([[0], ends + 1]), np.append(ends, len(ids))
        raw = ids.tobytes()
        seen.update(zip(new, map(raw.__getitem__, map(slice, (4 * begins).tolist(), (4 * ends).tolist())), strict=True))

    def encode(texts: list[bytes]) -> list[np.ndarray]:
        # Where the tokenizer lowers all letters, pieces that differ in A-Z alone are one.
        folded = [t.translate(_LOWER) for t in texts] if lowers else texts
        whole = [any(s in t or s in f for s in special) for t, f in zip(texts, folded, strict=True)]
        split = [[] if w else f.split() for f, w in zip(folded, whole, strict=True)]
        if len(seen) >= CACHE:
            seen.clear()
        out = []
        for at, (text, alone, words) in enumerate(zip(texts, whole, split, strict=True)):
            if alone:
                ids = np.array(tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                try:
                    ids = b"".join(map(seen.__getitem__, words))
                except KeyError:
                    # The unseen words of this and all later texts are encoded together.
                    new = list(set().union(*split[at:]).difference(seen))
                    for k in range(0, len(new), 4096):
                        learn(new[k : k + 4096])
                    ids = b"".join(map(seen.__getitem__, words))
            out.append(np.frombuffer(ids + tail, "<u4"))
        return out

    _MADE[path, end] = encode
    return encode


def write(
    docs: DataFrame, path: str, encoder: Encoder, vocabulary: int, doc_id: str = "doc_id", text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Writes shards of the encoded texts in ascending ``doc_id`` order; returns the manifest.

    One shard per range partition; rows of one id follow each other in the
    order of a hash of their text, null ids come first, a null text is empty.
    Tasks stream: a task holds one batch of texts, one block of ids and its
    index.  ``path`` is a folder that executors share, in any file system that
    Arrow opens.  An empty table gives an empty manifest.
    """
    spark, bits = docs.sparkSession, width(vocabulary)
    folder = path.rstrip("/")
    fs, place = _filesystem(folder)
    fs.create_dir(f"{place}/shards", recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        out, part = None, -1
        for batch in batches:
            for rows in pieces(batch):
                if out is None and len(rows):
                    part = int(rows["_part"].iloc[0])
                    out = ShardWriter(f"{folder}/shards/{part:08d}.tok", bits, block)
                for doc, ids in zip(rows["_id"], encode([t or b"" for t in rows["_text"]]), strict=True):
                    out.add(None if pd.isna(doc) else int(doc), ids)
        if out is not None:
            docs_in = len(out.docs)
            yield pd.DataFrame({"shard": [part], "ids": [out.close()], "documents": [docs_in]})

    ordered = docs.select(
        F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"), F.xxhash64(text).alias("_tie")
    ).repartitionByRange(F.col("_id").asc_nulls_first(), F.col("_tie"))
    placed = ordered.sortWithinPartitions(F.col("_id").asc_nulls_first(), "_tie", "_text")
    found = placed.select(F.spark_partition_id().alias("_part"), F.col("_id").cast("decimal(20,0)").alias("_id"), "_text")
    # One row per shard comes to the driver.
    shards = sorted(found.mapInPandas(run, "shard int, ids long, documents long").collect())
    before, rows = 0, []
    for shard, ids, documents in shards:
        rows.append((shard, f"{folder}/shards/{shard:08d}.tok", before, ids, documents))
        before += ids
    manifest = spark.createDataFrame(rows, "shard int, path string, start long, ids long, documents long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: ``doc_id``, ``start`` over all shards, ``n_tokens``, ``ids_crc32``.

    One task per shard reads it a run of blocks at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                rows = []
                for doc, at, ids in Shard(path).documents():
                    rows.append((doc, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 8192:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    shards = max(1, manifest.count())
    return manifest.repartitionByRange(shards, "shard").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return frame.assign(doc_id=frame["doc_id"].astype("Int64"))
