"""Language-model scores by online logistic mixing of hashed contexts.

A byte is coded by its path in a Huffman tree of the training bytes, one bit a
node.  Several contexts (the last one to five bytes), hashed into slots, each
predict every bit from counts of what followed in all training texts.  The predictions are mixed in the logistic domain; the weights
are chosen by the node (the gate) and learnt online.  A last table refines the
mixed probability by node and size from what really followed.  Bits add up to
the text's total, and to bits per byte.  (Mahoney's "lpaq" family, with the
tables fixed while scoring, so that texts are independent of each other.)

Counts, weights and the refining table cover every training text.  The first
pass also writes the distinct runs of six bytes and how often they came; two
short passes over those learn the weights, each task online through its own
runs, and count what followed each mixed prediction.  Weights of the tasks are
averaged by the evidence they had at each node.  A run's own occurrence is
taken out of the counts that predict it.

What a byte costs depends on itself and the five before it.  Texts repeat such
runs all the time, so a task sorts and counts runs before it touches tables,
and keeps the costs of runs it has scored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.base import ASCII_LOWER, ASCII_UPPER, bounded_sample
from retentia.session import materialise

# Slots of the contexts: the last byte, two, three, four, five.
SLOTS = (1 << 8, 1 << 13, 1 << 14, 1 << 15, 1 << 15)
PAD = len(SLOTS)
BLOCK = 1 << 18
CHUNK = 1 << 19
COSTS = 1 << 19  # runs whose cost a worker keeps
RUNS = 1 << 17  # distinct runs that are learnt from at once
HELD = 1 << 19  # distinct runs that a task holds before it sends them
FIXED = 1 << 16  # steps of one in a sum of weights, which is exact in any order
PRIOR = 0.4
SCALE = 900  # steps of one unit of log odds; five contexts of +-6500 fit 16 bits
MOST = 6500
BUCKETS = 256
SHIFT = 8
COMMON, COMMON_DOCUMENTS, COMMON_LENGTH = 100_000, 6_000, 64
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each after ``PAD`` zeros and ended by one; starts and ends of what is coded."""
    data = np.frombuffer(b"".join(bytes(PAD) + t + b"\0" for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1 + PAD
    ends = np.cumsum(sizes)
    return data, ends - sizes + PAD, ends


def runs(data: np.ndarray) -> np.ndarray:
    """For every byte itself, as the lowest eight bits, and the bytes before it."""
    wide = data.astype(np.uint64)
    out = wide.copy()
    for back in range(1, PAD + 1):
        out[back:] |= wide[:-back] << np.uint64(8 * back)
    return out


def contexts(run: np.ndarray) -> list[np.ndarray]:
    """For every run the slot of each of its contexts, times 256."""
    out, before = [], run >> np.uint64(8)
    for k, slots in enumerate(SLOTS, 1):
        value = before & np.uint64((1 << 8 * k) - 1)
        slot = value if k == 1 else (value * _GOLDEN) >> np.uint64(64 - slots.bit_length() + 1)
        out.append(slot.astype(np.int64) << 8)
    return out


def _offsets() -> list[int]:
    return [0, *np.cumsum(np.array(SLOTS) * 256).tolist()]


@dataclass
class Tree:
    """Huffman tree of the bytes: for each depth and byte its node, bit, and whether it goes on."""

    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    left: np.ndarray = field(repr=False)
    right: np.ndarray = field(repr=False)

    @staticmethod
    def of(counts: np.ndarray) -> Tree:
        # Every byte has a code, whether seen or not; ties go by byte.
        heap = [(int(c) * 256 + 1, s, (s,)) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        left, right = np.zeros((256, 255), np.float32), np.zeros((256, 255), np.float32)
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        for node in range(255):
            (a, i, one), (b, j, two) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side, table in ((0, one, left), (1, two, right)):
                table[list(side), node] = 1
                for s in side:
                    paths[s].append((node, bit))
            heapq.heappush(heap, (a + b, min(i, j), one + two))
        depth = max(map(len, paths))
        length = np.array([len(p) for p in paths], np.uint8)
        node, bit = np.zeros((depth, 256), np.uint8), np.zeros((depth, 256), np.uint8)
        for s, path in enumerate(paths):
            for d, (v, x) in enumerate(reversed(path)):
                node[d, s], bit[d, s] = v, x
        return Tree(length, node, bit, left, right)


@dataclass
class Mixer:
    """What scoring needs: weighted predictions as 16-bit log odds, and bits by node and bucket."""

    tree: Tree
    tables: list[np.ndarray]
    cost: np.ndarray

    def __post_init__(self) -> None:
        # Per depth and byte: the node, and where its costs begin for the byte's bit.
        self.nodes = self.tree.node.astype(np.int64)
        self.codes = ((self.tree.bit.astype(np.int64) << 8) | self.nodes) * BUCKETS + BUCKETS // 2
        self.kept: tuple[np.ndarray, np.ndarray] | None = None

    def cost_of(self, run: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run."""
        symbol, bases = (run & np.uint64(255)).astype(np.int64), contexts(run)
        spent = np.zeros(len(run), np.float32)
        for d in range(len(self.nodes)):
            on = np.flatnonzero(self.tree.length.take(symbol) > d)
            if not len(on):
                break
            mine = symbol.take(on)
            node = self.nodes[d].take(mine)
            total = np.zeros(len(on), np.int16)
            for base, table in zip(bases, self.tables, strict=True):
                total += table.take(base.take(on) + node)
            spent[on] += self.cost.take(self.codes[d].take(mine) + (total >> SHIFT))
        return spent

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Total bits of each text, its end included."""
        if self.kept is None:
            self.kept = np.full(COSTS, np.uint64(2**64 - 1)), np.zeros(COSTS, np.float32)
        seen, costs = self.kept
        data, starts, ends = joined(texts)
        run = runs(data)
        slot = ((run * _GOLDEN) >> np.uint64(64 - COSTS.bit_length() + 1)).astype(np.int64)
        spent = costs.take(slot)
        new = np.flatnonzero(seen.take(slot) != run)
        if len(new):
            fresh, where = np.unique(run.take(new), return_inverse=True)
            found = self.cost_of(fresh)
            spent[new] = found.take(where)
            slot = ((fresh * _GOLDEN) >> np.uint64(64 - COSTS.bit_length() + 1)).astype(np.int64)
            seen[slot], costs[slot] = fresh, found
        cuts = np.stack([starts, ends], axis=1).ravel()
        return np.add.reduceat(np.append(spent, 0.0).astype(np.float64), cuts)[::2]


def _coded(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each start up to its end."""
    sizes = ends - starts
    return np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


def _chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about ``CHUNK`` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def distinct_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs that end at the coded bytes of the texts, in order, and how often each comes."""
    data, starts, ends = joined(texts)
    run = np.sort(runs(data).take(_coded(starts, ends)))
    first = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
    return run.take(first), np.diff(np.append(first, len(run)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of several groups, and how often they come in all."""
    run, times = (np.concatenate(side) for side in zip(*parts, strict=True))
    order = np.argsort(run, kind="stable")
    run = run.take(order)
    first = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
    return run.take(first), np.add.reduceat(times.take(order), first)


def count_runs(table: np.ndarray, run: np.ndarray, times: np.ndarray) -> None:
    """Adds what follows each context of distinct runs to the flat table of all contexts."""
    symbol, times = (run & np.uint64(255)).astype(np.int64), times.astype(table.dtype)
    for base, offset in zip(contexts(run), _offsets(), strict=False):
        np.add.at(table, base + (symbol + offset), times)


def count_into(table: np.ndarray, texts: list[bytes]) -> None:
    """Adds what follows each context of the texts to the flat table of all contexts."""
    count_runs(table, *distinct_runs(texts))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _short(counts: np.ndarray) -> np.ndarray:
    """Counts as the upper half of a float: exact up to 256, within a half per cent beyond."""
    return ((counts.astype(np.float32).view(np.uint32) + np.uint32(0x7FFF)) >> np.uint32(16)).astype(np.uint16)


def _long(short: np.ndarray) -> np.ndarray:
    return (short.astype(np.uint32) << np.uint32(16)).view(np.float32)


def _by_context(counts: np.ndarray) -> list[np.ndarray]:
    offsets = _offsets()
    return [counts[a:b].reshape(-1, 256) for a, b in zip(offsets, offsets[1:], strict=False)]


def tree_of(counts: np.ndarray) -> Tree:
    return Tree.of(_by_context(counts)[0].sum(axis=0, dtype=np.float64))


@dataclass
class Counts:
    """Per context, flat by slot and node: how often a bit was one and zero, in short form."""

    tree: Tree
    ones: list[np.ndarray]
    zeros: list[np.ndarray]

    @staticmethod
    def of(counts: np.ndarray, tree: Tree) -> Counts:
        ones, zeros = [], []
        for table in _by_context(counts):
            for out, side in ((ones, tree.right), (zeros, tree.left)):
                short = np.zeros((len(table), 256), np.uint16)
                for at in range(0, len(table), 4096):
                    short[at : at + 4096, :255] = _short(table[at : at + 4096].astype(np.float32) @ side)
                out.append(short.ravel())
        return Counts(tree, ones, zeros)

    def events(self, run: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every coded bit of the runs: node, bit, how often, and what each context predicts without it."""
        symbol, bases = (run & np.uint64(255)).astype(np.int64), contexts(run)
        length = self.tree.length[symbol]
        found = []
        for d in range(len(self.tree.node)):
            on = np.flatnonzero(length > d)
            if not len(on):
                break
            node, bit = self.tree.node[d][symbol[on]], self.tree.bit[d][symbol[on]]
            x = np.empty((len(bases), len(on)), np.float32)
            for k, base in enumerate(bases):
                place = base.take(on) + node
                one, zero = (np.maximum(_long(t[k].take(place)) - b, 0) for t, b in ((self.ones, bit), (self.zeros, 1 - bit)))
                x[k] = np.log((one + PRIOR) / (zero + PRIOR))
            found.append((node, bit, times.take(on), x))
        return tuple(np.concatenate([f[i] for f in found], axis=-1) for i in range(4))


def first_weights() -> np.ndarray:
    return np.full((len(SLOTS), 256), 1.0 / len(SLOTS) + 0.1, np.float32)


def learn(
    weights: np.ndarray, node: np.ndarray, bit: np.ndarray, times: np.ndarray, x: np.ndarray, rate: float = 0.02, batch: int = 4096
) -> None:
    """Moves the weights online over the events, in a fixed random order.

    A batch moves a node by its mean error, events counted as often as they
    come, times the root of the node's events: a common one makes no larger step.
    """
    order = np.random.default_rng(8).permutation(len(node))
    node, bit, often, x = node[order].astype(np.int64), bit[order].astype(np.float32), times[order].astype(np.float32), x.take(order, axis=1)
    flat, lines = weights.reshape(-1), 256 * np.arange(len(weights))[:, None]
    for at in range(0, len(node), batch):
        n, part, w = node[at : at + batch], x[:, at : at + batch], often[at : at + batch]
        place = n + lines
        error = (bit[at : at + batch] - 1 / (1 + np.exp(-(flat.take(place) * part).sum(axis=0)))) * w
        step = rate * np.sqrt(np.bincount(n, minlength=256)) / np.maximum(np.bincount(n, w, 256), 1)
        weights += step * np.bincount(place.ravel(), (error * part).ravel(), weights.size).reshape(weights.shape)


def refine(weights: np.ndarray, node: np.ndarray, bit: np.ndarray, times: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How often each bit followed, by bit, node and bucket of the mixed prediction; flat."""
    mixed = sum(_steps(weights[k][node] * x[k]) for k in range(len(weights)))
    place = (bit.astype(np.int64) * 256 + node) * BUCKETS + ((mixed >> SHIFT) + BUCKETS // 2)
    return np.bincount(place, times, 512 * BUCKETS).astype(np.int64)


def mixer_of(counts: np.ndarray, tree: Tree, weights: np.ndarray, seen: np.ndarray) -> Mixer:
    """Folds the weights into the predictions of all contexts, and what was seen into costs."""
    seen = seen.reshape(2, 256, BUCKETS)
    # Before anything is seen a bucket has the probability it stands for.
    middle = (np.arange(BUCKETS) - BUCKETS // 2 + 0.5) * (1 << SHIFT) / SCALE
    expected = 1 / (1 + np.exp(-middle))
    one = (seen[1] + 8 * expected) / (seen.sum(axis=0) + 8)
    cost = -np.log2(np.clip(np.stack([1 - one, one]), 1e-6, 1)).astype(np.float32)
    folded = []
    for k, table in enumerate(_by_context(counts)):
        odds = np.zeros((len(table), 256), np.int16)
        for at in range(0, len(table), 4096):
            part = table[at : at + 4096].astype(np.float32)
            one, both = part @ tree.right, part @ (tree.left + tree.right)
            odds[at : at + 4096, :255] = _steps(weights[k][:255] * _logit((one + PRIOR) / (both + 2 * PRIOR)))
        folded.append(odds.ravel())
    return Mixer(tree, folded, cost.ravel())


def fit_mixer(counts: np.ndarray, passages: list[bytes]) -> Mixer:
    """The mixer learnt in one place from passages; ``counts`` covers them."""
    tree, weights, packed = tree_of(counts), first_weights(), list(_packed(*distinct_runs(passages)))
    shared = Counts.of(counts, tree)
    for data in packed:
        learn(weights, *shared.events(*_unpacked(data)))
    return mixer_of(counts, tree, weights, sum(refine(weights, *shared.events(*_unpacked(data))) for data in packed))


def _steps(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(odds * SCALE), -MOST, MOST).astype(np.int16)


def _clean(text: bytes | None) -> bytes:
    return (text or b"").translate(_LOWER)


def common_tokens(training: DataFrame, text: str) -> list[bytes]:
    """Tokens that are counted in tables instead of being shuffled: a choice of speed only.

    The commonest of a bounded sample, ``COMMON`` short ones at most.
    """
    sample = bounded_sample(training, [text], COMMON_DOCUMENTS, seed=8)
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    found = sample.select(F.explode(F.split(lower, "[ \\t\\n\\x0B\\f\\r]+")).alias("token"))
    found = found.where((F.col("token") != "") & (F.octet_length("token") <= COMMON_LENGTH))
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return [r[0].encode() for r in counts.orderBy(F.col("n").desc(), "token").limit(COMMON).select("token").collect()]


def _packed(run: np.ndarray, times: np.ndarray) -> Iterator[bytes]:
    """Runs in blocks of at most ``RUNS``, each spread over all of them."""
    press = zstandard.ZstdCompressor(level=1).compress
    blocks = max(1, -(-len(run) // RUNS))
    for k in range(blocks):
        part = np.diff(run[k::blocks], prepend=np.uint64(0))
        yield press(part.tobytes() + times[k::blocks].astype(np.uint32).tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.uint64, n), dtype=np.uint64), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums blocks of the same number; they come together."""
    open_ = zstandard.ZstdDecompressor().decompress
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch["block"], batch["data"], strict=True):
            got = np.frombuffer(open_(data), np.int64)
            sums[k] = sums[k] + got if k in sums else got
    press = zstandard.ZstdCompressor(level=1).compress
    for k, block in sums.items():
        yield pd.DataFrame({"block": [k], "data": [press(block.tobytes())]})


def _summed(parts: DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of the tasks' blocks, by number; their sizes and number are fixed."""
    open_ = zstandard.ZstdDecompressor().decompress
    for row in parts.repartition("block").mapInPandas(_add, "block int, data binary").collect():  # tables of a fixed size
        yield row["block"], np.frombuffer(open_(bytes(row["data"])), np.int64)


def _count(training: DataFrame, common: list[bytes]) -> tuple[np.ndarray, np.ndarray, int, DataFrame]:
    """Context counts, counts of the common tokens and number of texts, over all training texts; their distinct runs.

    Each task sums its own tables and sends what isn't zero, compressed, by
    block; blocks are summed where they meet, one at a time.  Runs stay where
    they are written, packed.
    """
    spark = training.sparkSession
    size, place = _offsets()[-1], spark.sparkContext.broadcast({t: i for i, t in enumerate(common)})
    known = len(common) + 1  # the last is the end of a text

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, tokens, of = np.zeros(-(-size // BLOCK) * BLOCK, np.int32), np.zeros(known, np.int64), place.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pd.DataFrame]:
            run, times = held.pop()
            count_runs(table, run, times)
            for data in _packed(run, times):
                yield pd.DataFrame({"block": [-2], "data": [data]})

        for batch in batches:
            for texts in _chunks(_clean(t) for t in batch["_text"]):
                held.append(distinct_runs(texts))
                if sum(len(run) for run, _ in held) > 2 * HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD:
                        yield from send()
                for token, n in Counter(b" ".join(texts).split()).items():
                    at = of.get(token)
                    if at is not None:
                        tokens[at] += n
                tokens[-1] += len(texts)
        if held:
            held = [merged(held)]
            yield from send()
        press = zstandard.ZstdCompressor(level=1).compress
        for k, block in enumerate(table.reshape(-1, BLOCK)):
            if block.any():
                yield pd.DataFrame({"block": [k], "data": [press(block.astype(np.int64).tobytes())]})
        if tokens.any():
            yield pd.DataFrame({"block": [-1], "data": [press(tokens.tobytes())]})

    parts = materialise(training.mapInPandas(count, "block int, data binary"), "counted")
    table, tokens = np.zeros(-(-size // BLOCK) * BLOCK, np.float32), np.zeros(known, np.int64)
    for k, got in _summed(parts.where("block > -2")):
        if k < 0:
            tokens += got
        else:
            table[k * BLOCK : (k + 1) * BLOCK] = got
    return table[:size], tokens[:-1], int(tokens[-1]), parts.where("block = -2").select("data")


def _learnt(packed: DataFrame, counts: np.ndarray) -> Mixer:
    """The mixer of all training texts, from their distinct runs.

    Tasks learn online from the first weights on, and their weights are
    averaged by node; what follows the predictions is then counted with those.
    """
    spark, tree = packed.sparkSession, tree_of(counts)
    shared = spark.sparkContext.broadcast(Counts.of(counts, tree))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1).compress
        weights, evidence = first_weights(), np.zeros(256, np.int64)
        for batch in batches:
            for data in batch["data"]:
                events = shared.value.events(*_unpacked(data))
                learn(weights, *events)
                evidence += np.bincount(events[0], events[2], 256).astype(np.int64)
        if evidence.any():
            sums = np.rint(weights.astype(np.float64) * evidence * FIXED).astype(np.int64)
            yield pd.DataFrame({"block": [0], "data": [press(np.vstack([sums, evidence]).tobytes())]})

    weights = first_weights()
    for _, got in _summed(packed.mapInPandas(weigh, "block int, data binary")):
        *sums, evidence = got.reshape(-1, 256)
        on = evidence > 0
        for k, total in enumerate(sums):
            weights[k, on] = total[on] / evidence[on] / FIXED

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1).compress
        seen = np.zeros(512 * BUCKETS, np.int64)
        for batch in batches:
            for data in batch["data"]:
                seen += refine(weights, *shared.value.events(*_unpacked(data)))
        for k, block in enumerate(seen.reshape(16, -1)):
            if block.any():
                yield pd.DataFrame({"block": [k], "data": [press(block.tobytes())]})

    seen = np.zeros((16, 32 * BUCKETS), np.int64)
    for k, got in _summed(packed.mapInPandas(follow, "block int, data binary")):
        seen[k] = got
    shared.unpersist()
    return mixer_of(counts, tree, weights, seen)


def score(docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all texts by a model of those where the boolean column ``train`` holds.

    ``doc_id``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (log10 of a unigram model with one added to each count),
    ``score`` (log10 of the mixed model's probability of the text and its end)
    and ``bits_per_byte``.  A null text is empty: its one token is the end.
    Repeated rows count each; without training texts counts are zero.

    Counts of rare tokens meet by a 64-bit hash of the token in one shuffle,
    with the documents they come from.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.coalesce(F.col(train), F.lit(False)).alias("_train"),
        F.col(text).alias("_words"), F.col(text).cast("binary").alias("_text"),
    )
    training = rows.where("_train")
    common = common_tokens(training, "_words")
    contexts_, counted, texts, packed = _count(training.select("_text"), common)
    mixer = _learnt(packed, contexts_)
    logs = np.log10(counted + 1.0)
    shared = spark.sparkContext.broadcast((mixer, {t: i for i, t in enumerate(common)}, logs, counted > 0))
    end = math.log10(texts + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, place, logs, known = shared.value
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            at = 0
            for group in _chunks(_clean(t) for t in batch["_text"]):
                part = batch.iloc[at : at + len(group)]
                at += len(group)
                made = []
                for t in group:
                    tokens = t.split()
                    found = [place.get(w, -1) for w in tokens]
                    ids = np.array(found, np.int64)
                    rare = Counter(w for w, i in zip(tokens, found, strict=True) if i < 0)
                    ids = ids[ids >= 0]
                    keys = [digest(w, 8) - (1 << 63) for w in rare]
                    made.append((len(tokens) + 1, logs[ids].sum() + end, int(known[ids].sum()) + (texts > 0), keys, list(rare.values()), len(t)))
                frame = pd.DataFrame(made, columns=["n_tokens", "sum", "n_known", "rare", "rare_n", "n_bytes"], index=part.index)
                yield part[["_row", "_id", "_train"]].assign(**{c: frame[c] for c in frame}, bits=mixer.bits(group))

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"_row long, _id {kind}, _train boolean, n_tokens long, sum double, n_known long, rare array<long>, rare_n array<int>, n_bytes long, bits double"
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_train", "_text")
    scored = materialise(numbered.mapInPandas(run, schema), "scored")  # the row numbers are fixed from here on
    found = scored.select("_row", "_train", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
    found = found.select("_row", "_train", F.col("r.rare").alias("h"), F.col("r.rare_n").alias("n"))
    token = Window.partitionBy("h").orderBy(F.col("_train").desc())
    whole = token.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted_ = found.withColumn("c", F.sum(F.when(F.col("_train"), F.col("n")).otherwise(0)).over(whole)).withColumn(
        "first", F.when(F.col("_train") & (F.row_number().over(token) == 1), 1).otherwise(0)
    )
    rare = counted_.groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_sum"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum("first").alias("types"),
    )
    joined_ = scored.drop("rare", "rare_n").join(rare, "_row", "left").fillna(0, ["rare_sum", "rare_known", "types"])
    whole_rows = materialise(joined_, "rows")
    totals = whole_rows.agg(F.sum("types"), F.sum(F.when(F.col("_train"), F.col("n_tokens")))).first()
    tokens = int(totals[1] or 0)
    types = int(totals[0] or 0) + int((counted > 0).sum()) + (texts > 0)
    floor = math.log10(tokens + types + 1)
    return whole_rows.select(
        F.col("_id").alias(doc_id),
        F.col("_train").alias("train"),
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sum") + F.col("rare_sum") - F.col("n_tokens") * floor).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
