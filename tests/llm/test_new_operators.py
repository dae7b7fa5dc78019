"""Secrets, vector codes and the conversation trie against plain versions, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from retentia.llm import conversation_trie, queries, secrets, vector_codes
from retentia.llm.base import join_counted
from retentia.session import materialise

# --- op11 --------------------------------------------------------------------

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
DOCS = "doc_id long, text string, spans string, kind int, `start` string"


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """Patterns as the contract words them: match first, drop what fails afterwards."""
    kinds = [
        ("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def test_secrets_of_the_table(spark, sf_dir):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.queries()["op11_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        kinds = [x[2] for x in base]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [kinds.count(k) for k in ("assign", "access", "hex")]
        listed = [x for x in r["spans"].split(",") if x and not x.startswith("novel")]
        assert ",".join(listed) == joined(base)


def test_patterns_as_worded():
    chance = random.Random(11)
    parts = ["token", "ToKeN", "api_key", "apikey", "=", ":", " ", '"', "abc", "abcdef12", "AKIA", "AKIA" + "B7" * 9, "0f" * 12, "é", "ſecret", "\n", "_"]
    for _ in range(3000):
        text = "".join(chance.choices(parts, k=chance.randint(1, 14)))
        assert [(s, k, e) for s, k, e in secrets.patterns(text)] == [(s, i, e) for s, i, _, e in base_spans(text)]


def test_novel_strings_are_reported_and_known_ones_not(spark):
    chance = random.Random(5)
    names = [f"connection_timeout_{w}" for w in ("limit", "retry", "handler", "window")]
    filler = " ".join(names * 30)
    key = "".join(chance.choices(string.ascii_letters + string.digits, k=32))
    again = "".join(chance.choices(string.ascii_letters + string.digits, k=32))
    rows = [
        (1, f"private key\t{key} {filler}", "x", 1, "y"),
        (2, f"{key} {filler}", "x", 1, "y"),  # no sensitive word
        (3, f"secret connection_timeout_retry_handler2 {filler}", "x", 1, "y"),  # known words
        (4, f"{again} then bearer {again}", None, 1, "y"),  # the text has it already
        (5, f"bearer\n{key}", None, 1, "y"),  # another line
        (6, f'token = "{key}"', None, 1, "y"),  # a pattern's match covers it
        (None, f"été client id {key}", None, None, None),
        (None, f"été client id {key}", None, None, None),
        (7, None, None, None, None),
        (8, "", None, None, None),
        (9, "word " * 200_000 + f"passphrase {key}", None, None, None),
        (10, "token " * 40_000, None, None, None),
    ]
    found = [(r["doc_id"], [(s["kind"], s["start"], s["stop"]) for s in r["spans"]]) for r in secrets.find(spark.createDataFrame(rows, DOCS)).collect()]
    by_id = defaultdict(list)
    for doc, spans in found:
        by_id[doc].append(spans)
    assert by_id[1] == [[("novel", 12, 44)]]
    assert by_id[2] == by_id[3] == by_id[4] == by_id[5] == by_id[7] == by_id[8] == by_id[10] == [[]]
    assert by_id[6] == [[("assign", 0, 41)]]
    assert by_id[None] == [[("novel", 14, 46)]] * 2
    assert by_id[9] == [[("novel", 1_000_011, 1_000_043)]]


def test_secrets_of_no_documents(spark):
    assert secrets.find(spark.createDataFrame([], DOCS)).count() == 0


def test_identifiers_are_the_commonest(spark):
    docs = spark.createDataFrame([("b_b b_b aaa",), ("aaa ccc abc1def ddd-1",), (None,)], "text string")
    assert {tuple(r) for r in secrets.identifiers(docs, most=2).collect()} == {("aaa", 2), ("b_b", 2)}
    assert secrets.identifiers(docs, most=1).count() == 0  # ties stay together
    assert secrets.dictionary(secrets.identifiers(docs)) == b"ccc\nb_b\naaa"


# --- op12 --------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, v int"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int((256 * x) // 1) for x in v], label) for i, v, label in rows if v and all(x is not None and abs(x) < float("inf") for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[near(c[p], books[p])[1]].append(c[p])
            for e, members in mine.items():
                books[p][e] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded, sums = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] += error
        coded.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in coded), key=str)


def spark_codes(frame):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r[c] for c in names) for r in vector_codes.compress(frame).collect()), key=str)


def test_codes_of_awkward_vectors(spark):
    chance = random.Random(12)
    rows = [(i, [chance.uniform(-2, 2) for _ in range(32)], chance.choice([1, 2, None])) for i in range(150)]
    rows = [(i, [float(x) for x in spark_floats(v)], label) for i, v, label in rows]
    common = rows[7][1]
    rows += [(1000 + i, common, 1) for i in range(200)] + [rows[3], rows[3]]  # copies and a repeated row
    rows += [(None, rows[9][1], None), (2000, [0.0] * 32, 5), (2001, [0.5] * 32, 5)]
    bad = [(3000, None, 1), (3001, [1.0, None] * 16, 1), (3002, [float("nan")] + [0.0] * 31, 1), (3003, [float("-inf")] * 32, 1), (3004, [], 1)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows + bad], VECTORS)
    assert spark_codes(frame) == plain_codes(rows)
    few = spark.createDataFrame([(*r, "c", 1) for r in rows[:5]], VECTORS)
    assert spark_codes(few) == plain_codes(rows[:5])


def spark_floats(values):
    import numpy as np

    return np.float32(values)


def test_vectors_of_other_lengths_and_none(spark):
    rows = [(2, [0.25] * 16, 1), (3, [0.5] * 32, 1), (1, [1.0] * 15, 1), (4, [3.4e38] * 16, 2)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)
    assert [r["vec_id"] for r in vector_codes.compress(frame).orderBy("vec_id").collect()] == [2, 4]
    assert vector_codes.compress(frame.limit(0)).count() == 0


def test_trie_assigns_as_all_pairs_do():
    import numpy as np

    chance = np.random.default_rng(1)
    leaves = np.unique(chance.integers(-3, 4, (9000, 4)), axis=0)
    book = chance.integers(-3, 4, (64, 4))
    codes, least = vector_codes.assign(leaves, book)
    far = ((leaves[:, None, :] - book) ** 2).sum(axis=2)
    assert (codes == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_join_counted_joins_hot_and_null_keys(spark):
    rows = materialise(spark.range(3000).selectExpr("id", "CASE WHEN id < 2000 THEN NULL ELSE id END AS k"), "rows")
    stats = materialise(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")), "stats")
    found = {(r["id"], r["least"]) for r in join_counted(rows, stats.where("k IS NULL OR k <> 2500"), ["k"], "n").collect()}
    assert found == {(i, 0 if i < 2000 else None if i == 2500 else i) for i in range(3000)}


# --- op13 --------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, least string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    said = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in said.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - c % 5
        convs[c] = tuple(said.get(base, [])[:h] + turns[h:]) if c != base else tuple(turns)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, inside in members.items():
        cost = (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += cost
    rows = []
    for node, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(inside), len(node), parent, len(inside), children.get(node, 0), leaves[node], saved[node], digest))
    return sorted(rows, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def spark_trie(frame, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in conversation_trie.trie(frame, **options).collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    chance = random.Random(13)
    rows = []
    for conv in range(180):
        for turn in range(chance.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((conv, turn, chance.choice(["user", "user", "assistant", None]), chance.choice(["a", "bé", "", None])))
    rows += [(500 + i, t, "user", f"same {t}") for i in range(0, 60) for t in range(4)]  # copies
    rows += [(700, None, "user", "first"), (700, 0, None, "second"), (700, 0, "user", "tie"), (700, 0, "user", "tie")]
    rows += [(None, 0, "user", "no conversation"), (803, 0, "user", "alone"), (900, 1, "ab", "c"), (905, 1, "a", "bc")]
    rows += [(1000, t, "user", f"long {t % 7}") for t in range(45)] + [(1001, t, "user", f"long {t % 7}") for t in range(37)]
    return rows


@pytest.fixture(scope="module")
def talk_frame(spark, talks):
    return spark.createDataFrame([(*r, 1, "z") for r in talks], TURNS).repartition(7)


@pytest.mark.parametrize("block", [4096, 9])
def test_trie_of_awkward_conversations(talk_frame, talks, block):
    assert spark_trie(talk_frame, block=block) == plain_trie(talks)


def test_trie_over_many_partitions_and_short_runs(spark, talk_frame, talks, monkeypatch):
    found = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert spark_trie(talk_frame, block=15) == plain_trie(talks)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", found)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")


def test_trie_of_no_conversations(talk_frame):
    assert conversation_trie.trie(talk_frame.limit(0)).count() == 0
    assert conversation_trie.trie(talk_frame.where("conv_id IS NULL")).count() == 0
