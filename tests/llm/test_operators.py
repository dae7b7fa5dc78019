"""Every training-data operator against a plain version, and on awkward tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import check
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from retentia.llm import (
    base, components, context_mixing, decontam, langid, licenses, linededup, mixing, packing, quality_rules, queries,
    rule_ensemble, simhash,
)
from retentia.session import scratch_dir

LOWER = simhash._LOWER
DOCS = "doc_id long, text string, lang string, source string, n_chars long, draw int, start int, `window` string"
SENTENCE = "the quick brown fox jumps over the lazy dog near the old river bank while rain falls on quiet hills"
ROWS = [
    (1, SENTENCE, "en", "a", 3, 1, 2, "x"),
    (1, SENTENCE, "en", "a", 3, 1, 2, "x"),  # a repeated row
    (2, SENTENCE, "en", "a", 3, 1, 2, "x"),
    (3, None, "en", "b", None, 1, 2, "x"),
    (4, "", None, None, 0, 1, 2, "x"),
    (None, "no id here but some words", "en", "b", 1, None, 2, None),
    (6, "word " * 60_000, "en", "b", 1, 1, 2, "x"),
    (7, " \n\t ", "fr", None, 4, 1, 2, "x"),
    (8, "l1 a\nl2 b\nl3 c\nl4 d", "en", "c", 4, 1, 2, "x"),
    (9, "z\nl1 a\nl2 b\nl3 c\nz", "en", "c", 4, 1, 2, "x"),
    (10, "été à la mer avec toi et moi", "fr", "c", 4, 1, 2, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(table):
    return {r["doc_id"]: (r["text"] or "") for r in table.select("doc_id", "text").collect()}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def keyed(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir).toPandas()
    assert check.compare(found, check.oracle_frame(check.connect(sf_dir), queries.oracle_sql()[name])) == ""


# --- op1 ---------------------------------------------------------------------


def plain_print(text: str | None) -> int:
    w = [x for x in (text or "").encode().translate(LOWER).split()]
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64)) if w else 0


def plain_groups(prints: dict[int, int]) -> dict[int, int]:
    ids, root = sorted(prints), {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_simhash(spark, sf_dir, texts):
    prints = {i: plain_print(t) for i, t in texts.items()}
    groups = plain_groups(prints)
    assert keyed(queries.queries()["op1_simhash"](spark, sf_dir), "fingerprint", "component_id") == {
        i: (f"{p:016x}", groups[i]) for i, p in prints.items()
    }


def test_simhash_families_of_near_copies(spark):
    # One family around a centre fills its anchors, so the grid is used.
    rng = np.random.default_rng(3)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(300)]
    prints = {i: f ^ 0x5BD1E995DEADBEEF for i, f in enumerate(flips)} | {1000 + i: int(x) for i, x in enumerate(rng.integers(0, 2**63, 50))}
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints.values())], "_fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(rows, cell=16)).collect()}
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    groups = plain_groups(prints)
    by_plain, by_links = defaultdict(set), defaultdict(set)
    for i, p in signed.items():
        by_plain[groups[i]].add(p)
        by_links[found.get(p, p)].add(p)
    assert sorted(map(sorted, by_plain.values())) == sorted(map(sorted, by_links.values()))


def test_simhash_awkward(docs, none):
    found = [(r["doc_id"], r["component_id"], r["fingerprint"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(found) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    assert {c for i, c, _ in found if i in (1, 2)} == {1}
    assert {(c, f) for i, c, f in found if i in (3, 4, 7)} == {(3, "0" * 16)}


# --- op2 ---------------------------------------------------------------------


def test_quality_rules(spark, sf_dir, texts):
    docs_ = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").collect()
    trusted = {r[0] for r in docs_}
    size = quality_rules.BUCKETS

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def features(w):
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, w[1:], strict=False)]
        return [signed(h) % size for h in one + two]

    every = {i: features(words(t)) for i, t in texts.items()}
    raw, good = Counter(), Counter()
    for i, f in every.items():
        raw.update(f)
        if i in trusted:
            good.update(f)
    n, g = sum(raw.values()), sum(good.values())
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    found = keyed(queries.queries()["op2_quality_rules"](spark, sf_dir), *columns)
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        w = [x.decode() for x in words(text)]
        lines = [x for x in text.split("\n") if x.encode().split()]
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in text)
        assert found[i][:6] == (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed)
        llr = sum(math.log(((good[k] + 1) / (g + size)) / ((raw[k] + 1) / (n + size))) for k in every[i]) / max(1, len(every[i]))
        assert found[i][6] == pytest.approx(llr, abs=1e-9)
        assert found[i][7] == (not failed and found[i][6] >= quality_rules.THRESHOLD)


def test_quality_rules_awkward(docs, none):
    found = quality_rules.assess(docs, docs.where("doc_id < 3"))
    rows = found.collect()
    assert len(rows) == len(ROWS) and "window" in found.columns
    assert all(not r["kept"] and r["llr"] == 0 and r["n_words"] == 0 for r in rows if r["doc_id"] in (3, 4, 7))
    assert quality_rules.assess(none, none).count() == 0 and quality_rules.assess(docs, none).count() == len(ROWS)


# --- op3 ---------------------------------------------------------------------


def test_language_id(spark, sf_dir, table):
    langs = keyed(table, "lang")
    found = keyed(queries.queries()["op3_language_id"](spark, sf_dir), "held_out", "lang_pred", "score")
    assert all(found[i][0] == (crc(i) % 5 == 0) and 0 <= found[i][2] <= 1 for i in langs)
    held = [found[i][1] == langs[i][0] for i in langs if found[i][0]]
    assert sum(held) / len(held) > 0.95


def test_language_id_backs_off(spark):
    rows = spark.createDataFrame([("aa bb aa", "x"), ("cc dd", "y")], "text string, lang string")
    model = langid.Model(langid.fit(rows).toPandas())
    assert model.langs == ["x", "y"]
    assert model.word("aa")[0] == pytest.approx(math.log(2 / 3))
    # An unseen word: of its bigrams only " a" and "aa" are known, in one language.
    assert model.predict("aaqq")[0] == "x" and model.predict("ddq")[0] == "y"
    assert model.predict("12 34 _") == ("und", 0.0) and model.predict(None) == ("und", 0.0)


def test_language_id_awkward(docs, none):
    found = langid.identify(docs, docs)
    assert {r["lang_pred"] for r in found.collect() if r["doc_id"] in (3, 4, 7)} == {"und"}
    assert found.count() == len(ROWS) and langid.identify(none, none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


# --- op4 ---------------------------------------------------------------------


def plain_targets(sizes: dict, total: float) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * left / share > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * left / share for s in names}
        full |= over


def test_mixing(spark, sf_dir, table):
    rows = {r["doc_id"]: (r["source"], len(words(r["text"]))) for r in table.collect()}
    sizes = Counter()
    for source, n in rows.values():
        sizes[source] += n
    targets = plain_targets(sizes, 1.5 * sum(sizes.values()))
    found = keyed(queries.queries()["op4_mixing"](spark, sf_dir), "size", "source_size", "target", "taken")
    taken, largest = Counter(), Counter()
    for i, (source, n) in rows.items():
        assert found[i][:2] == (n, sizes[source]) and found[i][2] == pytest.approx(targets[source], rel=1e-12)
        assert 0 <= found[i][3] <= 2 * n
        taken[source] += found[i][3]
        largest[source] = max(largest[source], n)
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)
    assert found == keyed(queries.queries()["op4_mixing"](spark, sf_dir), "size", "source_size", "target", "taken")


def test_mixing_awkward(docs, none):
    found = mixing.mix(docs).collect()
    assert len(found) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in found)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)


# --- op5 ---------------------------------------------------------------------


def test_packed_tokens(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    found, start = keyed(queries.queries()["op5_packed_tokens"](spark, sf_dir), "start", "n_tokens", "ids_crc32"), 0
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert found[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 32])
def test_packing_round_trip_and_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    lists = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 3, 70, 0, 1000, 8, 1)]
    out = packing.ShardWriter(str(tmp_path / "a.tok"), bits, block=64)
    for k, ids in enumerate(lists):
        out.add(None if k == 3 else 10 + k, ids)
    assert out.close() == sum(map(len, lists))
    shard = packing.Shard(str(tmp_path / "a.tok"))
    for k, (doc, start, ids) in enumerate(shard.documents(step=50)):
        assert doc == (None if k == 3 else 10 + k) and ids.tolist() == lists[k].tolist() == shard.document(k).tolist()
        assert start == sum(map(len, lists[:k]))
    assert (tmp_path / "a.tok").stat().st_size < sum(map(len, lists)) * bits / 8 + 600
    with pytest.raises(ValueError):
        packing.ShardWriter(str(tmp_path / "b.tok"), 3).add(1, np.array([8], np.uint32))


def test_packing_awkward(spark, docs, none):
    encoder = packing.word_encoder(public_tokenizers.path(queries.TOKENIZER), 2)
    found = packing.read(packing.write(docs, scratch_dir(spark, "t"), encoder, queries.VOCABULARY)).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 1, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert [r["n_tokens"] for r in found if r["doc_id"] in (3, 4, 7)] == [1, 1, 1]
    assert packing.read(packing.write(none, scratch_dir(spark, "t"), encoder, queries.VOCABULARY)).count() == 0


# --- op6 ---------------------------------------------------------------------


def test_decontamination_awkward(spark, docs, none):
    items = spark.createDataFrame(
        [(1, SENTENCE.upper()), (2, "Old-River bank"), (3, None), (4, "..."), (None, "l1 a"), (5, "absent words")], "item_id long, text string"
    )
    rows = decontam.contaminated(docs, items).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert (found[2]["n_hit"], found[2]["n_items"], found[2]["contaminated"]) == (20, 2, True)
    assert (found[8]["n_hit"], found[8]["n_items"]) == (2, 0)
    assert not any(found[i]["contaminated"] for i in (None, 3, 4, 6, 7, 10))
    assert decontam.contaminated(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontam.contaminated(docs, items.limit(0)).collect())


def test_proximity_matches(spark):
    docs_ = spark.createDataFrame([(1, "red big fox runs home"), (2, "red fox runs home"), (3, "fox red home runs")], "doc_id long, text string")
    wanted = decontam.windows(spark.createDataFrame([(1, "red fox runs home")], "item_id long, text string"))
    counts = decontam.corpus_counts(docs_, wanted.select(F.explode("window").alias("term")).distinct())
    chosen = decontam.probes(wanted, counts)
    index = decontam.build_index(docs_, chosen.select("term"), reach=decontam.WINDOW)
    found = {(r["doc_id"], r["exact"]) for r in decontam.matches(index, chosen, slack=1).collect()}
    assert (2, True) in found and (1, False) in found or (3, False) in found
    assert {r["doc_id"] for r in decontam.matches(index, chosen).collect()} == {2}


# --- op7 ---------------------------------------------------------------------


def test_quality_classifier(spark, sf_dir):
    labels = keyed(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    found = keyed(queries.queries()["op7_quality_classifier"](spark, sf_dir), "held_out", "score", "predicted")
    assert all(f[0] == (crc(i) % 4 == 2) and 0 <= f[1] <= 1 and f[2] == (f[1] >= 0.7) for i, f in found.items())
    held = [found[i][2] == q for i, (q,) in labels.items() if found[i][0]]
    assert sum(held) / len(held) > 0.9


def test_rules_are_conjunctions(spark):
    rule = rule_ensemble.Rule((("upper", True, 0.5), ("wide", False, 1.0)))
    rows = spark.createDataFrame([(0.5, 1.1), (0.6, 2.0), (0.1, 1.0)], "upper double, wide double")
    assert [r[0] for r in rows.select(rule.column()).collect()] == [True, False, False]


def test_quality_classifier_awkward(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (99, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        scored = rule_ensemble.score(docs, rule_ensemble.fit(docs, known))
        assert scored.count() == len(ROWS) and scored.where("score IS NULL").count() == 0
    assert rule_ensemble.score(none, rule_ensemble.fit(none, labels)).count() == 0


# --- op8 ---------------------------------------------------------------------


def test_context_mixing(spark, sf_dir, texts):
    lower = {i: [*t.encode().translate(LOWER).split(), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in lower.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    columns = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    found = keyed(queries.queries()["op8_context_mixing"](spark, sf_dir), *columns)
    for i, ws in lower.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert found[i][:4] == (crc(i) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert found[i][4] == pytest.approx(base, rel=1e-9) and found[i][5] < 0
    long = [found[i][6] for i, t in texts.items() if found[i][0] and len(t) > 500]
    assert sum(long) / len(long) < 4


def test_context_mixing_is_a_distribution():
    counts = np.zeros(context_mixing._offsets()[-1], np.int64)
    texts = [b"the cat sat on the mat and the dog ran", b"a cat and a dog"] * 5
    context_mixing.count_into(counts, texts)
    mixer = context_mixing.fit_mixer(counts, texts[:2])
    for context in (b"\0\0\0\0\0", b"e cat", b"qqqqq"):
        run = np.uint64(int.from_bytes(context, "big") << 8) + np.arange(256, dtype=np.uint64)
        assert (2.0 ** -mixer.cost_of(run).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    alone = [mixer.bits([t])[0] for t in (b"", b"a cat", b"zz")]
    assert mixer.bits([b"", b"a cat", b"zz"]).tolist() == pytest.approx(alone) and alone[1] < alone[2] * 2


def test_context_mixing_learns_from_all_texts(table, texts):
    whole = {i: t.encode().translate(LOWER) for i, t in texts.items()}
    assert max(map(len, whole.values())) > 4096
    counts = np.zeros(context_mixing._offsets()[-1], np.float32)
    context_mixing.count_into(counts, list(whole.values()))
    mixer = context_mixing.fit_mixer(counts, list(whole.values()))
    rows = table.select("doc_id", "text", F.lit(True).alias("train")).coalesce(1)
    found = {r["doc_id"]: r["score"] for r in context_mixing.score(rows, "train").collect()}
    expected = dict(zip(whole, mixer.bits(list(whole.values())) * -math.log10(2), strict=True))
    assert found == pytest.approx(expected, rel=1e-4)


def test_context_mixing_sums_over_tasks(table, texts):
    """Runs of all tasks arrive, counted as often as they come."""
    rows = table.select(F.col("text").cast("binary").alias("_text")).repartition(5)
    counts, _, n, packed = context_mixing._count(rows, [])
    unpacked = [context_mixing._unpacked(r["data"]) for r in packed.collect()]
    run, times = context_mixing.merged(unpacked)
    expected = context_mixing.distinct_runs([t.encode().translate(LOWER) for t in texts.values()])
    assert n == len(texts) and np.array_equal(run, expected[0]) and np.array_equal(times, expected[1])
    again = np.zeros_like(counts)
    context_mixing.count_runs(again, run, times)
    assert np.array_equal(counts, again)


def test_context_mixing_awkward(docs, none):
    rows = docs.withColumn("train", F.col("doc_id") != 2)
    found = context_mixing.score(rows, "train").collect()
    assert len(found) == len(ROWS) and all(r["score"] < 0 and r["base_score"] <= 0 for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (3, 4, 7)} == {1}
    assert context_mixing.score(none.withColumn("train", F.lit(True)), "train").count() == 0
    untrained = context_mixing.score(docs.withColumn("train", F.lit(False)), "train").collect()
    assert {r["train_tokens"] for r in untrained} == {0}


# --- op9 ---------------------------------------------------------------------


def test_licenses(spark):
    files = spark.createDataFrame(
        [
            ("LICENSE", "Released under the MIT License."),
            ("a/x.py", "# Licensed under the Apache License,\n# Version 2.0\ncode"),
            ("a/y.py", "nothing here about terms"),
            ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            ("a/b/c/z.py", None),
            ("a/b/c/w.py", ""),
            ("q.py", "mit der Bahn in the public domain\n" * 3),
            (None, "Released under the MIT License."),
        ],
        "path string, text string",
    )
    found = {r["path"]: (r["own_license"], r["license"], r["origin"]) for r in licenses.inherit(files, licenses.scan(files)).collect()}
    assert found["a/x.py"] == ("Apache-2.0", "Apache-2.0", "a/x.py")
    assert found["a/y.py"] == (None, "MIT", "") and found["q.py"] == (None, "MIT", "")
    assert found["a/b/c/z.py"] == found["a/b/c/w.py"] == (None, "GPL-3.0", "a/b")
    assert found[None] == (None, None, None)
    assert licenses.inherit(files.limit(0), licenses.scan(files.limit(0))).count() == 0


def test_every_template_finds_itself(spark):
    rows = [(f"{i}", f"some code\n// {text}\nmore code") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    found = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {str(i): name for i, (name, _) in enumerate(licenses.TEMPLATES)}


def test_license_query(spark, sf_dir, texts):
    found = keyed(queries.queries()["op9_licenses"](spark, sf_dir), "own_license")
    assert {i for i, (own,) in found.items() if own} == {i for i, t in texts.items() if "icensed under" in t or "MIT License" in t}


# --- op10 --------------------------------------------------------------------


def test_line_dedup_awkward(docs, none):
    found = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert found[9]["text"] == "z\nz" and (found[9]["n_lines"], found[9]["n_removed"]) == (5, 3)
    assert found[8]["n_removed"] == 0 and found[3]["text"] is None and found[3]["n_lines"] == 0
    assert (found[4]["text"], found[4]["n_lines"]) == ("", 1)
    assert linededup.dedup_lines(docs).columns[:1] == ["doc_id"] and linededup.dedup_lines(none).count() == 0


def test_line_dedup_merges_overlaps(spark):
    rows = spark.createDataFrame([(1, "a\na\na\na\nb"), (2, "x\na\na\na\na\ny"), (3, "\n\n\n\n")], "doc_id long, text string")
    found = keyed(linededup.dedup_lines(rows), "text")
    assert found == {1: ("a\nb",), 2: ("x\ny",), 3: ("\n\n\n\n",)}


def test_line_dedup_of_short_texts(spark):
    rows = spark.createDataFrame(
        [(1, "one line"), (2, " one line"), (3, "one line\nand two"), (4, "one line\nand two"), (5, "one line\nand two\nthree"), (6, " "), (7, " "),
         (8, "x\none line\ny")],
        "doc_id long, text string",
    )
    found = keyed(linededup.dedup_lines(rows), "text", "n_removed")
    assert found == {
        1: ("one line", 0), 2: ("", 1), 3: ("one line\nand two", 0), 4: ("", 2), 5: ("one line\nand two\nthree", 0), 6: (" ", 0), 7: (" ", 0),
        8: ("x\none line\ny", 0),
    }


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, docs, none, table):
    for rows in (docs.select("doc_id", "text", "lang", "source", "n_chars"), none.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf_dir).columns == rows.columns
            stage(spark, rows, sf_dir).count()
    groups = plain_groups({r["doc_id"]: plain_print(r["text"]) for r in table.collect()})
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, sf_dir).collect()]
    assert sorted(kept) == sorted(set(groups.values()))
    bad = keyed(queries.queries()["op6_decontaminate"](spark, sf_dir), "contaminated")
    clean = [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, table, sf_dir).collect()]
    assert sorted(clean) == sorted(i for i, (x,) in bad.items() if not x)


def test_near_duplicates_sorts_repeated_rows_only(spark, sf_dir, table):
    once = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, sf_dir).collect())
    found = corpus_pipeline.near_duplicates(spark, table.union(table.where("doc_id % 3 = 0")), sf_dir)
    assert sorted(r["doc_id"] for r in found.collect()) == once
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_pipeline_runs_whole(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert found and found[0]["start"] == 0
    for a, b in zip(found, found[1:], strict=False):
        assert b["start"] == a["start"] + a["n_tokens"] and b["doc_id"] >= a["doc_id"]


# --- columns of any name -----------------------------------------------------


def clashing(rows, *modules):
    """The rows with a column, holding its own name, for every name that the modules' sources quote."""
    import inspect
    import re

    quoted = {n for m in (*modules, base) for n in re.findall(r"[\"'`]([A-Za-z_]\w*)[\"'`]", inspect.getsource(m))}
    have = {c.lower() for c in rows.columns}
    new = {n.lower(): n for n in sorted(quoted) if n.lower() not in have}
    return rows.select(*rows.columns, *[F.lit(n).alias(n) for n in new.values()]), list(new.values())


STAGE_MODULES = {
    "language_id": [langid], "near_duplicates": [simhash, components], "decontaminate": [decontam], "mix_sources": [mixing],
}


@pytest.mark.parametrize("name", list(STAGE_MODULES))
def test_stage_keeps_columns_of_any_name(spark, sf_dir, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows, extra = clashing(plain, corpus_pipeline, *STAGE_MODULES[name])
    found = stage(spark, rows, sf_dir)
    assert found.columns == rows.columns and len(extra) > 10
    got = [r.asDict() for r in found.collect()]
    assert all(r[c] == c for r in got for c in extra)

    def keyed(rows):
        return sorted(str([r[c] for c in plain.columns]) for r in rows)

    assert keyed(got) == keyed(r.asDict() for r in stage(spark, plain, sf_dir).collect())


def _assessed(rows):
    return quality_rules.assess(rows, rows.select("doc_id").limit(3))


def _licensed(rows):
    files = rows.withColumnRenamed("doc_id", "path").withColumn("path", F.col("path").cast("string"))
    return licenses.inherit(files, licenses.scan(files))


def _predicted(rows):
    import pandas as pd

    model = pd.DataFrame({"lang": ["en", "fr"], "size": [0, 0], "gram": ["the", "mer"], "logp": [-1.0, -1.0]})
    return langid.predict(rows, model)


OPERATORS = {
    "assess": (_assessed, quality_rules, quality_rules.MADE, ["text"]),
    "predict": (_predicted, langid, ["lang_pred", "score"], ["text"]),
    "dedup_lines": (linededup.dedup_lines, linededup, ["n_lines", "n_removed"], []),
    "mixed_documents": (mixing.mixed_documents, mixing, [], []),
    "inherit": (_licensed, licenses, ["own_license", "own_score", "license", "origin"], ["doc_id", "path"]),
    "rules": (lambda rows: rule_ensemble.score(rows, rule_ensemble.Ensemble(0.5, {})), rule_ensemble, ["score", "predicted"], ["text"]),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operator_keeps_columns_of_any_name(spark, docs, name):
    run, module, made, gone = OPERATORS[name]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows, extra = clashing(plain.withColumn("path", F.lit("x")) if name == "inherit" else plain, module)
    if name == "inherit":
        rows, extra = clashing(plain, module)
        rows, extra = rows.drop("path"), [c for c in extra if c != "path"]
    found, wanted = run(rows), run(plain)
    assert len(found.columns) == len({c.lower() for c in found.columns})
    kept = [c for c in extra if c not in made and c not in gone]
    got = [r.asDict() for r in found.collect()]
    assert kept and all(r[c] == c for r in got for c in kept)

    def keyed(rows):
        return sorted(str([r[c] for c in wanted.columns]) for r in rows)

    assert keyed(got) == keyed(r.asDict() for r in wanted.collect())
