from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from retentia.catalog import voc
from retentia.plans import hourly
from retentia.sources import adapters as A
from retentia.sources.ledger import BatchLedger
from retentia.streaming import ingest

NOW = datetime(2024, 1, 12, 9)


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return A.load(spark, sf_dir, "events")


@pytest.fixture(scope="module")
def names(spark, sf_dir):
    return A.code_names(spark, sf_dir)


def classifier_of(events):
    return lambda messages: A.message_category_of(events.join(messages.select(F.col("id").alias("event_id")), "event_id", "left_semi"))


def tables(ledger):
    return {t: sorted(map(str, ledger.read(t).collect())) for t in (hourly.MESSAGES, hourly.CLASSIFIED, hourly.ACTIVITY, hourly.RUNS)}


@pytest.mark.parametrize("broken", [hourly.MESSAGES, hourly.CLASSIFIED, hourly.ACTIVITY, hourly.RUNS])
def test_a_run_that_dies_between_two_tables_shows_nothing(spark, events, names, tmp_path, monkeypatch, broken):
    first, second = (A.messages_of(events.where(c)) for c in ("ts < '2024-01-08'", "ts >= '2024-01-08' AND ts < '2024-01-13'"))
    whole, torn = (BatchLedger(spark, str(tmp_path / n)) for n in ("whole", "torn"))
    for ledger in (whole, torn):
        assert hourly.run(ledger, 0, first, classifier_of(events), names, datetime(2024, 1, 7, 23))
    assert hourly.run(whole, 1, second, classifier_of(events), names, NOW)
    before = tables(torn)
    write = BatchLedger.write

    def dies(self, table, *rest):
        found = write(self, table, *rest)
        if table == broken:
            raise RuntimeError("lost")
        return found

    monkeypatch.setattr(BatchLedger, "write", dies)
    with pytest.raises(RuntimeError):
        hourly.run(torn, 1, second, classifier_of(events), names, NOW)
    monkeypatch.undo()
    assert torn.last() == 0 and tables(torn) == before
    assert hourly.run(torn, 1, second, classifier_of(events), names, NOW)
    assert tables(torn) == tables(whole) != before
    assert not hourly.run(torn, 1, second, classifier_of(events), names, NOW)
    with pytest.raises(ValueError):
        torn.write(hourly.MESSAGES, 1, first)


def test_messages_that_come_again_are_taken_once(spark, events, names, tmp_path):
    rows = A.messages_of(events.where("ts < '2024-01-08'"))
    ledger = BatchLedger(spark, str(tmp_path))
    for batch in range(2):
        hourly.run(ledger, batch, rows, classifier_of(events), names, datetime(2024, 1, 7, 23))
    assert ledger.read(hourly.MESSAGES).count() == rows.count()
    runs = {r["batch"]: r["rows"] for r in ledger.read(hourly.RUNS).collect()}
    assert runs == {0: rows.count(), 1: 0}


def test_the_run_follows_a_stream(spark, events, names, tmp_path):
    folder = str(tmp_path / "in")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
    stream = A.messages_of(ingest.read_files(spark, folder, events.schema, files_per_batch=1))
    ledger = BatchLedger(spark, str(tmp_path / "out"))
    for _ in range(2):  # a restart finds nothing new
        hourly.follow(stream, ledger, classifier_of(events), names, lambda: datetime(2024, 1, 30, 23), str(tmp_path / "ck"))
    assert ledger.last() == 1 and ledger.read(hourly.MESSAGES).count() == events.count()
    found = ledger.latest(hourly.ACTIVITY, voc.UPSERT_KEYS).drop("updated_at")
    wanted = voc.recontact.recontacts(A.messages_of(events), A.message_category_of(events), names, voc.TODAY, only_today=True)
    assert found.select(*wanted.columns).exceptAll(wanted).isEmpty() and found.count() == wanted.count()
