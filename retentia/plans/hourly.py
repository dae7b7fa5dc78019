"""The hourly message run: ingest, classify, aggregate, merge."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.operators import matching, messages, recontact
from retentia.operators.taxonomy import taxonomy_json
from retentia.sources import sinks
from retentia.sources.ledger import BatchLedger, run_batch
from retentia.sources.readers import between
from retentia.streaming.ingest import run_available


def ingest(source: DataFrame, start: datetime, end: datetime, as_of: datetime) -> DataFrame:
    """Messages inserted in [start, end), in the domain layout."""
    return source.where(between("inserted_at", start, end)).select(
        "id", "rcno", "ccod", "content", F.col("inserted_at").alias("received_at"),
        F.lit(as_of).alias("created_at"), F.lit(as_of).alias("updated_at"),
    )


def pest_terms(spark) -> DataFrame:
    """The fixed pest dictionary in match order."""
    return spark.createDataFrame(list(enumerate(matching.PESTS)), "ord int, term string")


def classify(
    received: DataFrame, taxonomy: DataFrame, scorer: messages.Scorer, as_of: datetime, threshold: float = matching.MIN_SIMILARITY
) -> DataFrame:
    """Stored classification of new messages."""
    scored = messages.score_messages(received, scorer, taxonomy_json(taxonomy))
    texts = received.select("id", F.col("content").alias("text"))
    fallback = matching.best_term(texts, pest_terms(received.sparkSession), threshold).select("id", "term")
    return messages.classified_messages(received, scored, taxonomy, as_of, fallback)


Classifier = Callable[[DataFrame], DataFrame]
MESSAGES, CLASSIFIED, ACTIVITY, RUNS = "messages", "classified", "activity", "runs"


def run(ledger: BatchLedger, batch: int, received: DataFrame, classifier: Classifier, taxonomy: DataFrame, now: datetime) -> bool:
    """Ingests, classifies and refreshes the re-contact counts of ``now``'s day, all tables in one committed batch.

    ``received``: the new messages with id, ccod and created_at.  A message
    that a committed batch has already isn't taken again.  ``classifier``
    makes their stored classification.  Counters are taken while the tables are
    written and stored beside them.  A batch that was committed isn't run again.
    """

    def body(ledger: BatchLedger, batch: int) -> None:
        new = received
        if ledger.last() >= 0:
            new = new.join(ledger.read(MESSAGES).select("id"), "id", "left_anti")
        counted = {"rows": F.count(F.lit(1)), "customers": F.approx_count_distinct("ccod")}
        messages, taken = ledger.write(MESSAGES, batch, new, counted)
        claims = {"classified": F.count(F.lit(1)), "claims": F.count_if(F.col("is_claim") == 1)}
        classified, known = ledger.write(CLASSIFIED, batch, classifier(messages), claims)
        counts = recontact.recontacts(
            ledger.read_with(MESSAGES, batch, messages), ledger.read_with(CLASSIFIED, batch, classified), taxonomy, now.date(), only_today=True
        )
        _, keys = ledger.write(ACTIVITY, batch, counts.withColumn("updated_at", F.lit(now)), {"keys": F.count(F.lit(1))})
        row = {"as_of": now, **taken, **known, **keys}
        schema = "as_of timestamp, rows long, customers long, classified long, claims long, keys long"
        ledger.write(RUNS, batch, ledger.spark.createDataFrame([row], schema))

    return run_batch(ledger, batch, body)


def follow(stream: DataFrame, ledger: BatchLedger, classifier: Classifier, taxonomy: DataFrame, now: Callable[[], datetime], checkpoint: str) -> None:
    """The same for every batch of a stream of messages; a batch that is repeated after a failure replaces itself."""
    run_available(stream, checkpoint, lambda rows, batch: run(ledger, batch, rows, classifier, taxonomy, now()) and None)


def refresh_activity(
    message_rows: DataFrame, classified: DataFrame, taxonomy: DataFrame, day: date, folder: str, run: str, now: datetime
) -> None:
    """Merges the day's re-contact counts into the activity table."""
    counts = recontact.recontacts(message_rows, classified, taxonomy, day, only_today=True)
    sinks.upsert(
        counts, f"{folder}/activity", f"{folder}/staging/{run}",
        ["aggregate_date", "ccod", "category_code"], "aggregate_date", F.lit(now),
    )


def rebuild_activity(
    message_rows: DataFrame, classified: DataFrame, taxonomy: DataFrame, day: date, path: str, now: datetime
) -> None:
    """Replaces the activity table by all days of the lookback."""
    counts = recontact.recontacts(message_rows, classified, taxonomy, day)
    stamped = counts.withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("aggregate_date").parquet(path)
