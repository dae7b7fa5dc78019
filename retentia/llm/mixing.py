"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.base import numbered, renamed, returned, words
from retentia.session import materialise

# Pieces of a source's documents whose sizes are summed before any is ranked.
SLICES = 16_384


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for a null."""
    return F.size(words(text)).cast("long")


def water_fill(sources: DataFrame, total: float, weight: str = "weight", cap: str = "cap") -> DataFrame:
    """``sources`` with ``target``: shares of ``total`` by weight, none above its cap.

    What a capped source leaves is shared by weight among the others, again and
    again until none is above.  With total above the sum of caps every source
    gets its cap.  Each round is one aggregate; a source once at its cap stays
    there, so the number of rounds is at most that of sources.  A weight that is
    null or not positive, or a null cap, gets nothing.
    """
    rows = materialise(
        sources.withColumn(weight, F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)).cast("double")).withColumn(
            cap, F.coalesce(F.col(cap).cast("double"), F.lit(0.0))
        ),
        "sources",
    )
    level = 0.0  # words per unit of weight
    while True:
        full = F.col(cap) <= F.col(weight) * level
        left, open_ = rows.agg(
            F.sum(F.when(full, F.col(cap)).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col(weight)))
        ).first()
        if not open_ or not open_ > 0:
            return rows.withColumn("target", F.when(F.col(weight) > 0, F.col(cap)).otherwise(0.0))
        raised = (total - left) / open_
        if raised <= level:
            return rows.withColumn("target", F.least(F.col(cap), F.col(weight) * level))
        level = raised


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0, seed: int = 4,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies`` of each row.

    A document's size is its number of words, 0 for a null text.  Sources in
    code point order, null last, weigh ``weights``, repeating, and share
    ``share`` times all sizes, at most ``epochs`` times their own size each.

    Every document of a source is taken floor(target / size of the source)
    times.  For the rest its documents are taken once more in the order of a
    seeded hash of id and text, whole, as long as the sum of their sizes comes
    nearer to the target; at most one document misses or passes it.  So what a
    source gives differs from its target by half a document at most, and no
    document is taken more than ceil(epochs) times.  Sizes are summed by slices
    of the hash; only the documents of the one slice in which the target falls
    are ranked.  Reruns agree.  Documents without words are taken the whole
    number of times.  Repeated rows count each; an empty table gives no rows.
    """
    draw = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    sized = materialise(
        docs.select(
            F.col(doc_id).alias("_id"),
            F.col(source).isNull().alias("_none"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
            word_count(F.col(text)).alias("size"),
            draw.alias("_draw"),
        ).withColumn("_slice", F.pmod(F.col("_draw"), F.lit(SLICES))),
        "sized",
    )
    name = ["_none", "_source"]
    slices = materialise(sized.groupBy(*name, "_slice").agg(F.sum("size").alias("words")), "slices")
    sizes = numbered(slices.groupBy(*name).agg(F.sum("words").alias("source_size")), name, "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    sizes = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    total = float(sizes.agg(F.sum("source_size")).first()[0] or 0) * share
    filled = water_fill(sizes, total).select(
        *name,
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_whole"),
    )
    filled = materialise(filled.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")), "filled")
    upto = Window.partitionBy(*name).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = slices.withColumn("_upto", F.sum("words").over(upto)).join(filled, name)
    # Below the slice in which the rest falls all documents are taken, above it none.
    cuts = summed.where("words > 0 AND _rest > 0 AND _upto - words < _rest AND _upto >= _rest").select(
        *name, F.col("_slice").alias("_cut"), (F.col("_rest") - (F.col("_upto") - F.col("words"))).alias("_need")
    )
    plan = materialise(filled.join(cuts, name, "left"), "plan")
    rows = sized.join(plan, name)
    ranked = Window.partitionBy(*name).orderBy("_draw", "_id", "size")
    before = F.coalesce(F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = rows.where("_slice = _cut").withColumn("_before", before)
    edge = edge.withColumn("_extra", (F.col("size") > 0) & (F.col("_before") + F.col("size") / 2 <= F.col("_need"))).drop("_before")
    rest = rows.where("_cut IS NULL OR _slice <> _cut").withColumn(
        "_extra", F.coalesce((F.col("size") > 0) & (F.col("_rest") > 0) & (F.col("_slice") < F.col("_cut")), F.lit(False))
    )
    copies = F.col("_whole") + F.col("_extra").cast("long")
    return rest.unionByName(edge).select(
        F.col("_id").alias(doc_id), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        copies.alias("copies"), F.col("_draw").alias("draw"),
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 4, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in their own columns, whatever their names."""
    docs, names = renamed(docs)
    doc_id, text, source = names[doc_id], names[text], names[source]
    taken = mix(docs, doc_id, text, source, seed=seed, **options)
    draw = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    # Rows that agree in id and text share a draw; their copies are summed and dealt evenly.
    counts = taken.groupBy("draw").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    counts = materialise(counts.where("_copies > 0"), "copies")
    keyed = docs.withColumn("_draw", draw)
    ranked = keyed.join(counts.withColumnRenamed("draw", "_draw"), "_draw")
    single = ranked.where("_rows = 1")
    several = ranked.where("_rows > 1").withColumn(
        "_nth", F.row_number().over(Window.partitionBy("_draw").orderBy(*[c for c in docs.columns]))
    )
    each = F.floor(F.col("_copies") / F.col("_rows"))
    several = several.withColumn("_copies", each + (F.col("_nth") <= F.col("_copies") - each * F.col("_rows")).cast("long")).drop("_nth")
    return (
        single.unionByName(several)
        .where("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .select(*returned(names))
    )
