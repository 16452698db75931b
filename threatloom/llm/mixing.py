"""Mixing sources to target weights along a curriculum that changes over training time.

Targets: the sources by code point, null last, weigh 1, 2, 3 and again; they share the size
of all documents, and none takes more than ``MAX_REPEATS`` times its own size. What a capped
source leaves is shared by weight among the others, so a target is ``min(cap, level * weight)``
for one level, found from running sums over the sources by their cap for each weight.

Curriculum: a source's rate over training time is piecewise linear. Its integral is the share
of the target demanded up to a time; inverting it gives a document's training position from
the words of its source that come before it. Documents of a source follow the order of a hash,
as often as the target asks; the copy that crosses the target is cut there.

Null text has no words: such documents take nothing and are in no mix. Rows without a ``doc_id`` follow
the order of a hash of their text. Repeated rows are
documents each. Null sources are a source. Only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import ROW, SPACE_CLASS, WORD_PATTERN, named, stored, unpacked, whole_row, words
from threatloom.operators.ranking import codes_in_order, running_sums

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Rates at the start, middle and end of training, by a source's place: even, fading, growing.
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))


def _choice(place: Column, values: tuple) -> Column:
    """The value at ``place`` modulo the number of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, place, source_size and target from rows of source and size; one row a source."""
    sources = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    places = codes_in_order(sources, "source", "place").withColumnRenamed("source", "named")
    last = places.count()
    placed = sources.join(places, F.col("source") == F.col("named"), "left").select(
        "source", "source_size", F.coalesce("place", F.lit(last)).cast("bigint").alias("place")
    ).withColumn("weight", _choice(F.col("place"), WEIGHTS)).withColumn("cap", MAX_REPEATS * F.col("source_size"))
    placed = stored(placed, "places")
    total, weight = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    ratio = F.col("cap") / F.col("weight")
    summed = running_sums(placed, [], ratio, {"caps": F.col("cap"), "weights": F.col("weight")}, ["place"])
    # With all sources before this one capped, the rest shares what is left by weight.
    left = F.lit(total or 0) - (F.col("caps") - F.col("cap"))
    level = left / (F.lit(weight or 0) - (F.col("weights") - F.col("weight")))
    found = summed.select(level.alias("level"), ratio.alias("ratio"), "place")
    chosen = found.where(F.col("level") <= F.col("ratio")).agg(
        F.min_by("level", F.struct("ratio", "place")).alias("level")
    ).first()
    target = F.least(F.col("cap").cast("double"), F.lit(chosen["level"] or 0.0) * F.col("weight"))
    return placed.select("source", "place", "source_size", target.alias("target"))


def training_time(share: Column, place: Column) -> Column:
    """The time in [0, 1] at which the integral of a source's schedule reaches ``share`` of its whole."""
    result = F.lit(1.0)
    steps = len(SCHEDULES[0]) - 1
    width = 1.0 / steps
    areas = [[(s[i] + s[i + 1]) / 2 * width for i in range(steps)] for s in SCHEDULES]
    demand = share * _choice(place, tuple(sum(a) for a in areas))
    for i in reversed(range(steps)):
        before = _choice(place, tuple(float(sum(a[:i])) for a in areas))
        upto = _choice(place, tuple(float(sum(a[: i + 1])) for a in areas))
        start = _choice(place, tuple(s[i] for s in SCHEDULES))
        slope = _choice(place, tuple((s[i + 1] - s[i]) / width for s in SCHEDULES))
        rest = F.greatest(demand - before, F.lit(0.0))
        # start * x + slope / 2 * x**2 = rest, in the form that holds for slope 0 as well
        within = 2 * rest / (start + F.sqrt(F.greatest(start * start + 2 * slope * rest, F.lit(0.0))))
        result = F.when(demand < upto, F.lit(i * width) + within).otherwise(result)
    return F.least(result, F.lit(1.0))


def plan(docs: DataFrame, payload: list[Column]) -> DataFrame:
    """The payload, size, source_size, target and ``copies`` of each row of ``docs``.

    ``copies`` lists what the mix takes of a document: the words of each copy and its
    training position. The sum of words over a source is its target, rounded.
    """
    doc_id, text = named(docs, "doc_id"), named(docs, "text")
    # Rows without an id follow a hash of their text, so that they too are cut into blocks.
    key = F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id, F.lit("mix")))
    sized = docs.select(
        named(docs, "source").alias("source"), doc_id.alias("doc_id"), key.alias("key"),
        F.size(words(text)).cast("bigint").alias("size"), *payload,
    )
    if not payload:
        sized = stored(sized, "sizes")  # a few numbers a row: texts are read once
    targets = source_targets(sized)
    ordered = running_sums(
        sized, ["source"], F.col("key"), {"upto": F.col("size")}, ["doc_id", "size"]
    ).withColumnRenamed("source", "own")
    joined = ordered.join(targets, F.col("own").eqNullSafe(F.col("source")))
    wanted = F.floor(F.col("target") + 0.5)
    copies = F.array(*[
        F.struct(
            F.greatest(F.least(F.col("size"), wanted - begin), F.lit(0)).alias("words"),
            training_time((begin + F.col("size") / 2) / F.greatest(wanted, F.lit(1)), F.col("place")).alias("position"),
        )
        for begin in [F.col("source_size") * i + F.col("upto") - F.col("size") for i in range(MAX_REPEATS)]
    ])
    return joined.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the position of the first copy of each row,
    in the order of these positions; rows that are not taken come last."""
    return plan(docs, []).orderBy(F.asc_nulls_last(F.get("copies", F.lit(0))["position"]), "key").select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]).alias("taken"),
        F.size("copies").cast("bigint").alias("copies"),
        F.get("copies", F.lit(0))["position"].alias("first_position"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, sorted by training position.

    A copy that was cut ends after its last word; ``n_chars``, if there, follows its text.
    """
    planned = plan(docs, [whole_row(docs).alias(ROW)])
    taken = planned.select(ROW, "size", F.explode("copies").alias("copy")).select(
        ROW, "size", F.col("copy.words").alias("words"), F.col("copy.position").alias("position")
    )
    ordered = taken.orderBy("position", F.xxhash64(ROW))
    text = F.col(ROW).getField("text")
    pieces = F.regexp_extract_all(text, F.lit(SPACE_CLASS + "*" + WORD_PATTERN), F.lit(0))
    cut = F.when(
        F.col("words") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    ).otherwise(text)
    ordered = ordered.withColumn("cut", cut)
    columns = []
    for field in docs.schema.fields:
        value = F.col(ROW).getField(field.name)
        if field.name == "text":
            value = F.col("cut")
        elif field.name == "n_chars":
            value = F.when(F.col("words") < F.col("size"), F.length("cut").cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return ordered.select(*columns)
