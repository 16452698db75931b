"""Near-duplicate documents: fast similarity sketches, banding, verification on full sets.

The sketch is that of Dahlgaard, Knudsen and Thorup (2017): in round ``i`` every element
of a set falls into a hashed bin with the value ``i + hash``; a bin keeps its least value.
Rounds go on until each of the ``t`` bins is filled, and rounds ``t`` to ``2t - 1`` give
every element to bin ``i - t``, so after ``2t`` rounds no bin of a non-empty set is empty.
Large sets fill in a few rounds, so a sketch costs about one hash an element, and its
agreement concentrates about the similarity as that of ``t`` independent minima.

Two sets with similarity 0.8 meet in none of 40 bands of 5 coordinates with probability
1.3e-7. Whoever meets is verified on the full sets; banding never decides a link.

Null text, text without words: an empty set, linked with nothing, a component of its own.
Repeated rows count as copies. Rows without a ``doc_id`` are left as they are: no links,
component null, kept. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import ROW, beside, named, stored, unpacked, whole_row
from threatloom.llm.components import components
from threatloom.llm.shingles import mixed, shingle_sets, slices

BANDS = 40
BAND_ROWS = 5
#: Rounds in which every bucket compares its members with one of them, before families.
STAR_ROUNDS = 2
#: Elements and rows of a block in which the sets of a family are compared.
BLOCK_ELEMENTS, BLOCK_ROWS = 100_000, 1_000
#: Sets indexed under an element up to which each set that has it is paired with all of them.
GROUP_SETS = 64

_STEP = 0x9E3779B97F4A7C15


def sketches(elements: np.ndarray, owners: np.ndarray, n_sets: int, t: int) -> np.ndarray:
    """Sketch rows (n_sets x t) of hashed elements that belong to sets 0 .. n_sets-1.

    A value holds the round in its upper 16 bits and the hash below, so that an earlier
    round always wins. Sets without elements keep the largest value everywhere.
    """
    empty = np.iinfo(np.uint64).max
    table = np.full(n_sets * t, empty, dtype=np.uint64)
    elements, owners = elements.astype(np.uint64), owners.astype(np.int64)
    open_sets = np.zeros(n_sets, dtype=bool)
    open_sets[owners] = True
    for i in range(2 * t):
        if not len(elements):
            break
        hashed = mixed(elements + np.uint64((_STEP * (i + 1)) & (2**64 - 1)))
        if i < t:
            # The upper 32 bits choose the bin, the lower 48 bits order its elements.
            bins = ((hashed >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.int64(i - t)
        order = mixed(hashed) >> np.uint64(16)
        np.minimum.at(table, owners * t + bins, order | np.uint64(i << 48))
        still = (table.reshape(n_sets, t) == empty).any(axis=1) & open_sets
        if not still.all():
            left = still[owners]
            elements, owners = elements[left], owners[left]
    return table.reshape(n_sets, t)


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch; the band is mixed into its key."""
    parts = table[:, : bands * rows].reshape(len(table), bands, rows)
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(rows):
        keys = mixed(keys + mixed(parts[:, :, i] + np.uint64(i)))
    return keys


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit words as an Arrow column of lists."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _set_reader(size: int):
    """Arrow function: (id, text) to (id, elements)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                sets = shingle_sets(part.column(1), size)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], ["set_id", "elements"])

    return run


def _sketcher(size: int, bands: int, rows: int):
    """Arrow function: (doc_id, text) to the set's size, its two hashes and its band keys."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                sets = shingle_sets(part.column(1), size)
                lengths = np.array([len(s) for s in sets], dtype=np.int64)
                flat, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
                hashes = [np.zeros(len(sets), dtype=np.uint64) for _ in range(2)]
                for seed, total in enumerate(hashes, 1):
                    np.add.at(total, owners, mixed(flat + np.uint64(seed)))
                keys = band_keys(sketches(flat, owners, len(sets), bands * rows), bands, rows)
                columns = [part.column(0), pa.array(lengths), *[pa.array(h.view(np.int64)) for h in hashes]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, _lists(list(keys))], ["doc_id", "n", "h1", "h2", "keys"]
                )

    return run


def _open_buckets(buckets: DataFrame, pivot_order: Column) -> DataFrame:
    """The buckets whose members lie in more than one component, each with one member as pivot."""
    return (
        buckets.groupBy("key")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.min_by(F.struct("set_id", "component"), pivot_order).alias("pivot"),
            F.count("*").alias("members"),
        )
        .where(F.col("low") < F.col("high"))
        .select("key", "pivot", "members")
    )


def _star_pairs(buckets: DataFrame, turn: int, total: int) -> DataFrame:
    """Each of ``total`` members beside the pivot of its bucket, if that is open: no more pairs than members."""
    order = F.xxhash64("set_id", F.lit(turn)) if turn else F.col("set_id")
    joined = beside(buckets, _open_buckets(buckets, order), "key", "members", total, "set_id")
    return joined.where(F.col("pivot.component") != F.col("component")).select(
        F.least("set_id", "pivot.set_id").alias("first"),
        F.greatest("set_id", "pivot.set_id").alias("second"),
    )


def _compared(percent: int):
    """Cogroup function: the links between a block of queries and a block of members.

    Elements are matched by one sort of both blocks; an element adds one to the counts of
    all pairs that hold it. Only links leave the task.
    """

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        sides = []
        for side in (queries, members):
            side = side.combine_chunks()
            lists = side.column("elements").combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(side.num_rows), lengths)
            ids = side.column("set_id").to_numpy(), side.column("component").to_numpy()
            sides.append((flat, rows, lengths, *ids))
        (flat_q, rows_q, n_q, id_q, in_q), (flat_m, rows_m, n_m, id_m, in_m) = sides
        common = np.zeros((len(id_q), len(id_m)), dtype=np.int32)
        order_q, order_m = np.argsort(flat_q, kind="stable"), np.argsort(flat_m, kind="stable")
        flat_q, rows_q, flat_m, rows_m = flat_q[order_q], rows_q[order_q], flat_m[order_m], rows_m[order_m]
        shared = np.intersect1d(flat_q, flat_m)
        spans = [np.searchsorted(x, shared, side=s) for x in (flat_q, flat_m) for s in ("left", "right")]
        for q0, q1, m0, m1 in zip(*[x.tolist() for x in spans]):
            common[rows_q[q0:q1, None], rows_m[None, m0:m1]] += 1
        union = n_q[:, None] + n_m[None, :] - common
        linked = (100 * common.astype(np.int64) >= percent * union.astype(np.int64)) & (in_q[:, None] != in_m[None, :])
        q, m = np.nonzero(linked)
        first, second = np.minimum(id_q[q], id_m[m]), np.maximum(id_q[q], id_m[m])
        return pa.table({"first": pa.array(first, pa.int64()), "second": pa.array(second, pa.int64())})

    return run


def _prefixes(members: DataFrame, percent: int) -> DataFrame:
    """element, set_id, component, n, at (from 1) and indexed: the rarest elements of each set, rarest first.

    With elements in one order for all, a set and one that is at most as large can only be alike enough
    if the larger one's first ``n - percent * n + 1`` elements and the smaller one's shorter indexed
    prefix meet. Rare elements come first, so what many sets share is hardly ever in a prefix.
    """
    each = members.select("set_id", "component", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    shared = each.groupBy("element").agg(F.count("*").alias("sets")).where("sets > 1")
    total = members.agg(F.sum(F.size("elements"))).first()[0] or 0
    ordered = (
        beside(each, shared, "element", "sets", total, "set_id")
        .groupBy("set_id", "component", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("sets", F.lit(1)).alias("sets"), "element"))).alias("own"))
    )
    n = F.col("n")
    probed = n - F.ceil(n * percent / 100.0 - 1e-9) + 1
    indexed = n - F.ceil(n * 2 * percent / (100.0 + percent) - 1e-9) + 1
    return (
        ordered.select("set_id", "component", "n", F.posexplode(F.slice("own", 1, probed.cast("int"))).alias("at", "e"))
        .where("e.sets > 1")
        .select(F.col("e.element").alias("element"), "set_id", "component", "n", (F.col("at") + 1).alias("at"),
                (F.col("at") < indexed).alias("indexed"))
    )


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that meet in an element and whose sizes and places allow the similarity."""
    small = rows.where("indexed").select(
        "element", F.col("set_id").alias("other"), F.col("component").alias("other_component"),
        F.col("n").alias("other_n"), F.col("at").alias("other_at"),
    )
    fits = (F.col("component") != F.col("other_component")) & (F.col("other_n") <= F.col("n"))
    fits &= 100 * F.col("other_n") >= percent * F.col("n")
    # No more than this one and what follows it in the shorter rest can be common.
    most = F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at")) + 1
    fits &= (100 + percent) * most >= percent * (F.col("n") + F.col("other_n"))
    return (
        rows.select("element", "set_id", "component", "n", "at").join(small, "element").where(fits)
        .select(F.least("set_id", "other").alias("first"), F.greatest("set_id", "other").alias("second"))
        .distinct()
    )


def _remaining_links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components, for all buckets that star rounds left open.

    Members meet in the rare elements of their prefixes. Where at most ``GROUP_SETS`` sets are indexed
    under an element, each set that has it makes no more pairs than those. Elements under which more
    are indexed are few; their sets are compared in blocks (``_links_in_blocks``).
    """
    wanted = buckets.join(_open_buckets(buckets, F.col("set_id")).select("key"), "key", "left_semi")
    members = stored(wanted.select("set_id", "component").distinct().join(sets, "set_id"), "members")
    rows = stored(_prefixes(members, percent), "prefixes")
    met = (
        rows.groupBy("element")
        .agg(
            F.count_if("indexed").alias("sets"), F.count("*").alias("rows"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        )
        .where("sets > 0 and low < high")
        .select("element", "sets", "rows")
    )
    told = beside(rows, met, "element", "rows", rows.count(), "set_id")
    pairs = stored(_candidates(told.where(F.col("sets") <= GROUP_SETS), percent), "pairs")
    many = told.where(F.col("sets") > GROUP_SETS)
    families = stored(many.select(F.col("element").alias("family"), "set_id", "component").distinct(), "families")
    found = _verified(pairs, sets, percent)
    if families.isEmpty():
        return found
    return found.union(_links_in_blocks(families.join(sets, "set_id"), percent, families.count())).distinct()


def _links_in_blocks(members: DataFrame, percent: int, total: int) -> DataFrame:
    """Links within each family of sets (family, set_id, component, elements; ``total`` rows).

    In a family, whoever is outside the largest component is a query; queries meet all members
    of the family in blocks of about ``BLOCK_ELEMENTS`` elements and at most about ``BLOCK_ROWS``
    sets, one task for each pair of blocks. No pair leaves its task unless it is a link.
    """

    def blocks_of(elements: Column, rows: Column) -> Column:
        return F.greatest(F.ceil(elements / BLOCK_ELEMENTS), F.ceil(rows / BLOCK_ROWS)).cast("int")

    parts = members.groupBy("family", "component").agg(
        F.count("*").alias("rows"), F.sum(F.size("elements")).alias("n")
    )
    order = F.struct("rows", "component")
    largest = parts.groupBy("family").agg(
        F.max_by("component", order).alias("largest"),
        blocks_of(F.sum("n"), F.sum("rows")).alias("blocks"),
        blocks_of(F.sum("n") - F.max_by("n", order), F.sum("rows") - F.max_by("rows", order)).alias("query_blocks"),
        F.sum("rows").alias("in_family"),
    )
    hashed = F.xxhash64("set_id")
    dealt = beside(members, largest, "family", "in_family", total, "set_id")

    def blocks(count: str) -> Column:
        return F.pmod(hashed, F.col(count)).cast("int")

    def all_blocks(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    columns = ["family", "set_id", "component", "elements"]
    renewed = [F.col(c).alias(c) for c in columns]  # names of their own for the self-join
    queries = dealt.where(F.col("component") != F.col("largest")).select(
        *renewed, blocks("query_blocks").alias("q"), all_blocks("blocks").alias("m")
    )
    others = dealt.where(F.col("query_blocks") > 0).select(
        *columns, all_blocks("query_blocks").alias("q"), blocks("blocks").alias("m")
    )
    keys = ["family", "q", "m"]
    return (
        queries.groupBy(*keys).cogroup(others.groupBy(*keys))
        .applyInArrow(_compared(percent), "first bigint, second bigint").distinct()
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    first = sets.select(F.col("set_id").alias("first"), F.col("elements").alias("elements_first"))
    second = sets.select(F.col("set_id").alias("second"), F.col("elements").alias("elements_second"))
    common = F.size(F.array_intersect("elements_first", "elements_second"))
    union = F.size("elements_first") + F.size("elements_second") - common
    return (
        pairs.join(second, "second")
        .join(first, "first")
        .where(100 * common >= percent * union)
        .select("first", "second")
        .distinct()
    )


def _same_size(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity: the smaller set has ``percent`` of the larger."""
    first = sizes.select(F.col("set_id").alias("first"), F.col("n").alias("n_first"))
    second = sizes.select(F.col("set_id").alias("second"), F.col("n").alias("n_second"))
    return (
        pairs.join(first, "first")
        .join(second, "second")
        .where(
            100 * F.least("n_first", "n_second") >= percent * F.greatest("n_first", "n_second")
        )
        .select("first", "second")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked when their shingle sets have a similarity of ``percent`` or more;
    ``component_id`` is the least document reachable over links. Equal sets are one class,
    named by its least document, so copies never meet in pairs. Members of a bucket that
    already reach each other are not compared again; all others are, until every pair of
    different components that shares a bucket has been verified.
    """
    base = docs.select(named(docs, "doc_id").cast("bigint").alias("doc_id"), named(docs, "text").alias("text"))
    keyed = stored(
        base.mapInArrow(
            _sketcher(shingle_words, bands, band_rows),
            "doc_id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>",
        ),
        "sketches",
    )
    # Empty sets have no class in common.
    keyed = keyed.withColumn("h1", F.when(F.col("n") > 0, F.col("h1")).otherwise(F.col("doc_id")))
    in_classes = keyed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = in_classes.groupBy("n", "h1", "h2").agg(
        F.min("doc_id").alias("set_id"), F.first("keys").alias("keys")
    )
    classes = stored(classes, "classes")
    every = classes.select(F.explode("keys").alias("key"), "set_id", F.col("set_id").alias("component"))
    opened = _open_buckets(every, F.col("set_id"))
    buckets = stored(every.join(opened.select("key"), "key", "left_semi").drop("component"), "buckets")
    sizes = classes.select("set_id", "n")
    wanted = buckets.select("set_id").distinct()
    sets = stored(
        base.withColumnRenamed("doc_id", "set_id")
        .join(wanted, "set_id", "left_semi")
        .mapInArrow(_set_reader(shingle_words), "set_id bigint, elements array<bigint>"),
        "sets",
    )
    total = buckets.count()
    links = labels = None
    for turn in range(star_rounds + 1):
        if labels is None:
            labelled = buckets.withColumn("component", F.col("set_id"))
        else:
            labelled = buckets.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
            labelled = labelled.withColumn("component", F.coalesce("component", "set_id"))
        if turn < star_rounds:
            pairs = stored(_same_size(_star_pairs(labelled, turn, total), sizes, percent), "pairs")
            found = stored(_verified(pairs, sets, percent), "links")
        else:
            found = stored(_remaining_links(labelled, sets, percent), "links")
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            labels = components(links, "first", "second")
    answers = classes.select("n", "h1", "h2", "set_id")
    if labels is not None:
        answers = answers.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select(
            "n", "h1", "h2", F.coalesce("component", "set_id").alias("component_id")
        )
    else:
        answers = answers.withColumnRenamed("set_id", "component_id")
    result = keyed.select("doc_id", "n", "h1", "h2").join(answers, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and rows without a ``doc_id``."""
    removed = found.where(~F.col("kept")).select(F.col("doc_id").alias("__removed")).distinct()
    rows = docs.select(whole_row(docs).alias(ROW), named(docs, "doc_id").alias("id"))
    left = rows.where(F.col("id").isNotNull()).join(removed, F.col("id") == F.col("__removed"), "left_anti")
    order = Window.partitionBy("id").orderBy(F.xxhash64(ROW))
    first = left.withColumn("copy", F.row_number().over(order)).where("copy = 1")
    return unpacked(first.select(ROW).union(rows.where(F.col("id").isNull()).select(ROW)), docs.columns)
