"""Mixing sources to target weights, with DataFrame functions only.

Each source gets a target number of words.  Within a source, rows are ordered by a
hash-random key; whole epochs are taken while they fit and the last one is cut at the
exact word where the budget ends.

Scale.  The plan reads texts once: everything after works on (id, source, size, key), written
to the shared folder.  No source is ever sorted as one group.  Its key range is split in
``BUCKETS`` parts whose sums are prefix-summed (at most ``BUCKETS`` rows for a source); only the one
part that holds the cut is ordered, by its distinct (key, size).  The outcome is one row a source:
where the cut lies.  Any row finds its share from that row and its own key, so the mix itself moves
no text.  A source with a third of all rows costs the same as many small ones.  Up to
``BROADCAST_SOURCES`` sources (counted before) the rows of the sources are one window and broadcast;
beyond that they are range-sorted, summed partition by partition, and joined by shuffle.

Defined results.  A null text has size 0; a very long one is a row like others.  A null source is a
source of its own, last in order; a null id gets a key from its text; rows equal in id and size are
interchangeable, so of repeated rows any may stand for the others.  An empty table gives an empty
result.  Other columns of the input are ignored by the plan and pass through the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Parts of each source's key range: the first three hexadecimal digits of the key.
KEY_DIGITS = 3
BUCKETS = 16**KEY_DIGITS
#: The per-source table is one window, and broadcast, only up to this many sources (counted before).
BROADCAST_SOURCES = 20_000


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Hash-random order of rows, the same in each run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch | None, name: str) -> DataFrame:
    """Adds, for each of ``sums``, its total over all rows that come before in ``order``.

    Without a scratch folder in one window; with one in as many as there are partitions: rows are
    range-sorted, and each partition starts from the totals of those before it.
    """
    if scratch is None:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({k: F.coalesce(F.sum(v).over(before), F.lit(0)) for k, v in sums.items()})
    placed = scratch.write(rows.repartitionByRange(*order).withColumn("_place", F.spark_partition_id()), name)
    before = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = placed.groupBy("_place").agg(*[F.sum(v).alias(f"_t{k}") for k, v in sums.items()])
    totals = totals.select(F.col("_place").alias("_p"), *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_t{k}") for k in sums])
    within = Window.partitionBy("_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(totals), F.col("_place") == F.col("_p"))
    return joined.withColumns({k: F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"_t{k}") for k, v in sums.items()}).drop("_place", "_p", *[f"_t{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float, scratch: Scratch | None = None) -> DataFrame:
    """(source, source_size) -> target: weights by code point order, nulls last, filled like water.

    With sources sorted by cap/weight, level k assumes that all before k stand at their cap;
    the largest level is the one at which nothing is left above its cap.
    """
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"_rank": F.lit(1).cast("long")}, scratch, "sources-by-name")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", pick).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    if scratch is not None:
        capped = scratch.write(capped, "sources")
    order = [F.col("_cap") / F.col("weight"), F.col("_rank")]
    filled = running(capped, order, {"_below": F.col("_cap"), "_spent": F.col("weight")}, scratch, "sources-by-level")
    whole = capped.agg((F.lit(share) * F.sum("source_size")).alias("_total"), F.sum("weight").alias("_weights"))
    level = filled.join(F.broadcast(whole)).agg(F.max((F.col("_total") - F.col("_below")) / (F.col("_weights") - F.col("_spent"))).alias("_level"))  # one row each
    return capped.join(F.broadcast(level)).select("source", "source_size", "weight", F.least(F.col("_cap"), F.col("_level") * F.col("weight")).cast("double").alias("target"))


def _sized(docs: DataFrame, seed: str) -> list[Column]:
    return [word_count(docs["text"]).alias("__size"), random_key(docs["doc_id"], docs["text"], seed).alias("__key")]


def source_plan(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float, t: Scratch) -> DataFrame:
    """(doc_id, source, size, mix_key) -> a row for each source: where its budget ends.

    _s (source), source_size, target, _full (whole epochs); the last epoch takes what comes before
    (_cut_key, _cut_size), and of the _cut_count rows that stand there _cut_whole whole ones and
    _cut_words words of one more.  No cut: _cut_key is null and the last epoch is empty.
    """
    part = F.substring("mix_key", 1, KEY_DIGITS)
    parts = rows.groupBy("source", part.alias("_part")).agg(F.sum("size").alias("_words"))
    # the parts are at most BUCKETS for each source, whatever the number of rows
    upto = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = t.write(parts.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0).cast("long"))), "parts")
    sizes = t.write(parts.groupBy("source").agg(F.sum("_words").alias("source_size")), "source-sizes")
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda x: x

    targets = source_targets(sizes, weights, share, cap, None if few else t)
    targets = targets.withColumn("_full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = t.write(targets.withColumn("_rest", F.floor(F.col("target") - F.col("_full") * F.col("source_size")).cast("long")), "targets")
    cut = parts.alias("p").join(small(targets.alias("t")), F.col("p.source").eqNullSafe(F.col("t.source")))
    cut = cut.where((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_words")))
    cut = t.write(cut.select(F.col("t.source").alias("_cs"), F.col("_part").alias("_cut_part"), (F.col("_rest") - F.col("_before")).alias("_left")), "cuts")

    # rows equal in key and size are one: they are copies, and together in order
    inside = rows.join(small(cut), F.col("source").eqNullSafe(F.col("_cs")) & (part == F.col("_cut_part")))
    inside = inside.groupBy(F.col("source").alias("_cs"), "mix_key", "size", "_left").agg(F.count("*").alias("_count"))
    order = Window.partitionBy("_cs").orderBy("mix_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.col("size") * F.col("_count")).over(order), F.lit(0).cast("long"))
    inside = inside.withColumn("_left", F.col("_left") - ahead).where((F.col("_left") > 0) & (F.col("_left") <= F.col("size") * F.col("_count")))
    whole = F.floor(F.col("_left") / F.col("size")).cast("long")
    inside = inside.select("_cs", F.col("mix_key").alias("_cut_key"), F.col("size").alias("_cut_size"), F.col("_count").alias("_cut_count"), whole.alias("_cut_whole"), (F.col("_left") - whole * F.col("size")).alias("_cut_words"))
    plan = targets.join(small(inside), F.col("source").eqNullSafe(F.col("_cs")), "left").select(F.col("source").alias("_s"), "source_size", "target", "_full", *inside.columns[1:])
    plan = t.write(plan, "plan")
    t.drop("parts", "source-sizes", "sources-by-name", "sources", "sources-by-level", "targets", "cuts")
    return small(plan)


def _at_cut(key: Column, size: Column) -> Column:
    return (key == F.col("_cut_key")) & (size == F.col("_cut_size"))


def _before_cut(key: Column, size: Column) -> Column:
    return F.coalesce((size > 0) & ((key < F.col("_cut_key")) | ((key == F.col("_cut_key")) & (size < F.col("_cut_size")))), F.lit(False))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """One row per document: doc_id, source, size, mix_key, source_size, target, taken, epochs, cut.

    ``taken`` counts words, repeats included; ``epochs`` how often the document is taken whole;
    ``cut`` how many words of one more pass are taken (0 unless the budget ends inside it).
    """
    t = Scratch(docs.sparkSession, "mix")
    size, key = _sized(docs, seed)
    rows = t.write(docs.select("doc_id", "source", size.alias("size"), key.alias("mix_key")), "sizes")
    plan = source_plan(rows, weights, share, cap, t)
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left")
    split = F.coalesce(_at_cut(F.col("mix_key"), F.col("size")), F.lit(False))
    out = ["doc_id", "source", "size", "mix_key", "source_size", "target", "_full"]
    alike = placed.where(~split).select(*out, F.when(_before_cut(F.col("mix_key"), F.col("size")), F.col("size")).otherwise(F.lit(0).cast("long")).alias("_more"))
    # the copies at the cut: so many whole ones, one in part, the others not at all
    again = placed.where(split).groupBy(*out, "_cut_count", "_cut_whole", "_cut_words").agg(F.count("*").alias("_n"))
    share_of = [(F.col("size"), F.col("_cut_whole")), (F.col("_cut_words"), F.when(F.col("_cut_words") > 0, 1).otherwise(0).cast("long"))]
    share_of.append((F.lit(0).cast("long"), F.col("_n") - share_of[0][1] - share_of[1][1]))
    shares = F.filter(F.array(*[F.struct(w.alias("w"), n.alias("n")) for w, n in share_of]), lambda x: x["n"] > 0)
    again = again.select(*out, F.explode(shares).alias("_x")).select(*out, F.col("_x.w").alias("_more"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_x.n")))).drop("col")
    whole = (F.col("_more") == F.col("size")) & (F.col("size") > 0)
    return alike.unionByName(again).select(
        *out[:-1],
        (F.col("_full") * F.col("size") + F.col("_more")).alias("taken"),
        (F.col("_full") + F.when(whole, 1).otherwise(0)).cast("long").alias("epochs"),
        F.when(whole, F.lit(0).cast("long")).otherwise(F.col("_more")).alias("cut"),
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the plan takes it, columns unchanged.

    Texts stay whole and where they are.  The one document of a source that the budget cuts is taken
    when at least half of it fits, so each source ends within half a document of its target.  Rows
    without words carry nothing towards a target and stay once.  Where the cut falls among copies, one
    of them gives the last epoch's share of all.
    """
    t = Scratch(docs.sparkSession, "mix")
    size, key = _sized(docs, seed)
    rows = t.write(docs.select("doc_id", "source", size.alias("size"), key.alias("mix_key")), "sizes")
    plan = source_plan(rows, weights, share, cap, t)
    t.drop("sizes")
    columns = docs.columns
    keyed = docs.select(*[docs[c] for c in columns], docs["source"].alias("__source"), size, key)
    placed = keyed.join(plan, F.col("__source").eqNullSafe(F.col("_s")), "left")
    here = F.coalesce(_at_cut(F.col("__key"), F.col("__size")), F.lit(False))
    extra = (F.col("_cut_whole") + F.when(2 * F.col("_cut_words") >= F.col("_cut_size"), 1).otherwise(0)).cast("int")
    last = F.when(here, F.when(F.col("_cut_count") == 1, extra).otherwise(0)).otherwise(_before_cut(F.col("__key"), F.col("__size")).cast("int"))
    copies = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.col("_full").cast("int") + last)
    taken = _repeat(placed, columns, copies)
    if plan.where((F.col("_cut_count") > 1) & (extra > 0)).isEmpty():
        return taken
    among = placed.where(here & (F.col("_cut_count") > 1)).groupBy("__key", "__size", F.col("_s").alias("__at"), extra.alias("__extra"))
    one = among.agg(F.first(F.struct(*columns)).alias("__row")).select(*[F.col("__row")[c].alias(c) for c in columns], "__extra")
    return taken.unionByName(_repeat(one, columns, F.col("__extra")))


def _repeat(rows: DataFrame, columns: list[str], copies: Column) -> DataFrame:
    """Each row so often."""
    times = F.when(copies > 0, F.sequence(F.lit(1), copies))
    return rows.withColumn("__copy", F.explode(times)).select(*columns)
