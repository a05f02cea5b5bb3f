"""7. Mixing sources to target weights by Pareto order sampling.

Sources share the corpus' words by weight, each at most MOST_COPIES times its own. A source's target is met by as many whole
copies of all its documents as fit (certain), and by a sample for the rest: each document has an inclusion probability in
proportion to size to the power of -TILT (so that a long one rarely is the one at the limit); those that would exceed one are
certain, and the others' are scaled anew until none does. A document's rank is (odds of a random number from its id and
text) / (odds of inclusion), and documents are taken in order of rank until the sample has its fixed size, in words. The gap
before the document that would exceed it is filled by the longest document that fits, and by one more if that comes nearer to the
target: at most two documents of a source are so chosen by size and not by rank. The tests hold the frequencies of all documents
against the intended probabilities.

The limit of each source is found by sums over histograms of the ranks, refined bit by bit, never by sorting a source: all steps
are sums with map-side aggregation over (source, size, random number), so a source of a third of all rows does no harm. Sources stay
a table; only sums over them reach the driver. Their plan is broadcast if they are at most SOURCES_BROADCAST, else joined.

Defined results: null text has size 0; a null source is a source of its own, the last. Documents of size 0 take 0 words; an empty
table gives an empty result. Repeated rows and rows of a null id are told apart by their text, and if that is the same, by
their place in the table; a rerun over the same table gives the same result. Other columns of the input pass through, whatever
their names, except those named as a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm.common import checkpointed, partitions, prefixed, read, restored

#: Weights by the sources' order, repeated.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: The plan of at most so many sources, some 150 bytes each, is broadcast; one of more is joined by source.
SOURCES_BROADCAST = 100_000
TILT = 0.25
SEED = 11
#: Bits of the order that each histogram resolves; a rank has 50, and so has the order of rows of one rank. A source, however
#: large, has 2 ** BITS cells at most, which one task sums up in order.
BITS, LEVELS = 10, 5
_RESULTS = ("size", "source_size", "target", "copies", "taken")


def _small(table: DataFrame, broadcast: bool) -> DataFrame:
    return F.broadcast(table) if broadcast else table


def ordered(sizes: DataFrame, weights: tuple = WEIGHTS) -> tuple[DataFrame, int]:
    """((s, words) with w, the weight by the sources' order by code point, null last; number of sources). No task holds all sources."""
    n = partitions(sizes.sparkSession)
    # UTF-8 keeps the order of code points.
    key = F.struct(F.col("s").isNull().alias("none"), F.encode("s", "utf-8").alias("bytes"))
    placed = checkpointed(sizes.withColumn("key", key).repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()))
    held = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    before, total = [], 0
    for part, count in held:
        before += [F.lit(part), F.lit(total)]
        total += count
    start = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    at = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + start
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(at, F.lit(len(weights))) + 1).cast("int"))
    return checkpointed(placed.withColumn("w", weight.cast("double")).select("s", "words", "w")), total


def targets(sources: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """(s, words, w) with target: all words shared by weight; what a target exceeds `most` times its source is shared among the others.

    Every target is the least of that limit and weight times one level; each round of sums raises the level, until no source passes its limit.
    """
    limit, level = F.col("words") * F.lit(float(most)), 0.0
    while True:
        full = limit < F.col("w") * F.lit(level)
        left = sources.agg(F.sum("words").alias("all"), F.sum(F.when(full, F.col("words"))).alias("used"), F.sum(F.when(~full, F.col("w"))).alias("free")).first()
        if not left["free"]:
            break
        new = (left["all"] - most * (left["used"] or 0)) / left["free"]
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(limit, F.col("w") * F.lit(level)))


def _described(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    """`docs` with __s, __size, __u (its random number, by id and text) and __row (its place, for rows alike in all)."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.xxhash64(text)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    row = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()), 64 - BITS * LEVELS)
    return docs.withColumns({"__s": F.col(source).cast("string"), "__size": size, "__u": u, "__row": row})


def _weight(size: Column) -> Column:
    return F.pow(F.greatest(size, F.lit(1)), F.lit(-TILT))


def _rank(size: Column, u: Column, scale: Column) -> Column:
    """The rank as an integer of BITS * LEVELS bits; -1, before all others, of a document that is certain."""
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), scale * _weight(size)))
    odds = (u / (1 - u)) / (p / (1 - p))
    top = (1 << (BITS * LEVELS)) - 1
    return F.when(scale * _weight(size) >= 1, F.lit(-1)).otherwise(F.least(F.floor(odds / (1 + odds) * F.lit(float(top))), F.lit(top))).cast("long")


def _scales(plan: DataFrame, by_size: DataFrame, small: bool) -> DataFrame:
    """(k, scale): inclusion probabilities are scale * size ** -TILT, at most 1, and their words sum up to rest.

    Small documents are certain first: the scale is that of the shortest prefix, by size, after which no other is.
    """
    own = plan.filter("rest > 0").select(F.col("s").alias("k"), "rest")
    order = Window.partitionBy("k").orderBy("size")
    words = F.col("n") * F.col("size")
    # As many rows of a source as it has sizes.
    rows = by_size.filter("size > 0").join(_small(own, small), F.col("s").eqNullSafe(F.col("k")))
    rows = rows.withColumn("sure", F.sum(words).over(order) - words).withColumn("open", F.sum(words * _weight(F.col("size"))).over(order.orderBy(F.desc("size"))))
    rows = rows.withColumn("scale", (F.col("rest") - F.col("sure")) / F.col("open"))
    return rows.filter(F.col("scale") * _weight(F.col("size")) < 1).groupBy("k").agg(F.min_by("scale", "size").alias("scale"))


def plan_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, bool]:
    """(a row per source of what `mix_sources` needs, whether that is small enough to be broadcast)."""
    rows = checkpointed(_described(docs, text, source, doc_id, seed).select(F.col("__s").alias("s"), F.col("__size").alias("size"), F.col("__u").alias("u"), F.col("__row").alias("row")))
    by_size = checkpointed(rows.groupBy("s", "size").agg(F.count("*").alias("n")))
    sources, count = ordered(by_size.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("words")), weights)
    small = count <= SOURCES_BROADCAST
    whole = F.when(F.col("words") > 0, F.least(F.lit(MOST_COPIES), F.floor(F.col("target") / F.col("words")))).otherwise(0).cast("int")
    rest = F.when((F.col("words") > 0) & (F.col("whole") < MOST_COPIES), F.col("target") - F.col("whole") * F.col("words")).otherwise(0.0)
    plan = targets(sources).withColumn("whole", whole).select("s", F.col("words").alias("source_size"), "target", "whole", rest.alias("rest"))
    plan = checkpointed(plan.join(_small(_scales(plan, by_size, small), small), F.col("s").eqNullSafe(F.col("k")), "left").drop("k"))
    own = plan.filter("scale IS NOT NULL").select(F.col("s").alias("k"), "rest", "scale")
    ranked = rows.filter("size > 0").join(_small(own, small), F.col("s").eqNullSafe(F.col("k"))).select("s", "size", _rank(F.col("size"), F.col("u"), F.col("scale")).alias("rank"), "row")
    # Certain documents come first; then each level finds the cell of the order in which the sample ends.
    sure = ranked.filter("rank < 0").groupBy("s").agg(F.sum("size").alias("sure"))
    cut = own.join(_small(sure, small), F.col("k").eqNullSafe(F.col("s")), "left")
    zero = F.lit(0).cast("long")
    cut = cut.select("k", zero.alias("at"), zero.alias("at_row"), F.coalesce("sure", zero).alias("below"), F.col("rest").alias("want"))
    for column, fixed in (("rank", "at"), ("row", "at_row")):
        for level in reversed(range(LEVELS)):
            inside = F.col("s").eqNullSafe(F.col("k")) & (F.shiftright(column, (level + 1) * BITS) == F.col(fixed))
            if column == "row":
                inside &= F.col("rank") == F.col("at")
            cells = ranked.filter("rank >= 0").join(_small(cut, small), inside).groupBy("k", F.shiftright(column, level * BITS).alias("cell"))
            hist = cells.agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("at", "at_row", "below", "want")), F.count("*").alias("n"))
            # At most 2 ** BITS cells of a source.
            upto = F.col("below") + F.sum("words").over(Window.partitionBy("k").orderBy("cell"))
            found = F.min(F.struct("cell", "at", "at_row", (F.col("upto") - F.col("words")).alias("below"), "want", "n")).alias("c")
            cut = hist.withColumn("upto", upto).filter("upto > want").groupBy("k").agg(found).select("k", "c.*")
            cut = checkpointed(cut.withColumn(fixed, F.col("cell")).drop("cell"))
        # Rows of one rank are ordered by their place, where there are such.
        if not cut.filter("n > 1").limit(1).count():
            break
    cut = cut.select("k", "at", "at_row", (F.col("want") - F.col("below")).alias("gap"))
    # As many rows of a source as it has sizes: the first of each that the sample leaves.
    left = ranked.join(_small(cut, small), F.col("s").eqNullSafe(F.col("k"))).filter(~_before(F.col("rank"), F.col("row"), F.col("at"), F.col("at_row")))
    left = checkpointed(left.groupBy("k", "size").agg(F.first("gap").alias("gap"), F.min(F.struct("rank", "row")).alias("fit")))
    longest = left.filter("size <= gap").groupBy("k").agg(F.max("size").alias("size"), F.max_by("fit", "size").alias("fit")).toDF("l", "size1", "fit1")
    more = left.join(_small(longest, small), F.col("k").eqNullSafe(F.col("l")), "left").withColumn("gap", F.col("gap") - F.coalesce("size1", F.lit(0)))
    nearer = more.filter("NOT size <=> size1 AND size < 2 * gap").groupBy("k").agg(F.min_by("fit", F.struct(F.abs(F.col("gap") - F.col("size")), "size")).alias("fit2"))
    for table, key in ((cut.drop("gap"), "k"), (longest.drop("size1"), "l"), (nearer, "k")):
        plan = plan.join(_small(table, small), F.col("s").eqNullSafe(F.col(key)), "left").drop(key)
    return checkpointed(plan.select("s", "source_size", "target", "whole", "scale", "at", "at_row", F.array_compact(F.array("fit1", "fit2")).alias("fits"))), small


def _before(rank: Column, row: Column, at: Column, at_row: Column) -> Column:
    return (rank < at) | (rank == at) & (row < at_row)


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The columns of `docs` with size, source_size, target, copies and taken. One pass with the sources' plan at hand: no text is shuffled or kept."""
    plan, small = plan_mix(docs, text, source, doc_id, weights, seed)
    plan = plan.select(F.struct(*plan.columns).alias("__plan"))
    rows = _described(prefixed(docs), *(f"__in_{c}" for c in (text, source, doc_id)), seed)
    rows = rows.join(_small(plan, small), F.col("__s").eqNullSafe(F.col("__plan.s")), "left")
    p = F.col("__plan")
    rank = _rank(F.col("__size"), F.col("__u"), p["scale"])
    fits = F.exists(p["fits"], lambda f: (f["rank"] == rank) & (f["row"] == F.col("__row")))
    more = F.coalesce(_before(rank, F.col("__row"), p["at"], p["at_row"]), F.lit(False)) | fits
    copies = (p["whole"] + F.when((F.col("__size") > 0) & more, 1).otherwise(0)).cast("int")
    results = (F.col("__size"), p["source_size"], p["target"], copies, (copies * F.col("__size")).cast("long"))
    return restored(rows.withColumns({f"__out_{name}": c for c, name in zip(results, _RESULTS, strict=True)}), docs, _RESULTS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none included. Documents without words (null text too) are taken by whole
    copies of their source only; repeated rows are documents of their own; extra columns go along, whatever their names."""
    counted = mix_sources(prefixed(docs), "__in_text", "__in_source", "__in_doc_id")
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return counted.filter("copies > 0").withColumn("__copy", times).select(*(F.col(f"__in_{c}").alias(c) for c in docs.columns))
