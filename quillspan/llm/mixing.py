"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

A source's target is its share of all words by weight, but at most `most` times
its own words; what that cuts off goes to the other sources by weight. A
document then gets e = min(most, rate * favour) copies on average, where favour
says how much a document is preferred within its source (by default it grows with
the logarithm of its length) and rate is what brings the source to its target:
floor(e) certain copies, and one more with probability p = e - floor(e). The extra
copies are a Pareto sample: documents are ranked by their random odds over their
inclusion odds, q = (u / (1 - u)) / (p / (1 - p)), and taken from the smallest
until the source's words come nearest to its target. u is a hash of doc_id, text
and source, so reruns agree.

Favour is rounded to `LEVELS` steps a factor of e, so that a source's rate follows
from its words by level. The cut in a source is found without sorting the source:
words are summed over `GRID` intervals of q / (1 + q), and only the interval that
holds the cut is ranked; a second, finer grid inside that interval keeps it small
for sources of any size. The sources' table is never collected: ranks come from a
range partitioning, and the capped shares from a few aggregates of one row.

Null text has size 0. A null source is a source of its own, the last. Rows with
null or equal doc_id are rows of their own. Rows that are equal altogether are
numbered (within the parts of the table that they lie in, so that no task holds
them all), and each number has a u of its own: such a group is split where the cut
falls. A source without words has target 0. Very long texts are rows like others.
Tables without rows give no rows. Columns beside doc_id, text and source are kept
by `mixed` as they are, those named mix_... excepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.arrays import sized, written

WEIGHTS, MOST, GRID, LEVELS, SEED = (5.0, 2.0, 1.0), 3, 4096, 32, 17
#: ASCII white space separates words.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of sizes(source, size); weights repeat over the sources in code point order."""
    ranged = written(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    )
    before, counts = 0, {}
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        counts[part], before = before, before + n
    if not counts:
        return ranged.select("source", "source_size", F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + offset[F.col("part")]
    weight = F.array(*map(F.lit, weights))[F.pmod(rank, F.lit(len(weights))).cast("int")]
    ranked = written(ranged.select("source", "source_size", weight.alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, limit = 0.0, F.col("source_size") * float(most)
    while True:  # each round caps at least one more source
        full = limit <= F.col("weight") * level
        rest, share = ranked.agg(F.lit(float(total)) - F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not share or (new := rest / share) <= level * (1 + 1e-12):
            break
        level = new
    return ranked.select("source", "source_size", F.least(limit, F.col("weight") * level).alias("target"))


def _cell(x: Column, low: Column, width: Column) -> Column:
    return F.least(F.floor((x - low) / width * GRID), F.lit(GRID - 1)).cast("int")


def _crossing(sums: DataFrame) -> DataFrame:
    """Per source, the first cell at which the running words reach what is wanted: (source, cell, before)."""
    w = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("after", F.col("taken0") + F.sum("words").over(w)).withColumn("before", F.col("after") - F.col("words"))
    return run.where("after >= target").groupBy("source").agg(F.min_by(F.struct("cell", "before"), "cell").alias("c")).select("source", "c.cell", "c.before")


def _rates(sizes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(source, source_size, target, rate): the rate at which min(most, rate * favour) copies of each row come to the target.

    From the most favoured level on, levels are full as long as the rest's rate
    would fill them as well.
    """
    levels = sizes.groupBy("source", "favour").agg(F.sum("size").alias("words"))
    levels = _same_source(levels, sources, "left").withColumn("weighed", F.col("words") * F.col("favour"))
    w = Window.partitionBy("source").orderBy(F.desc("favour")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = F.sum("words").over(w) - F.col("words")
    rest = F.sum("weighed").over(Window.partitionBy("source")) - F.sum("weighed").over(w) + F.col("weighed")
    rate = F.try_divide(F.greatest(F.col("target") - float(most) * full, F.lit(0.0)), rest)
    fits = levels.withColumn("rate", rate).where(F.col("rate") * F.col("favour") <= float(most) * (1 + 1e-12))
    least = fits.groupBy("source").agg(F.max_by("rate", "favour").alias("rate"))
    known = _same_source(sources, least, "left")
    # Where no level fits all are full; a source without words has no rate.
    return known.withColumn("rate", F.when(F.col("source_size") > 0, F.coalesce("rate", F.lit(float("inf")))).otherwise(0.0))


def _same_source(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined on source, null being equal to null."""
    named = sized(right.withColumnRenamed("source", "mix_own"))
    return left.join(named, left["source"].eqNullSafe(named["mix_own"]), how).drop("mix_own")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs(mix_row, ...) with mix_number, which tells rows of equal mix_row apart."""
    twice = written(docs.groupBy("mix_row").count().where("count > 1").select("mix_row"))
    if twice.isEmpty():
        return docs.withColumn("mix_number", F.lit(0).cast("long"))
    # The part of the table that a row lies in is kept with it: counts of parts, then places within a part.
    again = written(docs.join(sized(twice), "mix_row", "left_semi").withColumn("mix_part", F.spark_partition_id()))
    w = Window.partitionBy("mix_row").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = again.groupBy("mix_row", "mix_part").agg(F.count(F.lit(1)).alias("n")).select("mix_row", "mix_part", (F.sum("n").over(w) - F.col("n")).alias("mix_before"))
    place = F.row_number().over(Window.partitionBy("mix_row", "mix_part").orderBy("mix_size", "source"))
    again = again.withColumn("mix_place", place).join(sized(written(parts)), ["mix_row", "mix_part"])
    again = again.withColumn("mix_number", F.col("mix_before") + F.col("mix_place"))
    once = docs.join(sized(twice), "mix_row", "left_anti").withColumn("mix_number", F.lit(0).cast("long"))
    return once.unionByName(again.select(once.columns))


def default_favour(size: Column) -> Column:
    """Longer documents are preferred, by the logarithm of their length."""
    return F.log2(size + 2.0)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, favour: Column | None = None, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source, ...) with mix_size, mix_source_size, mix_target and mix_copies.

    mix_copies says how often the mix holds the row, 0 to `most`. favour is a
    positive column; a null or other value counts as 1.
    """
    kept = [c for c in docs.columns if not c.startswith("mix_")]
    docs = docs.withColumn("mix_size", word_count(F.col("text")))
    favour = (favour if favour is not None else default_favour(F.col("mix_size"))).cast("double")
    level = F.round(F.log(F.when((favour > 0) & (favour < float("inf")), favour).otherwise(1.0)) * LEVELS)
    docs = docs.withColumn("mix_favour", F.exp(level / LEVELS)).withColumn("mix_row", F.xxhash64("doc_id", "text", "source"))
    docs = _numbered(docs.select(*kept, "mix_size", "mix_favour", "mix_row"))
    u = (F.xxhash64("mix_row", "mix_number", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    narrow = written(docs.select("source", F.col("mix_size").alias("size"), F.col("mix_favour").alias("favour"), u.alias("u")))
    sources = written(_rates(narrow, written(source_targets(narrow, weights, most)), most))

    def expected(rate: str, favour: str, u: Column) -> tuple[Column, Column]:
        """Certain copies and q / (1 + q), which is null where p is 0: such a row is never taken."""
        e = F.coalesce(F.least(F.lit(float(most)), F.col(rate) * F.col(favour)), F.lit(0.0))
        sure = F.floor(e + 1e-12).cast("int")
        p = F.greatest(e - sure, F.lit(0.0))
        q = F.try_divide(u * (1 - p), (1 - u) * p)
        return sure, F.try_divide(q, 1 + q)

    sure, x = expected("rate", "favour", F.col("u"))
    ranked = _same_source(narrow, sources, "left").select("source", "target", "size", sure.alias("sure"), x.alias("x"))
    # A null source cannot be a window or join key of its own without care, so it gets a flag beside it.
    key = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    ranked = ranked.withColumn("source", key)
    base = ranked.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("taken0"), F.first("target").alias("target"))
    cells = ranked.where("x is not null").groupBy("source", _cell(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("cell")).agg(F.sum("size").alias("words"))
    first = written(_crossing(cells.join(sized(base), "source")).join(base.select("source", "target"), "source"))
    inner = ranked.select("source", "size", "x").join(sized(first), "source").where(_cell(F.col("x"), F.lit(0.0), F.lit(1.0)) == F.col("cell"))
    fine = _cell(F.col("x"), F.col("cell") / GRID, F.lit(1.0 / GRID))
    inner = inner.select("source", "size", "x", "target", F.col("before").alias("taken0"), fine.alias("cell"))
    second = _crossing(inner.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("taken0").alias("taken0"), F.first("target").alias("target")))
    last = inner.drop("taken0").join(second, ["source", "cell"])
    w = Window.partitionBy("source").orderBy("x", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = last.withColumn("middle", F.col("before") + F.sum("size").over(w) - F.col("size") / 2)
    none = F.lit(-1.0)
    edge = run.groupBy("source").agg(F.max(F.when(F.col("middle") <= F.col("target"), F.col("x"))).alias("inside"), F.min("x").alias("least"))
    # Nothing of the last interval is taken where its first row already oversteps by more than half: the cut is just below that row.
    edge = edge.select("source", F.coalesce("inside", F.col("least") * (1 - 1e-15)).alias("cut"))
    cuts = written(base.select("source").join(edge, "source", "left").join(first.select("source", F.lit(1).alias("crossed")), "source", "left")
                   .select(F.when(~F.col("source.missing"), F.col("source.name")).alias("source"), F.when(F.col("crossed").isNull(), F.lit(2.0)).otherwise(F.coalesce("cut", none)).alias("cut")))

    known = _same_source(sources, cuts, "left").toDF("source", "mix_source_size", "mix_target", "mix_rate", "mix_cut")
    sure, x = expected("mix_rate", "mix_favour", u)
    extra = F.coalesce((x <= F.col("mix_cut")).cast("int"), F.lit(0))
    return _same_source(docs, known, "left").select(*kept, "mix_size", "mix_source_size", "mix_target", (sure + extra).alias("mix_copies"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs(doc_id, text, source)."""
    out = mixed(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
