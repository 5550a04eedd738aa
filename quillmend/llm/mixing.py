"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight; one that would be repeated more often than the maximum
number of epochs is clamped there and its excess goes to the others in proportion to their weights,
until no source is above its cap. A source's epochs are then whole repetitions of all its documents
plus a seeded sample of its documents for the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = 20
#: A table of source totals with at most this many rows is broadcast.
BROADCAST_SOURCES = 10_000
#: About so many documents of the largest source fall in one of the buckets of its order.
ROWS_PER_BUCKET = 4096


def word_count(text: str) -> Column:
    """Words of the text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("bigint")


def water_level(sources: DataFrame, budget: float) -> float:
    """The level at which sum(least(cap, level * weight)) is the budget.

    sources: columns weight (positive) and cap. Each round clamps the sources that are at their cap at
    the present level and shares what is left among the rest; the level only rises, so it ends. The
    driver gets two sums a round. Infinite if all caps together are within the budget.
    """
    level = -1.0
    while True:
        clamped = F.col("cap") <= F.col("weight") * level
        r = sources.agg(F.sum(F.when(clamped, F.col("cap"))).alias("held"), F.sum(F.when(~clamped, F.col("weight"))).alias("open")).first()
        if not r.open:
            return float("inf")
        now = (budget - float(r.held or 0)) / float(r.open)
        if now <= level * (1 + 1e-12):
            return max(level, 0.0)
        level = now


def targets(totals: DataFrame, source: str, total: str, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``totals`` (a row a source) with ``target``: weights go in turn to the sources by code point, null last.

    ``budget`` is a multiple of all words. Sources without words get 0.
    """
    listed = common.placed(totals.withColumn("__null", F.col(source).isNull()), "__null", source)  # one row a source, but these may be many
    turn = F.col("place") % len(weights)
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col(total) * max_epochs).drop("__null", "place")
    listed = common.staged(listed, "sources")
    everything = float(listed.agg(F.sum(total)).first()[0] or 0)
    level = water_level(listed, budget * everything)
    return listed.withColumn("target", F.least(F.col("cap").cast("double"), F.when(F.col("cap") > 0, F.lit(level) * F.col("weight")).otherwise(0.0)))


def mix(df: DataFrame, source: str, size: str, key: str, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``df`` with ``source_size``, ``target`` and ``repeats`` (how many times the mix takes the row).

    source: a column (null is a source too); size, key: names of bigint and id columns. A row is taken
    floor(epochs) times, and once more if it comes early enough in its source's seeded order: the
    rows up to the one at which the fraction is nearest. So a source's words differ from its target by
    half of one row's size at most. Rows with equal key (a null one, say) and size have one place in the order;
    where the fraction ends among them, the right number is taken, by a hash of the whole row. Rows of
    size 0 follow their order like others. An empty table gives an empty result. Reruns agree: the order is
    a hash of seed and key.

    No source is gathered in one task: order buckets are summed first, only the one bucket of each source in which
    the fraction ends is ranked, a row for each place, and the rows of the last place are numbered by
    ranges. Input columns named like the added ones give way to them.
    """
    inner, at = common.shielded(df)
    out = _mix(inner, at[source], at[size], at[key], weights, budget, max_epochs, seed)
    return common.restored(out, df.columns, "source_size", "target", "repeats")


def _mix(df: DataFrame, source: str, size: str, key: str, weights: tuple[float, ...], budget: float, max_epochs: float, seed: int) -> DataFrame:
    s, b, h = (common.fresh(df, x) for x in ("source", "bucket", "hash"))
    hashed = df.withColumn(h, common.hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    sums = common.staged(hashed.groupBy(F.col(source).alias(s)).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("__n")), "totals")
    largest = sums.agg(F.max("__n"), F.count(F.lit(1))).first()
    bits = max(6, min(20, ((largest[0] or 1) // ROWS_PER_BUCKET).bit_length() + 6))
    plan = targets(sums, s, "source_size", weights, budget, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("__whole", F.floor(epochs + 1e-12)).withColumn("__part", F.greatest(F.lit(0.0), F.col("target") - F.col("__whole") * F.col("source_size")))
    plan = plan.select(s, "source_size", "target", "__whole", "__part")
    small = (lambda x: F.broadcast(x)) if largest[1] <= BROADCAST_SOURCES else (lambda x: x)
    hashed = hashed.withColumn(b, F.shiftright(h, 60 - bits))

    buckets = hashed.groupBy(F.col(source).alias("__o"), b).agg(F.sum(size).alias("__sum"))
    run = Window.partitionBy("__o").orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("__before", F.sum("__sum").over(run) - F.col("__sum"))
    edge = buckets.join(small(plan), F.col("__o").eqNullSafe(F.col(s)))
    # the bucket in which the part ends: what comes before is taken, what comes after is not
    edge = edge.filter((F.col("__before") < F.col("__part")) & (F.col("__part") <= F.col("__before") + F.col("__sum")))
    edge = common.staged(edge.select(F.col(s), F.col(b).alias("__edge"), "__before", "__part"), "edges")  # a row a source at most

    inside = hashed.select(F.col(source).alias("__s"), F.col(b).alias("__b"), F.col(h).alias("__h"), F.col(key).alias("__k"), F.col(size).alias("__size"))
    inside = inside.join(small(edge), F.col("__s").eqNullSafe(F.col(s)) & (F.col("__b") == F.col("__edge")))
    # a row for each place, so a key that many rows share is one row here
    inside = inside.groupBy("__s", "__h", "__k", "__size", "__before", "__part").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy("__s").orderBy("__h", "__k", "__size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("__before") + F.sum(F.col("__n") * F.col("__size")).over(order) - F.col("__n") * F.col("__size")
    inside = inside.withColumn("__start", start).filter(F.col("__start") + F.col("__size") / 2 < F.col("__part"))
    # of the order's last place of which rows are taken, how many: those whose middle comes before the part's end
    count = F.when(F.col("__size") > 0, F.ceil((F.col("__part") - F.col("__start")) / F.col("__size") + 0.5) - 1).otherwise(F.col("__n"))
    place = ["__h", "__k", "__size"]
    last = inside.groupBy("__s").agg(F.max(F.struct(*place, F.least(count, "__n").alias("__count"), "__n")).alias("__last"))
    edge = edge.join(last, F.col(s).eqNullSafe(F.col("__s")), "left").select(F.col(s), "__edge", "__last")
    plan = plan.join(edge.withColumnRenamed(s, "__e"), F.col(s).eqNullSafe(F.col("__e")), "left").drop("__e")
    plan = common.staged(plan, "plan")

    joined = hashed.join(small(plan), F.col(source).eqNullSafe(F.col(s)))
    own, end = F.struct(F.col(h).alias("__h"), F.col(key).alias("__k"), F.col(size).alias("__size")), F.struct(*[F.col("__last")[c].alias(c) for c in place])
    at_edge = (F.col("__part") > 0) & F.col("__last").isNotNull() & (F.col(b) == F.col("__edge"))
    tied = F.coalesce(at_edge & own.eqNullSafe(end) & (F.col("__last.__count") < F.col("__last.__n")), F.lit(False))
    extra = (F.col("__part") > 0) & ((F.col(b) < F.col("__edge")) | ((F.col(b) == F.col("__edge")) & (own <= end)))
    repeats = lambda more: (F.col("__whole") + F.when(more, 1).otherwise(0)).cast("int").alias("repeats")
    out = joined.filter(~tied).select(*df.columns, "source_size", "target", repeats(extra))
    among = joined.filter(tied)
    if among.isEmpty():
        return out
    # equal rows are interchangeable, so their numbers may be any
    among = among.withColumns({"__tie": F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]), "__any": F.monotonically_increasing_id()})
    among = common.placed(among, s, "__tie", "__any")
    first = among.groupBy(F.col(s).alias("__f")).agg(F.min("place").alias("__first"))
    among = among.join(small(first), F.col(s).eqNullSafe(F.col("__f")))
    return out.unionByName(among.select(*df.columns, "source_size", "target", repeats(F.col("place") - F.col("__first") < F.col("__last.__count"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes from it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    out = mix(common.staged(docs, "sizes"), "source", "size", "doc_id")
    return out.select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * F.col("repeats")).cast("bigint").alias("taken"))


#: The same by SQL: the level of the water is found among the caps (in the order of cap by weight, the
#: sources before a place are clamped and the rest share what is left).
ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM t
), r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         1.5 * sum(source_size) OVER () AS budget
  FROM w
), l AS (SELECT min_by((budget - held) / open, cap / weight) FILTER (WHERE (budget - held) / open <= cap / weight) AS level FROM r
), g AS (
  SELECT source, source_size, least(cap, level * weight) AS target FROM w, l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM g
), o AS (
  SELECT d.*, e.source_size, e.target, e.whole, greatest(0, e.target - e.whole * e.source_size) AS part,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN upto - size / 2.0 < part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
