"""Mixing sources to target weights, in DataFrame functions only.

Sizes (words) are summed per source, every source gets a target, and rate = target / size of its source. A
document is emitted floor(rate) times, plus one more copy when a uniform number drawn from a hash of its id and
the seed is below the fraction of the rate: the same on every rerun, on any partitioning.

Defined results: null text has size 0; a null source is a source of its own, sorted last; rows that share an id
share their draw; an empty table gives an empty mix; a source without words has target 0 and rate 0; ties in a
source's name can't be, as a name is one source; own columns called like the mix's keep their values in `emitted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import textops as tx

SEED = 17
WEIGHTS = (1, 2, 3)
CEILING = 3


def words(text: str | Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(tx.WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """In [0, 1), from 52 bits of an MD5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Per source: source, source_size, target. `sizes` has one row per source.

    Resharing the excess by weight until no source is above its ceiling is water-filling: target = min(level *
    weight, ceiling * size), where the level follows from running sums over the sources in the order in which
    they reach their ceilings. Input is one row per source, so the ordering windows hold few rows.
    """
    whole = Window.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(ceiling)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("cap_before", F.sum("cap").over(order) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.sum("weight").over(order) + F.col("weight"))
        # the level that would hold if this source and all after it were below their ceilings
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("shared", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(whole)["level"])
    )
    target = F.when(F.col("shared").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("shared") * F.col("weight")))
    return filled.select("source", "source_size", target.alias("target"))


NEW = ("size", "source_size", "target", "rate", "copies")


def _mixed(docs: DataFrame, weights: tuple[int, ...], ceiling: int, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the columns `NEW` under names that none of its own has, and these names."""
    name = {c: tx.fresh(docs, c) for c in NEW}
    sized = docs.withColumn(name["size"], words("text"))
    sizes = sized.groupBy("source").agg(F.sum(name["size"]).alias("source_size"))
    plan = targets(sizes, weights, ceiling).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.select(F.struct("source", "source_size", "target", "rate").alias(tx.fresh(docs, "plan")))
    of = lambda x: plan[plan.columns[0]][x]
    both = sized.join(plan, sized["source"].eqNullSafe(of("source")), "left")
    whole = F.floor(of("rate"))
    copies = (whole + (uniform(sized["doc_id"], seed) < of("rate") - whole).cast("int")).cast("int")
    made = {"size": sized[name["size"]], "source_size": of("source_size"), "target": of("target"), "rate": of("rate"), "copies": copies}
    return both.select(*(sized[c] for c in docs.columns), *(x.alias(name[c]) for c, x in made.items())), name


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, text, source, ...) with size, source_size, target, rate and copies, in place of own columns of these names."""
    mixed, name = _mixed(docs, weights, ceiling, seed)
    return mixed.select(*(mixed[c] for c in docs.columns if c.lower() not in NEW), *(mixed[name[c]].alias(c) for c in NEW))


def emitted(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of `docs`."""
    mixed, name = _mixed(docs, weights, ceiling, seed)
    copy = tx.fresh(mixed, "copy")
    return mixed.filter(mixed[name["copies"]] > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(name["copies"])))).select(*tx.own(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tx.documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIX_SQL = r"""
sized AS (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes),
weighed AS (SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM ranked),
levels AS (SELECT *, (total - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)),
shared AS (SELECT arg_min(level, (cap / weight, place)) AS s FROM levels WHERE level * weight <= cap),
plan AS (SELECT source, source_size, CASE WHEN s IS NULL THEN cap ELSE least(cap, s * weight) END AS target FROM levels, shared),
mixed AS (SELECT d.*, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
taken AS (SELECT *, CAST(floor(rate) AS INT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM mixed)
"""
SQL = "WITH " + MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM taken"
