"""Cohort sizes counted in a population, in place of assumed selectivities.

:mod:`residual` multiplies fixed selectivities, as if attributes were independent.  Where the
population itself is a table, how many people share a combination is a count, and what has to be
withheld for a record to be one of enough people is a look-up.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 8  # attributes at most: a record is tried with each subset of them


def cohort_sizes(population: DataFrame, attributes: Sequence[str], least: int | None = None) -> DataFrame:
    """``attributes, level, n``: people of every combination, of each subset of the attributes.

    One ``cube``: counts combine before they move, and a combination is a row however many people
    have it.  ``level`` has a bit per attribute, the first one highest, set where the attribute
    is left out (and null).  A null attribute of a person is a value of its own, told from one left out by
    ``level``.  With ``least``, a count below it is null, as it must not be published.
    """
    if not 0 < len(attributes) <= MOST:
        raise ValueError(f"1 to {MOST} attributes")
    n = F.count(F.lit(1)).cast("long")
    out = population.cube(*attributes).agg(F.grouping_id().cast("long").alias("level"), n.alias("n"))
    return out.withColumn("n", F.when(F.col("n") >= least, F.col("n"))) if least else out


def selectivities(population: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``attribute, value, n, selectivity``: how many times a single value narrows the population."""
    sizes = cohort_sizes(population, attributes)
    total = sizes.where(F.col("level") == (1 << len(attributes)) - 1).agg(F.max("n")).first()[0]
    one = [(1 << len(attributes)) - 1 - (1 << (len(attributes) - 1 - i)) for i in range(len(attributes))]
    each = F.array(*[F.struct(F.lit(level).cast("long").alias("l"), F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for level, a in zip(one, attributes, strict=True)])
    rows = sizes.select("level", "n", F.explode(each).alias("e")).where(F.col("level") == F.col("e.l"))
    return rows.select("e.attribute", "e.value", "n", (F.lit(float(total or 0)) / F.col("n")).alias("selectivity"))


def release(records: DataFrame, id_col: str, population: DataFrame, attributes: Sequence[str], least: int) -> DataFrame:
    """For each record the fewest attributes to withhold so that at least ``least`` people of the
    population share the rest: ``id_col, action, withheld, cohort, own_cohort``.

    Every subset of a record's attributes is tried (2**m rows of a record, m at most MOST) by one
    join with the cube.  Of equally small sets that suffice the one whose rest most people share
    counts, then the lower level.  ``action`` is pass (nothing withheld), generalise, or suppress
    where even all attributes withheld leave too few (a population below ``least``); ``cohort``
    is the people who share what is released, ``own_cohort`` those who share everything (null
    if none: the record is of no one there).  A null attribute counts as a value; rows that
    repeat an id are records of their own, told apart by their attributes.
    """
    m = len(attributes)
    sizes = cohort_sizes(population, attributes)
    levels = [sum(1 << (m - 1 - i) for i in gone) for k in range(m + 1) for gone in combinations(range(m), k)]
    each = F.explode(F.array(*[F.lit(x).cast("long") for x in levels]))
    tried = records.select(id_col, *attributes).distinct().select(F.struct(F.col(id_col), *attributes).alias("_r"), each.alias("_level"))
    values = [F.when(F.col("_level").bitwiseAND(1 << (m - 1 - i)) == 0, F.col(f"_r.{a}")).alias(f"_v{i}") for i, a in enumerate(attributes)]
    tried = tried.select("_r", "_level", *values)
    on = F.col("_level") == F.col("level")
    for i, a in enumerate(attributes):
        on = on & F.col(f"_v{i}").eqNullSafe(F.col(a))
    found = tried.join(sizes, on)
    enough = F.struct(F.bit_count("_level").alias("k"), (-F.col("n")).alias("n"), F.col("_level").alias("level"))
    best = found.groupBy("_r").agg(F.min(F.when(F.col("n") >= least, enough)).alias("b"), F.max(F.when(F.col("_level") == 0, F.col("n"))).alias("own_cohort"))
    gone = F.filter(F.array(*[F.when(F.col("b.level").bitwiseAND(1 << (m - 1 - i)) != 0, F.lit(a)) for i, a in enumerate(attributes)]), lambda x: x.isNotNull())
    all_of = F.array(*map(F.lit, attributes))
    action = F.when(F.col("b").isNull(), "suppress").when(F.col("b.k") == 0, "pass").otherwise("generalise")
    return best.select(F.col(f"_r.{id_col}").alias(id_col), action.alias("action"), F.when(F.col("b").isNull(), all_of).otherwise(gone).alias("withheld"), (-F.col("b.n")).alias("cohort"), "own_cohort")
