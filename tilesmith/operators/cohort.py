"""Cohorts: event flags, their counts and distribution, sampling from it, register matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilesmith.functions.ids import any_flag, flag, whole_text

EVENTS = ("ESKD", "Death", "Transplant", "Dialysis")


def cohort(raw: DataFrame) -> DataFrame:
    """Names and flags of a raw cohort table: Mors is Death, words are 0, 1 or null, RRT_or_death is added if absent."""
    df = raw.withColumnsRenamed({"Mors": "Death", "Mors_year": "Death_year"})
    words = {"Death": ("Nei", "Ja")}
    df = df.withColumns({e: flag(e, *words.get(e, ("No", "Yes"))) for e in EVENTS if e in df.columns})
    return df if "RRT_or_death" in df.columns else df.withColumn("RRT_or_death", rrt_or_death())


def rrt_or_death() -> Column:
    """1 if death, transplant or dialysis is; kidney failure alone doesn't count."""
    return any_flag("Death", "Transplant", "Dialysis")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each combination, most frequent first; rows with a null in one of the columns don't count."""
    return df.na.drop(subset=columns).groupBy(*columns).count().orderBy(F.desc("count"), *columns)


def value_counts_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) for each of the columns that exists, in one pass."""
    there = [c for c in columns if c in df.columns]
    if not there:
        return df.sparkSession.createDataFrame([], "column string, value int, count bigint")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("int").alias("value")) for c in there)))
    return df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").count()


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Combinations with their share of the rows."""
    counts = value_counts(df, columns)
    whole = df.na.drop(subset=columns).agg(F.count("*")).scalar()
    return counts.select(*columns, (F.col("count") / whole).alias("probability"))


def simulated(shares: DataFrame, columns: list[str], draws: DataFrame) -> DataFrame:
    """Combinations drawn with replacement: draws has u in [0, 1) for each.

    shares has at most 2 ** len(columns) rows of binary flags, so its steps are one small array, found by a scalar subquery.
    """
    w = Window.orderBy(F.desc("probability"), *columns)  # over the combinations, not the rows
    steps = shares.select(*columns, "probability", F.sum("probability").over(w).alias("hi")).select(F.struct("hi", *columns, "probability").alias("s")).agg(F.sort_array(F.collect_list("s")).alias("steps"))
    rows = draws.withColumn("steps", steps.scalar())
    hit = F.coalesce(F.get(F.filter("steps", lambda s: F.col("u") < s["hi"]), F.lit(0)), F.element_at("steps", -1))
    return rows.withColumn("s", hit).select(*(c for c in draws.columns), *(F.col("s")[c].alias(c) for c in columns), F.col("s.probability").alias("probability"))


def random_draws(spark, n: int = 1000, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.rand(seed).alias("u"))


def registers(*parts: DataFrame) -> DataFrame:
    """All registers under one another by name, missing columns null, less what matching doesn't need."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select("patient_fnr")


def matched(patients: DataFrame, register: DataFrame, key: str = "PersNummer", register_key: str = "patient_fnr", keep: tuple[str, ...] = ("PersNummer", "EtterNavn", "ForNavn"), match_nulls: bool = True) -> DataFrame:
    """Distinct kept columns of patients with a row in the register; a null key matches a null one, if asked."""
    p, r = patients, register.select(F.col(register_key).alias("_key"))
    on = p[key].eqNullSafe(r["_key"]) if match_nulls else p[key] == r["_key"]
    return p.join(r, on, "left_semi").select(*keep).dropDuplicates()


def printed_ids(patients: DataFrame, key: str = "PersNummer", width: int | None = None) -> DataFrame:
    return patients.withColumn(key, whole_text(key, width))
