"""Burden inputs derived from an order-processing star schema.

Line items play the part of burden records: the customer's nation is the
place, the part type decides the causes, and quantities and prices give the
measures with their uncertainty bounds. The shipping year and a class of the
customer give the slices (year, sex). One pass over the line items yields the
cells (nation x sex x year x part type x size class x status), a number that does
not grow with the data; every input table of the analysis follows from these
cells and the dimension tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codes
from ..functions.exact import exact_sum
from ..functions.reshape import literal_table, lookup
from ..runtime import stage

# Causes a part type counts towards, beside all causes (fixed mapping).
TYPE_CAUSES = {
    "STANDARD": (558, 409),
    "SMALL": (543, 409),
    "LARGE": (630, 409),
    "PROMO": (639, 409),
    "ECONOMY": (409,),
    "MEDIUM": (687,),
}
SMALL_MEDIUM_CAUSE = 718
CAUSE_NAMES = {
    294: "All causes",
    409: "Non-communicable diseases",
    558: "Mental disorders",
    543: "Alzheimer's disease and other dementias",
    630: "Low back pain",
    639: "Other musculoskeletal disorders",
    687: "Injuries",
    718: "Self-harm",
}
PEOPLE_PER_CUSTOMER = 10_000.0
SEX_NAMES = {1: "Male", 2: "Female"}
# Slices the extract has; age is one class.
SLICES = ("sex_id", "year")
SEX = "CAST(1 + c_custkey % 2 AS INT) AS sex_id"
SOUTH_SUDAN_NATION = 5
UNMAPPED_NATION = 24


def _iso(nation: str) -> Column:
    return F.expr(
        f"CASE WHEN {nation} = {SOUTH_SUDAN_NATION} THEN 'SSD' ELSE concat('N', lpad({nation}, 2, '0')) END"
    )


def _with_world(nation: str, *keep: str):
    """Columns that repeat a nation's row for the world."""
    return [F.explode(F.array(F.col(nation) + 2, F.lit(codes.WORLD_LOCATION))).alias("location_id"), *keep]


# Columns of the source tables that are read; the rest is never touched.
SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate date",
    "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date",
    "customer": "c_custkey long, c_nationkey int",
    "part": "p_partkey long, p_type string, p_size int",
    "supplier": "s_suppkey long, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


@dataclass(frozen=True)
class OrderTables:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        """The columns of ``SCHEMAS``, by name; the scan reads no others."""
        columns = [c.split() for c in SCHEMAS[name].split(",")]
        stored = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return stored.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])

    @cached_property
    def order_places(self) -> DataFrame:
        """(o_orderkey, o_totalprice, nation, sex_id, year) of every order."""
        orders = self.table("orders").selectExpr("o_orderkey", "o_custkey", "o_totalprice", "year(o_orderdate) AS year")
        customers = self.table("customer").selectExpr("c_custkey", "c_nationkey AS nation", SEX)
        joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return joined.select("o_orderkey", "o_totalprice", "nation", "sex_id", "year")

    @property
    def cell_query(self) -> DataFrame:
        """Exact sums per nation, slice, part type, size class and line status."""
        part = self.table("part").select("p_partkey", "p_type", (F.col("p_size") <= 10).alias("small"))
        line = self.table("lineitem")
        amounts = {"q": "l_quantity", "p": "l_extendedprice", "n": "CAST(l_linenumber = 1 AS DOUBLE)"}
        factors = {"val": "1D", "upper": "(1D + l_tax)", "lower": "(1D - l_discount)"}
        sums = [
            exact_sum(f"{x} * {factors[bound]}").alias(f"{stem}_{bound}")
            for stem, x in amounts.items()
            for bound in codes.BOUNDS
        ]
        return (
            line.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(self.order_places.select("o_orderkey", "nation", "sex_id"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(
                "nation", "sex_id", F.year("l_shipdate").alias("year"), "p_type", "small",
                F.col("l_linestatus").alias("status"),
            )
            .agg(*sums, F.count(F.lit(1)).alias("lines"))
        )

    @cached_property
    def cells(self) -> DataFrame:
        return stage(self.cell_query, "cells")

    @cached_property
    def population(self) -> DataFrame:
        """(location_id, sex_id, people); the world is the sum of the nations."""
        customers = self.table("customer").selectExpr("c_nationkey", SEX)
        per_nation = customers.groupBy("c_nationkey", "sex_id").agg(F.count(F.lit(1)).alias("customers"))
        return (
            per_nation.select(*_with_world("c_nationkey", "sex_id", "customers"))
            .groupBy("location_id", "sex_id")
            .agg((F.sum("customers") * PEOPLE_PER_CUSTOMER).alias("people"))
        )

    @cached_property
    def places(self) -> DataFrame:
        """(location_id, iso_code, location_name), the world included."""
        nations = self.table("nation").select(
            (F.col("n_nationkey") + 2).alias("location_id"),
            _iso("n_nationkey").alias("iso_code"),
            F.col("n_name").alias("location_name"),
        )
        world = literal_table(
            self.spark,
            "location_id int, iso_code string, location_name string",
            [(codes.WORLD_LOCATION, None, codes.WORLD_NAME)],
        )
        return nations.unionByName(world)

    @cached_property
    def crosswalk(self) -> DataFrame:
        return self.places

    @cached_property
    def numbers(self) -> DataFrame:
        """Burden numbers per location, measure and cause, wide in the bounds."""
        causes = " ".join(
            f"WHEN '{kind}' THEN array({codes.ALL_CAUSES}, {', '.join(map(str, ids))})"
            for kind, ids in TYPE_CAUSES.items()
        )
        extra = f"CASE WHEN p_type = 'MEDIUM' AND small THEN array({SMALL_MEDIUM_CAUSE}) ELSE array() END"
        bounds = {stem: ", ".join(f"'{b}', {stem}_{b}" for b in codes.BOUNDS) for stem in "qpn"}
        measures = ", ".join(
            f"CASE WHEN {wanted} THEN named_struct('measure_id', {code}, 'scale', {scale}D, {bounds[stem]}) END"
            for code, stem, scale, wanted in (
                (codes.DEATHS, "q", 25.0, "status = 'F'"),
                (codes.DALYS, "p", 1000.0, "true"),
                (codes.YLDS, "p", 1000.0, "status = 'O'"),
                (codes.YLLS, "p", 1000.0, "status = 'F'"),
                (codes.PREVALENCE, "n", 1.0, "true"),
            )
        )
        stems = [f"{s}_{b}" for s in "qpn" for b in codes.BOUNDS]
        expanded = (
            self.cells.select(*_with_world("nation", *SLICES, "p_type", "small", "status", *stems))
            .selectExpr("*", f"explode(concat(CASE p_type {causes} END, {extra})) AS cause_id")
            .selectExpr("location_id", *SLICES, "cause_id", f"inline(array_compact(array({measures})))")
        )
        sums = [F.sum(b).cast("double").alias(b) for b in codes.BOUNDS]
        totals = expanded.groupBy("location_id", *SLICES, "measure_id", "cause_id", "scale").agg(*sums)
        return totals.withColumns({b: F.col(b) / F.col("scale") for b in codes.BOUNDS}).drop("scale")

    @cached_property
    def gbd(self) -> DataFrame:
        """Burden extract: three metrics per number, location 2 repeated."""
        totals = [
            f"max(CASE WHEN cause_id = {codes.ALL_CAUSES} THEN {b} END)"
            f" OVER (PARTITION BY location_id, {', '.join(SLICES)}, measure_id) AS all_{b}"
            for b in codes.BOUNDS
        ]
        named = (
            self.numbers.selectExpr("*", *totals)
            .join(self.population, ["location_id", "sex_id"])
            .join(self.places.select("location_id", "location_name"), "location_id")
        )
        value = {
            codes.NUMBER: "{b}",
            codes.PERCENT: "try_divide({b}, all_{b})",
            codes.RATE: "{b} / people * 1e5D",
        }
        metrics = ", ".join(
            f"named_struct('metric_id', {m}, 'metric_name', '{codes.METRIC_NAMES[m]}', "
            + ", ".join(f"'{b}', {text.format(b=b)}" for b in codes.BOUNDS)
            + ")"
            for m, text in value.items()
        )
        copies = "explode(array_repeat(1, CASE WHEN location_id = 2 THEN 2 ELSE 1 END)) AS copy"
        return named.selectExpr("*", copies).select(
            "measure_id",
            lookup("measure_id", codes.MEASURE_NAMES).alias("measure_name"),
            "location_id",
            "location_name",
            "sex_id",
            lookup("sex_id", SEX_NAMES).alias("sex_name"),
            F.expr("22 AS age_id"),
            F.expr("'All ages' AS age_name"),
            "cause_id",
            lookup("cause_id", CAUSE_NAMES).alias("cause_name"),
            "year",
            F.expr(f"inline(array({metrics}))"),
        )

    @cached_property
    def gbd_prev(self) -> DataFrame:
        """Prevalence extract: mental disorders, and one cause to be left out."""
        quantity = self.cells.select(*_with_world("nation", *SLICES, "p_type", "q_val"))
        share = quantity.groupBy("location_id", *SLICES).agg(
            F.sum(F.when(F.col("p_type") == "STANDARD", F.col("q_val"))).cast("double").alias("standard"),
            F.sum("q_val").cast("double").alias("total"),
        )
        fraction = F.coalesce("standard", F.lit(0.0)) / F.col("total")
        return share.select(
            F.lit(codes.PREVALENCE).alias("measure_id"),
            "location_id",
            "sex_id",
            F.lit(22).alias("age_id"),
            "year",
            F.explode(F.array(F.lit(codes.MENTAL), F.lit(543))).alias("cause_id"),
            fraction.alias("val"),
            (fraction * 1.1).alias("upper"),
            (fraction * 0.9).alias("lower"),
        )

    @cached_property
    def income(self) -> DataFrame:
        """The last five nations have a row without a level."""
        levels = F.get(F.array(*[F.lit(c) for c in codes.INCOME_LEVELS]), F.floor(F.col("n_nationkey") / 5).cast("int"))
        blank = literal_table(self.spark, "iso_code string, income_level string", [(None, None), (None, None)])
        nations = self.table("nation").select(_iso("n_nationkey").alias("iso_code"), levels.alias("income_level"))
        return nations.unionByName(blank)

    @staticmethod
    def _wide(per_nation: DataFrame, scale: float, unknown: str = "false") -> DataFrame:
        """Yearly indicator table with a world row; only 2019 is real.

        A nation for which ``unknown`` holds has a row without values; the world's
        total has it all the same.
        """
        row = F.inline(
            F.array(
                F.struct(_iso("nation").alias("iso_code"), F.expr(unknown).alias("unknown")),
                F.struct(F.lit(codes.WORLD_ISO).alias("iso_code"), F.lit(False).alias("unknown")),
            )
        )
        totals = per_nation.select("amount", row).groupBy("iso_code", "unknown").agg(F.sum("amount").alias("amount"))
        value = F.when(~F.col("unknown"), F.col("amount").cast("double") * scale)
        return totals.select(
            F.concat(F.lit("Place "), "iso_code").alias("country_name"),
            "iso_code",
            (value / 4).alias("X2017"),
            (value / 2).alias("X2018"),
            value.alias("X2019"),
        )

    @cached_property
    def gdp_wide(self) -> DataFrame:
        per_nation = (
            self.table("supplier")
            .groupBy(F.col("s_nationkey").alias("nation"))
            .agg(exact_sum("abs(s_acctbal)").alias("amount"))
        )
        return self._wide(per_nation, 1000.0, "nation % 7 = 3")

    @cached_property
    def gdp_ppp_wide(self) -> DataFrame:
        per_nation = self.order_places.groupBy("nation").agg(exact_sum("o_totalprice").alias("amount"))
        return self._wide(per_nation, 1.0)

    @cached_property
    def region(self) -> DataFrame:
        """One nation has a row without regions; one place has regions but no burden."""
        known = F.col("n_nationkey") != UNMAPPED_NATION
        part = F.concat("r_name", F.lit("-"), (F.floor(F.col("n_nationkey") / 5) % 2).cast("string"))
        mapped = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            _iso("n_nationkey").alias("iso_code"),
            F.when(known, F.col("r_name")).alias("who_region"),
            F.when(known, part).alias("ihme_region"),
        )
        extra = literal_table(
            self.spark,
            "iso_code string, who_region string, ihme_region string",
            [("ZZZ", "EUROPE", "EUROPE-0")],
        )
        return mapped.unionByName(extra)

    @cached_property
    def boundary(self) -> DataFrame:
        south_sudan = F.col("n_nationkey") == SOUTH_SUDAN_NATION
        code = _iso("n_nationkey")
        nations = self.table("nation").select(
            F.when(south_sudan, F.lit("X05")).otherwise(code).alias("gu_a3"),
            F.when(south_sudan, F.lit("SDS")).otherwise(code).alias("adm0_a3"),
        )
        extra = literal_table(self.spark, "gu_a3 string, adm0_a3 string", [("QQQ", "QQQ")])
        return nations.unionByName(extra)

    @cached_property
    def inputs(self) -> DataFrame:
        """Evidence counts per region: lines of two part types.

        The unmapped nation is the "Other/Duplicates" row, with the negative
        sign one of the published counts has; "Global" repeats the total.
        """
        counts = self.cells.groupBy("nation").agg(
            F.coalesce(F.sum(F.when(F.col("p_type") == "STANDARD", F.col("lines"))), F.lit(0)).alias("mental"),
            F.coalesce(F.sum(F.when(F.col("p_type") == "PROMO", F.col("lines"))), F.lit(0)).alias("maternal"),
        )
        keyed = counts.select(_iso("nation").alias("iso_code"), "mental", "maternal").join(
            self.region.select("iso_code", "ihme_region"), "iso_code", "left"
        )
        mapped = F.col("ihme_region").isNotNull()
        label = F.array(F.coalesce("ihme_region", F.lit("Other/Duplicates")), F.lit("Global"))
        signed = F.when(mapped, F.col("maternal")).otherwise(-F.col("maternal"))
        return (
            keyed.select(F.explode(label).alias("ihme_region"), "mental", signed.alias("maternal"))
            .groupBy("ihme_region")
            .agg(
                F.sum("mental").alias("inputs_mental"),
                F.sum("maternal").alias("inputs_maternal"),
                F.lit(None).cast("long").alias("inputs_all"),
            )
        )
