"""Repeatable random draws and the attributable deaths they imply.

A draw is a pure function of (id, seed): one hash gives four independent
uniforms, so a value does not depend on partitioning, retries or lost executors,
and drawing is a narrow step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..functions.reshape import inline_rows
from .attribution import PAF_EXPRESSIONS


def with_uniforms(ids: DataFrame, id_column: str = "draw_id", seed: int = codes.DRAW_SEED) -> DataFrame:
    """Add u1..u4, each uniform on (0, 1) with 32 bits."""
    text = F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed)))
    hashed = ids.withColumn("__hash", F.md5(text))
    uniforms = {
        f"u{k + 1}": (F.conv(F.substring("__hash", 8 * k + 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
        for k in range(4)
    }
    return hashed.withColumns(uniforms).drop("__hash")


def normal_pair(u: str, v: str) -> tuple[Column, Column]:
    """Two independent standard normals from two uniforms."""
    radius = F.sqrt(-2.0 * F.log(F.col(u)))
    angle = F.col(v) * (2.0 * 3.141592653589793)
    return radius * F.cos(angle), radius * F.sin(angle)


def from_interval(z: Column, mean, low, high) -> Column:
    """Normal draw whose 95% interval is (low, high)."""
    mean, low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mean, low, high))
    return mean + z * ((high - low) / codes.CI_WIDTH)


def uniform(u: str, low: float, high: float) -> Column:
    return F.lit(low) + F.col(u) * (high - low)


def pick(u: str, options) -> Column:
    """One of ``options`` with equal chances."""
    slot = (F.floor(F.col(u) * len(options)) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), slot)


def published_intervals(ids: DataFrame, seed: int = codes.DRAW_SEED, prevalence=None, deaths=None) -> DataFrame:
    """Scenario 1: prevalence, relative risk and deaths are normal around their
    published estimates. ``prevalence`` and ``deaths`` may be (mean, low, high)
    columns of ``ids`` instead, for place-specific draws."""
    z1, z2 = normal_pair("u1", "u2")
    z3, _ = normal_pair("u3", "u4")
    return with_uniforms(ids, seed=seed).withColumns(
        {
            "prevalence": from_interval(z1, *(prevalence or codes.PREVALENCE_CI)),
            "relative_risk": from_interval(z2, *codes.RISK_CI),
            "deaths": from_interval(z3, *(deaths or codes.DEATHS_CI)),
        }
    ).drop("u1", "u2", "u3", "u4")


def risk_grid(ids: DataFrame, seed: int = codes.DRAW_SEED, deaths=None) -> DataFrame:
    """Scenario 2: uniform prevalence, relative risk from a grid; ``deaths`` as in scenario 1."""
    z3, _ = normal_pair("u3", "u4")
    return with_uniforms(ids, seed=seed).withColumns(
        {
            "prevalence": uniform("u1", *codes.PREVALENCE_RANGE),
            "relative_risk": pick("u2", codes.RISK_GRID),
            "deaths": from_interval(z3, *(deaths or codes.DEATHS_CI)),
        }
    ).drop("u1", "u2", "u3", "u4")


def wide_risk(ids: DataFrame, seed: int = codes.DRAW_SEED, deaths=None) -> DataFrame:
    """Scenario 3: wide normal prevalence, uniform relative risk around the
    pooled estimate; ``deaths`` as in scenario 1."""
    z1, z2 = normal_pair("u1", "u2")
    mean, sd = codes.WIDE_PREVALENCE
    return with_uniforms(ids, seed=seed).withColumns(
        {
            "prevalence": F.lit(mean) + z1 * sd,
            "relative_risk": uniform("u3", *codes.RISK_RANGE),
            "deaths": from_interval(z2, *(deaths or codes.DEATHS_CI)),
        }
    ).drop("u1", "u2", "u3", "u4")


#: Draws of one place that leave a row together; only bounds the size of a row.
CHUNK = 4096


def place_draws(places: DataFrame, keys: Sequence[str], count: int, chunk: int = CHUNK) -> DataFrame:
    """``places`` with ``count`` draws each: ``draw_id``, its place and a number from 0.

    A draw's id is made of its place's ``keys`` and its number, so that places draw independently
    and any partitioning gives the same values. Nothing is stored: chunks of numbers are dealt
    out over the tasks and become draws as they are read, so that what follows can fold them
    with map-side state. A place with many draws spreads over as many tasks as it has chunks.
    """
    chunks = F.sequence(F.lit(0), F.lit((max(count, 1) - 1) // chunk))
    dealt = places.withColumn("__chunk", F.explode(chunks)).repartition(*keys, "__chunk")
    first = F.col("__chunk").cast("long") * chunk
    numbers = F.sequence(first, F.least(first + chunk, F.lit(count)) - 1)
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    named = F.concat_ws("-", *parts, F.col("draw_no").cast("string"))
    drawn = dealt.filter(F.lit(count) > 0).withColumn("draw_no", F.explode(numbers)).withColumn("draw_id", named)
    return drawn.drop("__chunk")


def attributable_deaths(draws: DataFrame) -> DataFrame:
    """Both formulas per draw as rows: (formula, paf, deaths_mh)."""
    rows = []
    for formula, paf in PAF_EXPRESSIONS.items():
        fraction = paf("prevalence", "relative_risk")
        rows.append(
            {
                "formula": F.lit(codes.FORMULA_NAMES[formula]),
                "paf": fraction,
                "deaths_mh": F.col("deaths") * fraction,
            }
        )
    return inline_rows(draws, draws.columns, rows)
