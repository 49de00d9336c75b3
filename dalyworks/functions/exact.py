"""Exact, overflow-safe sums of amounts with a fixed number of decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(amount: str, decimals: int = 4) -> Column:
    """Decimal sum of a double expression with at most ``decimals`` decimals.

    The result does not depend on row order. The running state is two longs, the
    scaled amount above and below 16 bits, which stay in generated code and have
    room for 10^13 rows of amounts up to 10^6; a DECIMAL buffer would allocate
    per row.
    """
    scaled = f"CAST(rint(({amount}) * {10.0**decimals}D) AS BIGINT)"
    high = f"CAST(sum(shiftright({scaled}, 16)) AS DECIMAL(20, 0))"
    low = f"CAST(sum({scaled} & 65535) AS DECIMAL(20, 0))"
    return F.expr(f"CAST(({high} * 65536BD + {low}) * {10**-decimals:.{decimals}f}BD AS DECIMAL(38, {decimals}))")
