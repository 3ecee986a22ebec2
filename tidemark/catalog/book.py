"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import SQL, brand_daily, daily, ticks

Query = Callable[[SparkSession, str], DataFrame]
VIEWS = {"daily": daily, "ticks": ticks, "user_ticks": lambda s, d: ticks(s, d, "user_id"), "brand": brand_daily}


#: Put before common table expressions of which one refers to itself.
RECURSIVE = "RECURSIVE_MARK"


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, view: str | None = None, sql: str | None = None, ctes: str = "") -> Callable:
        """Register a function of a view's DataFrame (or of session and folder) as a query. ``sql`` follows the view's common table expression and ``ctes``."""

        def keep(f: Callable) -> Callable:
            self.queries[name] = (lambda spark, sf_dir: f(VIEWS[view](spark, sf_dir))) if view else f
            if sql:
                parts = [x for x in (SQL[view] if view else "", ctes) if x]
                head = f"WITH {', '.join(parts)} " if parts else ""
                if RECURSIVE in head:
                    head = head.replace(RECURSIVE, "").replace("WITH", "WITH RECURSIVE", 1)
                self.sql[name] = head + sql
            return f

        return keep


def rounded(df: DataFrame, *keys: str, digits: int = 6, **columns: object) -> DataFrame:
    """Keys and columns, doubles rounded."""
    return df.select(*keys, *[F.round(F.col(c) if isinstance(c, str) else c, digits).alias(k) for k, c in columns.items()])


def phi_sql(z: str) -> str:
    """The normal distribution function as in operators.risk."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    tail = f"0.5 * {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z} / 2)"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"
