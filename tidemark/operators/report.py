"""Readable blocks of a risk report: value at risk by method, tails, GARCH. Text is made from columns; a report is a row per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.market import materialise
from . import risk

#: Order and names of the methods in a report, and its sentences. Fixed values.
METHODS = {"parametric": "Parametric (Normal)", "cornish_fisher": "Cornish-Fisher (Modified)", "historical": "Historical Simulation", "bootstrap": "Bootstrap"}
NO_VAR, NO_TAILS, NO_GARCH = "  VaR computation unavailable.", "  Fat-tail analysis unavailable.", "  GARCH analysis unavailable."


def share(x: Column, digits: int = 4) -> Column:
    """A share as a percentage."""
    return F.format_string(f"%.{digits}f%%", x * 100)


def var_line(name: Column, var: Column, cvar: Column, lo: Column, hi: Column) -> Column:
    """One method: its VaR (N/A where it is null or 0), and CVaR and interval where there are any."""
    head = F.when(var.isNull() | (var == 0), F.concat(F.lit("  - "), name, F.lit(": N/A"))).otherwise(F.concat(F.lit("  - "), name, F.lit(": VaR = "), share(var)))
    more = F.when(cvar.isNotNull(), F.concat(F.lit(",  CVaR = "), share(cvar))).otherwise("")
    interval = F.when(lo.isNotNull() & hi.isNotNull(), F.concat(F.lit("  [95% CI: "), share(lo), F.lit(" - "), share(hi), F.lit("]"))).otherwise("")
    return F.concat(head, more, interval)


def var_blocks(methods: DataFrame) -> DataFrame:
    """``symbol, var_block`` from rows (symbol, method, var, cvar, lo, hi), a line each, in the order of METHODS and then by name."""
    names = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])
    rank = F.create_map(*[F.lit(x) for k, m in enumerate(METHODS) for x in (m, k)])
    c = F.col
    line = F.struct(F.coalesce(rank[c("method")], F.lit(99)).alias("k"), c("method"), var_line(F.coalesce(names[c("method")], c("method")), c("var"), c("cvar"), c("lo"), c("hi")).alias("line"))
    return methods.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("var_block"))  # a line per method


def tail_block(skew: Column, kurtosis: Column, tail_class: Column, jb_p: Column, ks_p: Column, level: float = 0.05) -> Column:
    """Moments, the Jarque-Bera test at ``level`` and the Kolmogorov-Smirnov p value."""
    text = F.format_string(
        "  - Skewness: %.4f\n  - Excess Kurtosis: %.4f  (%s)\n  - Jarque-Bera p-value: %.4e  (%s)\n  - KS-test p-value: %.4e", skew, kurtosis, tail_class, jb_p, F.when(jb_p > level, "Normal").otherwise("NON-Normal"), ks_p,
    )
    return F.when(skew.isNull() | kurtosis.isNull(), NO_TAILS).otherwise(text)


def garch_block(alpha: Column, beta: Column, persistence: Column, nu: Column, current: Column, long_run: Column, aic: Column, bic: Column) -> Column:
    """Coefficients, distribution, yearly volatilities (both per year already) and criteria of a fit."""
    kind = F.when(nu.isNull(), "Normal").otherwise("Student-t")
    text = F.concat(
        F.format_string("  - alpha = %.4f,  beta = %.4f,  persistence (alpha+beta) = %.4f\n  - Distribution: %s\n  - Current Conditional Vol (ann.): %.2f%%", alpha, beta, persistence, kind, current * 100),
        F.when(long_run.isNotNull(), F.format_string("\n  - Long-run Vol (ann.): %.2f%%", long_run * 100)).otherwise(""),
        F.format_string("\n  - AIC: %.1f   BIC: %.1f", aic, bic),
    )
    return F.when(alpha.isNull(), NO_GARCH).otherwise(text)


def risk_report(rets: DataFrame, ret: str = "ret", draws: int = 10_000) -> DataFrame:
    """``symbol, var_block, tail_block``: all VaR methods and the tails of each symbol's returns, as text."""
    methods = risk.var_all(rets, ret).unionByName(risk.var_bootstrap(rets, ret, draws=draws), allowMissingColumns=True)
    for name in ("cvar", "lo", "hi"):
        if name not in methods.columns:
            methods = methods.withColumn(name, F.lit(None).cast("double"))
    # written first: a union of grouped tables that is grouped again by their key is planned partition by partition, which fails where their numbers differ
    methods = materialise(methods.select("symbol", "method", "var", "cvar", "lo", "hi"), "methods")
    tails = risk.fat_tails(rets, ret).join(risk.ks_normal(rets, ret), "symbol", "left")
    c = F.col
    text = tails.select("symbol", tail_block(c("skewness"), c("excess_kurtosis"), c("tail_class"), c("jb_p"), c("ks_p")).alias("tail_block"))
    return text.join(var_blocks(methods), "symbol", "left").select("symbol", F.coalesce("var_block", F.lit(NO_VAR)).alias("var_block"), "tail_block")
