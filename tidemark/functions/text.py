"""Text helpers of the research side: formatting, chunking, and parsing of structured answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of a formula line.
FORMULA_MARKS = ["=", "∑", "∫", "√", "≤", "≥", "≈", "∂", "∆", "σ", "μ", "\\frac", "\\sum", "\\int", "^", "→"]


def money(x: Column) -> Column:
    """Amount with its magnitude."""
    a = F.abs(x)
    return (
        F.when(x.isNull(), F.lit("N/A")).when(a >= 1e12, F.concat(F.format_number(x / 1e12, 2), F.lit("T"))).when(a >= 1e9, F.concat(F.format_number(x / 1e9, 2), F.lit("B")))
        .when(a >= 1e6, F.concat(F.format_number(x / 1e6, 2), F.lit("M"))).when(a >= 1e3, F.concat(F.format_number(x / 1e3, 2), F.lit("K"))).otherwise(F.format_number(x, 2))
    )


def percent(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("N/A")).otherwise(F.concat(F.format_number(x * 100, 2), F.lit("%")))


def is_formula(line: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in FORMULA_MARKS]), lambda m: F.contains(line, m))


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Paragraphs joined greedily up to ``size`` characters; each chunk but the first begins with the last ``overlap`` characters of the one before."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        joined = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        over = (F.length(cur) + F.length(p) > size) & (cur != "")
        next_cur = F.when(over, F.concat(F.substring(cur, -overlap, overlap), F.lit("\n\n"), p)).otherwise(joined) if overlap else F.when(over, p).otherwise(joined)
        return F.struct(next_cur.alias("cur"), F.when(over, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"))

    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.aggregate(paragraphs, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def explode_chunks(df: DataFrame, text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row per chunk: ``chunk`` (from 0) and ``chunk_text`` beside the columns of df."""
    return df.select("*", F.posexplode(chunks(F.col(text_col), size, overlap)).alias("chunk", "chunk_text"))


def parse_answer(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Fields of an answer with headings: ALPHA_DECAY and RISK_LEVEL on their lines, CONSENSUS as text, the other sections as lists of their bullets."""
    text = F.col(text_col)
    line = lambda key: F.trim(F.regexp_extract(text, rf"(?m)^\s*{key}\s*:\s*(.*)$", 1))
    body = lambda key: F.regexp_extract(text, rf"(?ms)^\s*{key}\s*:\s*\n?(.*?)(?=^[A-Z][A-Z _]+:|\z)", 1)
    bullets = lambda key: F.transform(F.regexp_extract_all(body(key), F.lit(r"(?m)^\s*[-*]\s+(.*)$"), F.lit(1)), lambda x: F.trim(x))
    return df.select(
        "*", line("ALPHA_DECAY").alias("alpha_decay"), line("RISK_LEVEL").alias("risk_level"), F.regexp_replace(body("CONSENSUS"), r"^\s+|\s+$", "").alias("consensus"),
        bullets("KEY FINDINGS").alias("findings"), bullets("RECOMMENDATIONS").alias("recommendations"), bullets("CITATIONS").alias("citations"),
    )
