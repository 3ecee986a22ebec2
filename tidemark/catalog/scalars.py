"""Section 2.2: projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as s
from ..functions import text
from ..operators import report
from ..sources.views import read
from .book import Book, rounded

book = Book()
LAG = "lag({x}{k}) OVER (PARTITION BY symbol ORDER BY ts)"


def ret(k: int) -> str:
    return f"price / nullif({LAG.format(x='price', k=f', {k}')}, 0) - 1"


@book.add("P1_simple_returns", "ticks", f"SELECT symbol, ts, round({ret(1)}, 6) AS ret_1, round({ret(5)}, 6) AS ret_5, round({ret(20)}, 6) AS ret_20 FROM ticks")
def _(df):
    return rounded(df, "symbol", "ts", **{f"ret_{k}": s.ret("price", k) for k in (1, 5, 20)})


@book.add("P2_log_returns", "ticks", f"SELECT symbol, ts, round(ln({ret(1)} + 1), 6) AS log_ret FROM ticks")
def _(df):
    return rounded(df, "symbol", "ts", log_ret=s.log_ret("price"))


@book.add("P3_first_difference", "ticks", f"SELECT symbol, ts, round(price - {LAG.format(x='price', k='')}, 6) AS diff FROM ticks")
def _(df):
    return rounded(df, "symbol", "ts", diff=s.change("price"))


@book.add("P4_momentum", "ticks", "SELECT symbol, ts, " + ", ".join(f"round({ret(k)}, 6) AS mom_{k}" for k in (5, 10, 20, 50)) + " FROM ticks")
def _(df):
    return rounded(df, "symbol", "ts", **{f"mom_{k}": s.ret("price", k) for k in (5, 10, 20, 50)})


@book.add("P5_elementwise", "ticks", "SELECT symbol, ts, CAST(sign(size - 50) AS INTEGER) AS sgn, least(greatest(size, 10), 90) AS clipped, abs(size - 50) AS dist, round(ln(price), 6) AS ln_price, round(sqrt(price), 6) AS root, round(exp(-size / 100), 6) AS decay FROM ticks")
def _(df):
    c = F.col
    return df.select(
        "symbol", "ts", F.signum(c("size") - 50).cast("int").alias("sgn"), F.least(F.greatest(c("size"), F.lit(10.0)), F.lit(90.0)).alias("clipped"), F.abs(c("size") - 50).alias("dist"),
        F.round(s.ln("price"), 6).alias("ln_price"), F.round(F.sqrt("price"), 6).alias("root"), F.round(F.exp(-c("size") / 100), 6).alias("decay"),
    )


@book.add("P6_nested_condition", "ticks", "SELECT symbol, ts, CASE WHEN size > 70 AND price > 50 THEN 1 WHEN size < 30 OR price < 5 THEN -1 ELSE 0 END AS signal FROM ticks")
def _(df):
    return df.select("symbol", "ts", F.when((F.col("size") > 70) & (F.col("price") > 50), 1).when((F.col("size") < 30) | (F.col("price") < 5), -1).otherwise(0).alias("signal"))


@book.add("P7_strict_filter", "ticks", f"SELECT symbol, ts, round(trgt, 6) AS trgt FROM (SELECT *, round(abs({ret(1)}), 9) AS trgt FROM ticks) WHERE trgt > 0.5")
def _(df):
    return rounded(df.withColumn("trgt", F.round(F.abs(s.ret("price")), 9)).where("trgt > 0.5"), "symbol", "ts", trgt="trgt")


@book.add("P8_drop_nulls", "ticks", f"SELECT symbol, ts, round(ret_20, 6) AS ret_20 FROM (SELECT *, {ret(20)} AS ret_20 FROM ticks) WHERE ret_20 IS NOT NULL")
def _(df):
    return rounded(df.withColumn("ret_20", s.ret("price", 20)).na.drop(subset=["ret_20"]), "symbol", "ts", ret_20="ret_20")


def drop_empty_columns(df, least: int = 1):
    """df without the columns that have fewer than ``least`` values: one aggregation, then a projection."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select([c for c in df.columns if n[c] >= least])


@book.add("P9_drop_empty_columns", "ticks", "SELECT symbol, ts, price FROM ticks")
def _(df):
    return drop_empty_columns(df.select("symbol", "ts", "price", F.lit(None).cast("double").alias("empty")))


def numeric_columns(df, least: int = 100):
    """The numeric columns with at least ``least`` values."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    n = df.agg(*[F.count(c).alias(c) for c in names]).first()
    return df.select([c for c in names if n[c] >= least])


@book.add("P10_numeric_columns", "ticks", "SELECT price, size FROM ticks")
def _(df):
    return numeric_columns(df)


@book.add("P11_scalar_broadcast", "ticks", "SELECT symbol, ts, price, (SELECT count(*) FROM ticks) AS n_rows FROM ticks")
def _(df):
    return df.select("symbol", "ts", "price").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_rows"))))


@book.add(
    "P12_cast_fields", None,
    "SELECT p_partkey, TRY_CAST(json_extract_string(j, '$.pe') AS DOUBLE) AS fund_pe, TRY_CAST(json_extract_string(j, '$.size') AS DOUBLE) AS fund_size FROM"
    " (SELECT p_partkey, '{\"pe\": \"' || CASE WHEN p_size % 3 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END || '\", \"size\": \"' || CAST(p_partkey AS VARCHAR) || '\"}' AS j FROM part)",
)
def _(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    pe = F.when(F.col("p_size") % 3 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    j = p.select("p_partkey", F.concat(F.lit('{"pe": "'), pe, F.lit('", "size": "'), F.col("p_partkey").cast("string"), F.lit('"}')).alias("j"))
    field = lambda k: F.get_json_object("j", f"$.{k}").try_cast("double")
    return j.select("p_partkey", field("pe").alias("fund_pe"), field("size").alias("fund_size"))


@book.add("P13_action", "ticks", "SELECT symbol, ts, CASE WHEN size >= 75 AND price > 50 THEN 'BUY' WHEN size >= 75 THEN 'SELL' ELSE 'PASS' END AS action FROM ticks")
def _(df):
    return df.select("symbol", "ts", F.when((F.col("size") >= 75) & (F.col("price") > 50), "BUY").when(F.col("size") >= 75, "SELL").otherwise("PASS").alias("action"))


def meta_labels(signals, labels):
    """1 where the side taken (``signal``) and the barrier's outcome (``label``) agree, for rows with both. Times must be unique in a symbol's labels."""
    return agreement(signals.join(labels, ["symbol", "ts"]))


def agreement(df):
    """``meta_labels`` of rows that have both ``signal`` and ``label``, whatever their times."""
    agree = ((F.col("signal") == 1) & (F.col("label") == 1)) | ((F.col("signal") == -1) & (F.col("label") == -1))
    return df.select("symbol", "ts", agree.cast("int").alias("meta_label"))


@book.add(
    "P14_meta_labels", "ticks",
    "SELECT symbol, ts, CASE WHEN (s = 1 AND y = 1) OR (s = -1 AND y = -1) THEN 1 ELSE 0 END AS meta_label FROM (SELECT *, CAST(sign(size - 50) AS INTEGER) AS s, CASE WHEN price > 50 THEN 1 ELSE -1 END AS y FROM ticks) WHERE size <> 50",
)
def _(df):
    both = df.where("size <> 50").withColumns({"signal": F.signum(F.col("size") - 50).cast("int"), "label": F.when(F.col("price") > 50, 1).otherwise(-1)})
    return agreement(both)  # ticks of one time would meet each other in a join


@book.add("P15_date_strings", "daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(CAST(ts AS DATE) - INTERVAL 30 DAY AS DATE) AS month_before FROM daily")
def _(df):
    return df.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_sub(F.col("ts").cast("date"), 30).alias("month_before"))


def business_days(last, horizon: int):
    """The next ``horizon`` weekdays after a date."""
    days = F.sequence(F.date_add(last, 1), F.date_add(last, 2 * horizon + 7))
    return F.slice(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7)), 1, horizon)


@book.add(
    "P16_business_days", "daily",
    "SELECT symbol, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS step, d AS ds FROM (SELECT symbol, CAST(unnest(generate_series(CAST(max(ts) AS DATE) + 1, CAST(max(ts) AS DATE) + 67, INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY symbol)"
    " WHERE dayofweek(d) NOT IN (0, 6) QUALIFY row_number() OVER (ORDER BY d) <= 30",
)
def _(df):
    last = df.groupBy("symbol").agg(F.max("ts").cast("date").alias("last"))
    return last.select("symbol", F.posexplode(business_days(F.col("last"), 30)).alias("step", "ds")).withColumn("step", F.col("step") + 1)


@book.add("P17_number_formats", "daily", "SELECT ts, printf('%.2f', round(volume, 2)) AS number_text, CASE WHEN close >= 1000 THEN printf('%.2fK', round(close, -1) / 1000) ELSE printf('%.2f', close) END AS money_text FROM daily WHERE volume < 1000 AND close < 900000")
def _(df):
    return df.where("volume < 1000 AND close < 900000").select("ts", F.format_number("volume", 2).alias("number_text"), text.money(F.when(F.col("close") >= 1000, F.round("close", -1)).otherwise(F.col("close"))).alias("money_text"))


@book.add("P18_formula_lines", None, "SELECT doc_id, (" + " OR ".join(f"contains(line, '{m}')" for m in text.FORMULA_MARKS) + ") AS is_formula FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.is_formula(F.split("text", "\n")[0]).alias("is_formula"))


BODY = "ALPHA_DECAY: slow\nRISK_LEVEL: HIGH\nCONSENSUS:\nBuy on dips\nKEY FINDINGS:\n- one\n- two\nRECOMMENDATIONS:\n- wait\nCITATIONS:\n- none"


@book.add(
    "P19_parse_answer", None,
    "SELECT conv_id, turn, CASE WHEN odd THEN 'slow' ELSE '' END AS alpha_decay, CASE WHEN odd THEN 'HIGH' ELSE '' END AS risk_level, CASE WHEN odd THEN 'Buy on dips' ELSE '' END AS consensus, CASE WHEN odd THEN 'one|two' ELSE '' END AS findings,"
    " CASE WHEN odd THEN 'wait' ELSE '' END AS recommendations, CASE WHEN odd THEN 'none' ELSE '' END AS citations FROM (SELECT conv_id, turn, coalesce(turn % 2 <> 0, true) AS odd FROM conversations)",
)
def _(spark, sf_dir):
    """Every other turn has an answer with all headings in place of its text, the rest have none."""
    asked = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit(BODY)).alias("text"))
    lists = ("findings", "recommendations", "citations")
    return text.parse_answer(asked).drop("text").withColumns({c: F.array_join(c, "|") for c in lists})


@book.add("P20_report_lines", "daily", "SELECT 'bars ' || CAST(count(*) AS VARCHAR) || ', last ' || strftime(max(ts), '%Y-%m-%d') AS report FROM daily")
def _(df):
    return df.agg(F.format_string("bars %d, last %s", F.count(F.lit(1)), F.date_format(F.max("ts"), "yyyy-MM-dd")).alias("report"))


@book.add("P21_risk_report", "ticks")
def _(df):
    rets = df.select("symbol", "ts", (100 + F.col("price")).alias("close")).withColumn("ret", s.ret("close"))
    return report.risk_report(rets)


@book.add(
    "P22_chunks", None,
    "SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk, length(done[k]) AS n_chars FROM (SELECT doc_id, done, unnest(range(1, len(done) + 1)) AS k FROM (SELECT doc_id, CASE WHEN acc.cur = '' THEN acc.done ELSE acc.done || [acc.cur] END AS done FROM"
    " (SELECT doc_id, list_reduce(ps, lambda a, x: CASE WHEN length(a.cur) + length(x.cur) > 1000 AND a.cur <> '' THEN {'cur': right(a.cur, 200) || chr(10) || chr(10) || x.cur, 'done': a.done || [a.cur]}"
    " ELSE {'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || chr(10) || chr(10) || x.cur END, 'done': a.done} END, {'cur': '', 'done': CAST([] AS VARCHAR[])}) AS acc FROM"
    " (SELECT doc_id, list_transform(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> ''), lambda p: {'cur': p, 'done': CAST([] AS VARCHAR[])}) AS ps FROM documents))))",
)
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return text.explode_chunks(docs).select("doc_id", F.col("chunk").cast("int"), F.length("chunk_text").alias("n_chars"))
