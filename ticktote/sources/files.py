"""File sources, sinks and row cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.operators.sequence import key_join
from ticktote.sources.storage import scratch_dir, stored_table  # noqa: F401

BAR_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("ts", "close", "high", "low", "open", "volume")])
EVENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "ts", "impact")])


def ensure_columns(df: DataFrame, defaults: dict, rename: dict[str, str] | None = None) -> DataFrame:
    """Add missing columns with constants, then apply the alias map."""
    d = df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})
    return d.withColumnsRenamed(rename or {})


def clean(df: DataFrame, required: list[str], fill: dict) -> DataFrame:
    """Infinite and NaN to NULL, drop rows lacking a required value, fill the rest."""
    inf = F.lit(float("inf"))
    d = df.withColumns(
        {c: F.when(~F.isnan(c) & (F.abs(c) != inf), F.col(c)) for c, t in df.dtypes if t == "double"}
    )
    return d.dropna(subset=required).fillna(fill)


def read_bars_csv(spark: SparkSession, path: str | list[str], header_lines: int = 3) -> DataFrame:
    """Bar files whose first lines are headers: coerced numbers, rows without time or close dropped.

    The symbol is the file's name. Header lines never parse as a timestamp, so
    they fall out with the bad rows and files stay splittable.
    """
    raw = spark.read.schema(BAR_SCHEMA).csv(path)
    num = {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume")}
    d = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("symbol"),
        F.col("ts").try_cast("timestamp_ntz").alias("ts"),
        *[v.alias(k) for k, v in num.items()],
    )
    return d.dropna(subset=["ts", "close"])


def load_table(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """The same logical table from parquet, orc, csv or json; jdbc where a driver is on the classpath."""
    rd = spark.read.format(fmt).options(**options)
    if schema is not None and fmt != "jdbc":
        rd = rd.schema(schema)
    return rd.load(path) if path else rd.load()


def date_filter(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end))
    return df


def split_valid_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Custom event rows: (valid typed rows, rejected rows with the reason)."""
    t, i = F.col("ts").try_cast("timestamp_ntz"), F.lower("impact")
    reason = (
        F.when(F.col("name").isNull() | (F.trim("name") == ""), "name missing")
        .when(t.isNull(), "time not readable")
        .when(F.coalesce(~i.isin("high", "medium", "low"), F.lit(True)), "impact unknown")
    )
    d = raw.withColumn("reason", reason)
    ok = d.where(F.col("reason").isNull()).select("name", t.alias("event_ts"), i.alias("impact"))
    return ok, d.where(F.col("reason").isNotNull())


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace on a key: the row with the greatest version wins."""
    u = old.unionByName(new, allowMissingColumns=True)
    vals = [c for c in u.columns if c not in keys]
    pick = F.max_by(F.struct(*vals), F.col(version))
    return u.groupBy(*keys).agg(pick.alias("_v")).select(*keys, *[F.col("_v")[c].alias(c) for c in vals]).select(*u.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First write wins: keep the old rows, add the first new row of unseen keys."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return old.unionByName(first.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def coalesce_update(old: DataFrame, updates: DataFrame, keys: list[str], cols: list[str], gap_cols: list[str]) -> DataFrame:
    """Rows with a gap in gap_cols take the non-null updates; complete rows are left alone."""
    u = updates.select(*keys, *[F.col(c).alias("_u_" + c) for c in cols])
    gap = F.lit(False)
    for c in gap_cols:
        gap = gap | F.col(c).isNull()
    d = key_join(old.withColumn("_gap", gap), u, keys)
    new = {c: F.when(F.col("_gap"), F.coalesce(F.col("_u_" + c), F.col(c))).otherwise(F.col(c)) for c in cols}
    return d.withColumns(new).select(*old.columns)


def from_csv_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Bar rows from CSV text lines: coerced, header and broken rows dropped."""
    d = lines.withColumn("_r", F.from_csv(F.col(text), BAR_SCHEMA.simpleString()[7:-1].replace(":", " ")))
    return typed_bars(d.select(*[c for c in lines.columns if c != text], "_r.*"))


def typed_bars(raw: DataFrame) -> DataFrame:
    num = {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume")}
    return raw.withColumns({"ts": F.col("ts").try_cast("timestamp_ntz"), **num}).dropna(subset=["ts", "close"])


KLINES = "array<struct<t:bigint,o:string,h:string,l:string,c:string,v:string>>"


def flatten_klines(payloads: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """Payload arrays to typed rows, one per key and timestamp."""
    d = payloads.select(*keys, F.explode(F.from_json(body, KLINES)).alias("k"))
    d = d.select(*keys, F.timestamp_millis("k.t").alias("ts"), *[F.col("k." + a).try_cast("double").alias(b) for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])
    return d.dropDuplicates([*keys, "ts"])


def extract_matches(pages: DataFrame, html: str, pattern: str, names: list[str], keys: list[str]) -> DataFrame:
    """One row per regular-expression match of a page, groups as columns, in page order."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    z = F.arrays_zip(*groups)
    return pages.select(*keys, F.posexplode(z).alias("match_no", "m")).select(*keys, (F.col("match_no") + 1).alias("match_no"), *[F.col("m")[n].alias(n) for n in names])


# Names of the trifecta table, its winning row, and the row's text, "3-1-4 17,640円".
TRIFECTA_NAMES = "3連勝|3連単"
TRIFECTA_ROW = "単"
PAYOUT_PATTERN = r"^\s*(\d+)\s*-\s*(\d+)\s*-\s*(\d+)\s+([\d,]+)\s*円"


def _cells(row: Column) -> Column:
    """Texts of a table row's cells, without markup and outer blanks."""
    inner = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(inner, lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>|&nbsp;", " ")))


def extract_payouts(pages: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """Race number, combination and payout of the trifecta of each race of a result page.

    A page has several tables for each race. Those whose first row names the trifecta number the races; in such a
    table the first row called 単 has the payout. A race whose row is missing or unreadable gives no row, but counts.
    """
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))
    rows = F.transform(tables, lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0)), _cells))
    races = F.filter(rows, lambda t: F.coalesce(F.array_join(F.try_element_at(t, F.lit(1)), " ").rlike(TRIFECTA_NAMES), F.lit(False)))
    d = pages.select(*keys, F.posexplode(races).alias("_n", "_t"))
    won = F.try_element_at(F.filter("_t", lambda r: F.try_element_at(r, F.lit(1)) == TRIFECTA_ROW), F.lit(1))
    d = d.select(*keys, (F.col("_n") + 1).alias("race_no"), F.try_element_at(won, F.lit(2)).alias("_x"))
    part = [F.regexp_extract("_x", PAYOUT_PATTERN, k) for k in (1, 2, 3, 4)]
    combo = F.concat_ws("-", *[p.try_cast("int") for p in part[:3]])
    pay = F.replace(part[3], F.lit(","), F.lit("")).try_cast("int")
    return d.where(F.col("_x").rlike(PAYOUT_PATTERN)).select(*keys, "race_no", combo.alias("combo"), pay.alias("payout")).where("payout is not null")


def position_rows(raw: DataFrame, code: str, name: str, codes: list[str], name_part: str, date: str, version: str) -> DataFrame:
    """Contract rows by code, or by name where the code is missing; last row per contract and date."""
    pick = F.coalesce(F.trim(code).isin(codes), F.lower(name).contains(name_part.lower()))
    d = raw.where(pick)
    vals = [c for c in d.columns if c not in (code, date)]
    return d.groupBy(code, date).agg(F.max_by(F.struct(*vals), version).alias("_v")).select(code, date, *[F.col("_v")[c].alias(c) for c in vals])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append", fmt: str = "parquet") -> None:
    w = df.write.mode(mode).format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
