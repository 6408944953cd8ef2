"""Readers and writers of samples: JSON Lines, CSV, reports, soft labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .shared import written

SAMPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "label", "vector", "channel", "source", "split")])
HOLDOUT = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "label", "vector", "source")])
# The domains of a holdout row.
SOURCES = ("ftc", "reddit_rscams", "phishtank", "huggingface_phishing", "huggingface_difraud", "huggingface_sms_spam", "manual")
VECTORS = ("crypto_investment", "government_impersonation", "lottery_reward", "phishing", "remote_access", "romance_grooming", "tech_support", "urgency_payment", "safe")


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def read_strict(spark: SparkSession, path: str, schema: T.StructType = SAMPLE) -> DataFrame:
    """JSON Lines; blank lines are passed over, and the first bad line fails, with its file and number.

    Lines are read and parsed once, into a table, from which rows come and bad lines show; only where there are bad ones
    are lines counted, to say which.
    """
    rows = written(_lines(spark, path, schema), "lines")
    if not rows.where("bad is not null").isEmpty():
        first = bad_lines(spark, path, schema).orderBy("file", "number").first()
        raise ValueError(f"{first.file}, line {first.number}: not a JSON object: {first.line[:200]}")
    return rows.select(*schema.names)


def read_lenient(spark: SparkSession, path: str, schema: T.StructType = SAMPLE) -> DataFrame:
    """JSON Lines; bad lines are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def _lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Fields of each line that isn't blank, and its file and text; `bad` holds a line that isn't JSON."""
    with_bad = T.StructType([*schema.fields, T.StructField("bad", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    read = lines.where(strip(F.col("value")) != "").withColumn("r", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    return read.select("file", "block", "id", "r.*")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType = SAMPLE) -> DataFrame:
    """(file, number, line) of lines that aren't JSON objects, numbered from 1 in their file, blank lines included.

    A split's lines have rising ids, so a line's number is its place in its split and the lines of the splits before.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    bad = _lines(spark, path, schema).where("bad is not null").join(splits, ["file", "block"])
    return bad.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), F.col("bad").alias("line"))


def read_validated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) holdout rows; a rejected row has its reason."""
    rows = written(_lines(spark, path, HOLDOUT), "lines")  # both outputs come from one read
    missing = F.col("text").isNull() | F.col("label").isNull() | F.col("vector").isNull() | F.col("source").isNull()
    reason = (
        F.when(F.col("bad").isNotNull(), "invalid JSON")
        .when(missing, "missing field")
        .when(~F.col("label").isin("scam", "safe"), "label")
        .when(~F.col("vector").isin(*VECTORS), "vector")
        .when(~F.col("source").isin(*SOURCES), "source")
    )
    marked = rows.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").select(*HOLDOUT.names), marked.where("reject_reason is not null")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a CSV with a header: column url, else URL; stripped, blanks dropped."""
    rows = spark.read.csv(path, header=True)
    named = {c: c for c in rows.columns}
    columns = [F.nullif(strip(F.col(f"`{named[c]}`")), F.lit("")) for c in ("url", "URL") if c in named]
    return rows.select(F.coalesce(*columns).alias("url")).where("url is not null") if columns else spark.createDataFrame([], "url string")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics in one JSON document a file."""
    return spark.read.json(path, multiLine=True)


def read_sms(rows: DataFrame) -> DataFrame:
    """(text, label) of a table with sms (or text) and label 0/1."""
    text = "sms" if "sms" in rows.columns else "text"
    return rows.select(F.col(text).alias("text"), F.when(F.col("label") == 1, "spam").otherwise("ham").alias("label"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_locked(df: DataFrame, path: str) -> None:
    """Refuses where the target exists."""
    df.write.mode("errorifexists").json(path)


def write_report(report: DataFrame, path: str, summary: dict[str, Column] | None = None) -> None:
    """A report as JSON Lines in `rows`, which as many tasks write as it has, and one line of aggregates over them in `summary`."""
    report.write.mode("overwrite").json(f"{path}/rows")
    totals = summary or {"n_rows": F.count("*")}
    report.agg(*(c.alias(name) for name, c in totals.items())).write.mode("overwrite").json(f"{path}/summary")


def write_soft_labels(df: DataFrame, path: str) -> None:
    """One folder per temperature, so that a reader of one reads no other."""
    df.write.mode("overwrite").partitionBy("t").parquet(path)


def resume_counts(existing: DataFrame, targets: DataFrame, by: str = "vector") -> DataFrame:
    """targets with how many rows exist already, and how many remain."""
    have = existing.groupBy(by).agg(F.count("*").alias("existing"))
    joined = targets.join(have, by, "left").withColumn("existing", F.coalesce("existing", F.lit(0)))
    return joined.withColumn("remaining", F.greatest(F.col("target") - F.col("existing"), F.lit(0)))


def document_or_default(keys: DataFrame, documents: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Each key's document, or a default row where there is none."""
    joined = keys.join(documents, key, "left")
    return joined.select(key, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()))


def nested_blocks(blocks: str) -> Column:
    """Recognised blocks with their lines and elements; missing lists are empty, a missing frame is zeros."""
    none = F.struct(*(F.lit(0).alias(n) for n in ("left", "top", "width", "height")))
    frame = lambda f: F.when(f.isNull(), none).otherwise(F.struct(*(f[n].alias(n) for n in ("left", "top", "width", "height"))))
    elements = lambda e: F.coalesce(F.transform(e, lambda x: F.struct(x["text"].alias("text"))), F.array().cast("array<struct<text:string>>"))
    lines = lambda b: F.coalesce(F.transform(b, lambda x: F.struct(x["text"].alias("text"), elements(x["elements"]).alias("elements"))), F.array().cast("array<struct<text:string,elements:array<struct<text:string>>>>"))
    return F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), frame(b["frame"]).alias("frame"), lines(b["lines"]).alias("lines")))


def text_regions(blocks: str) -> list:
    """Columns (text, x, y, width, height) of an array of recognised blocks, by inline."""
    return [F.inline(F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), *(F.coalesce(b["frame"][k], F.lit(0)).alias(n) for k, n in (("left", "x"), ("top", "y"), ("width", "width"), ("height", "height"))))))]
