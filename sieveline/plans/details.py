"""Smaller operations: coverage of keyword groups, shares, lookups, orderings, losses, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evalmetrics
from ..operators.ordering import beside, numbered, running_totals
from .corpus import LABELLED, _docs, _labelled
from .metrics import _CELLS, PREDICTED, predicted

#: Keyword groups of hard negatives, chosen so that the driver's prose has some and lacks some.
GROUPS = {"first": ["thnt", "ingth"], "second": ["ciónos", "zzzz"], "third": ["nowhere", "to be found"]}


def hard_negatives(spark, d) -> DataFrame:
    """Which groups some safe text covers; keywords are compared in lower case on both sides."""
    low = F.lower("text")

    def any_of(words: list[str]):
        first, *rest = (low.contains(w.lower()) for w in words)
        for r in rest:
            first = first | r
        return first

    found = _labelled(spark, d).where("label = 'safe'").agg(*(F.bool_or(any_of(w)).alias(k) for k, w in GROUPS.items()))
    return found.unpivot([], list(GROUPS), "name", "found")


def source_share(spark, d) -> DataFrame:
    rows = _docs(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def model_consistency(spark, d) -> DataFrame:
    """Kept where the prediction equals the label and its confidence reaches the language's threshold."""
    thresholds = spark.createDataFrame([("en", 0.6), ("fr", 0.7)], "lang string, least double")
    rows = predicted(spark, d).join(F.broadcast(thresholds), "lang", "left")
    said, sure = (F.col("score") > 0.5).cast("int"), F.greatest(F.col("score"), 1 - F.col("score"))
    kept = (said == F.col("label")) & (sure >= F.coalesce("least", F.lit(0.5)))
    return rows.groupBy("lang").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("discarded"))


def progress_rates(spark, d) -> DataFrame:
    """Share kept so far, at every 100th labelled row by id."""
    rows = predicted(spark, d).select("doc_id", ((F.col("score") > 0.5).cast("int") == F.col("label")).cast("int").alias("ok"))
    run = running_totals(rows, "doc_id", {"r": F.lit(1).cast("long"), "kept": F.col("ok")})
    run = run.select((F.col("r") + 1).alias("n_rows"), (F.col("kept") + F.col("ok")).alias("kept")).where("n_rows % 100 = 0")
    return run.select("n_rows", F.round(F.col("kept") / F.col("n_rows"), 6).alias("rate"))


def head_fraction(spark, d) -> DataFrame:
    """The first fifth of the labelled rows by id."""
    rows = predicted(spark, d).select("doc_id")
    n = rows.agg(F.floor(F.count("*") / 5).alias("n"))
    return numbered(rows, "doc_id", "r").crossJoin(F.broadcast(n)).where("r <= n").select("doc_id")


def intent_lookup(spark, d) -> DataFrame:
    """Each document's intent vector by language, zeros where the language has none."""
    intents = spark.createDataFrame([("en", [1, 0, 0]), ("fr", [0, 1, 1])], "lang string, intents array<int>")
    rows = _docs(spark, d).select("doc_id", "lang").join(F.broadcast(intents), "lang", "left")
    return rows.select("doc_id", F.array_join(F.coalesce("intents", F.array(F.lit(0), F.lit(0), F.lit(0))), ",").alias("intents"))


def intent_metrics(spark, d) -> DataFrame:
    """Precision, recall and F1 of each intent that has positives; an intent is predicted above one half."""
    rows = predicted(spark, d).select("doc_id", F.col("score"), F.explode(F.array(*map(F.lit, (2, 3, 5, 10_000_019)))).alias("intent"))
    y = (F.col("doc_id") % F.col("intent") == 1).cast("int")
    p = (1 / (1 + F.exp(-(F.col("score") - 0.4) * F.col("intent") / 2)) > 0.5).cast("int")
    g = rows.groupBy("intent").agg(*evalmetrics.confusion_columns(y, p))
    return evalmetrics.with_prf(g.where("tp + fn > 0")).select("intent", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def positional_join(spark, d) -> DataFrame:
    """Soft label i beside sample i, both numbered by their own order."""
    samples = predicted(spark, d).select("doc_id")
    soft = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 10 / 10).alias("p"))
    return beside(samples, "doc_id", soft, "o_orderkey").select("doc_id", "p")


def latest_checkpoint(spark, d) -> DataFrame:
    """Each region's checkpoint: of the epoch that its state names, if there is one; else the last."""
    names = spark.read.parquet(f"{d}/nation.parquet").select("n_regionkey", F.concat(F.lit("epoch_"), F.col("n_nationkey").cast("string")).alias("name"))
    state = spark.read.parquet(f"{d}/region.parquet").where("r_regionkey <> 1").select(F.col("r_regionkey").alias("n_regionkey"), (F.col("r_regionkey") * 5).alias("epoch"))
    return evalmetrics.latest_checkpoint(names, state, "n_regionkey")


def best_epoch(spark, d) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", (F.col("l_linenumber")).alias("epoch")).agg(F.round(F.avg("l_quantity"), 6).alias("f1"))
    return rows.groupBy("l_returnflag").agg(F.max_by("epoch", F.struct("f1", -F.col("epoch"))).alias("epoch"))


def loss_balance(spark, d) -> DataFrame:
    """beta * hidden / (alpha * soft) of the first ten batches, with a warning outside 0.1 to 10."""
    rows = spark.read.parquet(f"{d}/part.parquet").orderBy("p_partkey").limit(10).select("p_partkey", (F.col("p_size") * 0.3).alias("hidden"), (F.col("p_retailprice") / 500).alias("soft"))
    ratio = F.col("hidden") / (0.7 * F.col("soft"))
    return rows.select("p_partkey", F.round(ratio, 6).alias("ratio"), ((ratio < 0.1) | (ratio > 10)).alias("warn"))


def grouped_mean(spark, d) -> DataFrame:
    """Sixteen values to four by the mean of each four in a row."""
    heads = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ((F.col("p_partkey") * 31 + k * 17) % 100).cast("double"))
    means = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: F.aggregate(F.slice("h", g * 4 + 1, F.lit(4)), F.lit(0.0), lambda a, x: a + x) / 4)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", heads.alias("h")).select("p_partkey", F.array_join(F.transform(means, lambda x: (x * 100).cast("long")), ",").alias("means"))


def prompts(spark, d) -> DataFrame:
    """A prompt per part, each parameter chosen by a hash of the key of its own."""
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), (F.conv(F.substring(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(salt))), 1, 6), 16, 10).cast("long") % len(xs) + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("Write a "), pick("t", ["calm", "pressing", "friendly"]), F.lit(" message by "), pick("c", ["sms", "email"]), F.lit(" about "), F.col("p_brand")).alias("prompt"))


_PICK = lambda salt, xs: f"[{', '.join(repr(x) for x in xs)}][CAST('0x' || md5(CAST(p_partkey AS VARCHAR) || '{salt}')[1:6] AS BIGINT) % {len(xs)} + 1]"


def display_names(spark, d) -> DataFrame:
    """A family's title: its name, else its owner's, else My; an empty name is none."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.lit(""))
    owner = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.coalesce(F.nullif(name, F.lit("")), F.concat(F.coalesce(F.nullif(owner, F.lit("")), F.lit("My")), F.lit("'s Family"))).alias("title"))


def discard_report(spark, d) -> DataFrame:
    """Kept and all rows by source, and the share kept."""
    rows = predicted(spark, d).withColumn("k", F.col("score") > 0.2)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("k").alias("kept"), F.round(100 * F.avg(F.col("k").cast("double")), 6).alias("pct"))


QUERIES = {
    "hard_negatives": (hard_negatives, f"WITH {LABELLED} " + " UNION ALL ".join(f"SELECT '{k}' AS name, bool_or({' OR '.join(f'contains(lower(text), {w!r})' for w in ws)}) AS found FROM labelled WHERE label = 'safe'" for k, ws in GROUPS.items())),
    "source_share": (source_share, "SELECT source, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source"),
    "model_consistency": (model_consistency, f"WITH {PREDICTED}, k AS (SELECT lang, CAST(score > 0.5 AS INT) = label AND greatest(score, 1 - score) >= CASE lang WHEN 'en' THEN 0.6::DOUBLE WHEN 'fr' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS k FROM p) SELECT lang, CAST(count_if(k) AS BIGINT) AS kept, CAST(count_if(NOT k) AS BIGINT) AS discarded FROM k GROUP BY lang"),
    "progress_rates": (progress_rates, f"WITH {PREDICTED}, r AS (SELECT row_number() OVER (ORDER BY doc_id) AS n_rows, sum(CAST(CAST(score > 0.5 AS INT) = label AS INT)) OVER (ORDER BY doc_id) AS kept FROM p) SELECT n_rows, round(kept / n_rows, 6) AS rate FROM r WHERE n_rows % 100 = 0"),
    "head_fraction": (head_fraction, f"WITH {PREDICTED} SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM p) WHERE r <= n // 5"),
    "intent_lookup": (intent_lookup, "SELECT doc_id, CASE lang WHEN 'en' THEN '1,0,0' WHEN 'fr' THEN '0,1,1' ELSE '0,0,0' END AS intents FROM documents"),
    "intent_metrics": (intent_metrics, f"WITH {PREDICTED}, x AS (SELECT i AS intent, CAST(doc_id % i = 1 AS INT) AS label, 1 / (1 + exp(-(score - 0.4::DOUBLE) * i / 2)) AS score FROM p, (VALUES (2), (3), (5), (10000019)) v(i)), c AS (SELECT intent, {_CELLS} FROM x GROUP BY intent), m AS (SELECT intent, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, tp / (tp + fn) AS re FROM c WHERE tp + fn > 0) SELECT intent, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM m"),
    "positional_join": (positional_join, f"WITH {PREDICTED}, a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM p), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderkey % 10 / 10 AS p FROM orders) SELECT doc_id, b.p FROM a JOIN b USING (i)"),
    "latest_checkpoint": (latest_checkpoint, "SELECT n_regionkey, coalesce(max('epoch_' || n_nationkey) FILTER (n_regionkey <> 1 AND n_nationkey = n_regionkey * 5), max('epoch_' || n_nationkey)) AS latest FROM nation GROUP BY 1"),
    "best_epoch": (best_epoch, "WITH e AS (SELECT l_returnflag, l_linenumber AS epoch, round(avg(l_quantity), 6) AS f1 FROM lineitem GROUP BY ALL) SELECT l_returnflag, epoch FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY f1 DESC, epoch) AS r FROM e) WHERE r = 1"),
    "loss_balance": (loss_balance, "WITH r AS (SELECT p_partkey, p_size * 0.3::DOUBLE / (0.7::DOUBLE * (p_retailprice / 500)) AS r FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 10)) SELECT p_partkey, round(r, 6) AS ratio, r < 0.1 OR r > 10 AS warn FROM r"),
    "grouped_mean": (grouped_mean, "SELECT p_partkey, array_to_string(list_transform(range(0, 4), lambda g: CAST(list_sum(list_transform(range(0, 4), lambda k: (p_partkey * 31 + (g * 4 + k) * 17) % 100)) * 25 AS BIGINT)), ',') AS means FROM part"),
    "prompts": (prompts, f"SELECT p_partkey, 'Write a ' || {_PICK('t', ['calm', 'pressing', 'friendly'])} || ' message by ' || {_PICK('c', ['sms', 'email'])} || ' about ' || p_brand AS prompt FROM part"),
    "display_names": (display_names, "SELECT c_custkey, coalesce(nullif(CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '' END, ''), coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, ''), 'My') || '''s Family') AS title FROM customer"),
    "discard_report": (discard_report, f"WITH {PREDICTED} SELECT source, count(*) AS n, CAST(count_if(score > 0.2) AS BIGINT) AS kept, round(100 * avg(CASE WHEN score > 0.2 THEN 1::DOUBLE ELSE 0 END), 6) AS pct FROM p GROUP BY source"),
}
