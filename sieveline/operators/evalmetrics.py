"""Classifier evaluation: confusion, precision and recall, slices, AUC, calibration, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_total, running_totals


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion_columns(label: Column, predicted: Column) -> list[Column]:
    cell = lambda y, p: F.count_if((label == y) & (predicted == p))
    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp of score > threshold."""
    return df.agg(*confusion_columns(F.col(label), (F.col(score) > threshold).cast("int")))


def with_prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, accuracy to rows of confusion counts."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = df.withColumn("precision", p).withColumn("recall", r)
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def per_slice(df: DataFrame, by: str, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Metrics by slice; a slice with one true class reports accuracy for all three; note `*` under ten rows; f1 ascending."""
    predicted = (F.col(score) > threshold).cast("int")
    g = df.groupBy(by).agg(*confusion_columns(F.col(label), predicted), F.count("*").alias("n"), F.countDistinct(label).alias("classes"))
    m = with_prf(g)
    pick = lambda c: F.when(F.col("classes") == 1, F.col("accuracy")).otherwise(F.col(c)).alias(c)
    return m.select(by, "n", pick("precision"), pick("recall"), pick("f1"), F.when(F.col("n") < 10, "*").otherwise("").alias("note")).orderBy("f1", by)


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) of each class and of their plain and weighted means."""
    rows = df.groupBy(F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).count()
    side = rows.select(F.col("y").alias("class"), F.col("count").alias("support"), F.lit(0).alias("said"), F.when(F.col("y") == F.col("p"), F.col("count")).otherwise(0).alias("hit"))
    other = rows.select(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("count").alias("said"), F.lit(0).alias("hit"))
    per = side.unionByName(other).groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    per = per.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1", "support")
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")]
    macro = per.agg(*means, F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), "*")
    return per.unionByName(macro).unionByName(per.agg(*weighted, F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), "*"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc by the rank statistic. Scores are counted per value first, then summed in ranges."""
    by = df.groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = running_total(by, score, F.col("neg"), "below")
    u = below.withColumn("u", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return u.agg((F.sum("u") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def ece(df: DataFrame, label: str, score: str, bins: int = 15) -> DataFrame:
    """ece of a binary score: confidence of the predicted side, equal bins (lo, hi], mean gap weighted by rows."""
    conf = F.greatest(F.col(score), 1 - F.col(score))
    right = F.when((F.col(score) > 0.5).cast("int") == F.col(label), 1.0).otherwise(0.0)
    b = df.select(conf.alias("c"), right.alias("r")).withColumn("b", F.greatest(F.ceil(F.col("c") * bins) - 1, F.lit(0)))
    g = b.groupBy("b").agg(F.count("*").alias("n"), F.avg("r").alias("acc"), F.avg("c").alias("conf"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, positive_rate) over bins [lo, hi): a score of 1 is in none; empty bins are left out.

    Edges are k * (1 / bins), as equal steps of doubles are, and scores are compared with them: 0.3 stands under the
    fourth of ten, which is a little more.
    """
    edges = F.array(*(F.lit(k * (1.0 / bins)) for k in range(bins)))
    b = df.where((F.col(score) >= 0) & (F.col(score) < 1)).withColumn("bin", (F.size(F.filter(edges, lambda e: e <= F.col(score))) - 1).cast("int"))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("positive_rate"))


def soft_labels(df: DataFrame, key: str, z0: str, z1: str, temperatures: tuple[float, ...] = (2.0, 3.0, 4.0, 5.0)) -> DataFrame:
    """(key, t, p_safe, p_scam): softmax of two logits at each temperature, shifted by the larger."""
    t = df.select(key, z0, z1, F.explode(F.array(*map(F.lit, temperatures))).alias("t"))
    a, b = F.col(z0) / F.col("t"), F.col(z1) / F.col("t")
    m = F.greatest(a, b)
    ea, eb = F.exp(a - m), F.exp(b - m)
    return t.select(key, "t", (ea / (ea + eb)).alias("p_safe"), (eb / (ea + eb)).alias("p_scam"))


def temperature_sweep(df: DataFrame, label: str, z: str, lo: int = 5, hi: int = 50, bins: int = 15) -> DataFrame:
    """(t, ece) for t = lo/10 .. hi/10 of a logit difference z: one pass, bins counted per temperature before the shuffle."""
    x = df.select(label, z, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("k")).withColumn("t", F.col("k") / 10)
    p = 1 / (1 + F.exp(-F.col(z) / F.col("t")))
    x = x.withColumn("p", p).withColumn("c", F.greatest(F.col("p"), 1 - F.col("p"))).withColumn("r", F.when((F.col("p") > 0.5).cast("int") == F.col(label), 1.0).otherwise(0.0))
    g = x.withColumn("b", F.greatest(F.ceil(F.col("c") * bins) - 1, F.lit(0))).groupBy("t", "b").agg(F.count("*").alias("n"), F.avg("r").alias("acc"), F.avg("c").alias("conf"))
    return g.groupBy("t").agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def best_temperature(df: DataFrame, label: str, z: str) -> DataFrame:
    """The temperature with the least ece (to nine places); of equal ones the lowest."""
    return temperature_sweep(df, label, z).agg(F.min_by("t", F.struct(F.round("ece", 9), "t")).alias("t"))


def intent_soft_labels(df: DataFrame, key: str, logits: str, temperatures: tuple[float, ...] = (2.0, 3.0, 4.0, 5.0)) -> DataFrame:
    """(key, t, intents): the sigmoid of each of an array of logits at each temperature."""
    t = df.select(key, logits, F.explode(F.array(*map(F.lit, temperatures))).alias("t"))
    return t.select(key, "t", F.transform(logits, lambda z: 1 / (1 + F.exp(-z / F.col("t")))).alias("intents"))


def best_of_sweep(df: DataFrame, score: str, at: str) -> DataFrame:
    """The row of the sweep with the highest score; of equal ones the first by `at`."""
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(-F.col(score), F.col(at))).alias("r")).select("r.*")


def phase_b_loss(df: DataFrame, teacher: tuple[str, str], student: tuple[str, str], label: str, hidden: str, attention: str, t: float = 3.0, alpha: float = 0.7, beta: float = 100.0, gamma: float = 1.0) -> DataFrame:
    """loss: the distillation loss and the means of the hidden-state and attention losses, weighted by beta and gamma."""
    soft = distillation_loss(df, teacher, student, label, t, alpha)
    more = df.agg(F.avg(hidden).alias("h"), F.avg(attention).alias("a"))
    return soft.crossJoin(more).select((F.col("loss") + beta * F.col("h") + gamma * F.col("a")).alias("loss"))


def distillation_loss(df: DataFrame, teacher: tuple[str, str], student: tuple[str, str], label: str, t: float = 3.0, alpha: float = 0.7) -> DataFrame:
    """Mean of alpha * t^2 * KL(teacher || student) at temperature t and (1 - alpha) * cross-entropy."""

    def log_p(z: tuple[str, str], scale: float) -> tuple[Column, Column]:
        a, b = F.col(z[0]) / scale, F.col(z[1]) / scale
        m = F.greatest(a, b)
        total = m + F.log(F.exp(a - m) + F.exp(b - m))
        return a - total, b - total

    (t0, t1), (s0, s1), (h0, h1) = log_p(teacher, t), log_p(student, t), log_p(student, 1.0)
    kl = F.exp(t0) * (t0 - s0) + F.exp(t1) * (t1 - s1)
    ce = -F.when(F.col(label) == 1, h1).otherwise(h0)
    return df.agg(F.avg(alpha * t * t * kl + (1 - alpha) * ce).alias("loss"))


def dual_head_loss(df: DataFrame, z: tuple[str, str], label: str, intent_logits: str, intents: str) -> DataFrame:
    """Mean of 0.7 * cross-entropy and 0.3 * binary cross-entropy over an array of intents; without intents the first alone."""
    a, b = F.col(z[0]), F.col(z[1])
    m = F.greatest(a, b)
    ce = m + F.log(F.exp(a - m) + F.exp(b - m)) - F.when(F.col(label) == 1, b).otherwise(a)
    each = F.zip_with(intent_logits, intents, lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))))
    bce = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(intents)
    return df.agg(F.avg(F.when(F.col(intents).isNull(), ce).otherwise(0.7 * ce + 0.3 * bce)).alias("loss"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): total over twice the class's count."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.select(label, (F.sum("n").over(Window.partitionBy()) / (2 * F.col("n"))).alias("weight"))


def running_means(df: DataFrame, epoch: str, order: str, values: tuple[str, ...], every: int = 50, rows: int = 250_000) -> DataFrame:
    """(epoch, kind, batch, values ...): means of an epoch's batches so far, at every `every`-th batch (kind log), and of all of them (kind epoch).

    batch is a batch's ordinal in its epoch, from 1, by `order`, which is numeric and unique within an epoch; for an
    epoch's mean it is the number of its batches. An epoch of very many batches is added up in ranges.
    """
    so_far = running_totals(df, order, {"_n": F.lit(1).cast("long")} | {f"_{v}": F.col(v) for v in values}, (epoch,), rows)
    batch = F.col("_n") + 1
    logged = so_far.where(batch % every == 0).select(epoch, F.lit("log").alias("kind"), batch.alias("batch"), *(((F.col(f"_{v}") + F.col(v)) / batch).alias(v) for v in values))
    whole = df.groupBy(epoch).agg(F.count("*").alias("batch"), *(F.avg(v).alias(v) for v in values))
    return logged.unionByName(whole.select(epoch, F.lit("epoch").alias("kind"), "batch", *values))


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p95 (exact, interpolated) and mean by group."""
    mean = df.groupBy(by).agg(F.avg(value).alias("mean"))
    return percentiles(df, by, value, {"p50": 0.5, "p95": 0.95}).join(mean, by)


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, name ...): exact percentiles, interpolated between neighbours; nulls are left out.

    Equal values are counted first; running totals then tell at which ranks each value stands, so no group's values are
    held together.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    total = counts.groupBy("g").agg(F.sum("c").alias("n"))
    ranked = running_total(counts, "v", F.col("c"), "before", ("g",)).join(total, "g")
    out = []
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(share)
        holds = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("c")), F.col("v")))
        part = F.max(at - F.floor(at))
        out.append((holds(F.floor(at)) * (1 - part) + holds(F.ceil(at)) * part).alias(name))
    return ranked.groupBy(F.col("g").alias(by)).agg(*out)


def latest_checkpoint(names: DataFrame, state: DataFrame, by: str) -> DataFrame:
    """(by, latest) of rows (by, name): epoch_<n> of the epoch that state (by, epoch) names, if it is there, else the last as text orders names: epoch_9 comes after epoch_10."""
    named = names.join(state.select(by, F.concat(F.lit("epoch_"), F.col("epoch").cast("string")).alias("wanted")), by, "left")
    return named.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("name") == F.col("wanted"), F.col("name"))), F.max("name")).alias("latest"))


def candidates(training: DataFrame, info: DataFrame, conversion: DataFrame, name: str = "name") -> DataFrame:
    """Candidates that all three tables know, by name."""
    return training.join(info, name).join(conversion, name)


def rank_candidates(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds rank to candidates that passed validation: f1 descending, size, p50; ties by name. Others have a reason.

    Where df has flex_ops, an array of names, a candidate that failed with some of them is told so.
    """
    w = Window.orderBy(F.desc("f1"), "size", "p50", name)  # candidates are a handful of models
    reason = F.lit("validation failed")
    if "flex_ops" in df.columns:
        reason = F.when(F.size("flex_ops") > 0, F.concat(F.lit("flex ops: "), F.array_join("flex_ops", ", "))).otherwise(reason)
    passed = df.where("passed").withColumn("rank", F.row_number().over(w)).withColumn("reason", F.lit(None).cast("string"))
    failed = df.where("not passed").withColumn("rank", F.lit(None).cast("int")).withColumn("reason", reason)
    return passed.unionByName(failed)
