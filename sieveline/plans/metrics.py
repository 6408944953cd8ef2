"""Evaluation, benchmark, activity and membership queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, evalmetrics
from ..sources.shared import shared_path

# Predictions are functions of the key: a score, and logits z0 and z1.
_SCORE = "((doc_id * 7919) % 1000) / 1000.0"
PREDICTED = f"""p AS (SELECT l.doc_id, lang, source, toxic AS label, CASE WHEN toxic = 1 THEN 0.3::DOUBLE ELSE 0::DOUBLE END + 0.7::DOUBLE * ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS score,
  (doc_id % 37) / 10.0::DOUBLE - 1.5::DOUBLE AS z0, (doc_id % 41) / 10.0::DOUBLE - 2.0::DOUBLE + toxic AS z1 FROM labels l JOIN documents d USING (doc_id))"""


def predicted(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    rows = spark.read.parquet(f"{d}/labels.parquet").join(docs, "doc_id").withColumn("label", F.col("toxic"))
    score = F.when(F.col("toxic") == 1, 0.3).otherwise(0.0) + F.lit(0.7) * ((F.col("doc_id") * 7919) % 1000) / F.lit(1000.0)
    return rows.select("doc_id", "lang", "source", "label", score.alias("score"), ((F.col("doc_id") % 37) / F.lit(10.0) - 1.5).alias("z0"), ((F.col("doc_id") % 41) / F.lit(10.0) - 2.0 + F.col("toxic")).alias("z1"))


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else c for c in df.columns])


def confusion(spark, d):
    return evalmetrics.confusion(predicted(spark, d), "label", "score")


_CELLS = "CAST(count_if(label = 0 AND score <= 0.5) AS BIGINT) AS tn, CAST(count_if(label = 0 AND score > 0.5) AS BIGINT) AS fp, CAST(count_if(label = 1 AND score <= 0.5) AS BIGINT) AS fn, CAST(count_if(label = 1 AND score > 0.5) AS BIGINT) AS tp"
_P, _R = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END", "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END"
_F1 = "CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END"


def prf(spark, d):
    return _r(evalmetrics.with_prf(confusion(spark, d)), "precision", "recall", "f1", "accuracy")


def per_slice(spark, d):
    return _r(evalmetrics.per_slice(predicted(spark, d), "source", "label", "score"), "precision", "recall", "f1")


def classification_report(spark, d):
    rows = predicted(spark, d).withColumn("said", (F.col("score") > 0.5).cast("int"))
    return _r(evalmetrics.classification_report(rows, "label", "said"), "precision", "recall", "f1")


REPORT_SQL = f"""WITH {PREDICTED}, y AS (SELECT CAST(label AS VARCHAR) AS y, CAST(CAST(score > 0.5 AS INT) AS VARCHAR) AS s FROM p), k AS (SELECT y AS class FROM y UNION SELECT s FROM y),
c AS (SELECT class, (SELECT count(*) FROM y WHERE y.y = class) AS support, (SELECT count(*) FROM y WHERE y.s = class) AS said, (SELECT count(*) FROM y WHERE y.y = class AND y.s = class) AS hit FROM k),
m AS (SELECT class, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, support FROM c),
f AS (SELECT class, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"""


def roc_auc(spark, d):
    return _r(evalmetrics.roc_auc(predicted(spark, d), "label", "score"), "auc")


def ece(spark, d):
    return _r(evalmetrics.ece(predicted(spark, d), "label", "score"), "ece")


def reliability(spark, d):
    return _r(evalmetrics.reliability(predicted(spark, d), "label", "score"), "mean_score", "positive_rate")


def soft_labels(spark, d):
    return _r(evalmetrics.soft_labels(predicted(spark, d), "doc_id", "z0", "z1"), "p_safe", "p_scam")


def _ece_sql(p: str) -> str:
    return f"SELECT greatest({p}, 1 - {p}) AS c, CASE WHEN CAST({p} > 0.5 AS INT) = label THEN 1.0::DOUBLE ELSE 0 END AS r"


def temperature_sweep(spark, d):
    rows = predicted(spark, d).withColumn("z", F.col("z1") - F.col("z0"))
    return _r(evalmetrics.temperature_sweep(rows, "label", "z"), "ece")


SWEEP = f"""{PREDICTED}, x AS (SELECT label, k / 10.0::DOUBLE AS t, 1 / (1 + exp(-(z1 - z0) / (k / 10.0::DOUBLE))) AS q FROM p, (SELECT unnest(range(5, 51)) AS k)),
y AS (SELECT t, greatest(q, 1 - q) AS c, CASE WHEN CAST(q > 0.5 AS INT) = label THEN 1.0::DOUBLE ELSE 0 END AS r FROM x),
g AS (SELECT t, greatest(ceil(c * 15) - 1, 0) AS b, count(*) AS n, avg(r) AS acc, avg(c) AS conf FROM y GROUP BY ALL),
e AS (SELECT t, sum(n * abs(acc - conf)) / sum(n) AS ece FROM g GROUP BY t)"""


def best_temperature(spark, d):
    return evalmetrics.best_temperature(predicted(spark, d).withColumn("z", F.col("z1") - F.col("z0")), "label", "z")


def distillation_loss(spark, d):
    rows = predicted(spark, d).withColumn("h0", F.col("z0") * 0.5).withColumn("h1", F.col("z1") * 0.8)
    return _r(evalmetrics.distillation_loss(rows, ("z0", "z1"), ("h0", "h1"), "label"), "loss")


DISTILL_SQL = f"""WITH {PREDICTED}, q AS (SELECT label, z0 / 3 AS a0, z1 / 3 AS a1, z0 * 0.5::DOUBLE / 3 AS b0, z1 * 0.8::DOUBLE / 3 AS b1, z0 * 0.5::DOUBLE AS h0, z1 * 0.8::DOUBLE AS h1 FROM p),
l AS (SELECT label, a0 - ln(exp(a0) + exp(a1)) AS t0, a1 - ln(exp(a0) + exp(a1)) AS t1, b0 - ln(exp(b0) + exp(b1)) AS s0, b1 - ln(exp(b0) + exp(b1)) AS s1, h0 - ln(exp(h0) + exp(h1)) AS c0, h1 - ln(exp(h0) + exp(h1)) AS c1 FROM q)
SELECT round(avg(0.7::DOUBLE * 9 * (exp(t0) * (t0 - s0) + exp(t1) * (t1 - s1)) + 0.3::DOUBLE * -CASE WHEN label = 1 THEN c1 ELSE c0 END), 6) AS loss FROM l"""


def dual_head_loss(spark, d):
    rows = predicted(spark, d).withColumn("x", F.array("z0", "z1")).withColumn("y", F.when(F.col("doc_id") % 3 != 0, F.array(F.lit(1.0), F.lit(0.0))))
    return _r(evalmetrics.dual_head_loss(rows, ("z0", "z1"), "label", "x", "y"), "loss")


_BCE = lambda x, y: f"(greatest({x}, 0) - {x} * {y} + ln(1 + exp(-abs({x}))))"
DUAL_SQL = f"WITH {PREDICTED}, c AS (SELECT *, ln(exp(z0) + exp(z1)) - CASE WHEN label = 1 THEN z1 ELSE z0 END AS ce FROM p) SELECT round(avg(CASE WHEN doc_id % 3 = 0 THEN ce ELSE 0.7::DOUBLE * ce + 0.3::DOUBLE * ({_BCE('z0', '1')} + {_BCE('z1', '0')}) / 2 END), 6) AS loss FROM c"


def class_weights(spark, d):
    return _r(evalmetrics.class_weights(predicted(spark, d), "label"), "weight")


def running_loss(spark, d):
    """Each order is a batch of one of 97 epochs, with a soft, a hard and a total loss."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") % 97).alias("epoch"), "l_orderkey").agg(F.avg("l_discount").alias("soft"), F.avg("l_tax").alias("hard"))
    rows = rows.withColumn("total", F.lit(0.7) * F.col("soft") + F.lit(0.3) * F.col("hard"))
    return _r(evalmetrics.running_means(rows, "epoch", "l_orderkey", ("total", "soft", "hard")), "total", "soft", "hard", places=9)


def latency_percentiles(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    return _r(evalmetrics.latency(rows, "l_returnflag", "l_extendedprice"), "p50", "p95", "mean", places=4)


def rank_candidates(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    c = p.groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_size") / 50 + 1e-9, 2).alias("f1"), F.min("p_size").alias("size"), F.round(F.percentile("p_retailprice", 0.5), 4).alias("p50"), (F.count("*") % 5 != 0).alias("passed"))
    r = evalmetrics.rank_candidates(c)
    return r.select("name", "f1", "size", "p50", "rank", "reason")


# The event log: an error is a scan that found a scam, view and click are safe scans, purchase a report, signup an opening.
LOG = "e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'scam' WHEN 'view' THEN 'safe' WHEN 'click' THEN 'safe' WHEN 'purchase' THEN 'report' ELSE 'open' END AS kind FROM events)"


def log_of(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "scam").when(F.col("event_type").isin("view", "click"), "safe").when(F.col("event_type") == "purchase", "report").otherwise("open")
    return events.select("user_id", "ts", "event_id", kind.alias("kind"))


def _log(spark, d):
    return log_of(spark.read.parquet(f"{d}/events.parquet"))


def activity_counters(spark, d):
    c = activity.counters(_log(spark, d))
    return c.withColumn("last_active", F.date_format("last_active", "yyyy-MM-dd HH:mm:ss")).withColumn("risk_no_decay", F.least(F.lit(100).cast("long"), 5 * F.col("scams")))


def active_days(spark, d):
    return activity.active_days(_log(spark, d)).select("user_id", F.col("active_days").cast("long"))


def activity_fold_decay(spark, d):
    from ..functions.fusion import user_risk_band

    return activity.fold(activity.with_decay(_log(spark, d))).withColumn("band", user_risk_band(F.col("risk")))


FOLD_SQL = f"""WITH {LOG}, span AS (SELECT user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM e GROUP BY user_id),
dec AS (SELECT user_id, CAST(x AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS ts, 4611686018427387904 AS event_id, 'decay' AS kind FROM (SELECT user_id, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS x FROM span WHERE a < b)),
a AS (SELECT user_id, list(kind ORDER BY ts, event_id) AS k FROM (SELECT * FROM e UNION ALL SELECT * FROM dec) WHERE kind IN ('scam', 'decay') GROUP BY user_id),
f AS (SELECT user_id,
  list_reduce(list_prepend(0::BIGINT, list_transform(k, lambda x: CASE WHEN x = 'scam' THEN -1::BIGINT ELSE -2::BIGINT END)), lambda s, x: CASE WHEN x = -1 THEN s + 1 ELSE s * 9 // 10 END) AS recent,
  list_reduce(list_prepend(0::BIGINT, list_transform(k, lambda x: CASE WHEN x = 'scam' THEN -1::BIGINT ELSE -2::BIGINT END)), lambda s, x: CASE WHEN x = -1 THEN least(100, s + 5) ELSE greatest(0, s - 1) END) AS risk FROM a),
u AS (SELECT DISTINCT user_id FROM e)
SELECT user_id, CAST(coalesce(recent, 0) AS BIGINT) AS recent, CAST(coalesce(risk, 0) AS BIGINT) AS risk, CASE WHEN coalesce(risk, 0) >= 80 THEN 'High Risk' WHEN coalesce(risk, 0) >= 50 THEN 'Medium Risk' WHEN coalesce(risk, 0) >= 20 THEN 'Low Risk' ELSE 'Protected' END AS band FROM u LEFT JOIN f USING (user_id)"""


def recent_30d_window(spark, d):
    return activity.recent_window(_log(spark, d)).select("user_id", "event_id", F.col("scams_in_window").cast("long"))


def _families(spark, d) -> DataFrame:
    """Users with a family of up to six by key; every seventh has none."""
    u = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return u.withColumn("family_id", F.when(F.col("user_id") % 7 != 0, F.floor(F.col("user_id") / 7)))


def family_visibility(spark, d):
    users = _families(spark, d)
    return activity.visible(users.select("user_id"), users)


def family_removal(spark, d):
    users = _families(spark, d)
    members = users.where("family_id is not null").select("family_id", "user_id")
    families = members.select("family_id").distinct()
    u, m, f = activity.remove_families(users, members, families, families.where("family_id % 5 = 0"))
    return u.agg(F.count_if(F.col("family_id").isNull()).alias("without")).crossJoin(m.agg(F.count("*").alias("members"))).crossJoin(f.agg(F.count("*").alias("families")))


def membership_actions(spark, d):
    u = _families(spark, d)
    action = F.element_at(F.array(*map(F.lit, ("create", "join", "leave", "remove", "delete", "regenerate"))), (F.col("user_id") % 6 + 1).cast("int"))
    reason = activity.membership_reject_reason(action, F.col("family_id").isNotNull(), F.col("user_id") % 4 == 0, F.col("user_id") % 8 == 0)
    return u.select("user_id", action.alias("action"), F.coalesce(reason, F.lit("ok")).alias("reason"), activity.permissions(F.col("user_id"), F.col("user_id") - F.col("user_id") % 4).alias("p")).select("user_id", "action", "reason", "p.role", "p.can_invite", "p.can_leave")


QUERIES = {
    "confusion": (confusion, f"WITH {PREDICTED} SELECT {_CELLS} FROM p"),
    "prf": (prf, f"WITH {PREDICTED}, c AS (SELECT {_CELLS} FROM p), m AS (SELECT *, {_P} AS pr, {_R} AS re FROM c) SELECT tn, fp, fn, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round({_F1}, 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM m"),
    "per_slice_prf": (per_slice, f"WITH {PREDICTED}, c AS (SELECT source, {_CELLS}, count(*) AS n, count(DISTINCT label) AS k FROM p GROUP BY source), m AS (SELECT *, (tp + tn) / n AS acc, {_P} AS pr, {_R} AS re FROM c) SELECT source, n, round(CASE WHEN k = 1 THEN acc ELSE pr END, 6) AS precision, round(CASE WHEN k = 1 THEN acc ELSE re END, 6) AS recall, round(CASE WHEN k = 1 THEN acc ELSE {_F1} END, 6) AS f1, CASE WHEN n < 10 THEN '*' ELSE '' END AS note FROM m"),
    "classification_report": (classification_report, REPORT_SQL),
    "roc_auc": (roc_auc, f"WITH {PREDICTED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM p) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r"),
    "ece": (ece, f"WITH {PREDICTED}, x AS ({_ece_sql('score')} FROM p), g AS (SELECT greatest(ceil(c * 15) - 1, 0) AS b, count(*) AS n, avg(r) AS acc, avg(c) AS conf FROM x GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM g"),
    "reliability": (reliability, f"WITH {PREDICTED} SELECT CAST(len(list_filter(range(10), lambda k: k * 0.1::DOUBLE <= score)) - 1 AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_rate FROM p WHERE score >= 0 AND score < 1 GROUP BY 1"),
    "soft_labels": (soft_labels, f"WITH {PREDICTED} SELECT doc_id, t, round(exp(z0 / t) / (exp(z0 / t) + exp(z1 / t)), 6) AS p_safe, round(exp(z1 / t) / (exp(z0 / t) + exp(z1 / t)), 6) AS p_scam FROM p, (VALUES (2.0::DOUBLE), (3.0::DOUBLE), (4.0::DOUBLE), (5.0::DOUBLE)) v(t)"),
    "temperature_sweep": (temperature_sweep, f"WITH {SWEEP} SELECT t, round(ece, 6) AS ece FROM e"),
    "best_temperature": (best_temperature, f"WITH {SWEEP} SELECT t FROM e ORDER BY round(ece, 9), t LIMIT 1"),
    "distillation_loss": (distillation_loss, DISTILL_SQL),
    "dual_head_loss": (dual_head_loss, DUAL_SQL),
    "class_weights": (class_weights, f"WITH {PREDICTED} SELECT label, round((SELECT count(*) FROM p) / (2 * count(*)), 6) AS weight FROM p GROUP BY label"),
    "running_loss": (running_loss, "WITH b AS (SELECT l_orderkey % 97 AS epoch, l_orderkey, avg(l_discount) AS soft, avg(l_tax) AS hard FROM lineitem GROUP BY ALL), t AS (SELECT *, 0.7::DOUBLE * soft + 0.3::DOUBLE * hard AS total, row_number() OVER (PARTITION BY epoch ORDER BY l_orderkey) AS batch FROM b), r AS (SELECT epoch, batch, avg(total) OVER w AS total, avg(soft) OVER w AS soft, avg(hard) OVER w AS hard FROM t WINDOW w AS (PARTITION BY epoch ORDER BY batch ROWS UNBOUNDED PRECEDING)) SELECT epoch, 'log' AS kind, batch, round(total, 9) AS total, round(soft, 9) AS soft, round(hard, 9) AS hard FROM r WHERE batch % 50 = 0 UNION ALL SELECT epoch, 'epoch', count(*), round(avg(total), 9), round(avg(soft), 9), round(avg(hard), 9) FROM t GROUP BY epoch"),
    "latency_percentiles": (latency_percentiles, "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1"),
    "rank_candidates": (rank_candidates, "WITH c AS (SELECT p_brand AS name, round(avg(p_size) / 50 + 1e-9::DOUBLE, 2) AS f1, min(p_size) AS size, round(quantile_cont(p_retailprice, 0.5), 4) AS p50, count(*) % 5 <> 0 AS passed FROM part GROUP BY 1) SELECT name, f1, size, p50, CAST(row_number() OVER (ORDER BY f1 DESC, size, p50, name) AS INT) AS rank, NULL::VARCHAR AS reason FROM c WHERE passed UNION ALL SELECT name, f1, size, p50, NULL, 'validation failed' FROM c WHERE NOT passed"),
    "activity_counters": (activity_counters, f"WITH {LOG} SELECT user_id, CAST(count_if(kind IN ('scam', 'safe')) AS BIGINT) AS total_scans, CAST(count_if(kind = 'scam') AS BIGINT) AS scams, CAST(count_if(kind = 'report') AS BIGINT) AS reports, CAST(count_if(kind = 'open') AS BIGINT) AS opens, strftime(max(CASE WHEN kind <> 'report' THEN ts END), '%Y-%m-%d %H:%M:%S') AS last_active, CAST(least(100, 5 * count_if(kind = 'scam')) AS BIGINT) AS risk_no_decay FROM e GROUP BY user_id"),
    "active_days": (active_days, f"WITH {LOG}, l AS (SELECT user_id, kind, CAST(ts AS DATE) AS day, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e WHERE kind <> 'report') SELECT user_id, CAST(1 + count_if(kind = 'open' AND before IS NOT NULL AND before <> day) AS BIGINT) AS active_days FROM l GROUP BY user_id"),
    "activity_fold_decay": (activity_fold_decay, FOLD_SQL),
    "recent_window": (recent_30d_window, f"WITH {LOG}, s AS (SELECT user_id, event_id, kind, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM e WHERE kind IN ('scam', 'safe')) SELECT user_id, event_id, CAST(count_if(kind = 'scam') OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS BIGINT) AS scams_in_window FROM s"),
    "family_visibility": (family_visibility, "WITH u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 7 <> 0 THEN user_id // 7 END AS f FROM events) SELECT a.user_id AS reader, b.user_id FROM u a JOIN u b ON a.user_id = b.user_id OR a.f = b.f"),
    "family_removal": (family_removal, "WITH u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 7 <> 0 THEN user_id // 7 END AS f FROM events) SELECT count(*) FILTER (f IS NULL OR f % 5 = 0) AS without, count(*) FILTER (f IS NOT NULL AND f % 5 <> 0) AS members, count(DISTINCT f) FILTER (f % 5 <> 0) AS families FROM u"),
    "membership_actions": (membership_actions, "WITH u AS (SELECT DISTINCT user_id, user_id % 7 <> 0 AS has, ['create', 'join', 'leave', 'remove', 'delete', 'regenerate'][user_id % 6 + 1] AS action FROM events) SELECT user_id, action, CASE WHEN action IN ('create', 'join') AND has THEN 'already in a family' WHEN action IN ('remove', 'delete', 'regenerate') AND user_id % 4 <> 0 THEN 'not the admin' WHEN action = 'remove' AND user_id % 8 = 0 THEN 'admin can''t remove self' WHEN action = 'leave' AND user_id % 4 = 0 THEN 'admin can''t leave' ELSE 'ok' END AS reason, CASE WHEN user_id % 4 = 0 THEN 'admin' ELSE 'member' END AS role, user_id % 4 = 0 AS can_invite, user_id % 4 <> 0 AS can_leave FROM u"),
}


def wordpiece_encode(spark, d):
    """Encodings of order messages with the built-in vocabulary; the id list as text."""
    from ..functions.wordpiece import encode, fallback_vocabulary
    from .messages import messages

    e = encode(messages(spark, d).select("o_orderkey", "msg"), "msg", fallback_vocabulary())
    return e.select("o_orderkey", "token_count", F.concat_ws(",", "input_ids").alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


def activity_stream(spark, d):
    """The streaming fold over the events, run to the end of what there is; equals the batch fold without decay."""
    from ..streaming.activity import activity_stream as stream

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet")
    return finished(stream(log_of(source)), "user_id", shared_path(spark, "activity"))


def decaying_stream(spark, d):
    """The stream with daily decay over the events, which come in three parts of time, each a run from where the last one stopped."""
    from ..streaming.decay import decaying_activity, use_timers

    use_timers(spark)
    log, at = _log(spark, d), shared_path(spark, "decay")
    cuts = log.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(F.percentile_approx("us", [0.35, 0.7], 10_000).alias("q")).first()["q"] or [0, 0]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = None
    for part in (us <= cuts[0], (us > cuts[0]) & (us <= cuts[1]), us > cuts[1]):
        log.where(part).write.mode("append").parquet(f"{at}/in")
        source = spark.readStream.schema(log.schema).parquet(f"{at}/in")
        rows = finished(decaying_activity(source), "user_id", at)
    return rows.drop("late")


DECAYING_SQL = f"""WITH {LOG}, edge AS (SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) AS w FROM e),
span AS (SELECT user_id, min(CAST(ts AS DATE)) AS a, greatest(max(CAST(ts AS DATE)), any_value(w)) AS b FROM e, edge GROUP BY user_id),
dec AS (SELECT user_id, CAST(x AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS ts, 4611686018427387904 AS event_id, 'decay' AS kind FROM (SELECT user_id, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS x FROM span WHERE a < b)),
a AS (SELECT user_id, list(CASE WHEN kind = 'scam' THEN -1::BIGINT ELSE -2::BIGINT END ORDER BY ts, event_id) AS k FROM (SELECT * FROM e UNION ALL SELECT * FROM dec) WHERE kind IN ('scam', 'decay') GROUP BY user_id),
g AS (SELECT user_id, list_reduce(list_prepend(0::BIGINT, k), lambda s, x: CASE WHEN x = -1 THEN s + 1 ELSE s * 9 // 10 END) AS recent, list_reduce(list_prepend(0::BIGINT, k), lambda s, x: CASE WHEN x = -1 THEN least(100, s + 5) ELSE greatest(0, s - 1) END) AS risk FROM a),
l AS (SELECT user_id, kind, CAST(ts AS DATE) AS day, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e WHERE kind <> 'report'),
o AS (SELECT user_id, count_if(kind = 'open' AND before IS NOT NULL AND before <> day) AS n FROM l GROUP BY 1),
f AS (SELECT user_id, count_if(kind IN ('scam', 'safe')) AS total_scans, count_if(kind = 'scam') AS scams, count_if(kind = 'report') AS reports FROM e GROUP BY 1)
SELECT user_id, CAST(total_scans AS BIGINT) AS total_scans, CAST(scams AS BIGINT) AS scams, CAST(reports AS BIGINT) AS reports, CAST(coalesce(recent, 0) AS BIGINT) AS recent, CAST(coalesce(risk, 0) AS BIGINT) AS risk, CAST(1 + coalesce(n, 0) AS BIGINT) AS active_days FROM f LEFT JOIN g USING (user_id) LEFT JOIN o USING (user_id)"""


def finished(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Runs a stream of updates to the end of its source; its rows go into a table, a folder a batch, and each key's last one is what holds.

    A batch that runs again writes its own folder anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    table = rows.sparkSession.read.schema(f"{rows.schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, batch long").parquet(f"{at}/rows")
    return table.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*")


STREAM_SQL = f"""WITH {LOG}, f AS (SELECT user_id, count_if(kind IN ('scam', 'safe')) AS total_scans, count_if(kind = 'scam') AS scams, count_if(kind = 'report') AS reports FROM e GROUP BY 1),
l AS (SELECT user_id, kind, CAST(ts AS DATE) AS day, lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e WHERE kind <> 'report'),
a AS (SELECT user_id, count_if(kind = 'open' AND before IS NOT NULL AND before <> day) AS n FROM l GROUP BY 1)
SELECT user_id, CAST(total_scans AS BIGINT) AS total_scans, CAST(scams AS BIGINT) AS scams, CAST(reports AS BIGINT) AS reports, CAST(scams AS BIGINT) AS recent, CAST(least(100, 5 * scams) AS BIGINT) AS risk, CAST(1 + coalesce(n, 0) AS BIGINT) AS active_days FROM f LEFT JOIN a USING (user_id)"""
ADAPTIVE_SQL = f"""WITH {PREDICTED}, x AS (SELECT doc_id, lang, CAST(score > 0.5 AS INT) = label AS ok, greatest(score, 1 - score) AS c, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS block FROM p),
o AS (SELECT *, CASE WHEN ok AND c >= 0.6::DOUBLE THEN 0 ELSE 1 END AS out FROM x), full_blocks AS (SELECT count(*) // 100 AS n FROM x),
grid AS (SELECT lang, block FROM (SELECT DISTINCT lang FROM x), (SELECT unnest(range((SELECT n FROM full_blocks))) AS block)),
cum AS (SELECT g.lang, g.block, (SELECT count(*) FROM o WHERE o.lang = g.lang AND o.block <= g.block) AS n, (SELECT sum(out) FROM o WHERE o.lang = g.lang AND o.block <= g.block) AS out FROM grid g),
drops AS (SELECT lang, min(block) + 1 AS since FROM cum WHERE n > 0 AND out > n * 0.4::DOUBLE GROUP BY lang)
SELECT doc_id, ok AND c >= CASE WHEN since IS NOT NULL AND block >= since THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS kept FROM o LEFT JOIN drops USING (lang)"""


def _wordpiece_sql() -> str:
    """The built-in vocabulary has single characters alone: a word is its first character and one unknown for the rest."""
    from ..functions.wordpiece import fallback_vocabulary
    from .messages import MESSAGES

    plain = "".join(c for c in fallback_vocabulary() if len(c) == 1)
    literal = plain.replace("'", "''")
    mark = r"[.,!?;:''\"()\[\]{}<>@#$%^&*+=\-_/\\|`~]"
    word = f"{mark}|[^{mark[1:-1]}\\s]+"
    first = f"strpos('{literal}', w[1]) "
    return f"""WITH {MESSAGES}, w AS (SELECT o_orderkey, list_transform(regexp_extract_all(t, '{word}'), lambda w: CASE WHEN {first} = 0 THEN [100] WHEN length(w) = 1 THEN [103 + {first}] ELSE [103 + {first}, 100] END) AS p FROM t),
i AS (SELECT o_orderkey, list_concat([101], flatten(p), [102]) AS i FROM w), k AS (SELECT o_orderkey, CASE WHEN len(i) > 128 THEN list_concat(i[1:127], [102]) ELSE i END AS i FROM i)
SELECT o_orderkey, CAST(len(i) AS INT) AS token_count, array_to_string(list_concat(i, list_transform(range(128 - len(i)), lambda x: 0)), ',') AS ids, CAST(len(i) AS INT) AS mask_sum FROM k"""


def wordpiece_documents(spark, d):
    """Encodings of whole documents with some thousand pieces of a table; most words are of several pieces, rare ones hold unknowns."""
    from ..functions.wordpiece import encode, frequent_pieces, vocabulary_of
    from ..operators.ordering import spread

    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), 250_000)
    e = encode(docs, "text", vocabulary_of(frequent_pieces(docs, "text")))
    return e.select("doc_id", "token_count", F.concat_ws(",", "input_ids").alias("ids"), F.size(F.filter("input_ids", lambda k: k == 100)).alias("n_unknown"))


def _wordpiece_documents_sql() -> str:
    """All matches of pieces at all places of words, of which the longest are followed from the start of each word."""
    mark = r"[.,!?;:''\"()\[\]{}<>@#$%^&*+=\-_/\\|`~]"
    word = f"{mark}|[^{mark[1:-1]}\\s]+"
    return f"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(translate(nfc_normalize(lower(text)), 'аеорсухѕіјԁһԝʏαορτν', 'aeopcyxsijdhwyaoptv'), '\\s+', ' ', 'g')) AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(t, '{word}') AS ws FROM t),
u AS MATERIALIZED (SELECT DISTINCT unnest(ws) AS w FROM w),
pieces AS (SELECT w, unnest(list_distinct(list_concat(list_transform(range((length(w) - 1) // 3 + 1), lambda k: CASE WHEN k > 0 THEN '##' ELSE '' END || substr(w, 3 * k + 1, 3)), list_transform(range(length(w)), lambda k: CASE WHEN k > 0 THEN '##' ELSE '' END || substr(w, k + 1, 1))))) AS token FROM u),
vocab AS MATERIALIZED (SELECT token, 103 + row_number() OVER (ORDER BY token) AS id FROM (SELECT token FROM pieces GROUP BY token HAVING count(*) >= 5)),
places AS (SELECT w, unnest(range(length(w))) AS p FROM u),
slices AS (SELECT w, p, unnest(range(1, least(3, length(w) - p) + 1)) AS n FROM places),
best AS MATERIALIZED (SELECT w, p, max(n) AS n, arg_max(id, n) AS id FROM slices JOIN vocab ON token = CASE WHEN p > 0 THEN '##' ELSE '' END || substr(w, p + 1, n) GROUP BY w, p),
walk AS (SELECT w, CAST(0 AS BIGINT) AS p, []::BIGINT[] AS ids FROM u
  UNION ALL SELECT s.w, s.p + coalesce(b.n, 1), CASE WHEN b.id IS NOT NULL THEN list_append(s.ids, b.id) WHEN len(s.ids) > 0 AND s.ids[-1] = 100 THEN s.ids ELSE list_append(s.ids, 100) END FROM walk s LEFT JOIN best b ON b.w = s.w AND b.p = s.p WHERE s.p < length(s.w)),
done AS MATERIALIZED (SELECT w, ids FROM walk WHERE p = length(w)),
flat AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM w),
i AS (SELECT w.doc_id, list_concat([101], coalesce(f.i, []), [102]) AS i FROM w LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY k)) AS i FROM flat JOIN done USING (w) GROUP BY doc_id) f USING (doc_id)),
c AS (SELECT doc_id, CASE WHEN len(i) > 128 THEN list_concat(i[1:127], [102]) ELSE i END AS i FROM i)
SELECT doc_id, CAST(len(i) AS INT) AS token_count, array_to_string(list_concat(i, list_transform(range(128 - len(i)), lambda x: 0)), ',') AS ids, CAST(len(list_filter(i, lambda x: x = 100)) AS INT) AS n_unknown FROM c"""


def adaptive_filter(spark, d):
    """Rows kept by language under the adaptive threshold, checked every 100th row."""
    from ..operators.curate import adaptive_filter as run

    rows = predicted(spark, d).withColumn("said", (F.col("score") > 0.5).cast("int")).withColumn("confidence", F.greatest("score", 1 - F.col("score")))
    return run(rows, "doc_id", "lang", "label", "said", "confidence", 0.6, every=100).select("doc_id", "kept")


QUERIES |= {
    "wordpiece_encode": (wordpiece_encode, _wordpiece_sql()),
    "wordpiece_documents": (wordpiece_documents, _wordpiece_documents_sql()),
    "activity_stream": (activity_stream, STREAM_SQL),
    "decaying_stream": (decaying_stream, DECAYING_SQL),
    "adaptive_filter": (adaptive_filter, ADAPTIVE_SQL),
}
