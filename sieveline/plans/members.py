"""Queries on membership documents, holdout gates, candidates' tables, scorers and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.scorer import batch_scorer, clamp, percent, table_scorer
from ..operators import curate, evalmetrics, holdout, membership, similar
from ..sources.files import SOURCES, nested_blocks
from .corpus import LABELLED, SPLIT, TFIDF_SQL, _docs, _labelled, split_of
from .messages import MESSAGES, messages
from .metrics import DISTILL_SQL, PREDICTED, _families, predicted

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
AUTOMATED = holdout.FAMILIES["automated"]


def source_gates(spark, d) -> DataFrame:
    """The gates of each language's samples as a holdout; German ones have automated sources alone."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    rows = _labelled(spark, d).select("lang", "label", F.when(F.col("lang") == "de", pick(AUTOMATED)).otherwise(pick(SOURCES)).alias("source"))
    out = None
    for lang in ("en", "fr", "de", "es"):
        one = holdout.source_gates(rows.where(F.col("lang") == lang), rows=(20, 100_000_000), least_safe=10).select(F.lit(lang).alias("lang"), "*")
        out = one if out is None else out.union(one)
    return out


SOURCE_GATES_SQL = f"""WITH {LABELLED}, r AS (SELECT lang, label, CASE WHEN lang = 'de' THEN {_list(AUTOMATED)}[doc_id % {len(AUTOMATED)} + 1] ELSE {_list(SOURCES)}[doc_id % {len(SOURCES)} + 1] END AS source FROM labelled),
g AS (SELECT l.lang, count(r.lang) AS n_rows, CAST(count_if(label = 'safe') AS BIGINT) AS n_safe, coalesce(list(DISTINCT source) FILTER (source IS NOT NULL), []) AS s FROM (VALUES ('en'), ('fr'), ('de'), ('es')) l(lang) LEFT JOIN r USING (lang) GROUP BY l.lang),
f AS (SELECT *, {', '.join(f"list_has_any(s, {_list(v)}) AS {k}_" for k, v in holdout.FAMILIES.items())} FROM g)
SELECT lang, n_rows, n_safe, array_to_string(list_filter([{', '.join(f"CASE WHEN {k}_ THEN '{k}' END" for k in holdout.FAMILIES)}], lambda x: x IS NOT NULL), ',') AS families,
  len(list_filter(s, lambda x: NOT list_contains({_list(AUTOMATED)}, x))) = 0 AS automated_only, n_rows BETWEEN 20 AND 100000000 AND (public_ OR community_) AND n_safe >= 10 AS passed FROM f"""


def joined_candidates(spark, d) -> DataFrame:
    """Candidates that training, model and conversion tables know, ranked; those that failed have a reason."""
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("name", F.col("p_brand"))
    training = p.groupBy("name").agg(F.round(F.avg("p_size") / 50, 2).alias("f1"))
    info = p.groupBy("name").agg(F.count("*").alias("params"))
    ops = F.when(F.col("n") % 3 == 0, F.array(F.lit("FlexErf"), F.lit("FlexTile"))).otherwise(F.array().cast("array<string>"))
    conversion = p.groupBy("name").agg(F.min("p_size").alias("size"), F.round(F.min("p_retailprice"), 4).alias("p50"), F.count("*").alias("n"))
    conversion = conversion.where("name <> 'Brand#11'").select("name", "size", "p50", (F.col("n") % 4 != 0).alias("passed"), ops.alias("flex_ops"))
    ranked = evalmetrics.rank_candidates(evalmetrics.candidates(training, info, conversion))
    return ranked.select("name", "params", "rank", "reason")


CANDIDATES_SQL = """WITH c AS (SELECT p_brand AS name, round(avg(p_size) / 50, 2) AS f1, count(*) AS params, min(p_size) AS size, round(min(p_retailprice), 4) AS p50 FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1)
SELECT name, params, CASE WHEN params % 4 <> 0 THEN CAST(row_number() OVER (PARTITION BY params % 4 <> 0 ORDER BY f1 DESC, size, p50, name) AS INT) END AS rank,
  CASE WHEN params % 4 <> 0 THEN NULL WHEN params % 3 = 0 THEN 'flex ops: FlexErf, FlexTile' ELSE 'validation failed' END AS reason FROM c"""


def similarity_counts(spark, d) -> DataFrame:
    """How many pairs of a document and a holdout item are over each level of similarity."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    return similar.similarity_counts(similar.similar_pairs(_docs(spark, d), items, "doc_id", "item_id", "text", 0.45), 0.55, 0.85, 0.95)


def family_members(spark, d) -> DataFrame:
    return membership.members_of(_families(spark, d), 3)


def _people(spark, d) -> DataFrame:
    """Members with a name (every third none, every sixth an empty one) and an address (every fifth none)."""
    key = F.col("user_id")
    name = F.when(key % 6 == 0, "").when(key % 3 != 0, F.concat(F.lit("User "), key.cast("string")))
    mail = F.when(key % 5 != 0, F.concat(F.lit("u"), key.cast("string"), F.lit("@example.com")))
    return _families(spark, d).where("family_id is not null").select("user_id", "family_id", name.alias("display_name"), mail.alias("email"))


_PEOPLE = "people AS (SELECT user_id, user_id // 7 AS family_id, CASE WHEN user_id % 6 = 0 THEN '' WHEN user_id % 3 <> 0 THEN 'User ' || user_id END AS display_name, CASE WHEN user_id % 5 <> 0 THEN 'u' || user_id || '@example.com' END AS email FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 7 <> 0)"


def member_profiles(spark, d) -> DataFrame:
    """Each customer's profile as a user: member or not, title, and scans if there are any."""
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    scans = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("views"))
    found = membership.member_lookup(wanted, _people(spark, d), scans)
    title = F.when(F.col("found"), membership.member_title(F.col("display_name"), F.col("email")))
    return found.select("user_id", "found", "has_activity", title.alias("title"), F.when(F.col("has_activity"), F.col("views")).alias("views"))


PROFILES_SQL = f"""WITH {_PEOPLE}, v AS (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT c_custkey AS user_id, p.user_id IS NOT NULL AS found, p.user_id IS NOT NULL AND v.user_id IS NOT NULL AS has_activity,
  CASE WHEN p.user_id IS NOT NULL THEN coalesce(nullif(display_name, ''), nullif(email, ''), 'Member Profile') END AS title, CASE WHEN p.user_id IS NOT NULL THEN views END AS views
FROM customer LEFT JOIN people p ON p.user_id = c_custkey LEFT JOIN v ON v.user_id = c_custkey"""


def invite_lookup(spark, d) -> DataFrame:
    """Customers who try a code, in lower case, that is some nation's or none's; two nations may share one."""
    code = lambda k: F.upper(F.substring(F.md5((k % 20).cast("string")), 1, 8))
    families = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("family_id"), code(F.col("n_nationkey")).alias("invite_code"))
    key = F.col("c_custkey")
    attempts = spark.read.parquet(f"{d}/customer.parquet").select(key.alias("user_id"), F.lower(F.substring(F.md5((key % 30).cast("string")), 1, 8)).alias("code"), (key % 4 == 0).alias("has_family"))
    return membership.invited(attempts, families).select("user_id", "family_id", "reason")


INVITE_SQL = """WITH f AS (SELECT upper(md5(CAST(n_nationkey % 20 AS VARCHAR))[1:8]) AS code, min(n_nationkey) AS family FROM nation GROUP BY 1)
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 <> 0 THEN family END AS family_id, CASE WHEN c_custkey % 4 = 0 THEN 'already in a family' WHEN family IS NULL THEN 'invalid invite code' END AS reason
FROM customer LEFT JOIN f ON f.code = upper(md5(CAST(c_custkey % 30 AS VARCHAR))[1:8])"""


def invite_codes(spark, d) -> DataFrame:
    """A code for each customer's family that no nation's has."""
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    taken = spark.read.parquet(f"{d}/nation.parquet").select(F.upper("n_name").alias("invite_code"))
    return membership.with_unique_codes(customers, "c_custkey", taken)


INVITE_CODES_SQL = "SELECT c_custkey, array_to_string(list_transform(range(8), lambda k: 'ABCDEFGHJKLMNPQRSTUVWXYZ23456789'[CAST('0x' || sha256(c_custkey || ':0')[1 + 2 * k : 2 + 2 * k] AS INT) % 32 + 1]), '') AS invite_code FROM customer"


def merged_documents(spark, d) -> DataFrame:
    """Customers' documents after events as updates: last action, added value, tags gained by views and lost by errors; unknown users get a document."""
    docs = spark.read.parquet(f"{d}/customer.parquet").select((2 * F.col("c_custkey")).alias("user_id"), F.lit("none").alias("last"), F.lit(5).cast("long").alias("n"), F.array(F.lit("view"), F.lit("vip")).alias("tags"))
    kind = F.col("event_type")
    updates = spark.read.parquet(f"{d}/events.parquet").select(
        "user_id", "event_id", F.when(kind != "view", kind).alias("last"), F.lit(1).cast("long").alias("n"),
        F.when(kind == "click", F.array(kind, F.lit("vip"))).alias("union_tags"), F.when(kind == "error", F.array(F.lit("vip"))).alias("remove_tags"),
    )
    out = membership.merged(docs, updates, "user_id", "event_id", ("last",), ("n",), ("tags",), ("tags",))
    return out.select("user_id", "last", "n", F.array_join("tags", ",").alias("tags"))


MERGED_SQL = """WITH u AS (SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS last, count(*) AS n, bool_or(event_type = 'click') AS click, bool_or(event_type = 'error') AS error FROM events GROUP BY 1),
d AS (SELECT 2 * c_custkey AS user_id FROM customer)
SELECT coalesce(d.user_id, u.user_id) AS user_id, coalesce(u.last, CASE WHEN d.user_id IS NOT NULL THEN 'none' END) AS last, CASE WHEN d.user_id IS NOT NULL THEN 5 ELSE 0 END + coalesce(n, 0) AS n,
  array_to_string(list_filter([CASE WHEN d.user_id IS NOT NULL THEN 'view' END, CASE WHEN d.user_id IS NOT NULL AND NOT coalesce(error, false) THEN 'vip' END, CASE WHEN click THEN 'click' END, CASE WHEN d.user_id IS NULL AND click AND NOT error THEN 'vip' END], lambda x: x IS NOT NULL), ',') AS tags
FROM d FULL JOIN u ON d.user_id = u.user_id"""


def missing_documents(spark, d) -> DataFrame:
    """Activity documents after the default ones are made for users that have none; reports of unknown users can't be recorded."""
    log = spark.read.parquet(f"{d}/events.parquet")
    c = membership.DEFAULTS
    have = log.where("event_type = 'error'").groupBy("user_id").agg(*(F.count("*").alias(n) for n in c))
    every = membership.with_missing(log.select("user_id"), have)
    failed = membership.unmatched(have, log.where("event_type = 'purchase'"), "user_id").groupBy("user_id").agg(F.count("*").alias("failed"))
    return every.join(failed, "user_id", "left").select("user_id", "total_scans", "active_days", F.coalesce("failed", F.lit(0)).alias("failed"))


MISSING_SQL = "WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS n, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1) SELECT user_id, n AS total_scans, CASE WHEN n = 0 THEN 1 ELSE n END AS active_days, CASE WHEN n = 0 THEN p ELSE 0 END AS failed FROM e"


def vectors_by_split(spark, d) -> DataFrame:
    """Rows by source in each split, for every source that any split has."""
    s = split_of(_docs(spark, d).select("doc_id", "lang", "source")).withColumn("source", F.concat_ws("/", "lang", "source", (F.col("doc_id") % 40).cast("string")))
    return holdout.counts_by_split({x: holdout.split_of(s, x) for x in ("train", "val", "test")}, "source")


VECTORS_SQL = f"WITH {SPLIT}, k AS (SELECT split, s.lang || '/' || source || '/' || doc_id % 40 AS source FROM splits s JOIN documents USING (doc_id)) SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM k GROUP BY source"


def overridden_samples(spark, d) -> DataFrame:
    rows = _labelled(spark, d).withColumn("vector", F.col("source"))
    return holdout.overridden(rows, F.when(F.col("doc_id") % 2 == 0, "phishing").otherwise("tech_support"), F.lit("scam")).groupBy("vector", "label").agg(F.count("*").alias("n"))


def class_ratio(spark, d) -> DataFrame:
    return holdout.class_ratio(_labelled(spark, d), "label", "safe", "scam")


def phase_b_loss(spark, d) -> DataFrame:
    rows = predicted(spark, d).withColumn("h0", F.col("z0") * 0.5).withColumn("h1", F.col("z1") * 0.8)
    rows = rows.withColumn("hidden", (F.col("doc_id") % 13) / F.lit(1000.0)).withColumn("attention", (F.col("doc_id") % 7) / F.lit(10.0))
    return evalmetrics.phase_b_loss(rows, ("z0", "z1"), ("h0", "h1"), "label", "hidden", "attention").select(F.round("loss", 6).alias("loss"))


PHASE_B_SQL = DISTILL_SQL.replace("round(avg(", "avg(").replace("END), 6) AS loss FROM l", "END) AS loss FROM l")
PHASE_B_SQL = PHASE_B_SQL[: PHASE_B_SQL.rindex("SELECT avg(")] + f"SELECT round(({PHASE_B_SQL[PHASE_B_SQL.rindex('SELECT avg(') :]}) + 100 * (SELECT avg((doc_id % 13) / 1000.0::DOUBLE) FROM p) + (SELECT avg((doc_id % 7) / 10.0::DOUBLE) FROM p), 6) AS loss"


def intent_soft_labels(spark, d) -> DataFrame:
    rows = predicted(spark, d).select("doc_id", F.array("z0", "z1", F.col("z0") - F.col("z1")).alias("z"))
    return evalmetrics.intent_soft_labels(rows, "doc_id", "z").select("doc_id", "t", *(F.round(F.col("intents")[k], 9).alias(f"i{k}") for k in range(3)))


INTENTS_SQL = f"WITH {PREDICTED} SELECT doc_id, t, round(1 / (1 + exp(-z0 / t)), 9) AS i0, round(1 / (1 + exp(-z1 / t)), 9) AS i1, round(1 / (1 + exp(-(z0 - z1) / t)), 9) AS i2 FROM p, (VALUES (2.0::DOUBLE), (3.0::DOUBLE), (4.0::DOUBLE), (5.0::DOUBLE)) v(t)"


def best_sweep_row(spark, d) -> DataFrame:
    """The threshold with the best F1; of equal ones the lowest."""
    rows = predicted(spark, d).select("label", "score", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("tenths"))
    counts = rows.groupBy("tenths").agg(*evalmetrics.confusion_columns(F.col("label"), (F.col("score") > F.col("tenths") / 10).cast("int")))
    swept = evalmetrics.with_prf(counts).select("tenths", F.round("f1", 6).alias("f1"))
    return evalmetrics.best_of_sweep(swept, "f1", "tenths")


SWEEP_SQL = f"WITH {PREDICTED}, c AS (SELECT a AS tenths, count(*) FILTER (label = 1 AND score > a / 10) AS tp, count(*) FILTER (label = 0 AND score > a / 10) AS fp, count(*) FILTER (label = 1 AND score <= a / 10) AS fn FROM p, (SELECT unnest(range(1, 10)) AS a) GROUP BY a) SELECT CAST(tenths AS INT) AS tenths, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) AS f1 FROM c ORDER BY 2 DESC, 1 LIMIT 1"


def scored_by_table(spark, d) -> DataFrame:
    """Scores of parts from a table that lacks every fourth, clamped, and as shown."""
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    scores = parts.where("p_partkey % 4 <> 0").select("p_partkey", ((F.col("p_partkey") % 15) / 10 - 0.2).alias("s"))
    scored = table_scorer(scores, "p_partkey", "s", 0.5)(parts, "p_name", "score")
    return scored.select("p_partkey", "score", percent(F.floor(F.col("score") * 1000) / 1000).alias("shown"))


TABLE_SCORES_SQL = "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0.5::DOUBLE ELSE greatest(0, least(1, (p_partkey % 15) / 10 - 0.2::DOUBLE)) END AS score FROM part) SELECT p_partkey, score, printf('%.1f%%', floor(score * 1000) / 1000 * 100) AS shown FROM s"


def scored_by_batch(spark, d) -> DataFrame:
    """A scorer that takes batches of texts: a hundredth of a name's length, 1 at most."""
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    return batch_scorer(lambda texts: [len(t) / 20 for t in texts])(parts, "p_name", "score").select("p_partkey", "score")


def text_results(spark, d) -> DataFrame:
    """Result of a message by its text alone; a blank one's is fixed."""
    rows = messages(spark, d).select("o_orderkey", scoring.text_analysis(F.col("msg"), (F.col("o_orderkey") % 101) / F.lit(100.0)).alias("r"))
    return rows.select("o_orderkey", "r.*")


_SAY = "CASE WHEN s < 0.3 THEN '{}' WHEN s < 0.5 THEN '{}' WHEN s < 0.7 THEN '{}' WHEN s < 0.85 THEN '{}' ELSE '{}' END"
TEXT_RESULTS_SQL = f"""WITH {MESSAGES}, b AS (SELECT o_orderkey, msg = '' AS blank, (o_orderkey % 101) / 100.0::DOUBLE AS s FROM m)
SELECT o_orderkey, NOT blank AND s > 0.5 AS is_scam, CASE WHEN blank THEN 0 WHEN s > 0.5 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN blank OR s < 0.3 THEN 'low' WHEN s < 0.5 THEN 'medium' WHEN s < 0.7 THEN 'high' ELSE 'critical' END AS risk_level,
  CASE WHEN blank THEN 0 ELSE s END AS text_score, CASE WHEN blank THEN 0 ELSE s END AS fused_score, CASE WHEN blank THEN '{scoring.NO_TEXT}' ELSE {{say}} END AS explanation FROM b"""


def _said() -> str:
    from ..functions.fusion import BANDS

    return _SAY.format(*BANDS)


def ordered_sources(spark, d) -> DataFrame:
    """Names of three tables one after the other, with the table's ordinal; the last has no key."""
    r = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return membership.concatenated(r, n, n.where("k < 3").select("name"))


def recognised_blocks(spark, d) -> DataFrame:
    """Blocks of a recogniser's output with defaults, by counts: parts stand for blocks, some without frame or lines."""
    key = F.col("p_partkey")
    elements = F.when(key % 5 != 0, F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: F.struct(k.cast("string").alias("text"))))
    lines = F.when(key % 3 != 0, F.transform(F.sequence(F.lit(1), (key % 4 + 1).cast("int")), lambda k: F.struct(F.concat(F.lit("l"), k.cast("string")).alias("text"), elements.alias("elements"))))
    frame = F.when(key % 2 == 0, F.struct((key % 10).cast("int").alias("left"), F.lit(2).alias("top"), F.lit(3).alias("width"), F.lit(4).alias("height")))
    rows = spark.read.parquet(f"{d}/part.parquet").select(key, F.array(F.struct(F.col("p_name").alias("text"), frame.alias("frame"), lines.alias("lines"))).alias("blocks"))
    b = rows.select("p_partkey", F.explode(nested_blocks("blocks")).alias("b"))
    n_elements = F.aggregate("b.lines", F.lit(0), lambda a, x: a + F.size(x["elements"]))
    return b.select("p_partkey", "b.text", "b.frame.left", "b.frame.width", F.size("b.lines").alias("n_lines"), n_elements.alias("n_elements"))


BLOCKS_SQL = "SELECT p_partkey, p_name AS text, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 10 ELSE 0 END AS INT) AS left, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS width, CAST(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 4 + 1 ELSE 0 END AS INT) AS n_lines, CAST(CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN 2 * (p_partkey % 4 + 1) ELSE 0 END AS INT) AS n_elements FROM part"


def fenced_values(spark, d) -> DataFrame:
    """A number out of JSON with a code fence around it (every other), or out of broken JSON (every seventh)."""
    key = F.col("p_partkey").cast("string")
    said = F.when(F.col("p_partkey") % 7 == 0, "{broken").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('```json\n{"a": '), key, F.lit("}\n```"))).otherwise(F.concat(F.lit(' {"a": '), key, F.lit("} ")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.fenced_json(said, "a long")["a"].alias("a"))


def clamped(spark, d) -> DataFrame:
    return predicted(spark, d).select("doc_id", clamp(F.when(F.col("doc_id") % 9 != 0, F.col("z1"))).alias("p"))


QUERIES = {
    "source_gates": (source_gates, SOURCE_GATES_SQL),
    "joined_candidates": (joined_candidates, CANDIDATES_SQL),
    "similarity_counts": (similarity_counts, f"WITH q AS ({TFIDF_SQL.replace('>= 0.4', '>= 0.45').replace('round(sum(a.w * b.w), 5)', 'sum(a.w * b.w)')}) SELECT level, (SELECT count(*) FROM q WHERE similarity > level) AS n_pairs FROM (VALUES (0.55::DOUBLE), (0.85::DOUBLE), (0.95::DOUBLE)) v(level)"),
    "family_members": (family_members, "SELECT DISTINCT user_id, user_id // 7 AS family_id FROM events WHERE user_id % 7 <> 0 AND user_id // 7 = 3"),
    "member_profiles": (member_profiles, PROFILES_SQL),
    "invite_lookup": (invite_lookup, INVITE_SQL),
    "invite_codes": (invite_codes, INVITE_CODES_SQL),
    "merged_documents": (merged_documents, MERGED_SQL),
    "missing_documents": (missing_documents, MISSING_SQL),
    "vectors_by_split": (vectors_by_split, VECTORS_SQL),
    "overridden_samples": (overridden_samples, f"WITH {LABELLED} SELECT CASE WHEN doc_id % 2 = 0 THEN 'phishing' ELSE 'tech_support' END AS vector, 'scam' AS label, count(*) AS n FROM labelled GROUP BY 1"),
    "class_ratio": (class_ratio, f"WITH {LABELLED} SELECT count_if(label = 'safe') / nullif(count_if(label = 'scam'), 0) AS ratio FROM labelled"),
    "phase_b_loss": (phase_b_loss, PHASE_B_SQL),
    "intent_soft_labels": (intent_soft_labels, INTENTS_SQL),
    "best_sweep_row": (best_sweep_row, SWEEP_SQL),
    "scored_by_table": (scored_by_table, TABLE_SCORES_SQL),
    "scored_by_batch": (scored_by_batch, "SELECT p_partkey, least(1, length(p_name) / 20) AS score FROM part"),
    "text_results": (text_results, TEXT_RESULTS_SQL.replace("{say}", _said())),
    "ordered_sources": (ordered_sources, "SELECT r_regionkey AS k, r_name AS name, 0 AS source_ordinal FROM region UNION ALL SELECT n_nationkey, n_name, 1 FROM nation UNION ALL SELECT NULL, n_name, 2 FROM nation WHERE n_nationkey < 3"),
    "recognised_blocks": (recognised_blocks, BLOCKS_SQL),
    "fenced_values": (fenced_values, "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS a FROM part"),
    "clamped": (clamped, f"WITH {PREDICTED} SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN greatest(0, least(1, z1)) END AS p FROM p"),
}
