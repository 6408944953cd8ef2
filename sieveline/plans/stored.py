"""Queries that write rows, read them back and go on from there: formats, batches, documents, files by key, streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, wordpiece
from ..operators import curate, membership
from ..sources import files, store
from ..sources.shared import shared_path, written
from .corpus import _docs
from .metrics import _families, _log, finished, predicted

_IDS = "doc_id long, lang string, source string, n_chars long"


def strict_lines(spark, d) -> DataFrame:
    """Documents' metadata as JSON Lines and back, every line of which must be right."""
    at = shared_path(spark, "strict")
    files.write_lines(_docs(spark, d).select("doc_id", "lang", "source", "n_chars"), at)
    files.write_lines(_docs(spark, d).select("doc_id", "lang", "source", "n_chars"), at)  # overwrites
    return files.read_strict(spark, at, files.schema_of(_IDS))


def _broken(spark, d) -> DataFrame:
    """Lines of which every seventh is cut short and every eleventh blank."""
    row = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    line = F.when(F.col("doc_id") % 7 == 0, F.substring(row, 1, 9)).when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(row)
    return _docs(spark, d).select(line.alias("value"))


def lenient_lines(spark, d) -> DataFrame:
    at = shared_path(spark, "lenient")
    _broken(spark, d).write.text(at)
    return files.read_lenient(spark, at, files.schema_of(_IDS)).where("doc_id is not null")


def bad_lines(spark, d) -> DataFrame:
    """The lines that aren't JSON objects, with what they hold; one scan sorts out good and bad."""
    at = shared_path(spark, "bad")
    _broken(spark, d).write.text(at)
    return files.bad_lines(spark, at, files.schema_of(_IDS)).groupBy(F.length("line").alias("length")).agg(F.count("*").alias("n"))


def validated_lines(spark, d) -> DataFrame:
    """Holdout rows with a fault by key: how many are good, and why others are not."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    fault = F.col("doc_id") % 10
    row = F.struct(
        F.when(fault != 1, F.substring("text", 1, 40)).alias("text"), F.when(fault == 2, "spam").otherwise("scam").alias("label"),
        F.when(fault == 3, "other").otherwise(pick(files.VECTORS)).alias("vector"), F.when(fault == 4, "web").otherwise(pick(files.SOURCES)).alias("source"),
    )
    at = shared_path(spark, "holdout")
    _docs(spark, d).select(F.when(fault == 5, "{").otherwise(F.to_json(row)).alias("value")).write.text(at)
    good, rejected = files.read_validated(spark, at)
    return good.select(F.lit("good").alias("reason")).union(rejected.select("reject_reason")).groupBy("reason").agg(F.count("*").alias("n"))


VALIDATED_SQL = "SELECT CASE doc_id % 10 WHEN 1 THEN 'missing field' WHEN 2 THEN 'label' WHEN 3 THEN 'vector' WHEN 4 THEN 'source' WHEN 5 THEN 'invalid JSON' ELSE 'good' END AS reason, count(*) AS n FROM documents GROUP BY 1"


def url_list(spark, d) -> DataFrame:
    """Pages' addresses as a CSV file whose column is URL; some are blank."""
    at = shared_path(spark, "urls")
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.when(F.col("page_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("url"))).alias("URL"))
    pages.write.csv(at, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_urls(spark, at).groupBy("url").agg(F.count("*").alias("n"))


def message_table(spark, d) -> DataFrame:
    """A table of messages with numeric labels, under their own names."""
    rows = spark.read.parquet(f"{d}/labels.parquet").join(_docs(spark, d), "doc_id").select(F.col("text").alias("sms"), F.col("toxic").alias("label"))
    return files.read_sms(rows).groupBy("label", F.length("text").alias("length")).agg(F.count("*").alias("n"))


def vocabulary_lines(spark, d) -> DataFrame:
    """A vocabulary file of nations' names, read with the number of each line."""
    at = shared_path(spark, "vocabulary")
    names = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit(" "), F.col("n_name")).alias("value"), "n_nationkey")
    names.repartition(1).sortWithinPartitions("n_nationkey").select("value").write.text(at)
    got = wordpiece.read_vocabulary(spark, f"{at}/*.txt")
    return spark.createDataFrame(list(got.items()), "token string, id long")


def document_or_default(spark, d) -> DataFrame:
    """Each customer's activity, or what it is where there is none."""
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    activity = _log(spark, d).groupBy("user_id").agg(F.count("*").alias("events"), F.max("kind").alias("last_kind"))
    return files.document_or_default(keys, activity, "user_id", {"events": 0, "last_kind": "none"})


def metric_documents(spark, d) -> DataFrame:
    """A candidate's metrics as one JSON document a file."""
    at = shared_path(spark, "metrics")
    p = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), F.max("p_size").alias("size"))
    document = F.concat(F.lit('{\n  "name": "'), F.col("name"), F.lit('",\n  "latency": {"n": '), F.col("n").cast("string"), F.lit('},\n  "size": '), F.col("size").cast("string"), F.lit("\n}"))
    p.select(document.alias("value"), "name").repartition("name").write.partitionBy("name").option("lineSep", "\n\n").text(at)
    return files.read_metrics(spark, at).select("name", F.col("latency.n").alias("n"), "size")


def resumed_batches(spark, d) -> DataFrame:
    """Samples in batches by language, where a run broke off and was run again: how many each vector has and still lacks.

    Targets are 400 of each language; what is counted is what is in the log of batches, each once.
    """
    at = shared_path(spark, "samples")
    rows = _docs(spark, d).select("doc_id", "lang")
    names = sorted(r.lang for r in rows.where("lang is not null").select("lang").distinct().collect())  # a folder each
    batch = lambda k: rows.where(F.col("lang") == names[k])
    store.append_once(batch(0), at, "batch-0")
    store.stage_batch(batch(1), at, "batch-1")  # the run broke off before its name was in the log
    for k in range(len(names)):
        store.append_once(batch(k), at, f"batch-{k}")
    for k in range(len(names)):
        store.append_once(batch(k), at, f"batch-{k}")  # nothing is written twice
    existing = store.read_appended(spark, at, "doc_id long, lang string")
    targets = spark.createDataFrame([(x, 400) for x in ("en", "fr", "de", "es", "it")], "lang string, target long")
    return files.resume_counts(existing, targets, "lang").select("lang", "target", "existing", "remaining")


def locked_file(spark, d) -> DataFrame:
    """A holdout file that is written once: the second attempt is refused, and the rows are those of the first."""
    at = shared_path(spark, "locked")
    rows = _docs(spark, d).select("doc_id", "lang")
    files.write_locked(rows, at)
    try:
        files.write_locked(rows.limit(0), at)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.schema("doc_id long, lang string").json(at).groupBy("lang").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


def report_lines(spark, d) -> DataFrame:
    """A report of documents by language and source, as lines with a summary beside them, and read back."""
    at = shared_path(spark, "report")
    rows = _docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))
    files.write_report(rows, at, {"n_rows": F.count("*"), "n_documents": F.sum("n")})
    lines = spark.read.schema("lang string, source string, n long").json(f"{at}/rows")
    summary = spark.read.schema("n_rows long, n_documents long").json(f"{at}/summary")
    return lines.crossJoin(F.broadcast(summary))  # one row


def soft_label_files(spark, d) -> DataFrame:
    """Soft labels in a folder a temperature, of which one is read."""
    from ..operators import evalmetrics

    at = shared_path(spark, "soft-labels")
    files.write_soft_labels(evalmetrics.soft_labels(predicted(spark, d), "doc_id", "z0", "z1"), at)
    return spark.read.parquet(at).where("t = 3.0").select("doc_id", F.round("p_scam", 9).alias("p_scam"))


def consistency_stage(spark, d) -> DataFrame:
    """How each source's rows are checked for consistency, by how accurate the predictions are there."""
    right = F.avg(F.when((F.col("score") > 0.5).cast("int") == F.col("label"), 1.0).otherwise(0.0))
    rows = predicted(spark, d).groupBy("source").agg(F.round(right, 9).alias("accuracy"))
    found = rows.withColumn("mode", curate.consistency_mode(F.col("accuracy")))
    return found.select("source", "accuracy", "mode.mode", "mode.threshold")


def regions(spark, d) -> DataFrame:
    """Recognised blocks of parts' names as regions; a block without a frame is at the origin."""
    key = F.col("p_partkey")
    frame = F.when(key % 2 == 0, F.struct((key % 10).cast("int").alias("left"), F.lit(2).alias("top"), F.lit(3).alias("width"), F.lit(4).alias("height")))
    blocks = F.array(F.struct(F.col("p_name").alias("text"), frame.alias("frame")), F.struct(F.col("p_type").alias("text"), frame.alias("frame")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", blocks.alias("b")).select("p_partkey", *files.text_regions("b"))


REGIONS_SQL = """SELECT p_partkey, unnest([p_name, p_type]) AS text, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 10 AS INT) ELSE 0 END AS x, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS y,
  CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS width, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END AS height FROM part"""


def recognised_text(spark, d) -> DataFrame:
    """Documents as if they had been recognised: with dashes, tabs and NULs between their words, then normalised."""
    noisy = F.concat(F.lit("\t"), F.replace(F.replace("text", F.lit(". "), F.lit(" – ")), F.lit(", "), F.lit("—\u0000 \n")), F.lit(" "))
    return _docs(spark, d).select("doc_id", F.md5(text.ocr_normalized(noisy)).alias("digest"))


RECOGNISED_SQL = r"""SELECT doc_id, md5(trim(replace(translate(regexp_replace(chr(9) || replace(replace(text, '. ', ' – '), ', ', '—' || chr(1) || ' ' || chr(10)) || ' ', '\s+', ' ', 'g'), '–—', '--'), chr(1), ''))) AS digest FROM documents"""


def decoded(spark, d) -> DataFrame:
    """Customers' segments, encoded and decoded with the built-in vocabulary."""
    v = wordpiece.fallback_vocabulary()
    e = wordpiece.encode(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment"), "c_mktsegment", v, 8)
    return e.select("c_custkey", F.array_join(wordpiece.decode(F.col("input_ids"), v), " ").alias("tokens"))


DECODED_SQL = "SELECT c_custkey, '[CLS] ' || lower(c_mktsegment[1]) || ' [UNK] [SEP]' || repeat(' [PAD]', 4) AS tokens FROM customer"


def event_windows(spark, d) -> DataFrame:
    """Events by day and kind, counted in event time as a stream."""
    from ..streaming.activity import windowed_counts
    from .metrics import log_of

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = log_of(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet"))
    counts = windowed_counts(source).select(F.concat_ws(" ", F.date_format("window.start", "yyyy-MM-dd"), "kind").alias("key"), "n")
    got = finished(counts, "key", shared_path(spark, "windows"))
    return got.select(F.split_part("key", F.lit(" "), F.lit(1)).alias("day"), F.split_part("key", F.lit(" "), F.lit(2)).alias("kind"), "n")


def upserted_documents(spark, d) -> DataFrame:
    """Customers' documents in buckets, of which an update of a few nations' customers rewrites only some."""
    at = shared_path(spark, "documents")
    docs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("last"), F.lit(5).cast("long").alias("n"))
    store.write_documents(docs, at, "user_id")
    updates = spark.read.parquet(f"{d}/events.parquet").where("user_id < 40").select("user_id", "event_id", F.col("event_type").alias("last"), F.lit(1).cast("long").alias("n"))
    store.upsert(spark, at, updates, "user_id", lambda found, new: membership.merged(found, new, "user_id", "event_id", ("last",), ("n",)))
    return store.read_documents(spark, at).select("user_id", "last", "n")


UPSERTED_SQL = """WITH u AS (SELECT user_id, arg_max(event_type, event_id) AS last, count(*) AS n FROM events WHERE user_id < 40 GROUP BY 1)
SELECT coalesce(c_custkey, user_id) AS user_id, coalesce(u.last, 'none') AS last, CASE WHEN c_custkey IS NULL THEN 0 ELSE 5 END + coalesce(u.n, 0) AS n FROM customer FULL JOIN u ON user_id = c_custkey"""


def looked_up_members(spark, d) -> DataFrame:
    """The members of every family that a user with a sign-up is in, out of files by family: no other file is opened for one family."""
    at = shared_path(spark, "members")
    members = written(_families(spark, d).where("family_id is not null"), "families")
    store.write_sorted(members, at, "family_id", 8)
    wanted = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'signup'").agg(F.min("user_id").alias("u")).first()["u"]
    return store.lookup(spark, at, "family_id", [] if wanted is None else [wanted // 7, wanted // 7 + 3])


LOOKED_UP_SQL = "WITH w AS (SELECT min(user_id) // 7 AS f FROM events WHERE event_type = 'signup') SELECT DISTINCT user_id, user_id // 7 AS family_id FROM events, w WHERE user_id % 7 <> 0 AND user_id // 7 IN (f, f + 3)"

_META = "SELECT doc_id, lang, source, n_chars FROM documents"
QUERIES = {
    "strict_lines": (strict_lines, _META),
    "lenient_lines": (lenient_lines, f"{_META} WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0"),
    "bad_lines": (bad_lines, "SELECT 9 AS length, count(*) AS n FROM documents WHERE doc_id % 7 = 0"),
    "validated_lines": (validated_lines, VALIDATED_SQL),
    "url_list": (url_list, "SELECT url, count(*) AS n FROM pages WHERE page_id % 9 <> 0 GROUP BY 1"),
    "message_table": (message_table, "SELECT CASE WHEN toxic = 1 THEN 'spam' ELSE 'ham' END AS label, CAST(length(text) AS INT) AS length, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"),
    "vocabulary_lines": (vocabulary_lines, "SELECT n_name AS token, row_number() OVER (ORDER BY n_nationkey) - 1 AS id FROM nation"),
    "document_or_default": (document_or_default, "WITH a AS (SELECT user_id, count(*) AS events, max(CASE event_type WHEN 'error' THEN 'scam' WHEN 'view' THEN 'safe' WHEN 'click' THEN 'safe' WHEN 'purchase' THEN 'report' ELSE 'open' END) AS last_kind FROM events GROUP BY 1) SELECT c_custkey AS user_id, coalesce(events, 0) AS events, coalesce(last_kind, 'none') AS last_kind FROM customer LEFT JOIN a ON user_id = c_custkey"),
    "metric_documents": (metric_documents, "SELECT p_brand AS name, count(*) AS n, CAST(max(p_size) AS BIGINT) AS size FROM part GROUP BY 1"),
    "resumed_batches": (resumed_batches, "SELECT lang, CAST(400 AS BIGINT) AS target, coalesce(n, 0) AS existing, greatest(400 - coalesce(n, 0), 0) AS remaining FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) t(lang) LEFT JOIN (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1) USING (lang)"),
    "locked_file": (locked_file, "SELECT lang, count(*) AS n, true AS refused FROM documents GROUP BY 1"),
    "report_lines": (report_lines, "WITH r AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, source, n, (SELECT count(*) FROM r) AS n_rows, (SELECT CAST(sum(n) AS BIGINT) FROM r) AS n_documents FROM r"),
    "soft_label_files": (soft_label_files, None),
    "consistency_stage": (consistency_stage, None),
    "regions": (regions, REGIONS_SQL),
    "recognised_text": (recognised_text, RECOGNISED_SQL),
    "decoded": (decoded, DECODED_SQL),
    "event_windows": (event_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'error' THEN 'scam' WHEN 'view' THEN 'safe' WHEN 'click' THEN 'safe' WHEN 'purchase' THEN 'report' ELSE 'open' END AS kind, count(*) AS n FROM events GROUP BY 1, 2"),
    "upserted_documents": (upserted_documents, UPSERTED_SQL),
    "looked_up_members": (looked_up_members, LOOKED_UP_SQL),
}


def _sql() -> dict[str, str]:
    from .metrics import PREDICTED

    return {
        "soft_label_files": f"WITH {PREDICTED} SELECT doc_id, round(exp(z1 / 3) / (exp(z0 / 3) + exp(z1 / 3)), 9) AS p_scam FROM p",
        "consistency_stage": f"WITH {PREDICTED}, a AS (SELECT source, round(avg(CASE WHEN CAST(score > 0.5 AS INT) = label THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM p GROUP BY 1) SELECT source, accuracy, CASE WHEN accuracy < 0.7 THEN 'keyword' ELSE 'model' END AS mode, CASE WHEN accuracy < 0.7 THEN NULL WHEN accuracy < 0.85 THEN 0.5::DOUBLE ELSE 0.6::DOUBLE END AS threshold FROM a",
    }


QUERIES |= {name: (QUERIES[name][0], sql) for name, sql in _sql().items()}
