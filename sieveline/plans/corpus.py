"""Corpus queries over documents, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import n_tokens, tokens
from ..functions.automaton import Lexicon
from ..operators import curate, similar
from ..operators.ordering import spread

#: Keywords that the driver's prose holds, by vector; fixed for both engines.
LEXICON = {"en": ["thnt", "ingth", "ererre"], "fr": ["eaupa", "tionre", "ouche"], "de": ["schen", "ungbe", "keitü"], "es": ["ciónos", "mente", "quede"]}
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents where their texts are read."""
    return spread(_docs(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return _texts(spark, d).join(labels, "doc_id").withColumn("label", F.when(F.col("toxic") == 1, "scam").otherwise("safe"))


LABELLED = "labelled AS (SELECT d.*, l.quality, l.toxic, CASE WHEN l.toxic = 1 THEN 'scam' ELSE 'safe' END AS label FROM documents d JOIN labels l USING (doc_id))"


def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).select("doc_id", "lang", "text", n_tokens(F.col("text")).alias("n_tokens"))
    return curate.dedup_keep_first(rows, "text", "doc_id", ["doc_id", "lang", "n_tokens"]).where("n_tokens >= 15")


DEDUP_SQL = f"""
SELECT doc_id, lang, n_tokens FROM (
  SELECT doc_id, lang, CAST(len({WORDS}) AS INTEGER) AS n_tokens, row_number() OVER (PARTITION BY {STRIP} ORDER BY doc_id) AS r FROM documents
) WHERE r = 1 AND n_tokens >= 15"""


def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).select("doc_id", "lang", "text", n_tokens(F.col("text")).alias("n_tokens"))
    first = curate.dedup_keep_first(rows, "text", "doc_id", ["doc_id", "lang", "n_tokens"])
    after = first.groupBy("lang").agg(F.count("*").alias("distinct_rows"), F.count_if(F.col("n_tokens") >= 15).alias("kept"))
    before = rows.groupBy("lang").agg(F.count("*").alias("n_rows"))
    return before.join(after, "lang").select("lang", "n_rows", (F.col("n_rows") - F.col("distinct_rows")).alias("removed"), "kept")


DEDUP_REPORT_SQL = f"""
WITH t AS (SELECT doc_id, lang, len({WORDS}) AS n, row_number() OVER (PARTITION BY {STRIP} ORDER BY doc_id) AS r FROM documents),
b AS (SELECT lang, count(*) AS n_rows FROM t GROUP BY lang), a AS (SELECT lang, count(*) AS u, count_if(n >= 15) AS kept FROM t WHERE r = 1 GROUP BY lang)
SELECT lang, n_rows, n_rows - u AS removed, CAST(kept AS BIGINT) AS kept FROM b JOIN a USING (lang)"""


def duplicate_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return curate.duplicate_ordinals(_texts(spark, d), "text", "doc_id").select("doc_id", F.col("ordinal").cast("long"))


ORDINALS_SQL = f"SELECT doc_id, r AS ordinal FROM (SELECT doc_id, row_number() OVER (PARTITION BY {STRIP} ORDER BY doc_id) AS r FROM documents) WHERE r > 1"


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy("label", "lang", "source").agg(F.count("*").alias("n"))


def split_of(df: DataFrame) -> DataFrame:
    return curate.stratified_split(df, "lang", "doc_id")


SPLIT = """split_rows AS (
  SELECT doc_id, lang, r, n, n_test, floor((n - n_test) * 0.1111 + 0.5) AS n_val FROM (
    SELECT doc_id, lang, r, n, floor(n * 0.10 + 0.5) AS n_test FROM (
      SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents))),
splits AS (SELECT doc_id, lang, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM split_rows)"""


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return split_of(_docs(spark, d).select("doc_id", "lang")).select("doc_id", "lang", "split")


def split_crosstab(spark: SparkSession, d: str) -> DataFrame:
    s = split_of(_docs(spark, d).select("doc_id", "lang"))
    return s.groupBy("lang").pivot("split", ["train", "val", "test"]).count().select("lang", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("train", "val", "test"))).withColumn("total", F.col("train") + F.col("val") + F.col("test"))


CROSSTAB_SQL = f"WITH {SPLIT} SELECT lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM splits GROUP BY lang"


def gate(name: str, value, lo: float, hi: float) -> list:
    return [F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), value.between(lo, hi).alias("passed")]


def safe_ratio_gate(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).agg(F.avg(F.when(F.col("label") == "safe", 1.0).otherwise(0.0)).alias("v")).select(*gate("safe_ratio", F.col("v"), 0.40, 0.60))


def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Wanted classes that no row has."""
    wanted = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "it")], "lang string")
    return wanted.join(_docs(spark, d).select("lang").distinct(), "lang", "left_anti")


def split_integrity_gate(spark: SparkSession, d: str) -> DataFrame:
    """Stripped texts that both train and test hold."""
    s = split_of(_texts(spark, d)).select("split", curate.digest(F.col("text")).alias("t")).where("split <> 'val'")
    both = s.groupBy("t").agg(F.countDistinct("split").alias("n")).where("n = 2")
    return both.agg(F.count("*").alias("v")).select(*gate("overlap", F.col("v"), 0.0, 0.0))


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).select(curate.digest(F.col("text")).alias("t"), n_tokens(F.col("text")).alias("n"))
    per = rows.groupBy("t").agg(F.count("*").alias("c"), F.count_if(F.col("n") < 15).alias("short"))
    return per.agg((F.sum("c") - F.count("*")).alias("duplicates"), F.sum("short").alias("short"))


def keyword_consistency(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    kept = curate.keyword_consistent(F.col("label"), F.col("lang"), F.col("text"), LEXICON)
    return rows.select("lang", "label", kept.alias("k")).groupBy("lang", "label").agg(F.count_if("k").alias("kept"), F.count_if(~F.col("k")).alias("discarded"))


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


HITS = "CASE " + " ".join(f"WHEN lang = '{k}' THEN {_hits(w)}" for k, w in LEXICON.items()) + " ELSE 0 END"


def vector_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", curate.infer_vector(F.col("text"), LEXICON).alias("vector"))


_ARR = "[" + ", ".join(_hits(w) for w in LEXICON.values()) + "]"
ARGMAX_SQL = f"SELECT doc_id, CASE WHEN list_max(h) = 0 THEN 'phishing' ELSE ['en', 'fr', 'de', 'es'][list_position(h, list_max(h))] END AS vector FROM (SELECT doc_id, {_ARR} AS h FROM documents)"


def review_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    out = rows.where(~curate.keyword_consistent(F.col("label"), F.col("lang"), F.col("text"), LEXICON))
    return curate.review_sample(out, "lang", "doc_id", "text").withColumn("rank", F.col("rank").cast("long"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Unigram counts and shares by language."""
    words = _texts(spark, d).select("lang", F.explode(tokens(F.lower("text"))).alias("term"))
    counts = words.groupBy("lang", "term").agg(F.count("*").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total), "lang").select("lang", "term", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


TERMS = f"terms AS (SELECT lang, unnest({WORDS.replace('(text', '(lower(text)')}) AS term FROM documents), counts AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL), totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS t FROM counts GROUP BY lang)"


def vocabulary_size(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select(F.explode(tokens(F.lower("text"))).alias("term")).agg(F.countDistinct("term").alias("n_terms"))


def js_matrix(spark: SparkSession, d: str) -> DataFrame:
    return curate.js_matrix(_texts(spark, d), "lang", "text").select("a", "b", F.round("jsd", 6).alias("jsd"))


JS = f"""{TERMS}, p AS (SELECT lang, term, n / t AS p FROM counts JOIN totals USING (lang)),
names AS (SELECT a.lang AS a, b.lang AS b FROM totals a, totals b),
grid AS (SELECT a, b, term FROM names, (SELECT DISTINCT term FROM counts)),
js AS (SELECT a, b, sqrt(greatest(0, sum(CASE WHEN coalesce(x.p, 0) > 0 THEN x.p * ln(x.p / ((coalesce(x.p, 0) + coalesce(y.p, 0)) / 2)) ELSE 0 END + CASE WHEN coalesce(y.p, 0) > 0 THEN y.p * ln(y.p / ((coalesce(x.p, 0) + coalesce(y.p, 0)) / 2)) ELSE 0 END) / 2)) AS jsd
  FROM grid LEFT JOIN p x ON x.lang = a AND x.term = grid.term LEFT JOIN p y ON y.lang = b AND y.term = grid.term GROUP BY a, b)"""


def js_min_pair(spark: SparkSession, d: str) -> DataFrame:
    m = curate.js_matrix(_texts(spark, d), "lang", "text").where("a < b").withColumn("jsd", F.round("jsd", 6))
    return m.agg(F.min_by(F.struct("a", "b", "jsd"), F.struct("jsd", "a", "b")).alias("r")).select("r.*")


def exact_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return curate.decontaminate(_texts(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"), mode="exact").select("doc_id")


def contains_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return curate.decontaminate(_texts(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"), mode="contains").select("doc_id")


def tfidf_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs, items = _docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")
    return similar.similar_pairs(docs, items, "doc_id", "item_id", "text", 0.4).select("doc_id", "item_id", F.round("similarity", 5).alias("similarity"))


TFIDF_SQL = r"""
WITH side AS (SELECT 'l' || doc_id AS k, text FROM documents UNION ALL SELECT 'r' || item_id, text FROM benchmark),
w AS (SELECT k, regexp_extract_all(lower(text), '[\pL\pN_]{2,}', 0) AS t FROM side),
g AS (SELECT k, unnest(t) AS term FROM w UNION ALL SELECT k, t[i] || ' ' || t[i + 1] FROM (SELECT k, t, unnest(range(1, greatest(1, len(t)))) AS i FROM w)),
tf AS (SELECT k, term, count(*) AS tf FROM g GROUP BY ALL),
kept AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000),
x AS (SELECT k, term, tf * (ln((1 + (SELECT count(*) FROM side)) / (1 + df)) + 1) AS w FROM tf JOIN kept USING (term)),
n AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM x)
SELECT CAST(a.k[2:] AS BIGINT) AS doc_id, CAST(b.k[2:] AS BIGINT) AS item_id, round(sum(a.w * b.w), 5) AS similarity
FROM n a JOIN n b ON a.term = b.term AND a.k[1] = 'l' AND b.k[1] = 'r' GROUP BY a.k, b.k HAVING sum(a.w * b.w) >= 0.4"""


def capped_sample(spark: SparkSession, d: str) -> DataFrame:
    return curate.capped_sample(_docs(spark, d).select("doc_id", "lang"), "doc_id", 100)


def sample_validity(spark: SparkSession, d: str) -> DataFrame:
    """Reject reasons of documents taken as samples; a channel is derived from the id."""
    rows = _labelled(spark, d)
    channel = F.element_at(F.array(*map(F.lit, (*curate.CHANNELS, "fax"))), (F.col("doc_id") % 5 + 1).cast("int"))
    reason = F.coalesce(curate.sample_reject_reason(F.col("text"), F.col("label"), channel), F.lit("ok"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def augmented(spark: SparkSession, d: str) -> DataFrame:
    """The variants of each document, by the digest of their texts."""
    return curate.augment(_texts(spark, d).select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("text").alias("variant"))


_COIN = lambda s: f"(CAST('0x' || md5(CAST(doc_id AS VARCHAR) || '{s}:42')[1:8] AS BIGINT) % 10)"
AUGMENT_SQL = f"""
SELECT doc_id, md5(unnest(list_filter([text, lower(text), CASE WHEN {_COIN('u')} < 5 THEN replace(replace(upper(text), 'ß', 'SS'), 'ẞ', 'SS') END, CASE WHEN {_COIN('m')} < 3 THEN replace(replace(text, '!', '!!'), '.', '...') END], lambda x: x IS NOT NULL))) AS variant FROM documents"""


def target_attainment(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("en", 500), ("fr", 200), ("de", 100), ("it", 50)], "lang string, target int")
    have = _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    pct = F.coalesce("n", F.lit(0)) * 100 / F.col("target")
    return targets.join(have, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"), F.round(pct, 6).alias("pct"), F.when(pct >= 80, "OK").otherwise("LOW").alias("status"))


def quota_plan(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.activity import quota_plan as plan

    have = _docs(spark, d).groupBy(F.when(F.col("lang") == "fr", "romance_grooming").when(F.col("lang") == "de", "safe").otherwise(F.col("lang")).alias("vector")).agg(F.count("*").alias("existing"))
    return plan(have.withColumn("target", F.lit(20_000)))


def holdout_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of documents (language, source, length) that test has and training lacks, and the other way round."""
    s = split_of(_docs(spark, d).select("doc_id", "lang", "source", "n_chars"))
    key = F.concat_ws("/", "lang", "source", F.floor(F.col("n_chars") / 500).cast("string"))
    a, b = (s.where(F.col("split") == x).select(key.alias("k")).distinct() for x in ("train", "test"))
    return a.exceptAll(b).withColumn("only", F.lit("train")).union(b.exceptAll(a).withColumn("only", F.lit("test")))


QUERIES = {
    "dedup_keep_first": (dedup_keep_first, DEDUP_SQL),
    "dedup_report": (dedup_report, DEDUP_REPORT_SQL),
    "duplicate_ordinals": (duplicate_ordinals, ORDINALS_SQL),
    "label_distribution": (label_distribution, f"WITH {LABELLED} SELECT label, lang, source, count(*) AS n FROM labelled GROUP BY ALL"),
    "stratified_split": (stratified_split, f"WITH {SPLIT} SELECT * FROM splits"),
    "split_crosstab": (split_crosstab, CROSSTAB_SQL),
    "safe_ratio_gate": (safe_ratio_gate, f"WITH {LABELLED}, v AS (SELECT avg(CASE WHEN label = 'safe' THEN 1.0::DOUBLE ELSE 0 END) AS value FROM labelled) SELECT 'safe_ratio' AS gate, value, 0.4::DOUBLE AS lo, 0.6::DOUBLE AS hi, value BETWEEN 0.4 AND 0.6 AS passed FROM v"),
    "coverage_gate": (coverage_gate, "SELECT * FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) t(lang) WHERE lang NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)"),
    "split_integrity_gate": (split_integrity_gate, f"WITH {SPLIT}, t AS (SELECT {STRIP} AS t, split FROM documents JOIN splits USING (doc_id) WHERE split <> 'val'), v AS (SELECT count(*)::DOUBLE AS value FROM (SELECT t FROM t GROUP BY t HAVING count(DISTINCT split) = 2)) SELECT 'overlap' AS gate, value, 0::DOUBLE AS lo, 0::DOUBLE AS hi, value BETWEEN 0 AND 0 AS passed FROM v"),
    "quality_gate": (quality_gate, f"SELECT count(*) - count(DISTINCT {STRIP}) AS duplicates, CAST(count_if(len({WORDS}) < 15) AS BIGINT) AS short FROM documents"),
    "keyword_consistency": (keyword_consistency, f"WITH {LABELLED}, k AS (SELECT lang, label, label = 'safe' OR {HITS} >= 2 AS k FROM labelled) SELECT lang, label, CAST(count_if(k) AS BIGINT) AS kept, CAST(count_if(NOT k) AS BIGINT) AS discarded FROM k GROUP BY ALL"),
    "vector_argmax": (vector_argmax, ARGMAX_SQL),
    "review_sample": (review_sample, f"WITH {LABELLED}, k AS (SELECT lang, doc_id, replace(text[1:80], chr(10), ' ') AS preview, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS rank FROM labelled WHERE NOT (label = 'safe' OR {HITS} >= 2)) SELECT lang, rank, doc_id, preview FROM k WHERE rank <= 20"),
    "token_counts": (token_counts, f"WITH {TERMS} SELECT lang, term, n, round(n / t, 9) AS share FROM counts JOIN totals USING (lang)"),
    "vocabulary_size": (vocabulary_size, f"WITH {TERMS} SELECT count(DISTINCT term) AS n_terms FROM terms"),
    "js_matrix": (js_matrix, f"WITH {JS} SELECT a, b, CASE WHEN a = b THEN 0 ELSE round(jsd, 6) END AS jsd FROM js"),
    "js_min_pair": (js_min_pair, f"WITH {JS} SELECT a, b, round(jsd, 6) AS jsd FROM js WHERE a < b ORDER BY 3, 1, 2 LIMIT 1"),
    "exact_decontamination": (exact_decontamination, f"SELECT doc_id FROM documents WHERE {STRIP} NOT IN (SELECT {STRIP} FROM benchmark)"),
    "contains_decontamination": (contains_decontamination, f"SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT {STRIP} AS p FROM benchmark) b WHERE b.p <> '' AND contains(d.text, b.p))"),
    "tfidf_pairs": (tfidf_pairs, TFIDF_SQL),
    "capped_sample": (capped_sample, "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 100"),
    "sample_validity": (sample_validity, f"WITH {LABELLED} SELECT CASE WHEN len({WORDS}) < 4 THEN 'too short' WHEN doc_id % 5 = 4 THEN 'channel' ELSE 'ok' END AS reason, count(*) AS n FROM labelled GROUP BY ALL"),
    "augmented": (augmented, AUGMENT_SQL),
    "target_attainment": (target_attainment, "SELECT lang, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100 / target, 6) AS pct, CASE WHEN coalesce(n, 0) * 100 / target >= 80 THEN 'OK' ELSE 'LOW' END AS status FROM (VALUES ('en', 500), ('fr', 200), ('de', 100), ('it', 50)) t(lang, target) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)"),
    "quota_plan": (quota_plan, "WITH h AS (SELECT CASE WHEN lang = 'fr' THEN 'romance_grooming' WHEN lang = 'de' THEN 'safe' ELSE lang END AS vector, greatest(20000 - count(*), 0) AS remaining FROM documents GROUP BY ALL), l AS (SELECT vector, remaining, CAST(floor(remaining * CASE WHEN vector = 'romance_grooming' THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END) AS BIGINT) AS local FROM h), f AS (SELECT *, CAST(floor((remaining - local) * 0.4::DOUBLE) AS BIGINT) AS flash FROM l) SELECT *, remaining - local - flash AS lite, CASE WHEN vector = 'safe' THEN CAST(floor(remaining * 0.25::DOUBLE) AS BIGINT) END AS hard FROM f"),
    "holdout_overlap": (holdout_overlap, f"WITH {SPLIT}, k AS (SELECT DISTINCT split, s.lang || '/' || source || '/' || n_chars // 500 AS k FROM splits s JOIN documents USING (doc_id)) SELECT k, 'train' AS only FROM k WHERE split = 'train' AND k NOT IN (SELECT k FROM k WHERE split = 'test') UNION ALL SELECT k, 'test' FROM k WHERE split = 'test' AND k NOT IN (SELECT k FROM k WHERE split = 'train')"),
}
