"""Scoring and fusion queries over messages built from orders, with visual probabilities from the same keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fusion, lexicons, scoring
from ..functions.automaton import Lexicon
from ..functions.text import has_homoglyphs, normalized
from ..operators import curate
from ..operators.ordering import spread

#: Messages that a task scores: some seconds.
TASK_ROWS = 100_000
#: Message templates by key; {n} is the order's key.
TEMPLATES = (
    "Your order {n} has shipped, thank you",
    "URGENT: pay ${n} in gift card now!! act fast",
    "Congratulations you've won the lottery prize {n}, claim your prize at http://bit.ly/{n}",
    "IRS final notice {n}: you will be arrested, wire transfer now",
    "Verify your account {n} immediately or it is suspended https://secure.example/{n} https://t.co/{n}",
    "Lunch at noon on day {n}?",
    "Your pаypal account {n} was disabled, click here to confirm your identity",
    "Microsoft support team: send money immediately, within {n} hours, 100 dollars",
    "Meeting moved to room {n}",
    "free  bitcoin  {n}\trisk-free!!! guaranteed!!",
    "Your password and pin {n} expire today unless you hurry",
    "Send your cvv, credit card and date of birth to bank of {n}; failure to reply means court",
    "Caf\u00e9 or cafe\u0301 {n}: pay\u0301 the fund\u0301 by noon",  # composed, these are other words
    "",
)


def message(key: Column) -> Column:
    out = F.lit("")
    for k, t in enumerate(TEMPLATES):
        parts = [x for p in t.split("{n}") for x in (F.lit(p), key.cast("string"))][:-1]
        out = F.when(key % len(TEMPLATES) == k, F.concat(*parts)).otherwise(out)
    return out


def _sql_message() -> str:
    literal = lambda p: "'" + p.replace("'", "''").replace("\t", "' || chr(9) || '") + "'"
    cases = " ".join(f"WHEN {k} THEN " + " || o_orderkey || ".join(literal(p) for p in t.split("{n}")) for k, t in enumerate(TEMPLATES))
    return f"CASE o_orderkey % {len(TEMPLATES)} {cases} END"


def _count(text: str, rule: scoring.Rule) -> str:
    regex = rule.regex.replace("'", "''")
    if rule.every:
        return f"len(regexp_extract_all({text}, '{regex}'))"
    return f"CASE WHEN regexp_matches({text}, '{regex}') THEN {1 + rule.groups} ELSE 0 END"


def _matched(text: str, family: str) -> str:
    parts = []
    for r in scoring.FAMILIES[family][1]:
        regex = r.regex.replace("'", "''")
        if r.every:
            parts.append(f"list_slice(regexp_extract_all({text}, '{regex}'), 1, 3)")
        else:
            groups = ", ".join(f"regexp_extract({text}, '{regex}', {g})" for g in range(min(3, 1 + r.groups)))
            parts.append(f"CASE WHEN regexp_matches({text}, '{regex}') THEN [{groups}] ELSE []::VARCHAR[] END")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"array_to_string({out}, ', ')"


FAMILIES = list(scoring.FAMILIES)
_COUNTS = ", ".join(" + ".join(_count("t", r) for r in scoring.FAMILIES[f][1]) + f" AS n_{f}" for f in FAMILIES)
_HITS = [("homoglyph", scoring.HOMOGLYPH[2], scoring.HOMOGLYPH[1])] + [(f"n_{f} > 0", f"least(0.95::DOUBLE, 0.3::DOUBLE + n_{f} * 0.15::DOUBLE)", scoring.FAMILIES[f][0]) for f in FAMILIES]
_TOP = " + ".join(f"CASE WHEN {h} THEN {c}::DOUBLE * {w}::DOUBLE ELSE 0 END" for h, c, w in _HITS)
_UNDER = " + ".join(f"CASE WHEN {h} THEN {w}::DOUBLE ELSE 0 END" for h, _, w in _HITS)
_N = " + ".join(f"CAST({h} AS INT)" for h, _, _ in _HITS)
MESSAGES = f"""m AS (SELECT o_orderkey, {_sql_message()} AS msg FROM orders),
t AS (SELECT o_orderkey, msg, trim(regexp_replace(translate(nfc_normalize(lower(msg)), 'аеорсухѕіјԁһԝʏαορτν', 'aeopcyxsijdhwyaoptv'), '\\s+', ' ', 'g')) AS t,
  regexp_matches(msg, '[\\x{{400}}-\\x{{4ff}}\\x{{370}}-\\x{{3ff}}]') AND regexp_matches(msg, '[a-zA-Z]') AS homoglyph FROM m),
c AS (SELECT o_orderkey, msg, t, homoglyph, {_COUNTS} FROM t),
s AS (SELECT *, {_N} AS n_patterns, CASE WHEN {_N} = 0 THEN 0 ELSE least(1.0::DOUBLE, ({_TOP}) / ({_UNDER}) + least(0.3::DOUBLE, ({_N}) * 0.05::DOUBLE)) END AS heuristic FROM c),
f AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 0.6::DOUBLE * ((o_orderkey % 11) / 10.0::DOUBLE) + 0.4::DOUBLE * heuristic END AS txt,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 0.4::DOUBLE * p_login + 0.7::DOUBLE * p_warning + 0.95::DOUBLE * p_critical END AS vis,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE greatest(p_safe, p_login, p_warning, p_critical) END AS vconf,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ['safe', 'login', 'warning', 'critical'][list_position([p_safe, p_login, p_warning, p_critical], greatest(p_safe, p_login, p_warning, p_critical))] END AS cat
  FROM (SELECT *, w0 / (w0 + w1 + w2 + w3) AS p_safe, w1 / (w0 + w1 + w2 + w3) AS p_login, w2 / (w0 + w1 + w2 + w3) AS p_warning, w3 / (w0 + w1 + w2 + w3) AS p_critical
    FROM (SELECT *, (1 + o_orderkey % 13)::DOUBLE AS w0, (1 + o_orderkey % 17)::DOUBLE AS w1, (1 + o_orderkey % 19)::DOUBLE AS w2, (1 + o_orderkey % 23)::DOUBLE AS w3 FROM s))),
fused AS (SELECT *, greatest(coalesce(vis, 0), coalesce(txt, 0)) AS score,
  CASE WHEN vis IS NULL THEN coalesce(txt, 0) WHEN txt IS NULL THEN vis ELSE vis * 0.4::DOUBLE + txt * 0.6::DOUBLE END AS weighted,
  CASE WHEN vis IS NOT NULL AND txt IS NOT NULL THEN greatest(vconf, CASE WHEN txt > 0.5 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) * (0.5::DOUBLE + 0.5::DOUBLE * (1 - abs(vis - txt)))
    WHEN vis IS NOT NULL THEN vconf * 0.7::DOUBLE WHEN txt IS NOT NULL THEN CASE WHEN txt > 0.5 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END ELSE 0 END AS confidence FROM f)"""
_LEVEL = lambda c: f"CASE WHEN {c} < 0.3 THEN 'low' WHEN {c} < 0.5 THEN 'medium' WHEN {c} < 0.7 THEN 'high' ELSE 'critical' END"


def messages(spark: SparkSession, d: str, found: str = "rules") -> DataFrame:
    """(o_orderkey, msg, t, homoglyph, n_<family> ..., heuristic): each rule runs once. Beside these hit_... by rule, said_<family> for "texts", none for "counts"."""
    m = spread(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), TASK_ROWS).select("o_orderkey", message(F.col("o_orderkey")).alias("msg"))
    return _found(m, "msg", found)


def _found(m: DataFrame, raw: str, found: str) -> DataFrame:
    t = m.withColumn("t", normalized(F.col(raw))).withColumn("homoglyph", has_homoglyphs(F.col(raw)))
    if found == "rules":
        t = t.select("*", *(c.alias(n) for n, c in scoring.rule_matches(F.col("t")).items()))
        t = t.select("*", *(scoring.family_count(None, f, hits()).alias(f"n_{f}") for f in FAMILIES))
        return t.withColumn("heuristic", scoring.heuristic_from_counts(_counts(), F.col("homoglyph")))
    return t.select("*", *(c.alias(n) for n, c in scoring.family_scores(F.col("t"), F.col("homoglyph"), found == "texts").items()))


def _counts() -> dict[str, Column]:
    return {f: F.col(f"n_{f}") for f in FAMILIES}


def _patterns() -> Column:
    """detect_patterns from the columns of messages with texts."""
    return scoring.patterns_of(F.col("homoglyph"), _counts(), {f: F.col(f"said_{f}") for f in FAMILIES})


def hits() -> dict:
    """The columns of messages that hold what the rules found."""
    return {f"hit_{f}_{k}": F.col(f"hit_{f}_{k}") for f, (_, rules) in scoring.FAMILIES.items() for k in range(len(rules))}


def sides(spark: SparkSession, d: str, found: str = "counts") -> DataFrame:
    """Adds txt, vis, vconf and cat: a text score from a model score by key, and a visual side from probabilities by key."""
    s = messages(spark, d, found)
    key = F.col("o_orderkey")
    w = [(1 + key % k).cast("double") for k in (13, 17, 19, 23)]
    total = w[0] + w[1] + w[2] + w[3]
    probabilities = F.struct(*((x / total).alias(n) for x, n in zip(w, fusion.VISUAL_RISK, strict=True)))
    s = s.withColumn("p", F.when(key % 5 != 0, probabilities))
    model = (key % 11) / F.lit(10.0)
    return s.select(
        "*",
        F.when(key % 7 != 0, scoring.text_score(model, F.col("heuristic"))).alias("txt"),
        fusion.visual_risk(F.col("p")).alias("vis"),
        F.when(F.col("p").isNotNull(), F.greatest(*(F.col("p")[k] for k in fusion.VISUAL_RISK))).alias("vconf"),
        F.when(F.col("p").isNotNull(), fusion.visual_category(F.col("p"))).alias("cat"),
    )


def pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d, "counts")
    total = m.agg(F.count_if("homoglyph").alias("homoglyph_attack"), *(F.count_if(F.col(f"n_{f}") > 0).alias(f) for f in FAMILIES))
    return total.unpivot([], ["homoglyph_attack", *FAMILIES], "family", "n_messages")


def heuristic_score(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d, "counts").select("o_orderkey", "heuristic")


def matched_texts(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d, "texts").withColumn("patterns", _patterns())
    said = F.array_join(F.transform("patterns", lambda p: F.concat(p["type"], F.lit("="), p["matchedText"])), "; ")
    return m.select("o_orderkey", said.alias("patterns"), scoring.heuristic_score(F.col("patterns")).alias("heuristic"))


_SAID = "array_to_string(list_filter([" + ", ".join(["CASE WHEN homoglyph THEN 'homoglyph_attack=Suspicious Unicode characters detected' END", *(f"CASE WHEN n_{f} > 0 THEN '{f}=' || {_matched('t', f)} END" for f in FAMILIES)]) + "], lambda x: x IS NOT NULL), '; ')"


def quick_check(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d, "counts").select("o_orderkey", scoring.quick_check(F.col("msg")).alias("obvious"), scoring.is_blank(F.col("msg")).alias("blank"))


_QUICK = " OR ".join(f"contains(lower(msg), '{p}')" for p in scoring.PHRASES)


def fusion_max(spark: SparkSession, d: str) -> DataFrame:
    s = sides(spark, d).select("o_orderkey", fusion.fuse(F.col("vis"), F.col("vconf"), F.col("txt")).alias("r")).select("o_orderkey", "r.*")
    return s.select("o_orderkey", "fused_score", "is_scam", "risk_level", "confidence")


def fusion_weighted(spark: SparkSession, d: str) -> DataFrame:
    s = sides(spark, d).select("o_orderkey", fusion.fuse(F.col("vis"), F.col("vconf"), F.col("txt"), "weighted").alias("r")).select("o_orderkey", "r.*")
    return s.select("o_orderkey", "fused_score", "is_scam", "risk_level", "confidence")


def fusion_quick(spark: SparkSession, d: str) -> DataFrame:
    s = sides(spark, d).select("o_orderkey", fusion.fuse(F.col("vis"), F.col("vconf"), F.col("txt"), "quick").alias("r")).select("o_orderkey", "r.*")
    return s.groupBy("is_scam").agg(F.count("*").alias("n"), F.round(F.avg("fused_score"), 6).alias("mean_score"))


def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    s = sides(spark, d).select(fusion.fuse(F.col("vis"), F.col("vconf"), F.col("txt")).alias("r"))
    g = s.groupBy(F.col("r.risk_level").alias("risk_level")).agg(F.count("*").alias("n"), F.count_if("r.is_scam").alias("n_scam"))
    return g.withColumn("state", fusion.scan_state(F.col("risk_level")))


def _explained(spark: SparkSession, d: str) -> DataFrame:
    return sides(spark, d).withColumn("score", fusion.fused_score(F.col("vis"), F.col("txt")))


def _types() -> dict[str, Column]:
    """Whether each family was found, in a text that has a score."""
    return {k: F.col("txt").isNotNull() & hit for k, hit in scoring.detected(_counts(), F.col("homoglyph")).items()}


def explanations(spark: SparkSession, d: str) -> DataFrame:
    return _explained(spark, d).select("o_orderkey", fusion.explanation(F.col("score"), F.col("cat"), F.col("vconf"), _types()).alias("explanation"))


def red_flags(spark: SparkSession, d: str) -> DataFrame:
    found = F.when(F.col("txt").isNotNull(), _patterns())
    patterns = F.coalesce(found, F.array().cast("array<struct<type:string,confidence:double,matchedText:string>>"))
    return sides(spark, d, "texts").select("o_orderkey", F.array_join(fusion.red_flags(F.col("cat"), F.col("vconf"), patterns), " | ").alias("flags"))


def safety_tips(spark: SparkSession, d: str) -> DataFrame:
    return _explained(spark, d).select("o_orderkey", F.array_join(fusion.safety_tips(F.col("score"), _types()), " | ").alias("tips"))


_q = lambda s: "'" + s.replace("'", "''") + "'"
_on = lambda k: "(txt IS NOT NULL AND " + ("homoglyph" if k == "homoglyph_attack" else f"n_{k} > 0") + ")"
_EXPLAIN = (
    "concat_ws(' ', CASE WHEN score < 0.3 THEN " + _q(fusion.BANDS[0]) + " WHEN score < 0.5 THEN " + _q(fusion.BANDS[1]) + " WHEN score < 0.7 THEN " + _q(fusion.BANDS[2]) + " WHEN score < 0.85 THEN " + _q(fusion.BANDS[3]) + " ELSE " + _q(fusion.BANDS[4]) + " END, "
    + ", ".join(f"CASE WHEN cat = '{k}' AND vconf > 0.3 THEN {_q(v)} END" for k, v in fusion.VISUAL_SAYS.items())
    + ", " + ", ".join(f"CASE WHEN {_on(k)} THEN {_q(v)} END" for k, v in fusion.PATTERN_SAYS.items()) + ")"
)
_ORDER = ["homoglyph_attack", *FAMILIES]
_FLAGS = [f"CASE WHEN cat = '{k}' AND vconf > 0.5 THEN {_q(v)} END" for k, v in fusion.VISUAL_FLAGS.items()]
_FLAGS += [f"CASE WHEN {_on(k)} THEN " + (f"'{fusion.PATTERN_FLAGS[k][0]}: \"' || {_matched('t', k)} || '\"'" if fusion.PATTERN_FLAGS[k][1] else _q(fusion.PATTERN_FLAGS[k][0])) + " END" for k in _ORDER]
_TIPS = [f"CASE WHEN score > 0.5 THEN {_q(t)} END" for t in fusion.GENERAL_TIPS] + [f"CASE WHEN {_on(k)} THEN {_q(t)} END" for k, ts in fusion.PATTERN_TIPS.items() for t in ts] + [f"CASE WHEN score > 0.7 THEN {_q(t)} END" for t in fusion.LAST_TIPS]
_first5 = lambda xs: "array_to_string(list_slice(list_filter([" + ", ".join(xs) + "], lambda x: x IS NOT NULL), 1, 5), ' | ')"

def vector_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Messages by the vector that their keywords give, and how many are consistent with it: two lexicons of eight vectors, out of tables; each text is read once a lexicon."""
    known, given = (Lexicon.from_table(lexicons.table(spark, words)) for words in (lexicons.CONSISTENCY, lexicons.COLLECTION))
    m = spread(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), TASK_ROWS).select(message(F.col("o_orderkey")).alias("msg"))
    m = m.select(curate.infer_vector(F.col("msg"), given).alias("vector"), known.hits(F.col("msg")).alias("hits"))
    return m.groupBy("vector").agg(F.count("*").alias("n"), F.count_if(known.hits_of(F.col("hits"), F.col("vector")) >= 2).alias("consistent"), F.sum(F.aggregate("hits", F.lit(0), lambda s, x: s + x)).alias("hits"))


def _vector_keywords_sql() -> str:
    count = lambda words: "(" + " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words) + ")"
    arr = lambda lexicon: "[" + ", ".join(count(w) for w in lexicon.values()) + "]"
    names = "[" + ", ".join(f"'{v}'" for v in lexicons.COLLECTION) + "]"
    return f"""WITH m AS (SELECT lower({_sql_message()}) AS low FROM orders), h AS (SELECT {arr(lexicons.COLLECTION)} AS g, {arr(lexicons.CONSISTENCY)} AS h FROM m),
v AS (SELECT h, CASE WHEN list_max(g) = 0 THEN 'phishing' ELSE {names}[list_position(g, list_max(g))] END AS vector FROM h)
SELECT vector, count(*) AS n, CAST(count_if(h[list_position({names}, vector)] >= 2) AS BIGINT) AS consistent, CAST(sum(list_sum(h)) AS BIGINT) AS hits FROM v GROUP BY 1"""


def conversation_risk(spark: SparkSession, d: str) -> DataFrame:
    """The rules over the turns of conversations as they are: score, level, and how many families match."""
    m = spread(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text"), TASK_ROWS)
    t = _found(m, "text", "counts")
    n = sum(((F.col(f"n_{f}") > 0).cast("int") for f in FAMILIES), F.col("homoglyph").cast("int"))
    return t.select("conv_id", "turn", "heuristic", n.alias("n_patterns"), scoring.quick_check(F.col("text")).alias("obvious")).withColumn("level", fusion.risk_level(F.col("heuristic")))


CONVERSATION_SQL = f"""WITH t AS (SELECT conv_id, turn, text, trim(regexp_replace(translate(nfc_normalize(lower(text)), 'аеорсухѕіјԁһԝʏαορτν', 'aeopcyxsijdhwyaoptv'), '\\s+', ' ', 'g')) AS t,
  regexp_matches(text, '[\\x{{400}}-\\x{{4ff}}\\x{{370}}-\\x{{3ff}}]') AND regexp_matches(text, '[a-zA-Z]') AS homoglyph FROM conversations),
c AS (SELECT conv_id, turn, text, t, homoglyph, {_COUNTS} FROM t),
s AS (SELECT *, {_N} AS n_patterns, CASE WHEN {_N} = 0 THEN 0 ELSE least(1.0::DOUBLE, ({_TOP}) / ({_UNDER}) + least(0.3::DOUBLE, ({_N}) * 0.05::DOUBLE)) END AS heuristic FROM c)
SELECT conv_id, turn, heuristic, n_patterns, {_QUICK.replace("lower(msg)", "lower(text)")} AS obvious, {_LEVEL('heuristic')} AS level FROM s"""


QUERIES = {
    "vector_keywords": (vector_keywords, _vector_keywords_sql()),
    "conversation_risk": (conversation_risk, CONVERSATION_SQL),
    "pattern_hits": (pattern_hits, f"WITH {MESSAGES} " + " UNION ALL ".join([f"SELECT '{f}' AS family, CAST(count_if({'homoglyph' if f == 'homoglyph_attack' else f'n_{f} > 0'}) AS BIGINT) AS n_messages FROM c" for f in _ORDER])),
    "heuristic_score": (heuristic_score, f"WITH {MESSAGES} SELECT o_orderkey, heuristic FROM s"),
    "matched_texts": (matched_texts, f"WITH {MESSAGES} SELECT o_orderkey, {_SAID} AS patterns, heuristic FROM s"),
    "quick_check": (quick_check, f"WITH {MESSAGES} SELECT o_orderkey, {_QUICK} AS obvious, trim(msg) = '' AS blank FROM m"),
    "fusion_max": (fusion_max, f"WITH {MESSAGES} SELECT o_orderkey, score AS fused_score, score > 0.5 AS is_scam, {_LEVEL('score')} AS risk_level, confidence FROM fused"),
    "fusion_weighted": (fusion_weighted, f"WITH {MESSAGES} SELECT o_orderkey, weighted AS fused_score, weighted > 0.5 AS is_scam, {_LEVEL('weighted')} AS risk_level, confidence FROM fused"),
    "fusion_quick": (fusion_quick, f"WITH {MESSAGES} SELECT score > 0.5 AS is_scam, count(*) AS n, round(avg(score), 6) AS mean_score FROM fused GROUP BY 1"),
    "risk_levels": (risk_levels, f"WITH {MESSAGES}, l AS (SELECT {_LEVEL('score')} AS risk_level, score > 0.5 AS scam FROM fused) SELECT risk_level, count(*) AS n, CAST(count_if(scam) AS BIGINT) AS n_scam, CASE WHEN risk_level IN ('critical', 'high') THEN 'DANGER' WHEN risk_level = 'medium' THEN 'SUSPICIOUS' ELSE 'SAFE' END AS state FROM l GROUP BY risk_level"),
    "explanations": (explanations, f"WITH {MESSAGES} SELECT o_orderkey, {_EXPLAIN} AS explanation FROM fused"),
    "red_flags": (red_flags, f"WITH {MESSAGES} SELECT o_orderkey, {_first5(_FLAGS)} AS flags FROM fused"),
    "safety_tips": (safety_tips, f"WITH {MESSAGES} SELECT o_orderkey, {_first5(_TIPS)} AS tips FROM fused"),
}
