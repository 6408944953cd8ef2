"""Corpus curation: validation, deduplication, consistency, decontamination, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.automaton import MOST_BYTES, Lexicon, Patterns
from ..functions.text import n_tokens, preview, strip, tokens
from ..sources.shared import written
from .ordering import fresh, numbered

CHANNELS = ("sms", "email", "whatsapp", "app_notification")
LABELS = ("scam", "safe")
DEFAULT_VECTOR = "phishing"


def digest(c: Column) -> Column:
    """What texts are compared by: 256 bits of the stripped text, so that shuffles carry no text."""
    return F.sha2(strip(c), 256)


def sample_reject_reason(text: Column, label: Column, channel: Column, least_tokens: int = 4) -> Column:
    """Why a generated sample is refused, or null: missing fields, few tokens, or values out of domain (the vector isn't tested)."""
    return (
        F.when(text.isNull() | label.isNull() | channel.isNull(), "missing field")
        .when(n_tokens(text) < least_tokens, "too short")
        .when(~label.isin(*LABELS), "label")
        .when(~channel.isin(*CHANNELS), "channel")
    )


def effective_class(label: Column, vector: Column) -> Column:
    """safe for safe rows, else the vector, else unknown."""
    return F.when(label == "safe", "safe").otherwise(F.coalesce(vector, F.lit("unknown")))


def dedup_keep_first(df: DataFrame, text: str, order: str, keep: list[str] | None = None) -> DataFrame:
    """Of rows with the same stripped text the one with the smallest `order`; partial minima are taken before the shuffle."""
    keep = keep or df.columns
    first = F.min_by(F.struct(*keep), order).alias("r")
    return df.groupBy(digest(F.col(text)).alias(fresh(df, "digest"))).agg(first).select("r.*")


def duplicate_ordinals(df: DataFrame, text: str, order: str, rows: int = 250_000) -> DataFrame:
    """(order, ordinal) of the second and later occurrences of a text; a text that very many rows have is numbered in ranges of `order`."""
    return numbered(df.select(order, digest(F.col(text)).alias("digest")), order, "ordinal", ("digest",), rows).where("ordinal > 1").select(order, "ordinal")


def keyword_consistent(label: Column, vector: Column, text: Column, lexicon: Lexicon | dict[str, list[str]], least: int = 2) -> Column:
    """Safe rows pass; others need `least` of their vector's keywords, and an unknown vector has none. A text is read once for all keywords."""
    known = lexicon if isinstance(lexicon, Lexicon) else Lexicon(lexicon)
    return F.coalesce(label == "safe", F.lit(False)) | (known.hits_of(known.hits(text), vector) >= least)


def infer_vector(text: Column, lexicon: Lexicon | dict[str, list[str]], default: str = DEFAULT_VECTOR) -> Column:
    """The vector with most keywords in the text; of equals the first; the default without any. A text is read once for all keywords."""
    known = lexicon if isinstance(lexicon, Lexicon) else Lexicon(lexicon)
    hits = known.hits(text)
    most = F.coalesce(F.array_max(hits), F.lit(0))
    return F.when(most == 0, default).otherwise(F.element_at(known.names(), F.array_position(hits, most).cast("int")))


def consistency_mode(accuracy: Column) -> Column:
    """struct<mode, threshold> of the consistency stage by the baseline model's accuracy, as consistency_threshold has it."""
    row = lambda a: F.struct(F.lit(a[0]).alias("mode"), F.lit(a[1]).cast("double").alias("threshold"))
    return F.when(accuracy < 0.70, row(consistency_threshold(0.0))).when(accuracy < 0.85, row(consistency_threshold(0.7))).otherwise(row(consistency_threshold(1.0)))


def consistency_threshold(accuracy: float) -> tuple[str, float | None]:
    """The mode and threshold of the consistency stage by the baseline model's accuracy."""
    return ("keyword", None) if accuracy < 0.70 else ("model", 0.5 if accuracy < 0.85 else 0.6)


def adaptive_filter(df: DataFrame, order: str, vector: str, label: str, predicted: str, confidence: str, start: float, every: int = 2000, rate: float = 0.40, step: float = 0.1, least: float = 0.5) -> DataFrame:
    """Adds kept: prediction equals label and confidence reaches the vector's threshold, which drops once by `step`
    (to `least` at most) after the first `every`-th row at which over `rate` of the vector's rows so far are discarded.

    Two windows stand for the sequential rule. Until the drop, a row's fate depends on the start threshold alone, so
    discards by block of `every` rows are counted at that threshold, and a vector's first block end over the rate
    gives the place from which the lower threshold holds.
    """
    row, block, out, since = (fresh(df, n) for n in ("row", "block", "out", "since"))
    ordered = numbered(df, order, row)
    ok = F.col(predicted) == F.col(label)
    at_start = ordered.withColumn(block, F.floor((F.col(row) - 1) / every)).withColumn(out, F.when(ok & (F.col(confidence) >= start), 0).otherwise(1))
    blocks = at_start.groupBy(vector, block).agg(F.count("*").alias("n"), F.sum(out).alias("discarded"))
    ends = at_start.groupBy().agg(F.floor(F.max(row) / every).alias("full"))
    w = Window.partitionBy(vector).orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    grid = blocks.select(vector).distinct().crossJoin(ends).select(vector, F.explode(F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full").cast("long") - 1))).alias(block))
    so_far = grid.join(blocks, [vector, block], "left").fillna(0, ["n", "discarded"]).withColumn("n", F.sum("n").over(w)).withColumn("discarded", F.sum("discarded").over(w))
    drops = so_far.where((F.col("n") > 0) & (F.col("discarded") > F.col("n") * rate)).groupBy(vector).agg((F.min(block) + 1).alias(since))
    low = max(least, start - step)
    joined = at_start.join(F.broadcast(drops), vector, "left")  # a row a vector
    threshold = F.when(F.col(block) >= F.col(since), low).otherwise(start)
    return joined.withColumn("kept", ok & (F.col(confidence) >= threshold)).drop(row, block, out, since)


def decontaminate(df: DataFrame, holdout: DataFrame, text: str = "text", mode: str = "exact") -> DataFrame:
    """Drops rows whose stripped text equals a holdout text, or (mode contains) that contain one."""
    d = fresh(df, "digest")
    if mode == "exact":
        return df.join(holdout.select(digest(F.col(text)).alias(d)).distinct(), digest(df[text]) == F.col(d), "left_anti")
    found = containing(df.select(F.col(text).alias("text")), holdout.select(F.col(text).alias("text")))
    return df.withColumn(d, F.sha2(F.col(text), 256)).join(found.withColumnRenamed("digest", d), d, "left_anti").select(df.columns)


#: UTF-8 bytes of short passages that are searched together, in one pass over the texts.
BLOCK_BYTES = 1 << 20


def containing(df: DataFrame, holdout: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(digest) of the texts of df (text) that contain a stripped holdout text (text), as SHA-256.

    Inner words of a passage are whole words of any text that contains it, so a passage of five words or more meets texts
    on three of its inner words in a row: those that the fewest texts hold, by count; a passage of which some three are
    in no text is in none. What meets is tested. Shorter passages have no such key: automata search for all of them,
    block by block of bounded size, where the texts stand. Null texts contain nothing, and are no passages.
    """
    passages = holdout.select(strip(F.col("text")).alias("passage")).where("passage <> ''").distinct()
    three = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda k: F.xxhash64(F.slice(w, k, F.lit(3))))
    words = written(passages.withColumn("w", tokens(F.col("passage"))), "passages")
    inner = words.where(F.size("w") >= 5).withColumn("w", F.slice("w", 2, F.size("w") - 2))
    keys = inner.select("passage", F.explode(F.array_distinct(three(F.col("w")))).alias("key"))
    texts = df.select("text", tokens(F.col("text")).alias("w")).where(F.size("w") >= 3)
    held = texts.select(F.sha2("text", 256).alias("digest"), F.explode(F.array_distinct(three(F.col("w")))).alias("key"))
    held = written(held.join(keys.select("key").distinct(), "key", "left_semi").distinct(), "passage-keys")
    rare = keys.join(held.groupBy("key").agg(F.count("*").alias("n")), "key", "left").groupBy("passage").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("r"))
    met = held.join(rare.where("r.n > 0").select("passage", F.col("r.key").alias("key")), "key").select("digest", "passage").distinct()
    found = df.withColumn("digest", F.sha2("text", 256)).join(met, "digest").where(F.col("text").contains(F.col("passage"))).select("digest")
    short = words.where(F.size("w") < 5).select("passage")
    size = short.agg(F.sum(F.octet_length("passage")).alias("n")).first()["n"] or 0
    blocks = -(-size // min(block_bytes, MOST_BYTES // 2))
    for b in range(blocks):
        some = [r.passage for r in short.where(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == b).collect()]  # one block
        hit = df.where(Patterns(some).any(F.col("text"))).select(F.sha2("text", 256).alias("digest"))
        found = found.union(hit if blocks == 1 else written(hit, "short-passages"))
    return found.distinct()


def md5_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def stratified_split(df: DataFrame, strata: str, key: str, test: float = 0.10, val: float = 0.1111, seed: int = 42, rows: int = 250_000) -> DataFrame:
    """Adds split: of each stratum, in order of a seeded hash, the first round(n * test) rows are test, of the rest round(rest * val) val.

    A stratum is ranked in ranges of the hash, which is spread evenly, of about `rows` rows of the whole table.
    """
    h, part, rank, n, start = (fresh(df, c) for c in ("h", "part", "rank", "n", "start"))
    parts = max(1, -(-df.count() // rows))
    hashed = df.withColumn(h, md5_order(F.col(key), seed))
    hashed = hashed.withColumn(part, F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)))
    counts = hashed.groupBy(strata, part).agg(F.count("*").alias(n))
    w = Window.partitionBy(strata)
    before = F.coalesce(F.sum(n).over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(strata).alias(f"{strata}_"), F.col(part).alias(f"{part}_"), before.alias(start), F.sum(n).over(w).alias(n))
    ranked = hashed.withColumn(rank, F.row_number().over(Window.partitionBy(strata, part).orderBy(h, key)))
    ranked = ranked.join(starts, F.col(strata).eqNullSafe(F.col(f"{strata}_")) & (F.col(part) == F.col(f"{part}_")))
    at, n_test = F.col(start) + F.col(rank), F.floor(F.col(n) * test + 0.5)
    n_val = F.floor((F.col(n) - n_test) * val + 0.5)
    return ranked.select(*(df[c] for c in df.columns if c != "split"), F.when(at <= n_test, "test").when(at <= n_test + n_val, "val").otherwise("train").alias("split"))


def capped_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """min(k, n) rows by a seeded hash of the key."""
    return df.orderBy(md5_order(F.col(key), seed), key).limit(k)


def review_sample(df: DataFrame, by: str, key: str, text: str, most: int = 20, seed: int = 42) -> DataFrame:
    """Up to `most` rows by group, in order of a seeded hash, with an 80-character preview."""
    w = Window.partitionBy(by).orderBy(md5_order(F.col(key), seed), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(by, "rank", key, preview(F.col(text)).alias("preview"))


def augment(df: DataFrame, text: str, key: str, seed: int = 42) -> DataFrame:
    """The text as it is and in lower case, and by seeded coins in upper case (half) and with marks repeated (three in ten)."""
    coin = lambda salt: F.pmod(F.conv(F.substring(md5_order(F.concat(F.col(key).cast("string"), F.lit(salt)), seed), 1, 8), 16, 10).cast("long"), F.lit(10))
    loud = F.replace(F.replace(F.col(text), F.lit("!"), F.lit("!!")), F.lit("."), F.lit("..."))
    variants = F.array_compact(F.array(F.col(text), F.lower(text), F.when(coin("u") < 5, F.upper(text)), F.when(coin("m") < 3, loud)))
    return df.select(*[c for c in df.columns if c != text], F.explode(variants).alias(text))


def js_matrix(df: DataFrame, group: str, text: str) -> DataFrame:
    """(a, b, jsd): Jensen-Shannon distance (natural log) between the groups' unigram distributions, all ordered pairs.

    Only terms shift between groups: per pair the distance needs sums over terms that both hold; the rest of each side
    has mass 1 minus what is shared, and contributes that mass times ln 2. Pairs meet on terms after counting.
    """
    words = df.select(group, F.explode(tokens(F.lower(text))).alias("term"))
    counts = words.groupBy(group, "term").agg(F.count("*").alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("t"))
    p = counts.join(F.broadcast(total), group).select(F.col(group).alias("g"), "term", (F.col("n") / F.col("t")).alias("p"))
    q = p.select(F.col("g").alias("h"), "term", F.col("p").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    both = p.join(q, "term").where("g < h").groupBy("g", "h").agg(F.sum(F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)).alias("s"), F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    names = total.select(F.col(group).alias("a")).crossJoin(total.select(F.col(group).alias("b")))
    rest = F.lit(2.0) - F.coalesce("sp", F.lit(0.0)) - F.coalesce("sq", F.lit(0.0))
    jsd = F.sqrt(F.greatest(F.lit(0.0), (F.coalesce("s", F.lit(0.0)) + rest * F.log(F.lit(2.0))) / 2))
    joined = names.join(both, (F.least("a", "b") == F.col("g")) & (F.greatest("a", "b") == F.col("h")), "left")
    return joined.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(jsd).alias("jsd"))
