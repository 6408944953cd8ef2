"""Per-user activity folded from an event log, and group membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordering import fresh, running_totals

#: What an event of the log is: a scan that found a scam, a safe scan, a report, an app opening, or a daily decay.
KINDS = ("scam", "safe", "report", "open", "decay")


def counters(log: DataFrame) -> DataFrame:
    """(user_id, total_scans, scams, reports, opens, last_active) by partial sums; scams are detected and blocked alike."""
    is_ = lambda *k: F.col("kind").isin(*k)
    return log.groupBy("user_id").agg(
        F.count_if(is_("scam", "safe")).alias("total_scans"),
        F.count_if(is_("scam")).alias("scams"),
        F.count_if(is_("report")).alias("reports"),
        F.count_if(is_("open")).alias("opens"),
        F.max(F.when(is_("scam", "safe", "open"), F.col("ts"))).alias("last_active"),
    )


def active_days(log: DataFrame) -> DataFrame:
    """(user_id, active_days): 1, and 1 more for each opening on another day than the event before it.

    A scan moves the last-active day as well, so a scan after midnight takes the next opening's day. So a day counts if
    its first scan or opening is an opening, save a user's first: partial minima by user and day tell, and no task sees
    all events of a user.
    """
    rows = log.where(F.col("kind").isin("scam", "safe", "open")).select("user_id", F.to_date("ts").alias("day"), "kind", F.struct("ts", "event_id").alias("at"))
    days = rows.groupBy("user_id", "day").agg((F.min_by("kind", "at") == "open").alias("opened"))
    first = F.when(F.min_by("opened", "day"), 1).otherwise(0)
    return days.groupBy("user_id").agg((1 + F.count_if("opened") - first).alias("active_days"))


def with_decay(log: DataFrame, through: Column | None = None) -> DataFrame:
    """The log with a decay event at the end of each day from a user's first day to the last but one, or to the day before `through` if that is later."""
    last = F.max(F.to_date("ts"))
    span = log.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("a"), (last if through is None else F.greatest(last, through)).alias("b")).where("a < b")
    days = span.select("user_id", F.explode(F.sequence("a", F.date_sub("b", 1))).alias("day"))
    decay = days.select("user_id", (F.date_add("day", 1).cast("timestamp_ntz") - F.expr("interval 1 microsecond")).alias("ts"), F.lit(2**62).cast("long").alias("event_id"), F.lit("decay").alias("kind"))
    return log.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "kind").unionByName(decay)


def compose(first: Column, then: Column) -> Column:
    """One after the other of two maps x -> min(hi, max(lo, x + a)), as struct<a, lo, hi>: such a map again, so long histories can be folded in parts."""
    cut = lambda x: F.least(then["hi"], F.greatest(then["lo"], x + then["a"]))
    return F.struct((first["a"] + then["a"]).alias("a"), cut(first["lo"]).alias("lo"), cut(first["hi"]).alias("hi"))


#: Bounds of a map that cuts nothing on that side; far enough from a long's own to be added to.
FAR = 1 << 60
#: Decays of a user that are folded in one row.
DECAYS_A_ROW = 1024


def _risk(scams: Column, decays: Column) -> Column:
    """What `decays` decays and then `scams` scams do to the risk."""
    long = lambda x: F.lit(x).cast("long")
    down = F.struct((-decays).alias("a"), long(0).alias("lo"), long(FAR).alias("hi"))
    up = F.struct((5 * scams).alias("a"), long(-FAR).alias("lo"), long(100).alias("hi"))
    return compose(F.when(decays > 0, down).otherwise(F.struct(long(0).alias("a"), long(-FAR).alias("lo"), long(FAR).alias("hi"))), F.when(scams > 0, up).otherwise(F.struct(long(0).alias("a"), long(-FAR).alias("lo"), long(FAR).alias("hi"))))


def fold(log: DataFrame, rows: int = 250_000, decays_a_row: int = DECAYS_A_ROW) -> DataFrame:
    """(user_id, recent, risk): events in order; a scam adds 1 and 5 (100 at most), a decay takes a tenth (floor) and 1 (0 at least).

    Between two decays only the number of scams matters, so events are counted by how many decays of their user come
    before them, in ranges of time where a user has very many. Stretches of a bounded number of decays are folded each in a
    row of its own: the risk as a map that composes with the next one, so that stretches need no order until they meet;
    the recent scams, whose floors don't compose, stretch after stretch, in as many rounds as the longest history has
    stretches (one, for three years of daily decays).
    """
    zero = F.lit(0).cast("long")
    own = log.where(F.col("kind").isin("scam", "decay")).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "kind")
    is_decay = F.when(F.col("kind") == "decay", 1).otherwise(0).cast("long")
    after = running_totals(own, "us", {"before": is_decay}, ("user_id",), rows, ("event_id",)).withColumn("epoch", F.col("before") + is_decay)
    counts = after.groupBy("user_id", "epoch").agg(F.count_if(F.col("kind") == "scam").alias("n"))
    stretch = F.floor(F.col("epoch") / decays_a_row)
    parts = counts.groupBy("user_id", stretch.alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("epoch", "n"))).alias("e"))
    nothing = F.struct(zero.alias("a"), F.lit(-FAR).cast("long").alias("lo"), F.lit(FAR).cast("long").alias("hi"))
    # An epoch without an event of its own kind has a decay at its start all the same: every epoch from 1 on is there.
    step = lambda m, e: compose(m, _risk(e["n"], F.when(e["epoch"] > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    parts = written(parts.withColumn("risk", F.aggregate("e", nothing, step)), "stretches")
    risk = parts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "risk"))).alias("m"))
    total = F.aggregate("m", nothing, lambda m, x: compose(m, x["risk"]))
    risk = risk.select("user_id", F.least(total["hi"], F.greatest(total["lo"], total["a"])).alias("risk"))
    last = parts.agg(F.max("stretch").alias("k")).first()["k"]
    recent = log.select("user_id").distinct().withColumn("recent", zero)
    for k in range((last if last is not None else -1) + 1):
        here = parts.where(F.col("stretch") == k).select("user_id", "e")
        one = lambda r, e: F.floor(F.when(e["epoch"] > 0, r * 9).otherwise(r * 10) / 10) + e["n"]
        recent = recent.join(here, "user_id", "left").select("user_id", F.coalesce(F.aggregate("e", F.col("recent"), one), F.col("recent")).alias("recent"))
        recent = recent if last == 0 else written(recent, "recent")
    return recent.join(risk, "user_id", "left").select("user_id", "recent", F.coalesce("risk", zero).alias("risk"))


def recent_window(log: DataFrame, days: int = 30) -> DataFrame:
    """(user_id, event_id, scams_in_window): scams in the days up to each scan, by a range frame."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    w = Window.partitionBy("user_id").orderBy("second").rangeBetween(-days * 86_400, 0)
    scans = log.where(F.col("kind").isin("scam", "safe")).select("user_id", "event_id", "kind", F.floor(seconds).alias("second"))
    return scans.select("user_id", "event_id", F.sum(F.when(F.col("kind") == "scam", 1).otherwise(0)).over(w).alias("scams_in_window"))


def visible(analytics: DataFrame, users: DataFrame, reader: str = "reader", target: str = "user_id") -> DataFrame:
    """(reader, user_id) that may be read: one's own row, and rows of users in the same family (no family is no family)."""
    member = users.where("family_id is not null").select(F.col("user_id").alias("member"), "family_id")
    readers = member.select(F.col("member").alias("reading"), "family_id")
    rows = analytics.select(F.col(target).alias("own")).distinct()
    same = rows.join(member, F.col("own") == F.col("member")).join(readers, "family_id").select(F.col("reading").alias(reader), F.col("own").alias(target))
    return same.union(rows.select(F.col("own").alias(reader), F.col("own").alias(target))).distinct()


def remove_families(users: DataFrame, members: DataFrame, families: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, members, families) without the families of `gone`: their users have no family then."""
    g = gone.select("family_id").distinct()
    removed = fresh(users, "removed")
    marked = users.join(g.withColumn(removed, F.lit(True)), "family_id", "left")
    kept = marked.withColumn("family_id", F.when(F.col(removed).isNull(), F.col("family_id"))).select(users.columns)
    return kept, members.join(g, "family_id", "left_anti"), families.join(g, "family_id", "left_anti")


def membership_reject_reason(action: Column, has_family: Column, is_admin: Column, is_self: Column) -> Column:
    """Why a membership action is refused, or null."""
    return (
        F.when(action.isin("create", "join") & has_family, "already in a family")
        .when(action.isin("remove", "delete", "regenerate") & ~is_admin, "not the admin")
        .when((action == "remove") & is_self, "admin can't remove self")
        .when((action == "leave") & is_admin, "admin can't leave")
    )


def permissions(user: Column, admin: Column) -> Column:
    """struct<role, can_invite, can_remove, can_delete, can_regenerate, can_leave>."""
    boss = user == admin
    return F.struct(F.when(boss, "admin").otherwise("member").alias("role"), *(boss.alias(n) for n in ("can_invite", "can_remove", "can_delete", "can_regenerate")), (~boss).alias("can_leave"))


def invite_code(key: Column, attempt: int = 0) -> Column:
    """Eight characters of a 32-letter alphabet without I, O, 0 and 1, from a hash; a collision takes the next attempt."""
    h = F.sha2(F.concat(key.cast("string"), F.lit(f":{attempt}")), 256)
    bits = [F.conv(F.substring(h, 1 + 2 * k, 2), 16, 10).cast("int") % 32 for k in range(8)]
    alphabet = F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ23456789")
    return F.concat(*(F.substring(alphabet, b + 1, F.lit(1)) for b in bits))


def quota_plan(targets: DataFrame, sensitive: tuple[str, ...] = ("romance_grooming", "government_impersonation"), local: float = 0.10, flash: float = 0.40, hard: float = 0.25) -> DataFrame:
    """(vector, remaining, local, flash, lite, hard) of rows (vector, target, existing): floor shares of what is missing.

    hard: of what is missing of `safe`, that share is hard negatives; null for other vectors.
    """
    share = F.when(F.col("vector").isin(*sensitive), F.least(F.lit(local * 2.5), F.lit(0.25))).otherwise(F.lit(local))
    r = targets.withColumn("remaining", F.greatest(F.col("target") - F.col("existing"), F.lit(0)))
    r = r.withColumn("local", F.floor(F.col("remaining") * share))
    r = r.withColumn("flash", F.floor((F.col("remaining") - F.col("local")) * flash))
    lite = F.col("remaining") - F.col("local") - F.col("flash")
    return r.select("vector", "remaining", "local", "flash", lite.alias("lite"), F.when(F.col("vector") == "safe", F.floor(F.col("remaining") * hard)).alias("hard"))
