"""Documents of users, families and activity: lookups, merges and invite codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .activity import invite_code
from .ordering import fresh

#: Counters of a user's activity document, and what they are when it is made.
DEFAULTS = {"total_scans": 0, "scams": 0, "reports": 0, "recent": 0, "risk": 0, "active_days": 1}


def members_of(members: DataFrame, family: int | str | None) -> DataFrame:
    """All members of one family; with family_id first in the layout (partitioned or sorted), only its files are read."""
    return members.where(F.col("family_id") == F.lit(family))


def member_lookup(wanted: DataFrame, members: DataFrame, analytics: DataFrame) -> DataFrame:
    """Rows (user_id) of wanted with their member row and then its activity: found says whether there is a member, has_activity whether that has any."""
    known = members.withColumn("found", F.lit(True))
    counted = analytics.withColumn("has_activity", F.lit(True))
    out = wanted.join(known, "user_id", "left").join(counted, "user_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.withColumn("has_activity", flag("found") & flag("has_activity")).withColumn("found", flag("found"))


def or_else(first: Column, *others: Column) -> Column:
    """The first that is neither null nor empty, and the last whatever it is."""
    *some, last = (first, *others)
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in some), last)


def member_title(display_name: Column, email: Column) -> Column:
    return or_else(display_name, email, F.lit("Member Profile"))


def invited(attempts: DataFrame, families: DataFrame) -> DataFrame:
    """Rows (user_id, code, has_family) with the family_id they join, or a reason: codes are compared in upper case; of families that share a code the first by id."""
    first = families.groupBy(F.col("invite_code").alias("upper_code")).agg(F.min("family_id").alias("joined"))
    found = attempts.withColumn("upper_code", F.upper("code")).join(first, "upper_code", "left").drop("upper_code")
    reason = F.when(F.col("has_family"), "already in a family").when(F.col("joined").isNull(), "invalid invite code")
    return found.select(*attempts.columns, F.when(reason.isNull(), F.col("joined")).alias("family_id"), reason.alias("reason"))


def with_unique_codes(families: DataFrame, key: str, taken: DataFrame, code=invite_code, attempts: int = 64) -> DataFrame:
    """Adds invite_code to families: each key's first code that neither `taken` (invite_code) nor a smaller key has.

    All that are left try their next code in each round, and rounds end when none is left; so few collide that the
    second has next to no rows. A round's codes are found by an anti-join.
    """
    left, done = families, None
    for attempt in range(attempts):
        tried = left.withColumn("invite_code", code(F.col(key), attempt))
        first = F.row_number().over(Window.partitionBy("invite_code").orderBy(key)) == 1
        fresh_codes = tried.withColumn("is_first", first).join(taken.select("invite_code").distinct().withColumn("is_taken", F.lit(True)), "invite_code", "left")
        fresh_codes = written(fresh_codes, "codes")  # a round starts from the table of the one before it
        own = fresh_codes.where(F.col("is_first") & F.col("is_taken").isNull()).select(*families.columns, "invite_code")
        done = own if done is None else done.unionByName(own)
        left = fresh_codes.where(~F.col("is_first") | F.col("is_taken").isNotNull()).select(families.columns)
        if left.isEmpty():
            return done
        taken = taken.select("invite_code").union(own.select("invite_code"))
    raise RuntimeError(f"codes still collide after {attempts} attempts")


def merged(documents: DataFrame, updates: DataFrame, key: str, order: str, sets: tuple[str, ...] = (), adds: tuple[str, ...] = (), union: tuple[str, ...] = (), remove: tuple[str, ...] = (), upsert: bool = True) -> DataFrame:
    """documents after updates: Parquet has no rows to change, so each document is worked out anew from its updates.

    Of `sets` the last value that isn't null holds; `adds` are added up; the arrays `union` get what updates hold in
    column union_<name>, those of `remove` lose what they hold in remove_<name>. A document that doesn't exist is made
    (nulls, zeros, empty arrays), unless `upsert` is false: then its updates are left out, see unmatched.
    """
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"set_{c}") for c in sets]
    summed = [F.sum(c).alias(f"add_{c}") for c in adds]
    one = updates.groupBy(key).agg(*last, *summed, F.lit(True).alias("any_update"))
    for kind, names in (("union", union), ("remove", remove)):
        for c in names:  # elements are told apart before they meet, so a document gets each once, however many updates hold it
            elements = updates.select(key, F.explode(f"{kind}_{c}").alias("x")).distinct()
            one = one.join(elements.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias(f"{kind}_{c}")), key, "left")
    both = documents.join(one, key, "full" if upsert else "left")
    out = []
    for c in documents.columns:
        value = F.col(c)
        if c in sets:
            value = F.coalesce(F.col(f"set_{c}"), value)
        if c in adds:
            value = F.coalesce(value, F.lit(0)) + F.coalesce(F.col(f"add_{c}"), F.lit(0))
        if c in union or c in remove:
            none = F.array().cast(documents.schema[c].dataType)
            value = F.coalesce(value, none)
            if c in union:
                value = F.array_union(value, F.coalesce(F.col(f"union_{c}"), none))
            if c in remove:
                value = F.array_except(value, F.coalesce(F.col(f"remove_{c}"), none))
        out.append(value.alias(c))
    return both.select(*out)


def unmatched(documents: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates whose document doesn't exist: what an update without upsert fails on."""
    return updates.join(documents.select(key), key, "left_anti")


def with_missing(users: DataFrame, analytics: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """analytics, and a default row for each user that has none."""
    none = users.select("user_id").distinct().join(analytics.select("user_id"), "user_id", "left_anti")
    own = none.select("user_id", *(F.lit(v).cast(analytics.schema[c].dataType).alias(c) for c, v in defaults.items()))
    return analytics.select("user_id", *defaults).unionByName(own)


def concatenated(*sources: DataFrame) -> DataFrame:
    """Rows of all sources by name, with the source's ordinal, from 0; a column that a source lacks is null there."""
    taken = sources[0]
    for s in sources[1:]:
        taken = taken.unionByName(s.limit(0), allowMissingColumns=True)
    name, out = fresh(taken, "source_ordinal"), None
    for k, s in enumerate(sources):
        rows = s.withColumn(name, F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
