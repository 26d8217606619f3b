"""Subscriptions: adding, removing, listing, and the keywords they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse, text

# Keywords that are always looked for.
SEED_KEYWORDS = ["software engineer", "data engineer", "kế toán", "marketing", "nhân sự"]
MOST = 3
# Commands in the order in which they are looked for.
COMMANDS = ["start", "subscribe", "unsubscribe", "list", "myjobs", "jobs", "search", "help"]


def items(requests: DataFrame) -> DataFrame:
    """(user_id, request) rows as subscription rows: key, keyword, canonical city."""
    parts = text.keyword_and_place(F.col("request"))
    rows = requests.withColumn("__p", parts).withColumn("keyword_raw", F.col("__p.keyword"))
    key = text.strip(F.lower("keyword_raw"))
    return rows.select("user_id", F.concat(F.lit("SUB#"), key).alias("sk"), "keyword_raw", key.alias("keyword_normalized"), parse.location(F.col("__p.location")).alias("location_filter"), F.lit(0).cast("long").alias("salary_min_filter"), F.lit(True).alias("is_active"))


def commands(updates: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds command and argument to chat texts; blank texts drop out, and a text without a command is a search.

    The first command that the trimmed text starts with counts; the argument is the text without any of
    that command's occurrences, trimmed.
    """
    said = text.strip(F.coalesce(F.col(text_col), F.lit("")))
    command = F.lit("search")
    for word in reversed(COMMANDS):
        command = F.when(said.startswith(f"/{word}"), "myjobs" if word == "jobs" else word).otherwise(command)
    rows = updates.withColumn("__said", said).where("__said != ''").withColumn("command", command)
    takes = F.col("command").isin("subscribe", "unsubscribe", "search")
    rest = F.when(F.col("__said").startswith("/"), text.strip(F.replace("__said", F.concat(F.lit("/"), "command")))).otherwise(F.col("__said"))
    return rows.withColumn("argument", F.when(takes, rest)).drop("__said")


def users(updates: DataFrame, created_at: Column, *keep: str) -> DataFrame:
    """User rows of people who start the bot: (user_id, username, first_name) with their profile key, and ``keep``."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    stamp = F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return updates.select("user_id", F.lit("PROFILE").alias("sk"), some("username").alias("username"), some("first_name").alias("first_name"), F.lit(True).alias("is_active"), stamp.alias("created_at"), F.lit("").alias("last_notified_at"), *keep)


def put_users(existing: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """User rows after the new ones are put: whole rows are replaced, the last in order counts."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("user_id", "sk").orderBy(F.col("__new").desc(), *[c.desc() for c in order])
    return both.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "__new")


def accept(existing: DataFrame, asked: DataFrame, order: list[Column]) -> DataFrame:
    """New subscriptions that a user may have: not one there is already, and ``MOST`` in all, inactive ones too."""
    new = asked.join(existing.select("user_id", "sk"), ["user_id", "sk"], "left_anti")
    first = Window.partitionBy("user_id", "sk").orderBy(*order)
    new = new.withColumn("__k", F.row_number().over(first)).where("__k = 1")
    held = existing.groupBy("user_id").agg(F.count("*").alias("__held"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return new.withColumn("__turn", turn).join(held, "user_id", "left").where(F.col("__turn") + F.coalesce("__held", F.lit(0)) <= MOST).drop("__k", "__turn", "__held")


def unsubscribe_matches(subs: DataFrame, asked: DataFrame) -> DataFrame:
    """Subscriptions of the user whose keyword contains the asked one or lies in it; blank ones never match."""
    key = text.strip(F.lower(F.coalesce(F.col("keyword_normalized"), F.lit(""))))
    want = text.strip(F.lower(F.col("__asked")))
    rows = subs.join(asked.select("user_id", F.col("keyword").alias("__asked")), "user_id")
    return rows.where((key != "") & (F.contains(key, want) | F.contains(want, key))).drop("__asked")


def remove(subs: DataFrame, gone: DataFrame) -> DataFrame:
    return subs.join(gone.select("user_id", "sk"), ["user_id", "sk"], "left_anti")


def active(subs: DataFrame) -> DataFrame:
    return subs.where(F.coalesce("is_active", F.lit(True)) & F.col("sk").startswith("SUB#"))


def of_user(subs: DataFrame, user: str) -> DataFrame:
    """Subscriptions of one user, inactive ones too; the user's profile is none."""
    return subs.where((F.col("user_id") == user) & F.col("sk").startswith("SUB#"))


def listed(subs: DataFrame) -> DataFrame:
    """Active subscriptions with the number of all of the user's, inactive ones too."""
    mine = subs.where(F.col("sk").startswith("SUB#"))
    counts = mine.groupBy("user_id").agg(F.count("*").alias("n_all"))
    return mine.where(F.coalesce("is_active", F.lit(True))).join(counts, "user_id")


def by_user(subs: DataFrame) -> DataFrame:
    """(user_id, keywords in order, how many) of active subscriptions; a user has at most ``MOST``."""
    return active(subs).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("keyword_raw")), ", ").alias("keywords"), F.count("*").alias("n"))


def keywords(subs: DataFrame) -> DataFrame:
    """Seed keywords and those of active subscriptions, each once; blank ones drop out."""
    seed = subs.sparkSession.createDataFrame([(k,) for k in SEED_KEYWORDS], "keyword string")
    asked = active(subs).select(F.col("keyword_normalized").alias("keyword")).where(text.strip(F.coalesce("keyword", F.lit(""))) != "")
    return seed.union(asked).distinct()


def scan_plan(sources: DataFrame, words: DataFrame) -> DataFrame:
    """Every source with every keyword: what a scheduled scan asks for. Both sides are lists of names."""
    return sources.select("source").distinct().crossJoin(words.select("keyword"))
