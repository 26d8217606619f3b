"""Keyword search, recency, fair interleaving and subscription matching."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Words that stand for each other in titles, after folding.
SYNONYMS = {("intern", "tts"): ["intern", "thuc tap", "tts"], ("fresher",): ["fresher", "moi tot nghiep"]}
PLAIN_SYNONYMS = {("intern",): ["intern", "thuc tap", "thực tập", "tts"], ("fresher",): ["fresher", "moi tot nghiep", "mới tốt nghiệp"]}


def searchable(jobs: DataFrame) -> DataFrame:
    """Adds title_clean and tags_clean; store them, so that searches needn't fold texts again."""
    return jobs.withColumn("title_clean", text.clean_text(F.col("title_normalized"))).withColumn("tags_clean", F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")), text.clean_text))


def any_of(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(x, F.lit(word))
    return out


def matches(tokens: Column, title: Column, tags: Column) -> Column:
    """Every token lies in the title or in a tag, or has a synonym in the title."""

    def one(t: Column) -> Column:
        hit = F.contains(title, t) | F.exists(tags, lambda g: F.contains(g, t))
        for triggers, words in SYNONYMS.items():
            hit = hit | (t.isin(*triggers) & any_of(title, words))
        return hit

    return F.forall(tokens, one)


def recent_first(tie: str = "job_id") -> list[Column]:
    """Newest first by ISO text, posting time before scraping time; ties by id."""
    return [F.coalesce(F.nullif(F.col("posted_at").cast("string"), F.lit("")), F.col("scraped_at").cast("string"), F.lit("")).desc(), F.col(tie).asc()]


def search(jobs: DataFrame, keyword: str, limit: int = 20, place: str | None = None, tie: str = "job_id") -> DataFrame:
    """The newest ``limit`` matches, ranked. ``place`` filters after the limit, so fewer may remain."""
    found = searchable(jobs).where(matches(text.tokens(F.lit(unicodedata.normalize("NFC", keyword))), F.col("title_clean"), F.col("tags_clean"))).drop("title_clean", "tags_clean")
    top = found.orderBy(*recent_first(tie)).limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*recent_first(tie))))  # at most ``limit`` rows
    return ranked.where(in_place(F.lit(place))) if place else ranked


def in_place(needle: Column) -> Column:
    needle = F.lower(needle)
    return F.contains(F.lower(F.col("location_normalized")), needle) | F.contains(F.lower(F.col("location")), needle)


def recent(jobs: DataFrame, as_of: Column, days: int = 7, by: list[str] | None = None, ts: str = "ts", naive: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days, undated ones too; where there are none, all rows (of a group).

    The fallback is a join with one flag a group, not a window, so that no group meets in one task. Null
    groups are groups, too.
    """
    fresh = F.col(ts).isNull() | (F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))
    if naive is not None:
        fresh = fresh | naive
    marked = jobs.withColumn("__fresh", fresh)
    flags = marked.groupBy(*(by or [])).agg(F.bool_or("__fresh").alias("__any"))
    if by:
        flags = flags.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], "__any")
        same = [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(by)]
        joined = marked.join(flags, same).drop(*[f"__{k}" for k in range(len(by))])
    else:
        joined = marked.join(F.broadcast(flags), how="cross")  # one row
    return joined.where(F.col("__fresh") | ~F.coalesce(F.col("__any"), F.lit(False))).drop("__fresh", "__any")


def interleave(jobs: DataFrame, limit: int = 20, source: str = "source", ts: Column | None = None, tie: str = "job_id") -> DataFrame:
    """Newest row of every source in the order of names, then the second of each, up to ``limit``; with rank.

    Rows beyond ``limit`` in a source are dropped before the shuffle's window runs in full.
    """
    key = F.lower(F.coalesce(F.col(source), F.lit("unknown")))
    order = Window.partitionBy("__source").orderBy((ts if ts is not None else F.col("ts")).desc(), F.col(tie))
    dealt = jobs.withColumn("__source", key).withColumn("__turn", F.row_number().over(order)).where(F.col("__turn") <= limit)
    top = dealt.orderBy("__turn", "__source").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("__turn", "__source"))).drop("__source", "__turn")


#: A subscription table beyond this many rows isn't sent to every task.
SMALL_SUBSCRIPTIONS = 50_000


def match_subscriptions(jobs: DataFrame, subs: DataFrame, limit: int = 50, keyword: str = "keyword_normalized", key: tuple[str, ...] = ("user_id", "sk"), tie: str = "job_id") -> DataFrame:
    """The newest ``limit`` matches of every subscription, ranked, with its location applied after the limit.

    Few subscriptions (counted first) go to all tasks. Many are grouped by their set of tokens, as what
    matches depends on nothing else; the sets meet postings by a short piece of text that both must hold
    (see ``by_piece``), and what was found comes back to postings and subscriptions by equality.
    """
    jobs = searchable(jobs)
    subs = subs.withColumn("__tokens", F.array_sort(F.array_distinct(text.tokens(text.composed(F.col(keyword))))))
    mine = [c for c in subs.columns if c not in jobs.columns or c in key]
    subs = subs.select(*[F.col(c) for c in mine])
    test = matches(F.col("__tokens"), F.col("title_clean"), F.col("tags_clean"))
    if subs.limit(SMALL_SUBSCRIPTIONS + 1).count() <= SMALL_SUBSCRIPTIONS:
        found = jobs.join(F.broadcast(subs), test)
    else:
        pairs = by_piece(jobs, subs.select("__tokens").distinct(), test, tie, limit)
        found = jobs.join(pairs.withColumnRenamed("__tie", tie), tie).join(subs, "__tokens")
    order = Window.partitionBy(*key).orderBy(*recent_first(tie))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    place = F.coalesce(F.col("location_filter"), F.lit("")) if "location_filter" in subs.columns else F.lit("")
    return ranked.where((place == "") | in_place(place)).drop("title_clean", "tags_clean", "__tokens")


def grams(size: int) -> Callable[[Column], Column]:
    """A function that gives all pieces of ``size`` characters."""

    def of(x: Column) -> Column:
        return F.when(F.length(x) >= size, F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda k: F.substring(x, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return of


def by_piece(jobs: DataFrame, sets: DataFrame, test: Column, tie: str, limit: int) -> DataFrame:
    """(tie, __tokens) of the newest ``limit`` postings that each set of tokens matches.

    A posting that contains a token contains each piece of it, so a set stands under one piece: of all
    pieces of three characters of its tokens (of two or one, where they are shorter) the one that fewest
    postings hold. Tokens with synonyms can be matched by other words and are left out; a set of only such
    tokens stands under each of a few words' pieces, the blank set under the empty piece. Postings send
    only ids, times and texts to match, and only under pieces that some set stands under.
    """
    none = F.array().cast("array<string>")
    texts = F.concat(F.array("title_clean"), "tags_clean")
    newest = recent_first(tie)
    held = jobs.select(F.col(tie), "posted_at", "scraped_at", "title_clean", "tags_clean")
    pieces = F.array_distinct(F.concat(F.array(F.lit("")), *[F.flatten(F.transform(texts, grams(n))) for n in (1, 2, 3)]))
    triggers = {t: words for keys, words in SYNONYMS.items() for t in keys}
    plain = F.filter("__tokens", lambda t: ~t.isin(*triggers) & (F.length(t) > 0))
    own = F.array_distinct(F.flatten(F.transform(plain, lambda t: F.when(F.length(t) >= 3, grams(3)(t)).otherwise(F.array(t)))))
    # a synonym token is in the title or a tag itself, or one of its words is in the title
    other = none
    for t, words in triggers.items():
        alike = sorted({w[:3] for w in [t, *words]})
        other = F.when(F.array_contains("__tokens", t), F.array(*map(F.lit, alike))).otherwise(other)
    standing = sets.withColumn("__own", own).withColumn("__other", F.when(F.size("__own") > 0, none).when(F.size(other) > 0, other).otherwise(F.array(F.lit(""))))
    asked = standing.select(F.explode(F.concat("__own", "__other")).alias("__piece")).distinct()
    exploded = held.select(tie, F.explode(pieces).alias("__piece"))
    common = exploded.join(asked, "__piece", "left_semi").groupBy("__piece").agg(F.count("*").alias("__n"))
    choice = standing.where(F.size("__own") > 0).select("__tokens", F.explode("__own").alias("__piece")).join(common, "__piece", "left")
    rarest = choice.groupBy("__tokens").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__piece").alias("p"))).alias("one")).where("one.n > 0")
    rare = rarest.select("__tokens", F.col("one.p").alias("__piece"))
    rare = rare.unionByName(standing.where(F.size("__own") == 0).select("__tokens", F.explode("__other").alias("__piece")))
    wanted = rare.select("__piece").distinct()
    meet = held.withColumn("__piece", F.explode(pieces)).join(wanted, "__piece", "left_semi").join(rare, "__piece").where(test)
    order = Window.partitionBy("__tokens").orderBy(*newest)
    meet = meet.select(F.col(tie).alias("__tie"), tie, "posted_at", "scraped_at", "__tokens").dropDuplicates(["__tie", "__tokens"])
    return meet.withColumn("__k", F.dense_rank().over(order)).where(F.col("__k") <= limit).select("__tie", "__tokens")


def my_jobs(jobs: DataFrame, subs: DataFrame, limit: int = 30, sub_order: str = "sub_ord", tie: str = "job_id") -> DataFrame:
    """All subscriptions of one user together: a job stays once, under the first subscription that found it."""
    found = match_subscriptions(jobs, subs, limit, "keyword_raw", ("user_id", "sk"), tie)
    first = Window.partitionBy(tie).orderBy(sub_order, "rank")
    return found.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k").withColumn("matched_keyword", F.col("keyword_raw"))


def variant_matches(keyword: Column, title: Column, tags: Column, description: Column, requirements: Column) -> Column:
    """The unfolded rule: tokens and synonyms in title, tags, description or requirements."""
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in (title, description, requirements)]

    def within(word: Column) -> Column:
        out = F.exists(tags, lambda g: F.contains(F.lower(g), word))
        for field in fields:
            out = out | F.contains(field, word)
        return out

    def one(t: Column) -> Column:
        hit = within(t)
        for triggers, words in PLAIN_SYNONYMS.items():
            for word in words:
                hit = hit | (t.isin(*triggers) & within(F.lit(word)))
        return hit

    return F.forall(text.tokens(keyword, fold=False), one)


def place_reaches(wanted: Column, place: Column) -> Column:
    """No wanted place fits any; else the normalised place holds it."""
    wanted = F.lower(F.coalesce(wanted, F.lit("")))
    return (wanted == "") | F.contains(F.lower(F.coalesce(place, F.lit(""))), wanted)


def subscription_matches(keyword: Column, place: Column, floor: Column) -> Column:
    """The unfolded rule in full on a posting's columns: keyword, then place, then salary."""
    hit = variant_matches(keyword, F.col("title"), F.coalesce(F.col("tags"), F.array().cast("array<string>")), F.col("description"), F.col("requirements"))
    return hit & place_reaches(place, F.col("location_normalized")) & salary_reaches(floor, F.col("salary_max"))


def salary_reaches(floor: Column, salary_max: Column) -> Column:
    """An unknown salary passes any floor; so does any salary where no floor is set."""
    floor, top = F.coalesce(floor, F.lit(0)), F.coalesce(salary_max, F.lit(0))
    return (floor == 0) | (top == 0) | (top >= floor)


def digests(found: DataFrame, group: str = "user_id", keyword: str = "keyword_raw", show: int = 10) -> DataFrame:
    """(group, keyword, message) of ranked matches: how many, the first ``show``, how many more."""
    esc = text.escape_markup
    link = F.when(F.coalesce(F.col("source_url"), F.lit("")) != "", F.concat(F.lit("   🔗 [Xem chi tiết]("), "source_url", F.lit(")\n"))).otherwise("")
    entry = F.concat(F.lit("*"), F.col("__k").cast("string"), F.lit("\\. "), esc(F.coalesce("title", F.lit("N/A"))), F.lit("*\n   🏢 "), esc(F.coalesce("company", F.lit("N/A"))), F.lit("\n   📍 "), esc(F.coalesce("location", F.lit(""))), F.lit("\n   💰 "), esc(F.coalesce("salary_raw", F.lit("Thỏa thuận"))), F.lit("\n"), link)
    rows = found.withColumn("__k", F.row_number().over(Window.partitionBy(group, keyword).orderBy("rank")))
    shown = F.array_sort(F.collect_list(F.when(F.col("__k") <= show, F.struct("__k", entry.alias("e")))))
    per = rows.groupBy(group, keyword).agg(F.count("*").alias("n"), shown.alias("s"))
    head = F.concat(F.lit("🔔 *"), F.col("n").cast("string"), F.lit(" việc mới* cho *"), esc(F.col(keyword)), F.lit("*\\!\n\n"))
    more = F.concat(F.lit("\n_\\.\\.\\.và "), (F.col("n") - show).cast("string"), F.lit(" việc khác\\. Dùng /search "), esc(F.col(keyword)), F.lit(" để xem tất cả\\._"))
    body = F.array_join(F.transform("s", lambda x: x["e"]), "\n")
    return per.select(group, keyword, F.concat(head, body, F.when(F.col("n") > show, more).otherwise("")).alias("message"))


def _entry(order: str, between: str, tail: list[Column]) -> Column:
    """One shown posting: number, source, title, company, place and salary, then ``tail``, then the link."""
    esc, line = text.escape_markup, F.lit("\n")
    name = esc(text.source_name(F.coalesce("source", F.lit(""))))
    head = [F.lit("*"), F.col(order).cast("string"), F.lit("\\. ["), name, F.lit("] "), esc(F.coalesce("title", F.lit("N/A"))), F.lit("*\n   🏢 "), esc(F.coalesce("company", F.lit("N/A")))]
    where = [F.lit("\n   📍 "), esc(F.coalesce("location", F.lit(""))), F.lit(between), esc(F.coalesce("salary_raw", F.lit("Thỏa thuận"))), line]
    link = F.when(F.coalesce(F.col("source_url"), F.lit("")) != "", F.concat(F.lit("   🔗 [Xem chi tiết trên "), name, F.lit("]("), "source_url", F.lit(")\n"))).otherwise("")
    return F.concat(*head, *where, *tail, link)


def listing(found: DataFrame, order: str = "rank") -> DataFrame:
    """(rank, line) of a user's own list, with the source's name and the keyword that found it."""
    tail = [F.lit("   🔑 Từ khóa: `"), text.escape_markup(F.coalesce("matched_keyword", F.lit(""))), F.lit("`\n")]
    return found.select(F.col(order).alias("rank"), _entry(order, " \\| 💰 ", tail).alias("line"))


def _message(lines: DataFrame, head: Column) -> DataFrame:
    """(n, message): a head and the lines in their order. Shown lists are short; no rows give no message."""
    rows = lines.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l")).where("n > 0")
    return rows.select("n", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("message"))


def search_message(found: DataFrame, keyword: str, place: str | None = None, order: str = "rank") -> DataFrame:
    """(n, message) of shown search results: how many for which keyword and place, then the postings."""
    esc = text.escape_markup
    lines = found.select(F.col(order).alias("rank"), _entry(order, "\n   💰 ", []).alias("line"))
    at = [F.lit(" tại *"), esc(F.lit(place)), F.lit("*")] if place else []
    return _message(lines, F.concat(F.lit("🔍 *"), F.col("n").cast("string"), F.lit(" kết quả* cho *"), esc(F.lit(keyword)), F.lit("*"), *at, F.lit(":\n\n")))


def my_jobs_message(found: DataFrame, order: str = "rank") -> DataFrame:
    """(n, message) of a user's newest postings of all keywords."""
    return _message(listing(found, order), F.concat(F.lit("📋 *Top "), F.col("n").cast("string"), F.lit(" việc làm mới nhất* từ các từ khóa đã đăng ký:\n\n")))


def single_match(jobs: DataFrame) -> Column:
    """The message of one matched posting. Empty places and salaries are named, as null ones are."""
    esc = text.escape_markup
    some = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return F.concat(
        F.lit("💼 *"), esc(F.coalesce(jobs["title"], F.lit(""))), F.lit("*\n🏢 "), esc(F.coalesce(jobs["company"], F.lit(""))), F.lit("\n📍 "), esc(some("location", "Không rõ")), F.lit("\n💰 "),
        esc(some("salary_raw", "Thỏa thuận")), F.lit("\n🔗 ["), text.capitalize(F.col("source")), F.lit("]("), F.coalesce(jobs["source_url"], F.lit("")), F.lit(")\n"),
    )


def matcher_summary(found: DataFrame, subs: DataFrame | None = None, sent: DataFrame | None = None) -> DataFrame:
    """One row: users (of the active subscriptions, if given, else of the matches), matches, and, with the
    (user_id, keyword_raw, ok) of sending, the messages that went and that failed."""
    out = found.agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("matches"))
    if subs is not None:
        out = out.drop("users").crossJoin(subs.agg(F.count_distinct("user_id").alias("users"))).select("users", "matches")  # one row each
    if sent is not None:
        went = F.coalesce(F.col("ok"), F.lit(False))
        out = out.crossJoin(sent.agg(F.count_if(went).alias("sent"), F.count_if(~went).alias("failures")))
    return out
