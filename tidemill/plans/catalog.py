"""One registered query per operator, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, parse, text
from ..operators import postings, search, subscriptions
from ..sources import boards, feeds
from ..streaming import ingest, logs
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def shown(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def as_of() -> Column:
    return F.lit(A.AS_OF).cast("timestamp")


QUERY_TEXTS = ["Data Engineer/Python | Hà Nội", "Kế toán, Đà Nẵng", "R", " | hcm", "C-level  manager", "thực tập|", "a b c"]
PLACES = ["TP.HCM", "Hà Nội, Hồ Chí Minh", "Quận 12", "HN", "  Huế ", "", "Bình Dương"]
CHATS = ["/start", " /subscribe Kế toán | Hà Nội ", "/unsubscribe ring", "/list", "/jobs", "/myjobs now", "/search data /search", "/help", "data engineer", "  ", "/unknown x", "/subscribe"]
TITLES = ["Data Intern", "Thực tập sinh marketing", "TTS kế toán", "Fresher Java", "Mới tốt nghiệp", "Senior Python"]


@query
def normalize_title(spark, d):
    return A.docs(spark, d).select("doc_id", text.nfc(text.normalize_text(F.col("title"))).alias("t"))


@query
def clean_text(spark, d):
    return A.docs(spark, d).select("doc_id", text.clean_text(F.col("title")).alias("t"))


@query
def tokenize_query(spark, d):
    rows = spark.createDataFrame([(q,) for q in QUERY_TEXTS], "q string").withColumn("p", text.keyword_and_place(F.col("q")))
    return rows.select("q", F.col("p.keyword").alias("keyword"), F.col("p.location").alias("place"), F.array_join(text.tokens(F.col("p.keyword")), "#").alias("tokens"))


@query
def location_canon(spark, d):
    inline = spark.createDataFrame([(p,) for p in PLACES], "place string")
    rows = inline.unionByName(A.table(spark, d, "customer").select(F.concat(F.col("c_mktsegment"), F.lit(" hcm "), F.col("c_nationkey").cast("string")).alias("place")))
    return rows.select("place", parse.location(F.col("place")).alias("city"))


@query
def salary_parse(spark, d):
    rows = A.salaries(spark, d).withColumn("s", parse.salary(F.col("salary_raw")))
    return rows.where("not s.bad").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("s.low").alias("low"), F.col("s.high").alias("high"))


@query
def salary_row_drop(spark, d):
    rows = A.salaries(spark, d).withColumn("s", parse.salary(F.col("salary_raw")))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if("s.bad").alias("dropped"))


@query
def job_type_classify(spark, d):
    rows = A.table(spark, d, "part").withColumn("k", F.when(F.col("p_size") % 3 == 0, "Full-Time").when(F.col("p_size") % 5 == 0, "Hợp đồng remote").otherwise(F.col("p_type")))
    return rows.select("p_partkey", parse.job_type(F.col("k"), F.col("p_name"), F.lit(None).cast("string")).alias("job_type"))


@query
def tag_extract(spark, d):
    rows = A.docs(spark, d).withColumn("r", F.when(F.col("doc_id") % 2 == 0, "C++ / C# / Go / JavaScript trust ai, SQL").otherwise("spark c++11 (etl)"))
    return rows.select("doc_id", F.array_join(parse.tags(F.col("title"), F.col("description"), F.col("r")), ",").alias("tags"))


@query
def date_parse(spark, d):
    rows = A.dates(spark, d).withColumn("p", parse.posted_at(F.col("posted_at_raw"), F.col("base")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown("p.ts").alias("ts"), F.col("p.naive").alias("naive"))


@query
def content_id(spark, d):
    title = text.normalize_text(F.col("p_name"))
    rows = A.table(spark, d, "part")
    return rows.select("p_partkey", identity.posting_id(title, F.col("p_brand"), F.lower("p_type")).alias("job_id"), identity.cross_source_id(title, F.col("p_brand")).alias("cross_id"))


@query
def dedup_first_wins(spark, d):
    return postings.dedup(A.parts(spark, d), [F.col("job_id")]).select("job_id", "title", "company", "source")


@query
def dedup_same_source(spark, d):
    return postings.dedup(A.parts(spark, d), [F.col("job_id")], cross_source=False).select("job_id", "title", "company", "source")


@query
def dedup_documents(spark, d):
    rows = A.docs(spark, d).withColumn("title_normalized", text.normalize_text(F.col("title")))
    return postings.dedup(rows, [F.col("doc_id")]).select("doc_id", "source")


@query
def upsert_last_wins(spark, d):
    rows = A.events(spark, d).select("user_id", "job_id", "value")
    old, new = rows.where("job_id % 3 = 0"), rows.where("job_id % 3 <> 0")
    return postings.upsert(postings.upsert(old.limit(0), old, "user_id", [F.col("job_id")]), new, "user_id", [F.col("job_id")])


@query
def anti_join_new(spark, d):
    return postings.new_only(A.table(spark, d, "customer").select("c_custkey", "c_name"), A.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query
def semi_join_existing(spark, d):
    return postings.known_only(A.table(spark, d, "customer").select("c_custkey", "c_name"), A.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query
def store_item(spark, d):
    jobs = postings.transform(A.docs(spark, d))
    return postings.stored(jobs, as_of()).select("job_id", "source_posted", F.length("description").alias("n_description"), "scraped_at", "posted_at", "ttl")


@query
def transform_batch(spark, d):
    return postings.transform(A.docs(spark, d)).select("job_id", "title_normalized", "location_normalized", "salary_min", "salary_max", "job_type", F.array_join("tags", ",").alias("tags"), "source")


@query
def ttl_live(spark, d):
    rows = A.events(spark, d).withColumn("ttl", F.unix_timestamp("ts") + 15 * 86400)
    return postings.live(rows, as_of()).select("job_id", "ttl")


@query
def raw_validate(spark, d):
    return postings.valid(A.docs(spark, d).withColumn("title", F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("title")))).select("doc_id")


@query
def raw_issues(spark, d):
    rows = A.docs(spark, d).withColumn("title", F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("doc_id") % 5 == 1, " Ab ").otherwise(F.col("title")))
    return postings.issues(rows).select("doc_id", "is_valid", F.array_join("issues", "; ").alias("issues"))


def _messy(spark, d):
    rows = A.docs(spark, d)
    rows = rows.withColumn("title", F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("doc_id") % 5 == 1, "Ab").otherwise(F.col("title")))
    return rows.withColumn("company", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("company")))


@query
def quality_report(spark, d):
    return postings.quality(_messy(spark, d))


@query
def quality_by_source(spark, d):
    return postings.quality(_messy(spark, d), "source")


@query
def source_summary(spark, d):
    return postings.source_summary(_messy(spark, d))


@query
def processed_validate(spark, d):
    rows = A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") == 7, "").otherwise("t").alias("title_normalized"), F.lit("x").alias("job_id"),
        F.when(F.col("l_linenumber") == 2, "").otherwise("u").alias("source_url"), F.col("l_quantity").cast("long").alias("salary_min"), (F.col("l_linenumber") * 5).cast("long").alias("salary_max"),
    )
    return postings.processed_issues(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_valid", F.array_join("issues", "; ").alias("issues"))


@query
def keyword_union(spark, d):
    return subscriptions.keywords(A.subscriptions(spark))


@query
def source_keyword_cross(spark, d):
    return subscriptions.scan_plan(A.events(spark, d), subscriptions.keywords(A.subscriptions(spark)))


@query
def source_union(spark, d):
    return feeds.union_all([A.parts(spark, d).select("title", "source"), A.docs(spark, d).select("title", "source")]).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))


@query
def search_keyword(spark, d):
    return search.search(A.parts(spark, d), "Red, Widget economy").select("rank", "job_id", "title", "posted_at")


@query
def search_documents(spark, d):
    rows = A.docs(spark, d).select(F.col("doc_id").alias("job_id"), F.lower("title").alias("title_normalized"), F.lit(None).cast("array<string>").alias("tags"), F.lit("").alias("posted_at"), shown("scraped_at").alias("scraped_at"))
    return search.search(rows, "the / and", 50).select("rank", "job_id", "scraped_at")


@query
def search_synonyms(spark, d):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "job_id int, title string")
    rows = search.searchable(rows.select("job_id", "title", text.normalize_text(F.col("title")).alias("title_normalized"), F.array().cast("array<string>").alias("tags")))
    words = spark.createDataFrame([("intern",), ("tts",), ("fresher",), ("thuc",), ("python",)], "w string")
    return rows.join(F.broadcast(words), search.matches(text.tokens(F.col("w")), F.col("title_clean"), F.col("tags_clean"))).select("job_id", "w")


@query
def search_location_after_limit(spark, d):
    return search.search(A.parts(spark, d), "ring", 50, "brand#1").select("rank", "job_id", "location")


@query
def recency_filter(spark, d):
    return search.recent(A.events(spark, d), as_of()).select("job_id", shown("ts").alias("ts"))


@query
def recency_fallback(spark, d):
    rows = A.events(spark, d).where("source <> 'error' or ts < timestamp '2024-01-15'")
    return search.recent(rows, as_of(), 7, ["source"]).groupBy("source").agg(F.count("*").alias("n"), F.min("job_id").alias("first"))


@query
def interleave_top20(spark, d):
    return search.interleave(search.recent(A.events(spark, d), as_of())).select("rank", "job_id", "source", shown("ts").alias("ts"))


def _matched(spark, d, limit=50):
    subs = subscriptions.active(A.subscriptions(spark))
    return search.match_subscriptions(A.parts(spark, d), subs, limit)


@query
def match_subscriptions(spark, d):
    return _matched(spark, d).select("user_id", "sk", "rank", "job_id", "title")


@query
def myjobs_union_dedup(spark, d):
    subs = subscriptions.of_user(A.subscriptions(spark), "u1")
    return search.my_jobs(A.parts(spark, d), subs).select("job_id", "matched_keyword", "rank")


@query
def match_variant_salary(spark, d):
    rows = A.parts(spark, d).where(search.variant_matches(F.lit("small gear"), F.col("title"), F.col("tags"), F.col("description"), F.col("requirements")) & search.salary_reaches(F.lit(20_000), F.col("salary_max")))
    return rows.select("job_id", "salary_max")


@query
def new_since(spark, d):
    return postings.new_since(A.events(spark, d), F.lit("2024-01-20").cast("timestamp"), "ts").select("job_id", "source")


@query
def subs_cap(spark, d):
    asked = spark.createDataFrame([("u1", "Kế toán | Hà Nội", 1), ("u1", "ring", 2), ("u2", "Bolt, HCM", 1), ("u2", "nut", 2), ("u5", "cog", 1)], "user_id string, request string, n int")
    rows = subscriptions.items(asked).join(asked.select("user_id", F.concat(F.lit("SUB#"), text.strip(F.lower(text.keyword_and_place(F.col("request"))["keyword"]))).alias("sk"), "n"), ["user_id", "sk"])
    return subscriptions.accept(A.subscriptions(spark).where("sk like 'SUB#%'"), rows, [F.col("n")]).select("user_id", "sk", "keyword_raw", "location_filter")


@query
def unsubscribe_match(spark, d):
    asked = spark.createDataFrame([("u1", "WIDGET"), ("u2", "gears"), ("u4", "x")], "user_id string, keyword string")
    return subscriptions.unsubscribe_matches(A.subscriptions(spark), asked).select("user_id", "sk")


@query
def unsubscribe_remaining(spark, d):
    asked = spark.createDataFrame([("u1", "WIDGET"), ("u2", "gears")], "user_id string, keyword string")
    return subscriptions.remove(A.subscriptions(spark), subscriptions.unsubscribe_matches(A.subscriptions(spark), asked)).select("user_id", "sk")


@query
def subs_list(spark, d):
    return subscriptions.listed(A.subscriptions(spark)).select("user_id", "keyword_raw", "n_all")


@query
def user_subs_grouped(spark, d):
    return subscriptions.by_user(A.subscriptions(spark))


@query
def escape_md(spark, d):
    return A.docs(spark, d).select("doc_id", text.escape_markup(F.col("description")).alias("t"))


@query
def unescape_md(spark, d):
    return A.docs(spark, d).select("doc_id", text.unescape_markup(F.concat(text.escape_markup(F.col("title")), F.lit(r"\!\q"))).alias("t"))


@query
def digest_text(spark, d):
    return search.digests(_matched(spark, d))


@query
def listing_text(spark, d):
    found = search.interleave(search.my_jobs(A.parts(spark, d), subscriptions.of_user(A.subscriptions(spark), "u1")).drop("rank"), ts=F.col("posted_at"))
    return search.listing(found)


@query
def source_display(spark, d):
    return spark.createDataFrame([(s,) for s in ("itviec", "CAREERLINK", "ybox", "jOOBLE", "timviec365", "vieclam24h", "careerviet", "my work", "")], "s string").select("s", text.source_name(F.col("s")).alias("shown"))


@query
def url_path_encode(spark, d):
    return A.table(spark, d, "pages").select("page_id", text.encode_path(F.concat("url", F.lit(" kế toán*~+"))).alias("u"))


@query
def json_props(spark, d):
    return A.events(spark, d).select("job_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query
def json_api(spark, d):
    rows = A.table(spark, d, "part").select(F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("snippet")), F.struct(F.lit("  ").alias("title"), F.lit("x").alias("company"), F.lit("y").alias("snippet"))).alias("jobs"))).alias("body"))
    return feeds.api_postings(rows).groupBy("title", "company", "description").agg(F.count("*").alias("n"))


@query
def queue_messages(spark, d):
    rows = A.docs(spark, d).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "jooble").when(F.col("doc_id") % 3 == 1, "ybox").otherwise("elsewhere"))
    raw, bad = feeds.consume(postings.messages(rows).unionByName(spark.createDataFrame([("{broken",)], "value string")))
    return raw.groupBy("source").agg(F.count("*").alias("n")).unionByName(bad.agg(F.lit("(quarantine)").alias("source"), F.count("*").alias("n")))


def _page(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _scan(spark: SparkSession, d: str, board: str, html: Column) -> DataFrame:
    """Postings of pages made of parts, one or two cards a page."""
    pages = A.table(spark, d, "part").select(html.alias("html"), F.lit(A.AS_OF).cast("timestamp").alias("scraped_at"))
    return boards.scan(pages, board).select("title", "company", "location", "salary_raw", "description", "source_url", "posted_at_raw", "job_type_raw", "source")




def _part() -> tuple[Column, ...]:
    """Key, name, brand, type and size of parts."""
    return F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")


def _seventh(whole: Column, broken: Column) -> Column:
    """One part in seven gets a card that can't be read."""
    return F.when(F.col("p_size") % 7 == 0, broken).otherwise(whole)


@query
def scan_careerlink(spark, d):
    key, name, brand, kind, size = _part()
    minute = F.when(size % 3 == 0, "soon").otherwise((F.col("p_partkey") * 60 + 1704067200).cast("string"))
    link = _seventh(_page('<a class="job-link x" href="/j/', key, '">  ', name, " </a>"), F.lit('<a href="/j">none</a>'))
    fields = _page('<a class="job-company">', brand, '</a><span class="job-location">Hà Nội</span><span class="job-salary"> ', size.cast("string"), ' triệu</span><i class="job-position">', kind, "</i>")
    return _scan(spark, d, "careerlink", _page('<ul><li class="job-item">', link, fields, '<b class="cl-datetime" data-datetime="', minute, '"></b></li><li class="job-item"></li></ul>'))


@query
def scan_itviec(spark, d):
    key, name, brand, kind, size = _part()
    where = F.when(size % 2 == 0, "Hà Nội").otherwise("da nang")
    how = F.when(size % 3 == 0, "Remote").when(size % 3 == 1, "At office").otherwise("Hybrid")
    pay = F.when(size % 3 == 0, "").otherwise(_page("<p> Salary ", size.cast("string"), "</p>"))
    head = _page('<div class="job-card" data-search--job-selection-job-slug-value="s-', key, '"><h3> ', name, '</h3><span class="small-text text-dark-grey">Posted   ', size.cast("string"), " hours\n ago</span>")
    return _scan(spark, d, "itviec", _page(head, '<a href="/companies/x">', brand, "</a>", pay, '<a href="/x?Skill+tag">Java</a><a class="itag-light">', kind, "</a> <i>", where, "</i> <i>", how, "</i></div>"))


@query
def scan_careerviet(spark, d):
    key, name, brand, kind, size = _part()
    place = F.when(size % 2 == 0, "<ul><li>Hà Nội</li><li> Huế</li></ul>").otherwise(kind)
    title = F.when(size % 2 == 0, _page('title="', name, '">x')).otherwise(_page(">", name))
    link = _seventh(_page('<a class="job_link" href="https://careerviet.vn/vi/j-', key, '" ', title, "</a>"), F.lit("<a>none</a>"))
    return _scan(spark, d, "careerviet", _page('<div class="job-item">', link, '<a class="company-name" title="', brand, '">?</a><div class="salary">Lương : ', size.cast("string"), ' Tr</div><div class="location">', place, "</div><time>05-01-2024</time></div>"))


@query
def scan_timviec365(spark, d):
    key, name, brand, _, size = _part()
    link = _page('<a href="/v-p', key, '.html">')
    where = F.when(size % 2 == 0, "<i>Đà Nẵng</i>").otherwise("")
    return _scan(spark, d, "timviec365", _page("<div><p>", link, name, '</a></p><a href="/acme-co3.html">', brand, "</a>", where, "<i>", size.cast("string"), " - ", (size + 2).cast("string"), ' triệu</i><i>05/01/2024</i></div><div>', link, 'again</a><a href="/z-p1.html">ab</a></div>'))


@query
def scan_vieclam24h(spark, d):
    key, name, brand, kind, size = _part()
    pay = F.when(size % 3 == 0, "Thỏa thuận").otherwise(_page(size.cast("string"), " triệu"))
    place = F.when(size % 2 == 0, "text-se-neutral-80").otherwise("tooltip-content")
    return _scan(spark, d, "vieclam24h", _page('<a data-job-id="', key, '" href="/j/', key, '"><h3>', name, "</h3><h3>", brand, "</h3><span>x<b>y</b></span><span>", pay, '</span><span class="', place, '">', kind, "</span></a>"))


@query
def scan_ybox(spark, d):
    key, _, brand, kind, size = _part()
    slug = _seventh(_page("s-", key), F.lit(""))
    title = F.concat(F.when(size % 2 == 0, "[HCM] ").otherwise(""), "p_name", F.lit(" 5-6tr"))
    return _scan(spark, d, "ybox", ads_page(title, kind, slug, brand))


@query
def href_dedup(spark, d):
    """Posting links of a page, each address once, under its first place among all links."""
    key, _, _, _, _ = _part()
    link = lambda head: _page(f'<a href="{head}', key, '.html">x</a>')
    pages = A.table(spark, d, "part").select("p_partkey", _page(link("/a-p"), link("/a-p"), '<a href="/about.html">y</a>', link("/b-p"), link("/a-p"), "<a>z</a>").alias("html"))
    return boards.links(pages, "p_partkey").select("p_partkey", "pos", "href")


@query
def existing_ids(spark, d):
    rows = A.parts(spark, d).withColumn("job_id", identity.posting_id(F.col("title_normalized"), F.col("company"), F.col("source")))
    return postings.existing_ids(rows, "promo")


@query
def command_route(spark, d):
    rows = spark.createDataFrame([(c,) for c in CHATS], "said string")
    return subscriptions.commands(rows, "said").select("said", "command", "argument")


@query
def user_put(spark, d):
    rows = A.events(spark, d).select(F.col("user_id").cast("string").alias("user_id"), F.col("source").alias("username"), F.lit(None).cast("string").alias("first_name"), "ts", "job_id")
    made = subscriptions.users(rows, F.col("ts"), "job_id")
    return subscriptions.put_users(made.where("job_id % 2 = 0"), made.where("job_id % 2 = 1"), [F.col("job_id")]).drop("job_id")


@query
def subscription_match(spark, d):
    asked = spark.createDataFrame([("SUB#ring", "ring", "", 0), ("SUB#gear", "small gear", "Brand#1", 20_000), ("SUB#x", "bolt", "nowhere", 0)], "sk string, k string, place string, floor long")
    return A.parts(spark, d).join(F.broadcast(asked), search.subscription_matches(F.col("k"), F.col("place"), F.col("floor"))).select("job_id", "sk")


@query
def search_message(spark, d):
    return search.search_message(search.search(A.parts(spark, d), "ring", 50, "brand#1"), "ring", "brand#1")


@query
def single_match(spark, d):
    rows = A.parts(spark, d).withColumn("location", F.when(F.col("job_id") % 2 == 0, "").otherwise(F.col("location")))
    return rows.select("job_id", search.single_match(rows).alias("message"))


@query
def log_records(spark, d):
    """Log records as JSON lines, read again and counted by level and source."""
    rows = A.table(spark, d, "documents").select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("timestamp"), F.when(F.col("doc_id") % 2 == 0, "INFO").otherwise("ERROR").alias("level"), F.lit("etl").alias("logger"),
        F.concat(F.lit("read \""), "source", F.lit("\"\n")).alias("message"), F.col("lang").alias("source"), F.col("n_chars").alias("job_count"),
    )
    found = logs.scan(logs.records(rows))
    return found.groupBy("level", "source").agg(F.count("*").alias("n"), F.sum("job_count").alias("characters"))


def ads_page(title: Column, summary: Column, slug: Column, full: Column) -> Column:
    """Pages with embedded JSON of one post."""
    publisher = F.struct(full.alias("fullName"), F.lit("user").alias("username"))
    post = F.struct(F.struct(title.alias("title"), summary.alias("summary"), slug.alias("slug"), publisher.alias("publisher"), F.lit("").alias("publishedAt"), F.lit("2024-01-05").alias("acceptedAt")).alias("post"))
    return _page("<html><script>var a={};</script><script>window.INITIAL_ADS = ", F.to_json(F.struct(F.struct(F.array(post).alias("edges")).alias("Ads"))), ";</script></html>")


@query
def embedded_json(spark, d):
    key, _, brand, kind, size = _part()
    part = A.table(spark, d, "part")
    title = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("[HCM] "), "p_name")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("Sài Gòn "), "p_name", F.lit(" 10-20tr"))).otherwise(F.concat("p_name", F.lit(" lương: 8 - 10 triệu")))
    pages = part.select(ads_page(title, kind, _page("s-", key), F.when(size % 2 == 0, brand).otherwise("")).alias("html"))
    return feeds.ads(pages, keyword=" Ring ").select("title", "company", "location", "salary_raw", "source_url", "posted_at_raw")


@query
def matcher_summary(spark, d):
    """Digests of more than 20 matches stand for messages that were not taken."""
    found = _matched(spark, d)
    sent = found.groupBy("user_id", "keyword_raw").agg((F.count("*") <= 20).alias("ok"))
    return search.matcher_summary(found, subscriptions.active(A.subscriptions(spark)), sent)


@query
def etl_summary(spark, d):
    return postings.etl_summary(A.docs(spark, d))


@query
def raw_to_search(spark, d):
    """Raw rows to a shown list: transform, search, recency with fallback, interleave."""
    jobs = postings.transform(A.docs(spark, d))
    found = search.search(jobs.withColumn("posted_at", shown("posted_at")).withColumn("at", F.col("scraped_at")).withColumn("scraped_at", shown("scraped_at")), "the", 200)
    return search.interleave(search.recent(found.drop("rank"), F.lit("2024-01-01 12:00:00").cast("timestamp"), ts="at"), ts=F.col("at")).select("rank", "job_id", "source", "scraped_at")


@query
def stream_tumbling(spark, d):
    rows = ingest.tumbling(A.table(spark, d, "events"))
    return rows.select(shown("window_start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def stream_sessions(spark, d):
    rows = ingest.sessions(A.table(spark, d, "events"), "6 hours")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
