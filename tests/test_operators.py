"""Ordering, dedup, quality, matching, sources and streaming on small tables."""

import http.server
import json
import re
import threading
import time
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill import schema
from tidemill.operators import postings, search, subscriptions
from tidemill.sources import boards, feeds
from tidemill.streaming import ingest, logs

NOW = datetime(2026, 6, 15)


def raw_rows(spark, rows):
    names = [*schema.TEXTS, "scraped_at"]
    return spark.createDataFrame([tuple(r.get(n, NOW if n == "scraped_at" else "") for n in names) for r in rows], schema.RAW)


def test_interleave_is_fair(spark):
    rows = [("a", k, NOW - timedelta(hours=k)) for k in (1, 2, 3)] + [("b", 4, NOW)] + [("c", k, NOW - timedelta(hours=k)) for k in (5, 6)]
    out = search.interleave(spark.createDataFrame(rows, "source string, job_id int, ts timestamp"), 5)
    assert [r.job_id for r in out.orderBy("rank").collect()] == [1, 4, 5, 2, 6]


def test_recency_falls_back(spark):
    rows = spark.createDataFrame([(1, NOW - timedelta(days=9)), (2, NOW - timedelta(days=8)), (3, None)], "job_id int, ts timestamp")
    kept = lambda df: sorted(r.job_id for r in search.recent(df, F.lit(NOW)).collect())
    assert kept(rows.where("ts is not null")) == [1, 2]
    assert kept(rows) == [3]
    assert kept(rows.where("job_id < 0")) == []


def test_recency_keeps_null_groups(spark):
    rows = spark.createDataFrame([(1, None, NOW - timedelta(days=9)), (2, "a", NOW), (3, "a", NOW - timedelta(days=9)), (4, None, NOW - timedelta(days=8))], "job_id int, source string, ts timestamp")
    assert sorted(r.job_id for r in search.recent(rows, F.lit(NOW), by=["source"]).collect()) == [1, 2, 4]


def test_decomposed_texts_are_composed_at_ingest(spark):
    whole = "Kế Toán Trưởng"
    parts = unicodedata.normalize("NFD", whole)
    assert parts != whole
    jobs = postings.transform(raw_rows(spark, [{"title": t, "company": "X", "source": "ybox", "source_url": t} for t in (whole, parts, "\u1112\u1161\u11ab Dev", "plain")]))
    found = {r.title: r for r in jobs.collect()}
    assert found[whole].job_id == found[parts].job_id and found[parts].title_normalized == "kế toán trưởng"
    assert found["\u1112\u1161\u11ab Dev"].title_normalized == "\ud55c dev" and found["plain"].title_normalized == "plain"
    assert postings.dedup(jobs, [F.col("source_url")]).count() == 3
    assert search.search(jobs, unicodedata.normalize("NFD", "kế toán")).count() == 2
    subs = spark.createDataFrame([("u", "SUB#k", unicodedata.normalize("NFD", "kế toán"), "")], "user_id string, sk string, keyword_normalized string, location_filter string")
    assert search.match_subscriptions(jobs, subs).count() == 2


def test_dedup_modes(spark):
    rows = raw_rows(spark, [{"title": "Dev", "company": "X", "source": s, "scraped_at": NOW + timedelta(hours=k)} for k, s in enumerate(["ybox", "itviec"])])
    jobs = postings.transform(rows)
    assert [r.source for r in postings.dedup(jobs, [F.col("scraped_at")]).collect()] == ["ybox"]
    assert postings.dedup(jobs, [F.col("scraped_at")], cross_source=False).count() == 2


def test_quality_counts(spark):
    report = postings.quality(raw_rows(spark, [{"title": t} for t in ("", "A", "a", "Dev")])).first()
    expected = dict(total=4, passed=3, failed=1, missing_title=1, title_too_short=2, missing_company=3, missing_url=3, missing_location=4, missing_salary=4, duplicate_titles=1, warnings=0, pass_rate=75.0, completeness=25.0)
    assert {k: report[k] for k in expected} == expected
    odd = postings.quality(raw_rows(spark, [{"title": None, "company": None, "location": None}, {"title": "Dev", "company": " ", "source_url": " ", "location": " ", "salary_raw": None}])).first()
    assert (odd.missing_title, odd.missing_company, odd.missing_url, odd.missing_location, odd.missing_salary) == (1, 1, 0, 1, 2)
    assert postings.quality(raw_rows(spark, [])).first().pass_rate == 0.0


def test_transform_drops_unreadable_salaries(spark):
    jobs = postings.transform(raw_rows(spark, [{"title": " Dev  ", "salary_raw": "10 - 20 tr, x"}, {"title": " Data  Dev ", "salary_raw": "5 tr"}]))
    assert [(r.title, r.title_normalized, r.salary_min) for r in jobs.collect()] == [("Data  Dev", "data dev", 5_000_000)]


def test_upsert_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    make = lambda rows: spark.createDataFrame(rows, "job_id string, v int")
    assert postings.save_upsert(path, make([("a", 1), ("b", 1), ("a", 2)]), order=[F.col("v")]) == 3
    postings.save_upsert(path, make([("b", 5), ("c", 1)]), order=[F.col("v")])
    assert sorted(map(tuple, postings.load_store(path, spark).collect())) == [("a", 2), ("b", 5), ("c", 1)]


def stored_rows(path, spark):
    return sorted(map(tuple, postings.load_store(path, spark).select("job_id", "v").collect()))


def test_store_survives_crashes(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    make = lambda rows: spark.createDataFrame(rows, "job_id string, v int")
    assert postings.load_store(path, spark) is None
    postings.save_upsert(path, make([("a", 1), ("b", 1)]))

    def crash(*_):
        raise RuntimeError("lost between data and manifest")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(postings, "_publish", crash)
        postings.save_upsert(path, make([("a", 2)]))
    assert stored_rows(path, spark) == [("a", 1), ("b", 1)]
    postings.save_upsert(path, make([("a", 3), ("c", 1)]))
    assert stored_rows(path, spark) == [("a", 3), ("b", 1), ("c", 1)]
    with pytest.raises(FileExistsError):
        postings._publish(spark, f"{path}/_versions", 1, {})
    before = postings.load_store(path, spark)
    for v in range(6):
        postings.save_upsert(path, make([("a", v)]))
        if v == 0:
            assert before.count() == 3  # a reader of an older version goes on
    assert stored_rows(path, spark) == [("a", 5), ("b", 1), ("c", 1)]
    assert len(list((tmp_path / "store" / "_versions").glob("*.json"))) == 1 + postings.KEPT_VERSIONS
    folders = [p for p in (tmp_path / "store" / "data").iterdir() if any(p.rglob("*.parquet"))]
    assert len(folders) <= 3 + postings.KEPT_VERSIONS
    assert postings.save_upsert(path, make([])) == 0 and postings.load_store(path, spark).count() == 3


def test_store_knows_its_batches(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    make = lambda v: spark.createDataFrame([("a", v)], "job_id string, v int")
    assert [postings.save_upsert(path, make(v), batch=b) for v, b in ((1, 0), (2, 1), (3, 1), (4, 0))] == [1, 1, 0, 0]
    assert stored_rows(path, spark) == [("a", 2)]


def jobs_of(spark, titles):
    rows = [(k, t, t.lower(), "Hà Nội" if k % 2 else "HCM", ["python"] if k == 0 else [], f"2026-06-{k + 1:02d}", "") for k, t in enumerate(titles)]
    return spark.createDataFrame(rows, "job_id int, title string, title_normalized string, location string, tags array<string>, posted_at string, scraped_at string").withColumn("location_normalized", F.col("location"))


def test_location_filter_comes_after_the_limit(spark):
    jobs = jobs_of(spark, ["dev"] * 10)
    assert search.search(jobs, "dev", 4).count() == 4
    assert [r.rank for r in search.search(jobs, "dev", 4, "hà nội").orderBy("rank").collect()] == [1, 3]


def test_blank_search_matches_all_and_tags_count(spark):
    jobs = jobs_of(spark, ["Kỹ sư", "Thực tập sinh", "Fresher"])
    found = lambda w: sorted(r.job_id for r in search.search(jobs, w).collect())
    assert found("") == [0, 1, 2] and found("python") == [0] and found("ki su") == [0] and found("intern") == [1] and found("tts") == [1] and found("fresher") == [2]


def test_trigram_matching_finds_the_same(spark, monkeypatch):
    jobs = jobs_of(spark, ["Data engineer", "Kế toán trưởng", "Thực tập data", "C dev", "python dev"])
    subs = spark.createDataFrame([("u", f"SUB#{k}", k, "") for k in ("data", "ke toan", "intern", "r", "python", "dev c", "", "c dev", "tts", "fresher data", "intern data", "nothing here", "to")], "user_id string, sk string, keyword_normalized string, location_filter string")
    pairs = lambda: sorted((r.sk, r.job_id, r["rank"]) for r in search.match_subscriptions(jobs, subs).collect())
    small = pairs()
    monkeypatch.setattr(search, "SMALL_SUBSCRIPTIONS", 1)
    assert pairs() == small and len(small) > 12
    jobs = jobs.withColumn("posted_at", F.lit("2026-06-01"))  # ties
    many = spark.createDataFrame([(f"u{k}", "SUB#dev", "dev", "hcm") for k in range(5)], subs.schema)
    few = sorted((r.user_id, r.job_id, r["rank"]) for r in search.match_subscriptions(jobs, many, 1).collect())
    monkeypatch.undo()
    assert sorted((r.user_id, r.job_id, r["rank"]) for r in search.match_subscriptions(jobs, many, 1).collect()) == few and len(few) == 0 or len(few) == 5


def test_variant_and_salary(spark):
    row = spark.createDataFrame([("senior dev", ["java"], "cần Thực tập", "sql")], "t string, g array<string>, d string, r string")
    hit = lambda w: row.select(search.variant_matches(F.lit(w), F.col("t"), F.col("g"), F.col("d"), F.col("r"))).first()[0]
    assert hit("intern") and hit("java sql") and not hit("python") and hit("dev")
    reach = lambda a, b: row.select(search.salary_reaches(F.lit(a), F.lit(b))).first()[0]
    assert reach(10, None) and reach(10, 0) and reach(10, 10) and not reach(10, 9) and reach(0, 1)


def test_whole_subscription_rule(spark):
    rows = spark.createDataFrame([("Senior dev", ["java"], "", "", "Ha Noi", 20)], "title string, tags array<string>, description string, requirements string, location_normalized string, salary_max long")
    hit = lambda k, p, f: rows.select(search.subscription_matches(F.lit(k), F.lit(p), F.lit(f))).first()[0]
    assert hit("dev", "", 0) and hit("dev", "ha noi", 20) and hit("dev", None, None)
    assert not hit("dev", "Hue", 0) and not hit("dev", "ha noi", 21) and not hit("python", "", 0)


def test_messages_of_lists(spark):
    row = [("Dev.", "A-B", "", None, "jooble", "http://x", 1), ("QA", None, None, "5 tr", "ybox", "", 2)]
    found = spark.createDataFrame(row, "title string, company string, location string, salary_raw string, source string, source_url string, rank int")
    got = search.search_message(found, "c++", "Huế").first()
    assert got.n == 2
    assert got.message == (
        "🔍 *2 kết quả* cho *c\\+\\+* tại *Huế*:\n\n*1\\. [Jooble] Dev\\.*\n   🏢 A\\-B\n   📍 \n   💰 Thỏa thuận\n   🔗 [Xem chi tiết trên Jooble](http://x)\n"
        "\n*2\\. [Ybox] QA*\n   🏢 N/A\n   📍 \n   💰 5 tr\n"
    )
    assert search.search_message(found.limit(0), "x").count() == 0
    mine = search.my_jobs_message(found.withColumn("matched_keyword", F.lit("k"))).first().message
    assert mine.startswith("📋 *Top 2 việc làm mới nhất* từ các từ khóa đã đăng ký:\n\n*1\\. [Jooble] Dev\\.*\n   🏢 A\\-B\n   📍  \\| 💰 Thỏa thuận\n   🔑 Từ khóa: `k`\n")
    single = found.select(search.single_match(found).alias("m")).first().m
    assert single == "💼 *Dev\\.*\n🏢 A\\-B\n📍 Không rõ\n💰 Thỏa thuận\n🔗 [Jooble](http://x)\n"


def test_matcher_summary_counts_sending(spark):
    found = spark.createDataFrame([("u", 1), ("u", 2)], "user_id string, job_id int")
    subs = spark.createDataFrame([("u",), ("v",)], "user_id string")
    sent = spark.createDataFrame([("u", "k", True), ("u", "l", False), ("v", "m", None)], "user_id string, keyword_raw string, ok boolean")
    assert search.matcher_summary(found, subs, sent).first().asDict() == {"users": 2, "matches": 2, "sent": 1, "failures": 2}


def test_commands_and_users(spark):
    said = spark.createDataFrame([("/subscribe ke toan /subscribe",), (" /jobs ",), ("hello",), ("",), (None,), ("/subscriber x",)], "text string")
    assert [(r.command, r.argument) for r in subscriptions.commands(said).collect()] == [("subscribe", "ke toan"), ("myjobs", None), ("search", "hello"), ("subscribe", "r x")]
    new = subscriptions.users(spark.createDataFrame([("1", "a", None)], "user_id string, username string, first_name string"), F.lit(NOW))
    row = new.first()
    assert (row.sk, row.username, row.first_name, row.is_active, row.created_at, row.last_notified_at) == ("PROFILE", "a", "", True, "2026-06-15T00:00:00Z", "")
    again = subscriptions.users(spark.createDataFrame([("1", "b", "B"), ("2", "c", "C")], "user_id string, username string, first_name string"), F.lit(NOW))
    assert sorted((r.user_id, r.username) for r in subscriptions.put_users(new, again, [F.col("username")]).collect()) == [("1", "b"), ("2", "c")]


def test_subscription_rules(spark):
    held = spark.createDataFrame([("u", "SUB#a", False), ("u", "SUB#b", True)], "user_id string, sk string, is_active boolean")
    asked = spark.createDataFrame([("u", "SUB#b", 1), ("u", "SUB#c", 2), ("u", "SUB#d", 3)], "user_id string, sk string, n int")
    assert [r.sk for r in subscriptions.accept(held, asked, [F.col("n")]).collect()] == ["SUB#c"]


CARDS = {
    "careerlink": '<div class="job-item"><a class="job-link" href="/j/1">Dev</a><a class="job-company">ACME</a><span class="job-location">HN</span><span class="job-salary">10 triệu</span><i class="job-position">Nhân viên</i><b class="cl-datetime" data-datetime="0"></b></div><div class="job-item"></div>',
    "itviec": '<div class="job-card" data-search--job-selection-job-slug-value="dev-1"><h3>Dev</h3><span>Posted 2 hours ago</span><div>ACME</div><span class="small-text">Posted  2 hours ago</span><a href="/x?Skill+tag">Java</a><a class="itag">SQL</a> Hà Nội Remote</div>',
    "careerviet": '<div class="job-item"><a class="job_link" title="Dev" href="/j/2">x</a><a class="company-name">ACME</a><div class="salary">Lương: 5 tr</div><div class="location"><ul><li>HN</li><li>HCM</li></ul></div><time>01/02/2026</time></div>',
    "timviec365": '<div><p><a href="/dev-p12.html">Dev</a></p><a href="/acme-co3">ACME</a><i>Đà Nẵng</i><i>5 - 7 triệu</i><i>01/02/2026</i></div><a href="/dev-p12.html">Dev again</a>',
    "vieclam24h": '<a data-job-id="1" href="/j/3"><h3>Dev</h3><h3>ACME</h3><span>7 - 9 triệu</span><span class="text-se-neutral-80">TP.HCM</span></a>',
    "ybox": '<script>window.INITIAL_ADS = {"Ads":{"edges":[{"post":{"title":"[HCM] Dev 5-6tr","slug":"s","publisher":{"username":"u"},"acceptedAt":"2026-01-01"}},{"post":{"title":"No slug"}}]}};</script>',
}


def test_boards(spark):
    got = {b: list(boards.postings(b, html)) for b, html in CARDS.items()}
    assert all(len(x) == 1 for x in got.values())
    first = {b: x[0] for b, x in got.items()}
    assert first["careerlink"]["posted_at_raw"] == "1970-01-01T00:00:00+00:00" and first["careerlink"]["source_url"] == "https://www.careerlink.vn/j/1"
    assert first["itviec"] | {"x": 0} == first["itviec"] | {"x": 0, "company": "ACME", "description": "Java, SQL", "location": "Hà Nội", "job_type_raw": "Remote", "posted_at_raw": "Posted 2 hours ago"}
    assert first["careerviet"]["location"] == "HN, HCM" and first["careerviet"]["salary_raw"] == "5 tr"
    assert (first["timviec365"]["company"], first["timviec365"]["salary_raw"], first["timviec365"]["location"]) == ("ACME", "5 - 7 triệu", "Đà Nẵng")
    assert (first["vieclam24h"]["company"], first["vieclam24h"]["salary_raw"], first["vieclam24h"]["location"]) == ("ACME", "7 - 9 triệu", "TP.HCM")
    assert (first["ybox"]["location"], first["ybox"]["salary_raw"], first["ybox"]["company"]) == ("HCM", "5-6tr", "u")
    assert list(boards.postings("mywork", "<a>")) == [] and list(boards.postings("itviec", "")) == []
    pages = spark.createDataFrame([(CARDS["careerlink"], NOW), (None, NOW)], "html string, scraped_at timestamp")
    assert [r.title for r in boards.scan(pages, "careerlink").collect()] == ["Dev"]


def test_data_source_reads_saved_pages(spark, tmp_path):
    from tidemill.sources.web import PostingSource

    folder = tmp_path / "careerlink" / "dev"
    folder.mkdir(parents=True)
    (folder / "1.html").write_text(CARDS["careerlink"])
    spark.dataSource.register(PostingSource)
    rows = spark.read.format("postings").option("boards", "careerlink,mywork").option("keywords", "dev").option("base", f"file://{tmp_path}").option("delay", "0").option("tries", "1").load()
    assert [(r.title, r.source) for r in rows.collect()] == [("Dev", "careerlink")]


class Api(http.server.BaseHTTPRequestHandler):
    """Fails once, then answers one page of postings, then empty ones."""

    seen: list = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Api.seen.append((self.path, body, time.monotonic()))
        if len(Api.seen) == 1:
            self.send_error(503)
            return
        jobs = [{"title": " Dev ", "company": "A", "snippet": body["keywords"], "id": 1}, {"title": " "}] if body["page"] == "1" else []
        answer = json.dumps({"jobs": jobs, "totalCount": 1}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *_):
        pass


def test_api_scan_posts_retries_and_waits():
    from tidemill.sources.web import PostingReader

    server = http.server.HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    options = {"boards": "jooble", "keywords": "x,y", "api": f"http://127.0.0.1:{server.server_port}/api", "api_key": "k", "delay": "0.2", "pages": "3"}
    reader = PostingReader(options)
    assert len(reader.partitions()) == 1  # one source is asked by one task
    rows = list(reader.read(reader.partitions()[0]))
    server.shutdown()
    assert [(r[0], r[4], r[7]) for r in rows] == [("Dev", "x", "jooble"), ("Dev", "y", "jooble")]
    assert [(p, b["keywords"], b["location"], b["page"]) for p, b, _ in Api.seen] == [("/api/k", "x", "Vietnam", "1")] * 2 + [("/api/k", "x", "Vietnam", "2"), ("/api/k", "y", "Vietnam", "1"), ("/api/k", "y", "Vietnam", "2")]
    times = [t for *_, t in Api.seen[1:]]
    assert all(b - a > 0.19 for a, b in zip(times, times[1:]))
    assert "jooble" not in PostingReader({"keywords": "x"}).boards and "jooble" in PostingReader({"keywords": "x", "api_key": "k"}).boards
    with pytest.raises(ValueError):
        PostingReader({"boards": "nowhere"})


class Chat(http.server.BaseHTTPRequestHandler):
    """Three updates; refuses messages with markup that hold "bad", and all that hold "never"."""

    sent: list = []

    def answer(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):  # noqa: N802
        start = int(re.search(r"offset=(\d+)", self.path)[1])
        updates = [{"update_id": 7, "message": {"chat": {"id": 5}, "text": "/start", "from": {"username": "u"}}}, {"update_id": 8}, {"update_id": 9, "message": {"chat": {"id": 6}, "text": "dev"}}]
        self.answer(200, {"result": [u for u in updates if u["update_id"] >= start]})

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Chat.sent.append((self.path, body["chat_id"], body["text"], body.get("parse_mode"), body.get("message_id")))
        self.answer(400 if "never" in body["text"] or "bad" in body["text"] and "parse_mode" in body else 200, {})

    def log_message(self, *_):
        pass


def test_chat_updates_and_messages(spark, tmp_path):
    from tidemill.sources import chat

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    api = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(chat.ChatSource)
    rows = spark.readStream.format("chat").option("token", "t").option("api", api).option("wait", "1").load()
    out = rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/updates").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    out.processAllAvailable()
    out.stop()
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/updates").orderBy("update_id").collect()] == [(7, "5", "/start", "u", ""), (8, None, "", "", ""), (9, "6", "dev", "", "")]
    reader = chat.UpdateReader({"api": api, "token": "t", "wait": "1"})
    assert reader.read({"offset": 8})[1] == {"offset": 10} and [r[0] for r in reader.readBetweenOffsets({"offset": 7}, {"offset": 9})] == [7, 8]
    assert chat.UpdateReader({"api": "http://127.0.0.1:9", "tries": "1"}).read({"offset": 3})[1] == {"offset": 3}
    messages = spark.createDataFrame([("1", r"a\.b", None), ("2", r"bad\!", None), ("3", "never", None), ("4", r"bad\-", 11), (None, "x", None), ("5", None, None)], "user_id string, message string, message_id long")
    got = {r.user_id: r.ok for r in chat.send(messages, "t", api).collect()}
    server.shutdown()
    assert got == {"1": True, "2": True, "3": False, "4": True, None: False, "5": False}
    send, edit = "/bott/sendMessage", "/bott/editMessageText"
    assert {s for s in Chat.sent if s[1] != "3"} == {(send, "1", r"a\.b", "MarkdownV2", None), (send, "2", r"bad\!", "MarkdownV2", None), (send, "2", "bad!", None, None), (edit, "4", r"bad\-", "MarkdownV2", 11), (edit, "4", r"bad\-", None, 11)}


def test_sources_are_published_one_by_one(spark, tmp_path):
    good = raw_rows(spark, [{"title": f"Dev {k}", "source": "ybox"} for k in range(25)] + [{"title": ""}])
    bad = good.select(F.raise_error(F.lit("down")).cast("string").alias("title"), *[c for c in good.columns if c != "title"])
    for _ in range(2):  # a run that comes again changes nothing
        report = ingest.publish({"itviec": bad, "ybox": good}, f"file://{tmp_path}/queue", f"file://{tmp_path}/lake", run=1)
    assert report["ybox"] == {"scraped": 26, "valid": 25, "pass_rate": 96.2} and "error" in report["itviec"]
    files = list((tmp_path / "queue").rglob("part-*"))
    assert sum(len(f.read_text().splitlines()) for f in files) == 25 and all(len(f.read_text().splitlines()) <= 10 for f in files)
    assert spark.read.json(f"file://{tmp_path}/lake/source=ybox/batch=1").count() == 25


def test_lakes(spark, tmp_path):
    rows = raw_rows(spark, [{"title": "Dev", "source": "ybox"}, {"title": "QA", "source": "itviec"}])
    postings.write_raw_lake(rows, f"file://{tmp_path}/raw")
    assert sorted(p.name for p in (tmp_path / "raw").iterdir() if p.is_dir()) == ["source=itviec", "source=ybox"]
    items = postings.stored(postings.transform(rows), F.lit(NOW))
    for form in ("parquet", "json"):
        postings.write_processed_lake(items, f"file://{tmp_path}/{form}", F.lit(NOW), form)
        assert spark.read.format(form).load(f"file://{tmp_path}/{form}").where("dt = '2026-06-15'").count() == 2


def test_existing_ids_of_a_source(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b"), ("3", None)], "job_id string, source string")
    assert sorted(r.job_id for r in postings.existing_ids(rows).collect()) == ["1", "2", "3"]
    assert [r.job_id for r in postings.existing_ids(rows, "a").collect()] == ["1"]


def test_log_records(spark):
    rows = spark.createDataFrame([(NOW, "ERROR", "etl", 'a "b"\n', 3, None), (NOW - timedelta(days=2), None, None, None, None, ("X", "y"))], "timestamp timestamp, level string, logger string, message string, job_count long, exception struct<type: string, message: string>")
    lines = logs.records(rows)
    first, second = (json.loads(r.value) for r in lines.collect())
    assert first == {"timestamp": "2026-06-15T00:00:00.000000Z", "level": "ERROR", "logger": "etl", "message": 'a "b"\n', "job_count": 3}
    assert second["level"] == "INFO" and second["exception"] == {"type": "X", "message": "y"} and "job_count" not in second
    mixed = lines.union(spark.createDataFrame([("{broken",), ("",)], "value string"))
    assert logs.scan(mixed).count() == 2 and logs.scan(mixed, level="ERROR").first().job_count == 3
    assert logs.scan(mixed, since=F.lit(NOW)).count() == 1 and [r.level for r in logs.scan(mixed, limit=1).collect()] == ["INFO"]


def test_messages_and_quarantine(spark):
    good = raw_rows(spark, [{"title": "Dev", "source": "ybox"}, {"title": "Dev", "source": "nowhere"}])
    raw, bad = feeds.consume(postings.messages(good).unionByName(spark.createDataFrame([("{oops",)], "value string")))
    assert raw.count() == 1 and bad.count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"title": f"Dev {k % 7}", "company": "X", "source": "ybox", "scraped_at": (NOW + timedelta(minutes=k)).isoformat()} for k in range(20)]
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")
    store = f"file://{tmp_path}/store"
    ingest.ingest(spark, f"file://{inbox}", store, f"file://{tmp_path}/ck", quarantine=f"file://{tmp_path}/bad").awaitTermination()
    found = {r.title for r in postings.load_store(store, spark).collect()}
    assert found == {f"Dev {k}" for k in range(7)}
    assert spark.read.text(f"file://{tmp_path}/bad").count() == 1


def test_replayed_batches_change_nothing(spark, tmp_path):
    rows = [json.dumps({"title": f"Dev {k}", "company": "X", "source": "ybox", "scraped_at": NOW.isoformat()}) for k in range(4)] + ["{broken"]
    batch = spark.createDataFrame([(r,) for r in rows], "value string")
    run = ingest.etl_batch(f"file://{tmp_path}/store", f"file://{tmp_path}/bad", f"file://{tmp_path}/lake")
    for number in (0, 1, 1):
        run(batch, number)
    assert postings.load_store(f"file://{tmp_path}/store", spark).count() == 4
    assert len(list((tmp_path / "store" / "_versions").glob("*.json"))) == 2
    assert spark.read.json(f"file://{tmp_path}/bad").count() == 2 and spark.read.parquet(f"file://{tmp_path}/lake").count() == 8


def test_ingest_at_an_interval(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps({"title": "Dev", "company": "X", "source": "ybox"}))
    running = ingest.ingest(spark, f"file://{inbox}", f"file://{tmp_path}/store", f"file://{tmp_path}/ck", every="1 second")
    running.processAllAvailable()
    running.stop()
    assert postings.load_store(f"file://{tmp_path}/store", spark).count() == 1


def test_streaming_window_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = sorted(map(tuple, ingest.tumbling(events).select("window_start", "event_type", "n").collect()))
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    ingest.tumbling(stream, late="100 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("w").select("window_start", "event_type", "n").collect())) == batch
