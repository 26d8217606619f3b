"""Golden cases of the text, salary, date, place, tag and identity rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions import identity, parse, text

B = datetime(2026, 6, 15, 12, 0)


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "raw, low, high",
    [("", None, None), (None, None, None), ("Thỏa thuận", None, None), ("10 - 14 triệu", 10_000_000, 14_000_000), ("15 triệu", 15_000_000, 15_000_000), ("Lên đến 20 triệu", 20_000_000, 20_000_000),
     ("1000 - 2000 USD", 25_000_000, 50_000_000), ("$1000-2000", 25_000_000, 50_000_000), ("10.5 triệu", 105_000_000, 105_000_000), ("20 Tr - 30 Tr VND", 20_000_000, 30_000_000),
     ("trên 1000 USD", 1_000_000_000, 1_000_000_000), ("25.000.000 VNĐ", 25_000_000, 25_000_000), ("Sign in to view", None, None)],
)
def test_salary(spark, raw, low, high):
    found = one(spark, raw, parse.salary)
    assert (found.low, found.high, found.bad) == (low, high, False)


def test_salary_without_digits_is_bad(spark):
    assert one(spark, "10 - 20 tr, thưởng", parse.salary).bad
    assert tuple(one(spark, "1234567890123456789012 vnd - 5", parse.salary)) == (None, 5, False)
    strict = one(spark, "10 - 20 tr, thưởng", lambda x: parse.salary(x, True))
    assert (strict.low, strict.high, strict.bad) == (10_000_000, 20_000_000, False)


@pytest.mark.parametrize(
    "raw, ts, naive",
    [("2026-06-14T10:00:00Z", datetime(2026, 6, 14, 10), False), ("2026-06-14T10:00:00+07:00", datetime(2026, 6, 14, 3), False), ("2026-06-14T10:00:00", datetime(2026, 6, 14, 10), True), ("2026-06-14", datetime(2026, 6, 14), True),
     ("20260614", datetime(2026, 6, 14), True), ("20260614T1005", datetime(2026, 6, 14, 10, 5), True), ("20260614T100530Z", datetime(2026, 6, 14, 10, 5, 30), False),
     ("23/06/2026", datetime(2026, 6, 23), False), ("23-06-2026", datetime(2026, 6, 23), False), ("posted 2 hours ago", B - timedelta(hours=2), False), ("3 days ago", B - timedelta(days=3), False),
     ("2 weeks ago", B - timedelta(days=14), False), ("1 month ago", B - timedelta(days=30), False), ("3 ngày trước", B - timedelta(hours=3), False), ("2 tháng trước", B - timedelta(hours=2), False),
     ("1 tuần trước", B - timedelta(days=7), False), ("5 minutes ago", B - timedelta(hours=5), False), ("vừa xong", B, False), ("yesterday", None, False), ("", None, False)],
)
def test_posted_at(spark, raw, ts, naive):
    found = spark.createDataFrame([(raw, B)], "x string, b timestamp").select(parse.posted_at(F.col("x"), F.col("b")).alias("y")).first()[0]
    assert (found.ts, found.naive) == (ts, naive)


@pytest.mark.parametrize("raw, city", [("TP.HCM", "Ho Chi Minh"), ("Hà Nội, Hồ Chí Minh", "Ho Chi Minh"), ("Quận 12", "Ho Chi Minh"), ("HN", "Ha Noi"), ("  Huế ", "Huế"), ("", ""), (None, "")])
def test_location(spark, raw, city):
    assert one(spark, raw, parse.location) == city


def test_text(spark):
    assert one(spark, "  Kế   Toán\tTrưởng ", text.normalize_text) == "kế toán trưởng"
    assert one(spark, "a  b\x1f", text.normalize_text) == "a b"
    assert one(spark, "Kỹ sư Đà Nẵng", text.clean_text) == "ki su da nang"
    assert one(spark, "python", text.clean_text) == "pithon"
    assert one(spark, None, text.clean_text) == ""
    assert one(spark, "Data Engineer/Python", text.tokens) == ["data", "engineer", "pithon"]
    assert one(spark, "R", text.tokens) == ["r"]
    assert one(spark, "", text.tokens) == [""]
    assert one(spark, "é", text.nfc) == "é"
    assert one(spark, "C++ (a.b)", text.escape_markup) == r"C\+\+ \(a\.b\)"
    assert one(spark, r"C\+\+ \(a\.b\)", text.unescape_markup) == "C++ (a.b)"
    assert one(spark, "jOOBLE", text.source_name) == "Jooble" and one(spark, "myWork", text.source_name) == "Mywork"
    assert one(spark, "kế toán", text.encode_path) == "k%E1%BA%BF%20to%C3%A1n"


def test_tags_and_job_type(spark):
    assert one(spark, "C++ / C# / Go / JavaScript trust ai", lambda x: parse.tags(x, F.lit(""), F.lit(""))) == ["ai", "go", "java", "javascript", "rust"]
    assert one(spark, "c++11", lambda x: parse.tags(x, F.lit(None), F.lit(""))) == ["c++"]
    assert one(spark, "đgo", lambda x: parse.tags(x, F.lit(""), F.lit(""))) == []
    assert one(spark, "Hợp đồng full-time", lambda x: parse.job_type(x, F.lit(""), F.lit(""))) == "full_time"
    assert one(spark, "", lambda x: parse.job_type(x, F.lit(""), F.lit(None))) == "unknown"


def test_identity(spark):
    assert one(spark, "data engineer", lambda x: identity.posting_id(x, F.lit(" ABC Corp "), F.lit("jooble"))) == "d81ac29d9b9db1ef"
    assert one(spark, "data engineer", lambda x: identity.cross_source_id(x, F.lit("ABC Corp"))) == "5a603933bf93e5d5"
    assert one(spark, "kế toán trưởng", lambda x: identity.posting_id(x, F.lit(None).cast("string"), F.lit("careerlink"))) == "de3dc8cf361b4535"
