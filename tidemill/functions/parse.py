"""First-match dictionaries and field parsers for postings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, strip

# Dictionaries in their order; the first key that a text contains decides.
CITIES = {
    "Ho Chi Minh": ["hồ chí minh", "ho chi minh", "hcm", "tp.hcm", "tp hcm", "tphcm", "sài gòn", "saigon", "quận 1", "quận 7", "thủ đức"],
    "Ha Noi": ["hà nội", "ha noi", "hanoi", "hn"],
    "Da Nang": ["đà nẵng", "da nang", "danang"],
    "Binh Duong": ["bình dương"],
    "Dong Nai": ["đồng nai"],
    "Hai Phong": ["hải phòng"],
    "Can Tho": ["cần thơ"],
    "Bac Ninh": ["bắc ninh"],
    "Hung Yen": ["hưng yên"],
}
JOB_TYPES = {
    "full_time": ["full-time", "full time", "toàn thời gian"],
    "part_time": ["part-time", "part time", "bán thời gian"],
    "contract": ["contract", "hợp đồng"],
    "internship": ["internship", "thực tập"],
    "remote": ["remote", "từ xa", "work from home"],
    "freelance": ["freelance"],
}
SHORT_SKILLS = ["sql", "aws", "gcp", "k8s", "dbt", "vue", "git", "ai", "nlp", "etl", "elt", "go", "c++", "c#", "api"]
LONG_SKILLS = [
    "python", "java", "javascript", "typescript", "nosql", "azure", "docker", "kubernetes", "spark", "hadoop", "kafka", "airflow", "postgresql", "mysql", "mongodb", "redis",
    "elasticsearch", "react", "angular", "node.js", "nodejs", "terraform", "ansible", "jenkins", "ci/cd", "machine learning", "deep learning", "data engineer", "data analyst",
    "data scientist", "data pipeline", "data warehouse", "tableau", "power bi", "looker", "superset", "scala", "golang", "rust", ".net", "linux", "agile", "scrum", "microservices",
    "big data", "data lake", "snowflake", "redshift", "bigquery",
]
NEGOTIABLE = ["thỏa thuận", "thương lượng", "negotiable", "cạnh tranh"]
JUST_NOW = ["vừa xong", "mới đây", "just now"]
VND_PER_USD = 25_000


def has(x: Column, *words: str) -> Column:
    """Whether a text contains one of the words."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(x, F.lit(word))
    return out


def first_match(x: Column, table: dict[str, list[str]], default: Column) -> Column:

    def chain(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for value, words in reversed(table.items()):
            out = F.when(has(t, *words), F.lit(value)).otherwise(out)
        return out

    return F.coalesce(let(x, chain), default)


def location(x: Column) -> Column:
    """Known city in dictionary order, else the trimmed text; null gives the empty text."""
    x = F.coalesce(x, F.lit(""))
    return F.when(x == "", "").otherwise(first_match(F.lower(x), CITIES, strip(x)))


def job_type(kind: Column, title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (kind, title, description)]))
    return first_match(text, JOB_TYPES, F.lit("unknown"))


def salary(x: Column, strict: bool = False) -> Column:
    """struct(low, high, bad) in VND.

    All runs of digits, points and commas count as numbers without their points and commas; the first is
    the low end, the last the high end. ``tr`` anywhere means millions, before dollars are looked for. A
    run without a digit makes the row ``bad``: transformations drop it. Amounts beyond 64 bits are null. ``strict`` corrects both: a run needs
    a digit, and ``tr`` must follow a number.
    """
    digits = F.lit(r"([0-9.,]*[0-9][0-9.,]*)" if strict else r"([0-9.,]+)")

    def of(text: Column) -> Column:
        millions = text.rlike(rf"[0-9][{SPACE}]*tr") if strict else has(text, "triệu", "tr")
        unit = F.when(millions, 1_000_000).when(has(text, "usd", "$"), VND_PER_USD).otherwise(1)
        numbers = F.transform(F.regexp_extract_all(text, digits), lambda n: F.nullif(F.regexp_replace(n, "[.,]", ""), F.lit("")).try_cast("double"))
        return let(numbers, lambda found: ends(found, unit, (text == "") | has(text, *NEGOTIABLE) | (F.size(found) == 0)))

    def ends(numbers: Column, unit: Column, none: Column) -> Column:
        end = lambda k: F.when(~none, (F.try_element_at(numbers, F.lit(k)) * unit).try_cast("long"))
        return F.struct(end(1).alias("low"), end(-1).alias("high"), (~none & F.exists(numbers, lambda n: n.isNull())).alias("bad"))

    return let(strip(F.lower(F.coalesce(x, F.lit("")))), of)


def gates(words: list[str]) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """Pieces that several of the words hold, each with those words, and the words left: texts without a piece needn't be asked for its words."""
    left, out = list(words), []
    while True:
        held: dict[str, list[str]] = {}
        for w in left:
            for piece in {w[k : k + n] for n in (3, 4, 5, 6) for k in range(len(w) - n + 1)}:
                held.setdefault(piece, []).append(w)
        best = max(held, key=lambda g: (len(held[g]), len(g), g), default="")
        if len(held.get(best, [])) < 2:
            return out, left
        out.append((best, held[best]))
        left = [w for w in left if w not in held[best]]


def tags(title: Column, description: Column, requirements: Column) -> Column:
    """Skills named, ascending. Short ones need word edges on both sides, by which c++ and c# hardly ever match."""
    word = r"\p{L}\p{N}_"
    quoted = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    right = lambda s: rf"(?![{word}])" if s[-1].isalnum() else rf"(?=[{word}])"  # noqa: E731  after a sign the edge is a letter or digit
    firsts = "".join(sorted({s[0] for s in SHORT_SKILLS}))
    short = rf"(?=[{firsts}])(?<![{word}])(?:" + "|".join(quoted(s) + right(s) for s in SHORT_SKILLS) + ")"
    gated, free = gates(LONG_SKILLS)

    def of(text: Column) -> Column:
        hits = lambda words: F.array(*[F.when(F.contains(text, F.lit(s)), F.lit(s)) for s in words])
        some = [F.when(F.contains(text, F.lit(g)), hits(words)).otherwise(F.array().cast("array<string>")) for g, words in gated]
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(short), F.lit(0)))
        return F.array_sort(F.concat(found, F.array_compact(F.concat(hits(free), *some))))

    return let(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, description, requirements)])), of)


def posted_at(x: Column, base: Column, strict: bool = False) -> Column:
    """struct(ts, naive): absolute dates first, then ages before ``base``, else null.

    ISO dates without an offset are naive: recency never drops them. In ages, English units come before
    Vietnamese ones, and a bare letter g means hours, so that ``3 ngày`` and ``5 minutes ago`` give hours;
    ``strict`` looks for whole unit words instead and knows minutes.
    """
    def of(text: Column) -> Column:
        text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[t ])", "$1-$2-$3")  # basic form
        text = F.regexp_replace(F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[t ]\d{2})(\d{2})(?=\d{2}|$|z|[+-])", "$1:$2"), r"^(\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2})(\d{2})", "$1:$2")
        iso = r"^\d{4}-\d{2}-\d{2}([t ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?(z|[+-]\d{2}(:?\d{2})?)?$"
        zoned = text.rlike(iso) & text.rlike(r"[t ].*(z|[+-]\d{2}(:?\d{2})?)$")
        stamp = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"([t ]\d{2})(z|[+-].*)?$", "$1:00$2"), r"([+-]\d{2})$", "$1:00"), r"(\d)([+-]\d{2})(\d{2})$", "$1$2:$3"))
        number = F.try_to_number(F.regexp_extract(text, r"(\d+)", 1), F.lit("9" * 9)).cast("int")
        if strict:
            units = [(r"phút|min", 60), (r"giờ|hour|hr", 3600), (r"ngày|day", 86400), (r"tuần|week", 604800), (r"tháng|month", 2592000)]
        else:
            units = [(r"hour|hr", 3600), (r"day", 86400), (r"week", 604800), (r"month", 2592000), (r"giờ|g", 3600), (r"tuần", 604800)]
        age = F.lit(None).cast("timestamp")
        for pattern, seconds in reversed(units):
            age = F.when(text.rlike(pattern), F.timestamp_seconds(F.unix_micros(base) / 1e6 - number * seconds)).otherwise(age)
        now = F.when(has(text, *JUST_NOW), base)
        day = F.coalesce(F.try_to_timestamp(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), text), F.lit("d/M/yyyy")), F.try_to_timestamp(F.when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), text), F.lit("d-M-yyyy")))
        absolute = F.when(text.rlike(iso), F.try_to_timestamp(F.when(text.rlike("[t ]"), stamp).otherwise(text)))
        ts = F.coalesce(absolute, day, F.when(number.isNotNull(), age), now)
        return F.struct(F.when(text != "", ts).alias("ts"), (absolute.isNotNull() & ~zoned).alias("naive"))

    return let(strip(F.lower(F.coalesce(x, F.lit("")))), of)
