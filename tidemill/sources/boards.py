"""Posting pages of the boards: which elements are cards, and where a card holds its fields.

A board is data: a card selector and a field reader. ``scan`` applies one to a table of pages; bad cards
and bad pages give no rows and stop nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .dom import Element, parse

# Site addresses, names and patterns that the boards use.
CITIES_ITVIEC = ["Ha Noi", "Ho Chi Minh", "Da Nang", "Hà Nội", "Hồ Chí Minh", "Đà Nẵng"]
CITIES_TIMVIEC = ["Hà Nội", "Hồ Chí Minh", "Đà Nẵng", "Hải Phòng", "Cần Thơ", "Bình Dương", "Đồng Nai", "Bắc Ninh", "Hưng Yên", "Khánh Hòa", "Lâm Đồng", "Nghệ An", "Thanh Hóa", "Quảng Ninh", "Thái Nguyên", "Ninh Bình", "Vĩnh Long", "Tuyên Quang", "Tây Ninh", "Phú Thọ"]
NOISE_ITVIEC = ["hot", "posted", "ago", "ngày", "giờ", "trước"]
SALARY_TIMVIEC = re.compile(r"(\d+\s*-\s*\d+\s*triệu|Từ\s*\d+\s*triệu|Đến\s*\d+\s*triệu|Thỏa\s*Thuận|\d+\s*-\s*\d+\s*VNĐ)", re.I)
SALARY_VIECLAM = re.compile(r"triệu|VNĐ|USD|thỏa thuận", re.I)
SALARY_LABELLED = re.compile(r"(?:lương|thu nhập)[:\s]*([0-9\s\-\.\,trTriệu]+(?:\+/)?(?:\s*tháng)?)", re.I)
SALARY_MILLIONS = re.compile(r"([0-9\s\-\.\,tr]+tr(?:iệu)?(?:/tháng)?)", re.I)

Fields = dict[str, str]


def text_of(e: Element | None) -> str:
    return e.text() if e is not None else ""


def first_in(places: list[str], where: str, fold: bool = False) -> str:
    where = where.lower() if fold else where
    return next((p for p in places if (p.lower() if fold else p) in where), "")


def linked(base: str, e: Element) -> str:
    return urljoin(base, e.get("href")) if e.get("href") else ""


def careerlink(card: Element, base: str) -> Fields | None:
    link = card.first("a", "job-link")
    if link is None:
        return None
    when, posted = card.first(name="cl-datetime"), ""
    if when is not None and re.fullmatch(r"\s*[+-]?\d+\s*", when.get("data-datetime")):
        posted = datetime.fromtimestamp(int(when.get("data-datetime")), timezone.utc).isoformat()
    return {
        "title": link.text(), "source_url": linked(base, link), "company": text_of(card.first("a", "job-company")), "location": text_of(card.first(name="job-location")),
        "salary_raw": text_of(card.first(name="job-salary")), "description": text_of(card.first(name="job-position")), "posted_at_raw": posted,
    }


def itviec(card: Element, base: str) -> Fields | None:
    links = list(card.select("a"))
    employers = (a.text() for a in links if "/companies/" in a.get("href") or "/nha-tuyen-dung/" in a.get("href"))
    company = next((x for x in employers if x), "")
    if not company:
        bits = [x.strip() for x in card.text(" | ").split("|")]
        bits = [x for x in bits if x and not any(w in x.lower() for w in NOISE_ITVIEC)]
        company = (bits[1:2] or bits[:1] or [""])[0]
    dated = card.first("span", test=lambda e: any("text-dark-grey" in c for c in e.classes)) or card.first(test=lambda e: any("small-text" in c for c in e.classes))
    posted = " ".join("".join(dated.strings()).split()) if dated is not None and "posted" in "".join(dated.strings()).lower() else ""
    salary = next((s.strip() for s in card.strings() if re.search(r"salary|lương", s, re.I)), "")
    boxed = card.first(test=lambda e: "salary" in e.get("class").lower())
    whole = card.text(" ").lower()
    skills = [a.text() for a in links if "Skill+tag" in a.get("href") or any("itag" in c.lower() for c in a.classes)]
    slug = card.get("data-search--job-selection-job-slug-value")
    return {
        "title": text_of(card.first("h3")), "source_url": f"{base}/it-jobs/{slug}" if slug else "", "company": company, "location": first_in(CITIES_ITVIEC, whole, True),
        "salary_raw": boxed.text() if boxed is not None else salary, "description": ", ".join(skills), "posted_at_raw": posted,
        "job_type_raw": "Remote" if "remote" in whole else "At office" if "at office" in whole else "",
    }


def careerviet(card: Element, base: str) -> Fields | None:
    link = card.first("a", "job_link")
    if link is None:
        return None
    company, place = card.first("a", "company-name"), card.first("div", "location")
    items = [li.text() for li in place.select("li")] if place is not None else []
    return {
        "title": link.get("title") or link.text(), "source_url": linked(base, link), "company": (company.get("title") or company.text()) if company is not None else "",
        "salary_raw": re.sub(r"^(Lương|Luong)\s*:\s*", "", text_of(card.first("div", "salary")), flags=re.I).strip(),
        "location": ", ".join(items) if items else text_of(place), "posted_at_raw": text_of(card.first("time")),
    }


def timviec365(link: Element, base: str) -> Fields | None:
    title = link.text()
    if len(title) < 3:
        return None
    box = link.parent or link
    card = box.parent if box.parent is not None and box is not link else box
    whole = card.text(" | ")
    salary, day = SALARY_TIMVIEC.search(whole), re.search(r"\d{2}/\d{2}/\d{4}", whole)
    return {
        "title": title, "source_url": linked(base, link), "company": text_of(card.first("a", test=lambda e: re.search(r"-co\d+", e.get("href")))),
        "location": first_in(CITIES_TIMVIEC, whole), "salary_raw": salary[0].strip() if salary else "", "posted_at_raw": day[0] if day else "",
    }


def vieclam24h(card: Element, base: str) -> Fields | None:
    heads = [h.text() for h in card.select("h3")]
    lone = lambda e: [x for x in e.children if not (isinstance(x, str) and not x)]
    salary = card.first("span", test=lambda e: len(lone(e)) == 1 and SALARY_VIECLAM.search("".join(e.strings())))
    place = card.first("span", "text-se-neutral-80") or card.first("span", "tooltip-content")
    return {"title": (heads or [""])[0], "company": (heads[1:] or [""])[0], "source_url": linked(base, card), "salary_raw": text_of(salary), "location": text_of(place)}


def ybox_posts(source: str) -> Iterator[dict]:
    """Posts of the page's embedded JSON."""
    for script in parse(source).select("script"):
        body = "".join(c for c in script.children if isinstance(c, str))
        if "INITIAL_ADS" in body and "{" in body and "}" in body:
            try:
                found = json.loads(body[body.index("{") : body.rindex("}") + 1])
            except ValueError:
                continue
            yield from (e["post"] for e in (found.get("Ads") or {}).get("edges") or [] if e.get("post"))
            return


def ybox(post: dict, base: str) -> Fields | None:
    title, publisher = (post.get("title") or "").strip(), post.get("publisher") or {}
    if not post.get("slug"):
        return None
    low, bracket = title.lower(), re.match(r"\[([^\]]+)\]", title)
    if bracket:
        place = bracket[1].strip()
    elif first_in(["hcm", "hồ chí minh", "sài gòn"], low):
        place = "Hồ Chí Minh"
    else:
        place = "Hà Nội" if first_in(["hn", "hà nội"], low) else "Việt Nam"
    salary = SALARY_LABELLED.search(title) or SALARY_MILLIONS.search(title)
    return {
        "title": title, "company": publisher.get("fullName") or publisher.get("username") or "Ybox Employer", "location": place, "salary_raw": salary[1].strip() if salary else "Thỏa thuận",
        "description": (post.get("summary") or "").strip(), "source_url": f"{base}/tuyen-dung/{post['slug']}", "posted_at_raw": post.get("publishedAt") or post.get("acceptedAt") or "",
    }


def unique_links(page: Element) -> Iterator[Element]:
    """Posting links, each address once."""
    seen = set()
    for link in page.select("a", test=lambda e: re.search(r"-p\d+\.html$", e.get("href"))):
        if link.get("href") not in seen:
            seen.add(link.get("href"))
            yield link


@dataclass(frozen=True)
class Board:
    base: str
    url: Callable[[str, int], str]
    cards: Callable[[str], Iterable]
    read: Callable[[object, str], Fields | None]
    pages: int = 5


def _cards(name: str | None = None, attribute: str | None = None) -> Callable[[str], Iterable[Element]]:
    return lambda source: parse(source).select(name=name, test=(lambda e: attribute in e.attributes) if attribute else None)


def _paged(path: str) -> Callable[[str, int], str]:
    return lambda word, page: path.format(word=word) + (f"?page={page}" if page > 1 else "")


BOARDS = {
    "careerlink": Board("https://www.careerlink.vn", _paged("/tim-viec-lam/{word}"), _cards("job-item"), careerlink),
    "itviec": Board("https://itviec.com", _paged("/it-jobs/{word}"), _cards("job-card"), itviec, 3),
    "careerviet": Board("https://careerviet.vn", _paged("/viec-lam/{word}-k-vi.html"), _cards("job-item"), careerviet),
    "timviec365": Board("https://timviec365.vn", _paged("/tim-viec-lam/{word}"), lambda s: unique_links(parse(s)), timviec365),
    "vieclam24h": Board("https://vieclam24h.vn", _paged("/tim-kiem-viec-lam-nhanh/{word}"), _cards(attribute="data-job-id"), vieclam24h),
    "ybox": Board("https://ybox.vn", _paged("/tuyen-dung/{word}"), ybox_posts, ybox, 1),
}
#: Boards that share another one's platform: they are known by name and give no rows.
ALIASES = ("mywork", "timviecnhanh")


def postings(board: str, source: str) -> Iterator[Fields]:
    """Titled postings of one page; a card that can't be read is left out."""
    if board in ALIASES:
        return
    found = BOARDS[board]
    for card in found.cards(source):
        try:
            fields = found.read(card, found.base)
        except (AttributeError, KeyError, TypeError, ValueError, OverflowError, OSError):
            continue
        if fields and fields["title"]:
            yield fields


def scan(pages: DataFrame, board: str, html_col: str = "html") -> DataFrame:
    """Raw postings of a table of pages with a ``scraped_at``."""
    names = schema.TEXTS
    out = ", ".join(f"{n} string" for n in names) + ", scraped_at timestamp"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, t) for source, t in zip(batch.column(0).to_pylist(), batch.column(1)) for f in postings(board, source)]
            columns = [pa.array([board if n == "source" else f.get(n, "") for f, _ in rows], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t.as_py() for _, t in rows], pa.timestamp("us", "UTC"))], names=[*names, "scraped_at"])

    return pages.select(F.coalesce(F.col(html_col), F.lit("")), F.col("scraped_at").cast("timestamp")).mapInArrow(work, out)


def links(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id, pos, href) of the posting links of each page, each address once; pos counts all of a page's addresses from 0."""
    kind = pages.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, source in enumerate(batch.column(1).to_pylist()):
                page = parse(source)
                place = {id(a): n for n, a in enumerate(page.select("a", test=lambda e: "href" in e.attributes))}
                rows += [(k, place[id(a)], a.get("href")) for a in unique_links(page)]
            at, pos, href = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int64()), pa.array(href, pa.string())], names=[id_col, "pos", "href"])

    return pages.select(id_col, F.coalesce(F.col(html_col), F.lit(""))).mapInArrow(work, f"`{id_col}` {kind}, pos long, href string")
