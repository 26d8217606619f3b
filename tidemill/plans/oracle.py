"""The registered queries as DuckDB SQL, written from their meaning and not from their plans."""

from __future__ import annotations

from . import adapters as A
from . import facts
from .catalog import CHATS, PLACES, QUERY_TEXTS, TITLES

SPACE = "".join(f"\\x{{{c:x}}}" for c in facts.SPACES)
FROM = "".join(letters.replace(" ", "") for letters in facts.FOLDS.values())
TO = "".join(base * len(letters.split()) for base, letters in facts.FOLDS.items())


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def norm(x: str) -> str:
    return f"regexp_replace({strip(f'lower({x})')}, '[{SPACE}]+', ' ', 'g')"


def clean(x: str) -> str:
    return f"coalesce(translate(lower({x}), '{FROM}', '{TO}'), '')"


def ident(*parts: str) -> str:
    return f"substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 16)"


def chain(x: str, table: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(word)}) THEN {q(value)}" for word, value in table) + f" ELSE {default} END"


def place(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE {chain(f'lower({x})', facts.CITIES, strip(x))} END"


def tokens(x: str) -> str:
    some = f"list_filter(regexp_split_to_array({clean(x)}, '[,{SPACE}\\-/|]+'), lambda t: length(t) > 1)"
    return f"CASE WHEN len({some}) > 0 THEN {some} ELSE [{clean(x)}] END"


def tags(x: str) -> str:
    w = r"[^\p{L}\p{N}_]"
    out = []
    for s in facts.EDGED_SKILLS:
        quoted = "".join("\\" + c if not c.isalnum() else c for c in s)
        out.append((s, f"regexp_matches({x}, '(^|{w}){quoted}({w}|$)')" if s[-1].isalnum() else f"regexp_matches({x}, '(^|{w}){quoted}[\\p{{L}}\\p{{N}}_]')"))
    out += [(s, f"contains({x}, {q(s)})") for s in facts.PLAIN_SKILLS]
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(s)} END" for s, c in out) + "], lambda g: g IS NOT NULL)), ',')"


DOCS = """SELECT doc_id, split_part(text, chr(10), 1) AS title, source AS company, lang AS location, text AS description, source,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'https://example.org/' || doc_id END AS source_url, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS scraped_at FROM documents"""
PARTS = """SELECT p_partkey AS job_id, p_name AS title, p_brand AS company, p_brand AS location, '$' || p_size AS salary_raw, lower(p_type) AS source, lower(p_type) AS tag,
  'https://example.org/' || p_partkey AS source_url, strftime(DATE '2024-01-01' + CAST(p_partkey % 28 AS INTEGER), '%Y-%m-%d') AS posted_at, p_size * 1000 AS salary_max FROM part"""
SALARIES = """SELECT *, CASE l_linenumber WHEN 1 THEN q || ' - ' || (q + 5) || ' triệu' WHEN 2 THEN '$' || e WHEN 3 THEN 'Thỏa thuận' WHEN 4 THEN 'Trên ' || q || ',500 USD'
  WHEN 5 THEN q || '.000.000 VNĐ' WHEN 6 THEN q || ' - 90 tr, thưởng' ELSE '' END AS raw
  FROM (SELECT *, CAST(trunc(l_quantity) AS INTEGER) AS q, CAST(trunc(l_extendedprice) AS INTEGER) AS e FROM lineitem)"""
NUMBERS = f"""SELECT *, lower(raw) AS low_, list_transform(regexp_extract_all(lower(raw), '[0-9.,]+'), lambda n: TRY_CAST(regexp_replace(n, '[.,]', '', 'g') AS DOUBLE)) AS nums,
  raw = '' OR {' OR '.join(f'contains(lower(raw), {q(w)})' for w in facts.NEGOTIABLE)} AS none_,
  CASE WHEN contains(lower(raw), 'tr') THEN 1000000 WHEN contains(lower(raw), 'usd') OR contains(lower(raw), '$') THEN 25000 ELSE 1 END AS unit FROM ({SALARIES})"""
BAD = "NOT none_ AND len(list_filter(nums, lambda n: n IS NULL)) > 0"
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
EVENTS = "SELECT event_id AS job_id, event_type AS source, ts, user_id, value, props FROM events"
ASOF = f"TIMESTAMP '{A.AS_OF}'"


def _value(x) -> str:
    return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else q(x)


SUBS = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in A.SUBSCRIPTIONS) + ") t(user_id, sk, keyword_raw, keyword_normalized, location_filter, is_active, sub_ord)"
ACTIVE = f"SELECT * FROM ({SUBS}) WHERE is_active AND starts_with(sk, 'SUB#')"
BLANK = lambda x: f"{strip(f'coalesce({x}, {q(chr(39) * 0)})')} = ''"


def inline(values: list[str], name: str) -> str:
    return f"(SELECT unnest([{', '.join(map(q, values))}]) AS {name})"


def matched(subs: str, keyword: str, limit: int, partition: str) -> str:
    """Ranked matches of subscriptions on parts, before and after the location filter."""
    hit = "len(list_filter(toks, lambda t: NOT (contains(ct, t) OR contains(cg, t)))) = 0"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY posted_at DESC, job_id) AS rank
      FROM (SELECT *, {clean('title')} AS ct, {clean('tag')} AS cg FROM ({PARTS})) JOIN (SELECT *, {tokens(keyword)} AS toks FROM ({subs})) ON {hit})
      WHERE rank <= {limit} AND (location_filter = '' OR contains(lower(location), lower(location_filter)))"""


MATCHED = matched(ACTIVE, "keyword_normalized", 50, "user_id, sk")
MINE = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sub_ord, rank) AS k FROM ({matched(f"SELECT * FROM ({SUBS}) WHERE user_id = 'u1'", 'keyword_raw', 30, 'user_id, sk')})) WHERE k = 1"""
MESSY = f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'Ab' ELSE title END AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE company END AS company, location, '' AS salary_raw, source_url, source FROM ({DOCS})"""


def quality(by: str = "") -> str:
    """Rows without a title are not looked at for company and address; location, salary and address are not trimmed."""
    group, first = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    rate = lambda a, b: f"round_even(coalesce({a} * 100.0 / nullif({b}, 0), 0), 1)"
    ok, short = f"NOT ({BLANK('title')})", f"length({strip('title')}) < 3"
    none = lambda x: f"coalesce({x}, '') = ''"
    return f"""SELECT *, CAST({rate('passed', 'total')} AS DOUBLE) AS pass_rate,
      CAST({rate('(5 * total - missing_title - missing_company - missing_location - missing_salary - missing_url)', '(5 * total)')} AS DOUBLE) AS completeness FROM (
      SELECT {first}count(*) AS total, count_if({ok}) AS passed, count_if(NOT ({ok})) AS failed, 0 AS warnings, count_if({BLANK('title')}) AS missing_title,
      count_if({ok} AND {BLANK('company')}) AS missing_company, count_if({none('location')}) AS missing_location, count_if({none('salary_raw')}) AS missing_salary,
      count_if({ok} AND {none('source_url')}) AS missing_url, count_if({ok} AND {short}) AS title_too_short, count(*) - count(DISTINCT lower({strip('title')})) AS duplicate_titles,
      count_if({ok} AND ({short} OR {BLANK('company')} OR {none('source_url')})) AS warning_count FROM ({MESSY}) {group})"""


def esc(x: str) -> str:
    return f"regexp_replace({x}, '([_*\\[\\]()~`>#+\\-=|{{}}.!])', '\\\\\\1', 'g')"


JOB = f"""SELECT doc_id, {ident(norm('title'), strip("lower(company)"), 'source')} AS job_id, {norm('title')} AS title_normalized, {place('location')} AS location_normalized,
  {chain("lower(concat_ws(' ', '', title, description))", facts.JOB_TYPES, "'unknown'")} AS job_type, company, source, description, scraped_at, title FROM (SELECT * REPLACE ({strip('title')} AS title) FROM ({DOCS}))"""
NAMES = "CASE lower(s) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in facts.DISPLAY) + " ELSE upper(s[1]) || lower(s[2:]) END"
SEARCHED = f"""SELECT row_number() OVER (ORDER BY posted_at DESC, job_id) AS rank, job_id, title, posted_at, location FROM ({PARTS}) WHERE {{}} QUALIFY rank <= {{}}"""
WORD_HIT = "CASE w WHEN 'intern' THEN contains(t, 'intern') OR contains(t, 'thuc tap') OR contains(t, 'tts') WHEN 'tts' THEN contains(t, 'intern') OR contains(t, 'thuc tap') OR contains(t, 'tts') WHEN 'fresher' THEN contains(t, 'fresher') OR contains(t, 'moi tot nghiep') ELSE contains(t, translate(w, 'y', 'i')) END"
RECENT = f"SELECT * FROM ({EVENTS}) WHERE ts >= {ASOF} - INTERVAL 7 DAY OR NOT (SELECT bool_or(ts >= {ASOF} - INTERVAL 7 DAY) FROM events)"


def interleaved(rows: str, ts: str, columns: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY turn, lower(source)) AS rank, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY lower(source) ORDER BY {ts} DESC, job_id) AS turn FROM ({rows}))
      QUALIFY rank <= 20"""


ENTRY = f"""'*' || k || '\\. ' || {esc('title')} || '*' || chr(10) || '   🏢 ' || {esc('company')} || chr(10) || '   📍 ' || {esc('location')} || chr(10) || '   💰 ' || {esc('salary_raw')} || chr(10) || '   🔗 [Xem chi tiết](' || source_url || ')' || chr(10)"""

SQL: dict[str, str] = {
    "normalize_title": f"SELECT doc_id, nfc_normalize({norm('title')}) AS t FROM ({DOCS})",
    "clean_text": f"SELECT doc_id, {clean('title')} AS t FROM ({DOCS})",
    "tokenize_query": f"""SELECT q, keyword, place, array_to_string({tokens('keyword')}, '#') AS tokens FROM (SELECT q,
      {strip("CASE WHEN contains(q, '|') THEN q[:instr(q, '|') - 1] WHEN contains(q, ',') THEN q[:instr(q, ',') - 1] ELSE q END")} AS keyword,
      {strip("CASE WHEN contains(q, '|') THEN q[instr(q, '|') + 1:] WHEN contains(q, ',') THEN q[instr(q, ',') + 1:] END")} AS place FROM {inline(QUERY_TEXTS, 'q')})""",
    "location_canon": f"SELECT place, {place('place')} AS city FROM (SELECT place FROM {inline(PLACES, 'place')} UNION ALL SELECT c_mktsegment || ' hcm ' || c_nationkey FROM customer)",
    "salary_parse": f"""SELECT {KEY}, CASE WHEN NOT none_ AND len(nums) > 0 THEN CAST(nums[1] * unit AS BIGINT) END AS low, CASE WHEN NOT none_ AND len(nums) > 0 THEN CAST(nums[-1] * unit AS BIGINT) END AS high
      FROM ({NUMBERS}) WHERE NOT ({BAD})""",
    "salary_row_drop": f"SELECT l_linenumber, count(*) AS n, count_if({BAD}) AS dropped FROM ({NUMBERS}) GROUP BY 1",
    "job_type_classify": f"""SELECT p_partkey, {chain("lower(concat_ws(' ', k, p_name, ''))", facts.JOB_TYPES, "'unknown'")} AS job_type
      FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'Full-Time' WHEN p_size % 5 = 0 THEN 'Hợp đồng remote' ELSE p_type END AS k FROM part)""",
    "tag_extract": f"""SELECT doc_id, {tags('x')} AS tags FROM (SELECT doc_id, lower(concat_ws(' ', title, description, CASE WHEN doc_id % 2 = 0 THEN 'C++ / C# / Go / JavaScript trust ai, SQL' ELSE 'spark c++11 (etl)' END)) AS x FROM ({DOCS}))""",
    "date_parse": f"""SELECT {KEY}, strftime(CASE l_linenumber WHEN 1 THEN l_shipdate - to_days(CAST(trunc(l_quantity) AS INTEGER)) WHEN 2 THEN date_trunc('day', l_shipdate) WHEN 3 THEN date_trunc('day', l_shipdate)
      WHEN 4 THEN l_shipdate - to_hours(CAST(trunc(l_quantity) AS INTEGER)) WHEN 5 THEN l_shipdate WHEN 6 THEN date_trunc('second', l_shipdate) END, '%Y-%m-%d %H:%M:%S') AS ts, l_linenumber = 3 AS naive FROM lineitem""",
    "content_id": f"SELECT p_partkey, {ident(norm('p_name'), 'lower(p_brand)', 'lower(p_type)')} AS job_id, {ident(norm('p_name'), 'lower(p_brand)')} AS cross_id FROM part",
    "dedup_first_wins": f"SELECT job_id, title, company, source FROM ({PARTS}) QUALIFY row_number() OVER (PARTITION BY title, lower(company) ORDER BY job_id) = 1",
    "dedup_same_source": f"SELECT job_id, title, company, source FROM ({PARTS}) QUALIFY row_number() OVER (PARTITION BY title, lower(company), source ORDER BY job_id) = 1",
    "dedup_documents": f"SELECT doc_id, source FROM ({DOCS}) QUALIFY row_number() OVER (PARTITION BY {norm('title')}, lower(company) ORDER BY doc_id) = 1",
    "upsert_last_wins": "SELECT user_id, event_id AS job_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 <> 0 DESC, event_id DESC) = 1",
    "anti_join_new": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "semi_join_existing": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "store_item": f"""SELECT job_id, source || '#' || strftime(scraped_at, '%Y-%m-%d') AS source_posted, least(length(description), 2000) AS n_description, strftime(scraped_at, '%Y-%m-%dT%H:%M:%SZ') AS scraped_at,
      CAST(NULL AS VARCHAR) AS posted_at, CAST(epoch({ASOF}) AS BIGINT) + 60 * 86400 AS ttl FROM ({JOB})""",
    "transform_batch": f"""SELECT job_id, title_normalized, location_normalized, CAST(NULL AS BIGINT) AS salary_min, CAST(NULL AS BIGINT) AS salary_max, job_type, {tags('x')} AS tags, source FROM (SELECT *, lower(concat_ws(' ', title, description, '')) AS x FROM ({JOB}))""",
    "ttl_live": f"SELECT event_id AS job_id, CAST(floor(epoch(ts)) AS BIGINT) + 15 * 86400 AS ttl FROM events WHERE CAST(floor(epoch(ts)) AS BIGINT) + 15 * 86400 > epoch({ASOF})",
    "raw_validate": f"SELECT doc_id FROM ({DOCS}) WHERE doc_id % 5 <> 0 AND NOT ({BLANK('title')})",
    "raw_issues": f"""SELECT doc_id, NOT ({BLANK('title')}) AS is_valid, CASE WHEN {BLANK('title')} THEN 'CRITICAL: missing title' ELSE concat_ws('; ', CASE WHEN length({strip('title')}) < 3 THEN 'WARNING: title too short' END,
      CASE WHEN {BLANK('company')} THEN 'WARNING: missing company' END, CASE WHEN {BLANK('source_url')} THEN 'WARNING: missing url' END) END AS issues
      FROM (SELECT * REPLACE (CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN ' Ab ' ELSE title END AS title) FROM ({DOCS}))""",
    "quality_report": quality(),
    "quality_by_source": quality("source"),
    "source_summary": f"""SELECT source, count(*) AS scraped, count_if(NOT ({BLANK('title')})) AS valid, CAST(round_even(count_if(NOT ({BLANK('title')})) * 100.0 / count(*), 1) AS DOUBLE) AS pass_rate FROM ({MESSY}) GROUP BY ROLLUP (source)""",
    "processed_validate": f"""SELECT {KEY}, l_linenumber <> 7 AS is_valid, concat_ws('; ', CASE WHEN l_linenumber = 7 THEN 'CRITICAL: missing normalized title' END, CASE WHEN l_linenumber = 2 THEN 'WARNING: missing url' END,
      CASE WHEN trunc(l_quantity) <> 0 AND trunc(l_quantity) > l_linenumber * 5 THEN 'WARNING: salary range reversed' END) AS issues FROM lineitem""",
    "keyword_union": f"SELECT keyword FROM {inline(facts.SEED_KEYWORDS, 'keyword')} UNION SELECT keyword_normalized FROM ({ACTIVE}) WHERE NOT ({BLANK('keyword_normalized')})",
    "source_keyword_cross": f"SELECT DISTINCT event_type AS source, keyword FROM events, (SELECT keyword FROM {inline(facts.SEED_KEYWORDS, 'keyword')} UNION SELECT keyword_normalized FROM ({ACTIVE}) WHERE NOT ({BLANK('keyword_normalized')}))",
    "source_union": f"SELECT source, count(*) AS n, count(DISTINCT title) AS titles FROM (SELECT title, source FROM ({PARTS}) UNION ALL SELECT title, source FROM ({DOCS})) GROUP BY 1",
    "search_keyword": f"SELECT rank, job_id, title, posted_at FROM ({SEARCHED.format(' AND '.join(f'(contains(title, {q(w)}) OR contains({clean(chr(116) + chr(97) + chr(103))}, {q(w)}))' for w in ('red', 'widget', 'economi')), 20)})".replace("contains(title, ", f"contains({clean('title')}, "),
    "search_documents": f"SELECT row_number() OVER (ORDER BY scraped_at DESC, doc_id) AS rank, doc_id AS job_id, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at FROM ({DOCS}) WHERE contains({clean('title')}, 'the') AND contains({clean('title')}, 'and') QUALIFY rank <= 50",
    "search_synonyms": f"SELECT CAST(i - 1 AS INTEGER) AS job_id, w FROM (SELECT {clean('s')} AS t, i FROM (SELECT unnest([{', '.join(map(q, TITLES))}]) AS s, unnest(range(1, {len(TITLES) + 1})) AS i)), {inline(['intern', 'tts', 'fresher', 'thuc', 'python'], 'w')} WHERE {WORD_HIT}",
    "search_location_after_limit": f"SELECT rank, job_id, location FROM ({SEARCHED.format(f'contains({clean(chr(116) + chr(105) + chr(116) + chr(108) + chr(101))}, {q(chr(114) + chr(105) + chr(110) + chr(103))})', 50)}) WHERE contains(lower(location), 'brand#1')",
    "recency_filter": f"SELECT job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM ({RECENT})",
    "recency_fallback": f"""SELECT source, count(*) AS n, min(job_id) AS first FROM (SELECT *, bool_or(ts >= {ASOF} - INTERVAL 7 DAY) OVER (PARTITION BY source) AS any_ FROM ({EVENTS}) WHERE source <> 'error' OR ts < TIMESTAMP '2024-01-15')
      WHERE ts >= {ASOF} - INTERVAL 7 DAY OR NOT any_ GROUP BY 1""",
    "interleave_top20": interleaved(RECENT, "ts", "job_id, source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"),
    "match_subscriptions": f"SELECT user_id, sk, rank, job_id, title FROM ({MATCHED})",
    "myjobs_union_dedup": f"SELECT job_id, keyword_raw AS matched_keyword, rank FROM ({MINE})",
    "match_variant_salary": f"SELECT job_id, salary_max FROM ({PARTS}) WHERE (contains(title, 'small') OR contains(tag, 'small')) AND (contains(title, 'gear') OR contains(tag, 'gear')) AND (salary_max = 0 OR salary_max >= 20000)",
    "new_since": "SELECT event_id AS job_id, event_type AS source FROM events WHERE ts >= TIMESTAMP '2024-01-20'",
    "subs_cap": "SELECT * FROM (VALUES ('u2', 'SUB#bolt', 'Bolt', 'Ho Chi Minh'), ('u5', 'SUB#cog', 'cog', '')) t(user_id, sk, keyword_raw, location_filter)",
    "unsubscribe_match": f"""SELECT s.user_id, sk FROM ({SUBS}) s JOIN (VALUES ('u1', 'widget'), ('u2', 'gears'), ('u4', 'x')) a(user_id, k) ON s.user_id = a.user_id WHERE NOT ({BLANK('keyword_normalized')}) AND (contains(keyword_normalized, k) OR contains(k, keyword_normalized))""",
    "unsubscribe_remaining": f"SELECT user_id, sk FROM ({SUBS}) WHERE sk NOT IN ('SUB#red widget', 'SUB#gear')",
    "subs_list": f"SELECT user_id, keyword_raw, n_all FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_all FROM ({SUBS}) WHERE starts_with(sk, 'SUB#')) WHERE is_active",
    "user_subs_grouped": f"SELECT user_id, string_agg(keyword_raw, ', ' ORDER BY keyword_raw) AS keywords, count(*) AS n FROM ({ACTIVE}) GROUP BY 1",
    "escape_md": f"SELECT doc_id, {esc('text')} AS t FROM documents",
    "unescape_md": f"SELECT doc_id, title || '!\\q' AS t FROM ({DOCS})",
    "digest_text": f"""SELECT user_id, keyword_raw, '🔔 *' || count(*) || ' việc mới* cho *' || {esc('keyword_raw')} || '*\\!' || chr(10) || chr(10) || string_agg(CASE WHEN k <= 10 THEN {ENTRY} END, chr(10) ORDER BY k)
      || CASE WHEN count(*) > 10 THEN chr(10) || '_\\.\\.\\.và ' || (count(*) - 10) || ' việc khác\\. Dùng /search ' || {esc('keyword_raw')} || ' để xem tất cả\\._' ELSE '' END AS message
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, keyword_raw ORDER BY rank) AS k FROM ({MATCHED})) GROUP BY user_id, keyword_raw""",
    "listing_text": f"""SELECT rank, '*' || rank || '\\. [' || name || '] ' || {esc('title')} || '*' || chr(10) || '   🏢 ' || {esc('company')} || chr(10) || '   📍 ' || {esc('location')} || ' \\| 💰 ' || {esc('salary_raw')} || chr(10) || '   🔑 Từ khóa: `' || {esc('keyword_raw')} || '`' || chr(10)
      || '   🔗 [Xem chi tiết trên ' || name || '](' || source_url || ')' || chr(10) AS line FROM (SELECT *, upper(source[1]) || lower(source[2:]) AS name FROM ({interleaved(f'SELECT * EXCLUDE (rank) FROM ({MINE})', 'posted_at', '*')}))""",
    "source_display": f"SELECT s, {NAMES} AS shown FROM {inline(['itviec', 'CAREERLINK', 'ybox', 'jOOBLE', 'timviec365', 'vieclam24h', 'careerviet', 'my work', ''], 's')}",
    "url_path_encode": "SELECT page_id, url_encode(url || ' kế toán*~+') AS u FROM pages",
    "json_props": "SELECT event_id AS job_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "json_api": "SELECT p_name AS title, p_brand AS company, p_type AS description, count(*) AS n FROM part GROUP BY 1, 2, 3",
    "queue_messages": f"SELECT CASE WHEN good THEN s ELSE '(quarantine)' END AS source, count(*) + CASE WHEN any_value(good) THEN 0 ELSE 1 END AS n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'jooble' WHEN 1 THEN 'ybox' ELSE 'elsewhere' END AS s, doc_id % 3 <> 2 AS good FROM documents) GROUP BY 1",
    "href_dedup": "SELECT p_partkey, x.pos AS pos, x.href AS href FROM part, (VALUES (0, '/a-p'), (3, '/b-p')) x(pos, head), LATERAL (SELECT x.head || p_partkey || '.html' AS href) h".replace("x.href", "h.href"),
    "scan_careerlink": """SELECT p_name AS title, p_brand AS company, 'Hà Nội' AS location, p_size || ' triệu' AS salary_raw, p_type AS description, 'https://www.careerlink.vn/j/' || p_partkey AS source_url,
      CASE WHEN p_size % 3 = 0 THEN '' ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(p_partkey AS INTEGER)), '%Y-%m-%dT%H:%M:%S+00:00') END AS posted_at_raw, '' AS job_type_raw, 'careerlink' AS source FROM part WHERE p_size % 7 <> 0""",
    "scan_itviec": """SELECT p_name AS title, p_brand AS company, CASE WHEN p_size % 2 = 0 THEN 'Hà Nội' ELSE 'Da Nang' END AS location, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Salary ' || p_size END AS salary_raw, 'Java, ' || p_type AS description,
      'https://itviec.com/it-jobs/s-' || p_partkey AS source_url, 'Posted ' || p_size || ' hours ago' AS posted_at_raw, CASE p_size % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'At office' ELSE '' END AS job_type_raw, 'itviec' AS source FROM part""",
    "scan_careerviet": """SELECT p_name AS title, p_brand AS company, CASE WHEN p_size % 2 = 0 THEN 'Hà Nội, Huế' ELSE p_type END AS location, p_size || ' Tr' AS salary_raw, '' AS description, 'https://careerviet.vn/vi/j-' || p_partkey AS source_url,
      '05-01-2024' AS posted_at_raw, '' AS job_type_raw, 'careerviet' AS source FROM part WHERE p_size % 7 <> 0""",
    "scan_timviec365": """SELECT p_name AS title, p_brand AS company, CASE WHEN p_size % 2 = 0 THEN 'Đà Nẵng' ELSE '' END AS location, p_size || ' - ' || (p_size + 2) || ' triệu' AS salary_raw, '' AS description,
      'https://timviec365.vn/v-p' || p_partkey || '.html' AS source_url, '05/01/2024' AS posted_at_raw, '' AS job_type_raw, 'timviec365' AS source FROM part""",
    "scan_vieclam24h": """SELECT p_name AS title, p_brand AS company, p_type AS location, CASE WHEN p_size % 3 = 0 THEN 'Thỏa thuận' ELSE p_size || ' triệu' END AS salary_raw, '' AS description, 'https://vieclam24h.vn/j/' || p_partkey AS source_url,
      '' AS posted_at_raw, '' AS job_type_raw, 'vieclam24h' AS source FROM part""",
    "scan_ybox": r"""SELECT CASE WHEN p_size % 2 = 0 THEN '[HCM] ' ELSE '' END || p_name || ' 5-6tr' AS title, p_brand AS company, CASE WHEN p_size % 2 = 0 THEN 'HCM' ELSE 'Việt Nam' END AS location, trim(regexp_extract(p_name || ' 5-6tr', '([0-9\s\-.,tr]+tr)', 1)) AS salary_raw, p_type AS description,
      'https://ybox.vn/tuyen-dung/s-' || p_partkey AS source_url, '2024-01-05' AS posted_at_raw, '' AS job_type_raw, 'ybox' AS source FROM part WHERE p_size % 7 <> 0""",
    "existing_ids": f"SELECT DISTINCT {ident('p_name', 'lower(p_brand)', 'lower(p_type)')} AS job_id FROM part WHERE lower(p_type) = 'promo'",
    "command_route": f"""SELECT said, command, CASE WHEN command IN ('subscribe', 'unsubscribe', 'search') THEN CASE WHEN starts_with(t, '/') THEN trim(replace(t, '/' || command, '')) ELSE t END END AS argument FROM (
      SELECT said, t, CASE WHEN starts_with(t, '/start') THEN 'start' WHEN starts_with(t, '/subscribe') THEN 'subscribe' WHEN starts_with(t, '/unsubscribe') THEN 'unsubscribe' WHEN starts_with(t, '/list') THEN 'list'
      WHEN starts_with(t, '/myjobs') OR starts_with(t, '/jobs') THEN 'myjobs' WHEN starts_with(t, '/search') THEN 'search' WHEN starts_with(t, '/help') THEN 'help' ELSE 'search' END AS command
      FROM (SELECT said, trim(said) AS t FROM {inline(CHATS, 'said')}) WHERE t <> '')""",
    "user_put": "SELECT CAST(user_id AS VARCHAR) AS user_id, 'PROFILE' AS sk, max_by(event_type, (event_id % 2) * 1000000000000 + event_id) AS username, '' AS first_name, true AS is_active, strftime(max_by(ts, (event_id % 2) * 1000000000000 + event_id), '%Y-%m-%dT%H:%M:%SZ') AS created_at, '' AS last_notified_at FROM events GROUP BY user_id",
    "subscription_match": f"""SELECT job_id, sk FROM ({PARTS}), (VALUES ('SUB#ring', 'ring', '', 0), ('SUB#gear', 'small gear', 'Brand#1', 20000), ('SUB#x', 'bolt', 'nowhere', 0)) s(sk, k, place_, floor_)
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(k, ' ')) AS t) WHERE NOT (contains(lower(title), t) OR contains(tag, t)))
      AND (place_ = '' OR contains(lower(location), lower(place_))) AND (floor_ = 0 OR salary_max = 0 OR salary_max >= floor_)""",
    "search_message": f"""SELECT count(*) AS n, '🔍 *' || count(*) || ' kết quả* cho *ring* tại *brand\\#1*:' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS message FROM (
      SELECT rank, '*' || rank || '\\. [' || {esc('name')} || '] ' || {esc('title')} || '*' || chr(10) || '   🏢 ' || {esc('company')} || chr(10) || '   📍 ' || {esc('location')} || chr(10) || '   💰 ' || {esc('salary_raw')} || chr(10)
      || '   🔗 [Xem chi tiết trên ' || {esc('name')} || '](' || source_url || ')' || chr(10) AS line FROM (SELECT *, upper(source[1]) || lower(source[2:]) AS name FROM (
      SELECT *, row_number() OVER (ORDER BY posted_at DESC, job_id) AS rank FROM ({PARTS}) WHERE contains({clean('title')}, 'ring') QUALIFY rank <= 50) WHERE contains(lower(location), 'brand#1')))""",
    "single_match": f"""SELECT job_id, '💼 *' || {esc('title')} || '*' || chr(10) || '🏢 ' || {esc('company')} || chr(10) || '📍 ' || {esc("CASE WHEN job_id % 2 = 0 THEN 'Không rõ' ELSE location END")} || chr(10) || '💰 ' || {esc('salary_raw')} || chr(10)
      || '🔗 [' || upper(source[1]) || lower(source[2:]) || '](' || source_url || ')' || chr(10) AS message FROM ({PARTS})""",
    "log_records": "SELECT 'INFO' AS level, lang AS source, count(*) AS n, sum(n_chars) AS characters FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT 'ERROR', lang, count(*), sum(n_chars) FROM documents WHERE doc_id % 2 = 1 GROUP BY 1, 2",
    "embedded_json": """SELECT CASE p_size % 4 WHEN 0 THEN '[HCM] ' || p_name WHEN 1 THEN 'Sài Gòn ' || p_name || ' 10-20tr' ELSE p_name || ' lương: 8 - 10 triệu' END AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'user' END AS company,
      CASE p_size % 4 WHEN 0 THEN 'HCM' WHEN 1 THEN 'Hồ Chí Minh' ELSE 'Việt Nam' END AS location, CASE p_size % 4 WHEN 0 THEN 'Thỏa thuận' WHEN 1 THEN '10-20tr' ELSE '8 - 10 triệu' END AS salary_raw,
      'https://ybox.vn/tuyen-dung/s-' || p_partkey AS source_url, '2024-01-05' AS posted_at_raw FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')""",
    "matcher_summary": f"""SELECT users, matches, sent, failures FROM (SELECT count(*) AS matches FROM ({MATCHED})), (SELECT count(DISTINCT user_id) AS users FROM ({ACTIVE})),
      (SELECT count_if(n <= 20) AS sent, count_if(n > 20) AS failures FROM (SELECT user_id, keyword_raw, count(*) AS n FROM ({MATCHED}) GROUP BY 1, 2))""",
    "etl_summary": f"SELECT count(*) AS raw, count(*) AS transformed, count(DISTINCT {ident('title_normalized', 'lower(company)')}) AS loaded FROM ({JOB})",
    "raw_to_search": interleaved(
        f"SELECT * FROM (SELECT job_id, source, scraped_at AS at_, row_number() OVER (ORDER BY strftime(scraped_at, '%Y-%m-%d %H:%M:%S') DESC, job_id) AS r, bool_or(scraped_at >= TIMESTAMP '2023-12-25 12:00:00') OVER () AS any_ FROM ({JOB}) WHERE contains({clean('title_normalized')}, 'the') OR {tags('lower(concat_ws(chr(32), title, description, chr(32)))')} LIKE '%the%' QUALIFY r <= 200) WHERE at_ >= TIMESTAMP '2023-12-25 12:00:00' OR NOT any_",
        "at_", "job_id, source, strftime(at_, '%Y-%m-%d %H:%M:%S') AS scraped_at"),
    "stream_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s
      FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1""",
}
