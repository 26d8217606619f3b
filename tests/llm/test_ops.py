"""The ten operators against brute force, on small tables with nulls, empties, ties, copies and clashing columns."""

import bisect
import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import crosspolytope, htmltext, licenses, mixing, quality, sentencepieces, simhash, suffixdedup, suffixes, telephony, warc
from tidemill.llm import queries as llm_queries
from tidemill.llm.common import join_unique
from tidemill.llm.components import components

LONG = " ".join(f"word{k % 977}" for k in range(40_000))
TEXTS = [(1, "Hello  world, this is a text of some words here."), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG), (7, "Hello  world, this is a text of some words here."), (7, "Hello  world, this is a text of some words here."), (None, "naïve 日本語 🙂 <s> ▁x"), (8, "one"), (9, "Hello  world, this is a text of some words here now.")]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns beside the needed ones have names that operators might use themselves."""
    rows = [(i, t, f"s{(i or 0) % 3}" if i != 4 else None, "k", 1, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp string, n int, `group` string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# 1


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "<p>b é</p>", "<p>a</p>", "x" * 300_000]
    rows = [(k, f"http://e.org/{k}\nx" if k != 3 else None, h, "d") for k, h in enumerate(html)] + [(4, "u", "<p>b é</p>", "d"), (None, None, "<p>c</p>", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, d string")
    folder = f"file://{tmp_path}/a"
    manifest = warc.write(df, folder, roll_bytes=200, shards=2)
    assert manifest.count() > 2 and sum(r.records for r in manifest.collect()) == len(rows)
    got = warc.read(spark, folder).collect()
    raw = lambda h: (h or "").encode()
    by = defaultdict(list)
    for r in got:
        by[r.key].append(r)
    assert sorted(map(str, by)) == sorted(map(str, {r[0] for r in rows})) and len(got) == len(rows)
    largest = {}
    for k, _, h, _ in rows:
        largest[raw(h)] = max(largest.get(raw(h), -1), -1 if k is None else k)
    for k, _, h, _ in rows:
        r = by[k][0]
        assert r.payload_bytes == len(raw(h)) and r.payload_digest == warc.digest(raw(h))
        if k != 4:
            owner = largest[raw(h)]
            assert (r.record_type, r.refers_to) == (("response", None) if owner in (k, -1) else ("revisit", owner))
    assert sorted((r.record_type, r.refers_to) for r in by[4]) == [("response", None), ("revisit", 4)]
    warc.write(df, f"file://{tmp_path}/b", roll_bytes=200, shards=2)
    same = lambda f: sorted((r.file, r.sha256) for r in spark.read.parquet(f"file://{tmp_path}/{f}/_manifest").collect())
    assert same("a") == same("b")
    warc.write(df.repartition(5), f"file://{tmp_path}/e", roll_bytes=200, shards=2)
    assert same("a") == same("e")
    with pytest.raises(FileExistsError):
        warc.write(df, folder)
    assert not (tmp_path / "a" / "_temporary").exists()
    few = warc.write(df, f"file://{tmp_path}/c", min_bytes=5)
    assert {r.key: r.record_type for r in warc.read(spark, f"file://{tmp_path}/c").collect()}[1] == "response" and few.count()
    assert warc.round_trip(df.limit(0)).count() == 0


# 2


def brute_spans(rows, length=50):
    first = {}
    low = -(1 << 63)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, 1 << 62), low if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (low if i is None else i):
                gone[p : p + length] = True
        spans = int(np.count_nonzero(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if b else 0
        yield str((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))


def random_texts(seed, count):
    r = random.Random(seed)
    base = ["".join(r.choice("abé ") for _ in range(300)) for _ in range(5)]
    for _ in range(count):
        parts = []
        for _ in range(r.randint(0, 5)):
            b, a = r.choice(base), r.randint(0, 250)
            parts.append(b[a : a + r.randint(20, 200)] + (r.choice("xyz") if r.random() < 0.3 else ""))
        yield r.randint(0, count), "".join(parts)


@pytest.mark.parametrize("length, block", [(50, 2000), (50, 8 << 20), (20, 5000)])
def test_suffix_dedup(spark, length, block):
    rows = list(random_texts(length, 80)) + [(1, None), (2, ""), (None, "x" * 60), (3, "x" * 60), (3, "x" * 70), (4, "ab" * 100), (5, "ab" * 40), (6, "x" * 49), (7, LONG[:3000]), (8, "q" + LONG[:3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixdedup.dedup(df.withColumn("block", F.lit("z")), length=length, digests=True, block_bytes=block, range_strings=500)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(brute_spans(rows, length))


def test_suffix_dedup_keeps_columns(spark, docs, empty):
    got = suffixdedup.dedup(docs, keep=["n", "source", "group"])
    assert got.columns == ["doc_id", "n", "source", "group", "n_bytes", "n_removed", "n_spans", "kept"] and got.count() == len(TEXTS)
    by = {r.doc_id: r for r in got.collect()}
    assert by[6].kept == b"" and by[6].n_spans == 1 and by[5].n_removed == 0 and by[7].n_removed == 0
    assert suffixdedup.dedup(empty).count() == 0


def test_suffix_dedup_deals_evenly(spark, tmp_path):
    """No bucket of hashes and no range of strings is much larger than the others, however many there are."""
    random_, job = np.random.default_rng(0), suffixdedup.Job(f"file://{tmp_path}", 50, 64, 0)
    table = pa.table({"__id": pa.array([1], pa.int64()), "__text": pa.array([random_.integers(97, 123, 400_000, dtype=np.uint8).tobytes()], pa.large_binary())})
    with pa.ipc.new_file(f"{tmp_path}/a.block", table.schema) as file:
        file.write_table(table)
    sizes = np.diff(job.bounds(np.sort(job.block("a").runs(job.shape)[3])))
    assert sizes.max() < 2 * sizes.mean()
    (tmp_path / "anchor").mkdir()
    blocks = [random_.integers(0, 256, (20 if k % 3 == 0 else 2000, 16), dtype=np.uint8) for k in range(90)]
    local = [job.local(str(k), "anchor", keys, np.arange(len(keys)), 10).to_pylist()[0] for k, keys in enumerate(blocks)]
    cuts = suffixdedup.splits(spark.createDataFrame(local, "block string, count long, sample binary"), 16, 100, 10, 90)
    keys = np.concatenate(blocks)
    sizes = np.diff(np.concatenate(([0], suffixes.places(keys[suffixes.sort_rows(keys)], cuts), [len(keys)])))
    assert sizes.max() < 5 * sizes.mean()


def test_places_of_cuts():
    random_ = np.random.default_rng(0)
    for top in (2, 3, 256):
        keys, cuts = (m[suffixes.sort_rows(m)] for m in (random_.integers(0, top, (300, 13), dtype=np.uint8), random_.integers(0, top, (40, 13), dtype=np.uint8)))
        cuts = np.concatenate((cuts, keys[::50]))
        cuts = cuts[suffixes.sort_rows(cuts)]
        rows = [bytes(x) for x in keys]
        assert rows == sorted(rows) and suffixes.places(keys, cuts).tolist() == [bisect.bisect_left(rows, bytes(c)) for c in cuts]


def test_merge_of_front_coded_runs():
    random_ = np.random.default_rng(0)
    for trial in range(60):
        width, runs, rows = int(random_.integers(1, 90)), [], []
        for _ in range(int(random_.integers(1, 8))):
            m = random_.integers(97, 99 if trial % 2 else 200, (int(random_.integers(0, 30)), width)).astype(np.uint8)
            m = m[suffixes.sort_rows(m)]
            runs.append(suffixes.front_code(m) if len(m) else (b"", b""))
            rows.append([bytes(x) for x in m])
        run, share = suffixes.merge(runs, width)
        its = [iter(r) for r in rows]
        out = [next(its[r]) for r in run]
        assert out == sorted(sum(rows, []))
        for a, b, h in zip(out, out[1:], share[1:]):
            assert a[:h] == b[:h] and (h == width or a[h] != b[h])


# 3


def test_mixing(spark, docs, empty):
    random_ = random.Random(4)
    rows = [(k, "w " * random_.randint(0, 400), random_.choice(["a", "a", "a", "b", "c", "é", None])) for k in range(600)] + [(999, "w " * 30_000, "b"), (1000, None, "tiny"), (1001, " v", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, group=50).collect()
    again = mixing.mix(df.repartition(7), group=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # the excess over a stop is shared again
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    taken = defaultdict(int)
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s in order:
        if s != "b":
            assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]), s
    largest = max(r.size for r in got if source[r.doc_id] == "b")
    assert abs(taken["b"] - target["b"]) < largest  # one document has over half of this source's words
    assert mixing.mix(docs).count() == len(TEXTS) and mixing.mix(empty).count() == 0
    counts = defaultdict(int)
    for r in mixing.repeated(df, group=50).select("doc_id", "text").collect():
        counts[r.doc_id] += 1
    assert all(counts[r.doc_id] * r.size == r.taken for r in got)


def test_flight_keeps_totals():
    random_ = np.random.default_rng(1)
    size, p = random_.integers(1, 1000, 500).astype(float), np.full(500, 0.37)
    rows = np.stack([size, np.ones(500)])
    out = mixing.flight(p.copy(), rows, random_)
    assert np.count_nonzero((out > 1e-9) & (out < 1 - 1e-9)) <= 2
    assert np.allclose(rows @ out, rows @ p)


def test_landing_keeps_chances_and_totals():
    """Each unit's share of 4,000 landings is its probability, and words stay near what is expected."""
    random_ = np.random.default_rng(3)
    size = np.concatenate([[300.0, 200.0], random_.integers(1, 60, 60)])
    start = random_.uniform(0.2, 0.8, len(size))
    taken, off = np.zeros(len(size)), []
    for k in range(4000):
        p = mixing.landing(start.copy(), size, mixing.seeded(1, k))
        assert set(np.unique(p)) <= {0.0, 1.0}
        taken += p
        off.append(abs((p - start) @ size))
    assert np.abs(taken / 4000 - start).max() < 0.04  # five standard errors
    assert np.median(off) < 5


def test_running_sums(spark):
    rows = [(s, k % 7) for k, s in enumerate(["b", None, "a", "é", "z", "", "c"] * 1)]
    got = mixing.in_order(spark.createDataFrame(rows, "source string, v long"), [F.col("source").asc_nulls_last()], {"before": "v"}, "t").collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    assert {r.source: int(r.before) for r in got} == {s: sum(v for _, v in order[:k]) for k, (s, _) in enumerate(order)}


# 4


def test_quality(spark, docs, empty):
    rows = [(k, ("spam buy now !!! " if k % 3 == 0 else "a quiet text about rivers and hills ") * (1 + k % 5) + f"w{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1) for k in range(300)] + [(5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(df, quality.fit(df, labels, bits=12)).collect()}
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _ in rows)
    held = [k for k, _ in rows if out[k].held_out]
    assert np.mean([out[k].predicted == (k % 3 != 0) for k in held]) > 0.95
    assert all(out[k].predicted == (out[k].score >= 0.5) for k, _ in rows)
    learned = quality.fit(df, labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))), bits=12)
    assert np.array_equal(learned.weight, quality.fit(df, labels, bits=12).weight)  # held-out labels change nothing
    model = quality.fit(df, labels, bits=12)
    assert quality.classify(docs, model).count() == len(TEXTS) and quality.classify(empty, model).count() == 0
    assert quality.fit(df, labels.limit(0), bits=12).score("x") == 0.5
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.fit(df, labels, bits=12, class_bytes=0).score("x") == 0.5
    small = quality.fit(df.unionByName(spark.createDataFrame([(3, "spam " * 100_000)], "doc_id long, text string")), labels, bits=12, class_bytes=20_000)
    assert np.mean([(small.score(t) >= 0.5) == (k % 3 != 0) for k, t in rows]) > 0.9


# 5


def test_cross_polytope(spark):
    random_ = np.random.default_rng(2)
    data = random_.normal(size=(1500, 24)).astype(np.float32)
    data[40:60] = data[0]
    ids = np.arange(1500)
    rows = [(int(i), [float(x) for x in v], "v") for i, v in zip(ids, data)]
    odd = [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [None] * 24), (2400, [1.0] * 5), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + [(i, v, "v") for i, v in odd] + rows[:1], "vec_id long, embedding array<float>, ids string")
    got = defaultdict(list)
    for r in sorted(crosspolytope.search(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.score, r.vec_id))
    want = crosspolytope.brute_force(ids, data.astype(float), np.arange(0, 1500, 100))
    assert set(got) == set(want)  # the short vector has no candidate of its length
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in v}) / 10 for q, v in want.items()])
    assert recall >= 0.9
    assert [i for _, i in got[0]] == list(range(40, 50)) and got[0][0][0] == 0
    for found in got.values():
        assert found == sorted(found)
    assert crosspolytope.search(df.limit(0)).count() == 0


def test_cross_polytope_fills_up(spark):
    """Small tables, a rare length, and queries far from one tight cluster: k neighbours, or all there are."""
    random_ = np.random.default_rng(4)
    for n in (5, 12, 30):
        data = random_.normal(size=(n, 64))
        ids = np.arange(n) * 50
        rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, data)] + [(10_000, [1.0] * 5), (10_001, [2.0] * 5)]
        got = defaultdict(list)
        for r in sorted(crosspolytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r.query_id, r["rank"])):
            got[r.query_id].append(r.vec_id)
        want = crosspolytope.brute_force(ids, data, ids[::2])
        assert all(len(got[q]) == min(10, n - 1) for q in want) and got[10_000] == [10_001]
        if n <= 11:
            assert all(got[q] == [i for _, i in v] for q, v in want.items())
    center = random_.normal(size=64)
    data = np.concatenate([random_.normal(size=(20, 64)), center + 0.01 * random_.normal(size=(2000, 64))])
    ids = np.concatenate([np.arange(20) * 100, 1_000_001 + 100 * np.arange(2000)])
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, data)], "vec_id long, embedding array<double>")
    assert {r["count"] for r in crosspolytope.search(df).groupBy("query_id").count().collect()} == {10}


def test_cross_polytope_buckets(spark, monkeypatch):
    """Several hashes a table, buckets in parts: still near all neighbours, and far fewer rows ranked."""
    monkeypatch.setattr(crosspolytope, "OCCUPANCY", 8)
    random_ = np.random.default_rng(6)
    centers = random_.normal(size=(60, 32))
    data = np.concatenate([centers[k % 60] + 0.3 * random_.normal(size=32) for k in range(4000)]).reshape(-1, 32)
    data[1000:2000] = data[0] + 0.001 * random_.normal(size=(1000, 32))
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, data)], "vec_id long, embedding array<double>")
    assert crosspolytope.hashes_for(4000, 32) == 2
    want = crosspolytope.brute_force(ids, data, np.arange(0, 4000, 100))
    for split in (16384, 50):
        got = defaultdict(set)
        for r in crosspolytope.search(df, split=split).collect():
            got[r.query_id].add((r.vec_id, r.score))
        recall = np.mean([len({i for i, _ in got[q]} & {i for _, i in v}) / 10 for q, v in want.items()])
        assert recall >= 0.9
        assert all(s == np.sqrt(((data[i] - data[q]) ** 2).sum()) for q in got for i, s in got[q])


def test_probes_are_the_nearest_buckets():
    tables = crosspolytope.Tables(8, 3, 2, 5)
    x = crosspolytope.unit(np.random.default_rng(1).normal(size=(5, 8)))
    probes, own = tables.probes(x, 256), tables.buckets(x)
    assert (probes[:, :, 0] == own).all()
    for n in range(5):
        for t in range(3):
            turned = [np.concatenate((y, -y)) for y in (tables.turned(x[n : n + 1], 2 * t + k)[0] for k in range(2))]
            cost = [((turned[0].max() - turned[0][a]) ** 2 + (turned[1].max() - turned[1][b]) ** 2, (a * 16 + b) * 3 + t) for a in range(16) for b in range(16)]
            assert sorted(probes[n, t].tolist()) == sorted(c for _, c in cost)
            assert {c for _, c in sorted(cost)[:5]} == set(tables.probes(x, 5)[n, t].tolist())


def test_hadamard_turns_keep_length():
    tables = crosspolytope.Tables(24, 2, 1, 1)
    x = np.eye(24, dtype=np.float32)
    assert np.allclose(np.linalg.norm(tables.turned(x, 1), axis=1), 1, atol=1e-5)


# 6


def test_html(spark):
    pages = [
        "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class=ad>Buy this now, it is cheap.</div>"
        "<article><h1>Head &amp; tail</h1><p><b>First block.<br><p>Second\n\n  block &#233; here.</p><ul><li>one item</li><li>another item</li></ul></article><footer>&copy; all rights</footer></body></html>",
        None, "", "<p>", "<<<>>> < & &bogus; <a href='", "<div>" * 3000 + "deep text here, with words." + "</div>" * 3000,
    ]
    df = spark.createDataFrame([(k, "u", p, "t") for k, p in enumerate(pages)] + [(None, None, pages[0], "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert got[0].text == "Head & tail\n\nFirst block.\n\nSecond block é here.\n\none item\n\nanother item" == got[None].text
    assert got[1].text == got[2].text == got[3].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert htmltext.extract(df.limit(0)).count() == 0


PAGES = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Rivers</title><style>p{color:red}</style></head><body class="home">
        <header class="site-header"><a href="/"><svg viewBox="0 0 1 1"><title>Logo</title></svg>The Daily</a><nav><ul><li><a href="/w">World</a><li><a href="/s">Sport</a></ul></nav></header>
        <div class="cookie-consent"><p>We use cookies to improve this site.</p><button>Accept all</button></div>
        <main><article><h1>Rivers rise &amp; fall</h1><p>After a week of rain, the rivers of the north rose by two metres, the office said.</p>
        <p>Energy follows <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here, <em>as a teacher</em> explained to us on Monday.<video src=v.mp4>Your player can't show this.</video></p>
        <div class="advert"><p>Buy boots now, half price.</p></div><h2>What comes next</h2><p>The water will fall again by the weekend, if no more rain comes.</p></article></main>
        <section id="comments"><div class="comment"><p>I saw it from my window, it was a lot of water.</p></div></section>
        <aside class="sidebar"><ul><li><a href="/1">Most read: snow</a></ul></aside><footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer><script>var x = "<p>no text</p>";</script></body></html>""",
        ["Rivers rise & fall", "After a week of rain, the rivers of the north rose by two metres, the office said.", "Energy follows E=m here, as a teacher explained to us on Monday.", "What comes next", "The water will fall again by the weekend, if no more rain comes."],
    ),
    (
        """<html><body><div id="nav"><a href="a">Home</a> | <a href="b">About</a></div><div class="content"><h1>Bread</h1><p>Mix the flour with water and salt, and let it rest for an hour.<p>Then fold it twice,
        and bake it in a hot oven until it is brown.<ul><li>500 g flour<li>10 g salt</ul></div><div class="footer">Imprint and contact</div></body></html>""",
        ["Bread", "Mix the flour with water and salt, and let it rest for an hour.", "Then fold it twice, and bake it in a hot oven until it is brown.", "500 g flour", "10 g salt"],
    ),
]


def test_html_pages_of_other_hands():
    """Pages written by hand, not by the generator that the trees learn from."""
    got = htmltext.extract_all([p for p, _ in PAGES], htmltext.model())
    assert [g.split("\n\n") for g in got] == [m for _, m in PAGES]


def test_broken_markup_takes_linear_time():
    """Millions of bytes that would make a parser look back: each page is read in a few seconds."""
    for source in ("<a href='x" * 500_000 + ">", "<div>" * 20_000 + "</p></span></li>" * 200_000, "<li>" + "<blockquote>" * 50_000 + "<dt>x" * 100_000, "<button>x<p>y" * 300_000, "<!x" * 1_000_000 + ">",
                   "<head>" * 500_000, '<a b="<a c=" d="' * 300_000 + ">", "<video>" * 100_000 + "</video>", "<select><" * 500_000 + "</select>"):
        began = time.perf_counter()
        page = htmltext.Page(source)
        assert time.perf_counter() - began < 12, source[:20]
        assert len(page.parent) == len(page.end) and all(page.end[v] > v for v in range(len(page.end)))


def test_markup_that_never_ends_loses_no_text():
    texts = lambda source: [t for t in htmltext.Page(source).text if t]
    assert texts("<p>one <svg/> two</p><p>three <button>four</p><p>five</p>") == ["one two", "three four", "five"]
    assert texts("<p>a<video>b<p>c</p>") == ["ab", "c"] and texts("<p>a<noscript>b</noscript> c</p>") == ["b", "a c"]
    assert texts("<div><button>x</div><p>kept</p><button>y</button>") == ["kept"]
    assert texts("<p title='it's'>f</p><p title=\"a<b>c\">d < e</p>") == ["f", "d < e"]
    assert texts("<p>x <!-- a > b --> y<!DOCTYPE z></p>") == ["x y"] and texts("a < b <3 </ c") == ["a < b <3 </ c"]


def test_html_trees_on_unseen_layouts():
    make = htmltext.Generator(123)
    made = [make.page() for _ in range(150)]
    got = htmltext.extract_all([s for s, _ in made], htmltext.model())
    assert np.mean([g == "\n\n".join(m) for g, (_, m) in zip(got, made)]) > 0.9


def test_decoding_has_no_contradictions():
    page = htmltext.Page("<div><p>a</p></div><div><p>b</p></div>")
    assert htmltext.decode(page, [1.0, -9.0, 1.0, 3.0, 5.0, -1.0, -2.0]) == ["b"]  # leaf a doesn't outweigh its ancestors
    assert htmltext.decode(page, [1.0, -5.0, 1.0, 9.0, 5.0, -1.0, -2.0]) == ["a", "b"]
    assert htmltext.decode(page, [-9.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]) == []  # six are not worth the root


# 7


def test_sentencepiece(spark, docs, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=__import__("public_tokenizers").path("piece_bpe_32k.model"))
    coder = sentencepieces.table(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    random_ = random.Random(5)
    texts = [t or "" for _, t in TEXTS] + ["".join(random_.choice("abcdeéàß -–=_\n\t 0123456789日本▁🙂") for _ in range(random_.randint(0, 40))) for _ in range(3000)]
    texts += [" " * k + w + " " * (k % 4) for k in range(40) for w in ("", "a", "the", "\n", "é", "x\n  y")] + [c * k for c in "aen-=*# ." for k in (3, 17, 200)]
    for t in texts:
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_bos=True, add_eos=True), t[:60]
        assert coder.decode(ids).decode() == model.decode(np.frombuffer(ids, "<u4").tolist())
    rows = sentencepieces.encode_decode(docs, digests=True).collect()
    assert len(rows) == len(TEXTS) and {r.doc_id: r.n_tokens for r in rows}[2] == 2
    assert {r.doc_id: r.ids for r in sentencepieces.encode_decode(docs).collect()}[3] == [1, 2]
    assert sentencepieces.encode_decode(empty).count() == 0


def test_other_models_are_refused(tmp_path):
    """A model that splits in another way than the table is not loaded."""
    table = sentencepieces.PrefixTable(public_tokenizers.path("piece_bpe_32k.model"))

    class Other:
        def __init__(self, model):
            self.model = model

        def encode(self, text):
            return self.model.encode(text.strip())

    with pytest.raises(ValueError, match="in another way"):
        table.check(Other(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))))
    table.byte.pop(7)
    with pytest.raises(ValueError, match="every byte"):
        table.check(None)


# 8


def plain_sound(payload, codec):
    """Samples of a payload, one by one."""
    out = []
    if codec == "ima":
        for at in range(0, len(payload), 192):
            value, index = 0, 0
            out.append(0)
            for byte in payload[at : at + 192]:
                for code in (byte & 15, byte >> 4):
                    step = int(telephony.STEPS[index])
                    delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                    value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
                    index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                    out.append(value)
        return out
    for byte in payload:
        if codec == "mulaw":
            byte = ~byte & 0xFF
            size = (((byte & 15) << 3) + 132 << (byte >> 4 & 7)) - 132
            out.append(-size if byte & 128 else size)
        else:
            byte ^= 0x55
            size = ((byte & 15) << 4) + 8 if not byte >> 4 & 7 else ((byte & 15) << 4) + 264 << (byte >> 4 & 7) - 1
            out.append(size if byte & 128 else -size)
    return out


def plain_feature(sound, rate, to):
    picked = []
    for k in range(len(sound) * to // rate):
        left, share = divmod(k * rate, to)
        right = min(left + 1, len(sound) - 1)
        picked.append((sound[left] * (to - share) + sound[right] * share) // to)
    n = len(picked)
    turns = sum((a < 0) != (b < 0) for a, b in zip(picked, picked[1:]))
    rms = (sum(x * x for x in picked) / n) ** 0.5
    return f"rate={to};n={n};s={n / to:.3f};rms={rms:.3f};peak={max(map(abs, picked))};mean={sum(picked) / n:.3f};turns={turns}"


def test_telephony_query_keeps_every_sample(spark, tmp_path):
    """The query's sound has all samples of the payload and those between them."""
    spark.createDataFrame([(k, f"Sound number {k}. " * (k + 1)) for k in range(12)] + [(99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    used = set()
    for r in llm_queries.op8_telephony(spark, str(tmp_path)).collect():
        raw = b"" if r.doc_id == 99 else (f"Sound number {r.doc_id}. " * (r.doc_id + 1)).encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        used.add(codec := telephony.CODECS[zlib.crc32(padded) % 3])
        assert r.feature == plain_feature(plain_sound(padded, codec), 8000, 16000)
    assert len(used) > 1


def test_folded_sound_comes_back():
    random_ = np.random.default_rng(0)
    for size in (0, 1, 2, 3, 4, 101, 1000):
        x = random_.integers(-32768, 32768, size).astype(np.int16)
        assert telephony.unfolded(telephony.folded(x)).tolist() == x.tolist()
        assert not np.frombuffer(telephony.folded(telephony.resample(x, 8000, 16000)), "<i2")[size:].any()


def test_coded_sound_comes_back_and_is_small():
    rng = np.random.default_rng(11)
    few, many = rng.integers(-9, 9, 4000).astype(np.int16), rng.integers(-32768, 32768, 4000).astype(np.int16)
    none, same = np.zeros(0, np.int16), np.full(300, -32768, np.int16)
    for sounds in ([few, many, none, same], [none], [few], [many]):
        assert [telephony.decoded(x).tolist() for x in telephony.coded(sounds)] == [x.tolist() for x in sounds]
    assert len(telephony.coded([few])[0]) < 4200
    for size in (1, 2, 3, 1000, 1001):
        x = rng.integers(-32768, 32768, size).astype(np.int16)
        assert telephony.restored(telephony.coded([np.frombuffer(telephony.folded(x), "<i2")])[0]).tolist() == x.tolist()


def test_stored_pcm_is_smaller_than_its_samples(spark):
    words = [" ".join(f"word{(k * j) % 91}" for j in range(200)) for k in range(60)]
    media = telephony.store(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"))
    stored = {r.doc_id: r for r in telephony.stored_pcm(media, "doc_id", "media", 16, 16000).collect()}
    for r in telephony.to_pcm(media).collect():
        codec, rate, block, samples = telephony.read_wave(next(m.media for m in [*media.where(f"doc_id = {r.doc_id}").collect()])) if r.doc_id < 3 else (None,) * 4
        assert codec is None or r.pcm == telephony.resample(telephony.expanded([(codec, rate, block, samples)])[0], rate, 16000).astype("<i2").tobytes()
        assert len(stored[r.doc_id].pcm) < 0.75 * len(r.pcm)


def test_telephony(spark, docs, empty):
    got = telephony.round_trip(docs).collect()
    assert len(got) == len(TEXTS)
    texts, used = dict((i, t) for i, t in TEXTS), set()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        codec = telephony.CODECS[zlib.crc32(padded) % 3]
        used.add(codec)
        blocks = b"".join(bytes(4) + padded[at : at + 192] for at in range(0, len(padded), 192))
        media = telephony.wave(blocks, "ima", 8000, 196) if codec == "ima" else telephony.wave(padded, codec)
        assert r.media_sha256 == hashlib.sha256(media).hexdigest() and r.media_bytes == len(media)
        if len(raw) < 5000:
            assert r.feature == plain_feature(plain_sound(padded, codec), 8000, 2000)
    assert used == set(telephony.CODECS)
    assert len({r.feature for r in got if r.doc_id == 7}) == 1
    assert telephony.round_trip(empty).count() == 0
    sound = telephony.to_pcm(telephony.store(docs, codec="alaw")).collect()
    assert all(len(r.pcm) % 768 == 0 and r.rate == 16000 for r in sound)
    nulls = spark.createDataFrame([(1, None), (None, telephony.wave(b"ab"))], "doc_id long, media binary")
    odd = {r.doc_id: r for r in telephony.describe(telephony.to_pcm(nulls)).collect()}
    assert odd[1].feature is None and odd[1].payload_sha256 is None and odd[None].payload_bytes == 2 and odd[None].feature.startswith("rate=16000;n=4;")


def test_codecs():
    assert telephony.MULAW[0xFF] == 0 and telephony.MULAW[0x00] == -32124 and telephony.MULAW[0x80] == 32124
    assert telephony.ALAW[0xD5] == 8 and telephony.ALAW[0x2A] == -32256 and telephony.ALAW[0xAA] == 32256
    blocks = np.random.default_rng(0).integers(0, 256, (20, 68)).astype(np.uint8)
    blocks[:, 2] %= 89
    out = telephony.adpcm(blocks)
    for block, row in zip(blocks, out):  # sample by sample
        value, index = int(np.int16(int(block[0]) | int(block[1]) << 8 if block[1] < 128 else (int(block[0]) | int(block[1]) << 8) - 65536)), int(block[2])
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                want.append(value)
        assert row.tolist() == want
    media = telephony.wave(blocks.tobytes(), "ima", 8000, 68)
    codec, rate, block, samples = telephony.read_wave(media)
    assert (codec, rate, block, samples) == ("ima", 8000, 68, blocks.tobytes())
    x = np.array([0, 10, -10, 7], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 5, 10, 0, -10, -2, 7, 7] and len(telephony.resample(x, 8000, 6000)) == 3


# 9


def plain_rules():
    """Known sentences as word tuples with their numbers, and (place, name, numbers) of the rules, those of most sentences first."""
    known, rules = {}, []
    for place, (name, wording) in enumerate(licenses.RULES.items()):
        parts = [tuple(re.findall("[a-z0-9]+", x.lower())) for x in re.split(r"(?<=[.!?;:])[ \t]+", wording)]
        parts = [x for x in parts if len(x) > 2]
        rules.append((-len(parts), -sum(len(" ".join(x)) for x in parts), place, name, [known.setdefault(x, len(known) + 1) for x in parts]))
    return known, [r[2:] for r in sorted(rules)]


def plain_scan(text, gap=2):
    """The scan on lists of words, from the rules' wording on."""
    known, rules = plain_rules()
    pieces = [tuple(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))) for line in (text or "").split("\n") for x in re.split(r"(?<=[.!?;:])[ \t]+", line)]
    hits, covered = {}, set()
    for k in range(len(pieces)):
        words = ()
        for j in range(k, len(pieces)):
            words += pieces[j]
            if not pieces[j] or len(words) > 80:
                break
            if words in known:
                hits[k] = known[words], j
        covered |= set(range(k + 1, hits[k][1] + 1)) if k in hits else set()
    ids = [hits[k][0] if k in hits else 0 for k in range(len(pieces)) if pieces[k] and k not in covered]
    rest, names = list(ids), []
    for place, name, wanted in rules:
        at = 0
        while at < len(rest):
            to = at
            for n, i in enumerate(wanted):
                skipped = 0
                while n and skipped < gap and to < len(rest) and rest[to] == 0:
                    to, skipped = to + 1, skipped + 1
                if to >= len(rest) or rest[to] != i:
                    break
                to += 1
            else:
                rest[at:to] = [0]
                names.append((place, name))
            at += 1
    return len(ids), sum(i > 0 for i in ids), " ".join(f"{k}:{i}" for k, i in enumerate(ids, 1) if i), ",".join(n for _, n in sorted(set(names)))


def licence_texts():
    """Every rule plain, wrapped at several widths behind several marks, and in paragraphs; rules behind and within each other; near misses."""
    texts, want = [], []
    for name, wording in licenses.RULES.items():
        parts = re.split(r"(?<=[.!?;:])[ \t]+", wording)
        for width, mark, end in ((10_000, "", "\n"), (72, "", "\n"), (60, "# ", "\n"), (76, " * ", "\n"), (70, "// ", "\r\n"), (24, "-- ", "\n")):
            lines = [x for part in (parts if width in (60, 24) else [wording]) for x in [*textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False), *([""] if width == 60 else [])]]
            texts.append(end.join(mark + x for x in ["Copyright (c) 2020 Some One", "", *lines, "", "import this"]))
            want.append(name)
    mit = licenses.RULES["mit"]
    for text, names in (
        (mit.upper(), "mit"), (mit.replace("conditions: ", "conditions: Strange one. "), "mit"), (mit.replace("conditions: ", "conditions: One. Two. Three. "), ""), ("THE SOFTWARE IS PROVIDED", ""),
        (mit + "\n\n" + licenses.RULES["bsd-3-clause"] + "\n\n" + mit, "mit,bsd-3-clause"), (licenses.RULES["bsd-2-clause"] + "\n\n" + licenses.RULES["bsd-3-clause"], "bsd-2-clause,bsd-3-clause"),
        ("an intro line\nReleased under the MIT License.\nand a line after", "mit-notice"), ("Released under\n\nthe MIT License.", ""), ("Released under the\nMIT License. Licensed under CC BY 4.0.", "mit-notice,cc-by-4.0-notice"),
        ("see the gnu general public license\nfor more details\nsee the gnu general public license for more details", ""), ("x Released under the MIT License.", ""),
    ):
        texts.append(text)
        want.append(names)
    return texts, want


def test_licenses(spark, docs, empty):
    texts, want = licence_texts()
    texts += [t for _, t in TEXTS] + ["\n" * 50 + "x" * 100_000, ".; :!?"]
    df = spark.createDataFrame([(k, t, "k") for k, t in enumerate(texts)], "doc_id long, text string, known string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(df).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain_scan(t), (k, t[:200])
    assert [got[k][3] for k in range(len(want))] == want
    assert licenses.scan(docs).count() == len(TEXTS) and licenses.scan(empty).count() == 0
    assert licenses.scan(docs, rules={}).where("n_known > 0 or licenses != ''").count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    assert {r[0]: r[1:] for r in db.execute(licenses.scan_sql()).fetchall()} == got


# 10


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, empty):
    random_ = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    rows = list(TEXTS)
    for base in range(6):
        text = [random_.choice(words) for _ in range(250)]
        for copy in range(8):
            if copy:
                text = list(text)
                text[random_.randrange(250)] = "ZZ"
            rows.append((100 + base * 10 + copy, " ".join(text)))
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, fp int, root string")
    prints = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 4):
            group[find(int(b))] = find(a)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        root = find(k)
        if i is not None:
            least[root] = i if least[root] is None else min(least[root], i)
    want = sorted(str((i, f"{int(prints[k]):016x}", least[find(k)])) for k, (i, _) in enumerate(rows))
    for blocks in (5, 6, 8):
        assert sorted(str(tuple(r)) for r in simhash.near_duplicates(df, blocks=blocks).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_joins_of_hot_keys_find_the_same(spark):
    rows = spark.createDataFrame([(k % 5 if k % 2 else 0, k) for k in range(200)] + [(None, 7), (9, 8)], "key long, v int")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("key != 9")
    plain = sorted(map(tuple, join_unique(rows, table, "key", "n").collect()))
    assert plain == sorted(map(tuple, join_unique(rows, table, "key", "n", hot=50).collect())) and len(plain) == 200


def test_blocks_follow_the_count():
    assert [simhash.blocks_for(n, 4) for n in (1, 50_000, 100_000, 10**8, 10**10, 10**11)] == [6, 6, 6, 7, 8, 9]


def test_near_links_of_a_hot_key_are_split(spark):
    random_ = np.random.default_rng(3)
    center = random_.integers(0, 1 << 63, dtype=np.int64)
    values = {int(center) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in random_.integers(0, 40, (150, 2))}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = simhash.near_links(df, split=16)
    roots = {r.root for r in components(found).collect()}
    assert len(roots) == 1 and components(found).count() == len(values)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100)] + [(200, 201), (201, 202), (200, 202), (300, 300), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(101)) and got[202] == 200 and 300 not in got
