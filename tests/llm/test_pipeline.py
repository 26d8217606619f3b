"""The pipeline on a small fixture: each stage's decisions against a plain version."""

import random
import re

import numpy as np
from test_ops import brute_fingerprint, brute_spans

import corpus_pipeline
from tidemill.llm import common, queries, similar


def test_stages(spark, tmp_path):
    good = [f"the river number {k} runs past hill {k * 7} and wood {k * 13} down to the old town of number {k}" for k in range(60)]
    rows = [(k, g, "en", f"s{k % 3}", len(g)) for k, g in enumerate(good)]
    rows += [(100 + k, good[k], "en", "s0", 1) for k in range(5)] + [(200 + k, "BUY NOW!! " * 30 + str(k), "en", "s1", 1) for k in range(20)]
    passage = "this passage of more than fifty bytes comes again in other texts. "
    rows += [(300, f"first {passage} one two three four", "en", "s1", 1), (301, f"other start {passage} five six seven", "en", None, 1), (302, "", "en", "s1", 0), (303, None, "en", "s2", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1 if k < 200 else 0) for k in [*range(60), *range(200, 220)]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{len(seen)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    by = [{r.doc_id: r for r in s} for s in seen]
    assert not any(200 <= i < 220 for i in by[0]) and set(range(60)) <= set(by[0])
    assert not any(100 <= i < 105 for i in by[1]) and {302} <= set(by[1]) and 303 not in by[1]
    prints = {brute_fingerprint(r.text) for r in seen[1]}
    assert len(prints) == len(seen[1])
    spans = {eval(x)[0]: eval(x) for x in brute_spans([(r.doc_id, r.text) for r in seen[1]])}
    assert by[2][300].text == by[1][300].text and passage not in by[2][301].text
    assert all(len(r.text.encode()) == spans[i][1] - spans[i][2] and r.n_chars == len(r.text) for i, r in by[2].items() if r.text.isascii())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(r.text) for r in seen[2])
    assert abs(sum(size(r.text) for r in seen[3]) - total) < 0.1 * total
    assert len(seen[4]) == len(seen[3]) and all(r.n_tokens >= 2 for r in seen[4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_stages_return_heap(spark):
    """Every stage after the first starts with the heap that the work before it took given back."""
    collectors = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in collectors if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "a few words", "en", "a", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        before = whole()
        assert stage(spark, docs, "").count() == 1
        assert whole() > before


def test_registered_queries(spark):
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(found)


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, rows of nulls, very long and repeated rows, and extra columns go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp int, block string"
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    odd = [(None,) * 8, (None,) * 8, (1, long, "en", "a", 1, "k", 1, "b"), (2, long, None, None, 1, "k", 1, "b"), (3, None, "en", "a", None, None, None, None), (3, "x", "en", "a", 1, "", 0, ""), (3, "x", "en", "a", 1, "", 0, "")]
    for name, rows in (("empty", []), ("odd", odd)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert bool(out) == bool(rows)
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, f"{tmp_path}/odd").count() == len(odd)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    # the empty texts (fingerprint 0), the long ones, and x: one document each
    assert sorted((r.doc_id, len(r.text or "")) for r in kept) == [(1, len(long)), (3, 0), (3, 1)]


def edited_rows():
    """Groups of edited copies, texts with a common line, texts of few words."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(200)]
        for copy in range(6):
            edited = list(text)
            for at in rng.sample(range(200), (0, 1, 2, 4, 5, 9)[copy]):
                edited[at] = f"new{base}x{copy}x{at}"
            rows.append((base * 10 + copy, " ".join(edited)))
    line = "one very common line of words that many of the texts do hold"
    rows += [(500 + k, f"{line} " + " ".join(rng.choice(words) for _ in range(12))) for k in range(40)]
    return rows + [(600, None), (601, ""), (602, "two Words"), (603, "two  words"), (None, "two words")]


def brute_components(sets):
    """Places of the sets' groups: equal sets, and those of Jaccard similarity 0.8."""
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


def shingle_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_ids(rows):
    """The smallest id of each row's group."""
    groups = brute_components([shingle_set(t) for _, t in rows])
    least = {}
    for g, (i, _) in zip(groups, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, least.get(g)) for g, (i, _) in zip(groups, rows)]


def test_near_duplicates_against_brute_force_jaccard(spark):
    """Edited copies whose fingerprints lie more than four bits apart are one group; less similar texts stay."""
    rows = edited_rows()
    want = {i for i, c in brute_ids(rows) if i == c}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)
    assert 12 < sum(i < 200 for i in want) < 72


def test_near_duplicates_in_small_places(spark, monkeypatch):
    """The same groups where every place is cut into parts and bands, sizes and ids repeat, and joins don't broadcast."""
    monkeypatch.setattr(similar, "TOGETHER", 3)
    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HOT", 2)
    rows = edited_rows() + [(3, "two words"), (3, "two words"), (17, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.near_duplicates(docs, limit=6000)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_ids(rows)))
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def test_searches_among_sets():
    """Whole sets: exactly the groups of similar ones. Sketches: no group is cut that is similar."""
    rng = np.random.default_rng(8)
    for trial in range(40):
        base = [rng.integers(-(1 << 62), 1 << 62, int(rng.integers(1, 120))) for _ in range(4)]
        each = [np.unique(np.concatenate((b[rng.random(len(b)) < rng.choice([0.85, 0.95, 1])], rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, 9)))))) for b in base for _ in range(6)]
        each = [x for x in each if len(x)]
        want = brute_components([set(x.tolist()) for x in each])
        counts = rng.integers(0, 4, similar.COUNTED).astype(np.uint16) if trial % 2 else np.zeros(similar.COUNTED, np.uint16)
        for links, exact in ((similar.linked(list(range(len(each))), each, 0.8, counts), True), (similar.allowed(np.arange(len(each)), np.array([len(x) for x in each]), np.array([np.frombuffer(similar.sketch(x), np.uint8) for x in each]), 0.8), False)):
            group = list(range(len(each)))
            for a, b in links:
                group = [group[a] if g == group[b] else g for g in group]
            for a in range(len(each)):
                for b in range(a):
                    if want[a] == want[b]:
                        assert group[a] == group[b]
                    elif exact:
                        assert group[a] != group[b]


def test_passages_leave_other_characters_whole(spark):
    """Replacement characters of a text stay; bytes of cut characters go, and never join to another character."""
    shared = "\u65e5this passage of more than fifty bytes comes again in other texts. \u65e5"
    other = "and here is a passage which is as long and comes again as well"
    rows = [
        (1, "as it was \ufffd here"),
        (2, "first " + shared + " one"),
        (3, "other \ufffd start " + shared + " end \ufffd"),
        # characters that share their first byte (\u65e5, \u6625), first two (\u65e5, \u65e6) or last (\u65e5, \u6625)
        (4, "caf\xe9 \u65e6" + shared[1:-1] + "\u6625 caf\xe9"),
        (5, "x" * 60 + "\u65e5 a"),
        (6, "x" * 60 + "\u65e6\u6625 b"),
        (7, "\u65e5" + other + "\u65e6 c"),
        (8, "\u6625" + other + "\u65e5 d"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.passage_stage(spark, docs, "").collect()}
    assert [got[i].text for i in (1, 2, 5, 7)] == [rows[i - 1][1] for i in (1, 2, 5, 7)]
    assert [got[i].text for i in (3, 4, 6, 8)] == ["other \ufffd starend \ufffd", "caf\xe9 \u65e6 caf\xe9", "\u6625 b", " d"]
    assert all(r.n_chars == len(r.text) for r in got.values())
