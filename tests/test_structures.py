"""Operators with their own structures against plain versions on small fixtures."""

import collections
import hashlib
import random
import tempfile

import numpy as np
import pytest

from tessera.operators import calibration, content, index, lexicon, maintained, matching, retrieval, spatial, views
from tessera.sources import digests


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_patterns_held(spark):
    """Names of several words, inside words, overlapping and nested; words alone would not find them."""
    names = ["new york", "york new", "ork", "aa", "aaa", "é日", "x", "", None, "new york"]
    texts = [(1, "in new york new york"), (2, "aaaa"), (3, None), (4, ""), (5, "café日本"), (6, "newyork"), (6, "a" * 100_000), (None, "ork")]
    got = matching.held_patterns(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(n,) for n in names], "pattern string"))
    want = collections.Counter()
    for key, text in texts:
        for n in {n for n in names if n}:
            want[key, n] += sum((text or "").startswith(n, i) for i in range(len(text or "")))
    assert rows(got) == sorted(((k, n, c) for (k, n), c in want.items() if c), key=repr)
    assert matching.held_patterns(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([], "pattern string")).count() == 0


def test_patterns_in_shards(spark, monkeypatch):
    monkeypatch.setattr(matching, "SHARD_BYTES", 40)
    rng = random.Random(3)
    names = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    texts = [(k, "".join(rng.choice("abcd") for _ in range(30))) for k in range(50)]
    got = matching.held_patterns(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(n,) for n in names], "pattern string"))
    assert rows(got) == sorted(((k, n, c) for k, t in texts for n in names if (c := sum(t.startswith(n, i) for i in range(len(t))))), key=repr)


def test_lookup_of_files(spark):
    entries = spark.createDataFrame([(1, "old book", 1), (2, "book", 1), (3, "old book of two", 2), (4, "k", 1)], "id long, name string, page long")
    pages = spark.createDataFrame([(10, "old book", 1), (11, "my old book.pdf", 1), (12, "d b", 2), (13, "d b", 1), (14, "none", 7), (15, "book", 2)], "page_key long, file string, page long")
    assert rows(matching.looked_up(pages, entries)) == [(10, 1, "exact"), (11, 1, "contained"), (12, 3, "containing"), (13, 1, "containing"), (14, None, "none"), (15, 3, "containing")]


def test_rectangles_meet_once(spark):
    """A skewed fixture: most boxes in one corner and many in one point; views of all sizes, touching and outside ones."""
    rng = random.Random(5)
    box = lambda k, x, y, w, h: (k, float(x), float(y), float(x + w), float(y + h))
    boxes = [box(k, rng.random() ** 8 * 1000, rng.random() ** 8 * 1000, rng.random() * 30, rng.random() * 5) for k in range(1500)] + [box(2000 + k, 3, 3, 0, 0) for k in range(300)]
    boxes += [(5000, 5.0, 5.0, 4.0, 6.0), (5001, None, 1.0, 2.0, 2.0), box(5002, 0, 0, 1000, 1000)]
    views = [box(k, rng.random() * 1100 - 50, rng.random() * 1100 - 50, 10 ** rng.uniform(-1, 3), 10 ** rng.uniform(-1, 3)) for k in range(60)] + [box(99, 3, 3, 0, 0), box(98, -50, -50, 3000, 3000), box(97, 5000, 5000, 1, 1)]
    schema = "id long, x1 double, y1 double, x2 double, y2 double"
    got = spatial.meeting(spark.createDataFrame(boxes, schema), spark.createDataFrame(views, schema), limit=20).select("box.id", "view.id")
    ok = lambda r: None not in r and r[1] <= r[3] and r[2] <= r[4]
    want = sorted((b[0], v[0]) for b in boxes if ok(b) for v in views if b[1] <= v[3] and v[1] <= b[3] and b[2] <= v[4] and v[2] <= b[4])
    assert sorted(map(tuple, got.collect())) == want
    assert spatial.meeting(spark.createDataFrame([], schema), spark.createDataFrame(views, schema)).count() == 0


def test_index_and_phrases(spark):
    texts = [(k, " ".join("abc"[(k * 7 + j * j) % 3] + "x" * (j % 2) for j in range(k % 40))) for k in range(700)]
    texts += [(5000, "hot " * 3000 + "end"), (None, "lost words"), (5001, None), (5002, ""), (7, "again and again"), (5003, "Ärger ÄRGER")]
    docs = spark.createDataFrame([(i, t, "e", 1, "b") for i, t in texts], "doc_id long, text string, token string, place int, block string")
    held = index.positional(docs)
    want = collections.defaultdict(list)
    for i, t in texts:
        for place, w in enumerate((t or "").lower().split()):
            if i is not None:
                want[w, i].append(place)
    got = {}
    for r in held.collect():
        assert r.documents == len(r.doc_gaps) <= index.BLOCK
        doc = 0
        for g, places in zip(r.doc_gaps, r.place_gaps, strict=True):
            doc, at, out = doc + g, 0, []
            for p in places:
                at += p
                out.append(at)
            got[r.token, doc] = out
    assert got == {k: sorted(v) for k, v in want.items()}
    phrases = [(1, ["hot", "end"]), (2, ["a", "bx", "a"]), (3, ["again", "and", "again"]), (4, ["nowhere", "end"]), (5, []), (6, ["hot", "hot", "hot"]), (7, ["ärger"])]
    found = index.phrases_found(held, spark.createDataFrame(phrases, "phrase_id long, words array<string>")).collect()
    plain = set()
    for (w, i), places in want.items():
        for n, words in phrases:
            if words and words[0] == w:
                plain |= {(n, i, p) for p in places if all(p + k in want.get((x, i), ()) for k, x in enumerate(words))}
    assert sorted(map(tuple, found)) == sorted(plain) and len(plain) > 3000


def test_radix_tree(spark):
    rng = random.Random(2)
    names = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(120)} | {"a" * 300, "a" * 299 + "b", "é", "日本", "日"}
    tree = index.radix_tree(spark.createDataFrame([(n,) for n in [*names, None, "", *list(names)[:9]]], "name string").repartition(5)).collect()
    starts = collections.defaultdict(set)
    for n in names:
        for k in range(len(n) + 1):
            starts[n[:k]].add(n[k : k + 1])
    nodes = {p for p, following in starts.items() if len(following) > 1 or p in names or p == ""}
    assert {r.label for r in tree} == nodes and len(nodes) <= 2 * len(names)
    for r in tree:
        below = sorted(n for n in names if n.startswith(r.label))
        assert (r.is_name, r.names, r.first) == (r.label in names, len(below), below[:8])
        assert r.parent == (max((x for x in nodes if r.label.startswith(x) and x != r.label), key=len) if r.label else None)
    asked = ["", "a", "ab", "a" * 250, "zz", "日", None, "a"]
    got = {r.prefix: (r.names, r.first) for r in index.completions(index.radix_tree(spark.createDataFrame([(n,) for n in names], "name string")), spark.createDataFrame([(p,) for p in asked], "prefix string")).collect()}
    assert got == {p: (len(b), b[:8] or None) for p in set(asked) - {None} for b in [sorted(n for n in names if n.startswith(p))]}
    assert index.radix_tree(spark.createDataFrame([], "name string")).count() == 0


def test_chains_and_bookings_of_null_and_large_keys(spark):
    big = 2**60 + 1
    rows = [(None, 1, "a"), (None, 2, "b"), (big, 1, "c"), (big, 2, None), (big + 1, 1, "d")]
    got = {r.user: (r.entries, r.head) for r in content.chained(spark.createDataFrame(rows, "user long, k long, p string"), "user", ["k"], "p").collect()}
    head = "genesis"
    for p in ("c", ""):
        head = hashlib.sha256(f"{p}:{head}".encode()).hexdigest()
    assert set(got) == {None, big, big + 1} and got[big] == (2, head) and got[None][0] == 2
    named = content.chained(spark.createDataFrame([("x", 1, "a"), ("y", 1, "a")], "user string, k long, p string"), "user", ["k"], "p")
    assert {r.user for r in named.collect()} == {"x", "y"}
    bookings = [(None, 1, 1, 5), (None, 2, 2, -3), (big, 1, big, 4), (big, 2, big + 1, None), (big, 3, big + 2, -5)]
    done = views.purchases(spark.createDataFrame(bookings, "user_id long, ts long, event_id long, amount long")).collect()
    assert sorted((r.event_id, r.user_id, r.balance, r.accepted) for r in done) == sorted([(1, None, 5, True), (2, None, 2, True), (big, big, 4, True), (big + 1, big, 4, True), (big + 2, big, 4, False)], key=lambda r: r[0])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_corrections_of_words_of_any_length(spark):
    """Against every pair measured; runs of a hundred thousand letters among them."""
    rng = random.Random(4)
    terms = [("".join(rng.choice("abc") for _ in range(n)), rng.randrange(5)) for n in [*range(3, 30)] * 3]
    terms = list({t: (t, u) for t, u in terms}.values())

    def edited(t):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t) + 1)
            t = rng.choice([t[:k] + t[k + 1 :], t[:k] + "b" + t[k:], t[:k] + "c" + t[k + 1 :]])
        return t

    words = sorted({edited(t) for t, _ in terms for _ in range(3)})
    got = {r.word: (r.corrected, r.distance) for r in lexicon.corrections(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(terms, "term string, uses long")).collect()}
    want = {}
    for w in words:
        allowed = 0 if len(w) <= 3 else 1 if len(w) <= 5 else 2
        found = sorted((d, -u, t) for t, u in terms if allowed and abs(len(t) - len(w)) <= allowed and (d := distance(w, t)) <= allowed)
        if found:
            want[w] = (found[0][2], found[0][0])
    assert got == want and len(want) > 100
    run = "ab" * 1000
    asked = [(run,), (run + "xyz",), ("ab" * 50_000,), ("",), (None,)]
    long = lexicon.corrections(spark.createDataFrame(asked, "word string"), spark.createDataFrame([(run + "x", 1), ("a", 1)], "term string, uses long")).collect()
    assert {(len(r.word), r.distance) for r in long} == {(2000, 1), (2003, 2)}


def test_reading_order_takes_the_topmost_open_region(spark):
    page = [(1, 0, 5, []), (2, 0, 6, []), (3, 0, 7, []), (4, 0, 1, [1])]
    assert retrieval.in_order(page) == [1, 4, 2, 3]
    # a heading over two columns, the right one starting higher than the left one's end
    boxes = [(1, 1, 0.0, 0.0, 100.0, 10.0), (1, 2, 0.0, 20.0, 45.0, 60.0), (1, 3, 0.0, 61.0, 45.0, 90.0), (1, 4, 55.0, 20.0, 100.0, 90.0), (2, 1, 0.0, 0.0, 1.0, 1.0)]
    df = retrieval.precedence(spark.createDataFrame(boxes, "page long, region long, x1 double, y1 double, x2 double, y2 double"))
    assert {(r.page, r.region): r.before for r in df.collect()} == {(1, 1): [], (1, 2): [1], (1, 3): [1, 2], (1, 4): [1, 2, 3], (2, 1): []}
    rng = random.Random(1)
    many = [(k % 7, k, x := rng.random() * 90, y := rng.random() * 90, x + rng.random() * 20, y + rng.random() * 20) for k in range(140)]
    want = {}
    for p, r, x1, y1, x2, y2 in many:
        want[p, r] = sorted(o for q, o, u1, v1, u2, v2 in many if q == p and o != r and ((v2 <= y1 and x1 < u2 and u1 < x2) or (u2 <= x1 and y1 < v2 and v1 < y2)))
    got = retrieval.precedence(spark.createDataFrame(many, "page long, region long, x1 double, y1 double, x2 double, y2 double"))
    assert {(r.page, r.region): r.before for r in got.collect()} == want
    # pages that go over the ends of batches, and those without id
    regions = [(None if p == 3 else p, r, x1, y1, want[p, r]) for p, r, x1, y1, _, _ in many]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        order = retrieval.read_in_order(spark.createDataFrame(regions, "page long, region long, x1 double, y1 double, before array<long>")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p in {r[0] for r in regions}:
        got_page = [r.region for r in sorted(order, key=lambda r: r.position) if r.page == p]
        assert got_page == retrieval.in_order([r[1:] for r in regions if r[0] == p])
    assert retrieval.read_in_order(spark.createDataFrame([], "page long, region long, x1 double, y1 double, before array<long>")).count() == 0


def test_calibration_recovers_parameters(spark):
    rng = np.random.default_rng(3)
    b, a = np.linspace(-1.6, 1.6, 14), np.array([0.7, 1.6] * 7)
    theta = rng.standard_normal(900)
    p = 0.25 + 0.75 / (1 + np.exp(-1.702 * a * (theta[:, None] - b)))
    ok = rng.random(p.shape) < p
    rows = [(u, i, bool(ok[u, i])) for u in range(len(theta)) for i in range(len(b))] + [(None, 1, True), (1, None, True), (1, 1, None), (1, 99, True)]
    items = [(i, 1.2, 0.0, 0.25) for i in range(len(b))] + [(50, 1.2, 0.0, 0.25)]
    fitted, fits = calibration.calibrated_items(spark.createDataFrame(rows, "user_id long, item long, ok boolean"), spark.createDataFrame(items, "item long, a double, b double, c double"), rounds=12)
    got = {r.item: r for r in fitted.collect()}
    assert set(got) == {i for i, *_ in items} and (got[50].a, got[50].b) == (1.2, 0.0)
    assert all(y > x for x, y in zip(fits, fits[1:], strict=False)) and len(fits) > 3
    found = np.array([(got[i].a, got[i].b) for i in range(len(b))])
    assert np.abs(found[:, 1] - b).mean() < 0.2 and np.abs(found[:, 1] - b).max() < 0.6
    assert found[1::2, 0].mean() > 1.4 * found[::2, 0].mean()


def test_increments_are_one_run(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/view"
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(5), rng.choice([None, 1, 5]), t, f"v{t}") for t in range(200)]
    schema = "k long, n long, s long, t long, v string"
    view = maintained.View(spark, path, ["k"], ["n", "s"], {"v": "t"})
    assert view.totals() is None
    for j in range(5):
        part = spark.createDataFrame(rows[j * 40 : j * 40 + 40], schema)
        assert view.applied(part, f"p{j}")
        before = sorted(map(tuple, view.totals().collect()), key=repr)
        assert not view.applied(part, f"p{j}")  # it comes again
        assert sorted(map(tuple, view.totals().collect()), key=repr) == before
    want = {k: (sum(r[1] for r in rows if r[0] == k), sum(r[2] or 0 for r in rows if r[0] == k), max((r[3], r[4]) for r in rows if r[0] == k)[1]) for k in {r[0] for r in rows}}
    assert {r.k: (r.n, r.s, r.v) for r in view.totals().collect()} == want
    assert view.versions() == [4, 5]
    # an increment that fails before its commit leaves the version before
    with pytest.raises(Exception, match="boom"):
        view.applied(spark.createDataFrame(rows[:3], schema).selectExpr("k", "n", "s", "t", "raise_error('boom') v"), "bad")
    assert {r.k: (r.n, r.s, r.v) for r in view.totals().collect()} == want and view.applied(spark.createDataFrame([(9, 1, 1, 1, "x")], schema), "bad")


def test_block_digests_of_large_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/sparse.bin", "wb") as f:
        f.truncate(3 << 30)
    with open(f"{folder}/small.bin", "wb") as f:
        f.write(b"x" * 100_001)
    open(f"{folder}/empty.bin", "wb").close()
    block = 256 << 20
    told = digests.block_digests(spark, [folder], block)
    told = spark.createDataFrame(told.collect(), told.schema)
    files = {r.path.rsplit("/", 1)[1]: r for r in digests.file_digests(told).collect()}
    assert {k: (r.length, r.blocks) for k, r in files.items()} == {"sparse.bin": (3 << 30, 12), "small.bin": (100_001, 1)}
    own = hashlib.sha256(b"x" * 100_001).hexdigest()
    assert files["small.bin"].tree == hashlib.sha256(own.encode()).hexdigest()
    with open(f"{folder}/sparse.bin", "r+b") as f:
        f.seek(5 * block + 17)
        f.write(b"!")
    with open(f"{folder}/more.bin", "wb") as f:
        f.write(b"y" * block + b"z")
    found = digests.damaged_blocks(told, digests.block_digests(spark, [folder], block)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.block, r.state) for r in found} == {("sparse.bin", 5, "changed"), ("more.bin", 0, "new"), ("more.bin", 1, "new")}


def test_proximity_graph_finds_neighbours(spark):
    from tessera.operators import proximity

    rng = np.random.default_rng(0)
    n, d = 20_000, 32
    centres = rng.standard_normal((60, d))
    x = centres[rng.integers(0, 60, n)] + 0.6 * rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "id long, v array<double>").repartition(8).cache()
    graph, starts = proximity.neighbour_graph(df)
    degrees = [r["count"] for r in graph.groupBy("id").count().collect()]
    assert max(degrees) <= proximity.EDGES and len(degrees) == n
    q = np.arange(0, n, 100)
    got = {}
    for r in proximity.searched(graph, starts, df, df.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    true = np.argsort(-(x[q] @ x.T), axis=1)[:, :10]
    recall = np.mean([len(got[i] & set(t.tolist())) / 10 for i, t in zip(q.tolist(), true, strict=True)])
    assert recall >= 0.9, recall
    df.unpersist()
