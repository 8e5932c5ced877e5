import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import learning, psychometrics, quality, retrieval
from tessera.sources import sinks
from tessera.streaming import flows


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_streaks_over_gaps_and_ties(spark):
    d = lambda n: dt.date(2024, 1, n)
    days = spark.createDataFrame([(1, d(1)), (1, d(2)), (1, d(2)), (1, d(4)), (2, d(3)), (2, d(4)), (3, d(1))], "user_id long, day date")
    got = {r.user_id: (r.longest_streak, r.current_streak, r.days_active) for r in learning.streak_table(days).collect()}
    assert got == {1: (2, 1, 3), 2: (2, 2, 2), 3: (1, 0, 1)}


@pytest.mark.parametrize("given,right,verdict", [("abá", "aba", "correct"), ("nhe'engatu", "nheengatu", "correct"), ("casa", "caso", "almost"), ("", "x", "wrong"), ("sol", "mar", "wrong")])
def test_fuzzy_verdict(spark, given, right, verdict):
    df = spark.createDataFrame([(given, right)], "g string, r string")
    n = T.normal_answer
    df = df.select(n(F.col("g")).alias("g"), n(F.col("r")).alias("r"), n(F.col("g"), False).alias("bg"), n(F.col("r"), False).alias("br"))
    assert df.select(T.fuzzy_verdict(F.col("g"), F.col("r"), F.col("bg"), F.col("br")).alias("v")).first().v.verdict == verdict


def test_similarities(spark):
    assert one(spark, T.trigram_similarity(F.col("a"), F.col("b")), a="word", b="word") == 1.0
    assert one(spark, T.jaccard(T.ngrams(F.col("a"), 3), T.ngrams(F.col("b"), 3)), a="abcd", b="abce") == pytest.approx(1 / 3)
    assert one(spark, T.word_shingles(F.col("a")), a="A b c d") == ["a b c", "b c d"]
    assert one(spark, T.rolling_hash(F.col("a"), 100), a="ab") == (97 * 31 + 98) % 100


def test_sanity_and_chunks(spark):
    assert one(spark, T.sanity_reason(F.col("a")), a="short") == "too_short"
    assert one(spark, T.sanity_reason(F.col("a")), a="xxxxxxxx" + " good words here to read" * 4) == "repeated_run"
    assert one(spark, T.packed_chunks(T.sentences(F.col("a")), 12, 0), a="One two. Six. Seven ate. Nine.") == ["One two.", "Six.", "Seven ate.", "Nine."]
    assert " ".join(one(spark, T.packed_chunks(T.sentences(F.col("a")), 200, 5), a="One two. Six.")) == "One two. Six."


def test_error_rates_and_alignment(spark):
    assert one(spark, T.word_error_rate(F.col("a"), F.col("b")), a="a b c", b="a x c") == pytest.approx(1 / 3)
    assert one(spark, T.character_error_rate(F.col("a"), F.col("b")), a="abc", b="abd") == pytest.approx(1 / 3)
    assert T.align("kitten", "sitten")[2] == 5 * 2 - 1
    assert T.align("xxabcyy", "abc", local=True) == ("abc", "abc", 6)


def test_signatures(spark):
    token = one(spark, T.signed(F.col("a"), b"k"), a="user.1")
    assert one(spark, T.signature_valid(F.col("a"), b"k"), a=token)
    assert not one(spark, T.signature_valid(F.col("a"), b"k"), a=token[:-1] + ("0" if token[-1] != "0" else "1"))


def test_levels_round_trip(spark):
    levels = spark.range(1, 11).select("id", psychometrics.level_to_theta(F.col("id")).alias("t"))
    assert all(-2.51 <= r.t <= 2.51 for r in levels.collect())


def test_eap_of_all_right_and_all_wrong(spark):
    rows = [(u, 1.2, b / 2, 0.25, u == 1) for u in (1, 2) for b in range(-4, 5)]
    got = {r.user_id: r.theta for r in psychometrics.eap(spark.createDataFrame(rows, "user_id long, a double, b double, c double, ok boolean")).collect()}
    assert got[1] > 0.8 and got[2] < -0.8


def test_rotation_is_a_derangement_and_is_undone(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "d"], k) for k in range(9)], "xs array<string>, k int")
    for r in rows.select("xs", quality.rotated(F.col("xs"), F.col("k")).alias("ys"), *(quality.restored(F.lit(i), F.col("k"), F.lit(4)).alias(f"p{i}") for i in range(4))).collect():
        assert all(x != y for x, y in zip(r.xs, r.ys, strict=True))
        assert [r.xs[r[f"p{i}"]] for i in range(4)] == r.ys


def test_boxes_are_fused(spark):
    boxes = spark.createDataFrame([(1, "text", 0, 0, 10, 10, 0.9), (1, "text", 1, 0, 10, 10, 0.6), (1, "table", 50, 50, 60, 60, 0.5)], "page long, label string, x1 int, y1 int, x2 int, y2 int, layout_confidence double")
    got = sorted((r.label, r.boxes) for r in retrieval.fused_layout(boxes).collect())
    assert got == [("table", 1), ("text", 2)]


def test_bundle_reports_damage(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/bundle"
    sinks.write_bundle({"a": spark.range(5), "b": spark.range(3)}, path)
    assert sinks.damaged(spark, path, ["a", "b"]).count() == 0
    spark.range(9).write.mode("append").parquet(f"{path}/a")
    assert {r.state for r in sinks.damaged(spark, path, ["a", "b"]).collect()} == {"new"}


def test_upsert_with_new_column(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "c", 1)], "id long, v string, w int")
    assert sorted(map(tuple, sinks.upserted(old, new, ["id"]).collect()), key=str) == [(1, "a", None), (2, "c", 1)]


def streamed(spark, df, flow, mode="append"):
    path = tempfile.mkdtemp(prefix="spark-")
    df.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
    name = "out_" + path[-6:].replace("-", "_")
    q = flow(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/c").start()
    q.awaitTermination(120)
    return spark.table(name)


def test_replays_are_dropped(spark):
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("n1", ts), ("n1", ts), ("n2", ts)], "nonce string, ts timestamp")
    assert streamed(spark, df, flows.first_seen).count() == 2


def test_queue_is_drained_once(spark):
    message = '[{"user_id": 1, "word": " Abc ", "status": "correct"}, {"user_id": 1, "word": "x"}]'
    rows = flows.drained(spark.createDataFrame([(1, message), (2, "broken")], "msg_id long, message string"))
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    for _ in range(2):
        flows.write_once(rows, path, ["msg_id", "n"])
    got = spark.read.parquet(path).orderBy("n").collect()
    assert [(r.word, r.status, r.seconds) for r in got] == [("abc", "correct", 3.0), ("x", "wrong", 3.0)]


def test_session_state_is_carried(spark):
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", k, ts, True, 1.2, 0.0, 0.25) for k in range(3)], "session_id string, event_id long, ts timestamp, ok boolean, a double, b double, c double")
    r = streamed(spark, df, flows.sessions, "update").first()
    assert r.answers == 3 and r.theta > 0


def test_late_events_keep_a_reason(spark):
    now = dt.datetime(2024, 3, 1)
    df = spark.createDataFrame([(now - dt.timedelta(days=31), now), (now + dt.timedelta(minutes=11), now), (now, now)], "ts timestamp, received timestamp")
    assert [r.rejected for r in flows.accepted(df).collect()] == ["too_old", "in_future", None]


def test_stream_metrics_equal_batch(spark):
    rows = [(dt.datetime(2024, 1, 1, h), "view", float(h)) for h in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    got = streamed(spark, df, flows.metrics, "complete").select("window_start", "n", "mean").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, flows.metrics(df).select("window_start", "n", "mean").collect()))


def test_circuit_cools_down(spark):
    t = dt.datetime(2024, 1, 1)
    calls = [("a", t, False, False), ("a", t + dt.timedelta(seconds=1), False, False), ("b", t, False, True), ("b", t + dt.timedelta(seconds=1), True, False)]
    got = {r.target: r.cooldown_seconds for r in flows.circuit_states(spark.createDataFrame(calls, "target string, ts timestamp, ok boolean, fatal boolean")).collect()}
    assert got == {"a": 300, "b": 0}


def test_topological_levels_of_a_long_chain(spark):
    nodes = spark.range(12).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([*((k, k + 1) for k in range(8)), (0, 8), (10, 11), (11, 10)], "before long, node long")
    got = {r.node: r.level for r in retrieval.topological_levels(nodes, edges).collect()}
    assert got == {**{k: k for k in range(9)}, 9: 0}  # 10 and 11 need each other


def test_evidence_cascade_of_every_word(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(1, "the Quick fox"), (2, "lazy dogs sleeping")], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    spark.createDataFrame([(1, "fox quick\n sleeper"), (2, "none fox"), (3, None), (4, "")], "doc_id long, text string").write.parquet(path + "/documents.parquet")
    got = {tuple(r) for r in retrieval.QUERIES["evidence_cascade_terms"](spark, path).collect()}
    assert got == {("fox", 1, "exact", 1.0), ("quick", 1, "normalised", 0.95), ("sleeper", 2, "variant", 0.9), ("none", None, "none", 0.0)}


def test_session_ends_once_ability_is_known(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [("few", k, ts, True, 1.2, 0.0, 0.25) for k in range(5)] + [("sure", k, ts, k % 2 == 0, 4.0, 0.0, 0.0) for k in range(6)]
    df = spark.createDataFrame(rows, "session_id string, event_id long, ts timestamp, ok boolean, a double, b double, c double")
    got = {r.session_id: r.finished for r in streamed(spark, df, flows.sessions, "update").collect()}
    assert got == {"few": False, "sure": True}


def test_presence_stream_counts_users_once(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    beats = spark.createDataFrame([(t(5), 1, "x"), (t(20), 1, "x"), (t(30), 2, "x"), (t(4000), 3, "y")], "ts timestamp, user_id long, country string")
    got = {(r.at, r.country): r.online for r in streamed(spark, beats, flows.presence).collect()}
    assert got[t(180), "x"] == 2 and got[t(60), "x"] == 2
    assert got.items() <= {(r.at, r.country): r.online for r in flows.presence(beats).collect()}.items()


def test_additive_upsert(spark):
    old, new = spark.createDataFrame([(1, 5, "a"), (2, 7, "b")], "id long, n long, v string"), spark.createDataFrame([(2, 3, "c"), (3, 1, "d")], "id long, n long, v string")
    assert sorted(tuple(r) for r in sinks.upserted(old, new, ["id"], ["n"]).select("id", "n", "v").collect()) == [(1, 5, "a"), (2, 10, "c"), (3, 1, "d")]


def test_logs_and_exports(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for k in range(3):
        sinks.appended(spark.createDataFrame([(k, f"e{k}")], "ts long, v string"), f"{folder}/log")
    assert [r.v for r in sinks.last_entries(spark, f"{folder}/log", "ts long, v string", 2).collect()] == ["e2", "e1"]
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id long, v string")
    assert [r.line for r in sinks.markdown(df).collect()] == ["| 1 | a\\|b |", "| 2 |  |"]
    sinks.export(df, f"{folder}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 2


def test_reading_order_with_prerequisites_and_cycles():
    page = [(1, 0, 10, []), (2, 0, 0, [1]), (3, 50, 0, None), (4, 0, 90, [5]), (5, 0, 80, [4])]
    assert retrieval.in_order(page) == [3, 1, 2, 5, 4]


def test_ancestry_of_deep_chains_and_cycles(spark):
    nodes = spark.createDataFrame([(k,) for k in range(12)], "node long")
    edges = spark.createDataFrame([*((k, k + 1) for k in range(8)), (10, 11), (11, 10)], "before long, node long")
    got = {r.node: r.path for r in retrieval.ancestry(nodes, edges).collect()}
    assert got == {**{k: list(range(k, -1, -1)) for k in range(9)}, 9: [9]}


def test_first_kept_is_greedy(spark):
    from tessera.operators import curation

    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (1, 5), (7, 9)], "a long, b long")
    assert {r.b for r in curation.first_kept(pairs).collect()} == {2, 4, 5, 9}  # 3 is like 2 alone, which went; so 4 goes


def test_corrections_against_all_pairs(spark):
    import itertools
    import random

    from tessera.operators import lexicon

    rng = random.Random(3)
    terms = {"".join(rng.choices("abcde", k=rng.randrange(3, 9))) for _ in range(80)}
    words = {"".join(rng.choices("abcde", k=rng.randrange(2, 9))) for _ in range(150)} | {"", "a"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for w, t in itertools.product(words, terms):
        d, most = distance(w, t), 0 if len(w) <= 3 else 1 if len(w) <= 5 else 2
        if most and d <= most:
            want[w] = min(want.get(w, (9, "")), (d, t))
    got = lexicon.corrections(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t, 1) for t in terms], "term string, uses long"))
    assert {r.word: (r.distance, r.corrected) for r in got.collect()} == want


def test_search_takes_the_first_axis(spark):
    from tessera.operators import lexicon

    rows = [(1, "abaré", "priest", "aba"), (2, "xyz", "abaré house", "q"), (3, "uvw", "opq", "abaré"), (4, "none", "at all", "z")]
    catalog = spark.createDataFrame(rows, "id long, label string, other string, root string").selectExpr("*", "'k' kind", "'b' brand", "1 size")
    got = {r.id: (r.axis, r.score) for r in lexicon.search(catalog, "abaré", brand="B").collect()}
    assert got == {1: ("lexical", 1.0), 2: ("translation", 0.874), 3: ("root", 0.85)}
    assert lexicon.search(catalog, "abaré", size=2).count() == 0


def test_confidence_fusion_of_known_values(spark):
    v = one(spark, quality.composite(F.col("o"), F.lit(80.0), F.lit(60.0), F.lit(50.0), F.lit(100.0), F.col("u"), F.lit(100)), o=90.0, u=False)
    assert v.score == pytest.approx(0.45 * 90 + 0.15 * 80 + 0.2 * 60 + 0.1 * 50 + 0.1 * 100) and v.review == "approved"
    v = one(spark, quality.composite(F.col("o"), F.lit(80.0), F.lit(60.0), F.lit(50.0), F.lit(100.0), F.col("u"), F.lit(10)), o=40.0, u=True)
    assert v.score == pytest.approx(0.45 * 40 + 12 + 10) and v.review == "low_recognition; short; unchanged_noise"
    half = one(spark, quality.fused({"ocr": F.col("p"), "consensus": F.col("p")}), p=0.5)
    assert half == pytest.approx(0.5) and one(spark, quality.temperature_scaled(F.col("p"), 1.0), p=0.3) == pytest.approx(0.3)
    low, high = quality.wilson(F.col("k"), F.col("n"))
    assert one(spark, low, k=5, n=10) == pytest.approx(0.2366, abs=1e-3) and one(spark, high, k=0, n=0) == 0


def test_chains_and_purchases_carry_over_batches(spark):
    import hashlib

    from tessera.operators import content, views

    rows = [(1, k, f"p{k}") for k in range(40)] + [(2, 1, "q")]
    got = {r.user: (r.entries, r.head) for r in content.chained(spark.createDataFrame(rows, "user long, k long, p string").repartition(6), "user", ["k"], "p").collect()}
    head = "genesis"
    for k in range(40):
        head = hashlib.sha256(f"p{k}:{head}".encode()).hexdigest()
    assert got == {1: (40, head), 2: (1, hashlib.sha256(b"q:genesis").hexdigest())}
    bookings = [(1, dt.datetime(2024, 1, k), k, x) for k, x in ((1, 5), (2, -9), (3, 6), (4, -11), (5, -1))]
    done = views.purchases(spark.createDataFrame(bookings, "user_id long, ts timestamp, event_id long, amount long")).orderBy("event_id").collect()
    assert [(r.balance, r.accepted) for r in done] == [(5, True), (5, False), (11, True), (0, True), (0, False)]
