"""Operators against plain versions written apart from them, and edge rows that the other tests don't have."""

import base64
import gzip
import hashlib
import tempfile

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, fingerprints, jaccard_join, mixing, sharding, suffix_dedup, token_counts, toxicity, warc
from tessera.llm.common import Scratch


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


# ---- fingerprints, byte by byte


def plain_chunks(data):
    """{(digest, length)} of normalised chunks: one rolling hash over the whole text, one byte at a time."""
    table = [xxhash.xxh32_intdigest(bytes([i])) for i in range(256)]
    h, start, out = 0, 0, set()
    for k, byte in enumerate(data):
        h = ((h << 1) + table[byte]) & 0xFFFFFFFF
        size = k + 1 - start
        mark = (h >> 25) & (0x7F if size < 64 else 0x1F)
        if (size >= 16 and mark == 0) or size == 256:
            out.add((xxhash.xxh3_64_intdigest(data[start : k + 1]) >> 16, size))
            start = k + 1
    if start < len(data):
        out.add((xxhash.xxh3_64_intdigest(data[start:]) >> 16, len(data) - start))
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    return sum(n for _, n in a & b) / min(sum(n for _, n in a), sum(n for _, n in b))


def plain_print(chunks):
    return base64.b64encode(b"".join(sorted((d << 16 | n).to_bytes(8, "big") for d, n in chunks))).decode()


def test_fingerprints_against_rolling_hash(spark, docs):
    got, ids = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, DATA).collect()}, sorted(docs)
    own = {i: plain_chunks(docs[i].encode()) for i in ids}
    for k, i in enumerate(ids):
        following = ids[(k + 1) % len(ids)]
        n = len(docs[i]) // 4
        new = (docs[i][: len(docs[i]) - n] + docs[following][:n]).encode()
        edited, r = plain_chunks(new), got[i]
        assert (r.fingerprint, r.edited_fingerprint, r.edited_sha256) == (plain_print(own[i]), plain_print(edited), hashlib.sha256(new).hexdigest())
        assert r.near_edited == pytest.approx(plain_likeness(own[i], edited)) and r.near_next == pytest.approx(plain_likeness(own[i], own[following]))


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_DOCS", 3)
    rows = [(i * i % 997 * 3, f"text number {i} " * (i % 9)) for i in range(200)] + [(None, "without id"), (5000, "x" * 300_000)]
    got = sorted(fingerprints.edit_comparison(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for k, r in enumerate(got):
        if len(texts[r.doc_id]) == 1 and len(texts[rows[(k + 1) % len(rows)][0]]) == 1:
            t, following = texts[r.doc_id][0], rows[(k + 1) % len(rows)][1]
            n = len(t) // 4
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()


# ---- toxicity


def test_noisy_or_of_a_plain_loop(spark, docs):
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.random(toxicity.FEATURES), -6.0)
    for t in list(docs.values())[:40]:
        safe = 1.0
        for s in toxicity.sentences(t):
            x = model.bias + sum(model.weights[f] for w in s for f in toxicity.features(w))
            safe *= 1 / (1 + np.exp(x))
        assert model.score(t) == pytest.approx(1 - safe, abs=1e-9)
        bag = toxicity.Bag.unpacked(toxicity.Bag.of(t).packed())
        assert np.allclose(bag.sums(model.weights) + model.bias, model.logits(t))


@pytest.mark.parametrize("toxic", [0, 1])
def test_slopes_are_the_losses_derivative(toxic):
    x = np.array([-2.0, 0.3, -0.7])
    loss = lambda x: -np.log(toxicity.noisy_or(x) if toxic else 1 - toxicity.noisy_or(x))
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert toxicity.slopes(x, toxic)[k] == pytest.approx((loss(x + step) - loss(x - step)) / 2e-6, abs=1e-6)
    bag = toxicity.Bag.of("one two. two three one. four")
    d = np.array([1.0, 2.0, 4.0])
    w = np.random.default_rng(0).random(toxicity.FEATURES)
    assert (bag.spread(d) * w[bag.features]).sum() == pytest.approx((d * bag.sums(w)).sum())


def test_held_out_documents_by_language(spark):
    """On labels that training never saw: hardly a clean document is called toxic, most toxic English ones are found."""
    folder = DATA.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = toxicity.op6_toxicity(spark, folder).join(labels, "doc_id").join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    clean = [r for r in rows if not r.toxic]
    found = [r.predicted for r in rows if r.toxic and r.lang == "en"]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean) and np.mean(found) >= 0.4


def test_sample_passes_over_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100)
    rows = [(i, "x" * 500 if i % 2 else "good words") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(40)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic")
    assert 0 < toxicity.sample(docs, labels).count() <= 10


def test_toxicity_of_ties_repeats_and_empty_tables(spark):
    rows = [(1, None), (1, "same"), (1, "same"), (None, "same"), (2, ""), (3, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("kept"))
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, 1)], "doc_id long, toxic int"))
    got = toxicity.scored(docs, model, "p").collect()
    assert len(got) == 6 and {r.score for r in got} == {"kept"} and len({r.p for r in got if r.text == "same"}) == 1
    assert toxicity.scored(docs.limit(0), model, "p").count() == 0 and toxicity.offending(docs.limit(0), model).count() == 0


# ---- nearest neighbours


def test_ann_recall_on_many_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 20_000)] + 0.6 * rng.normal(size=(20_000, 24))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, "vec_id", "embedding").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = total = 0
    for q in range(0, 20_000, 50):
        score = ann.cosines(x[q], x)
        assert all(s == score[v] for v, s in got[q].values())
        assert [(-s, v) for v, s in (got[q][k] for k in range(1, 6))] == sorted((-s, v) for v, s in got[q].values())
        score[q] = -9
        hit += len({v for v, _ in got[q].values()} & set(np.lexsort((np.arange(len(x)), -score))[:5].tolist()))
        total += 5
    assert hit / total >= 0.9


def test_ann_of_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (50, [1e-200, 1e-201]), (2, [0.0, 1e-200]), (3, [-1.0, 0.0]), (4, [1.0, 0.1])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    best = {r.query_id: (r.vec_id, r.score) for r in got.where("rank = 1").collect()}
    assert best[50][0] in (1, 4) and best[50][1] == pytest.approx(1) and best[0][1] == pytest.approx(1 / np.sqrt(1.01))
    assert not [r for r in got.collect() if np.isnan(r.score)]


def test_ann_of_many_ties(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(120)] + [(200 + i, [0.0, 1.0, float(i)]) for i in range(20)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), "vec_id", "embedding")
    assert [r.vec_id for r in got.where("query_id = 50").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


# ---- tokens


def test_truncation_from_stored_counts(spark):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=token_counts.default_path())
    texts = ["hello  world\n x▁y again and again", "é日本 12345\t  ﬁne words, many of them", "", "   ", "a" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for limit in (1, 5, 9):
        for r in token_counts.token_totals(df, token_counts.default_path(), limit).collect():
            t = texts[r.doc_id]
            fits = max(k for k in range(len(t) + 1) if len(sp.encode(t[:k])) <= limit)
            assert (r.n_tokens, r.chars_within_limit) == (len(sp.encode(t)), fits)
    assert token_counts.token_totals(df.limit(0), token_counts.default_path(), 5).count() == 0


def test_token_counts_of_a_very_long_unit(spark):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=token_counts.default_path())
    t = "abcdefghij" * 4000
    r = token_counts.token_totals(spark.createDataFrame([(1, t)], "doc_id long, text string"), token_counts.default_path(), 4096).first()
    assert r.n_tokens == len(sp.encode(t)) and r.over_limit


def test_bpe_words_beyond_what_a_range_remembers(spark, monkeypatch):
    path = bpe.default_path()
    rows = [(i, f"word{i} other{i % 7} some 日本{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {i: bpe.tokenizer(path).encode(t, add_special_tokens=False).ids for i, t in rows}
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    got = bpe.encode(docs, path)
    assert {r.doc_id: r.ids for r in got.collect()} == want
    back = {r.doc_id: r.text for r in bpe.decode(got, path).collect()}
    assert back == dict(rows)


def test_decoding_of_unknown_ids_and_broken_bytes(spark):
    path = bpe.default_path()
    tok = bpe.tokenizer(path)
    ids = tok.encode("日", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, ids[:1]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(rows, path).collect()}
    assert got == {1: tok.decode(ids[:1], skip_special_tokens=False), 2: "", 3: ""}
    with pytest.raises(Exception, match="no piece"):
        bpe.decode(spark.createDataFrame([(1, [10**8])], "doc_id long, ids array<int>"), path).collect()


# ---- names that clash


def test_shards_keep_every_column(spark):
    rows = [(i, "x" * i, i, f"p{i}", f"b{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, depth long, prefix string, bits string")
    path = tempfile.mkdtemp(prefix="spark-") + "/shards"
    sharding.write_shards(df, "doc_id", F.octet_length("text"), 100, path)
    back = spark.read.parquet(path)
    assert set(back.columns) == {*df.columns, "shard"} and sorted(map(tuple, back.select(*df.columns).collect())) == rows
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("shard", F.lit(1)), "doc_id", F.octet_length("text"), 100, path + "2")


CLASHES = "cutoff epochs_done supply budget domain copies score place bag weights __runs_ component_id n_links rest bucket".split()


def test_stages_keep_clashing_columns_nulls_and_empty_tables(spark):
    import corpus_pipeline

    base = spark.read.parquet(f"{DATA}/documents.parquet")
    edge = spark.createDataFrame([(None, None, None, None, None), (10_001, "", "en", "src1", 0), (10_002, "word " * 60_000, "xx", None, 300_000), (10_003, "short", None, "src2", 5), (10_003, "short", None, "src2", 5)], base.schema)
    table = base.unionByName(edge)
    for c in CLASHES:
        table = table.withColumn(c, F.lit(f"own {c}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, DATA)
        assert out.columns == table.columns, name
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES), name
        assert {r.doc_id for r in rows} <= {r.doc_id for r in table.select("doc_id").collect()}, name
        assert stage(spark, table.limit(0), DATA).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, table, DATA).count() == table.count()
    assert corpus_pipeline.STAGES[-1][1](spark, table.limit(0), DATA).count() == 0


def test_toxicity_and_mixing_stages_against_plain_versions(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = table.collect()
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, table, DATA).collect()}
    # the scorer has weights of single precision
    assert kept == {r.doc_id for r in rows if model.score(r.text or "") < 0.5}
    counted, leaves = mixing.mix(table, corpus_pipeline.MIX_SHARE, 1, mixing.SEED)
    leaf = {(r.domain, r.lang, r.source): r for r in leaves.collect()}
    want, by_leaf = set(), {}
    for r in counted.collect():
        by_leaf.setdefault((r.domain, r.lang, r.source), []).append(r)
    for name, own in by_leaf.items():
        b = leaf[name]
        done, left = (b.budget // b.supply if b.supply else 0), b.budget % b.supply if b.supply else 0
        run = 0
        for r in sorted(own, key=lambda r: hashlib.md5(f"{mixing.SEED}:{done}:{r.doc_id}".encode()).hexdigest()):
            run += r.n_tokens
            if done or (left > 0 and run <= left):
                want.add(r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, table, DATA).collect()} == want


# ---- suffix dedup


@pytest.mark.parametrize("hot", [2000, 15])
def test_suffix_dedup_of_hot_lines_and_runs(spark, monkeypatch, hot):
    from test_operators import removed_bytes

    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", hot)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        t = " ".join(f"w{rng.integers(0, 200)}" for _ in range(rng.integers(5, 60)))
        t = t[:20] + " All rights reserved. Copyright line 2024 (c) " + t[20:] if i % 3 == 0 else t
        t += "x" * int(rng.integers(40, 300)) if i % 5 == 0 else ""
        t += "-=" * int(rng.integers(20, 150)) + t[: int(rng.integers(0, 120))] if i % 7 == 0 else ""
        t += "abc" * int(rng.integers(20, 150)) if i % 11 == 0 else ""
        t += rows[int(rng.integers(0, len(rows)))][1] if i % 13 == 0 and rows else ""
        rows.append((i, t))
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == removed_bytes(rows)


@pytest.mark.parametrize("sort_bytes", [1_000_000, 300])
def test_suffix_dedup_moves_hot_strings_together(spark, monkeypatch, sort_bytes):
    """The more texts there are, the more anchors are hot: a start of one may not cost a whole string."""
    from test_operators import removed_bytes

    starts, moved = [], []

    class Counting(suffix_dedup.Scratch):
        def write(self, df, name):
            out = super().write(df, name)
            if name == "strings":
                for r in out.where("place is not null").select("starts", "spans", "sizes").collect():
                    starts.append(int(np.frombuffer(r.spans, np.int32).sum()))
                    moved.append(int(np.frombuffer(r.sizes, np.int32).sum()))
            return out

    monkeypatch.setattr(suffix_dedup, "Scratch", Counting)
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", 5)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort_bytes)
    rng = np.random.default_rng(8)
    noise = lambda n: rng.bytes(n).hex()
    line, ends = "the line that stands in every text, the end of which is followed by one of many", [noise(8) for _ in range(40)]
    rows = [(i, noise(10 + i % 7) + line + ends[i % 40] + noise(9) + "ab" * (i % 3 * 30)) for i in range(120)]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == removed_bytes(rows) and sum(r[1] > 0 for r in got.values()) == 119
    assert sum(starts) > 500 and sum(moved) < 25 * sum(starts)


def test_suffix_dedup_moves_no_strings_for_short_repeats(spark, monkeypatch):
    """Phrases shorter than the strings looked for are in many texts, as 16 bytes are by chance in much text."""
    from test_operators import removed_bytes

    moved = []

    class Counting(suffix_dedup.Scratch):
        def write(self, df, name):
            out = super().write(df, name)
            if name == "strings":
                moved.append(sum(len(r.starts) // 4 for r in out.where("place is not null").select("starts").collect()))
            return out

    monkeypatch.setattr(suffix_dedup, "Scratch", Counting)
    rng = np.random.default_rng(3)
    noise = lambda n: rng.bytes(n).hex()
    phrases = [noise(13) for _ in range(200)]
    rows = [(i, "".join(noise(int(rng.integers(20, 60))) + phrases[int(k)] for k in rng.integers(0, 200, 8))) for i in range(60)]
    digests = lambda: {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert digests() == removed_bytes(rows) and moved == [0]
    for i, (a, b) in enumerate([(0, 50), (3, 53), (40, 200), (100, 149)]):  # passages at the start, inside, at the end, one too short
        rows += [(100 + i, rows[i][1][a:b] + noise(30)), (200 + i, noise(30) + rows[i][1][a:b]), (300 + i, noise(30) + rows[i][1][a:b] + noise(30))]
    got = digests()
    assert got == removed_bytes(rows) and sum(r[1] > 0 for r in got.values()) == 9


def test_pipeline_stage_moves_no_strings_for_short_repeats(spark, monkeypatch):
    import corpus_pipeline

    moved = []

    class Counting(suffix_dedup.Scratch):
        def write(self, df, name):
            out = super().write(df, name)
            if name == "strings":
                moved.append(out.where("place is not null").count())
            return out

    monkeypatch.setattr(suffix_dedup, "Scratch", Counting)
    rng = np.random.default_rng(6)
    noise = lambda n: rng.bytes(n).hex()
    phrases = [noise(13) for _ in range(200)]
    rows = [(i, t := "".join(noise(40) + phrases[int(k)] for k in rng.integers(0, 200, 8)), "en", "web", len(t)) for i in range(60)]
    out = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), DATA)
    assert sorted(map(tuple, out.collect())) == rows and moved == [0]


@pytest.mark.parametrize("texts", [["one text alone, of more than fifty bytes, in which nothing comes twice"], ["abcdefgh" * 7, "ijklmnop" * 8], ["short", "q" * 50, "z" * 49]])
def test_suffix_dedup_where_no_anchor_repeats(spark, texts):
    from test_operators import removed_bytes

    rows = list(enumerate(texts))
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed_bytes(rows)


@pytest.mark.parametrize("stage", ["op8", "pipeline"])
def test_suffix_dedup_moves_no_keys_beside_ids(spark, monkeypatch, stage):
    """Ids tell rows apart if no two rows have one id; else a digest of id and text goes with each string and run."""
    import corpus_pipeline
    from test_operators import removed_bytes

    moved, buckets = {"strings": [], "removed": []}, set()

    class Counting(suffix_dedup.Scratch):
        def write(self, df, name):
            out = super().write(df, name)
            if name in moved:
                rows = out.select("keys", "ids").collect()
                moved[name].append((sum(len(r.keys) for r in rows), sum(len(r.ids) for r in rows)))
            if name == "removed":
                buckets.update(r.bucket for r in out.select("bucket").collect())
            return out

    monkeypatch.setattr(suffix_dedup, "Scratch", Counting)
    rng = np.random.default_rng(9)
    noise = lambda n: rng.bytes(n).hex()
    shared = [noise(40) for _ in range(10)]
    rows = [(i * 840, f"{noise(19)}{i % 10}{i // 10}{shared[i % 10]}{i // 10}{i % 10}{noise(14)}") for i in range(60)]
    if stage == "op8":
        got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        assert got == removed_bytes(rows) and sum(r[1] > 0 for r in got.values()) == 50
    else:
        frame = lambda rows: spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        cut = lambda rows: sorted((r.doc_id if r.doc_id is not None else 10**9, r.text) for r in corpus_pipeline.cut_repeats(spark, frame(rows), DATA).collect())
        assert [len(t) for _, t in cut(rows)] == [150] * 10 + [70] * 50
    assert [x[0] for x in (*moved["strings"], *moved["removed"])] == [0, 0] and moved["removed"][0][1] > 0 and len(buckets) == 4
    if stage == "pipeline":  # two rows of one id, two without: they keep their own places
        want = [(i, t.replace(shared[1], "") if i == 840 else t) for i, t in cut(rows)]
        more = [(0, noise(33) + "x" + shared[1]), (None, shared[2] + "y" + noise(7)), (None, noise(70) + "z" + shared[2])]
        assert cut(rows + more) == sorted(want + [(0, more[0][1]), (10**9, more[1][1][80:]), (10**9, more[2][1][:-80])])
        assert moved["strings"][-1][0] == moved["strings"][-1][1] > 0


def test_anchors_of_joined_texts(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 97 + int(rng.integers(1, 9)), int(rng.integers(0, 400))).astype(np.uint8)) for _ in range(60)] + [b"a" * 50, b"b" * 49, b""]
    want = []
    for k, t in enumerate(texts):
        h = suffix_dedup.anchor_hashes(t) & suffix_dedup.KEPT if len(t) >= 50 else []
        for a in range(len(t) - 49):
            at = a + int(np.argmin(h[a : a + 35]))
            if not want or want[-1][:2] != (k, at):
                want.append((k, at, a))
    for piece in (1 << 15, 64, 1):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        found = suffix_dedup.Anchored(texts)
        begin = found.begin[found.text]
        assert list(zip(found.text.tolist(), (found.place - begin).tolist(), (found.first - begin).tolist(), strict=True)) == want
    assert len(suffix_dedup.Anchored([b"b" * 49, b""]).place) == 0


# ---- jaccard


def test_blocks_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 10)
    rows = [(1, i, 50 if i < 200 else 50 + i % 30, bytes([i % 251]), i * 7919, 1) for i in range(400)] + [(2, 1000 + i, 5, b"z", i, 1) for i in range(5)]
    got = jaccard_join.blocked(spark.createDataFrame(rows, "comp long, rep long, n long, sig binary, k long, copies long")).collect()
    assert len(got) == len(rows) and {r.block for r in got if r.comp == 2} == {0}
    sizes = {}
    for r in got:
        sizes.setdefault((r.comp, r.block), []).append(r.n)
    spans = [(min(v), max(v)) for (c, _), v in sorted(sizes.items()) if c == 1]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) >= 30 and max(map(len, sizes.values())) <= 30


# ---- WARC


def test_warc_reader_takes_any_archive(spark):
    def record(kind, payload, version="1.0"):
        head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:x:{kind}>\r\nContent-Length: {len(payload)}\r\n\r\n"
        return head.encode() + payload + b"\r\n\r\n"

    tricky = "before WARC/1.1\r\nWARC-Type: none\r\n\r\n é".encode()
    path = tempfile.mkdtemp(prefix="spark-")
    with open(f"{path}/a.warc.gz", "wb") as f:  # a member a record
        for part in (record("warcinfo", b"software: x\r\n"), record("response", tricky), record("request", b"", "1.1")):
            f.write(gzip.compress(part))
    got = {r.type: r for r in warc.read_warc(spark, path).collect()}
    assert set(got) == {"warcinfo", "response", "request"} and bytes(got["response"].payload) == tricky and bytes(got["request"].payload) == b""
    assert got["response"].record_id == "<urn:x:response>" and got["response"].headers["content-length"] == str(len(tricky))
    with open(f"{path}/a.warc.gz", "ab") as f:
        f.write(gzip.compress(record("response", b"cut off here")[:-9]))
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, path).collect()


def test_archives_start_with_warcinfo_and_hold_long_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 4)
    rows = [(i, f"http://x/{i}", f"page {i} " * (i % 5)) for i in range(20)] + [(99, "u", "é" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    warc.write_archives(pages, path, Scratch(spark))
    back = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert set(back) == {i for i, *_ in rows} and back[99].payload_bytes == 1_000_000
    kinds = [[r.type for r in warc.read_warc(spark, f).collect()] for f in [x.file for x in warc.pieces_of(spark, path).select("file").distinct().collect()]]
    assert len(kinds) > 4 and all(k[0] == "warcinfo" and k.count("warcinfo") == 1 and len(k) <= 4 for k in kinds)
    none = tempfile.mkdtemp(prefix="spark-") + "/w"
    warc.write_archives(pages.limit(0), none, Scratch(spark))
    assert warc.read_archives(spark, none).count() == 0


def test_nearest_with_twin_ids_and_other_lengths(spark):
    """Rows of one id count once, by their least vector; vectors of each length are searched among themselves."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(0, 40)] + [(0, [1.0, 0.0, 0.0, 0.0]), (7, [9.0, 1.0, 0.0, 0.0]), (7, [9.0, 1.0, 0.0, 0.0])]
    rows += [(100 + i, rng.standard_normal(3).tolist()) for i in range(0, 12)] + [(1000, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (50, [0.0, 0.0, 0.0, 0.0]), (51, [])]
    got = ann.search(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, v int"), "vec_id", "embedding", 10).collect()
    least = {}
    for i, v in rows:
        if i is not None and any(v):
            least[i] = min(least.get(i, v), v)
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = {}
    for q in least:
        others = [(i, np.dot(least[q], v) / np.linalg.norm(least[q]) / np.linalg.norm(v)) for i, v in least.items() if i != q and len(v) == len(least[q])]
        if q % 10 == 0 and others:
            want[q] = {k + 1: x for k, x in enumerate(sorted(others, key=lambda x: (-x[1], x[0]))[:5])}
    assert {q: {k: i for k, (i, _) in ranks.items()} for q, ranks in found.items()} == {q: {k: i for k, (i, _) in ranks.items()} for q, ranks in want.items()}
    assert all(abs(s - want[q][k][1]) < 1e-12 for q, ranks in found.items() for k, (_, s) in ranks.items())
