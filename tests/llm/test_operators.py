"""The numbered operators against brute force, the libraries, or SQL, on the smallest tables and on edge rows."""

import base64
import collections
import hashlib
import re
import tempfile
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, fingerprints, jaccard_join, mixing, registry, sharding, suffix_dedup, token_counts, toxicity, warc
from tessera.llm.common import Scratch

#: Null and empty texts, a null id, repeated rows, ties; with columns whose names clash with inner ones.
EDGE = [(1, None, "x", 1), (2, "", "y", 2), (None, "abc", "z", 3), (4, "A B c  D", "q", 4), (5, "a b c d", "q", 5), (6, "x " * 20000, "src1", 6), (6, "x " * 20000, "src1", 6), (7, "Zoë's naïve <|endoftext|> 日本\n\n ok", None, 7)]
SCHEMA = "doc_id long, text string, source string, n long, lang string, key string, h string, n_chars long"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, s, n, "en", "k", "h", len(t or "")) for i, t, s, n in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints_against_plain_edit(spark, docs):
    got, ids = by_id(fingerprints.op1_fingerprints(spark, DATA).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited")), sorted(docs)
    for k, i in enumerate(ids):
        t, following = docs[i], docs[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        new = t[: len(t) - q] + following[:q]
        print_ = lambda x: fingerprints.printed(fingerprints.chunk_set(x.encode(), 0, fingerprints.cuts(x.encode())))
        assert got[i][:4] == (len(t), sha(new), print_(t), print_(new))
    assert np.mean([v[4] for v in got.values()]) > 0.6


def test_fingerprints_survive_shift():
    text = " ".join(f"word{i * 7919 % 10007}" for i in range(3000)).encode()
    a, b = (fingerprints.chunk_set(t, 0, fingerprints.cuts(t)) for t in (text, b"some words before it " + text))
    assert fingerprints.likeness(a, b) > 0.97


def test_fingerprints_of_edge_rows(edge):
    got = fingerprints.edit_comparison(edge).collect()
    assert len(got) == len(EDGE) and fingerprints.edit_comparison(edge.limit(0)).count() == 0
    assert {r.fingerprint for r in got if not r.n_chars} == {""}


def test_bpe_against_library(spark, docs):
    tok = bpe.tokenizer(bpe.default_path())
    got = by_id(bpe.op2_bpe(spark, DATA))
    for i, t in docs.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_bpe_round_trip_of_edge_rows(edge):
    path = bpe.default_path()
    back = bpe.decode(bpe.encode(edge, path), path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, *_ in EDGE)
    assert bpe.encode_digests(edge.limit(0), path).count() == 0


def test_bpe_of_a_word_of_many_tokens(spark):
    path = bpe.default_path()
    rows = [(1, "\u1681" * 30000), (2, "a word " + "\u1681" * 21845), (3, "\u1681" * 21846 + " and more"), (4, "a word")]
    want = {i: bpe.tokenizer(path).encode(t, add_special_tokens=False).ids for i, t in rows}
    assert len(want[1]) > 65535
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path)
    assert {r.doc_id: r.ids for r in got.collect()} == want
    said = by_id(bpe.encode_digests(spark.createDataFrame(rows, "doc_id long, text string"), path))
    assert all(said[i][0] == len(want[i]) and said[i][2] == sha(t) for i, t in rows)


def test_ann_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = collections.defaultdict(dict)
    for r in ann.op3_ann(spark, DATA).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    hit = total = 0
    for k in np.flatnonzero(ids % ann.QUERY_STEP == 0):
        score = ann.cosines(x[k], x)
        score[k] = -9
        best = ids[np.lexsort((ids, -score))[: ann.NEAREST]].tolist()
        hit, total = hit + len(set(best) & {v for v, _ in got[ids[k]].values()}), total + ann.NEAREST
    assert hit / total >= 0.9


def test_ann_of_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, [1.0, float("nan")]), (2, None), (3, [2.0, 0.0]), (4, [0.0, 5.0]), (100, [1.0, 1.0]), (5, [1.0, None]), (6, [4.0, 0.0]), (6, [4.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(e, "vec_id", "embedding").where("query_id = 0").orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in got] == [(1, 3), (2, 6), (3, 100), (4, 4)]
    assert ann.search(e.limit(0), "vec_id", "embedding").count() == 0


def test_token_counts_against_library(spark, docs):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=token_counts.default_path())
    got = by_id(token_counts.op4_token_counts(spark, DATA))
    for i, t in docs.items():
        n = len(sp.encode(t))
        assert got[i] == (len(t.encode()), n, n > 4096)


def test_every_prefix_is_counted(edge):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=token_counts.default_path())
    own = token_counts.counter(token_counts.default_path())
    for t in ["hello  world\n x▁y", "<s> <0x0A> é日本 12345\t  ﬁ", "   ", ""]:
        assert own.prefixes(t).tolist() == [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
    counts = token_counts.prefix_counts(edge, token_counts.default_path()).where("doc_id = 4")
    r = counts.select(token_counts.tokens_of_prefix(F.col("counts"), F.lit(3)).alias("n"), token_counts.longest_within(F.col("counts"), 2).alias("fit")).first()
    assert r.n == len(sp.encode("A B")) and len(sp.encode("A B c  D"[: r.fit])) <= 2 < len(sp.encode("A B c  D"[: r.fit + 1]))


def test_shards_fit_their_limit(spark, edge):
    out = sharding.extendible_shards(edge, "doc_id", F.octet_length("text"), 1000).collect()
    size = collections.Counter()
    for r in out:
        size[r.shard] += r.n_bytes
    assert len(out) == len(EDGE) and all(r.shard_bytes == size[r.shard] for r in out)
    assert {r.depth for r in out if r.shard_bytes > 1000} == {sharding.MAX_DEPTH}  # one key, repeated: can't be split
    assert sharding.extendible_shards(edge.limit(0), "doc_id", F.octet_length("text"), 1000).count() == 0
    path = tempfile.mkdtemp(prefix="spark-") + "/shards"
    sharding.write_shards(edge.where("doc_id < 6"), "doc_id", F.octet_length("text"), 6, path)
    assert spark.read.parquet(path).groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).where("b > 8").count() == 0


def test_toxicity_learns_and_locates(spark):
    clean = ["the river runs to the sea", "we read a book in the garden", "bread and cheese for lunch"]
    texts = [". ".join(clean[(i + k) % 3] for k in range(4)) + (". you are a grumblefoo person" if i % 3 == 0 else "") for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = [r for r in toxicity.scored(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held)
    found = toxicity.offending(docs.where("doc_id < 9"), model).collect()
    assert {r.doc_id for r in found} == {0, 3, 6} and all("grumblefoo" in r.text for r in found)


def test_toxicity_of_edge_rows(spark, edge):
    model = toxicity.fit(edge, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.scored(edge, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if not r.text)


def linked_components(rows):
    parent, sets, having, seen = {}, {}, collections.defaultdict(list), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        parent[i] = i
        for g in sets[i]:
            having[g].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in having[g] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_components_against_brute_force(spark, docs):
    assert by_id(jaccard_join.op7_jaccard_join(spark, DATA)) == linked_components(docs.items())


def test_jaccard_tiles_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(w if (k * 31 + i * 17) % 151 else f"x{i}" for k, w in enumerate(base[: 100 + i % 21]))) for i in range(60)]
    got = by_id(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == linked_components(rows)


def link_numbers(rows):
    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] for i, t in rows}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for i, w in words.items()}
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    return {i: sum(linked(s, t) for j, t in sets.items() if j != i) for i, s in sets.items()}


def test_jaccard_links_against_brute_force(spark, docs):
    got = by_id(jaccard_join.op7_jaccard_links(spark, DATA))
    assert {i: v[2] for i, v in got.items()} == link_numbers(docs.items()) and {i: v[:2] for i, v in got.items()} == linked_components(docs.items())


def test_jaccard_links_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(w if (k * 31 + i // 2 * 17) % 151 else f"x{i // 2}" for k, w in enumerate(base[: 100 + i // 2 % 21]))) for i in range(80)]
    got = {i: v[2] for i, v in by_id(jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))).items()}
    assert got == link_numbers(rows) and min(got.values()) > 0 and len(set(got.values())) > 1


def test_jaccard_overlaps_by_products(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(40)]
    x, y = np.triu_indices(40, 1)
    got = jaccard_join.overlaps(sets, x, y)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)]


def test_jaccard_of_edge_rows(edge):
    got = sorted(map(str, jaccard_join.jaccard_components(edge).collect()))
    assert "Row(doc_id=5, n_shingles=1, component_id=4)" in got and "Row(doc_id=1, n_shingles=0, component_id=1)" in got and len(got) == len(EDGE)
    assert jaccard_join.jaccard_components(edge.limit(0)).count() == 0


def removed_bytes(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark, docs):
    assert by_id(suffix_dedup.op8_suffix_dedup(spark, DATA)) == removed_bytes(docs.items())


@pytest.mark.parametrize("seed", range(12))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 3 + seed % 3, int(rng.integers(1, 500)))
    a = np.tile(a[: max(1, len(a) // 5)], 5) if seed % 2 else a
    order = suffix_dedup.suffix_order(a, 1)
    prefixes = [bytes(a.tolist())[k : k + 50] for k in order]
    assert sorted(order.tolist()) == list(range(len(a))) and prefixes == sorted(prefixes)


def test_suffix_dedup_of_edge_rows(edge):
    got = [tuple(r) for r in suffix_dedup.removal_digests(edge).collect()]
    assert len(got) == len(EDGE) and all(r[2] == 0 for r in got)  # rows of one id never remove each other
    assert suffix_dedup.deduplicated(edge).columns == edge.columns
    assert suffix_dedup.removal_digests(edge.limit(0)).count() == 0


def test_warc_segments_round_trip(spark):
    pages = spark.createDataFrame([(1, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 50, 1), (2, "u\r\nx: y", None, 2), (None, None, "", 3), (3, "u", "é日本" * 99, 4), (4, "u", "é日本" * 99, 4), (3, "u", "é日本" * 99, 4)], "page_id long, url string, html string, row int")
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    archive = warc.write_archives(pages, path, Scratch(spark), most=37)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read_archives(spark, path, archive).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    a, b, n = "a\r\n\r\nWARC/1.1\r\n\r\n" * 50, "é日本" * 99, 792
    assert got == sorted([(1, 850, digest(a), "response", 0), (2, 0, digest(""), "response", 0), (0, 0, digest(""), "revisit", 2), (3, n, digest(b), "response", 0), (3, n, digest(b), "revisit", 3), (4, n, digest(b), "revisit", 3)])


def test_mixing_of_edge_rows(spark, edge):
    counted, leaves = mixing.mix(edge, 60, 2, 1)
    assert counted.count() == len(EDGE)
    budget = {(r.domain, r.lang, r.source): r.budget for r in leaves.collect()}
    assert sum(budget.values()) <= counted.agg(F.sum("n_tokens")).first()[0] * 60 // 100
    assert mixing.mix(edge.limit(0), 60, 2, 1)[0].count() == 0
    assert set(mixing.select_documents(edge, 80).columns) == set(edge.columns)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, table, DATA).collect()}
    assert kept == {i for i, (_, c) in linked_components(docs.items()).items() if c == i}
    cut = corpus_pipeline.cut_repeats(spark, table, DATA).collect()
    assert all(r.n_chars == len(r.text) for r in cut) and all(set(r.text) <= set(docs[r.doc_id]) for r in cut)
    assert corpus_pipeline.run(spark, DATA).count() > 0
