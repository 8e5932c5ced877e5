"""Personal data against plain patterns and counts, and edge rows."""

import collections
import hashlib
import math
import re
import time

import pytest
import regex
import xxhash
from conftest import DATA

from tessera.llm import sanitisation as S

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def good(kind, found):
    d = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return True


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if good(k, m[0])] for k, p in PLAIN.items()}


def low(text):
    return text.lower().replace("ς", "σ")


def words(text, shortest=3):
    return [w for w in WORD.findall(text) if len(w) >= shortest]


def hash2(a, b):
    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - 2**64 if h >= 2**63 else h


def actions(texts):
    """{term: action}, by dictionaries."""
    every = re.compile("|".join(("(?<![A-Za-z0-9._%+-])" if k == "email" else "(?<![0-9])" if k == "ip" else "") + f"(?:{p})" for k, p in PLAIN.items()))
    both, held, having = collections.defaultdict(collections.Counter), collections.Counter(), collections.Counter()
    for text in texts:
        parts, found, at = [], [], 0
        for m in every.finditer(text):
            parts.append(low(text[at : m.start()]))
            found.append(m[0])
            at = m.end()
        parts.append(low(text[at:]))
        having.update(set(words(" ".join(parts))))
        said = words(" ".join(parts), 1)
        signature = min((hash2(a, b) for a, b in zip(said, said[1:], strict=False)), default=" ".join(said))
        pairs, own = set(), set()
        for i, m in enumerate(found):
            kind = "email" if "@" in m else "phone" if m[0] == "+" else "ip" if "." in m else "card"
            if not good(kind, m):
                continue
            entity = (kind, m.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", m))
            left, right = parts[i], parts[i + 1]
            if len(left) > 100:
                left = regex.sub(r"^[\p{L}\p{M}\p{N}]+", "", left[-100:])
            if len(right) > 100:
                right = regex.sub(r"[\p{L}\p{M}\p{N}]+\Z", "", right[:100])
            own.add(entity)
            pairs |= {(entity, w) for w in words(left)[-5:] + words(right)[:5]}
        held.update(own)
        for p in pairs:
            both[p][signature] += 1
    out = {}
    for (entity, term), c in both.items():
        n = sum(c.values())
        left, told = -math.log2(n / having[term]), math.log2(n * len(texts) / (having[term] * held[entity]))
        if n * n >= 3 * sum(v * v for v in c.values()) and left <= 1 and told >= 3:
            out[term] = min(out.get(term, 9), left)
    return {t: "removed" if left <= 0.25 else "general" for t, left in out.items()}


def plain(rows):
    texts = [t or "" for _, t in rows]
    acts, out = actions(texts), []
    kinds = [*PLAIN, "general", "removed"]
    for (i, _), text in zip(rows, texts, strict=True):
        own = base(text)
        spans = sorted((s, kinds.index(k), e) for k, v in own.items() for s, e in v)
        line = lambda x: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in x)
        more = [(m.start(), kinds.index(acts[low(m[0])]), m.end()) for m in WORD.finditer(text) if low(m[0]) in acts and not any(s < m.end() and e > m.start() for s, _, e in spans)]
        out.append((i, *(len(own[k]) for k in PLAIN), hashlib.sha256(line(spans).encode()).hexdigest(), line(sorted(spans + more))))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def filler(k, n=40):
    return " ".join(hashlib.md5(f"{k}/{j}".encode()).hexdigest()[:7].translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(n))


@pytest.fixture(scope="module")
def planted():
    """Texts in which one word goes with an address, one mostly, one of a group of copies, one with everything."""
    rows = [(k, f"{filler(k)} Zorvian wrote from qq.{k % 2}@site.example.com today {filler(k + 1000)}") for k in range(12)]
    rows = [(k, t.replace("qq.1", "qq.0")) for k, t in rows]
    rows += [(100 + k, f"{filler(k + 2000)} Kelmar9 said +1 (555) 123-4567 {filler(k + 3000)}") for k in range(6)] + [(120 + k, f"{filler(k + 4000)} kelmar9 alone") for k in range(4)]
    rows += [(200 + k, f"{filler(9)} Copied name at 10.0.0.{7} in one text {filler(8)}") for k in range(30)]
    rows += [(300 + k, filler(k + 5000) + " today said") for k in range(300)]
    return rows


def test_planted_words(spark, planted):
    acts = actions([t for _, t in planted])
    assert acts["zorvian"] == "removed" and acts["kelmar9"] == "general" and "copied" not in acts and "today" not in acts and "said" not in acts
    got = S.personal_data(spark.createDataFrame(planted, "doc_id long, text string").repartition(4)).collect()
    assert ordered(got) == ordered(plain(planted))
    by = {r.doc_id: r for r in got}
    assert "removed:" in by[0].spans and "general:" in by[121].spans and "general" not in by[300].spans and "removed" not in by[200].spans
    clean = {r.doc_id: r.text for r in S.sanitised(spark.createDataFrame([(i, t, 1, "x") for i, t in planted], "doc_id long, text string, __text int, found string")).collect()}
    assert "Zorvian" not in clean[0] and " [email] today" in clean[0] and "[code] alone" in clean[121] and "[phone]" in clean[100] and clean[300] == dict(planted)[300]


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = S.op12_sanitisation(spark, DATA)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert ordered(got.collect()) == ordered(plain(rows))


EDGES = [
    "a@b.c%d@e.f x@y.z.", "a@b@c.d", "a@b.c.@d", ".@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.255", "001.02.3.0004 1.2.3.4@a.b", "1.2.3 4.5.6.7",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111111111", "0000 0000 0000 00", "12 3", "1  2", "1 - 2", "4111 1111 1111 1111 5", "+1 (555) 123-4567 8", "+1 23", "++1 234 567 8901-", "+1234567890123456",
    "+0 (((((1", "é日本 a@b.c 日本\U0001f600 1.2.3.4 \U0001f600+4 44 44 44 44 44", "x@y.z\n\nu@v.w\r\n", "\x01\x02 a@b.c \u0000", "ÄÖ a@b.c", "a@b.c" * 50, "", None, " ", "Σ a@b.c ς",
]


def test_edges(spark):
    rows = [(k if k % 5 else None, t) for k, t in enumerate(EDGES)] * 2
    df = spark.createDataFrame([(i, t, "e", 1, None) for i, t in rows], "doc_id long, text string, entity string, k int, term string")
    assert ordered(S.personal_data(df).collect()) == ordered(plain(rows))
    assert S.personal_data(df.limit(0)).count() == 0
    assert S.sanitised(df).columns == df.columns and S.sanitised(df).count() == len(rows)


def test_long_texts(spark):
    """Runs that patterns can start in anywhere, and thousands of entities, in texts of a megabyte."""
    began = time.time()
    rows = [(1, "a" * 1_000_000), (2, "1" * 1_000_000), (3, "1." * 500_000), (4, "+1" + " " * 1_000_000), (5, "a@" + "b." * 300_000 + "c"), (6, "some words a.b@c.de and 4111 1111 1111 1111, " * 10_000), (7, "1 " * 500_000)]
    assert ordered(S.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()) == ordered(plain_fast(rows))
    assert time.time() - began < 200


def plain_fast(rows):
    """plain() without the email pattern where a text has no @ (it would take minutes), and without words."""
    out = []
    for i, text in rows:
        own = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if good(k, m[0])] if k != "email" or "@" in text else [] for k, p in PLAIN.items() if not (k == "ip" and "." not in text)} | ({"ip": []} if "." not in text else {})
        spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, list(PLAIN).index(k), k, e) for k, v in own.items() for s, e in v))
        out.append((i, *(len(own[k]) for k in PLAIN), hashlib.sha256(spans.encode()).hexdigest(), spans))
    return out
