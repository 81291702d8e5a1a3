"""Exact, substring, n-gram and embedding dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from sparkinsight.llm import embedding_join, exact_dedup, ngram_join, substring_dedup
from sparkinsight.llm.graph import components


def texts(df):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("bits,block", [(64, 4096), (2, 16)])
def test_exact_dedup(odd_docs, bits, block):
    rows = texts(odd_docs)
    got = exact_dedup.dedup_report(odd_docs, block_bytes=block, hash_bits=bits).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(hashlib.sha256(t).hexdigest(), []).append(i)
    for r in got:
        ids = by[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    kept = exact_dedup.exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(t for _, t in texts(kept)) == sorted({t for _, t in rows})


def test_exact_dedup_empty(no_docs):
    assert exact_dedup.dedup_report(no_docs).count() == 0


def brute_substring(rows, size=13):
    first, words = {}, [(i, t.split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(odd_docs, small, no_docs):
    for df in (odd_docs, small):
        got = [tuple(r) for r in substring_dedup.substring_report(df, bucket_bytes=100_000).collect()]
        assert sorted(got, key=repr) == brute_substring(texts(df))
    assert substring_dedup.substring_report(no_docs).count() == 0


def test_removed_intervals_are_maximal(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"a b {shared} c"), (2, f"x {shared} y z {shared}")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substring_dedup.substring_dedup(df).collect()}
    assert rows[1]["removed"] == []
    assert [tuple(x) for x in rows[2]["removed"]] == [(1, 21), (23, 43)]
    assert bytes(rows[2]["kept"]) == b"x y z"


def brute_join(rows, size=5):
    sets = []
    for i, t in rows:
        w = t.lower().split()
        sets.append((i, {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a][1] & sets[b][1])
            if sets[a][1] and sets[b][1] and 100 * n >= 80 * len(sets[a][1] | sets[b][1]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), i if not s else least.get(root(k))) for k, (i, s) in enumerate(sets)), key=repr)


def near_copies(spark, copies=90, edits=(0, 14), words=120, seed=5):
    """Groups of edited copies of one text, so that many are close and many just not."""
    g = random.Random(seed)
    rows = []
    for k in range(4):
        base = [f"b{k}_{g.randrange(400)}" for _ in range(words)]
        for c in range(copies if k == 0 else 12):
            w = list(base)
            for _ in range(g.randint(*edits)):
                w[g.randrange(words)] = f"e{g.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    g.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_ngram_join(odd_docs, no_docs):
    got = [tuple(r) for r in ngram_join.ngram_join(odd_docs).collect()]
    assert sorted(got, key=repr) == brute_join(texts(odd_docs))
    assert ngram_join.ngram_join(no_docs).count() == 0


def test_ngram_join_blocks(spark):
    df = near_copies(spark)
    rows, comps = ngram_join.near_sets(df, block=16)
    want = {i: c for i, _, c in brute_join(texts(df))}
    comp = {r["node"]: r["component"] for r in comps.collect()}
    mine = {r["doc_id"]: comp.get(r["set_id"], r["set_id"]) for r in rows.collect()}
    least = {}
    for i in sorted(mine):
        least.setdefault(mine[i], i)
    assert {i: least[c] for i, c in mine.items()} == want
    assert 1 < len(set(want.values())) < len(want)


def test_needed_signatures_are_positive():
    s = ngram_join.Schemes(80)
    n = np.array([*range(1, 600), 1000, 3000, 20000])
    h = np.random.default_rng(0).integers(0, 1 << 63, n.sum(), dtype=np.uint64)
    of = np.repeat(np.arange(len(n)), n)
    for low in (False, True):
        assert (np.bincount(s.signatures(h, of, n, low)[1], minlength=len(n)) > s.spoiled(n, low)).all()


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 30) if i % 7] + [(50, 3), (60, 61), (61, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got[50] == got[7] == 1 and got[14] == 8 and got[61] == 60


def test_embedding_join(spark):
    g = np.random.default_rng(3)
    base = g.standard_normal((12, 16))
    rows = []
    for i in range(300):
        v = base[i % 12] + g.standard_normal(16) * (0.25 if i % 3 else 0.05)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(300, rows[0][1], 0), (300, rows[0][1], 0), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1),
             (304, rows[1][1], None), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [None] * 16, 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_join.embedding_join(df, length=40).collect()}
    ok = [(i, np.array(v), y) for i, v, y in rows[:301] if True] + [(305, np.array([1.0, 2.0]), 1), (306, np.array([2.0, 4.0]), 1)]
    link = {i: {j for j, w, z in ok if j != i and y == z and len(v) == len(w)
                and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= 0.93} for i, v, y in ok}
    comp = {i: i for i in link}
    for _ in link:
        comp = {i: min([comp[i], *(comp[j] for j in link[i])]) for i in link}
    for i in link:
        assert (got[i]["n_links"], got[i]["component_id"]) == (len(link[i]), comp[i])
    for i in (301, 302, 303, 304, 307):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0
    assert embedding_join.embedding_join(df.where("false")).count() == 0


CLASHING = ["_score", "_b", "_text_sha", "_sha", "_id", "_words", "_copy", "_size", "_source", "copies", "size", "name", "set_id", "own_0", "a.b"]


def test_stages_keep_columns_with_any_name(spark, labels):
    """Columns named like helpers go through every stage with their values."""
    from sparkinsight.llm import mixing, toxicity
    rows = [(i, f"w{i} alpha beta gamma delta w{i % 7} and some more words {i}", "s", *[f"{c} {i}" for c in CLASHING]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    docs = docs.select(*[f"`{c}`" for c in [*CLASHING[:7], "doc_id", "text", "source", *CLASHING[7:]]])
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    named = real.selectExpr("doc_id", "text", "source", *[f"concat('{c} ', cast(doc_id as string)) AS `{c}`" for c in CLASHING])
    for name, out in (("exact", exact_dedup.exact_dedup(docs)), ("near", ngram_join.keep_first(docs)), ("mix", mixing.mix(docs)),
                      ("toxic", toxicity.drop_toxic(named, labels, positives=30, negatives=60))):
        assert out.columns == (named if name == "toxic" else docs).columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c} {r['doc_id']}" for r in got for c in CLASHING), name
