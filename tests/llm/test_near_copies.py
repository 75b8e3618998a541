"""The pipeline's near-dedup stage against all pairs."""

import corpus_pipeline
import numpy as np
import pytest
from conftest import SCHEMA, prose
from pyspark.sql import functions as F
from tessera.llm import common, near_copies


def plain_kept(docs, similarity=0.8):
    """The row of the least id of each component of distinct texts."""
    texts = sorted({t or "" for _, t in docs})
    words = [t.encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    at, ids = {t: find(i) for i, t in enumerate(texts)}, {}
    for i, t in docs:
        ids.setdefault(at[t or ""], []).append(i)
    return sorted((min((i for i in found if i is not None), default=None) for found in ids.values()), key=repr)


def kept(spark, df):
    return sorted((r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()), key=repr)


def test_pairs_at_the_threshold(spark, small):
    """Near copies with a few words changed, which four bits of four-word shingles do not find."""
    docs, r = [(x.doc_id, x.text) for x in small.select("doc_id", "text").collect()], np.random.default_rng(5)
    for k in range(60):
        words = prose(100 + k, 150).split()
        docs.append((1000 + 2 * k, " ".join(words)))
        for at in r.integers(0, 150, k % 5).tolist():
            words[at] = "changed"
        docs.append((1001 + 2 * k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert kept(spark, df) == plain_kept(docs)
    assert not {1, 177} <= set(kept(spark, small))


@pytest.mark.parametrize("hot", [2048, 4])
def test_large_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(near_copies, "HOT", hot)
    words = prose(9, 200).split()
    docs = [(i, " ".join(w if j != i else "x" for j, w in enumerate(words))) for i in range(30)] + [(99, prose(10, 90))]
    assert kept(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == [0, 99]


def test_rows_without_an_id_of_their_own(spark, odd, none):
    rows = [(None, prose(i, 80), "en", "a", i) for i in range(20, 26)] + [(7, prose(30, 80), "en", "a", 1), (7, prose(31, 80), "en", "a", 2), (7, prose(31, 80), "en", "a", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(r.text for r in found.collect()) == sorted({r[1] for r in rows}) and found.columns == df.columns
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert kept(spark, odd) == plain_kept(docs) and kept(spark, none) == []


def test_spread_join(spark, monkeypatch):
    """Hot, cold and missing keys give what a plain join gives, null keys nothing; a clash with n does no harm."""
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = [(i, None if i % 50 == 0 else 7 if i % 3 else i % 40) for i in range(600)]
    left = spark.createDataFrame(rows, "id long, root long")
    right = left.filter("root <> 5").groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    found = common.spread_join(left, right, "root", 600)
    assert found.columns == ["root", "id", "least"]
    want = left.join(right, "root").select("root", "id", "least")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert right.filter(F.col("n") * 10 > 600).count() == 1 and common.spread_join(left.limit(0), right.limit(0), "root", 0).count() == 0


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def differing(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def segments(words):
    bits = np.unpackbits(words.view(np.uint8), bitorder="little")[: near_copies.SEGMENTS * 2 * near_copies.HALF]
    return bits.reshape(near_copies.SEGMENTS, 2 * near_copies.HALF)


def test_candidates_are_simhash_links(spark, small):
    """The stage's candidates are the components of fingerprints that agree but for a bit in a segment and differ little."""
    texts = {r.text or "" for r in small.select("text").collect()} | {"", " ", "one", "One", "a b c d e f", "a b c d e g"}
    for k in range(20):
        words = prose(300 + k, 40 + 5 * k).split()
        texts |= {" ".join(words), " ".join(["x", *words[k % 4 + 1 :]]), " ".join(words[: 25 + 5 * k])}
    rows = spark.createDataFrame([(t,) for t in texts for _ in range(2)], "text string").select(near_copies.node_of().alias("node"), "text").repartition(3).cache()
    prints = {r.node: near_copies.wide_fingerprint(near_copies.shingles(r.text, 5)) for r in rows.collect()}
    cut = {n: segments(p) for n, p in prints.items()}
    near = lambda a, b: differing(prints[a][: near_copies.CHECK], prints[b][: near_copies.CHECK]) <= near_copies.RADIUS and (cut[a] != cut[b]).sum(axis=1).min() <= 1
    nodes = sorted(prints)
    want = components_of(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if near(a, b)])
    found = {r.node: r.root for r in near_copies.candidates(rows).collect()}
    linked = {r for n, r in want.items() if n != r}
    assert len(linked) > 10 and found == {n: r for n, r in want.items() if r in linked}


def plain_fingerprint(found):
    """Bit by bit, for a set of odd size, which has no ties."""
    low, out = (1 << 64) - 1, []
    for by in near_copies.BY.tolist():
        mixed = [h * by & low for h in found.tolist()]
        mixed = [(m ^ m >> 32) * 0x9E3779B97F4A7C15 & low for m in mixed]
        mixed = [m ^ m >> 32 for m in mixed]
        out.append(sum(1 << i for i in range(64) if 2 * sum(m >> i & 1 for m in mixed) > len(mixed)))
    return out


def test_fingerprints():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 64, n, np.uint64)) for n in (1, 3, 255, 301, 511)]
    assert [near_copies.wide_fingerprint(s).tolist() for s in sets] == [plain_fingerprint(s) for s in sets]
    assert not near_copies.wide_fingerprint(sets[0][:0]).any()
    # Sets of two, where half of the bits are ties, have nothing in common if their members have not.
    apart = [differing(*(near_copies.wide_fingerprint(np.unique(r.integers(0, 1 << 64, 2, np.uint64))) for _ in range(2))) for _ in range(50)]
    assert np.mean(apart) == pytest.approx(32 * near_copies.WORDS, rel=0.03)


def test_recall_at_the_threshold():
    """Sets with a similarity of just 0.8 meet and verify; of strangers none do."""
    r, found = np.random.default_rng(4), {True: 0, False: 0}
    for k in range(300):
        both, more = r.integers(0, 1 << 64, 8 * (1 + k % 40), np.uint64), r.integers(0, 1 << 64, 2 * (1 + k % 40), np.uint64)
        for alike in (True, False):
            prints = [near_copies.wide_fingerprint(np.unique(s)) for s in (both, np.concatenate((both, more)) if alike else more)]
            met = (segments(prints[0]) != segments(prints[1])).sum(axis=1).min() <= 1
            found[alike] += met and differing(prints[0][: near_copies.CHECK], prints[1][: near_copies.CHECK]) <= near_copies.RADIUS
    assert found == {True: 300, False: 0}


@pytest.mark.parametrize("copies,large", [(20, 1024), (900, 1024), (900, 40)])
def test_meet(monkeypatch, copies, large):
    """Groups up to SMALL, up to LARGE and above, pairs that differ in one bit of the segment, in two, and beyond the radius."""
    monkeypatch.setattr(near_copies, "LARGE", large)
    r = np.random.default_rng(copies)
    centres = r.integers(0, 1 << 64, (5, near_copies.CHECK), np.uint64)
    own = r.integers(0, 5, copies)
    flips = np.packbits(r.random((copies, 64 * near_copies.CHECK)) < 0.13, axis=1, bitorder="little").view(np.uint64)
    check, key = centres[own] ^ flips, np.sort(r.choice([0, 1, 3, 7, 64, 1 << 9, 1 << 9 | 1], copies).astype(np.int32))
    near = [(i, j) for i in range(copies) for j in range(i) if key[i] >> 9 == key[j] >> 9 and int(key[i] ^ key[j]).bit_count() <= 1 and differing(check[i], check[j]) <= near_copies.RADIUS]
    a, b = near_copies.meet(key, check)
    want = components_of(range(copies), near)
    assert near and components_of(range(copies), zip(a.tolist(), b.tolist())) == want
    if copies < 100:
        nodes, roots = near_copies.stars(a, b)
        assert dict(zip(nodes.tolist(), roots.tolist())) == {n: x for n, x in want.items() if n != x}
