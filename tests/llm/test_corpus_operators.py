"""SimHash, mixing, packing, WARC audit and the pipeline."""

import collections
import gzip
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tessera.llm import mixture, packing, registry, simhash, warc_merkle

DATA = "/root/testdata/sf0.001"


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    found = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def plain_components(fps, differ=4):
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= differ:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in fps}


def expected(found):
    """(id, fingerprint) to sorted (id, fingerprint, component)."""
    root = plain_components({f for _, f in found})
    least = {}
    for i, f in found:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f, least.get(root[f])) for i, f in found), key=repr)


def test_near_duplicates(small, odd, none):
    for df in (small, odd):
        got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
        assert got == expected([(r.doc_id, plain_fingerprint(r.text)) for r in df.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(none).count() == 0


def planted(seed, flips):
    r = np.random.default_rng(seed)
    out = set()
    for base in r.integers(0, 2**63, 4).tolist():
        for _ in range(50):
            x = base
            for b in r.integers(0, 64, flips).tolist():
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("small_groups,hot", [(32, 4096), (1, 4096), (1, 2), (8, 12)])
def test_every_way_to_link(spark, monkeypatch, small_groups, hot):
    monkeypatch.setattr(simhash, "SMALL", small_groups)
    monkeypatch.setattr(simhash, "HOT", hot)
    fps = planted(small_groups + hot, 3)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    links = simhash.join_index(simhash.indexed(spark.createDataFrame(signed, "fp long").repartition(3)))
    pairs = links.filter("not hot").select("a", "b")
    dense = links.filter("hot").selectExpr("a fp").distinct()
    assert (hot < 4096) == (dense.count() > 0)
    pairs = pairs.unionByName(simhash.join_dense(dense))
    assert all(0 < bin((r.a ^ r.b) % 2**64).count("1") <= 4 for r in pairs.collect())
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    want = collections.Counter(collections.Counter(plain_components(fps).values()).values())
    assert collections.Counter(collections.Counter(roots.get(f, f) for (f,) in signed).values()) == want


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_four_bits_share_a_key(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    keys = simhash.deletion_keys(np.array([a, b], np.uint64))
    assert set(keys[0].tolist()) & set(keys[1].tolist())
    assert len(simhash.near_bits()) == len(set(simhash.near_bits().tolist())) == 1 + 64 + 64 * 63 // 2


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a long, b long")
    assert rows(simhash.components(edges)) == sorted([(i, 0) for i in range(1, 61)] + [(101, 100)], key=repr)


# Mixing


def plain_targets(sizes, weights, total, epochs):
    full = set()
    while True:
        left = total - sum(epochs * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        if not open_:
            return [epochs * s for s in sizes]
        level = max(0, left) / sum(weights[i] for i in open_)
        more = {i for i in open_ if weights[i] * level > epochs * sizes[i]}
        if not more:
            return [epochs * s if i in full else weights[i] * level for i, s in enumerate(sizes)]
        full |= more


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 0, 7], [0, 0], [1000, 1, 1, 1]])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame([(i, s, float(1 + i % 3)) for i, s in enumerate(sizes)], "i int, size long, weight double")
    for share in (0.5, 1.5, 3.0):
        total = share * sum(sizes)
        got = [r.target for r in mixture.water_fill(df, total, 2.0).orderBy("i").collect()]
        assert got == pytest.approx(plain_targets(sizes, [1 + i % 3 for i in range(len(sizes))], total, 2.0))


def test_mix_takes_what_it_should(small, odd, none, monkeypatch):
    monkeypatch.setattr(mixture, "CELL_ROWS", 1)  # so that cells are narrowed down
    for df in (small, odd):
        found = mixture.mix(df).collect()
        assert len(found) == df.count() and all(0 <= r.whole * r.size + r.part <= 2 * r.size for r in found)
        by = collections.defaultdict(list)
        for r in found:
            by[r.source].append(r)
        for part in by.values():
            assert abs(sum(r.whole * r.size + r.part for r in part) - part[0].target) <= 1
    assert mixture.mix(none).count() == 0 and mixture.repeat(none).count() == 0
    assert rows(mixture.mix(small)) == rows(mixture.mix(small.repartition(7)))


@pytest.mark.parametrize("edges", [0, 1000])
def test_rows_that_share_an_id_are_taken_one_by_one(spark, monkeypatch, edges):
    monkeypatch.setattr(mixture, "CELL_ROWS", 7)
    monkeypatch.setattr(mixture, "BROADCAST_EDGES", edges)
    docs = [(None, "w x y", "a")] * 400 + [(5, "v w", "b")] * 300 + [(6, f"t{i} u", "c") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = mixture.mix(df).collect()
    for source in "abc":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.whole * r.size + r.part for r in own) - own[0].target) <= 1
    again = mixture.mix(df.repartition(5))
    assert rows(again) == rows(mixture.mix(df)) and len(found) == len(docs)


def test_repeat(small, odd):
    plan = {r.doc_id: r for r in mixture.mix(small).collect()}
    found = mixture.repeat(small)
    assert found.columns == small.columns
    texts = collections.defaultdict(list)
    for r in found.collect():
        texts[r.doc_id].append(r.text)
    original = {r.doc_id: r.text for r in small.collect()}
    for i, p in plan.items():
        words = original[i].split()
        assert sum(len(t.split()) for t in texts[i]) == p.whole * p.size + p.part
        assert all(t == original[i] or t.split() == words[: p.part] for t in texts[i])
    assert mixture.repeat(odd).columns == odd.columns


# Packing


@settings(deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_packing_loses_nothing(lengths):
    pieces = packing.pack_block(lengths)
    for d, n in enumerate(lengths):
        at = 0
        for _, start, length, *_ in sorted(p for p in pieces if p[0] == d):
            assert start == at and length > 0
            at += length
        assert at == n
    filled = collections.defaultdict(int)
    for _, _, length, sequence, offset in sorted(pieces, key=lambda p: p[3:]):
        assert offset == filled[sequence]
        filled[sequence] += length
    assert sorted(filled) == list(range(len(filled))) and all(n == 2048 or n & (n - 1) == 0 for n in filled.values())
    assert sum(n < 2048 for n in filled.values()) <= 11


def test_costs_are_balanced():
    r = np.random.default_rng(0)
    lengths = r.integers(20, 900, 400)
    to, used = packing.assign(lengths, 2048, int(lengths.sum() // 2048), 2048)
    cost = np.bincount(to[to >= 0], (lengths + lengths.astype(float) ** 2 / 2048)[to >= 0])
    plain = np.bincount(np.cumsum(lengths) // 2048, lengths + lengths.astype(float) ** 2 / 2048)[:-1]
    assert cost.std() / cost.mean() < plain.std() / plain.mean() and used.max() <= 2048


def test_tokens_are_the_librarys(small, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.encoder(packing.default_tokenizer())
    texts = ["", " ", "a  b\n\n c\td\r\n e", "x<|endoftext|>y", "  a b \x1c\x1d c", "it's 12 o'clock!!  \n", "é漢字 😀\n\nZ", " \n x", "a\n b \nc", "\x85 q"]
    for t in texts + [r.text for r in small.collect()]:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:40]
    found = packing.digest(packing.pack_documents(odd.filter("doc_id in (7, 8)"))).collect()
    for doc_id in (7, 8):
        ids = whole.encode(odd.filter(f"doc_id = {doc_id}").first().text, add_special_tokens=False).ids + [1]
        parts = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found if r.doc_id == doc_id)
        assert sum(p[1] for p in parts) == len(ids) == parts[0][3]
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c, _ in parts)
    assert packing.pack_documents(none).count() == 0
    assert packing.pack_documents(odd).select("sequence_id", "offset").distinct().count() == packing.pack_documents(odd).count()


# WARC


def pages(spark, n):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 5)) for i in range(n)], "page_id long, url string, html string").repartition(3)


def test_records_parse(spark):
    found = warc_merkle.lay_out(warc_merkle.warc_records(pages(spark, 20)), 6).orderBy("file", "seq").collect()
    for name in {r.file for r in found}:
        own = [r for r in found if r.file == name]
        parsed = warc_merkle.parse_warc(b"".join(bytes(r.record) for r in own))
        assert len(own) <= 6 and [(o, n) for o, n, *_ in parsed] == [(r.start, r.end - r.start) for r in own]
        assert [b.decode() for *_, b in parsed] == [f"<p>page {r.id}</p>" * (r.id % 5) for r in own]
    assert warc_merkle.parse_warc(None) == warc_merkle.parse_warc(b"x") == [] and len(warc_merkle.parse_warc(bytes(found[0].record)[:-1])) == 0


def test_audit_finds_just_the_damage(spark):
    store = warc_merkle.lay_out(warc_merkle.warc_records(pages(spark, 300)), 40)
    ours = warc_merkle.leaves(store).cache()
    hurt = ours.selectExpr("id", "file", "seq", "start", "end", "case when id in (5, 77) then 'bad' when id = 123 then null else digest end digest")
    gone = hurt.select("file").distinct().orderBy("file").first()[0]
    a, b = warc_merkle.tree(ours, 4, 3).cache(), warc_merkle.tree(hurt.filter(hurt.file != gone), 4, 3).cache()
    want = {(r.file, r.seq, "missing") for r in ours.collect() if r.file == gone} | {(r.file, r.seq, "missing" if r.id == 123 else "corrupt") for r in ours.collect() if r.id in (5, 77, 123) and r.file != gone}
    assert {(r.file, r.seq, r.status) for r in warc_merkle.audit(a, b, 4, 3).collect()} == want
    assert warc_merkle.audit(a, a, 4, 3).count() == 0
    assert {r.status for r in warc_merkle.audit(b, a, 4, 3).filter(f"file = '{gone}'").collect()} == {"extra"}
    roots = a.filter("level = 3")
    assert roots.count() == ours.select("file").distinct().count() and a.filter("level = 0").count() == 300


def test_offsets_and_archives_that_are_files(spark, tmp_path):
    store = warc_merkle.lay_out(warc_merkle.warc_records(pages(spark, 60)), 20)
    ours = warc_merkle.leaves(store).cache()
    moved = ours.withColumn("start", ours.start + 1000).withColumn("end", ours.end + 1000)
    trees = [warc_merkle.tree(x, 4, 3).cache() for x in (ours, moved, ours.filter("id <> 7"))]
    assert {r.status for r in warc_merkle.audit(trees[0], trees[1], 4, 3).collect()} == {"moved"}
    assert warc_merkle.audit(trees[0], trees[1], 4, 3).count() == 60
    where = ours.filter("id = 7").first()
    assert [(r.file, r.seq, r.status) for r in warc_merkle.audit(trees[0], trees[2], 4, 3).collect()] == [(where.file, where.seq, "missing")]
    assert [r.status for r in warc_merkle.audit(trees[2], trees[0], 4, 3).collect()] == ["extra"]
    whole = collections.defaultdict(bytes)
    for r in store.orderBy("file", "seq").collect():
        whole[r.file] += bytes(r.record)
    for i, (name, data) in enumerate(whole.items()):
        (tmp_path / f"{name}.warc").write_bytes(gzip.compress(data) if i % 2 else data)
    back = warc_merkle.read_warc(spark, str(tmp_path))
    key = lambda r: (r.file.rsplit("/", 1)[-1].removesuffix(".warc"), r.seq, r.start, r.end, bytes(r.record))
    assert sorted(map(key, back.collect())) == sorted(map(key, store.collect()))
    assert {r.body.decode() for r in back.collect()} == {f"<p>page {i}</p>" * (i % 5) for i in range(60)}


def test_audit_edges(spark):
    odd = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "h" * 100_000, None), (2, "", "", "")], "page_id long, url string, html string, record string")
    store = warc_merkle.lay_out(warc_merkle.warc_records(odd))
    assert warc_merkle.leaves(store).count() == 4 and warc_merkle.tree(warc_merkle.leaves(store.filter("1 = 0"))).count() == 0


# Queries and pipeline


def ordered(found):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found, df = duck.execute(registry.oracle_sql()[name]), registry.queries()[name](spark, DATA)
    assert df.columns == [c[0] for c in found.description] and ordered(tuple(r) for r in df.collect()) == ordered(found.fetchall())


def firsts_of_near_copies(docs):
    """The least id of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    sets, first = [(i, shingles(t)) for i, t in docs], {i: i for i, _ in docs}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if len(a & b) >= 0.8 * len(a | b) and first[i] != first[j]:
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = {k: new if v == old else v for k, v in first.items()}
    return set(first.values())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "pii", "mixing", "packing"]
    before, found = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, DATA).write.parquet(str(tmp_path / str(k)))
        found[name] = after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    texts = lambda n: [(r.doc_id, r.text) for r in found[n].collect()]
    clean = texts("toxicity")
    insult = ("idiot", "moron", "stupid", "scum")
    assert 0.85 * docs.count() < len(clean) < docs.count() and not any(sum(w in t.lower() for w in insult) > 2 for _, t in clean)
    alone = firsts_of_near_copies(clean)
    assert len(alone) < len(clean)
    assert {i for i, _ in texts("simhash near-dedup")} == alone and found["simhash near-dedup"].count() == len(alone)
    masked = dict(texts("pii"))
    assert set(masked) == alone and any("[EMAIL]" in t for t in masked.values())
    mixed = texts("mixing")
    assert {i for i, _ in mixed} <= alone and sum(len(t.split()) for _, t in mixed) == pytest.approx(1.5 * sum(len(t.split()) for t in masked.values()), abs=20)
    packed = found["packing"].collect()
    assert {r.doc_id for r in packed} == {i for i, _ in mixed}
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)


def test_pipeline_on_odd_documents(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns
        corpus_pipeline.pack(spark, docs, str(tmp_path)).count()
