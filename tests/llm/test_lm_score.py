"""Language-model scoring: base figures by brute force, the mixer against a plain version, what order and class cost."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm_score


def test_scores(small, odd, none):
    for df, class_col in ((small, "lang"), (odd, None), (odd, "lang")):
        docs = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in df.select("doc_id", "text").collect()]
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
        c = collections.Counter(w for i, words in docs if not held(i) for w in words)
        n, v = sum(c.values()), len(c)
        want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 3)) for i, ws in docs), key=repr)
        found = lm_score.score(df, class_col=class_col, head=200, shard=5000).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in found), key=repr) == want
        assert all(r.score < 0 and r.bits_per_byte > 0 for r in found)
    assert lm_score.score(none).count() == 0


def test_no_training_text(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    found = lm_score.score(spark.createDataFrame([(held, "some words", "en")], "doc_id long, text string, lang string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in found] == [(3, 0, 0)] and found[0].score < 0


def test_scores_do_not_depend_on_what_is_broadcast(small):
    few, all_ = ({r.doc_id: r.score for r in lm_score.score(small, head=n).collect()} for n in (50, lm_score.HEAD))
    assert few == pytest.approx(all_, rel=1e-9)


def test_model_learns(spark):
    found = lm_score.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum() and held.bits_per_byte.mean() < 2.5


def test_order_counts(spark, small):
    """Shuffled texts are less probable than the texts; without a class nothing is paid for it."""
    r = random.Random(3)
    docs = [(x.doc_id, x.text, x.lang) for x in small.collect() if x.text and len(x.text.split()) > 50]
    mixed = [(10_000 + i, " ".join(r.sample(t.split(), len(t.split()))), lang) for i, t, lang in docs]
    held = [(i, t, lang) for i, t, lang in mixed if zlib.crc32(str(i).encode()) % 7 == 2]
    found = {x.doc_id: x.score for x in lm_score.score(spark.createDataFrame(docs + held, "doc_id long, text string, lang string")).collect()}
    pairs = [(found[i - 10_000], found[i]) for i, *_ in held]
    assert len(pairs) > 10 and sum(a > b for a, b in pairs) > 0.8 * len(pairs)


def test_the_class_is_paid_for(spark):
    df = spark.createDataFrame([(i, "w", "en" if i % 4 else None) for i in range(40)], "doc_id long, text string, lang string")
    rows = df.selectExpr("if(lang is null, 9, 1) class", "doc_id % 5 = 0 held_out")
    got = {r["_class"]: r.price for r in lm_score.prices(rows).collect()}
    assert got == pytest.approx({9: math.log10((8 + 1) / (32 + 2)), 1: math.log10((24 + 1) / (32 + 2))})


def test_tokens():
    texts = ["B a. b", None, "", " \t x,\n\x0b y! ", "é"]
    t = lm_score.tokens(pa.array([x or "" for x in texts]))
    got = sorted((int(i), t.words[int(w)].as_py(), int(a)) for w, i, a in zip(t.word, t.text, t.after))
    want = [(0, b"b", 0), (0, b"a.", 3), (0, b"b", 1), (0, b"\n", 3), (1, b"\n", 0), (2, b"\n", 0), (3, b"x,", 0), (3, b"y!", 2), (3, b"\n", 1), (4, "é".encode(), 0), (4, b"\n", 3)]
    assert got == sorted(want) and t.n_bytes.tolist() == [8, 1, 1, 7, 4]


# The mixer

WORDS = [b"the", b"then", b"of", b"off", b"a", b"\n", b"the", b"a" * 40, "ü".encode()]
KINDS = [7, 7, 7, 5, 6, 5, 11, 7, 7]
COUNTS = [50, 7, 30, 2, 11, 9, 3, 1, 2]


def plain_code(code):
    return {b: [(int(code.node[j, b]), int(code.bit[j, b])) for j in range(code.size[b])] for b in range(256)}


def plain_contexts(word, i, kind):
    text = word + b" "
    at = lambda k: text[max(0, i - k) : i].rjust(k, b"\0")
    return (at(1), min(i, 3), kind), (at(2), kind), (at(3), kind >> 2), (at(4),), (text[:i], kind >> 2)


def plain_odds(table, word, i, kind, node, less):
    """Log odds of the predictors and how often the whole word so far was seen; less: the bit to leave out."""
    found = []
    for k, c in enumerate(plain_contexts(word, i, kind)):
        n = list(table[k, c, node])
        if less is not None:
            n[less] = max(n[less] - 1, 0)
        found.append(math.log((n[1] + lm_score.PRIOR) / (n[0] + lm_score.PRIOR)))
    return found, sum(lm_score.GRADES < sum(n))


def plain_level(x):
    at = min(max((x + 12.0) / 1.0, 0), 24 - 0.001)
    return int(at), at - int(at)


def plain_model(code, steps):
    """Counts, weights and refining counts, bit by bit."""
    table, paths = collections.defaultdict(lambda: [0.0, 0.0]), plain_code(code)
    for word, kind, n in zip(WORDS, KINDS, COUNTS):
        for i, byte in enumerate(word + b" "):
            for node, bit in paths[byte]:
                for k, c in enumerate(plain_contexts(word, i, kind)):
                    table[k, c, node][bit] += n
    weights, refined = np.full((lm_score.GATES, 5), 0.3), lm_score.first_refined().astype(float) * 0
    for _ in range(steps):
        for j in range(max(map(len, paths.values()))):
            moves, totals = collections.defaultdict(lambda: np.zeros(5)), collections.Counter()
            for word, kind, n in zip(WORDS, KINDS, COUNTS):
                for i, byte in enumerate(word + b" "):
                    if j >= len(paths[byte]):
                        continue
                    node, bit = paths[byte][j]
                    odds, seen = plain_odds(table, word, i, kind, node, bit)
                    gate = (min(j, 7) * 2 + (i == 0)) * 6 + seen
                    x = float(np.dot(weights[gate], odds))
                    moves[gate] += (bit - 1 / (1 + math.exp(-x))) * n * np.array(odds)
                    totals[gate] += n
                    low, part = plain_level(x)
                    row = min(j, 7) * 256 + (word[i - 1] if i else 0)
                    refined[row, low, bit] += n * (1 - part)
                    refined[row, low + 1, bit] += n * part
            for g, move in moves.items():
                weights[g] += 0.02 * move / totals[g]
    return table, weights, refined + lm_score.first_refined()


def plain_score(model, code, word, kind):
    table, weights, refined = model
    total = 0.0
    for i, byte in enumerate(word + b" "):
        for j, (node, bit) in enumerate(plain_code(code)[byte]):
            odds, seen = plain_odds(table, word, i, kind, node, None)
            x = float(np.dot(weights[(min(j, 7) * 2 + (i == 0)) * 6 + seen], odds))
            low, part = plain_level(x)
            r = refined[min(j, 7) * 256 + (word[i - 1] if i else 0)]
            share = r[:, 1] / r.sum(axis=1)
            p = 0.5 / (1 + math.exp(-x)) + 0.5 * (share[low] * (1 - part) + share[low + 1] * part)
            total += math.log10(min(max(p if bit else 1 - p, 1e-7), 1))
    return total


def small_model(steps):
    code = lm_score.prefix_code(np.bincount(np.frombuffer(b" ".join(WORDS) + b" ", np.uint8), minlength=256))
    s = lm_score.spell(pa.array(WORDS, pa.binary()), np.array(KINDS))
    table, counts = np.zeros((lm_score.STARTS[-1], 2), np.float32), np.array(COUNTS)
    lm_score.count_contexts(table, s, code, counts)
    weights, refined = lm_score.first_weights(), np.zeros(lm_score.REFINED, np.float32)
    for _ in range(steps):
        lm_score.learn(table, s, code, counts, weights, refined, 0.02)
    return lm_score.frozen(table, weights, refined + lm_score.first_refined(), code)


def test_against_a_plain_mixer(monkeypatch):
    monkeypatch.setattr(lm_score, "BITS", (22,) * 5)  # so wide that no two contexts share a slot
    monkeypatch.setattr(lm_score, "STARTS", tuple(k << 22 for k in range(6)))
    m = small_model(5)
    model = plain_model(m.code, 5)
    assert m.weights == pytest.approx(model[1], abs=1e-3)
    words, kinds = [*WORDS, b"zqxj", b"thou", b"of"], [*KINDS, 7, 7, 4]
    got = lm_score.score_words(m, lm_score.spell(pa.array(words, pa.binary()), np.array(kinds)))
    assert got == pytest.approx([plain_score(model, m.code, w, k) for w, k in zip(words, kinds)], abs=1e-2)
    assert got[0] > got[2] > got[1] and got[9] < got[:9].min()


def test_probabilities_sum_to_one():
    """Over all bytes that a word can begin with, the next-byte distribution of a trained model is a distribution."""
    m = small_model(50)
    s = lm_score.spell(pa.array([bytes([b]) for b in range(256)], pa.binary()), np.full(256, 7))
    total, last = np.ones(len(s.data)), lm_score.before(s)
    for j, at, node, bit in s.bits(m.code):
        p = lm_score.predict(m, s, j, at, node, last)
        total[at] *= np.where(bit == 1, p, 1 - p)
    assert total[s.starts].sum() == pytest.approx(1, abs=1e-3) and total[s.starts].argmax() == ord("t")
