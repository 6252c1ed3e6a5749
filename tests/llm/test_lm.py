import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lotlight.llm import lm


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


ROWS = [(i, f"the cat {'sat' if i % 2 else 'ran'} on mat{i % 5} the {'x' * (i % 4)} End") for i in range(60)] + [(60, None), (61, ""), (62, "Zorblax unseen"), (63, "the " * 400), (64, "été ÉTÉ")]


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 1


def test_base_columns_match_brute_force(spark):
    df = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, p int").repartition(3)
    got = {r.doc_id: r for r in lm.score(df).collect()}
    counts = {}
    for d, t in ROWS:
        if not held(d):
            for w in words(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(ROWS)
    for d, t in ROWS:
        r, w = got[d], words(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(counts.get(x, 0) > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0
    # the model knows the order of words and how they are spelled
    test = [got[d] for d, _ in ROWS[:60] if held(d)]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_empty_and_untrained(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(d for d in range(100) if held(d))
    r = lm.score(spark.createDataFrame([(only, "abc")], "doc_id long, text string")).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score)


def test_spelling_is_a_distribution():
    data = pa.array(["abc", "abd", "", "abc", "zz", "été"])
    cells, word = lm.spell_cells(lm._word_table(data))
    assert np.bincount(word).tolist() == [4, 4, 1, 4, 3, 6]
    used, n = np.unique(cells, return_counts=True)
    model = lm.Spelling.sample(used, n, 1)
    assert np.allclose(model.table.sum(axis=1), 1, atol=1e-3) and (model.table > 0).all()
    assert set(model.row_of.tolist()) <= set(range(len(model.table)))


def test_seating_bounds():
    rng = np.random.default_rng(0)
    count = np.array([0, 1, 2, 50, 100_000])
    t = lm.seat(count, np.full(5, 0.5), 0.7, rng)
    assert t[0] == 0 and t[1] == 1 and (t <= count).all() and (t[1:] >= 1).all()
    assert lm.seat(np.array([500]), np.array([1e9]), 0.5, rng)[0] > 490


def test_predictive_probabilities_sum_to_one():
    """Over all words with an end, of a tiny alphabet by exhaustion, less what longer words hold."""
    table = lm.Spelling.sample(*np.unique(lm.spell_cells(lm._word_table(pa.array(["a", "b", "ab", ""])))[0], return_counts=True), 2)
    one = [bytes([c]) for c in range(256)]
    p = table.words(lm._word_table(pa.array(one, pa.binary())))
    end = table.words(lm._word_table(pa.array([""])))[0]
    assert 0 < p.sum() + end < 1


def test_packed_columns_round_trip():
    for v in ([], [0], [1, 255, 256, 2**40, 7], list(range(1000))):
        assert lm.unpack(lm.pack(np.array(v, np.int64))).tolist() == v
    assert lm.unpack_rising(lm.pack_rising(np.array([3, 3, 9, 2**33]))).tolist() == [3, 3, 9, 2**33]
    words = lm._word_table(pa.array(["b", "", "été", "a"]))
    back = lm.unpack_words(*[[x] for x in lm.pack_words(words, np.array([2, 1, 0]))])
    assert [back.data.tobytes()[a:b].decode() for a, b in zip(back.starts, back.ends)] == ["été", "", "b"]
    assert back.hashes().tolist() == words.hashes()[[2, 1, 0]].tolist()


def test_tables_follow_their_exact_distribution():
    """All partitions of four customers, weighed by table sizes, against draws."""
    d, strength, others, chance = 0.6, 1.5, 3.0, 0.3

    def partitions(n):
        if n == 0:
            yield ()
            return
        for p in partitions(n - 1):
            for i in range(len(p)):
                yield p[:i] + (p[i] + 1,) + p[i + 1 :]
            yield p + (1,)

    weight = [0.0] * 5
    for p in partitions(4):
        sizes = math.prod(math.prod(j - d for j in range(1, k)) for k in p)
        weight[len(p)] += sizes * math.prod((strength + d * (others + i)) * chance for i in range(len(p)))
    n = 40_000
    t = lm.tables_of(np.full(n, 4), np.full(n, chance), np.full(n, others), d, strength, np.random.default_rng(1))
    got = np.bincount(t, minlength=5) / n
    assert np.allclose(got, np.array(weight) / sum(weight), atol=0.012)
    few = lm.tables_of(np.array([0, 1, 500]), np.full(3, 0.1), np.zeros(3), d, strength, np.random.default_rng(1))
    assert few[0] == 0 and few[1] == 1 and 1 <= few[2] <= 500


def test_scores_match_brute_force(spark, monkeypatch):
    """With one table a dish and a fixed spelling, every probability is known."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lm, "_learn", lambda state, seed: fixed_model(state))
    keep = lm.tables_of

    def fixed_model(state):
        kept = state.select("customers").collect()
        n = sum(int(lm.unpack(r.customers).sum()) for r in kept)
        v = sum(int((lm.unpack(r.customers) > 0).sum()) for r in kept)
        return lm.Model(lm.Spelling(), n, v)

    import sys

    from pyspark import cloudpickle

    def once(count, *rest):
        return np.minimum(count, 1).astype(np.int64)

    cloudpickle.register_pickle_by_value(sys.modules[lm.__name__])
    monkeypatch.setattr(lm, "tables_of", once)
    try:
        df = spark.createDataFrame([(d, t) for d, t in ROWS], "doc_id long, text string").repartition(2)
        got = {r.doc_id: r.score for r in lm.score(df).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[lm.__name__])
        assert lm.tables_of is not keep
    pairs, after, known = {}, {}, {}
    for d, t in ROWS:
        if not held(d):
            for c, h in zip(["^", *words(t)], words(t)):
                pairs[c, h] = pairs.get((c, h), 0) + 1
                after.setdefault(c, []).append(h)
    for c, h in pairs:
        known[h] = known.get(h, 0) + 1
    customers, opened = sum(known.values()), len(known)
    spell = lambda h: (1 / lm.SYMBOLS) ** (1 + len((h or "").encode()))
    unseen = 1 - sum(map(spell, known))

    def chance(c, h):
        rest = (lm.WORD_S + lm.WORD_D * opened) / (lm.WORD_S + customers)
        p = (known[h] - lm.WORD_D) / (lm.WORD_S + customers) + rest * spell(h) if h in known else rest * unseen
        if c not in after:
            return p
        n, tables = pairs.get((c, h), 0), len(set(after[c]))
        return ((n - lm.CONTEXT_D) * (n > 0) + (lm.CONTEXT_S + lm.CONTEXT_D * tables) * p) / (lm.CONTEXT_S + len(after[c]))

    for d, t in ROWS:
        want = sum(math.log10(chance(c, h)) for c, h in zip(["^", *words(t)], words(t)))
        assert got[d] == pytest.approx(want, abs=1e-4 + 2e-5 * len(words(t)))


def test_long_words_are_contexts(spark):
    """Equal words, another order: only what follows each long word differs."""
    train = [d for d in range(400) if not held(d)][:200]
    a, b = [d for d in range(1000, 1100) if held(d)][:2]
    rows = [(d, "morning sunlight evening shadows" if d % 2 else "evening shadows morning sunlight") for d in train]
    rows += [(a, "morning sunlight evening shadows"), (b, "morning shadows evening sunlight")]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[a].base_score == pytest.approx(got[b].base_score)
    assert got[a].score > got[b].score + 1


def test_one_word_that_is_most_of_the_text(spark):
    """A context with most tokens is dealt over the buckets and counted whole."""
    train = [d for d in range(300) if not held(d)]
    rows = [(d, " ".join(f"the w{(d * 7 + i) % 90}" for i in range(40))) for d in train] + [(next(d for d in range(1000, 1100) if held(d)), "the w1 the w2 unknown the")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    some = [r for r in got if not r.held_out]
    assert sum(r.score for r in some) / sum(r.n_tokens for r in some) > -1.2  # about log10(90) / 2
