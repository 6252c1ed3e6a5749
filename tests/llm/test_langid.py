import random
import zlib

import numpy as np

from lotlight.llm import langid

WORDS = {
    "en": "the and of in thing other water house going under three could would after where".split(),
    "fr": "le la les et des une maison être avec où très après leur jour été nous".split(),
    "de": "der die und das nicht haus schön über für wasser gehen straße auch nach wir".split(),
}


def make(seed=1, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]).capitalize() if rng.random() < 0.1 else rng.choice(WORDS[lang]) for _ in range(rng.randint(4, 60)))
        rows.append((i, text.replace(" und ", ", und\n"), lang))
    return rows + [(1000, None, "en"), (1001, "12 ++ 3!", "fr"), (1002, "—€ 5", None), (1003, "", None), (1004, "the house", None)]


def test_held_out_accuracy_and_defined_cases(spark):
    rows = make()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.label(df, model).collect()}
    truth = {d: k for d, _, k in rows}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    tested = [d for d in truth if d < 1000 and got[d].held_out]
    assert np.mean([got[d].lang_pred == truth[d] for d in tested]) > 0.97
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (1000, 1001, 1002, 1003))
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in langid.keep(df, model).collect()}
    assert not kept & {1000, 1001, 1002, 1003} and len(kept) > 200


def test_words_of_switched_text_are_labelled():
    rows = [(t, k) for _, t, k in make(2) if k and t and any(c.isalpha() for c in t)]
    model = langid.fit(rows)
    text = " ".join(WORDS["en"][:8] + WORDS["fr"][:8])
    import pyarrow as pa

    from lotlight.llm.words import split, text_bytes

    gamma = langid.label_words(model, split(*text_bytes(pa.array([text]))))
    found = [model.languages[k] for k in gamma.argmax(axis=1)]
    assert found.count("en") >= 6 and found[:7] == ["en"] * 7 and found[-6:] == ["fr"] * 6


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    sizes, n = np.array([1, 4, 3]), 2
    scores, steps = rng.normal(size=(8, n)).astype(np.float32), rng.normal(size=(n, n)).astype(np.float32)
    gamma, pairs = langid.forward_backward(scores, sizes, steps, pairs=True)
    import itertools

    want_pairs, at = np.zeros((n, n)), 0
    for size in sizes:
        total, marginal, joint = 0.0, np.zeros((size, n)), np.zeros((n, n))
        for path in itertools.product(range(n), repeat=int(size)):
            w = np.exp(sum(scores[at + i, y] for i, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                marginal[i, y] += w
            for a, b in zip(path, path[1:]):
                joint[a, b] += w
        assert np.allclose(gamma[at : at + size], marginal / total, atol=1e-4)
        want_pairs += joint / total
        at += size
    assert np.allclose(pairs, want_pairs, atol=1e-3)


def test_untrained_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert langid.label(df, model).first().lang_pred == "und"
    assert langid.label(df.filter("false"), model).count() == 0
