import random
import re

import numpy as np

from lotlight.llm import quality

TEXTS = ["a b c\na b c\n\n \nx", "", None, "# * $ % & | < > é\u00e9", "r e p e a t r e p " * 30, "one two three one two three", "\n\n", "aa aa aa aa", "Tab\tsep\x0bword\r\nTab\tsep\x0bword", "z" * 3000]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in quality.NAMES) for r in quality.statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def rows(seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(900):
        lang, source = rng.choice([("en", "hot"), ("en", "hot"), ("fr", "s1"), ("fr", "tiny") if rng.random() < 0.02 else ("en", "s2")])
        n = int(np.exp(rng.gauss(5.3, 0.6))) + 60
        out.append((i, "\n".join(" ".join("x" * rng.randint(2, 9) + str(rng.random())[2:5] for _ in range(12)) for _ in range(n // 12)), lang, source))
    bad = [(2000 + i, " ".join("#" * 8 + "|" * 8 for _ in range(40)) + " " + " ".join(f"##{j}||" for j in range(300)), "en", "hot") for i in range(20)]
    return out + bad + [(3000, None, None, None), (3001, "w " * 200, "en", "hot")]


def test_outliers_go_and_others_stay(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(rows())
    assert not any(got[2000 + i].kept for i in range(20))
    assert np.mean([got[i].kept for i in range(900) if not got[i].base_failed]) > 0.995
    assert got[3000].base_failed and not got[3000].kept and got[3001].base_failed
    assert quality.judge(df.filter("false")).count() == 0


def test_estimate_resists_contamination(spark):
    rng = np.random.default_rng(5)
    clean = rng.normal(size=(800, 5)) * [1, 2, 1, 1, 1]
    bad = rng.normal(size=(150, 5)) + 25
    data = np.concatenate([clean, bad]).tolist()
    df = spark.createDataFrame([("g", *x) for x in data], "g string, " + ", ".join(f"{d} double" for d in quality.DIMS))
    est = quality.estimates(df, 1).first()
    assert all(abs(est[f"m{i}"]) < 0.3 for i in range(5))
    assert 0.1 < est["q11"] < 0.5
