"""Language identification by a linear-chain conditional random field.

Words are labelled, not documents: each word has hashed features (prefixes and
suffixes of up to four bytes, inner byte n-grams of two and three, the whole
word as lexicon entry), learned weights turn them into scores for each
language, learned transitions tie neighbours together, and forward-backward
gives every word its probability of each language, also in text that switches
between languages.  A document's language is the one with the largest mean
probability over its words with letters, and that mean is its score.

Training runs on the driver on at most about ``PER_LANGUAGE`` labelled documents of each
language, chosen by a hash of their id; half of the training chains join
spans of different languages.  Prediction covers all words of all texts, in
batches: features are computed once for each distinct word of a batch, and the
chains of all lines advance together.

Chains end at line feeds and after ``CHAIN`` words.

Defined cases: null texts and texts without a letter are ``und`` with score
0; without any labelled document everything is ``und``; ties go to the
alphabetically first language; repeated rows are judged alike; null doc_ids count
as held out for training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import BASE, Words, mix, row_slices, split, text_bytes

PLACES = 1 << 17
PER_LANGUAGE = 200
#: Words of one training document at most that enter chains, taken from all over it.
SPAN_WORDS = 40
CHAIN = 256
EPOCHS = 3
BATCH_CHAINS = 96
RATE = 0.15
UND = "und"

_letter = np.zeros(256, dtype=bool)
_letter[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True


def features(words: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, which) of all features of the words at ``index``."""
    starts, ends = words.starts[index], words.ends[index]
    data = words.data
    # drop ASCII punctuation at both ends of a word
    bare = ~(_letter[data] | (data >= 0x80) | ((data >= 48) & (data <= 57)))
    for _ in range(3):
        starts = starts + ((starts < ends) & bare[np.minimum(starts, len(data) - 1)])
        ends = ends - ((starts < ends) & bare[np.maximum(ends - 1, 0)])
    size = ends - starts
    which_all, place_all = [], []
    total = int(size.sum())
    owner = np.repeat(np.arange(len(index)), size)
    begin = np.cumsum(size) - size
    inner = np.arange(total) - begin[owner]
    flat = data[starts[owner] + inner].astype(np.uint64) + np.uint64(1)

    def add(hashes, which, kind):
        place_all.append((mix(hashes + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(PLACES)).astype(np.int64))
        which_all.append(which)

    base = np.uint64(BASE)
    gram = flat.copy()
    for n in (2, 3):
        if total >= n:
            gram = gram[: total - n + 1] * base + flat[n - 1 :]
            ok = inner[: total - n + 1] + n <= size[owner[: total - n + 1]]
            add(gram[ok], owner[: total - n + 1][ok], n)
    whole = np.zeros(len(index), dtype=np.uint64)
    at = np.arange(len(index))
    for n in range(1, 5):
        has = size >= n
        front, back = np.zeros(int(has.sum()), np.uint64), np.zeros(int(has.sum()), np.uint64)
        for j in range(n):
            front = front * base + flat[begin[has] + j]
            back = back * base + flat[begin[has] + size[has] - n + j]
        add(front, at[has], 10 + n)
        add(back, at[has], 20 + n)
    if total:
        trimmed = Words(data, starts, ends, None, None)
        whole = trimmed.hashes()
        add(whole[size > 0], at[size > 0], 30)
    which, place = np.concatenate(which_all or [np.zeros(0, np.int64)]), np.concatenate(place_all or [np.zeros(0, np.int64)])
    order = np.argsort(which, kind="stable")
    return place[order], which[order]


@dataclass
class Model:
    """Languages, weights (places x languages) and transition scores."""

    languages: list[str]
    weights: np.ndarray
    steps: np.ndarray


def emissions(weights: np.ndarray, place: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Score of each of ``n`` words for each language, by features in word order."""
    out = np.zeros((n, weights.shape[1]), dtype=np.float32)
    if len(which):
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        out[which[first]] = np.add.reduceat(weights[place], first, axis=0)
    return out


def forward_backward(scores: np.ndarray, sizes: np.ndarray, steps: np.ndarray, pairs: bool = False):
    """Probabilities of labels for chains that lie one after another.

    All chains advance together, longest first.  With ``pairs``, also the
    expected number of each transition.
    """
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    begin = (np.cumsum(sizes[np.argsort(order, kind="stable")]) - sizes[np.argsort(order, kind="stable")])[order]
    move = np.exp(steps).astype(np.float32)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    alpha, beta = np.empty_like(e), np.ones_like(e)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    for t in range(longest):
        at = begin[: live[t]] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ move) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros(steps.shape)
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        ahead = e[at + 1] * beta[at + 1]
        b = ahead @ move.T
        if pairs:
            joint = alpha[at][:, :, None] * move[None] * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    return (gamma, expected) if pairs else gamma


def _training_chains(rows: list[tuple[str, int]], rng: np.random.Generator):
    """Words of all training texts and chains of (word index, label)."""
    words = split(*text_bytes(pa.array([t for t, _ in rows], pa.string())))
    label = np.array([k for _, k in rows])
    n = words.counts()
    spans = []
    for r in np.flatnonzero(n).tolist():
        for at in range(0, int(n[r]), SPAN_WORDS):
            spans.append((int(words.first[r]) + at, int(words.first[r]) + min(at + SPAN_WORDS, int(n[r])), int(label[r])))
    if len(spans) > 40 * PER_LANGUAGE:
        keep = rng.permutation(len(spans))[: 40 * PER_LANGUAGE]
        spans = [spans[i] for i in keep.tolist()]
    rng.shuffle(spans)
    chains, i = [], 0
    while i < len(spans):
        take = int(rng.integers(2, 4)) if rng.random() < 0.5 else 1
        group = spans[i : i + take]
        i += take
        if take > 1:  # shorter spans where languages meet
            group = [(a, a + int(rng.integers(3, max(4, b - a + 1))) if b - a > 3 else b, k) for a, b, k in group]
            group = [(a, min(b, int(words.first[words.row[a] + 1])), k) for a, b, k in group]
        at = np.concatenate([np.arange(a, b) for a, b, _ in group])
        chains.append((at, np.concatenate([np.full(b - a, k) for a, b, k in group])))
    return words, chains


def fit(rows: list[tuple[str, str]], seed: int = 3) -> Model:
    """Train on (text, language) rows by adaptive gradient steps on the
    conditional likelihood of whole chains."""
    languages = sorted({k for _, k in rows})
    code = {k: i for i, k in enumerate(languages)}
    size = len(languages)
    weights, steps = np.zeros((PLACES, size), np.float32), np.zeros((size, size), np.float32)
    if size < 2:
        return Model(languages, weights, steps)
    rng = np.random.default_rng(seed)
    words, chains = _training_chains([(t, code[k]) for t, k in rows], rng)
    h = words.hashes()
    seen_w, seen_s = np.full((PLACES, size), 1e-2, np.float32), np.full((size, size), 1.0, np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(chains))
        for lo in range(0, len(order), BATCH_CHAINS):
            batch = [chains[i] for i in order[lo : lo + BATCH_CHAINS].tolist()]
            at, gold = np.concatenate([c[0] for c in batch]), np.concatenate([c[1] for c in batch])
            sizes = np.array([len(c[0]) for c in batch])
            _, first, back = np.unique(h[at], return_index=True, return_inverse=True)
            place, which = features(words, at[first])
            gamma, expected = forward_backward(emissions(weights, place, which, len(first))[back], sizes, steps, pairs=True)
            real = np.zeros((size, size))
            inner = np.ones(len(at), bool)
            inner[np.cumsum(sizes) - 1] = False
            spots = np.flatnonzero(inner)
            np.add.at(real, (gold[spots], gold[spots + 1]), 1)
            error = -gamma
            error[np.arange(len(at)), gold] += 1
            by_word = np.stack([np.bincount(back, weights=error[:, k], minlength=len(first)) for k in range(size)], axis=1)
            used, where = np.unique(place, return_inverse=True)
            g = np.stack([np.bincount(where, weights=by_word[which, k], minlength=len(used)) for k in range(size)], axis=1)
            g = (g / len(batch) - 1e-4 * weights[used]).astype(np.float32)
            seen_w[used] += g * g
            weights[used] += RATE * g / np.sqrt(seen_w[used])
            gs = ((real - expected) / len(batch)).astype(np.float32)
            seen_s += gs * gs
            steps += RATE * gs / np.sqrt(seen_s)
    return Model(languages, weights, steps)


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a column."""
    texts_rows = len(column)
    size = len(model.languages)
    if not size:
        return [UND] * texts_rows, np.zeros(texts_rows)
    data, offsets = text_bytes(column)
    words = split(data, offsets)
    sums, n = np.zeros((texts_rows, size)), np.zeros(texts_rows)
    if len(words.row):
        gamma = label_words(model, words)
        letters = np.concatenate([[0], np.cumsum(_letter[words.data])])
        has = letters[words.ends] > letters[words.starts]
        row = words.row[has]
        for k in range(size):
            sums[:, k] = np.bincount(row, weights=gamma[has, k], minlength=texts_rows)
        n = np.bincount(row, minlength=texts_rows)
    best = sums.argmax(axis=1)
    score = np.where(n > 0, sums[np.arange(texts_rows), best] / np.maximum(n, 1), 0.0)
    found = [model.languages[k] if m else UND for k, m in zip(best.tolist(), n.tolist())]
    for i in np.flatnonzero(n == 0).tolist():  # letters of other scripts, or none
        if any(c.isalpha() for c in column[i].as_py() or ""):
            found[i], score[i] = model.languages[0], 1 / size
    # bytes taken for letters above may be symbols beyond ASCII only
    ascii_letters = np.concatenate([[0], np.cumsum(_letter[data] & (data < 0x80))])
    for i in np.flatnonzero((ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]]) & (n > 0)).tolist():
        if not any(c.isalpha() for c in column[i].as_py()):
            found[i], score[i] = UND, 0.0
    return found, np.clip(score, 0.0, 1.0)


def label_words(model: Model, words: Words) -> np.ndarray:
    """Probability of each language for every word."""
    _, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    parts = [emissions(model.weights, *features(words, first[lo : lo + 65536]), len(first[lo : lo + 65536])) for lo in range(0, len(first), 65536)]
    scores = np.concatenate(parts)[back]
    feeds = np.concatenate([[0], np.cumsum(words.data == 10)])
    line = feeds[words.starts]
    new = np.concatenate([[True], (words.row[1:] != words.row[:-1]) | (line[1:] != line[:-1])])
    since = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    new |= since % CHAIN == 0
    at = np.flatnonzero(new)
    return forward_backward(scores, np.diff(np.concatenate([at, [len(new)]])), model.steps)


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from a bounded sample of the labelled rows that are not held out."""
    known = docs.select("doc_id", "text", "lang").filter(~is_held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    spread = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (spread < max(1, int(1_000_000 * min(1.0, per_language / n)))))
    rows = known.filter(chosen).orderBy("doc_id").limit(2 * per_language * max(1, len(sizes))).select("text", "lang").collect()
    return fit([(r["text"], r["lang"]) for r in rows])


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, n in row_slices(batch.column(2)):
                part = batch.slice(lo, n)
                found, score = predict(shared.value, part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without those of no language or of a score below ``least``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, n in row_slices(batch.column(at)):
                part = batch.slice(lo, n)
                found, score = predict(shared.value, part.column(at))
                good = np.array([k != UND for k in found]) & (score >= least)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
