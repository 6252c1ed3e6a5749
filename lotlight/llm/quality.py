"""Quality rules: text statistics and robust multivariate outliers.

``statistics`` counts words, characters, symbols, repeated lines and repeated
word windows of whole texts.  ``outliers`` fits, for each language and source,
the location and scatter of the transformed statistics by the minimum
covariance determinant and rejects rows by their Mahalanobis distance.

The estimate runs as concentration steps over all rows of a group: distances
from the present estimate, the group's 75 % quantile of them, then mean and
covariance of the rows within it, which never raises the determinant.  The
start is the coordinates' medians and absolute deviations.  A group is only
ever met as mergeable sums and quantile sketches, so one source may hold any
share of the rows.  Groups of fewer than ``MIN_ROWS`` rows take the estimate
of their language, or else that of all rows.

Defined cases: null text counts as empty: all statistics 0 and the base rules
fail it; a null language or source is a group of its own; statistics without
spread have a least standard deviation (``FLOOR``), so constant columns and
tiny groups give finite distances; repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_join
from .words import Words, distinct, mix, odd, row_slices, split, text_bytes

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
NAMES = [c.split()[0] for c in STATS.split(", ")]

#: Transformed statistics and the least standard deviation of each.
VECTOR = {
    "x0": "ln(1 + n_words)",
    "x1": "ln(word_chars / greatest(n_words, 1) + 0.5)",
    "x2": "ln(1 + 100 * n_symbols / greatest(word_chars, 1))",
    "x3": "asin(sqrt(n_dup_lines / greatest(n_lines, 1)))",
    "x4": "asin(sqrt(n_repeat_words / greatest(n_words, 1)))",
}
FLOOR = {"x0": 0.5, "x1": 0.08, "x2": 0.2, "x3": 0.12, "x4": 0.12}
DIMS = list(VECTOR)

HALF = 0.75
STEPS = 4
MIN_ROWS = 100
#: Fixed values for five dimensions: the factor that makes the covariance of
#: the inner 75 % consistent for normal data, the 97.5 % point of chi-square,
#: the factor for the covariance within it, and the point for rejection, which
#: normal data pass with a probability of 1 - 1e-15; real statistics have
#: heavier tails, and what is junk lies far beyond.
CONSISTENT = 1.41
INNER = 12.83
CONSISTENT_INNER = 1.09
REJECT = 80.0

_symbol = np.zeros(256, dtype=bool)
_symbol[[ord(c) for c in "#*$%&|<>"]] = True


def _counts(column: pa.Array) -> list[np.ndarray]:
    data, offsets = text_bytes(column)
    words = split(data, offsets, lower=False)
    rows = len(column)
    n = words.counts()

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    in_word = np.zeros(len(data) + 1, dtype=np.int8)
    in_word[words.starts] = 1
    in_word[words.ends] -= 1  # may fall on the next row's first word: the marks cancel
    inside = np.cumsum(in_word[:-1]) > 0
    chars = within(inside & ((data & 0xC0) != 0x80))
    symbols = within(_symbol[data])
    # lines: a row's text between line feeds
    feeds = np.flatnonzero(data == 10)
    first = np.concatenate([offsets[:-1], feeds + 1])
    owner = np.concatenate([np.arange(rows), np.searchsorted(offsets[1:], feeds, side="right")])
    order = np.lexsort((first, owner))
    first, owner = first[order], owner[order]
    last = np.concatenate([first[1:] - 1, [0]])
    is_last = np.concatenate([owner[1:] != owner[:-1], [True]])
    last[is_last] = offsets[1:][owner[is_last]]
    filled = np.searchsorted(words.starts, last) > np.searchsorted(words.starts, first)
    first, last, owner = first[filled], last[filled], owner[filled]
    lines = Words(data, first, last, owner, np.zeros(0)).hashes()
    n_lines = np.bincount(owner, minlength=rows)
    n_dup = n_lines - np.bincount(distinct(lines, owner)[1], minlength=rows)
    # words covered by windows of three words that occur at least twice
    covered = np.zeros(len(words.row) + 1, dtype=np.int64)
    if len(words.row) >= 3:
        h, scale = words.hashes(), odd(3, 31)
        window = mix(h[:-2] * scale[0] + h[1:-1] * scale[1] + h[2:] * scale[2])
        whole = np.flatnonzero(words.row[:-2] == words.row[2:])
        v, r = window[whole], words.row[whole]
        by = np.lexsort((v, r))
        same = (v[by][1:] == v[by][:-1]) & (r[by][1:] == r[by][:-1])
        twice = np.zeros(len(by), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = whole[by[twice]]
        flags = np.zeros(len(words.row), dtype=bool)
        for j in range(3):
            flags[at + j] = True
        covered[1:] = np.cumsum(flags)
    repeat = covered[words.first[1:]] - covered[words.first[:-1]]
    return [n, chars, symbols, n_lines, n_dup, repeat]


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and the statistics of ``text``."""

    def run(batches):
        for batch in batches:
            for lo, n in row_slices(batch.column(0)):
                part = batch.slice(lo, n)
                got = [pa.array(x.astype(np.int64)) for x in _counts(part.column(0))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *got], names=[*keep, *NAMES])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{kinds}, {STATS}")


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def _distance() -> Column:
    """Squared Mahalanobis distance from columns of a joined estimate."""
    parts = []
    for i, a in enumerate(DIMS):
        for j, b in enumerate(DIMS[i:], i):
            parts.append((1 if i == j else 2) * F.col(f"q{i}{j}") * (F.col(a) - F.col(f"m{i}")) * (F.col(b) - F.col(f"m{j}")))
    return sum(parts[1:], parts[0])


ESTIMATE = ", ".join(["g string", *[f"m{i} double" for i in range(len(DIMS))], *[f"q{i}{j} double" for i in range(len(DIMS)) for j in range(i, len(DIMS))]])


def _solve(sums: DataFrame, factor: float) -> DataFrame:
    """One row of sums per group to its mean and inverse covariance."""
    p, floor = len(DIMS), np.array([FLOOR[d] for d in DIMS])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = max(r["n"], 1)
                mean = np.array([r[f"s{i}"] for i in range(p)]) / n
                cov = np.empty((p, p))
                for i in range(p):
                    for j in range(i, p):
                        cov[i, j] = cov[j, i] = r[f"s{i}{j}"] / n - mean[i] * mean[j]
                low, vectors = np.linalg.eigh(factor * cov / np.outer(floor, floor))
                # in units of the floors every direction has a variance of at least one
                inv = (vectors / np.maximum(low, 1.0)) @ vectors.T / np.outer(floor, floor)
                rows.append({"g": r["g"]} | {f"m{i}": mean[i] for i in range(p)} | {f"q{i}{j}": inv[i, j] for i in range(p) for j in range(i, p)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return sums.mapInArrow(run, ESTIMATE)


def _sums(rows: DataFrame) -> DataFrame:
    p = range(len(DIMS))
    return rows.groupBy("g").agg(
        F.count("*").alias("n"),
        *[F.sum(DIMS[i]).alias(f"s{i}") for i in p],
        *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"s{i}{j}") for i in p for j in p if j >= i],
    )


def estimates(rows: DataFrame, groups: int) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group ``g`` of rows
    (g and the transformed statistics); ``groups`` is their number."""
    mid = rows.groupBy("g").agg(*[F.percentile_approx(d, 0.5, 1000).alias(f"c{i}") for i, d in enumerate(DIMS)])
    spread = small_join(rows, cut(mid), ["g"], groups).select("*", *[F.abs(F.col(d) - F.col(f"c{i}")).alias(f"a{i}") for i, d in enumerate(DIMS)])
    spread = spread.groupBy("g").agg(*[F.first(f"c{i}").alias(f"m{i}") for i in range(len(DIMS))], *[F.percentile_approx(f"a{i}", 0.5, 1000).alias(f"a{i}") for i in range(len(DIMS))])
    start = [(1 / F.pow(F.greatest(1.4826 * F.col(f"a{i}"), F.lit(FLOOR[d])), F.lit(2))).alias(f"q{i}{i}") for i, d in enumerate(DIMS)]
    zero = [F.lit(0.0).alias(f"q{i}{j}") for i in range(len(DIMS)) for j in range(i + 1, len(DIMS))]
    est = cut(spread.select("g", *[f"m{i}" for i in range(len(DIMS))], *start, *zero))
    for _ in range(STEPS):
        far = small_join(rows, est, ["g"], groups).select("g", *DIMS, _distance().alias("d"))
        edge = cut(far.groupBy("g").agg(F.percentile_approx("d", HALF, 1000).alias("edge")))
        inner = small_join(far, edge, ["g"], groups).filter("d <= edge")
        est = cut(_solve(_sums(inner), CONSISTENT))
    far = small_join(rows, est, ["g"], groups).select("g", *DIMS, _distance().alias("d"))
    return cut(_solve(_sums(far.filter(F.col("d") <= INNER)), CONSISTENT_INNER))


def outliers(table: DataFrame) -> DataFrame:
    """Add ``distance`` and ``outlier`` to a stable table of statistics with
    lang and source.  Rows that fail the base rules don't shape estimates."""
    names = [F.to_json(F.struct(F.coalesce("lang", F.lit("\u0000")).alias("l"), F.coalesce("source", F.lit("\u0000")).alias("s"))), F.to_json(F.struct(F.coalesce("lang", F.lit("\u0000")).alias("l"))), F.lit("{}")]
    vectors = table.select("*", *[F.expr(c).alias(n) for n, c in VECTOR.items()])
    good = cut(vectors.filter(f"not {BASE_FAILED}").select(F.array(*names).alias("levels"), *DIMS))
    every = good.select(F.explode("levels").alias("g"), *DIMS)
    sizes = every.groupBy("g").count()
    usable = cut(sizes.filter((F.col("count") >= MIN_ROWS) | (F.col("g") == "{}")).select("g"))
    groups = usable.count()
    fitted = estimates(small_join(every, usable, ["g"], groups), groups)
    known = fitted.select("g").withColumn("there", F.lit(True))
    rows = vectors.select("*", F.array(*names).alias("levels"))
    for i in range(2):
        rows = small_join(rows.withColumn("g", F.col("levels")[i]), known, ["g"], groups, how="left").withColumnRenamed("there", f"there{i}").drop("g")
    rows = rows.withColumn("g", F.when(F.col("there0"), F.col("levels")[0]).when(F.col("there1"), F.col("levels")[1]).otherwise(F.lit("{}")))
    far = small_join(rows, fitted, ["g"], groups, how="left").withColumn("distance", _distance())
    return far.select(*table.columns, "distance", F.coalesce(F.col("distance") > REJECT, F.lit(False)).alias("outlier"))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base rules and the outlier verdict of every document."""
    table = cut(statistics(docs, ("doc_id", "lang", "source")))
    out = outliers(table).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
