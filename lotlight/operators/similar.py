"""Similarity join of words: all pairs whose matching ratio reaches a bound.

The ratio is that of matching blocks (twice the characters in common blocks
over both lengths, the longest block first, then left and right of it).  It is
never more than the share of the longest common subsequence, so a pair at the
bound differs by few insertions and deletions, and these destroy few of a
word's bigrams: two words must share one of their rarest bigrams (a prefix of
the order by frequency).  Candidates come from that index alone; lengths, the
edit distance and then the ratio itself verify them.  No word meets all terms.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(words: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(words, terms)])


def bigrams(word: Column) -> Column:
    """Pairs of neighbouring characters, each with its number among equal ones."""
    pairs = F.regexp_extract_all(word, F.lit("(?s)(?=(..))"), F.lit(1))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, 1, i), lambda h: h == g)).cast("string")))


def _prefix(rows: DataFrame, name: str, frequency: DataFrame, least: float, gap: int) -> DataFrame:
    """The rarest bigrams of each word, as many as a partner can lack and one more."""
    size = F.length(name)
    edits = F.floor((1 - least) * (2 * size + gap) + 1e-9)
    lost = edits + F.floor((edits + gap) / 2)
    grams = rows.select(name, F.explode(bigrams(F.col(name))).alias("gram")).join(frequency, "gram", "left")
    held = grams.groupBy(name).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("_g"))
    return held.select(name, F.explode(F.slice("_g.gram", F.lit(1), (lost + 1).cast("int"))).alias("gram"))


def similar(words: DataFrame, terms: DataFrame, least: float = 0.88, shortest: int = 6, gap: int = 2) -> DataFrame:
    """word, term and ratio of every pair with that ratio at least, both words
    of ``shortest`` characters or more and ``gap`` apart in length at most.

    words (word) and terms (term) may repeat and hold nulls, which have no
    partner; a word that is a term itself has no other partner."""
    terms = terms.select("term").filter(F.length("term") >= shortest).distinct()
    words = words.select("word").filter(F.length("word") >= shortest).distinct().join(terms, F.col("word") == F.col("term"), "left_anti")
    frequency = terms.select(F.explode(bigrams(F.col("term"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    met = _prefix(words, "word", frequency, least, gap).join(_prefix(terms, "term", frequency, least, gap), "gram")
    met = met.filter(F.abs(F.length("word") - F.length("term")) <= gap).select("word", "term").distinct()
    met = met.filter(F.levenshtein("word", "term") <= (1 - least) * (F.length("word") + F.length("term")) + 1e-9)
    return met.withColumn("ratio", _ratio("word", "term")).filter(F.col("ratio") >= least)


def fuzzy_codes(queries: DataFrame, postings: DataFrame, least: float = 0.88) -> DataFrame:
    """queries (query, word) against postings (term, code): for each query and
    code the most similar term (of equal ones the first) of a word that no
    title has, and the confidence of such a suggestion."""
    near = similar(queries, postings, least)
    rows = queries.select("query", "word").distinct().join(near, "word").join(postings.select("term", "code").distinct(), "term")
    best = rows.groupBy("query", "code").agg(F.max("ratio").alias("ratio"), F.min_by("term", F.struct(-F.col("ratio"), "term")).alias("term"))
    return best.withColumn("confidence", F.round(F.least(F.lit(0.4), 0.2 + 0.2 * F.col("ratio")), 3))
