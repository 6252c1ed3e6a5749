"""Lexemes of Russian words; the tables hold Latin ones, so each letter stands for a Cyrillic one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stems
from ..session import table
from .registry import query

LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "аящтефгиыйклмноьйвшсюхцэяз"


def _strip(name: str, source: str, text: str, pattern: str, keep: str = "") -> str:
    """A step of the twin: ``name`` is ``source`` without an ending of ``text``."""
    return f"{name} AS (SELECT *, regexp_replace({text}, '{pattern}$', '{keep}') AS {name}_t FROM {source})"


def _either(endings: str) -> str:
    return "(?:" + "|".join(endings.split()) + ")"


def _twin() -> str:
    v, c = f"[{stems.VOWELS}]", f"[^{stems.VOWELS}]"
    second = lambda kinds: rf"(?:([ая]){_either(kinds[0])}|{_either(kinds[1])})"
    steps = [
        f"w AS (SELECT translate(t, '{LATIN}', '{CYRILLIC}') AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents) GROUP BY 1)",
        f"h AS (SELECT *, length(regexp_extract(word, '^{c}*{v}')) AS a, length(regexp_extract(word, '^{c}*{v}+{c}+{v}+{c}')) AS b FROM w)",
        "p AS (SELECT *, word[:a] AS head, word[a + 1:] AS rv FROM h)",
        _strip("g", "p", "rv", second(stems.GERUND), r"\1"),
        _strip("s", "g", "rv", "с[яь]"),
        _strip("d", "s", "s_t", _either(stems.ADJECTIVE)),
        _strip("e", "d", "d_t", second(stems.PARTICIPLE), r"\1"),
        _strip("q", "e", "s_t", second(stems.VERB), r"\1"),
        _strip("o", "q", "s_t", _either(stems.NOUN)),
        "x AS (SELECT *, CASE WHEN g_t <> rv THEN g_t WHEN d_t <> s_t THEN e_t WHEN q_t <> s_t THEN q_t ELSE o_t END AS x_t FROM o)",
        _strip("i", "x", "x_t", "и"),
        "r AS (SELECT *, CASE WHEN b = 0 THEN i_t ELSE i_t[:b - a] || regexp_replace(i_t[b - a + 1:], 'ость?$', '') END AS r_t FROM i)",
        _strip("f", "r", "r_t", "(?:ейше?|ь)"),
        "z AS (SELECT *, CASE WHEN ends_with(f_t, 'нн') AND NOT ends_with(r_t, 'ь') THEN f_t[:-2] ELSE f_t END AS z_t FROM f)",
    ]
    stop = ", ".join(f"'{t}'" for t in stems.STOP)
    return f"WITH {', '.join(steps)} SELECT word, n, CASE WHEN word IN ({stop}) THEN NULL WHEN a = 0 THEN word ELSE head || z_t END AS lexeme FROM z"


@query(_twin())
def word_lexemes(spark, sf_dir):
    """Every word of the documents with its count and its lexeme, null for a
    stop word.  Words are counted first, so each is stemmed once."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("t"))
    counted = words.groupBy(F.translate("t", LATIN, CYRILLIC).alias("word")).agg(F.count("*").alias("n"))
    return counted.select("word", "n", F.when(~stems.is_stop(F.col("word")), stems.stem(F.col("word"))).alias("lexeme"))
