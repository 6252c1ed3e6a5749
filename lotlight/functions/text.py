"""The search form of procurement text, in SQL expressions.

Characters first get their plain form.  What remains is then said by one
pattern of a token: letters and digits, and marks that stand where they mean
something (a point or comma within a number, a per cent or inch sign behind a
digit, a joint between two letters or digits).  The tokens are taken out of
the text in order; everything else is a gap.  Whether a double quote is an
inch sign depends on the quotes before it, so a fold over the quoted pieces
says that beforehand.  Only rows with combining marks go through Python, for
their composition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that vanish, become a space, or a plain one.
GONE = "­​‌‍‎‏⁠﻿"
TO_SPACE = "«»„“”‟º" + "".join(map(chr, range(32)))
DOUBLE, SINGLE, DASHES = "″〃＂ʺ", "‘’‚‛′`´", "‐‑‒–—―−﹘﹣－"
PLAIN = {**dict.fromkeys(TO_SPACE, " "), **dict.fromkeys(DOUBLE, '"'), **dict.fromkeys(SINGLE, "'"), **dict.fromkeys(DASHES, "-"), "ё": "е", "Ё": "Е", "×": "x"}
#: Raised digits that are part of a unit; other raised and lowered signs are notes.
UNITS = {"м²": "м2", "м³": "м3", "m²": "m2", "m³": "m3"}
RAISED = r"²³¹⁰-₟"

#: What translate() takes: characters, and what they become (the rest vanishes).
SOURCE, TARGET = "".join(PLAIN) + GONE, "".join(PLAIN.values())

_digit = r"\p{Nd}"
_letter = rf"[\p{{L}}\p{{N}}&&[^{RAISED}]]"
#: One character of a token, by what stands around it; a star may turn out to be a sign of multiplication.
_inside = [_letter, r"\*", rf"(?<={_digit})[.,](?={_digit})", rf'(?<={_digit})[%"]', rf"(?<={_letter})[/+-](?={_letter})"]
TOKEN = f"(?:{'|'.join(_inside)})+"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def inch_marks(text: Column) -> Column:
    """Double quotes stay only as inch marks after a digit outside quotation;
    one before a character that can stand in a token opens a quotation."""
    parts = F.transform(F.split(text, '"', -1), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    last = F.size(parts) - 1
    start = F.struct(parts[0]["p"].alias("out"), parts[0]["p"].alias("before"), F.lit(False).alias("quoting"))

    def step(s: Column, x: Column) -> Column:
        inch = ~s["quoting"] & s["before"].rlike(rf"{_digit}$")
        opens = ~s["quoting"] & ~inch & F.when(x["p"] == "", x["i"] < last).otherwise(x["p"].rlike(rf"^(?:{_letter}|[%*/+-])"))
        return F.struct(F.concat(s["out"], F.when(inch, '"').otherwise(" "), x["p"]).alias("out"), x["p"].alias("before"), opens.alias("quoting"))

    return F.when(text.contains('"'), F.aggregate(F.slice(parts, 2, F.greatest(last, F.lit(1))), start, step)["out"]).otherwise(text)


def normalize(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``, the search form of ``column``; null where nothing
    is left.  Applying it twice changes nothing."""
    raw = F.col(column)
    out = df.withColumn(name, F.coalesce(_composed(F.when(raw.rlike(r"\p{M}"), raw)), raw))
    plain = F.lower(F.translate(name, SOURCE, TARGET))
    for unit, digit in UNITS.items():
        plain = F.replace(plain, F.lit(unit), F.lit(digit))
    out = out.withColumn(name, plain)
    out = out.withColumn(name, F.array_join(F.regexp_extract_all(inch_marks(F.col(name)), F.lit(TOKEN), F.lit(0)), " "))
    # a sign of multiplication between numbers, within a token or as a token of its own
    signs = F.regexp_replace(name, rf"(?<={_digit})[xх*](?={_digit})", "x")
    signs = F.regexp_replace(signs, rf"(?<={_digit}) [xх*] (?={_digit})", "x")
    return out.withColumn(name, F.nullif(F.trim(F.regexp_replace(signs, "[* ]+", " ")), F.lit("")))
