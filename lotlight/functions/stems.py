"""Russian lexemes: stop words and the published Snowball suffix rules, in SQL expressions.

A word's endings are taken only from the part behind its first vowel.  Of a
kind of ending the longest one goes; some only behind а or я.  As a pattern
anchored at the end matches from its leftmost start, it takes the longest by
itself.  Words without Cyrillic vowels stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The algorithm's vowels and endings; those of the first kind stand behind а or я.
VOWELS = "аеиоуыэюя"
GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"

#: Stop words of the published list.
STOP = """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему
теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где
есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним
здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот
через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более
всегда конечно всю между""".split()


def _any(endings: str) -> str:
    return "(?:" + "|".join(endings.split()) + ")"


def _two(kinds: tuple[str, str]) -> str:
    return f"(?:(?<=[ая]){_any(kinds[0])}|{_any(kinds[1])})"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _first(text: Column, *patterns: str) -> Column:
    """The text without the ending of the first pattern that has one."""
    return F.coalesce(*[F.nullif(F.regexp_replace(text, f"{p}$", ""), text) for p in patterns], text)


def _region(text: Column, start: Column) -> Column:
    """What remains of the part behind the first vowel; ``start`` is where the
    second region begins in it."""
    out = F.coalesce(
        F.nullif(F.regexp_replace(text, f"{_two(GERUND)}$", ""), text),
        _let(F.regexp_replace(text, "с[яь]$", ""), lambda t: _first(t, f"{_two(PARTICIPLE)}?{_any(ADJECTIVE)}", _two(VERB), _any(NOUN))),
    )
    out = F.regexp_replace(out, "и$", "")
    out = _let(out, lambda t: F.concat(F.substring(t, F.lit(1), start), F.regexp_replace(F.substring(t, start + 1, F.length(t)), "ость?$", "")))
    return F.regexp_replace(out, "(?:(?<=н)н)?ейше?$|(?<=н)н$|ь$", "")


def stem(word: Column) -> Column:
    """The stem of a word in small letters; null stays null."""
    v, c = f"[{VOWELS}]", f"[^{VOWELS}]"

    def of(w: Column) -> Column:
        first = F.length(F.regexp_extract(w, f"^{c}*{v}", 0))
        second = F.length(F.regexp_extract(w, f"^{c}*{v}+{c}+{v}+{c}", 0))
        parts = F.struct(first.alias("first"), F.when(second > 0, second).otherwise(F.length(w)).alias("second"))
        cut = _let(parts, lambda p: F.concat(F.substring(w, F.lit(1), p["first"]), _region(F.substring(w, p["first"] + 1, F.length(w)), p["second"] - p["first"])))
        return F.when(w.rlike(v), cut).otherwise(w)

    return _let(F.translate(word, "ё", "е"), of)


def is_stop(word: Column) -> Column:
    return F.translate(word, "ё", "е").isin(STOP)


def lexemes(text: str | Column) -> Column:
    """Distinct stems of a text's words without stop words: a tokeniser for
    ``operators.search``, which takes any function of this form."""
    words = F.split(F.col(text) if isinstance(text, str) else text, " ")
    return F.array_distinct(F.transform(F.filter(words, lambda t: (t != "") & ~is_stop(t)), stem))
