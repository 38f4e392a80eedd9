"""Visually identical text with different characters, brought to one consistent form.

Letters of equal look form classes across scripts. A letter can stand for each script its class has a letter in, so each
run of letters (a token) has a resolved script set: the scripts in which all of it can be spelled. One script: the token
belongs there, and foreign letters in it (a mixed-script confusable) are replaced by that script's. Several (it may be
a whole-script confusable): the script that the text's other tokens belong to, if they all belong to one, else the home
script, Latin unless said otherwise. None: each letter becomes the first of its class.

The form depends on classes only, never on which of its letters a text was written with, so texts of equal look have
equal forms. Before that, invisible characters go, forms that differ only in width, font or ligature are resolved, and
spaces and hyphens of all kinds become the plain ones; letters and marks are composed. Letter case, marks, digits and
the number of spaces stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of letters of equal look, one letter a script (Latin, Cyrillic, Greek, Armenian, Cherokee); marks
# are apart, so accented letters need no entries of their own.
_CLASSES = (
    "AАΑᎪ BВΒᏴ CСϹᏟ DᎠ EЕΕᎬ GԌᏀ HНΗᎻ IІΙӀ JЈͿᎫ KКΚᏦ LԼᏞ MМΜᎷ NΝ OОΟՕ PРΡᏢ QԚ SЅՏᏚ TТΤᎢ VѴᏙ WԜᎳ XХΧ YУΥҮᎩ ZΖᏃ"
    " aаα cсϲ dԁ eе gց hһհ iіι jјϳյ lӏ nո oоοօ pрρ qԛզ sѕ uυս vѵν wԝ xх yу"
    " ĸкκ ЛΛ ПΠ ГΓᎱ ФΦՓ фφ тτ ӨΘ ɛєε æӕ əә RᎡ"
)
#: Latin letters that look like plainer Latin ones, and those; and small capitals.
_LATIN_KIN, _LATIN_KIN_AS = "ɑɡƅɩⅼⅽⅾⅿⅰⅴⅹꜱᴄᴏᴜᴠᴡᴢɪ", "agbilcdmivxscouvwzi"
_KIN = dict(zip(_LATIN_KIN, _LATIN_KIN_AS))
_HYPHENS = "‐‑‒–−⁃﹣－­"
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


@lru_cache(maxsize=65536)
def scripts(letter: str) -> frozenset[str]:
    """The scripts a letter is used in; empty for what belongs to all."""
    if not letter.isalpha():
        return frozenset()
    name = unicodedata.name(letter, "").partition(" ")[0]
    if name in ("CJK", "IDEOGRAPHIC"):
        return frozenset(("HAN", "JAPANESE", "KOREAN", "BOPOMOFO"))
    if name in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH"):
        return frozenset((name, "JAPANESE"))
    return frozenset((name, "KOREAN")) if name == "HANGUL" else frozenset((name,)) if name else frozenset()


@lru_cache(maxsize=65536)
def _plain_form(c: str) -> str:
    """One character without differences of width, font or ligature; '' for an invisible one."""
    if c in _HYPHENS:
        return "" if c == "­" else "-"
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind == "Cf" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef" or c in "͏ᅟᅠㅤﾠ":
        return ""
    if c in _KIN:
        return _KIN[c]
    if c in _CLASSES:
        return c
    tag, *codes = unicodedata.decomposition(c).split() or [""]
    if tag in _SAME_LOOK:
        return "".join(_plain_form(chr(int(x, 16))) for x in codes)
    return c


def _classes() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """The class of each letter, named by its first letter, and the letter of each script in a class."""
    of: dict[str, str] = {}
    members: dict[str, dict[str, str]] = {}
    for group in _CLASSES.split():
        first = next((of[c] for c in group if c in of), group[0])
        for c in group:
            of[c] = first
            for script in scripts(c):
                members.setdefault(first, {}).setdefault(script, c)
    return of, members


_CLASS, _MEMBER = _classes()
#: Where a token can be spelled in several scripts and none of them is the home script.
_PREFERENCE = {"LATIN": 0, "CYRILLIC": 1, "GREEK": 2}


@lru_cache(maxsize=65536)
def possible(letter: str) -> frozenset[str]:
    """The scripts a letter can stand for: its own, and those with a letter of equal look."""
    own = scripts(letter)
    return own | frozenset(_MEMBER[_CLASS[letter]]) if letter in _CLASS else own


def resolved_scripts(token: str) -> frozenset[str] | None:
    """The scripts in which the whole token can be spelled; None if no letter is bound to a script."""
    common: frozenset[str] | None = None
    for c in token:
        if own := possible(c):
            common = own if common is None else common & own
    return common


def _spell(token: str, script: str | None) -> str:
    """The token in letters of ``script``, which keeps its own letters; without one, each letter as the first of its class."""
    if script is None:
        return "".join(_CLASS.get(c, c) for c in token)
    return "".join(c if c not in _CLASS or script in scripts(c) else _MEMBER[_CLASS[c]].get(script, c) for c in token)


def consistent(text: str, home: str = "LATIN") -> str:
    """The consistent form of a text. Idempotent; plain ASCII stays as it is where Latin is the home script."""
    if text.isascii() and home == "LATIN":
        return text
    plain = unicodedata.normalize("NFD", "".join(map(_plain_form, unicodedata.normalize("NFC", text))))
    resolved = [resolved_scripts(t) for t in _TOKEN.findall(plain)]
    around = frozenset().union(*(r for r in resolved if r is not None and len(r) == 1))
    at = iter(resolved)

    def spell(m: re.Match) -> str:
        can = next(at)
        if can is None:
            return m.group()
        if len(can) > 1:
            fit = can & around if len(around) == 1 else frozenset()
            can = fit or can
        return _spell(m.group(), min(can, key=lambda x: (x != home, _PREFERENCE.get(x, 9), x), default=None))

    return unicodedata.normalize("NFC", _TOKEN.sub(spell, plain))


def with_form(df: DataFrame, column: str, form: str = "form") -> DataFrame:
    """``df`` with the consistent form of ``column``; null stays null, '' stays ''. ASCII rows never leave the JVM."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(consistent)

    ascii_only = F.col(column).isNull() | F.col(column).rlike(r"^[\x00-\x7F]*$")
    fast = df.where(ascii_only).withColumn(form, F.col(column))
    return fast.unionByName(df.where(~ascii_only).withColumn(form, F.pandas_udf(run, "string")(F.col(column))))


def match_registered(values: DataFrame, registered: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys``, ``value``, ``registered_value`` and ``n_alike``: each distinct unregistered value with the registered one
    it looks like.

    Both frames have ``keys`` and ``value``. Distinct values are matched, so repeats cost nothing. If several registered
    values have one form, ``n_alike`` is their number, and the one in consistent form is named, else the smallest. Nulls
    match nothing; a registered value is never reported.
    """
    asked = values.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    known = registered.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    forms = with_form(known, value).groupBy(*keys, "form").agg(F.min(F.struct(F.col(value) != F.col("form"), F.col(value))).getField(value).alias("registered_value"), F.count("*").alias("n_alike"))
    foreign = with_form(asked.join(known, [*keys, value], "left_anti"), value)
    return foreign.join(forms, [*keys, "form"]).select(*keys, value, "registered_value", "n_alike")
