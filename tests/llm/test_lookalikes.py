import random
import unicodedata

import pytest

from ruleframe.llm import lookalikes
from ruleframe.llm.lookalikes import consistent


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("plain ASCII", "plain ASCII"), ("", ""), ("ＡＣ００－６４", "AC00-64"), ("AC‑12‐3", "AC-12-3"), ("a​b﻿c­d", "abcd"), ("Café", "Café"), ("Оffісе", "Office"), ("РАУ", "PAY"), ("Oﬃce", "Office"), ("x y　z", "x y z"),
        ("Склады", "Склады"), ("Cклaды", "Склады"), ("Πληρωμές", "Πληρωμές"), ("Πληpωμές", "Πληρωμές"), ("售后服务 Direct", "售后服务 Direct"), ("АСО0", "ACO0"), ("x²", "x²"), ("𝐏𝐚𝐲", "Pay"), ("naïve", "naïve"), ("a  b", "a  b"), ("OfficeО", "OfficeO"), ("ж" * 3, "жжж"),
    ],
)
def test_consistent_form(given, want):
    assert consistent(given) == want
    assert consistent(want) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("ПΑΝ", "ΠΑΝ"), ("ƅeta", "beta"), ("ɩoan", "ioan"), ("ꜱmall", "small"), ("Все хор Платежи", "Все хор Платежи"), ("Платежи cop", "Платежи сор"), ("Πλάνο του", "Πλάνο του"), ("сор", "cop"), ("Office сор", "Office cop"),
        ("Geb\u0430\u0308ud\u0435", "Gebäude"), ("Ӓrea", "Ärea"), ("Ωж", "Ωж"), ("Үй жаңа", "Үй жаңа"), ("ΓΑЖ", "ГАЖ"),
    ],
)
def test_scripts_across_letters_and_neighbours(given, want):
    assert consistent(given) == want and consistent(want) == want


def test_home_script():
    assert consistent("cop", "CYRILLIC") == "сор" and consistent("Все хор", "CYRILLIC") == "Все хор" and consistent("grid", "CYRILLIC") == "grid"


def test_form_does_not_depend_on_the_letters_used():
    """Any letter may be replaced by one of its class, in any token: the form stays."""
    r = random.Random(3)
    by_class = {}
    for c, first in lookalikes._CLASS.items():
        by_class.setdefault(first, []).append(c)
    letters = "ABCEHIKMOPTXaceiopxyDFGdfgnrЖдПлΩλπ éäç"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 14)))
        other = "".join(r.choice(by_class[lookalikes._CLASS[c]]) if c in lookalikes._CLASS and r.random() < 0.5 and c not in "УҮӀI" else c for c in unicodedata.normalize("NFD", text))
        if not set(other) & set("ҮУӀІ"):
            assert consistent(other) == consistent(text), (text, other)


def test_differences_that_stay():
    for a, b in (("Office", "office"), ("Área", "Area"), ("AC0", "ACO"), ("a b", "ab"), ("a b", "a  b"), ("l1", "11")):
        assert consistent(a) != consistent(b)


def test_long_text():
    assert consistent("Оffісе " * 50_000) == "Office " * 50_000


def test_match(spark, rows):
    values = spark.createDataFrame([("n", "Оffісе"), ("n", "Оffісе"), ("n", "Office"), ("n", None), ("n", "office"), ("c", "Оffісе"), (None, "Оffісе")], "field_name string, value string")
    known = spark.createDataFrame([("n", "Office"), ("n", "Office"), ("n", None), ("m", "x")], "field_name string, value string")
    assert rows(lookalikes.match_registered(values, known, ["field_name"])) == [("n", "Оffісе", "Office", 1)]
    alike = known.union(spark.createDataFrame([("n", "Officе"), ("n", "Оffice")], known.schema))
    assert rows(lookalikes.match_registered(values, alike, ["field_name"])) == [("n", "Оffісе", "Office", 3)]
    assert lookalikes.match_registered(values, known.limit(0), ["field_name"]).count() == 0
    assert lookalikes.match_registered(values.limit(0), known, ["field_name"]).count() == 0
