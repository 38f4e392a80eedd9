import time

import pytest

import residue_texts
from ruleframe.llm import residue
from ruleframe.llm.residue import kinds

BAD = [
    "The Member for {{member_name}} rose.", "We heard {% vote_count %} witnesses.", "I met ${speaker.name} today.", "I met $(party) today.", "Dear #{name}, thanks.", "It cost <%= amount %> crowns.", "On %%ITEM%% we agree.", "On @@item@@ we agree.",
    "It was %(sum)s crowns.", "The [[PARTY]] objects.", "The [MINISTER_NAME] objects.", "Clause [INSERT NUMBER HERE] stands.", "By [TODO: name] alone.", "The [name to be supplied] puts it so.", "The <SPEAKER NAME> rose.", "Say &lt;party&gt; again.", "Say «vote count» again.", "No XXXX (vote count) came.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Real speech here.\nvelit nulla officia mollit fugiat.", "blah blah blah blah.", "Sample speech text.", "Hier steht Blindtext.", "Texte factice pour la mise en page.", "TBC TBC - speech to follow", "Xxxx xxxxx xx xxx.", "Text text text text.",
    "404 Not Found", "Ann Lee 502 Bad Gateway: the connection was closed.", "Access Denied.", "Fehler 186\nTry again.", "Internal Server Error - please return.", "The requested page could not be found on this server.", "Your session has expired.", "Traceback (most recent call last): KeyError", "nginx", "Sorry, something went wrong.",
    "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "Veuillez activer JavaScript pour continuer.", "Your browser does not run scripts: change this setting!", "I thank the House.\nThis site requires JavaScript and cookies.", "Please enable JavaScript and reload the page The Minister said nothing of it.",
]
GOOD = [
    "", "I thank the House for its patience.", "[Applause] (The sitting was suspended.) [sic] [pause]", "The bill costs $5 {in today's prices} for rail.", "They record <so it stands> in the text.", "“Please enable JavaScript” is all they saw.", "The website told growers to enable JavaScript.",
    "Access denied was the answer they got.", "A constituent showed me a page headed 503 Service Unavailable; that, he said, is the policy.", "They get an error 404 and nothing else.", "On a répondu « service momentanément indisponible » à tous.", "Der Entwurf ist Blindtext, werte Kollegen.", "We might as well read lorem ipsum on rail.",
    "I ask for a placeholder of 3 million.", "My office wrote TBC beside rail twice.", "```\n{{ name }}\n```\nis how it is written.", "For example, “{{ name }}” marks the name.", "Please turn on the lights, one of them wrote to me, before you turn on your browsers.", "[Note: 404 Not Found]", "50 per cent of 100 euros @ home #1 & more < less > more",
]


@pytest.mark.parametrize("text", BAD)
def test_residue(text):
    assert kinds(text)


@pytest.mark.parametrize("text", GOOD)
def test_speech(text):
    assert kinds(text) == []


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "404 Not Found", 0), (1, "404 Not Found", 0), (2, None, 0), (3, "", 0), (4, "Fine words. " * 50_000 + "{{ x_y }}", 0), (None, "404 Not Found", 0)], "doc_id long, text string, kinds int")
    assert rows(residue.find_residue(df)) == [(1, ["notice"]), (1, ["notice"]), (4, ["placeholder"])]
    assert residue.find_residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["The Member for {{member_name}} rose. We need rail, such as the coast line.", "```\n{{ name }}\n```\nI thank {{ member_name }} for it.", "For example, {{ a }} marks a name. The [[PARTY]] objects.", "Par exemple, le rail.\nI met ${speaker.name} today."])
def test_fields_beside_explanations(text):
    assert kinds(text) == ["placeholder"]


@pytest.mark.parametrize("text", ["For example, {{ name }} marks the name.", "Marks are set by hand, e.g. {{ name }} or {{ party }} in a letter.", "Beispiel:\n{{ name }}", "We print placeholders like [[PARTY]] there. Rail is late."])
def test_explained_fields(text):
    assert kinds(text) == []


@pytest.mark.parametrize("text", ["Serverfehler.", "Rede wird nachgereicht.", "Wortlaut wird nachgereicht.", "This document does not exist.", "This document is not available.", "The record you are looking for could not be shown."])
def test_every_sentence_meets_the_grammars(text):
    assert kinds(text) and kinds(f"I thank the House for its patience.\n{text}")


def test_accuracy_on_everyday_texts():
    for name, least in (("SEEN", 1.0), ("HELD", 0.9)):
        bad, good = getattr(residue_texts, f"{name}_RESIDUE"), getattr(residue_texts, f"{name}_CLEAN")
        found, wrong = sum(map(bool, map(kinds, bad))), sum(map(bool, map(kinds, good)))
        assert found >= least * len(bad) and found >= 0.9 * (found + wrong), name


def test_one_trigger_for_every_rule():
    """Without the automaton's hint, each sentence alone comes out the same."""
    texts = [*BAD, *GOOD, *residue_texts.SEEN_RESIDUE, *residue_texts.SEEN_CLEAN, *residue_texts.HELD_RESIDUE, *residue_texts.HELD_CLEAN]
    with_hint = [kinds(t) for t in texts]
    was, residue._triggered = residue._triggered, lambda _: True
    try:
        assert [kinds(t) for t in texts] == with_hint
    finally:
        residue._triggered = was


def test_long_stretches():
    """Whole texts are read: quotations, brackets and names of any length."""
    long = " ".join("a slow grey barge with coal for the northern mills came down to our old lock".split()[k * k % 13] for k in range(300))
    assert kinds(f"“{long} please enable JavaScript {long}” is what they saw.") == []
    assert kinds(f"[Note: {long} 404 Not Found]") == [] and kinds(f"{long}.\n404 Not Found") == ["notice"]
    assert kinds("Ann Bo Cy Di Ed Flo Gus Hal Ida Please enable JavaScript to continue.") == ["notice"]
    assert kinds("{{ " + "x" * 500 + " | default }}") == ["placeholder"] and kinds(f"[INSERT {long} HERE]") == ["placeholder"]


def test_time_is_linear():
    for text in ("AAA " * 40_000, "[" * 40_000, "“" * 40_000, "{ " * 40_000, "Bo " * 40_000 + "x", "<a " * 40_000, "( " * 40_000):
        began = time.perf_counter()
        kinds(text)
        assert time.perf_counter() - began < 5
