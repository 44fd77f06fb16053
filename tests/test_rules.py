"""Rule cascades case by case."""

import pytest

from docweave.operators import findings, rules
from docweave.plans.cascades import SPEAKERS


@pytest.mark.parametrize(
    ("sentence", "judgment", "found"),
    [
        ("The prosecutor requested two years and six months of imprisonment.", False, ("requested", "imprisonment", 30, 30)),
        ("He was sentenced to imprisonment of 18 months.", True, ("imposed", "imprisonment", 18, 18)),
        ("He was sentenced to imprisonment of 18 months.", False, None),
        ("The offence is punishable by up to five years in prison.", False, ("statutory", "imprisonment", None, 60)),
        ("The offence is punishable by not less than three years in prison.", False, ("statutory", "imprisonment", 36, None)),
        ("He was sentenced to prison of 3 to 5 years.", True, ("imposed", "imprisonment", 36, 60)),
        ("He was sentenced to two and a half years.", True, None),
        ("She was sentenced to a fine.", True, ("imposed", "fine", None, None)),
        ("The crime is punishable by the death penalty.", False, ("statutory", "death_penalty", None, None)),
        ("The prosecution seeks life imprisonment.", False, ("requested", "life_imprisonment", None, None)),
        ("The court imposed no prison sentence.", True, None),
        ("He was sentenced to 20 days of imprisonment.", True, ("imposed", "imprisonment", None, None)),
        ("The weather was fine.", True, None),
    ],
)
def test_penalties(sentence, judgment, found):
    assert rules.penalty(sentence, judgment) == found


def test_number_words():
    assert [findings.number_of_words(w) for w in ("seven", "twenty-one", "one hundred and five", "12", "a dozen", "")] == [7, 21, 105, 12, None, None]


def test_speakers():
    s = lambda text, kind="body", chapter=None, fresh=True: (kind, text, chapter, fresh)
    rows = [
        s("Case 12", "header"), s("The defence argues delay."), s("It further submits costs."), s("The Court finds none."), s("It further relies on this."), s("The defence rightly argues delay."),
        s("Article 14 provides:"), s("Everyone has rights."), s("And more of them.", fresh=False), s("The case was heard."), s("He is charged with fraud."), s("Heard.", chapter="Submissions"), s("Heard.", chapter="Charges and reasons"),
        s("The Court notes that the prosecution objects."), s("Facts", "heading"), s("It also objects."),
    ]
    assert rules.speakers(rows, SPEAKERS) == [
        "header_or_signature", "party_position", "party_position", None, None, None, "statute_quote", "statute_quote", "statute_quote", None, "charge_recital", "non_reasoning_section", None, "party_position", None, None,
    ]


def test_named_passages():
    assert rules.named(["P1, P3", "none"], 5) == ([1, 3], False)
    assert rules.named(["P2: it says 9"], 5) == ([2], False)
    assert rules.named(["see above", "P9"], 5) == ([], True)


def test_excerpts_stay_in_budget():
    text = "x" * 3000 + " sentenced here " + "y" * 3000
    cut = rules.excerpts(text, ["sentenced"], 1500)
    assert sum(b - a for a, b in cut) <= 1500 and any("sentenced" in text[a:b] for a, b in cut)
    assert rules.excerpts("short", ["x"], 1500) == []
