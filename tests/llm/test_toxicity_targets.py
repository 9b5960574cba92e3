"""Targets on either side of a threat or an insult."""

from __future__ import annotations

import pytest

from dealforge.llm.toxicity import NEGATION_FACTOR, REPORT_FACTOR, TARGET_FACTOR, Grammar


@pytest.mark.parametrize("text", ["I will kill you", "going to hurt them", "matar a usted", "kill one two you", "you will die"])
def test_a_target_completes_a_threat(text):
    assert Grammar({}).text(text) == pytest.approx(0.5 * TARGET_FACTOR)


@pytest.mark.parametrize("text", ["kill the process", "kill one two three you", "kill. you", "you one two three kill"])
def test_no_target_in_reach(text):
    assert Grammar({}).text(text) == 0


def test_factors_are_those_of_the_threat():
    grammar = Grammar({"idiot": 4.0})
    assert grammar.text("never kill you") == pytest.approx(0.5 * TARGET_FACTOR * NEGATION_FACTOR)
    assert grammar.text("kill what you") == grammar.text("kill not you") == pytest.approx(0.5 * TARGET_FACTOR)
    assert grammar.text("wrote kill you") == pytest.approx(0.5 * TARGET_FACTOR * REPORT_FACTOR)
    assert grammar.text("idiot, you") == grammar.text("you idiot") == pytest.approx(4 * TARGET_FACTOR)
    assert grammar.text("idiot") == 4 and grammar.text("you idiot you") == pytest.approx(4 * TARGET_FACTOR)  # a target counts once
    assert grammar.text("hurt and kill them you") == pytest.approx(TARGET_FACTOR)  # both threats, once each
