"""The threat voter's feature against its pattern on every text."""

import random

from factflow.llm import toxicity


def test_threats_are_found_wherever_the_pattern_matches():
    rng = random.Random(2)
    parts = ["kill", "KILL", "\u212aill", "Hate", "hurt", "de\u017ftroy", "\u017fhut", "up", "shut", "go", "to", "hell", "you", "them", "h\u0131m", "him", "her", "x", "_", "9", "-", "\u0130"]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", "", "\u00a0", "."]) for _ in range(rng.randrange(1, 7)))
        want = toxicity.THREATS.search(text) is not None
        assert ("!threat" in toxicity.features_of(text)) == want, text
        found += want
    assert found > 200
