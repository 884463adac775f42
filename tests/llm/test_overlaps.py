"""Overlaps with short test items, against a comparison of all stretches."""

import random
from itertools import combinations

import pytest

from nearfield.llm import decontaminate


def overlap(same, tokens):
    """Whether some stretch of `same` has enough matches and four fifths of them."""
    ends = range(len(same) + 1)
    return any(sum(same[a:b]) >= min(13, -(-4 * tokens // 5)) and 5 * sum(same[a:b]) >= 4 * (b - a) for a in ends for b in ends if a < b)


@pytest.mark.parametrize("tokens", [*range(1, 21), 26, 30])
def test_substitutions(tokens):
    item = [f"w{i}" for i in range(tokens)]
    block = decontaminate.TestItems([(1, " ".join(item))])
    rng = random.Random(tokens)
    for n in range(min(tokens, 5) + 1):
        places = list(combinations(range(tokens), n))
        for some in places if len(places) <= 300 else rng.sample(places, 300):
            text = ["before", *("other" if i in some else w for i, w in enumerate(item)), "after"]
            found = block.overlaps(" ".join(text))
            assert bool(found) == overlap([i not in some for i in range(tokens)], tokens), (tokens, some)
