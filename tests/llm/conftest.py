import random

import pytest

from knownby.llm.tables import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


def prose(seed, words, vocabulary=400):
    """Invented words: a vocabulary drawn from the seed of the caller."""
    pick = random.Random(seed)
    syllables = ["ka", "to", "mi", "re", "su", "no", "li", "fa", "be", "du"]
    return " ".join("".join(syllables[(w // 10**i + w) % 10] for i in range(2 + w % 2)) + str(w % 7 or "") for w in (pick.randrange(vocabulary * 50) for _ in range(words)))
