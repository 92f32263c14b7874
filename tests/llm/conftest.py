import random

import pytest

SYLLABLES = "ba ce di fo gu ha ke li mo nu pa re si to vu wa xe yi zo lu".split()


class Texts:
    """Random prose, the same for the same seed."""

    def __init__(self, seed=1):
        self.rng = random.Random(seed)

    def word(self):
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, n):
        return [self.word() for _ in range(n)]

    def prose(self, n, line=12):
        words = self.words(n)
        return "\n".join(" ".join(words[k : k + line]) for k in range(0, n, line))

    def edited(self, text, share):
        """Some words replaced by others."""
        return " ".join(self.word() if self.rng.random() < share else w for w in text.split(" "))


@pytest.fixture
def prose():
    return Texts()


@pytest.fixture
def documents(spark):
    """Rows ``(doc_id, text[, source])`` as documents with columns whose names clash."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        rows = [(*r, 1, "x", 2.0, "y") for r in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, key int, rep string, size double, row string"
        return spark.createDataFrame(rows, kinds)

    return make
