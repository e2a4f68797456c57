"""Small tables with awkward rows."""

from __future__ import annotations

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and to in river stone light wind over under garden window table seven blue green tall ü né".split()) + rng.choice(["", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    rng = random.Random(3)
    texts: list[str | None] = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " more", None, "", "   \n\t ", "word", "a b", "x " * 3000, prose(rng, 4000), "\\ [INST]", "one\ntwo\none\n\ntwo"]
    found = [(i, t, ("en", "de", "xx", None)[i % 4], ("s1", "s2", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return found + [found[2], (None, "no id " * 20, "en", "s1", 120)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows beside columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(7).alias(c) for c in ("size", "score", "fp", "spans", "items", "members", "place", "line", "h1", "kind", "id", "_text")])
