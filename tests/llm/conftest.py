import random

import pytest

WORDS = ["the", "of", "and", "in"] + [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def corpus():
    """doc_id, text: prose, exact and near copies, shared passages, repeated lines, runs of a word, odd white space, nulls."""
    dice = random.Random(5)
    prose = lambda n: " ".join(dice.choice(WORDS) for _ in range(n))
    rows, passage = [], prose(90)
    for i in range(60):
        rows.append(prose(dice.randrange(1, 300)))
    for i in range(12):
        rows.append(prose(dice.randrange(5, 60)) + " " + passage + "\n" + prose(dice.randrange(5, 60)))
    base = prose(250).split()
    for i in range(14):
        words = list(base)
        for _ in range(i):
            words[dice.randrange(len(words))] = f"edit{i}{dice.randrange(9)}"
        rows.append(" ".join(words))
    rows += [rows[3], rows[3], rows[3].upper(), rows[61]]
    rows += [("same line of words here\n" * 40), "again " * 200, "again " * 75, "a b " * 60, "x" * 2000, "y" * 399, "y" * 400, "\t lead\x0band\x0c tail \r\n", "é è ü 中文 \u00a0 ünï " * 30, "", None, " \n ", "one", "One", "two words"]
    rows.append(prose(30) + " " + rows[-10] + passage)
    return list(enumerate(rows))


@pytest.fixture
def docs(spark, corpus):
    """With columns of names that operators use inside."""
    return spark.createDataFrame([(i, t, "key", 1, len(t or "")) for i, t in corpus], "doc_id long, text string, key string, start int, id int").repartition(5)
