import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, rid string, score string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, and columns with clashing names."""
    import random

    rnd = random.Random(4)
    words = ["the", "of", "and", "Über", "año", "stone", "river", "blue", "seven", "cart", "mill", "é", "x1"]
    long = lambda n: " ".join(rnd.choice(words) + (rnd.choice([".", ",", ""])) + str(rnd.randint(0, 99)) for _ in range(n)) + "."
    shared = long(90)
    base = [long(120) for _ in range(6)]
    texts = [*base, base[0], base[1] + " tail.", long(30) + "\n" + shared + "\n" + long(25), long(35) + " " + shared, None, "", " \n ", "one", "a\tb", "#$%& | x", long(6000), "same same same same " * 60, "😀 ñ \x1c y"]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "k", "f", "r", "z") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, "null id text here", "en", None, 1, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
