"""Small documents with every awkward case the operators have to stand."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, key double, fp long, items string"


def texts(n: int = 60, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    stock = [f"{a}{b}" for a in ("the", "of", "ea", "in", "lo", "ra") for b in ("", "t", "nd", "ing", "ou", "é")]
    return ["\n".join(" ".join(r.choice(stock) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))) for _ in range(n)]


def rows() -> list[tuple]:
    own = texts()
    own += [own[0], own[1].upper(), own[2] + " tail", "", "   \t\n ", "one", "One two\x0bthree", None, None, "x " * 30000, "12 34 -- !!", "a\n\n\na"]
    found = [(i, t, ["en", "fr", None][i % 3], [f"s{i % 4}", None][i % 9 == 0], len(t or ""), 1, 0.5, 7, "x") for i, t in enumerate(own)]
    return [*found, found[5], (None, "no id here", "en", None, None, None, None, None, None), (5, "another text of the same id", None, "s1", 0, 0, 0.0, 0, "")]


def docs(spark, few: list[tuple] | None = None):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame(rows() if few is None else few, COLUMNS)


def simple(spark, own: list):
    """Documents 0, 1, ... with these texts."""
    return docs(spark, [(i, t, "en", "s", 0, 0, 0.0, 0, "") for i, t in enumerate(own)])
