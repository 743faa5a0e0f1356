import random

import pytest

#: Names the operators use inside; a table may have them too.
CLASHING = "id h row w fp block bucket hash words pos gram kept named marked drop findings c t turns participant value".split()


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, a very long one, ties, repeated rows, a null key, white space and letters beyond ASCII."""
    rng = random.Random(7)
    long_text = " ".join(rng.choice("alpha beta Gamma été übung x1 ## 42".split()) for _ in range(30_000)).replace("42 ", "42\n")
    passage = " ".join(f"w{i}" for i in range(60))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\r "),
        (4, "Refund the order.\nrefund the ORDER. \n\nÉtude Ünder x"),
        (5, long_text),
        (6, f"before {passage} after"),
        (7, f"{passage}\n{passage}"),
        (8, "Same text here\nRefund the order."),
        (8, "Same text here\nRefund the order."),
        (9, "Same text here\nRefund the order."),
        (None, "no key, token: abc123DEF456ghi789"),
        (None, "no key, token: abc123DEF456ghi789"),
        (10, "one"),
        (11, "two words"),
        (12, "A" * 5000 + " " + "🤦 emoji é" * 3),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """The rows as prompts, with columns whose names the operators use inside."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(*r, "src", "en", "host.example", *["x"] * len(CLASHING)) for r in edge_rows]
    return spark.createDataFrame(rows, f"prompt_id long, text string, owner string, repository string, host string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")


def order(rows):
    """Rows in an order that nulls do not break."""
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))
