"""Documents with every oddity, and helpers to compare with plain Python."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, extra: str = ""):
    """Nulls in every column, empty and long texts, ties, repeated rows; `extra` is a column with a clashing name."""
    long = "Lorem ipsum dolor sit amet. " * 6000
    rows = [
        (1, "One two three four five six seven.", "en", "a", 34),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (None, "No id but some words here.", "en", "b", 26),
        (None, None, None, None, None),
        (4, long, "la", "b", len(long)),
        (5, "One two three four five six seven.", "en", "a", 34),
        (6, "Éa ñ ß 漢字 😀 \t\x0b\n\n ", "xx", "c", 19),
        (7, "x" * 50_000, "en", "c", 50_000),
        (8, "9" * 20_000, "en", "c", 20_000),
        (9, "same row", "en", "c", 8),
        (9, "same row", "en", "c", 8),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", f"'mine' AS {extra}") if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rnd: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def components(n: int, links: set[tuple[int, int]]) -> list[int]:
    """The smallest number that each is connected to."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
