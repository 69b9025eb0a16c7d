import pytest

WORDS = "the of and thorn reve onde stal mire pont graf lume idiot trash lise vaux kort".split()


def words(n, seed):
    import random

    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty, blank and very long texts, repeated rows, clashing columns."""
    base = words(60, 1)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base + " changed", None, None),
        (4, None, "en", "b"),
        (5, "", "de", "b"),
        (6, " \n\t ", "de", "b"),
        (None, base, "en", "c"),
        (None, None, None, None),
        (7, words(30_000, 2), "en", "c"),
        (8, "12 34 !!", "en", None),
        (9, "one two", "en", "d"),
        (10, "Ünïcode   and\x1cmore lines <s>[INST]</s> \\ <|endoftext|>x ▁mark", "fr", "e"),
        (11, "end with blanks   ", "fr", "e"),
    ]
    extra = "score double, judged string, kept_id long, component_id long, mark_of_text long, piece_row int"
    return spark.createDataFrame(
        [(*r, 0.5, "x", 7, 8, 9, 1) for r in rows],
        f"doc_id long, text string, lang string, source string, {extra}",
    )
