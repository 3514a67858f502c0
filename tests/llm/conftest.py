import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words, lexicon=300):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(lexicon)]
    return " ".join(r.choice(vocabulary) for _ in range(words))


def hard_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies and odd characters."""
    base = prose(1, 400)
    texts = [base, base, base + " x", base.replace(" ", "\n"), None, "", " \t\n", "one", "one two three", "Ünïcödé 漢字 😀 <|endoftext|> it's  'tis ''", prose(2, 40_000), prose(3, 90), prose(3, 90).upper(), "zz" * 900, "12345 67890"]
    rows = [(i, t, ["en", "de", "fr", None][i % 4], [f"s{i % 3}", None][i % 5 == 4], len(t) if t else None) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[7], (None, base, None, None, None), (None, None, None, None, None), (500, base, "en", "s0", 1)]


@pytest.fixture(scope="session")
def hard(spark):
    """The rows, and a table of them with extra columns under names that the operators add."""
    rows = hard_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("fingerprint", "component_id", "lang_pred", "score", "keep_id", "kept", "group_size", "size", "target", "taken", "position", "rule", "host", "__h", "spans")
    for n in names:
        df = df.selectExpr("*", f"'clash' as `{n}`")
    return rows, df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
