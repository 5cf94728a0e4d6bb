import pytest

LONG = " ".join(f"w{k % 701}x{k % 13}" for k in range(20_000))

TEXTS = [None, "", " ", "one two", "a b c d e f g"]


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash with internal ones."""
    rows = [(1, None, "k"), (2, "", None), (3, " \n ", "k"), (None, "one two three", "k"), (4, "same text here " * 20, "a"), (5, "same text here " * 20, "a"), (5, "same text here " * 20, "a"), (6, LONG, "z"), (None, None, None)]
    names = "row h label n bucket _id m pattern p_good _m _pattern _key stay_id stay_key _stay_id _stay_key text_key gone cut_key cut_id _shoal_gone size shard slot _part _n _before rank length start class_id kept best"
    return spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("doc_id", "text", "key", *[f"{k} AS {name}" for k, name in enumerate(names.split())])


@pytest.fixture
def none(odd):
    return odd.limit(0)
