import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, leak string, n_tokens string, rank string, "
    "__id string, __hash string, __n string, __secrets string, __quality string, _leak string, score string, fp string, n_words string, "
    "counts map<string, int>"
)


def with_extras(spark, rows):
    """Documents from (doc_id, text), with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "s", "l", "n", "r", *"abcdefghi", {"x": 1}) for i, t in rows], SCHEMA)


EDGE = [
    (1, None), (2, ""), (None, "no id here"), (3, "Word " * 30_000), (4, "twice the same"), (4, "twice the same"), (4, "same id, other text"),
    (5, "\n\t  "), (6, "Ünïcödé wörds, 中文字符 and 🙂 emoji wide space"), (7, "a"), (-8, "negative id"), (None, None),
]


@pytest.fixture
def make(spark):
    return lambda rows: with_extras(spark, rows)


@pytest.fixture
def edge(spark):
    return with_extras(spark, EDGE)
