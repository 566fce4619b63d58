import pytest

# null doc_id, null and empty text, no word, repeated rows, a long text, ties; and columns whose names the operators use inside
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, fp string, node string, own string, leaks string, ids string, score string"
LONG = "der lange satz mit vielen worten geht immer weiter und weiter ohne ende " * 3000


def rows(texts):
    return [(i, t, "de", "s", None if t is None else len(t), "a", "b", "c", "d", "e", "f", "g") for i, t in texts]


EDGE = [(0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, LONG), (5, "Einmal ist keinmal.\n" * 40), (5, "Einmal ist keinmal.\n" * 40), (None, "no id here at all, only words"), (6, "ties\nties\nties"), (7, "日本語のテキスト 😀 é")]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(EDGE), COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts: spark.createDataFrame(rows(texts), COLUMNS)
