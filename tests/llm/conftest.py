import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

LONG = "lorem ipsum dolor sit amet consectetur " * 60_000
PASSAGE = "shared passage of many words that stands in more than one text, word for word, " * 4
#: Null and empty values, a very long text, repeated rows, ties, no letters, and one word.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again. " + PASSAGE, "en", "b"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, LONG, "la", "a"),
    (5, "einzig", "de", "b"),
    (5, "einzig", "de", "b"),
    (6, "123 456 !!! ### ***", "en", None),
    (7, PASSAGE + " something else follows here", "en", "ü"),
    (None, "null id with some text of its own", "en", "b"),
    (9, " \t\n ", None, "a"),
    (10, "Déjà vu — naïve façade, 中文 und Ümläute 😀 " * 20, "fr", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns whose names operators use inside.
CLASH = ("fp", "key", "n", "size", "target", "taken", "bucket", "content", "stratum", "n_words", "component_id", "score", "_tk", "rk", "c", "flags", "n_chars")


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for i, name in enumerate(CLASH):
        df = df.selectExpr("*", f"{i}L as {name}" if name != "n_chars" else "length(text)::long as n_chars")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
