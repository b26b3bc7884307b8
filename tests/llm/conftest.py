import random

import pytest

#: Columns whose names the operators use themselves.
CLASHING = ["n_words", "kept", "fp", "doc", "g", "bucket", "size", "score", "text_hash", "held_out", "copy", "_id", "n_removed", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, repeated ids."""
    draw = random.Random(5)
    words = ["the", "of", "and", "Haus", "maison", "città", "naïve", "日本語", "x" * 40, "a", "b", "|", "***", "😀"]
    prose = lambda n: " ".join(draw.choices(words, k=n))
    passage = " ".join(f"w{k}" for k in range(30))
    copy = prose(60)
    texts = [None, "", " \n\t ", "one", copy, copy, copy + " end", prose(5000), passage, prose(25) + " " + passage, passage + "\n" + passage, "line a\nline a\nline a\nline b", "ha " * 400, "\u0085  odd\x1cspace", "tail<|endoftext|>of text <|endoftext|>", "under the MIT license. CC BY-NC, Apache License, Version 2.0"]
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 3 else f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (4, prose(40), "en", "src1", 7), (None, prose(50), None, None, None), (None, copy, None, "src0", 1)]
    return [(*r, *("clash" for _ in CLASHING)) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def as_table(tmp_path_factory):
    """Write a DataFrame as the documents of a folder."""

    def write(df, **others):
        folder = str(tmp_path_factory.mktemp("sf"))
        for name, table in {"documents": df, **others}.items():
            table.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
