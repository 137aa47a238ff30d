import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


HARD_TEXTS = [
    None, "", " ", "  two  spaces ", "\n\n", "a", "the the the", "Ünïcode façade ß Σίσυφος İ", "日本語 のテキスト",
    "<|endoftext|> in <s> text", "don't we'll\tTAB\x0bVT\x1cFS\x85NEL\xa0NBSP", "▁ literal", "x" * 5000,
    ("lorem ipsum dolor sit amet consectetur " * 4000).strip(), "a\x00b", "é combining ​ zero", "# # #",
]


@pytest.fixture()
def hard_docs(spark):
    """Null, empty, very long and repeated rows, and columns whose names clash with the operators' own."""
    clash = (1, 2.0, "x", 3, True, "y")
    rows = [(i, t, "en", "s", 0, *clash) for i, t in enumerate(HARD_TEXTS)]
    rows += [(3, HARD_TEXTS[3], "en", "s", 0, *clash), (None, "no id", None, None, None, *clash)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "n_tokens long, score double, found string, row long, kept boolean, `a.b` string").repartition(3)
