import pytest

TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "The cat, the dog and THE bird.",
    "The cat, the dog and THE bird.",
    "Füße çà été 12 don't e-mail",
    "word " * 3000,
    " ".join(f"w{i}" for i in range(20000)),
    "x" * 30000,
    "mail jane.doe@example.org or 10.0.0.1, card 4111 1111 1111 1111, +1 (555) 123-4567",
    "Licensed under the Apache License, Version 2.0. All rights reserved. CC BY 4.0, GNU General Public License",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, blanks, repeats, long texts, and columns that clash with those that operators add."""
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "en", 7, "x") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "s0", "en", 7, "x"), (None, "no id at all", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int, label string").repartition(3)
