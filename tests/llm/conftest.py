import pytest

#: Extra columns whose names clash with working names of the operators.
CLASH = ("key", "value", "part", "line", "node", "h", "n_lines", "log_weight", "declared", "ids", "__key")
TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "Ünïcode words, and “marks”: 漢字 😀 it's fine.\nSecond line here, quite long enough.\n\nSecond line here, quite long enough.",
    "The same text twice, with a line that others share.\nA LINE THAT MANY DOCUMENTS SHARE  \nend",
    "The same text twice, with a line that others share.\nA LINE THAT MANY DOCUMENTS SHARE  \nend",
    "another\n  a line that many documents share\nlast",
    "third\na line that many documents SHARE\tx\na line that many documents share",
    "word " * 20_000 + "\n" + "x" * 70_000,
    "  two  blanks\r\n\x0b and \x1c separators \x85 here",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, repeated and very long texts; null and repeated ids; clashing columns."""
    rows = [(i if i != 3 else None, t, *(["z"] * len(CLASH))) for i, t in enumerate(TEXTS)]
    rows.append(rows[5])
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
