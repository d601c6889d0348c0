from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "id long, row string, size int, hash string, spans int, drop_lines int, class int, found int"


@pytest.fixture
def docs(spark):
    """Frame of (doc_id, text[, source]) rows with extra columns whose names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "r", 3, "h", 1, 2, 4, 5) for r in rows]
        return spark.createDataFrame(full, f"{DOC}, {CLASH}")
    return make


@pytest.fixture
def odd_rows():
    """NULLs, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (None, "a row without an id"), (4, long), (5, "same text in two rows"),
            (6, "same text in two rows"), (7, "repeated row"), (7, "repeated row"), (None, None)]
