import random

import pandas as pd

from quillmine import rules
from quillmine.operators.blocks import pieces
from quillmine.operators.chunks import chunk_pages, split_text


def test_short_text_is_one_stripped_chunk():
    assert split_text("  one line \n") == ["one line"]


def test_text_without_separators_is_cut_into_windows():
    text = "".join(chr(97 + i % 26) for i in range(2500))
    got = split_text(text, 1000, 200)
    want = [text[s:s + 1000] for s in range(0, 2500 - 200, 800)]
    assert got == want


def test_coarsest_separator_wins_and_leads_the_next_piece():
    text = "a" * 60 + "\n\n" + "b" * 60 + "\n" + "c" * 10
    assert split_text(text, 100, 20) == ["a" * 60, "b" * 60 + "\n" + "c" * 10]
    assert split_text("one. two. three", 9, 0) == ["one. two", ". three"]


def test_piece_of_exactly_the_size_goes_one_level_down():
    text = "x" * 50 + "\n\n" + "y" * 98
    assert split_text(text, 100, 0) == ["x" * 50, "y" * 98]


def test_overlap_carries_whole_pieces():
    text = " ".join(f"w{i:02d}" for i in range(40))
    got = split_text(text, 40, 12)
    assert all(len(c) <= 40 for c in got)
    for left, right in zip(got, got[1:]):
        assert right.split()[0] in left.split()[-3:]


def test_nothing_is_lost_without_overlap():
    rng = random.Random(7)
    for _ in range(50):
        text = "".join(rng.choice(["ab", "c", " ", "\n", "\n\n", ". ", ", ", "word"]) for _ in range(rng.randint(1, 900)))
        got = split_text(text, 80, 0)
        assert all(0 < len(c) <= 80 for c in got)
        assert "".join("".join(c.split()) for c in got) == "".join(text.split())


def test_chunk_rows(spark):
    long = "Sentence number one. " * 150
    pages = spark.createDataFrame(
        [("u1", "t", "generic", long), ("u2", "t", "jira", "  \n"), ("u3", "t", "jira", "x")],
        "page_url string, title string, source_type string, markdown string",
    )
    rows = chunk_pages(pages).sort("page_url", "chunk_index").collect()
    first = [r for r in rows if r.page_url == "u1"]
    assert [r.text for r in first] == split_text(long)
    assert [r.chunk_index for r in first] == list(range(first[0].total_chunks))
    start = 0
    for r in first:
        assert (r.char_start, r.char_end) == (start, start + len(r.text))
        start += len(r.text) - rules.CHUNK_OVERLAP
    assert [r.page_url for r in rows if r.page_url != "u1"] == ["u3"]


def test_batches_are_cut_by_characters():
    """Rows keep their order, nulls count nothing, a long text stands alone; results leave the task piece by piece."""
    texts = ["a" * 40, None, "b" * 70, "c" * 500, "", "d" * 10, "e" * 95]
    batches = [pd.DataFrame({"n": range(7), "t": texts}), pd.DataFrame({"n": [], "t": []}), pd.DataFrame({"n": [7], "t": [None]})]
    got = list(pieces(iter(batches), "t", chars=100))
    assert [n for part in got for n in part["n"]] == list(range(8))
    assert len(got) > 4 and all(sum(len(t or "") for t in part["t"][:-1]) <= 100 + max(len(t or "") for t in part["t"]) for part in got)
    many = pd.DataFrame({"n": range(1000), "t": ["x" * 10_000] * 1000})
    assert max(len(part) for part in pieces(iter([many]), "t")) <= 106
