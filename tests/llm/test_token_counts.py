from collections import Counter

import pytest

from quillmine.llm import token_counts
from quillmine.llm.queries import op1_token_counts, vocabulary
from tests.llm.conftest import clashing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_librarys(docs, texts, library, tmp_path):
    cache = str(tmp_path / "cache")
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, vocabulary(), cache).collect())
    assert got == Counter((i, library(t)) for i, t in texts)


def test_only_misses_are_encoded(spark, docs, library, tmp_path):
    cache = str(tmp_path / "cache")
    version = token_counts.tokenizer_version(vocabulary())
    half = docs.where("doc_id % 2 = 0")
    token_counts.count_tokens(half, vocabulary(), cache).count()
    first = token_counts.stored(spark, cache, version).count()
    token_counts.count_tokens(half, vocabulary(), cache).count()
    assert token_counts.stored(spark, cache, version).count() == first
    assert first < half.count()
    token_counts.count_tokens(docs, vocabulary(), cache).count()
    stored = token_counts.stored(spark, cache, version)
    assert stored.count() == stored.select("digest").distinct().count() > first
    assert token_counts.stored(spark, cache, "another version").count() == 0


def test_a_stored_count_is_trusted(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    one = spark.createDataFrame([(1, "some words")], "doc_id int, text string")
    token_counts.count_tokens(one, vocabulary(), cache).count()
    again = spark.createDataFrame([(2, " some\n\twords ")], "doc_id int, text string")
    assert token_counts.count_tokens(again, vocabulary(), cache).first().n_tokens == 2
    assert token_counts.stored(spark, cache, token_counts.tokenizer_version(vocabulary())).count() == 1


def test_clashing_columns_and_empty_table(docs, tmp_path):
    got = token_counts.count_tokens(clashing(docs.limit(0), "digest", "Content"), vocabulary(), str(tmp_path / "c"))
    assert got.columns == ["doc_id", "Content", "digest", "n_tokens"]
    assert got.count() == 0


def test_block_counts_with_a_small_memory(monkeypatch, texts, library):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "MEMO_WORDS", 50)
    memo, tokenizer = {}, Tokenizer.from_file(vocabulary())
    rows = [" ".join((t or "").split()) for _, t in texts if t and "\x1f" not in t]
    got = [n for block in token_counts._blocks(rows, 3000) for n in token_counts.count_words(tokenizer, memo, block)]
    assert got == [library(t) for t in rows]


def test_query(spark, folder, texts, library):
    rows = op1_token_counts(spark, folder).collect()
    want = Counter((i, len((t or "").encode()), library(t), library(t) > 2048) for i, t in texts if i is not None)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want


def test_lengths_without_a_cache_equal_the_counts(docs, texts, library):
    got = token_counts.token_lengths(clashing(docs, "content", "n_tokens"), vocabulary())
    assert got.columns == ["doc_id", "n_tokens"]
    assert Counter(map(tuple, got.collect())) == Counter((i, library(t)) for i, t in texts)


def test_a_file_that_keeps_white_space_is_refused(docs, tmp_path):
    import public_tokenizers

    for name in ("byte_bpe_50k.json",):
        with pytest.raises(ValueError, match="white space"):
            token_counts.count_tokens(docs, public_tokenizers.path(name), str(tmp_path / "c"))
        with pytest.raises(ValueError, match="white space"):
            token_counts.token_lengths(docs, public_tokenizers.path(name))


def test_another_splitter_takes_the_librarys_whole_path(docs, texts, tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(vocabulary(), encoding="utf-8") as file:
        settings = json.load(file)
    assert token_counts.known_pieces(settings)
    settings["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]"
    assert not token_counts.known_pieces(settings)
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as file:
        json.dump(settings, file)
    library = Tokenizer.from_file(other)
    got = Counter(map(tuple, token_counts.token_lengths(docs, other).collect()))
    assert got == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
