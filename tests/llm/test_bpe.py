"""BPE by last tokens of prefixes against the tokenizers library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recallforge.llm import bpe
from recallforge.llm._tokens import default_tokenizer
from recallforge.llm.queries import queries

SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", " ", "  ", "\n", "é", "ß", "日本", "🙂", "'s", "'LL", "12", ".", "!!", "\t", "the", "ing", "tion", "<|endoftext|>", "\x00", "हि", " ", " "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder.of(default_tokenizer(), 2)


def test_ids_and_texts_equal_the_library(library, encoder):
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * n for n in range(1, 150)] + [" " * n for n in range(60)] + ["ab" * 20_000, "<|endoftext|>" * 3, "<|endoftext", ""]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x530), r.randrange(0x530, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(20)) for _ in range(2000)]
    ids, ends = encoder.encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, ends[:-1])):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(own).decode() == library.decode(own.tolist(), skip_special_tokens=False)


def test_ids_that_are_no_text_decode_like_the_library(library, encoder):
    r = random.Random(3)
    for _ in range(400):
        ids = [r.randrange(50257) for _ in range(r.randint(1, 9))]
        assert encoder.decode(np.array(ids)).decode() == library.decode(ids, skip_special_tokens=False)


def test_the_last_token_of_every_prefix_is_that_of_its_own_encoding(encoder):
    merges, shown = encoder.merges, encoder.shown
    for word in (" internationalization", "aaaaaaaaaaaaa", "ÄÖÜberraschung", "0000000012345"):
        part = word.encode().decode("latin-1").translate(shown)
        last = merges.last_tokens(part)
        assert [merges.encode(part[: n + 1])[-1] for n in range(len(part))] == last[:-1]


def merged(ranks, parts):
    """BPE as it is defined: the pair of least rank is merged, the leftmost first."""
    parts = list(parts)
    while True:
        found = min(((ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
        if found[0] == 1 << 30:
            return parts
        parts[found[1] : found[1] + 2] = ["".join(parts[found[1] : found[1] + 2])]


def test_random_merge_lists_against_merging():
    r = random.Random(11)
    for _ in range(60):
        vocabulary, merges = {c: i for i, c in enumerate("abc")}, []
        while len(merges) < 25:
            a, b = r.choice(list(vocabulary)), r.choice(list(vocabulary))
            if a + b not in vocabulary and len(a + b) < 9:
                vocabulary[a + b] = len(vocabulary)
                merges.append((a, b))
        own, ranks, names = bpe.Merges(vocabulary, merges), {m: i for i, m in enumerate(merges)}, {i: t for t, i in vocabulary.items()}
        for _ in range(60):
            text = "".join(r.choice("abc") for _ in range(r.randint(0, 24)))
            assert [names[i] for i in own.encode(text)] == merged(ranks, text)


def test_merge_lists_that_make_a_token_twice_are_refused():
    vocabulary = {"a": 0, "aa": 1, "aaa": 2}
    with pytest.raises(ValueError, match="two merges"):
        bpe.Merges(vocabulary, [("a", "a"), ("a", "aa"), ("aa", "a")])


def test_query_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = queries()["op12_bpe_prefixes"](spark, SF).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs["doc_id"])
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got.loc[doc_id].tolist() == [len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()]


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, library):
    rows = [(None, None, "x"), (1, "", "x"), (1, "héllo <|endoftext|> ", "x"), (1, "héllo <|endoftext|> ", "x"), (2, "word " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip_digests(docs, default_tokenizer()).collect()
    assert Counter((x.doc_id, x.n_tokens) for x in got) == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    coded = bpe.encode_documents(docs, default_tokenizer())
    assert sorted((x.doc_id or 0, x.text) for x in bpe.decode_ids(coded, default_tokenizer()).collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.round_trip_digests(docs.limit(0), default_tokenizer()).collect() == []
    assert bpe.round_trip_digests(docs.limit(0), default_tokenizer()).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
