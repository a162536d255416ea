import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from counterbook.llm import queries, word_bpe
from tests.llm.conftest import SF

STRANGE = [
    "Hello<|endoftext|>World <|startoftext|>", "été café x\x85y\x1cz", "İstanbul ǅ ß ΣΣ 你好 123٣ it's WE'LL don't 'S",
    "​﻿ a　b  c", "ª²½1/2 _x_ $%^", "\U0001f600\U0001f468‍\U0001f469 한국", "< |endoftext|> <|ENDOFTEXT|>", "\x00\x01\x7f",
]


def library(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)


def test_ids_and_texts_are_the_librarys(spark, texts):
    rows = queries.QUERIES["op2_word_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, ids, decoded = library(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_strange_and_odd_texts_over_many_blocks(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(word_bpe, "BLOCK_CHARS", 4000)
    monkeypatch.setattr(word_bpe, "CHUNK", 2)
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(STRANGE)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "words").unionByName(more, allowMissingColumns=True)
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded) for r in word_bpe.encode(docs, queries.vocabulary()).collect())
    assert got == sorted((str(i), *library(t)) for i, t in [*odd_rows, *((100 + k, t) for k, t in enumerate(STRANGE))])


def test_empty_table(odd):
    assert word_bpe.encode(odd.limit(0), queries.vocabulary()).count() == 0


def test_packed_numbers_round_trip():
    for numbers in ([], [0], [1, 2**32 - 1, 70000]):
        assert list(word_bpe.unpacked(word_bpe.packed(numbers))) == numbers


def test_every_character_of_the_fast_path_is_the_librarys(spark):
    rows = [(c, "{0} BAK{0} {0}BAK b{0}k {0}1 {0}{0}".format(chr(c))) for c in range(word_bpe.LATIN_END)] + [(1000 + c, chr(c)) for c in range(word_bpe.LATIN_END)]
    docs = spark.createDataFrame([*rows, (2000, "BAK\u018f"), (2001, "\u0186kwan \u0190nyin")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded) for r in word_bpe.encode(docs, queries.vocabulary()).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    assert got == {i: (len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)) for i, ids in want.items()}
