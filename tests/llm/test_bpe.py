"""Byte-pair encoding against the tokenizers library, and decoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tritmarts.llm import bpe

SF = "/root/testdata/sf0.01"
ODD = ["", "Hello  World!", "it's we'll 1234 a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|endoftext|>", "\x1c\x1d x\x1fy",
       "İÉ ÅÅ ﬁ\x00 ​　!?…", "ΑΣ ς日本語😀", "x" * 20000, "ab" * 3001 + "é" * 999, "́a ́", "' 's't'RE",
       " \n\t  ", "a\x85b\xa0c d", "!" * 300 + "0" * 300]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


def plain(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_merges_go_by_rank_then_place():
    pairs = bpe.byte_pairs()
    draw = random.Random(5)
    for _ in range(300):
        symbols = [pairs.vocabulary[c] for c in draw.choices("aehinrst", k=draw.randint(1, 40))]
        naive = list(symbols)
        while True:
            found = [(pairs.merges[p][0], i) for i, p in enumerate(zip(naive, naive[1:])) if p in pairs.merges]
            if not found:
                break
            _, i = min(found)
            naive[i:i + 2] = [pairs.merges[naive[i], naive[i + 1]][1]]
        assert pairs.merged(symbols) == naive


def test_texts_of_all_kinds(library):
    pairs = bpe.byte_pairs()
    draw = random.Random(3)
    letters = "aAeéßẞÑñİıΣσДд中あ🙂①²'’̧́‍﻿ .,!?<|>0١\n"
    for text in ODD + ["".join(draw.choices(letters, k=draw.randint(1, 60))) for _ in range(2000)]:
        ids, back = plain(library, text)
        assert pairs.encode(text).tolist() == ids, repr(text)
        assert pairs.decode(ids) == back


def test_every_code_point(library):
    pairs = bpe.byte_pairs()
    for first in range(0, 0x110000, 512):
        chars = [chr(c) for c in range(first, first + 512) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b 1{c}! {c}́ " for c in chars)
        assert pairs.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(first)


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 7)
    pairs = bpe.BytePairs(public_tokenizers.path(bpe.TOKENIZER))
    text = " ".join(f"word{i}" for i in range(200)) + " " + "long" * 100
    assert pairs.encode(text).tolist() == plain(library, text)[0]
    assert len(pairs.parts) <= 7 and len(pairs.words) <= 7 and "long" * 100 not in pairs.parts


def test_files_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.BytePairs(public_tokenizers.path("byte_bpe_50k.json"))


def test_rows(spark, library):
    rows = [(i if i != 3 else None, t, "x", [1]) for i, t in enumerate([None, *ODD, "same", "same"])] + [(5, "same", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids array<int>")
    encoded = bpe.encode(df)
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in encoded.collect())
    assert got == sorted((r[0] is None, r[0] or 0, plain(library, r[1])[0]) for r in rows)
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in bpe.decode(encoded).collect())
    assert back == sorted((r[0] is None, r[0] or 0, plain(library, r[1])[1]) for r in rows)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_digests_of_the_sample(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids, back = plain(library, r.text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                 hashlib.sha256(back.encode()).hexdigest())
