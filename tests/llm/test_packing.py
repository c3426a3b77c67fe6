"""Best-fit packing against packing one document at a time."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tritmarts.llm import packing


def one_by_one(lengths, capacity):
    """Number of sequences of best fit in falling order of length."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            best = min(fits)
            rooms.remove(best)
        else:
            best = capacity
        rooms.append(best - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_sweep_equals_one_by_one(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, draw.choice([5, 20, 64])) for _ in range(300)]
    plan = packing.sweep(Counter(lengths), 64)
    used = {s for size, steps in plan.items() for st in steps for r in range(st.since, st.until)
            for s in [st.first + (r - st.since) // st.each]}
    assert len(used) == one_by_one(lengths, 64)


def check_layout(rows, capacity=1024):
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_documents(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(4)
    texts = [None, "", "a", "<|endoftext|> inside", "日本語 текст ñandú  x\x1fy z  \n", "x" * 50000, "same", "same"]
    texts += [" ".join(draw.choice(["the", "Word", "straße", "42", "it's", "\n\n", "€5"]) for _ in range(draw.randint(1, 1500)))
              for _ in range(60)]
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string, segment int")
    got = packing.pack(df, with_ids=True).collect()
    check_layout(got)
    assert len({r.sequence_id for r in got}) == one_by_one([r.length for r in got], 1024)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for doc_id, text, *_ in rows:
        want = plain.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert sum((list(p.ids) for p in parts), []) == want
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts[:-1]]))
        assert all(p.length == 1024 for p in parts[1:]) and all(p.length <= 1024 for p in parts)
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in parts)


def test_both_libraries_agree_on_sample(spark):
    encode = packing.encoder()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(150).collect():
        assert encode.ids(r.text).tolist() == encode.slow.encode(r.text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
