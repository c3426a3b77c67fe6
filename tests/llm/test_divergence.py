"""The divergence audit against sums over all terms in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tritmarts.llm import divergence

TERM = re.compile("[" + "A-Za-z" + chr(0x80) + "-" + chr(0x10FFFF) + "]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_audit(rows, min_docs=3, top=200):
    rows = [(la or "", so or "", Counter(TERM.findall(lower(t or "")))) for la, so, t in rows]
    in_docs, in_lang, in_group = Counter(), Counter(), defaultdict(Counter)
    for la, so, terms in rows:
        in_group[la, so].update(terms)
        for t, n in terms.items():
            in_docs[la, t] += 1
            in_lang[la, t] += n
    kept = {k for k, n in in_docs.items() if n >= min_docs}
    out = []
    for (la, so), counts in in_group.items():
        terms = sorted(t for lang, t in kept if lang == la)

        def share(count_of):
            whole = sum(count_of[t] for t in terms) + len(terms)
            return {t: 1 + 10**9 * (count_of[t] + 1) // whole for t in terms}
        p, usual = share(counts), share({t: in_lang[la, t] for t in terms})
        parts = {"pair": [(sum((p[t] - q[t]) ** 2 // q[t] for t in terms), other)
                          for lang, other in in_group if lang == la and other != so
                          for q in [share(in_group[lang, other])]],
                 "term": [((p[t] - usual[t]) ** 2 // usual[t], t) for t in terms if counts[t] and p[t] > usual[t]]}
        for part, told in parts.items():
            told.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(la, so, part, item, value, i) for i, (value, item) in enumerate(told, 1) if part == "pair" or i <= top]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def made_rows(seed, n=150):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" + draw.choice(["", "É", "ß", "日", "x" * 30]) for i in range(120)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(n):
        source = draw.choice(["hot"] * 5 + [f"s{i}" for i in range(7)] + [None])
        rows.append((draw.choice(["en", "en", "fr", None]), source, draw.choice([" ", ", ", "1"]).join(
            draw.choices(words, weights, k=draw.randint(0, 200))).title()))
    return rows


@pytest.mark.parametrize("cells,strip", [(divergence.BLOCK_CELLS, divergence.STRIP_GROUPS), (40, 3)])
def test_audit(spark, cells, strip):
    rows = made_rows(1) + [("en", "mute", None), ("en", "mute", "12 34"), ("xx", "a", "once only"), ("xx", "b", ""), ("xx", None, None),
                           ("en", "hot", "Long " * 30000 + "y" * 9000), ("alone", "one", "a a a"), ("alone", "one", "a b"), ("alone", "one", "a")]
    rows += [rows[0]] * 3
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "lang string, source string, text string, term string, n int")
    want = plain_audit(rows)
    assert {r[2] for r in want} == {"pair", "term"}
    assert found(divergence.audit(df, block_cells=cells, strip_groups=strip)) == want


def test_top_terms_of_ties(spark):
    rows = [("en", s, "a b c d e f") for s in "pqr"] + [("en", "p", "a b c d e f g h")] * 3
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(divergence.audit(df, top_terms=2, block_cells=1)) == plain_audit(rows, top=2)


def test_slices_end_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE", 7)
    text = ("aaaa bb " + "c" * 20 + " é日 d" * 9).encode()
    parts = list(divergence._slices(text))
    assert b"".join(parts) == text and len(parts) > 3
    assert [t for p in parts for t in divergence._TERM.findall(p)] == divergence._TERM.findall(text)


def test_shares_are_exact():
    counts = [0, 1, 10**6, 10**12, 2**52 - 5]
    for whole in (1 + max(counts), 2**52, 2**53 - 1):
        assert divergence.shares(np.array(counts), whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in counts]


def test_empty_table(spark):
    df = divergence.audit(spark.createDataFrame([], "lang string, source string, text string"))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and df.collect() == []
