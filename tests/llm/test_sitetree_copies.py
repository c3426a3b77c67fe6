"""Copies of a page do not change what is judged furniture."""

import random

from tritmarts.llm import sitetree


def test_table_of_a_page_with_copies_stays(spark):
    draw = random.Random(3)
    words = lambda n: " ".join(f"w{draw.randrange(9999)}" for _ in range(n))
    page = f"<article><h1>{words(4)}</h1><p>{words(30)}</p><table><tr><td>{words(6)}</table></article>"
    others = [f"<article><h1>{words(4)}</h1><p>{words(30)}</p><div class=more>Read on everywhere</div></article>" for _ in range(9)]
    url = "https://copies.example/"

    def texts(copies):
        rows = [(i, url, page) for i in range(copies)] + [(100 + i, url, h) for i, h in enumerate(others)]
        got = sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        return {r.page_id: r.text for r in got}

    one, six = texts(1), texts(6)
    assert len(one[0].split("\n")) == 3 and all(six[i] == one[0] for i in range(6))
    assert all(six[100 + i] == one[100 + i] and "Read on" not in six[100 + i] for i in range(9))
