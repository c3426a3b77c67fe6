"""The head of the failure cards is ranked once, not by each of its readers."""

import datetime as dt

import pytest

from tritmarts.plans import catalog_cards

DAY = dt.date(2020, 1, 1)


def test_head_is_written_before_it_is_explained(spark, monkeypatch):
    scored = spark.createDataFrame([(c, DAY, c / 10) for c in range(5)], "channel_id long, d date, score double")
    dim = spark.createDataFrame([(c, "n", "t", "s", 1, 1, "o", "p") for c in range(5)],
                                "channel_id long, sensor_name string, sensor_type string, system string, picket int, object_id long, object_name string, parent_name string")
    domains = spark.createDataFrame([(1, 1, 5, True)], "object_id long, picket int, n_channels long, has_thermal boolean")
    monkeypatch.setattr(catalog_cards.World, "dim", dim)
    monkeypatch.setattr(catalog_cards.World, "domains", domains)
    monkeypatch.setattr(catalog_cards, "_fitted", lambda *_: (None, None))
    monkeypatch.setattr(catalog_cards, "_scored_test", lambda *_: scored)
    seen = []

    def contributions(_, head):
        seen.append(head)
        raise StopIteration

    monkeypatch.setattr(catalog_cards.explain, "contributions", contributions)
    with pytest.raises(StopIteration):
        catalog_cards.failure_cards(spark, "rows of this test")
    assert "/failure_head-" in seen[0].inputFiles()[0]
    assert sorted((r.channel_id, r.score, r.dom_size) for r in seen[0].collect()) == [(c, c / 10, 5) for c in range(5)]
