"""Landmarks with more languages than LANDMARKS."""

import numpy as np

from tritmarts.llm import language


def test_every_language_has_landmarks():
    draw = np.random.default_rng(1)
    rows = []
    for i in range(270):
        own = np.zeros(language.BINS, bool)
        own[draw.choice(language.BINS, 60, replace=False)] = True
        rows += [(f"l{i:03d}", np.packbits(own))] * 2
    model = language.fit(rows)
    assert len(model.languages) == 270
    last = np.unpackbits(rows[-1][1]).astype(np.float32) @ model.weights
    assert model.languages[int(last.argmax())] == "l269" and last.max() > 0
