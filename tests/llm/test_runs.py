"""Stored record places of the suffix operator against a plain search of every window."""

import numpy as np
import pytest

from lanternlog.llm import suffix_dedup as sd


@pytest.mark.parametrize("length", [50, 300])
@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_runs_are_read_back(monkeypatch, length, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, n).astype(np.uint8) for n in (length, length + 1, 500, 3000)]
    texts += [np.full(1000, 97, np.uint8), np.frombuffer(b"abcab" * 300, np.uint8)]
    for data in texts:
        grams = sd.gram_hashes(data)
        width = length - sd.GRAM + 1
        want = [grams[i : i + width].min() for i in range(len(data) - length + 1)]
        cover, first, n = sd.read_runs(data, sd.runs(data, length), length)
        assert n.max() <= sd.MOST_RUN and first.tolist() == (np.cumsum(n) - n).tolist()
        assert np.repeat(cover, n).tolist() == want
