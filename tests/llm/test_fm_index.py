from collections import Counter

import numpy as np
import pytest

from slate.llm.fm_index import FMIndex, repeated_intervals


def _text(rng, sequences, letters):
    parts = [rng.integers(1, letters + 1, n) for n in sequences]
    return parts, np.concatenate([np.append(p, 0) for p in parts])


@pytest.mark.parametrize("letters", [1, 2, 5, 300])
def test_backward_search_counts_every_pattern(letters):
    rng = np.random.default_rng(letters)
    _, text = _text(rng, [50, 1, 80, 7], letters)
    index = FMIndex(text, 12)
    want = Counter(tuple(text[i:i + n]) for n in range(1, 12) for i in range(len(text) - n + 1))
    for pattern, n in want.items():
        if 0 in pattern:
            continue
        low, high = np.array([0]), np.array([len(text)])
        for s in reversed(pattern):
            low, high = index.back(np.array([s]), low), index.back(np.array([s]), high)
        assert high[0] - low[0] == n, pattern


@pytest.mark.parametrize("seed", range(40))
def test_repeated_intervals_cover_exactly_the_repeated_windows(seed):
    rng = np.random.default_rng(seed)
    letters = int(rng.choice([2, 3, 50, 400]))
    parts, _ = _text(rng, rng.integers(1, 60, 12), letters)
    for _ in range(6):  # shared passages with changes
        a, b = rng.integers(0, 12, 2)
        n = min(len(parts[a]), int(rng.integers(5, 40)))
        parts[b] = np.concatenate([parts[b], parts[a][:n]])
        if rng.random() < 0.5:
            parts[b][rng.integers(0, len(parts[b]))] = letters
    text = np.concatenate([np.append(p, 0) for p in parts])
    lengths = np.array([len(p) for p in parts])
    begins = np.append(0, np.cumsum(lengths + 1))[:-1]
    least = int(rng.integers(3, 20))
    got = set()
    for q, a, b in repeated_intervals(FMIndex(text, least), text, begins, lengths, least):
        got |= {(q, i) for i in range(a, b - least + 1)}
    count = Counter(tuple(p[i:i + least]) for p in parts for i in range(len(p) - least + 1))
    want = {(q, i) for q, p in enumerate(parts) for i in range(len(p) - least + 1) if count[tuple(p[i:i + least])] > 1}
    assert got == want
