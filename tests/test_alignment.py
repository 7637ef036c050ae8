import time

import numpy as np

from ledgerloom.operators import recognition
from ledgerloom.operators.recognition import _coded, _dense, _meeting, _points, _sparse, align


def _page(rng, n, alike):
    rows = np.array([[f"A{rng.integers(alike)}", f"d{rng.integers(alike)}", ("IN", "OUT")[rng.integers(2)], f"{rng.integers(alike)}", f"{rng.integers(3 * alike)}", ("", f"P{rng.integers(alike)}")[rng.integers(2)]] for _ in range(n)], dtype=object)
    other = rows[rng.random(n) > 0.1].copy()
    other[rng.random(len(other)) < 0.2, 4] = "0"
    other[rng.random(len(other)) < 0.1, 1] = ""
    k = rng.integers(len(other))
    return rows, np.concatenate([other[:k], other[k : k + 2], other[k:]])


def test_chains_of_possible_pairs_find_what_the_whole_table_finds():
    rng = np.random.default_rng(3)
    some = 0
    for turn in range(400):
        a, b = _page(rng, int(rng.integers(3, 26)), int(rng.integers(1, 9)))
        x, y = _coded(a, b)
        i, j = _meeting(x, y, 10**9)
        s = _points(x[i], y[j])
        fit = np.isfinite(s)
        whole = _points(x[:, None, :], y[None, :, :])
        assert fit.sum() == np.isfinite(whole).sum()
        found = _sparse(i[fit], j[fit], s[fit], len(a), len(b))
        assert found == _dense(whole), turn
        some += bool(found) and len(found) < len(b)
    assert some > 50


def test_a_page_of_many_rows_is_aligned_in_little_time(monkeypatch):
    """3,000 rows against 2,900, without the table of all pairs."""
    n = 3_000
    a = np.array([[f"A{k % 600}", f"d{k % 700}", "IN", str(k), str(k * 7), f"P{k % 50}"] for k in range(n)], dtype=object)
    kept = [k for k in range(n) if k % 30]
    monkeypatch.setattr(recognition, "_best_totals", None)
    started = time.time()
    assert align(a, a[kept]) == [(k, at) for at, k in enumerate(kept)]
    assert time.time() - started < 20
