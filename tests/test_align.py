import numpy as np
import pytest

from strandlake.operators import align
from strandlake.operators.align import borders, path_hits, score_global, score_local, similarity_map, smoothed, spans, tracebacks
from strandlake.params import AlignParams


def loop_local(a):
    h = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    for i in range(a.shape[0]):
        for j in range(a.shape[1]):
            h[i + 1, j + 1] = max(0, h[i, j] + a[i, j])
    return h


def loop_global(a, gap):
    h = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    for i in range(a.shape[0]):
        for j in range(a.shape[1]):
            h[i + 1, j + 1] = max(0, h[i, j] + a[i, j], h[i, j + 1] - gap, h[i + 1, j] - gap)
    return h


def walk(h, y, x, gap):
    path, diagonal = [(y, x)], True
    while y > 1 and x > 1:
        p = 0 if diagonal else gap
        up, left, diag = h[y - 1, x] - p, h[y, x - 1] - p, h[y - 1, x - 1]
        if diag >= up and diag >= left:
            best, step, diagonal = diag, (1, 1), True
        elif up > left:
            best, step, diagonal = up, (1, 0), False
        else:
            best, step, diagonal = left, (0, 1), False
        if best < 1e-3:
            break
        y, x = y - step[0], x - step[1]
        path.append((y, x))
    return path


@pytest.mark.parametrize("gap", [0.0, 0.5])
def test_matrices_and_paths_against_loops(gap):
    rng = np.random.default_rng(2)
    for _ in range(20):
        a = rng.normal(0, 1, (rng.integers(3, 30), rng.integers(3, 30)))
        assert np.allclose(score_local(a), loop_local(a))
        assert np.allclose(score_global(a, gap), loop_global(a, gap))
        h = loop_local(a)
        starts = borders(h, 2, 1)
        paths = tracebacks(h, starts, gap)
        assert [list(map(tuple, p)) for p in paths] == [walk(h, *s, gap) for s in starts]


def test_borders():
    h = np.arange(20, dtype=float).reshape(4, 5)
    cells = borders(h, 1, 1).tolist()
    assert cells == [[1, 4], [2, 4], [3, 4], [3, 3], [3, 2], [3, 1]]
    assert len(cells) == 3 + 4 - 2 * 1 + 1
    assert borders(h, 1, 2).tolist() == [[2, 4], [3, 4], [3, 2]]
    assert borders(h, 1, 4).tolist() == [[3, 4]]
    assert borders(h, 9, 1).tolist()[0] == [0, 4]


@pytest.mark.parametrize("n", [1, 3, 5, 7, 10, 23])
@pytest.mark.parametrize("w", [2, 5, 10])
def test_moving_mean(n, w):
    v = np.random.default_rng(n).normal(0.3, 1, n)
    expected = np.empty(n)
    width = min(w, n)
    for k in range(n):
        end = max(width - 1, min(k, n - w - 1))
        expected[k] = v[end - width + 1 : end + 1].mean()
    assert np.allclose(smoothed(v, w), expected * (v > 0))


def test_spans_at_the_limits():
    one, low = 1.0, 0.0
    assert spans(np.array([one] * 3 + [low]), 3, 0.5) == [(0, 2)]
    assert spans(np.array([one] * 3), 3, 0.5) == []
    assert spans(np.array([one] * 4), 3, 0.5) == [(0, 3)]
    assert spans(np.array([low, one, one, low, one, one, one, one, low]), 3, 0.5) == [(4, 7)]
    assert spans(np.array([np.nan, one, one, low]), 3, 0.5) == [(0, 2)]


def test_similarity_is_symmetric_and_bounded():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 16)), rng.normal(size=(9, 16))
    assert similarity_map(x, y).shape == (9, 7)
    assert np.allclose(similarity_map(x, y), similarity_map(y, x).T) and abs(similarity_map(x, y)).max() <= 1 + 1e-9


@pytest.mark.parametrize("window", [1, 5])
@pytest.mark.parametrize("bfactor", [1, 2, 3])
def test_a_sequence_finds_itself(window, bfactor):
    x = np.random.default_rng(4).normal(size=(40, 32))
    params = AlignParams(window=window, min_span=6, bfactor=bfactor)
    hits = align.align(x, x, params)
    assert hits and max(h[5] for h in hits) <= 1.01
    best = hits[0]
    assert abs(best[5] - 1) < 1e-9 and (best[4][:, 0] == best[4][:, 1]).all()


def test_global_gives_one_hit():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 32))
    assert len(align.align(x, x[3:], AlignParams(window=5, min_span=6, bfactor=0))) == 1


def test_short_run_needs_four_more_than_the_span():
    least = 5
    for length, found in ((least + 3, 0), (least + 4, 1)):
        a = np.full((30, 30), -1.0)
        for k in range(length):
            a[5 + k, 5 + k] = 1.0
        path = np.array([[6 + k, 6 + k] for k in range(length)][::-1] + [[5, 5], [4, 4]])
        assert len(path_hits(a, [path], AlignParams(window=1, min_span=least))) == found


def test_parameters_are_checked():
    for bad in ({"window": 0}, {"gap": -1.0}, {"sigma": 0.0}, {"bfactor": -1}):
        with pytest.raises(ValueError):
            AlignParams(**bad)
