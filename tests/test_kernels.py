import random

import numpy as np
import pytest

from strandmill.config import Settings, normalized_identity, odd_span_window
from strandmill.functions import kernels as K
from strandmill.functions.families import BURR, GAMMA, GENERALIZED, MIXTURE, family_reports, gamma_p, inverse, survival_area
from strandmill.functions.sketch_size import filter_parameters, fragment_length, upper_tail

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def bases(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("identity,length,reference,window", [(0.78, 3000, 5_000_000, 17), (0.95, 10_000, 100_000, 1000), (0.95, 100_000, 100_000, 10_000)])
def test_parameter_vectors(identity, length, reference, window):
    found = filter_parameters(length, 16, identity, 0.001, reference)
    assert found.window == window
    if identity == 0.95:
        assert (found.sketch_size, found.minimum_hits) == (20, 3)


def test_small_parameter_functions():
    assert upper_tail(10, 0.5, 0) == 1 and abs(upper_tail(2, 0.5, 1) - 0.75) < 1e-12 and upper_tail(3, 0.0, 1) == 0
    assert fragment_length(0, 0, 16) == 17 and fragment_length(2, 101, 16) == 51
    assert normalized_identity(99.5) == 0.995 and normalized_identity(0.5) == 0.5
    with pytest.raises(ValueError):
        normalized_identity(101)
    assert [odd_span_window(16, w) for w in (1, 40, 41)] == [2, 40, 40]
    with pytest.raises(ValueError):
        Settings(alignment_targets=17)


def plain_alignment(q, t):
    """Best (score, matches, columns) by cells, gaps of length l cost 4 + 2 l."""
    low = (-(10**9), 0, 0)
    n, m = len(q), len(t)
    best = [[low] * (m + 1) for _ in range(n + 1)]
    across, down = [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0, 0, 0)

    def add(cell, score, match, column):
        return (cell[0] + score, cell[1] + match, cell[2] + column)

    for i in range(n + 1):
        for j in range(m + 1):
            if j:
                across[i][j] = max(add(across[i][j - 1], -2, 0, 1), add(best[i][j - 1], -6, 0, 1))
            if i:
                down[i][j] = max(add(down[i - 1][j], -2, 0, 1), add(best[i - 1][j], -6, 0, 1))
            if i and j:
                same = q[i - 1] == t[j - 1] and q[i - 1] in "ACGT"
                best[i][j] = add(best[i - 1][j - 1], 2 if same else -4, int(same), 1)
            best[i][j] = max(best[i][j], across[i][j], down[i][j])
    return best[n][m]


def test_alignment_vectors():
    assert K.banded_alignment(K.codes("ACGTACGT"), K.codes("ACGTACGT"), -1) == (16, 8, 8)
    assert K.banded_alignment(K.codes("ACGTACGT"), K.codes("ACGTTCGT"), -1) == (10, 7, 8)
    assert K.banded_alignment(K.codes("acgu"), K.codes("ACGT"), -1) == (8, 4, 4)
    assert K.banded_alignment(K.codes("NNNN"), K.codes("NNNN"), -1)[1] == 0


@pytest.mark.parametrize("seed", range(30))
def test_alignment_equals_cells(seed):
    rng = random.Random(seed)
    q = bases(rng, rng.randrange(1, 40), "ACGTN")
    t = "".join(x for x in q if rng.random() > 0.15) + bases(rng, rng.randrange(0, 6))
    score, matches, _ = plain_alignment(q, t)
    assert K.banded_alignment(K.codes(q), K.codes(t), -1)[:2] == (score, matches)


@pytest.mark.parametrize("seed", range(20))
def test_alignment_beyond_a_field(seed, monkeypatch):
    rng = random.Random(seed)
    q = bases(rng, rng.randrange(30, 60), "ACGTN")
    t = "".join(x for x in q if rng.random() > 0.15) + bases(rng, rng.randrange(0, 6))
    for band in (-1, 3):
        expected = K.banded_alignment(K.codes(q), K.codes(t), band)
        with monkeypatch.context() as small:
            small.setattr(K, "_FIELD", 4)
            assert K.banded_alignment(K.codes(q), K.codes(t), band) == expected
    assert expected[2] >= 1 << 4


def test_extremes_and_minimizers():
    rng = np.random.default_rng(1)
    for n, width in ((1, 1), (7, 3), (50, 8), (41, 41)):
        values = rng.integers(0, 99, n).astype(np.uint64)
        assert K.sliding_extreme(values, width, np.minimum, np.uint64(2**63)).tolist() == [min(values[i : i + width]) for i in range(n - width + 1)]
        assert K.sliding_extreme(values, width, np.maximum, np.uint64(0)).tolist() == [max(values[i : i + width]) for i in range(n - width + 1)]
    rnd = random.Random(3)
    sequence = bases(rnd, 300) + "N" * 5 + bases(rnd, 200) + "NN" + bases(rnd, 30)
    tokens, places = K.minimizers(sequence, 11, 10)
    turned, mirrored = K.minimizers(sequence.translate(COMPLEMENT)[::-1], 11, 10)
    assert sorted(zip(tokens, len(sequence) - 11 - places)) == sorted(zip(turned, mirrored))
    assert all("N" not in sequence[p : p + 11] for p in places)
    assert len(K.minimizers("ACGT" * 5, 11, 11)[0]) == 0 and len(K.minimizers("", 11, 5)[0]) == 0
    assert len(set(K.token(np.arange(100_000, dtype=np.uint64)).tolist())) == 100_000


def test_families():
    x = np.array([0.1, 1.0, 4.0, 10.0])
    assert np.allclose(GAMMA.cdf((4.2, 0.7), x), GENERALIZED.cdf((4.2, 1 / 0.7, 1.0), x), atol=1e-12)
    for p in (0.1, 0.5, 0.95):
        at = inverse(lambda v: BURR.cdf((20.0, 3.0, 2.0), v), p)
        assert abs(BURR.cdf((20.0, 3.0, 2.0), np.array([at]))[0] - p) < 1e-12
    assert abs(gamma_p(1.0, np.array([2.0]))[0] - (1 - np.exp(-2.0))) < 1e-13
    assert abs(gamma_p(5000.0, np.array([5000.0]))[0] - 0.5018806) < 1e-6 and gamma_p(0.05, np.array([0.0, 100.0])).tolist() == [0.0, 1.0]
    assert abs(survival_area(GAMMA, (9.0, 0.5), 400.0) - 18.0) < 1e-3


@pytest.mark.parametrize("family,p", [(GAMMA, (60.0, 3.2)), (MIXTURE, (0.6, 120.0, 9.0, 200.0, 9.5))])
def test_fits_of_known_curves(family, p):
    effort = np.exp(np.linspace(8, 20, 24))
    coverage = family.cdf(p, np.log1p(effort))
    reports = {r["family"]: r for r in family_reports(effort, coverage, effort[-1])}
    assert len(reports) == 4 and reports[family.name]["sse"] < 1e-4
    assert abs(reports[family.name]["area_diversity"] - family.mean(p)) < 0.5
    assert [r["bic"] for r in family_reports(effort, coverage, effort[-1])] == sorted(r["bic"] for r in reports.values())
    assert family_reports(effort[:4], coverage[:4], 1.0) == []


@pytest.mark.parametrize("k,seed", [(16, 0), (17, 0), (21, 5), (31, 9)])
def test_long_kmers_and_seeds_are_neutral_to_the_strand(k, seed):
    rng = random.Random(k)
    read = bases(rng, 700)
    tokens, places = K.minimizers(read, k, 20, seed)
    back, mirrored = K.minimizers(read.translate(COMPLEMENT)[::-1], k, 20, seed)
    assert len(tokens) > 40 and sorted(zip(tokens.tolist(), places.tolist())) == sorted(zip(back.tolist(), (700 - k - mirrored).tolist()))
    assert max(tokens.tolist()) < 2**63
    codes = np.arange(5000, dtype=np.uint64)
    assert len(set(K.token(codes, 32 if k <= 16 else 62, seed).tolist())) == 5000
    assert seed == 0 or K.minimizers(read, k, 20, 0)[0].tolist() != tokens.tolist()
