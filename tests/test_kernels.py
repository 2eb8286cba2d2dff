import numpy as np
import pytest

from meshwork.operators import kernels
from meshwork.plans.schwarz import Config, _inverted
from meshwork.sources import grids
from meshwork.sources.matrix_market import step_file


def laplacian(n, dirichlet=True):
    t = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    if not dirichlet:
        t[0, 0] = t[-1, -1] = 1
    return np.kron(t, np.eye(n)) + np.kron(np.eye(n), t)


def test_factorization_chain():
    rng = np.random.default_rng(0)
    spd, general = laplacian(8), laplacian(8) + np.triu(rng.random((64, 64)), 1) * 0.1
    for a, symmetric, kind in ((spd, True, "cholesky"), (spd - 1.1 * np.eye(64), True, "ldlt"), (general, False, "lu")):
        x, chain = kernels.inverse(a, symmetric)
        assert chain == kind and np.abs(a @ x - np.eye(64)).max() < 1e-8
    x, _ = kernels.inverse(spd, True, single=True)
    assert np.abs(spd @ x - np.eye(64)).max() < 1e-3


@pytest.mark.parametrize("coarsening", ["sa", "rs"])
def test_multigrid_is_linear_and_contracts(coarsening):
    a = laplacian(14)
    m = kernels.Multigrid(a, coarsening, enough=30, single=False)
    rng = np.random.default_rng(1)
    x, y = rng.random(len(a)), rng.random(len(a))
    assert len(m.levels) >= 1 and np.allclose(m(2 * x - 3 * y), 2 * m(x) - 3 * m(y))
    assert np.array_equal(m(x), m(x))
    assert np.abs(np.linalg.eigvals(np.eye(len(a)) - m(np.eye(len(a))) @ a)).max() < 0.6
    again = kernels.Multigrid(2 * a, coarsening, enough=30, single=False, transfers=m.transfers)
    assert np.allclose(2 * again(x), m(x))


def test_unknown_coarsening():
    with pytest.raises(ValueError):
        kernels.Multigrid(laplacian(3), "other")


def test_kernel_and_modes_of_a_floating_subdomain():
    a = laplacian(5, dirichlet=False)
    k = kernels.kernel_of(a)
    assert k.shape[1] == 1 and np.ptp(k) < 1e-10
    d = np.ones(25)
    d[-5:] = 0
    z, info = kernels.local_modes(a, d[:, None] * a * d, 0.3, 12)
    assert info["kernel"] == 1 and np.linalg.matrix_rank(z) == z.shape[1]
    v = kernels.orthonormal(d[:, None] * z)
    assert np.allclose(v.T @ v, np.eye(v.shape[1])) and (v[-5:] == 0).all()


def test_selection_of_complex_pairs():
    values = np.array([3 + 1j, 3 - 1j, 2.0, 0.5])
    vectors = np.eye(4, dtype=complex) + 0.5j * np.eye(4, k=1)
    assert kernels.selected(values, vectors, 4, 0.9).shape[1] == 3
    assert kernels.selected(values, vectors, 1, 0.9).shape[1] == 2
    assert kernels.selected(values, vectors, 4, 0.45).shape[1] == 2
    swapped = kernels.selected(values[[1, 0, 2, 3]], vectors[:, [1, 0, 2, 3]], 4, 0.9)
    assert np.array_equal(swapped, kernels.selected(values, vectors, 4, 0.9))  # the member below the axis met first
    assert kernels.selected(values[[1, 0, 2, 3]], vectors[:, [1, 0, 2, 3]], 1, 0.9).shape[1] == 2


def test_options():
    c = Config.from_options(["--krylov", "bicgstab", "--tau=0.5", "--single", "yes"])
    assert (c.krylov, c.tau, c.single) == ("bicgstab", 0.5, True)
    for bad in (["--what", "1"], ["--tau"], ["--tau", "x"], ["--tau", "2"], ["--single", "maybe"], ["--atol", "1e-3"], ["tau", "1"]):
        with pytest.raises(ValueError):
            Config.from_options(bad)


def test_step_files():
    assert [step_file(p, 7) for p in ("a.mtx", "a%d.mtx", "a%04d.mtx", "a%4d.mtx")] == ["a.mtx", "a7.mtx", "a0007.mtx", "a   7.mtx"]
    for bad in ("a%d%d", "a%s", "a%f"):
        with pytest.raises(ValueError):
            step_file(bad, 1)


def test_twister_as_the_standard_says():
    """The 10000th value with the default seed is fixed by the C++ standard."""
    g = grids.Mt19937_64(5489)
    for _ in range(9999):
        g.next()
    assert g.next() == 9981545732273789042


def test_bubbles_rise_and_wrap():
    o = grids.GridOptions(16, 16, nbubbles=3, radius=0.1)
    still, later = grids.bubble_images(2, o), grids.bubble_images(2, grids.GridOptions(16, 16, nbubbles=3, radius=0.1, time=32))
    assert {round(b[1] % 1, 6) for b in still} == {round(b[1] % 1, 6) for b in later}  # 32 steps of half a cell: one round
    with pytest.raises(ValueError):
        grids._parse("other2d")


def test_coarse_matrix_is_inverted_or_replaced():
    inverse, sure = _inverted(np.array([[2.0, 1.0], [1.0, 3.0]]))
    assert sure and np.allclose(inverse, [[0.6, -0.2], [-0.2, 0.4]])
    inverse, sure = _inverted(np.ones((2, 2)))
    assert not sure and np.allclose(inverse, 0.25)
    assert _inverted(np.zeros((0, 0)))[1]


def test_modes_take_an_inverse_where_the_kernel_is_sure(monkeypatch):
    """A pseudo-inverse (singular values) is made only where the norms leave the kernel open; modes span what they did before."""
    made, pinv = [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda *a, **k: (made.append(1), pinv(*a, **k))[1])
    wind = np.diag(np.full(4, 0.3), 1) - np.diag([0.3] * 4 + [0.0])
    for a, kernel in ((laplacian(5), 0), (laplacian(5, dirichlet=False), 1), (np.kron(np.eye(2), laplacian(4, dirichlet=False)), 2)):
        a = a + np.kron(np.eye(5), wind) if kernel < 2 else a
        d = np.ones(len(a))
        d[-5:] = 0
        b = d[:, None] * a * d
        right, p = kernels.kernel_and_pinv(a)
        assert right.shape[1] == kernel and np.allclose(p, pinv(a, rcond=1e-10), atol=1e-9) and np.allclose(a @ right, 0)
        onto = np.eye(len(a)) - right @ right.T
        values, vectors = np.linalg.eig(pinv(a, rcond=1e-10) @ b @ onto)
        want = kernels.selected(values, vectors, 12, 0.6)
        z = kernels.local_modes(a, b, 0.6, 12)[0]
        v = kernels.orthonormal(z)
        assert np.abs(want - v @ (v.T @ want)).max(initial=0.0) < 1e-7
    assert len(made) == 2  # of the two floating pieces alone
