"""Property: the Spark chi-square equals an independent plain-Python computation
on random contingency tables (zero cells and zero rows/columns included)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from crashlens.operators import stats as T


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution for integer dof, via
    Q(a + 1, y) = Q(a, y) + y^a e^-y / Gamma(a + 1)."""
    y = x / 2.0
    if k % 2 == 0:
        q, a = math.exp(-y), 1.0
    else:
        q, a = math.erfc(math.sqrt(y)), 0.5
    while a < k / 2.0:
        q += math.exp(a * math.log(y) - y - math.lgamma(a + 1)) if y > 0 else 0.0
        a += 1.0
    return q


def python_chi2(table):
    rows = [i for i, r in enumerate(table) if sum(r) > 0]
    cols = [j for j in range(len(table[0])) if sum(table[i][j] for i in range(len(table))) > 0]
    t = [[table[i][j] for j in cols] for i in rows]
    if not t or not t[0]:
        return None
    R = [sum(r) for r in t]
    C = [sum(c) for c in zip(*t)]
    n = sum(R)
    dof = (len(R) - 1) * (len(C) - 1)
    if dof == 0:
        return 0.0, 0, 1.0
    stat = 0.0
    for i, ri in enumerate(R):
        for j, cj in enumerate(C):
            e = ri * cj / n
            d = abs(t[i][j] - e)
            if dof == 1:
                d -= min(0.5, d)
            stat += d * d / e
    return stat, dof, chi2_sf(stat, dof)


tables = st.integers(2, 4).flatmap(lambda r: st.integers(2, 4).flatmap(
    lambda c: st.lists(st.lists(st.integers(0, 40), min_size=c, max_size=c), min_size=r, max_size=r)))


@settings(max_examples=15, deadline=None)
@given(tables)
def test_chi2_matches_python(spark, table):
    want = python_chi2(table)
    cells = [(f"r{i}", f"c{j}", v) for i, row in enumerate(table) for j, v in enumerate(row)]
    got = T.chi_square(spark.createDataFrame(cells, "r string, c string, n bigint"), "r", "c").collect()
    if want is None:  # all-zero table
        assert [(r.dof, r.chi2, r.p_value, r.n_total) for r in got] == [(0, 0.0, 1.0, 0)]
        return
    stat, dof, p = want
    r = got[0]
    assert r.dof == dof
    assert math.isclose(r.chi2, stat, rel_tol=1e-9, abs_tol=1e-9)
    assert math.isclose(r.p_value, p, rel_tol=1e-7, abs_tol=1e-12)
