"""Windows, correspondence analysis, tails and decisions of stretches between stops, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.functions import tails
from helixspark.operators import recstat as R

WORDS = K.words(3)


def reverse(s):
    return s.translate(str.maketrans("acgt", "tgca"))[::-1]


def force_windows(s, size=90, shift=30):
    out = {}
    for strand, x in (("F", s), ("R", reverse(s))):
        for f in range(3):
            k = 0
            while f < len(x):
                start = f + 1 + k * shift
                w = x[start - 1 : start - 1 + size]
                codons = [w[i : i + 3] for i in range(0, len(w) - 2, 3)]
                out[strand, f, k] = (start, [codons.count(c) for c in WORDS])
                if start + size > len(x):
                    break
                k += 1
    return out


def random_dna(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("acgt") for _ in range(n))


def test_windows_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 7)
    seqs = {1: random_dna(1, 1000), 2: random_dna(2, 90), 3: random_dna(3, 91), 4: "acg", 5: "a", 6: "", 7: None, 8: random_dna(8, 200) + "nn" + random_dna(9, 150)}
    df = spark.createDataFrame(list(seqs.items()), "id int, seq string")
    got = {}
    for r in R.windows(df, ["id"]).collect():
        got.setdefault(r.id, {})[r.strand, r.frame, r.k] = (r.start, list(r.counts))
    assert got == {k: force_windows(s) for k, s in seqs.items() if s}
    found = sorted((r.id, r.strand, r.frame, r.before, r.stop) for r in R.inter_stop(df, ["id"]).collect())
    expected = []
    for k, s in seqs.items():
        for strand, x in (("F", s), ("R", reverse(s))) if s else ():
            for f in range(3):
                cuts = sorted({f - 2, len(x) - (len(x) - f) % 3 - 2} | {i + 1 for i in range(f, len(x) - 2, 3) if x[i : i + 3] in R.STOPS})
                expected += [(k, strand, f, a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 150]
    assert found == sorted(expected)
    with pytest.raises(ValueError):
        R.windows(df, ["id"], size=91)


def coa(s):
    """Loads and eigenvalues from a singular value decomposition of the whole table of a strand."""
    x = np.array([c for (strand, _, _), (_, c) in sorted(force_windows(s).items()) if strand == "F" and sum(c)], float)
    p = x / x.sum()
    r, c = p.sum(1), p.sum(0)
    use = c > 0
    z = (p[:, use] - np.outer(r, c[use])) / np.sqrt(np.outer(r, c[use]))
    _, d, v = np.linalg.svd(z, full_matrices=False)
    loads = np.zeros((4, 64))
    loads[:, use] = v[:4] / np.sqrt(c[use])
    return d[:4] ** 2, loads


def test_axes_against_a_decomposition(spark):
    s = random_dna(5, 3000)
    row = R.codon_axes(spark.createDataFrame([(1, s), (2, "")], "id int, seq string"), ["id"]).where("strand = 'F'").collect()
    assert len(row) == 1
    values, loads = coa(s)
    assert np.allclose(row[0]["values"], values) and np.allclose(np.abs(np.array(row[0].loads)), np.abs(loads), atol=1e-8)
    assert np.allclose(np.array(row[0].codons), np.array(row[0].loads) * np.sqrt(values)[:, None])


def test_tails(spark):
    rows = [(2.0, 10.0, 0.07338803477074037), (-2.0, 10.0, 0.07338803477074037), (0.0, 3.0, 1.0), (12.706204736, 1.0, 0.05), (1.96, 1e6, 0.04999607), (40.0, 2.5, None), (None, 3.0, None), (1.0, 0.0, None)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, k double, e double").select(tails.t_tail(F.col("t"), F.col("k")).alias("p")).collect()]
    for p, (t, k, e) in zip(got, rows):
        assert (p is None) == (t is None or k == 0) and (e is None or abs(p - e) < 1e-7)
    # published quantiles of the chi-squared law
    rows = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (6.634896601021213, 1, 0.01), (0.0, 4, 1.0), (124.34211340400407, 100, 0.05), (2.0, 2, np.exp(-1))]
    got = [r.p for r in spark.createDataFrame([(h, k, float(e)) for h, k, e in rows], "h double, k int, e double").select(tails.chi2_tail(F.col("h"), F.col("k")).alias("p")).collect()]
    assert np.allclose(got, [float(e) for *_, e in rows], atol=1e-10)


def p_t(a, b):
    """Welch's test; the tail by Simpson's rule."""
    if len(a) < 2 or len(b) < 2:
        return None
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    if va + vb == 0:
        return None
    t, k = abs(np.mean(a) - np.mean(b)) / np.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    from math import atan, exp, lgamma, pi, sqrt

    x = np.linspace(0, atan(t / sqrt(k)), 4001)
    y = np.cos(x) ** (k - 1)
    area = (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return 1 - 2 * exp(lgamma((k + 1) / 2) - lgamma(k / 2)) / sqrt(pi) * area


def coding(seed, n):
    """A stretch of few codons, as a gene's usage is uneven, between random ends."""
    rng = random.Random(seed)
    return "".join(rng.choice(["gct", "gcc", "ctg", "aag", "gaa", "cgt"]) for _ in range(n))


def test_decisions_against_brute_force(spark):
    seqs = {1: random_dna(11, 900) + "taa" + coding(1, 200) + "taa" + random_dna(12, 901), 2: random_dna(13, 1500)}
    df = spark.createDataFrame(list(seqs.items()), "id int, seq string")
    got = {(r.id, r.strand, r.frame, r.start, r.end): r for r in R.test_scores(df, ["id"]).collect()}
    low = {(r.id, r.strand, r.frame, r.start, r.end): r for r in R.test_codons(df, ["id"]).collect()}
    assert set(got) == set(low)
    segments = {(r.id, r.strand, r.frame, r.before, r.stop) for r in R.inter_stop(df, ["id"]).collect()}
    for k, s in seqs.items():
        values, loads = coa(s)
        force = {(f, j): (start, np.array(c)) for (strand, f, j), (start, c) in force_windows(s).items() if strand == "F"}
        score = {key: (start, loads[0] @ c / c.sum()) for key, (start, c) in force.items() if c.sum()}
        p_window = {}
        for j in {j for _, j in force}:
            three = [force[f, j][1] for f in range(3) if (f, j) in force and force[f, j][1].sum() == 30]
            if len(three) == 3:
                axis = np.round(loads[0], 12)
                level = np.unique(axis)
                g = np.array([[c[axis == v].sum() for v in level] for c in three], float)
                t, n = g.sum(0), 90
                rank = np.cumsum(t) - (t - 1) / 2
                h = (12 / (n * (n + 1)) * ((g @ rank) ** 2 / 30).sum() - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
                p_window[j * 30 + 1] = np.exp(-h / 2)
        for id_, strand, f, before, stop in segments:
            if id_ != k or strand != "F":
                continue
            r = got[k, "F", f, before + 3, stop + 2]
            seg = [[v for (g, _), (at, v) in score.items() if g == h and (before - at) / 90 <= 0.2 and (stop - at) / 90 >= 0.8] for h in range(3)]
            a, b = [h for h in range(3) if h != f]
            for p, q in ((r.p_a, p_t(seg[f], seg[a])), (r.p_b, p_t(seg[f], seg[b]))):
                assert (p is None) == (q is None) and (q is None or abs(p - q) < 1e-8)
            assert r.cds == bool(r.p_a is not None and r.p_b is not None and r.p_a < 0.05 and r.p_b < 0.05)
            inside = [p for at, p in p_window.items() if (before - at) / 92 <= 0.2 and (stop - at) / 92 >= 0.8]
            x = low[k, "F", f, before + 3, stop + 2]
            assert (x.n, x.n_low, x.cds) == (len(inside), sum(p < 0.01 for p in inside), bool(inside) and sum(p < 0.01 for p in inside) / len(inside) > 0.8)
    gene = [r for key, r in low.items() if key[0] == 1 and key[1] == "F" and key[4] - key[3] > 550]
    assert gene and gene[0].cds and got[1, "F", gene[0].frame, gene[0].start, gene[0].end].cds
    assert R.test_scores(df.limit(0), ["id"]).count() == 0 and R.test_codons(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_codons_in_one_pass(spark, monkeypatch, chunk):
    """nothing is shuffled, the stretches are those of inter_stop, and sequences that are not held give the same."""
    seqs = {k: random_dna(20 + k, 40 * k) + "taa" * (k % 2) + coding(k, 20 * k) + random_dna(50 + k, 7 * k) for k in range(1, 16)}
    seqs |= {16: None, 17: "", 18: "a", 19: "nnn" * 90, 20: "ACGTnéACGG" * 30, 21: random_dna(9, 149), 22: "acc" * 50 + "n" + "gtt" * 40}
    df = spark.createDataFrame(list(seqs.items()), "id int, seq string")
    want = R.test_codons(df, ["id"]).collect()
    monkeypatch.setattr(R, "CHUNK", chunk)
    out = R.test_codons(df, ["id"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert sorted(got) == sorted(want) and any(r.cds for r in got) and any(r.n > r.n_low > 0 for r in got)
    stretches = {(r.id, r.strand, r.frame, r.before + 3, r.stop + 2) for r in R.inter_stop(df.where("length(seq) >= 150"), ["id"]).collect()}
    assert {(r.id, r.strand, r.frame, r.start, r.end) for r in got} == stretches and len(got) == len(stretches)
