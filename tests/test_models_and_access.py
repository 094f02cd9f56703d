"""Simulated scores, near matches, breaks, class analyses, draws, stutters, locations and access, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.operators import alignment as A
from helixspark.operators import codon as C
from helixspark.operators import composition as P
from helixspark.operators import forensics as X
from helixspark.operators import genome as G
from helixspark.operators import multivariate as M
from helixspark.plans import access
from helixspark.plans.bank import Bank, where_is


def random_dna(seed, n, letters="acgt"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_simulated_scores_agree_with_the_closed_form(spark):
    df = spark.createDataFrame([(1, random_dna(3, 1500, "aaccgtt")), (2, random_dna(4, 900)), (3, "")], "id int, seq string")
    sim = {(r.id, r.word): r for r in P.zscore_simulated(df, ["id"], "base", 150).collect()}
    exact = {(r.id, r.word): r.z for r in P.zscore_base(df, ["id"], exact=True).collect()}
    assert len(sim) == 48
    off = [sim[k].z - exact[k] for k in sim if k[0] != 3]
    # a mean of 150 draws is off by 0.08 and a deviation by 6 % at one sigma
    assert max(map(abs, off)) < 0.75 and abs(sum(off) / len(off)) < 0.15
    again = {(r.id, r.word): (r.mean, r.var) for r in P.zscore_simulated(df.repartition(3), ["id"], "base", 150).collect()}
    assert all(math.isclose(again[k][0], sim[k].mean, rel_tol=1e-12) for k in sim if k[0] != 3)
    other = {(r.id, r.word): r.mean for r in P.zscore_simulated(df, ["id"], "base", 150, seed=2).collect()}
    assert any(other[k] != sim[k].mean for k in sim if k[0] != 3) and all(sim[k].z is None for k in sim if k[0] == 3)
    codon = P.zscore_simulated(df, ["id"], "codon", 10).where("id = 1").collect()
    assert len(codon) == 16 and all(r.z is not None for r in codon)


def test_rho_of_any_size(spark):
    df = spark.createDataFrame([(1, random_dna(8, 500))], "id int, seq string")
    two = {r.word: r.rho for r in P.rho(df, ["id"]).collect()}
    assert all(math.isclose(r.rho, two[r.word]) for r in P.rho_words(df, ["id"], 2).collect())
    s = df.first().seq
    three = {r.word: r.rho for r in P.rho_words(df, ["id"], 3).collect()}
    n = sum(s[i : i + 3] == "acg" for i in range(498))
    assert math.isclose(three["acg"], n / 498 / (s.count("a") * s.count("c") * s.count("g") / 500**3))


@pytest.mark.parametrize(("size", "matches", "steps"), [(10, 8, (1, 1)), (7, 7, (1, 2)), (9, 4, (2, 1)), (5, 1, (1, 3))])
def test_near_dot_plot_against_brute_force(spark, size, matches, steps):
    a, b = random_dna(1, 60), random_dna(2, 45)
    b = b[:10] + a[20:40] + b[10:]
    left, right = (spark.createDataFrame([(1, s), (2, ""), (3, None)], "id int, seq string") for s in (a, b))
    got = sorted((r.i, r.j, r.same) for r in A.near_dot_plot(left, right, size, matches, steps).collect())
    want = []
    for i in range(0, len(a) - size + 1, steps[0]):
        for j in range(0, len(b) - size + 1, steps[1]):
            same = sum(x == y for x, y in zip(a[i : i + size], b[j : j + size]))
            if same >= matches:
                want.append((i + 1, j + 1, same))
    assert got == sorted(want) and got


def near_brute_force(left, right, size, matches, steps):
    out = []
    for x, a in left:
        for y, b in right:
            for i in range(0, len(a or "") - size + 1, steps[0]):
                for j in range(0, len(b or "") - size + 1, steps[1]):
                    same = sum(p == q for p, q in zip(a[i : i + size], b[j : j + size]))
                    out += [(x, y, i + 1, j + 1, same)] if same >= matches else []
    return sorted(out)


@pytest.mark.parametrize(("size", "matches", "steps", "held"), [(24, 22, (1, 3), True), (20, 18, (3, 1), True), (9, 3, (2, 2), True), (24, 22, (1, 3), False), (300, 20, (1, 1), True)])
def test_near_dot_plot_in_parts(spark, monkeypatch, size, matches, steps, held):
    """sequences in several stretches and candidates in several goes; letters that one side lacks; a right side that is held and one that is not."""
    monkeypatch.setattr(A, "TOGETHER", 17)
    monkeypatch.setattr(A, "CANDIDATES", 5)
    monkeypatch.setattr(A, "HELD", 10**6 if held else 0)
    if size == 300:
        left, right = [(1, random_dna(7, 330))], [("u", random_dna(8, 310))]
    else:
        base, rng = "aaaé𝛼acgttt" * 6 + random_dna(3, 60), random.Random(9)
        left = [(1, base), (2, base[5:90] + "zzz"), (3, None), (4, ""), (9, base[20:60])]
        right = [("u", "".join(rng.choice("acgt") if rng.random() < 0.06 else c for c in base)), ("v", "qq" + base[:50]), ("w", None), ("x", "acg")]
    frames = spark.createDataFrame(left, "id long, seq string"), spark.createDataFrame(right, "id string, seq string")
    df = A.near_dot_plot(*frames, size, matches, steps)
    assert ("MapInArrow" in df._jdf.queryExecution().executedPlan().toString()) == held and [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "int", "int", "int"]
    want = near_brute_force(left, right, size, matches, steps)
    assert want and sorted(map(tuple, df.collect())) == want
    none = frames[1].limit(0)
    assert A.near_dot_plot(frames[0], none, size, matches, steps).count() == 0 and A.near_dot_plot(frames[0].limit(0), frames[1], size, matches, steps).count() == 0


def test_breaks(spark):
    rng = random.Random(5)
    line = lambda x: 2 * x if x < 300 else 600 - 3 * (x - 300) if x < 700 else -600 + (x - 700)
    rows = [("k", x, line(x) + rng.gauss(0, 0.5)) for x in range(1001)] + [("few", 1, 1.0), ("few", 2, 2.0), ("one", 5, 1.0), ("null", 1, None)]
    df = spark.createDataFrame(rows, "k string, x int, y double")
    got = {r.k: r for r in G.breakpoints(df, ["k"], "x", "y", 2).collect()}
    assert np.allclose(got["k"].breaks, [300, 700], atol=10) and np.allclose(got["k"].slopes, [2, -3, 1], atol=0.02) and got["k"].rss < 1000
    assert got["few"].breaks is None and got["one"].breaks is None and "null" not in got
    # one break of a continuous line, against least squares at every place of the grid
    pts = [(x, (x if x < 40 else 40 - 2 * (x - 40)) + rng.gauss(0, 1)) for x in range(0, 101, 3)]
    one = G.breakpoint(spark.createDataFrame([("a", x, y) for x, y in pts] + [("flat", 1, 2.0)], "k string, x int, y double"), ["k"], "x", "y").collect()
    x, y = (np.array(v, float) for v in zip(*pts))
    fits = []
    for k in range(1, 100):
        b = x.min() + (x.max() - x.min()) * k / 100
        design = np.stack([np.ones_like(x), x, np.maximum(x - b, 0)], 1)
        w, *_ = np.linalg.lstsq(design, y, rcond=None)
        fits.append((((y - design @ w) ** 2).sum(), b, w[1], w[1] + w[2]))
    best = min(fits)
    assert len(one) == 1 and np.allclose((one[0].rss, one[0].at, one[0].slope_left, one[0].slope_right), best)


def test_class_analysis_against_decompositions(spark):
    rng = np.random.default_rng(7)
    columns = list("abcdefg")
    classes = dict(zip(columns, "XXYYYZZ"))
    n = rng.poisson(6, (12, 7))
    n[3] = 0
    df = spark.createDataFrame([(str(k), *map(int, r)) for k, r in enumerate(n)], "k string, " + ", ".join(f"{c} int" for c in columns))
    p = n[n.sum(1) > 0] / n.sum()
    r, c = p.sum(1), p.sum(0)
    group = np.array([[classes[x] == g for g in "XYZ"] for x in columns], float)
    spread = (p @ group) @ group.T * c / (group @ (group.T @ c))
    expected = {"between": spread - np.outer(r, c), "within": p - spread}
    total = M.correspondence(df, "k", columns, 7)[1]
    for part, z in expected.items():
        s = np.linalg.svd(z / np.sqrt(np.outer(r, c)))[1] ** 2
        rows, values, inertia = M.class_analysis(df, "k", columns, classes, part, 2)
        assert np.allclose(sorted(values, reverse=True)[:7], s[:7], atol=1e-10)
        assert math.isclose(inertia["between"] + inertia["within"], inertia["total"]) and math.isclose(inertia["total"], sum(total)) and math.isclose(inertia[part], s.sum())
        got = rows.orderBy(F.col("k").cast("int")).collect()
        axis = np.array([x.axis_1 for x in got])
        assert len(got) == 11 and math.isclose((r * axis**2).sum(), values[0]) and abs((r * axis).sum()) < 1e-9
    assert M.class_analysis(df.limit(0), "k", columns, classes, "within")[1] == []


def test_weighted_draws(spark):
    seq = "gctgctaaa" * 400 + "nnnatgg"
    df = spark.createDataFrame([(seq,)], "seq string")
    weights = {c: 1.0 for c in K.words(3)} | {"gct": 6.0, "gcc": 3.0, "gca": 1.0, "gcg": 0.0}
    out = df.select(C.drawn(F.col("seq"), weights).alias("x"), C.drawn(F.col("seq"), weights, 2).alias("y"), C.drawn(F.col("seq"), weights).alias("z")).first()
    codons = [out.x[i : i + 3] for i in range(0, 3600, 3)]
    code = K.code()
    assert [code[c] for c in codons] == [code[seq[i : i + 3]] for i in range(0, 3600, 3)] and out.x[3600:] == "nnnatgg"
    ala = [c for c in codons if code[c] == "A"]
    share = {c: ala.count(c) / len(ala) for c in ("gct", "gcc", "gca", "gcg")}
    assert abs(share["gct"] - 0.6) < 0.06 and abs(share["gcc"] - 0.3) < 0.06 and share["gcg"] == 0
    assert out.x != out.y and out.x == out.z
    with pytest.raises(Exception, match="no weight"):
        df.select(C.drawn(F.col("seq"), {"aaa": 1.0})).collect()


def test_stutters_of_overlapping_peaks(spark):
    x = np.arange(1000, 1400)
    bell = lambda h, m, s: h * np.exp(-(((x - m) / s) ** 2) / 2)
    y = 12 + bell(900.0, 1200.3, 3.4) + bell(72.0, 1176.8, 3.2)
    rows = [("l", int(a), float(b)) for a, b in zip(x, y)] + [("flat", int(a), 5.0) for a in x] + [("none", 1, None)]
    alleles = spark.createDataFrame([("l", 1200.0), ("flat", 1200.0), ("none", 3.0), ("gone", 5.0)], "k string, place double")
    got = {r.k: r for r in X.stutters(spark.createDataFrame(rows, "k string, at int, v double"), alleles, ["k"], "at", "v").collect()}
    r = got["l"]
    for value, want in ((r.rh, 72 / 900), (r.rs, 72 * 3.2 / (900 * 3.4)), (r.h1, 72), (r.h2, 900), (r.s1, 72 * 3.2 * math.sqrt(2 * math.pi)), (r.s2, 900 * 3.4 * math.sqrt(2 * math.pi)), (r.sd1, 3.2), (r.sd2, 3.4)):
        assert abs(value / want - 1) < 0.01
    assert abs(r.l1 - 1176.8) <= 0.5 and abs(r.l2 - 1200.3) <= 0.5 and got["flat"].rh is None and "gone" not in got


def test_stutters_beside_an_allele_without_height(spark):
    """an allele's place at which the trace is flat has a stutter's measures, but no ratio; nor do values that are no numbers end the run."""
    x = np.arange(1000, 1100)
    rows = [("flat", int(a), 300.0 if a == 1030 else 5.0) for a in x]
    rows += [("odd", int(a), {1040: float("nan"), 1041: float("inf"), 1042: None}.get(int(a), 12 + 900 * math.exp(-(((a - 1070) / 3.4) ** 2) / 2) + 72 * math.exp(-(((a - 1048) / 3.2) ** 2) / 2))) for a in x]
    rows += [("spike", int(a), 1e300 if a == 1070 else 1.0 if a == 1030 else 0.0) for a in x]
    alleles = spark.createDataFrame([("flat", 1095.0), ("odd", 1070.0), ("spike", 1070.0)], "k string, place double")
    got = {r.k: r for r in X.stutters(spark.createDataFrame(rows, "k string, at int, v double"), alleles, ["k"], "at", "v").collect()}
    assert set(got) == {"flat", "odd", "spike"} and abs(got["odd"].rh / (72 / 900) - 1) < 0.01
    assert got["flat"].h1 > 0 and got["flat"].h2 == 0 and got["flat"].rh is None and got["flat"].rs is None


def test_fits_of_a_batch_are_those_of_each_alone():
    draw, sets = np.random.default_rng(2), []
    for k in range(40):
        x = np.arange(20.0 + 2 * k)
        y = 900 * np.exp(-(((x - 0.7 * len(x)) / 3.4) ** 2) / 2) + 72 * np.exp(-(((x - 0.2 * len(x)) / 2.5) ** 2) / 2) + draw.random(len(x))
        sets.append((x, y, float(x[y.argmax()])))
    got, none = X.stutters_of(sets), 0
    for s, g in zip(sets, got):
        (alone,) = X.stutters_of([s])
        none += alone is None
        assert (g is None) == (alone is None) and (g is None or np.allclose(list(g.values()), list(alone.values()), rtol=1e-5, equal_nan=True))
    assert none < 20 and X.stutters_of([]) == []


def test_locations_of_long_chains(spark):
    chain = [(k, 10 * k, 10 * k + 5, k + 1 if k < 70 else None) for k in range(1, 71)] + [(100, 1, 2, None), (200, 7, 8, 201), (201, 3, 4, None)]
    random.Random(1).shuffle(chain)
    extents = spark.createDataFrame(chain, "extent int, begin int, end int, next int")
    seqs = spark.createDataFrame([("long", 1), ("one", 100), ("two", 200), ("parent", None)], "seq_id string, extent int")
    got = {r.seq_id: r.spans for r in access.locations(seqs, extents).collect()}
    assert [(s.begin, s.end) for s in got["long"]] == [(10 * k, 10 * k + 5) for k in range(1, 71)]
    assert [(s.begin, s.end) for s in got["two"]] == [(7, 8), (3, 4)] and len(got["one"]) == 1 and got["parent"] is None
    with pytest.raises(ValueError):
        access.chain_places(spark.createDataFrame([(1, 2), (2, 1)], "id int, next int"), most_rounds=5)
    assert access.chain_places(spark.createDataFrame([], "id int, next int")).count() == 0


@pytest.fixture
def small_bank(spark):
    seqs = spark.createDataFrame([(1, "AB1", None, 100, None, None, "2001-05-01"), (2, "AB1.CDS", 1, 30, 2, 11, "1999-01-01"), (3, "XY9", None, 50, None, None, None)], "seq_id int, name string, parent_id int, length int, frame int, ncbigc int, date string").withColumn("date", F.to_date("date"))
    species = spark.createDataFrame([("a", "root", None, 1), ("b", "leaf", "a", 2)], "id string, name string, parent_id string, tax_id int")
    links = {
        "accession": spark.createDataFrame([(1, "A1"), (3, "a1"), (2, "B2")], "seq_id int, value string"), "reference": spark.createDataFrame([(1, "JMB/13/5432"), (3, "NAR/1/2")], "seq_id int, value string"),
        "author": spark.createDataFrame([(3, "Smith")], "seq_id int, value string"),
    }
    annots = spark.createDataFrame([(1, 5, "five"), (1, 1, "one"), (1, 3, "three"), (3, 1, "x")], "seq_id int, line_no int, line string")
    return Bank(seqs, species, None, spark.createDataFrame([(1, "b"), (3, "a")], "seq_id int, id string"), None, annots, links)


def ids(lst):
    return sorted(r.id for r in lst.ids.collect())


def test_criteria(small_bank):
    b = small_bank
    assert ids(b.year(2001)) == [1] and ids(b.year(2001, "<")) == [1, 2] and ids(b.year(2001, ">")) == [1]
    assert ids(b.reference("jmb/13/5432")) == [1] and ids(b.journal("n@")) == [3] and ids(b.author("SMITH")) == [3] and ids(b.accession("a1")) == [1, 3]
    assert ids(b.taxon(1)) == [1, 3] and ids(b.taxon(2)) == [1]
    with pytest.raises(ValueError):
        b.reference("JMB")
    other = Bank(b.sequences, links=b.links)
    assert where_is("A1", {"y": b, "x": other}).count() == 4 and {r.bank for r in where_is("A1", {"y": b, "x": other}, first_only=True).collect()} == {"x"}


def test_numbers_annotations_and_lists(spark, small_bank, tmp_path):
    asked = spark.createDataFrame([("ab1",), ("AB1.cds",), ("no",), ("ab1",)], "what string")
    got = {r.asked: tuple(r)[1:] for r in access.numbers(small_bank, asked).collect()}
    assert got == {"ab1": (1, 100, None, None, None, False), "AB1.cds": (2, 30, 2, None, 11, False), "no": (None,) * 6}
    more = access.numbers(small_bank, spark.createDataFrame([("A1",)], "what string"), "access").first()
    assert (more.number, more.other_matches) == (1, True)
    lines = lambda n: sorted((r.seq_id, r.line_no) for r in access.annotations(small_bank.all(), n).collect())
    assert lines(2) == [(1, 1), (1, 3), (3, 1)] and lines(-4) == [(1, 1), (3, 1)]
    access.save_list(small_bank.all(), str(tmp_path / "n"))
    access.save_list(small_bank.year(2001, "<"), str(tmp_path / "a"), "A")
    assert ids(small_bank.from_file(str(tmp_path / "n"))) == [1, 2, 3] and ids(small_bank.from_accessions(str(tmp_path / "a"))) == [1, 2, 3]
    with pytest.raises(ValueError):
        access.save_list(small_bank.species_list("root"), str(tmp_path / "s"))


def test_extraction(spark):
    seqs = spark.createDataFrame([(1, "s", "atgaaataa", 1, 0), (2, "t", "catgaga", 2, 1), (3, "u", "atg", 99, 0)], "seq_id int, name string, seq string, numcode int, frame int")
    features = spark.createDataFrame([(1, 0, 4, 6), (2, 1, 1, 3)], "seq_id int, ord int, begin int, end int")
    rows = lambda *a: sorted((r.seq_id, r.name, r.seq) for r in access.extract(seqs, *a).collect())
    assert rows(None, "simple")[0] == (1, "s", "atgaaataa")
    assert rows(None, "translate") == [(1, "s", "MK*"), (2, "t", "M*"), (3, "u", None)]
    assert rows(None, "fragment", "2,e-1") == [(1, "s", "tgaaata"), (2, "t", "atgag"), (3, "u", "t")]
    assert rows(None, "fragment", "4,9") == [(1, "s", "aaataa")] and rows(None, "fragment", "4,9", "4,5") == [(1, "s", "aaataa"), (2, "t", "gaga")]
    assert rows(features, "region", "-1,e+2") == [(1, "s.0", "tgaaata")] and rows(features, "region", "-1,e+2", "1,e") == [(1, "s.0", "tgaaata"), (2, "t.1", "catga")]
    assert rows(features, "feature") == [(1, "s", "aaa"), (2, "t", "cat")]
    for bad in (("fragment",), ("region", "1,2"), ("fragment", "1;2"), ("other",)):
        with pytest.raises(ValueError):
            rows(None, *bad)


def test_genes_of_circular_genomes(spark, tmp_path):
    rng = random.Random(4)
    genome = random_dna(9, 97)
    genes = [(k, rng.randrange(1, 98), rng.randrange(1, 98)) for k in range(60)] + [(99, 50, 120)]
    rows = spark.createDataFrame([("g", k, a, b) for k, a, b in genes], "id string, gene int, start int, end int")
    for turn in (0, 13):
        turned = genome[turn:] + genome[:turn]
        got = {r.gene: r for r in G.gene_skews(spark.createDataFrame([("g", genome.upper()), ("none", None)], "id string, seq string"), rows, "id", rotation=turn).collect()}
        for k, a, b in genes:
            a, b = (v - turn + (97 if v - turn < 1 else 0) for v in (a, b))
            wraps = abs(b - a) > 97 / 2
            direct = a > b if wraps else a < b
            if max(a, b) > 97:
                assert got[k].x is None
                continue
            at = range(a + 2, (97 + b if wraps else b) + 1, 3) if direct else range(a - 2, (b - 97 if wraps else b) - 1, -3)
            third = [turned[(i - 1) % 97] for i in at]
            assert (got[k].x, got[k].y) == (third.count("t") - third.count("a"), third.count("c") - third.count("g")), (turn, k)
            assert got[k].excess == (1 if direct else -1) and got[k].place == (a + b) / 2000
    from helixspark.sources.fasta import read_growth

    (tmp_path / "notes.txt").write_text("Text 1 2 3\n  Release   Month  Entries Nucleotides\n\n  1 06/1982  568 585433\n 2.5 04/1983 811 1114447\nend of table\n")
    assert [tuple(r) for r in read_growth(spark, str(tmp_path / "notes.txt")).orderBy("release").collect()] == [(1.0, "06/1982", 568.0, 585433.0, 5 / 12 + 1982), (2.5, "04/1983", 811.0, 1114447.0, 0.25 + 1983)]


def test_ranks_and_primers(spark):
    from helixspark.functions import sequence as S

    used = spark.createDataFrame([("k", "aaa", "K", 3), ("k", "aag", "K", 3), ("k", "atg", "M", 2), ("k", "ttt", "F", 5), ("k", "ttc", "F", 1)], "key string, codon string, aa string, eff int")
    got = {r.codon: (r.aa_place, r.place, r.total) for r in C.usage_ranks(used, ["key"]).collect()}
    assert got == {"atg": (1, 1, 2), "aaa": (2, 1, 6), "aag": (2, 1, 6), "ttt": (2, 2, 6), "ttc": (2, 1, 6)}
    s = "a" * 20 + "gattaca" + "c" * 30 + "ttgacat" + "g" * 20
    df = spark.createDataFrame([(s,), ("acgt",), (None,)], "seq string")
    found = [r.f for r in df.select(S.amplified(F.col("seq"), "gattaca", "ttgacat", most=1).alias("f")).collect()]
    assert tuple(found[0]) == (44, 21, 58) and found[1:] == [None, None]
    back = df.select(S.amplified(S.revcomp(F.col("seq")), "gattaca", "ttgacat", False, 1).alias("f")).first().f
    assert back.length == 44
