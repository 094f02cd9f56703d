"""Alignments, genomes, banks, files and streams on small tables."""

import math
import struct

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
from helixspark.plans.bank import Bank
from helixspark.sources import fasta, forensic
from helixspark.streaming import sequences as stream


def seqs(spark, *s):
    return spark.createDataFrame([(k, x) for k, x in enumerate(s)], "id int, seq string")


def test_count_words(spark):
    got = {(r.id, r.word): r.n for r in P.count_words(seqs(spark, "aacg", "nn", None, ""), ["id"], 2).collect()}
    assert len(got) == 64 and got[0, "aa"] == got[0, "ac"] == got[0, "cg"] == 1 and sum(got.values()) == 3
    assert P.count_words(seqs(spark), ["id"], 2).count() == 0


def test_codon_usage_and_permutations(spark):
    s = "atggctgctgcattaaaataa"
    u = {r.codon: r for r in C.usage(seqs(spark, s), ["id"]).collect()}
    assert u["gct"].eff == 2 and u["gct"].rscu == pytest.approx(2 / (3 / 4)) and u["gct"].freq == pytest.approx(2 / 7)
    assert u["tgg"].rscu is None and sum(r.eff for r in u.values()) == 7
    df = seqs(spark, s * 9 + "ac")
    out = df.select("seq", *[C.permuted(F.col("seq"), m).alias(m) for m in ("base", "position", "codon", "syncodon")]).first()
    split = lambda t: [t[i : i + 3] for i in range(0, len(t) - 2, 3)]
    assert sorted(out.base) == sorted(out.seq) and out.base != out.seq
    assert all(sorted(c[k] for c in split(out.position)) == sorted(c[k] for c in split(out.seq)) for k in range(3))
    assert sorted(split(out.codon)) == sorted(split(out.seq)) and sorted(split(out.syncodon)) == sorted(split(out.seq))
    from helixspark.constants import code

    aa = code()
    assert [aa[c] for c in split(out.syncodon)] == [aa[c] for c in split(out.seq)] and out.syncodon != out.seq


def alignment(spark, *s):
    return spark.createDataFrame([("x", k, t) for k, t in enumerate(s)], "aln string, idx int, seq string")


def test_consensus(spark):
    aln = alignment(spark, "aac-", "atc-", "agtn")
    line = lambda m: A.consensus_string(A.consensus(aln, m)).first().con
    assert line("majority") == "aac-" and line("threshold") == "a.c-" and line("IUPAC") == "ady."


def test_distances(spark):
    aln = alignment(spark, "ACDE-", "ACNE-", "-CDEK")
    d = {(r.i, r.j): (r.diff, r.bases) for r in A.distances(aln).collect()}
    assert d == {(0, 1): (0, 3), (0, 2): (0, 3), (1, 2): (0, 2)}
    gaps = {(r.i, r.j): (r.diff, r.bases) for r in A.distances(aln, gap=True).collect()}
    assert gaps[0, 2] == (2, 5)
    same = {(r.i, r.j): r.dist for r in A.distances(alignment(spark, "DIA", "KLP"), "similarity").collect()}
    assert same[0, 1] == pytest.approx(math.sqrt(1 / 3))


def test_kaks(spark):
    rows = {(r.i, r.j): r for r in A.kaks(alignment(spark, "atggctaaagattta" * 8, "atggccaaagatctg" * 8, "atggctaaagattta" * 8)).collect()}
    assert rows[0, 2].ka == rows[0, 2].ks == 0 and rows[0, 1].ka == pytest.approx(0, abs=0.02) and rows[0, 1].ks > 0.3
    gaps = A.kaks(alignment(spark, "atg-ct---aaa", "atggctgctaaa")).first()
    assert gaps.ka == 0 and gaps.ks == 9.999999  # no fourfold site is left
    # out-of-frame gaps: whole codons go, and what is left differs in synonymous places alone
    one = "ATGTGGTCGAGATATCGAAAGCTAGGGATATCGATTATATATAGCAAGATCGATAGAGGATCGATGATCGATCGGGATCGACAGCTG"
    two = "AT-TGGTCCAGGTATCGTAAGCTAGGGATATCGATTATATATAGCAAGATCGATAGGGGATCGATGATCGATCGGGA--GACAGCTG"
    known = A.kaks(alignment(spark, one, two)).first()
    assert known.ka == pytest.approx(0, abs=1e-12) and 0 < known.ks < 9
    # every pair of the 64 codons has finite values
    every = A.kaks(alignment(spark, *K.words(3))).collect()
    assert len(every) == 64 * 63 // 2 and all(np.isfinite([r.ka, r.ks, r.vka, r.vks]).all() for r in every)


def test_codon_pairs():
    rows = {(r[0], r[1]): r[2:] for r in A.codon_pair_table()}
    assert len(rows) == 4096 and all(rows[x, y] == pytest.approx(rows[y, x]) for x, y in rows) and all(sum(r[:3]) == pytest.approx(3) for r in rows.values())
    assert rows["ttt", "ttc"] == pytest.approx((2, 1, 0, 0, 1, 0, 0, 0, 0))
    assert rows["cga", "aga"] == pytest.approx((1, 1.5, 0.5, 0, 1, 0, 0, 0, 0))  # a synonymous transversion counts as a transition
    assert rows["ata", "atg"] == pytest.approx((2.5, 0.5, 0, 0.5, 0, 0, 0, 0.5, 0))  # a transition that changes the residue, at a twofold site
    # two changes: ctt to ttg by ctg (L to L) or by ttt (L to F), the ways weighed by replacements
    a, b = 1.0 * 1.0, K.replacement("L", "F") * K.replacement("F", "L")
    w = a / (a + b)
    first = {"ctt": 0, "ctg": 2, "ttt": 0, "ttg": 2}
    step = lambda x, y: [first[x], first[y]]
    zero = sum((w if "ctg" in p else 1 - w) / 2 for p in (("ctg", "ttg"), ("ctt", "ttt")) for d in step(*p) if d == 0)
    third = {"ctt": 4, "ctg": 4, "ttt": 2, "ttg": 2}
    assert rows["ctt", "ttg"][0] == pytest.approx(1 + zero)
    assert rows["ctt", "ttg"][2] == pytest.approx(w + 0 * third["ctt"])


def test_reverse_align(spark):
    back = A.reverse_align(alignment(spark, "M-AK", "MVAK"), spark.createDataFrame([(0, "atggctaaa"), (1, "atggtggccaag")], "idx int, seq string"))
    assert {r.idx: r.seq for r in back.collect()} == {0: "atggctaaa", 1: "atggccaag"}


def test_marks(spark):
    for text, sr in (("**-***-----------", 18), ("---------***--***", 81)):
        df = spark.createDataFrame([(1, k, c == "*") for k, c in enumerate(text)], "g int, k int, m boolean")
        assert G.mark_tests(df, ["g"], ["k"], F.col("m")).first().sr == sr


def test_islands_and_peaks(spark):
    ys = [0, 0, 3, 9, 4, 0, 5, 0, 0, 2, 8, 8, 2, 0]
    df = spark.createDataFrame([("t", k, float(y)) for k, y in enumerate(ys)], "trace string, k int, y double")
    runs = G.islands(df, ["trace"], ["k"], F.col("y") >= 2, F.col("y")).orderBy("island").collect()
    assert [(r.first, r["last"], r.n, r.top) for r in runs] == [(3, 5, 3, 9.0), (7, 7, 1, 5.0), (10, 13, 4, 8.0)]
    p = {r.island: r for r in X.peaks(df, "trace", "k", "y", 2.0).collect()}
    assert 3.5 < p[1].place < 4.5 and p[1].height >= 9 and p[2].height is None
    assert X.baseline(df, "trace", "y").first().baseline < 3


def test_breakpoint(spark):
    df = spark.createDataFrame([(1, float(x), float(x if x < 60 else 120 - x)) for x in range(100)], "g int, x double, y double")
    b = G.breakpoint(df, ["g"], "x", "y").first()
    assert b.at == pytest.approx(60, abs=1.5) and b.slope_left == pytest.approx(1, abs=0.05) and b.slope_right == pytest.approx(-1, abs=0.05)


def test_segments_and_windows(spark):
    got = [(r.frame, r.first, r["last"]) for r in G.stop_segments(seqs(spark, "atgtaaccc"), ["id"]).orderBy("frame", "first").collect()]
    assert got[:2] == [(0, 1, 1), (0, 3, 3)]
    assert G.window_codons(seqs(spark, "a" * 120), ["id"]).where("frame = 0").agg(F.sum("n")).first()[0] == 60


def test_correspondence(spark):
    cols = ["a", "b", "c"]
    df = spark.createDataFrame([("x", 3, 1, 0), ("y", 1, 4, 2), ("z", 0, 1, 5), ("empty", 0, 0, 0)], "k string, a int, b int, c int")
    rows, values, scores = M.correspondence(df, "k", cols, 2)
    import numpy as np

    n = np.array([[3, 1, 0], [1, 4, 2], [0, 1, 5]], float)
    p = n / n.sum()
    r, c = p.sum(1), p.sum(0)
    s = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)))[1]
    assert np.allclose(values, s[:2] ** 2) and rows.count() == 3 and set(scores) == set(cols)
    axis = np.array([x.axis_1 for x in rows.orderBy("k").collect()])
    assert (r * axis).sum() == pytest.approx(0, abs=1e-9) and (r * axis**2).sum() == pytest.approx(values[0])


def test_bank(spark):
    s = spark.createDataFrame([(1, "A", None, 10, "ORDER"), (2, "A.1", 1, 4, "CDS"), (3, "B", None, 7, "ORDER"), (4, "B.1", 3, 2, "RRNA")], "seq_id int, name string, parent_id int, length int, type string")
    tree = spark.createDataFrame([(1, "Life", None), (2, "Homo", 1), (3, "Homo sapiens", 2)], "id int, name string, parent_id int")
    b = Bank(s, tree, tree, spark.createDataFrame([(1, 3), (3, 1)], "seq_id int, id int"), spark.createDataFrame([(2, 3)], "seq_id int, id int"), spark.createDataFrame([(1, 1, "Complete")], "seq_id int, line_no int, line string"))
    ids = lambda x: sorted(r.id for r in x.ids.collect())
    assert ids(b.species("homo@")) == [1] and ids(b.species("life")) == [1, 3]
    assert ids(b.where(type="cds") | b.by_name("b@")) == [2, 3, 4] and ids(~b.where(type="CDS")) == [1, 3, 4]
    assert ids(b.where(type="cds").parents()) == [1] and ids(b.by_name("A").with_subsequences()) == [1, 2]
    assert ids(b.where(type="CDS").keywords().sequences()) == [2] and ids(b.all().scan("complete")) == [1]
    assert ids(b.all().longer(5) - b.by_name("A")) == [3] and b.all().count().first().residues == 23


def test_fasta_round_trip(spark, tmp_path):
    rows = [("one", "acgt" * 40), ("two", "a" * 60), ("three", "c")]
    fasta.write_fasta(spark.createDataFrame(rows, "name string, seq string").coalesce(1), str(tmp_path / "f"))
    assert sorted((r.name, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "f")).collect()) == sorted(rows)
    (tmp_path / "g.fa").write_bytes(b"; note\r\n>x some words\r\nAC\r\n; inside\r\nGT\r\n>y\r\n")
    got = {r.name: (r.annot, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "g.fa")).collect()}
    assert got == {"x": (">x some words", "acgt"), "y": (">y", "")}


def test_alignment_files(spark, tmp_path):
    files = {
        "phylip": " 2 8\nalpha     ACGT\nbeta      AC-T\n\nGGGG\nGG-G\n", "clustal": "CLUSTAL W\n\nalpha   ACGT 4\nbeta    AC-T 3\n        ** *\n\nalpha   GGGG 8\nbeta    GG-G 6\n",
        "mase": ";; file\n; one\nalpha\nACGT\nGGGG\n; two\nbeta\nAC-TGG-G\n", "msf": " x MSF: 8\n Name: alpha\n Name: beta\n//\n\nalpha  ACGT GGGG\nbeta   AC.T GG.G\n", "fasta": ">alpha\nACGT\nGGGG\n>beta\nAC-TGG-G\n",
    }
    for form, text in files.items():
        (tmp_path / form).write_text(text)
        got = sorted((r.nam, r.seq) for r in fasta.read_alignment(spark, str(tmp_path / form), form).collect())
        assert got == [("alpha", "acgtgggg"), ("beta", "ac-tgg-g")], form


def test_genbank(spark, tmp_path):
    text = "LOCUS       AB1 12 bp DNA\nFEATURES\n     CDS             complement(2..7)\n                     /gene=\"a\"\n     CDS             join(1..3,\n                     5..8)\n                     /gene=\"b\"\n     gene            1..3\nORIGIN\n        1 acgtacgtac gt\n//\n"
    (tmp_path / "a.gbk").write_text(text)
    e = fasta.read_genbank(spark, str(tmp_path / "a.gbk"))
    assert [(r.locus, r.length, r.seq) for r in e.collect()] == [("AB1", 12, "acgtacgtacgt")]
    assert fasta.gb2fasta(e).first().value == ">AB1 12 bp\nacgtacgtacgt"
    f = fasta.read_features(spark, str(tmp_path / "a.gbk"))
    assert sorted((r.begin, r.end, r.part, r.complement) for r in f.collect()) == [(1, 3, 1, False), (2, 7, 1, True), (5, 8, 2, False)]
    assert [(r.start, r.end) for r in fasta.glimmer_coordinates(f).collect()] == [(7, 5)]


def test_genotyping_files(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes(b"Version\t1\rPanel\tKit\t\rD8\t\tblue\t100\t200\t12,13\t4\t0.1\tnone\t8,9\r")
    p = forensic.read_panels(spark, str(tmp_path / "p.txt")).first()
    assert (p.panel, p.marker, p.min_bp, p.repeat_bp) == ("Kit", "D8", 100.0, 4.0)
    (tmp_path / "b.txt").write_text("Panel Name\tKit\nMarker Name\tD8\n8\t120.5\t0.5\t0.4\n9\t124.5\t0.5\t0.4\n")
    assert [(r.marker, r.allele, r.size_bp) for r in forensic.read_bins(spark, str(tmp_path / "b.txt")).orderBy("allele").collect()] == [("D8", "8", 120.5), ("D8", "9", 124.5)]


def test_abif_and_bfa(spark, tmp_path):
    data = struct.pack(">3h", 5, -6, 7)
    entry = lambda tag, num, kind, size, n, total, at: struct.pack(">4sihhiiii", tag, num, kind, size, n, total, at, 0)
    directory = entry(b"DATA", 1, 4, 2, 3, 6, 128) + struct.pack(">4sihhii4si", b"DYE#", 1, 4, 2, 1, 2, struct.pack(">hh", 4, 0), 0)
    raw = b"ABIF" + struct.pack(">h", 101) + struct.pack(">4sihhiiii", b"tdir", 1, 1023, 28, 2, 56, 134, 0)
    (tmp_path / "x.fsa").write_bytes(raw.ljust(128, b"\0") + data + directory)
    got = [(r.tag, r.idx, r.value) for r in forensic.read_abif(spark, str(tmp_path / "x.fsa")).orderBy("tag", "idx").collect()]
    assert got == [("DATA", 0, 5.0), ("DATA", 1, -6.0), ("DATA", 2, 7.0), ("DYE#", 0, 4.0)]
    word = sum("acgt".index(c) << (62 - 2 * k) for k, c in enumerate("gattaca"))
    known = sum(3 << (62 - 2 * k) for k in range(6))
    (tmp_path / "y.bfa").write_bytes(struct.pack("<i", 3) + b"ab\0" + struct.pack("<ii", 7, 1) + struct.pack("<QQ", word, known))
    assert [(r.name, r.seq) for r in forensic.read_bfa(spark, str(tmp_path / "y.bfa")).collect()] == [("ab", "gattacn")]


def test_streams(spark, tmp_path):
    rows = [("a", "acgt", "2024-01-01 00:10:00"), ("b", "gggg", "2024-01-01 00:20:00"), ("c", "aaaa", "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "name string, seq string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = stream.stream_records(spark, str(tmp_path / "in"), "name string, seq string, ts timestamp")
    q = stream.annotate(s).writeStream.format("memory").queryName("annotated").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.name: r.gc for r in spark.table("annotated").collect()} == {"a": 0.5, "b": 1.0, "c": 0.0}
    s = stream.stream_records(spark, str(tmp_path / "in"), "name string, seq string, ts timestamp")
    q = stream.composition_by_window(s, "ts").writeStream.format("memory").queryName("by_hour").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.records, r.gc) for r in spark.table("by_hour").collect()) == [(1, 0.0), (2, 0.75)]


def test_growth_and_mixture(spark):
    df = spark.createDataFrame([(float(y), math.exp(0.5 * y)) for y in range(10)], "t double, n double")
    g = X.growth(df, "t", "n").first()
    assert g.slope == pytest.approx(0.5) and g.doubling_months == pytest.approx(24 * math.log(2))
    x = spark.createDataFrame([(float(v),) for k in range(200) for v in (k % 5 - 2, 50 + k % 5 - 2)], "x double")
    assert sorted(r.mean for r in X.mixture(x, "x").collect()) == pytest.approx([0, 50], abs=0.2)
