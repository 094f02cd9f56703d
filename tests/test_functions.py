"""Known values of the sequence functions."""

import pytest
from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.functions import sequence as S
from helixspark.operators import composition as P


@pytest.fixture(scope="module")
def ev(spark):
    def value(make, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first().v

    return value


def test_gc(ev):
    s = "agtctggggggccccttttaagtagatagatagctagtcgta"
    assert ev(S.gc, s) == pytest.approx(0.4761905, abs=1e-7)
    assert [ev(lambda c, p=p: S.gc_pos(c, p), s) for p in (1, 2, 3)] == pytest.approx([0.6428571, 0.3571429, 0.4285714], abs=1e-7)
    assert ev(S.gc, "acgtssss") == 0.5 and ev(S.gc_exact, "acgtssss") == 0.75
    assert ev(S.gc, "NNNN") is None and ev(S.gc_exact, "NNNN") is None and ev(S.gc_exact, "WWSS") == 0.5
    assert ev(S.gc, None) is None and ev(S.gc, "") is None


def test_translate(ev):
    assert ev(S.translate, "atgaaaactgcttatatt") == "MKTAYI"
    assert ev(S.translate, "atraaracngcntayath") == "XXXXXX"
    assert ev(lambda c: S.translate(c, ambiguous=True), "atgaaracngcntayath") == "MKTAYI"
    assert ev(lambda c: S.translate(c, ambiguous=True, numcode=2), "atgaaracngcntayath") == "MKTAYX"
    assert ev(S.translate, "at") == "" and ev(S.translate, None) is None
    assert ev(lambda c: S.translate(c, sens="R"), "aatataagcagttttcat") == "MKTAYI"
    with pytest.raises(ValueError):
        S.translate(F.lit("a"), numcode=7)


def test_codes_differ_where_they_should():
    assert len(K.CODES) == 17 and all(len(c) == 64 for c in K.CODES.values())
    assert K.code(2)["tga"] == "W" and K.code(2)["aga"] == "*" and K.code(3)["ctt"] == "T" and K.code(1)["atg"] == "M"


def test_strings(ev):
    assert ev(lambda c: S.comp(c, ambiguous=True), "abcdghkmstvwn".replace("t", "t")) == "tvghcdmksabwn"
    assert ev(S.comp, "aNcg") == "tgc" and ev(S.revcomp, "aacg") == "cgtt"
    assert ev(S.rot13, ev(S.rot13, "Hello, World")) == "Hello, World"
    assert ev(lambda c: S.splitseq(c), "aaacccg") == ["aaa", "ccc"] and ev(lambda c: S.splitseq(c, 1, 2), "abcd") == ["bc"]
    assert ev(lambda c: S.kmers(c, 3), "ab") == [] and ev(lambda c: S.kmers(c, 2, 1, 2), "abcdef") == ["bc", "de"]
    assert ev(lambda c: S.kmers(c, 2), "abcd") == ["ab", "bc", "cd"]
    assert ev(lambda c: S.words_pos(c, "aa"), "aaaba") == [1, 2]
    assert [ev(lambda c: S.al2bp(c), x) for x in ("9", "9.3", "<8", ">19", "X")] == [36, 39, None, None, None]
    assert [ev(S.aaa, x) for x in ("A", "*", "?")] == ["Ala", "Stp", None] and ev(S.a, "Trp") == "W"
    assert ev(lambda c: S.bma(S.chars(c)), "atatattttata") == "w" and ev(lambda c: S.bma(S.chars(c)), "gcggcgcgcggc") == "s"
    assert ev(lambda c: S.bma(S.chars(c)), "ACGT") == "n" and ev(lambda c: S.bma(S.chars(c)), "AC-T") is None
    assert ev(S.amb, "U") == ["t"] and ev(S.amb, "r") == ["a", "g"] and ev(S.amb, "!") is None
    assert ev(S.trim_space, "  a b ") == "a b" and ev(S.stresc, "a_b\\%") == "a\\_b\\textbackslash{}\\%"
    assert ev(S.reply_values, "code=0&lrank=2&count=150513&type=SQ&locus=F") == ["0", "2", "150513", "SQ", "F"]
    assert [ev(S.s2n, x) for x in "acgtn"] == [0, 1, 2, 3, None]
    assert ev(lambda c: S.frag(c, 2, 3), "abcd") == "bc" and ev(lambda c: S.frag(c, 2, 9), "abcd") is None
    site = ev(lambda c: S.best_site(c, "gatt"), "ccgattgatc")
    assert (site.mismatches, site.pos) == (0, 3) and ev(lambda c: S.best_site(c, "gatt", 0), "cccc") is None


def test_protein_statistics(ev):
    every = "ACDEFGHIKLMNPQRSTVWY"
    assert ev(P.isoelectric_point, every) == pytest.approx(6.78454, abs=2e-3)
    assert ev(P.molecular_weight, "*" + every) == pytest.approx(2395.71366, rel=1e-6)
    assert ev(P.molecular_weight, "*") is None and ev(P.isoelectric_point, "") is None


def test_long_sequences_take_linear_time(ev):
    s = "acgt" * 150_000
    assert ev(lambda c: F.size(S.kmers(c, 3)), s) == 599_998
    assert ev(lambda c: F.length(S.translate(c)), s) == 200_000
