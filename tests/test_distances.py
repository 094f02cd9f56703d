"""Distances of all pairs of an alignment, against plain loops and the query's SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixspark.operators import alignment as A


def plain(seqs, gap):
    out = {}
    for i, a in seqs:
        for j, b in seqs:
            if i is not None and j is not None and i < j:
                sites = [(x, y) for x, y in zip(a.upper(), b.upper()) if not ({x, y} & set("XN*")) and (x, y) != ("-", "-") and (gap or "-" not in (x, y))] if a is not None and b is not None else None
                out[i, j] = (None, None) if sites is None else (sum(x != y for x, y in sites), len(sites))
    return out


@pytest.mark.parametrize("gap", [False, True])
def test_tiles_give_every_pair_once(spark, monkeypatch, gap):
    """An alignment dealt over many blocks: each pair comes once, from its smaller idx."""
    monkeypatch.setattr(A, "BLOCK_ROWS", 4)
    monkeypatch.setattr(A, "SPAN", 7)
    draw = random.Random(3)
    seqs = [(k * 37 - 200, "".join(draw.choice("acgtN-*éx") for _ in range(draw.randrange(20))).ljust(20, "-")) for k in range(30)] + [(None, "a" * 20), (5000, None)]
    rows = [("x", *s) for s in seqs] + [("y", k, "ac") for k in range(2)] + [(None, 1, "a"), (None, 2, "a"), ("empty", 1, ""), ("empty", 2, "")]
    got = A.distances(spark.createDataFrame(rows, "aln string, idx long, seq string"), gap=gap).collect()
    assert {(r.i, r.j): (r.diff, r.bases) for r in got if r.aln == "x"} == plain(seqs, gap)
    assert len(got) == 31 * 30 // 2 + 2 and {(r.i, r.j, r.diff, r.bases, r.dist) for r in got if r.aln != "x"} == {(0, 1, 0, 2, 0.0), (1, 2, 0, 0, None)}
    assert all(r.dist is None if not r.bases else r.dist == pytest.approx(math.sqrt(r.diff / r.bases)) for r in got)


def test_pairs_of_one_alignment_are_made_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 8)
    rows = [("x", k, "acgt" * (1 + k % 5)) for k in range(200)]
    aln = A.padded(spark.createDataFrame(rows, "g string, idx long, seq string"), "g", "idx", "seq")
    made = A.distances(aln).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 200 * 199 // 2 and len(made) == 4


def test_sequences_of_a_large_alignment_are_not_sent_to_each_tile(spark, monkeypatch):
    """of 25 blocks each was sent 25 times."""
    monkeypatch.setattr(A, "BLOCK_ROWS", 8)
    aln = spark.createDataFrame([("x", k, "acgt" * (1 + k % 5)) for k in range(200)], "aln string, idx long, seq string")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan is not there in one piece
    try:
        df = A.distances(aln)
        got, plans, sent = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(k) for k in range(plan.children().size())]
        rows = plan.metrics().get("shuffleRecordsWritten")
        sent += rows.get().value() if rows.isDefined() else 0
    assert len({(r.i, r.j) for r in got}) == len(got) == 200 * 199 // 2 and sent <= 400


def test_dist_identity_compares_all_of_a_language_and_source(spark, tmp_path):
    """pairs are those of a whole group of documents, not of eight neighbours; documents without a group have none."""
    import duckdb

    import __spark_entry__ as e

    draw = random.Random(5)
    docs = [(k, "en" if k % 3 else "de", "s1" if k != 7 else None, "".join(draw.choice("acgt xyz") for _ in range(draw.randrange(60)))) for k in range(40)] + [(40, None, "s1", "acgt"), (41, None, "s1", "acga")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = e.queries()["dist_identity"](spark, str(tmp_path))
    got = df.collect()
    n = [sum(r[1] == lang and r[2] is not None for r in docs) for lang in ("en", "de")]
    assert len(got) == sum(k * (k - 1) // 2 for k in n) and any(r.j - r.i > 30 for r in got)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({e.oracle_sql()['dist_identity']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
