"""Files read by byte ranges against whole reads; ordered operators against brute force, also for one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from helixspark.operators import ordered as O
from helixspark.sources import fasta
from helixspark.sources.records import read_records


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "0b"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def all_ranges(spark):
    """Small results keep their ranges, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def by_lines(text, comments=True):
    """FASTA records of a whole text, line by line."""
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if comments and line.startswith(";"):
            continue
        if line.startswith(">"):
            out.append([line[1:], ""])
        elif out:
            out[-1][1] += line
    return [(k + 1, h.split(" ")[0], ">" + h, s) for k, (h, s) in enumerate(out)]


def test_fasta_ranges_equal_a_whole_read(spark, tmp_path, small_ranges):
    rng = random.Random(6)
    for case in range(4):
        end = rng.choice(["\n", "\r\n"])
        text = rng.choice(["", "; a note" + end, "no record" + end + end])
        for k in range(60):
            text += rng.choice([f">s{k}", f">s{k} words > here", f">>s{k}", ">"]) + end
            for _ in range(rng.randrange(4)):
                text += rng.choice(["acgt" * rng.randrange(20), ";> note", "nn-*", ""]) + end
        text = text if case % 2 else text.rstrip(end)
        f = tmp_path / f"{case}.fa"
        f.write_bytes(text.encode())
        df = fasta.read_fasta(spark, str(f))
        got = [(r.record, r.name, r.annot, r.seq) for r in df.orderBy("record").collect()]
        assert got == by_lines(text), case
        assert fasta.read_records(spark, str(f), "\n>").rdd.getNumPartitions() > 20
    many = fasta.read_fasta(spark, str(tmp_path / "*.fa"))
    assert many.groupBy("path").agg(F.max("record").alias("n"), F.count("*").alias("m")).where("n <> m").isEmpty()


def test_fasta_without_a_header_is_an_error(spark, tmp_path):
    (tmp_path / "x.fa").write_text("acgt\nacgt\n")
    with pytest.raises(Exception, match="no line starting with a > character found"):
        fasta.read_fasta(spark, str(tmp_path / "x.fa")).collect()
    (tmp_path / "y.fa").write_bytes(b">a b\rAC\r>c\rGT\r")
    assert [(r.name, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "y.fa"), line_end="\r").orderBy("record").collect()] == [("a", "ac"), ("c", "gt")]


def test_shuffled_joins_of_ranges_give_the_same(spark, tmp_path, small_ranges, monkeypatch):
    (tmp_path / "z.txt").write_text("|".join(f"record {k}" for k in range(200)))
    monkeypatch.setattr("helixspark.sources.records.MOST_RANGES", 1)
    got = [(r.record, r.value) for r in read_records(spark, str(tmp_path / "z.txt"), "|").orderBy("record").collect()]
    assert got == [(k, f"record {k}") for k in range(200)]


ENTRY = """LOCUS       AB{k} {n} bp DNA
DEFINITION  a /gene="none" here.
FEATURES             Location/Qualifiers
     source          1..{n}
     CDS             join(1..3,
                     <5..>8)
                     /note="x"
                     /gene="one"
     CDS             complement(join(2..4,
                     6..9))
                     /gene="two"
     CDS             complement(3..7)
                     /product="p"
     gene            3..7
                     /gene="three"
     CDS             join(1..3,5..8)
                     /gene="one"
ORIGIN
        1 acgtacgtac gt
//
"""


def test_genbank_entries_and_exons(spark, tmp_path, small_ranges):
    (tmp_path / "e.gbk").write_text("".join(ENTRY.format(k=k, n=12) for k in range(30)))
    e = fasta.read_genbank(spark, str(tmp_path / "e.gbk"))
    assert sorted((r.entry, r.locus, r.length, r.seq) for r in e.collect()) == sorted((k + 1, f"AB{k}", 12, "acgtacgtacgt") for k in range(30))
    features = fasta.features_of(fasta.genbank_entries(spark, str(tmp_path / "e.gbk")).where("entry = 7"))
    assert [(r.no, r.key, r.location) for r in features.orderBy("no").collect()][:3] == [(1, "source", "1..12"), (2, "CDS", "join(1..3,<5..>8)"), (3, "CDS", "complement(join(2..4,6..9))")]
    got = sorted((r.gene, r.begin, r.end) for r in fasta.exon_table(features).collect())
    assert got == [("", 7, 3), ("one", 1, 3), ("one", 5, 8), ("two", 4, 2), ("two", 9, 6)]


def test_as_of_against_brute_force(spark, all_ranges):
    rng = random.Random(2)
    row = lambda n, tag: [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(60), f"{tag}{k}") for k in range(n)]
    left, right, until = row(120, "l"), row(40, "r"), row(25, "u")
    frame = lambda rows: spark.createDataFrame(rows, "k string, at int, what string").repartition(3)
    got = O.first_after(frame(left), frame(right).withColumnRenamed("what", "next"), ["k"], ["at"], ["next"], frame(until)).collect()

    def expected(k, at):
        later = sorted([(p, 0, v) for kk, p, v in right if kk == k and p > at] + [(p, 1, "") for kk, p, _ in until if kk == k and p > at])
        return later[0][2] if later and later[0][1] == 0 else None

    assert sorted(map(str, [(r.k, r.at, r.what, r.next) for r in got])) == sorted(str((k, at, w, expected(k, at))) for k, at, w in left)
    none = O.first_after(frame(left), frame(right[:0]).withColumnRenamed("what", "next"), ["k"], ["at"], ["next"])
    assert none.count() == len(left) and none.where("next is not null").isEmpty()


def test_running_sums_of_a_hot_key(spark, all_ranges):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), k, rng.randrange(-5, 6)) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, at int, x int").repartition(4)
    out = O.running(df, ["k"], ["at"], {"s": F.col("x"), "n": F.lit(1)})
    expected, s, n = {}, {}, {}
    for k, at, x in rows:
        s[k], n[k] = s.get(k, 0) + x, n.get(k, 0) + 1
        expected[at] = (k, x, s[k], n[k])
    assert {r.at: (r.k, r.x, r.s, r.n) for r in out.collect()} == expected
    parts = O.ranged(df, ["k"], ["at"]).where("k = 'hot'").select(O.PART).distinct().count()
    assert parts >= 3  # the hot key is spread


def test_range_join_against_brute_force(spark):
    rng = random.Random(4)
    points = [(rng.choice("ab"), rng.randrange(-50, 300), k) for k in range(200)]
    spans = [(rng.choice("ab"), a := rng.randrange(-60, 280), a + rng.randrange(-3, 120), k) for k in range(60)]
    p, i = spark.createDataFrame(points, "k string, at int, p int"), spark.createDataFrame(spans, "k string, low int, high int, i int")
    got = sorted((r.p, r.i) for r in O.range_join(p, i, ["k"], "at", "low", "high", 16).collect())
    assert got == sorted((x, y) for k, at, x in points for kk, lo, hi, y in spans if k == kk and lo <= at <= hi)


def test_range_totals_against_brute_force(spark):
    rng = random.Random(6)
    places = [rng.randrange(-50, 300) for _ in range(200)] + [-(2**40), 2**40, None]
    points = [(rng.choice(["a", "b", None]), at, k if k % 7 else None) for k, at in enumerate(places)]
    spans = [(rng.choice(["a", "b", None]), a := rng.randrange(-60, 280), a + rng.randrange(-3, 120)) for k in range(80)]
    spans += [("a", -(2**41), 2**41), ("a", 2**40, 2**40), ("b", -(2**62), 2**61), ("a", None, 5), ("a", 5, None), ("a", 1, 8), ("a", 1, 8)]
    p, i = spark.createDataFrame(points, "k string, at long, p int"), spark.createDataFrame(spans, "k string, low long, high long")
    got = sorted(tuple(r) for r in O.range_totals(p, i, ["k"], "at", "low", "high", "p").collect())
    want = []
    for k, lo, hi in {s for s in spans if None not in s}:
        inside = [x for kk, at, x in points if kk == k and at is not None and lo <= at <= hi]
        if inside:
            want.append((k, lo, hi, len(inside), min((x for x in inside if x is not None), default=None)))
    assert got == sorted(want)
    assert O.range_totals(p.limit(0), i, ["k"], "at", "low", "high", "p").count() == 0 and O.range_totals(p, i.limit(0), ["k"], "at", "low", "high", "p").count() == 0


def test_range_matches_makes_no_pairs(spark, tmp_path):
    """3000 marks that all lie in 2000 intervals; no step may give out more rows than a few for each row read."""
    import duckdb

    import __spark_entry__ as e

    spark.createDataFrame([(k, 0, 95.0 + k % 4 + 0.5) for k in range(3000)] + [(5000, 0, None)], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k // 2, 900.0 + k % 5, 20 + k % 30) for k in range(2000)] + [(7000, 5000.0, 3), (7001, None, 3)], "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan is not there in one piece
    try:
        df = e.queries()["range_matches"](spark, str(tmp_path))
        got, plans, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(k) for k in range(plan.children().size())]
        rows = plan.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    assert 2000 <= most < 10_000
    con = duckdb.connect()
    for table in ("events", "part"):
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({e.oracle_sql()['range_matches']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 1000


def test_scratch_is_cleared_by_age(spark):
    from helixspark.sources.shared import clear_scratch, new_path, written

    df = written(spark.range(3), "kept")
    path = new_path(spark, "x")
    spark.range(2).write.parquet(path)
    assert clear_scratch(spark, 1.0) == 0 and df.count() == 3
    assert clear_scratch(spark, -1.0) >= 2 and clear_scratch(spark, -1.0) == 0
