"""Nearest neighbours and archives; the pipeline's stages in order."""

import gzip
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from helixspark.llm import ann, warc


def test_nearest_recall_and_edges(spark):
    g = np.random.default_rng(12)
    x = g.normal(size=(1200, 32)) + 2 * g.normal(size=(12, 32))[g.integers(0, 12, 1200)]
    x[7] = x[3]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    odd = [(5000, None), (5050, []), (5100, [0.0] * 32), (5150, [float("nan")] * 32), (5200, [None] * 32), (5250, [float("inf")] * 32), (5300, [1.0] * 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("id", F.lit(2))
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    f = np.float64(np.array([r[1] for r in rows], "f4"))
    n = f / np.linalg.norm(f, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 1200, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:]))
        sims = n @ n[q]
        assert all(abs(r.score - sims[r.vec_id]) < 1e-12 for r in mine)
        sims[q] = -9
        hits += len({r.vec_id for r in mine} & set(np.argsort(-sims, kind="stable")[:5].tolist()))
        total += 5
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(range(0, 1200, 50))
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] and len(few) == 2
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_repeated_rows_and_ids_with_two_vectors(spark):
    """Against brute force, where rows repeat, an id has two vectors and many rows share one."""
    g = np.random.default_rng(24)
    x = [[float(np.float32(v)) for v in r] for r in g.normal(size=(300, 16))]
    rows = [(k, r) for k, r in enumerate(x)] + [(50, x[50])] * 3 + [(100, x[7]), (8, x[9]), (8, x[9])] + [(400 + k, x[50]) for k in range(40)] + [(None, x[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("b")).withColumn("v", F.lit(0))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    hits = 0
    for q in {k for k, _ in rows if k is not None and k % 50 == 0}:
        best: dict = {}
        for k, r in rows:
            if k is not None and k != q:
                best[k] = max(best.get(k, -2), max(cosine(r, o) for j, o in rows if j == q))
        mine = [v for p, _, v in got if p == q]
        assert len(mine) == len(set(mine)) == 5
        hits += len(set(mine) & set(sorted(best, key=lambda k: (-round(best[k], 12), k))[:5]))
    assert len(got) == 5 * 7 and hits >= 0.9 * len(got)


def test_recall_on_vectors_without_clusters(spark):
    g = np.random.default_rng(25)
    x = g.normal(size=(3000, 32)).astype("f4").astype("f8")
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = n[::50] @ n.T
    sims[np.arange(60), np.arange(0, 3000, 50)] = -9
    want = {(50 * i, int(j)) for i, row in enumerate(np.argsort(-sims, axis=1)[:, :5]) for j in row}
    assert len(got) == 300 and len(got & want) >= 0.9 * 300


def test_index_returns_all_within_the_radius():
    g = np.random.default_rng(13)
    codes = g.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    asked = codes[:20] ^ np.uint16(5)
    dist = ann.hamming(asked, codes)
    for radius in (0, 3, 8, 9, 17, 30, 64):
        assert (ann.MultiIndex(codes).within(asked, radius) == (dist <= radius)).all()


def test_archive_round_trip(spark, tmp_path):
    g = random.Random(14)
    big = "".join(g.choice("abé ") for _ in range(1500))
    pages = [(k, f"http://h/{k}", "<p>" + "x" * g.randint(0, 3000)) for k in range(40)]
    pages += [(100, "u", big), (101, None, big), (105, "u\nv", big), (200, "u", "small"), (201, "u", "small"), (300, "u", None), (301, "u", ""), (None, "u", big), (105, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    path = warc.archive_pages(df, str(tmp_path / "w"))
    got = warc.page_digests(warc.read_archive(spark, path)).collect()
    assert len(got) == len(pages)
    raw = {p: (h or "").encode() for p, _, h in pages}
    for r in got:
        assert r.payload_bytes == len(raw[r.page_id]) and r.payload_digest == hashlib.sha1(raw[r.page_id]).hexdigest()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(100, "revisit", 105), (101, "revisit", 105), (105, "response", None), (None, "revisit", 105), (200, "response", None), (201, "response", None)} <= kinds
    assert warc.read_archive(spark, warc.archive_pages(df.limit(0), str(tmp_path / "e"))).count() == 0


def test_archive_predicates_and_foreign_files(spark, tmp_path):
    record = warc.record("response", "<urn:x>", "http://a", "d1", 3, None, b"abc") + warc.record("request", "<urn:y>", None, None, 2, None, b"\r\n")
    (tmp_path / "a.warc").write_bytes(record)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record[: len(record) // 2]) + gzip.compress(record[len(record) // 2 :]))
    df = warc.read_archive(spark, str(tmp_path))
    assert sorted((r.record_type, bytes(r.payload)) for r in df.collect()) == [("request", b"\r\n")] * 2 + [("response", b"abc")] * 2
    only = df.where("record_type = 'response' and payload_length >= 3")
    assert only.count() == 2
    reader = warc.WarcReader(str(tmp_path), ["record_id", "record_type", "payload"])
    from pyspark.sql.datasource import EqualTo, IsNotNull

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), IsNotNull(("payload",))]))
    assert left == [IsNotNull(("payload",))] and reader.tests == [("=", "record_type", "response")]
    heads = spark.read.format("warc").schema("record_id string, record_type string").load(str(tmp_path))
    assert heads.columns == ["record_id", "record_type"] and heads.where("record_type in ('request')").count() == 2


def test_appended_jobs_and_foreign_files_are_all_read(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = lambda a, b: spark.createDataFrame([(k, "u", f"page {k}") for k in range(a, b)], "page_id long, url string, html string")
    ids = lambda: sorted(r.page_id for r in warc.page_digests(warc.read_archive(spark, path)).collect())
    warc.archive_pages(pages(0, 5), path)
    warc.archive_pages(pages(5, 9), path)
    assert ids() == list(range(9))
    (tmp_path / "w" / "other.warc").write_bytes(warc.record("response", "<urn:page:50>", "http://a", None, 3, None, b"abc"))
    (tmp_path / "w" / f"part-{'0' * 32}.warc").write_bytes(warc.record("response", "<urn:page:60>", None, None, 3, None, b"abc"))  # of a task that was not committed
    assert ids() == [*range(9), 50]
    warc.records(pages(70, 73)).write.format("warc").mode("overwrite").save(path)
    assert ids() == [70, 71, 72]


def test_large_archives_are_split(spark, tmp_path, monkeypatch):
    writer = warc.WarcWriter(str(tmp_path / "s"))
    monkeypatch.setattr(warc, "SPLIT", 1000)
    import pyarrow as pa

    rows = [{"record_id": f"<urn:page:{k}>", "record_type": "response", "target_uri": None, "refers_to": None, "payload_digest": None, "payload_length": 300, "payload": b"z" * 300} for k in range(50)]
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows)])), None])
    reader = warc.WarcReader(str(tmp_path / "s"), ["record_id", "payload"])
    parts = reader.partitions()
    assert len(parts) > 10
    assert sorted(i for p in parts for b in reader.read(p) for i in b.column("record_id").to_pylist()) == sorted(r["record_id"] for r in rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_models import made_docs
    from tests.llm.test_text_ops import words

    g = random.Random(15)
    docs = [(k, t, "en", "s", len(t)) for k, t, _ in made_docs(150)]
    item = words(g, 30)
    docs += [(500, words(g, 50), "en", "s", 1), (502, words(g, 20) + " " + item, "en", "s", 1), (503, "token = abcdefgh1234 " + words(g, 60), "en", "s", 1), (504, None, None, None, None)]
    docs += [(501, docs[150][1], "en", "s", 1)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, y, 0) for k, _, y in made_docs(150)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        assert name == "packing" or out.columns == now.columns
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        ids[name] = {r.doc_id for r in now.collect()}
    assert 500 in ids["near_duplicates"] and 501 not in ids["near_duplicates"] and 501 in ids["quality"]
    assert ids["near_duplicates"] - ids["decontamination"] == {502}
    redacted = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/secrets").collect()}
    assert redacted[503].startswith("[SECRET] ") and ids["packing"] == ids["secrets"] == ids["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == ids["packing"]
