"""Whitening against numpy's eigenvectors, pieces against the library, spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixspark.llm import pieces, queries, spelling, whitening

VECTORS = "vec_id bigint, embedding array<float>, id string, component string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "own", "own", 3) for k, v in rows], VECTORS)


def by_numpy(rows):
    good = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = np.floor(1024 * np.array([np.array(v, "f4").astype(float) for _, v in good])).astype(np.int64) + 100_000
    c = x - x.mean(0)
    values, u = np.linalg.eigh(c.T @ c / len(c))
    values, u = values[::-1], u[:, ::-1]
    k = min(8, x.shape[1])
    return [i for i, _ in good], ((len(x) * x - x.sum(0)) ** 2).sum(1), c @ u[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300)), values[:k] / values.sum()


def whitened(df, k=8):
    return df.toPandas().sort_values(["component", "vec_id"], kind="stable")


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    scales = 1 / (1 + np.arange(40) / 7)
    rows = [(k, [float(x) for x in rng.standard_normal(40) * scales]) for k in range(300)]
    rows[5], rows[9], rows[12] = (5, None), (9, [float("nan")] * 40), (12, [None] + [1.0] * 39)
    rows[20] = (20, [float("inf")] + [0.0] * 39)
    rows += [(300, rows[0][1]), (300, rows[0][1]), (301, []), (302, [1.0, 2.0])]  # repeated rows; of other lengths
    taken = [r for r in rows if r[1] is None or len(r[1]) == 40]
    ids, deviation, w, explained = by_numpy(taken)
    got = whitened(whitening.whitened_rows(vectors(spark, rows)))
    assert len(got) == 8 * len(ids) and set(got["n"]) == {len(ids)}
    for j in range(8):
        own = got[got["component"] == j + 1]
        order = np.argsort(ids, kind="stable")
        assert own["vec_id"].tolist() == [ids[i] for i in order]
        assert [int(d) for d in own["deviation"]] == deviation[order].tolist()
        v = own["whitened"].to_numpy()
        assert min(abs(v - w[order, j]).max(), abs(v + w[order, j]).max()) < 1e-9
        assert abs(own["explained"] / explained[j] - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_subspace_restarts_and_certifies():
    rng = np.random.default_rng(1)
    u = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    values = 1.0 / (1 + np.arange(400)) ** 0.5
    v = (u * values) @ u.T
    got, found, residuals, passes = whitening.subspace(lambda q: v @ q, 400, 4, 8, widest=48)
    assert np.allclose(got, values[:4], atol=1e-12) and (residuals < 1e-12).all() and passes > 6
    assert (abs((found * u[:, :4]).sum(0)) > 1 - 1e-10).all()


def test_whitening_of_few_rows(spark):
    assert whitening.whitened_rows(vectors(spark, [])).collect() == []
    assert whitening.whitened_rows(vectors(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whitened_rows(vectors(spark, [(1, [0.5, 1.5]), (1, [0.5, 1.5])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] is None for r in one)
    low = whitening.whitened_rows(vectors(spark, [(k, [k * 1.0, 2.0 * k, 0.0]) for k in range(5)])).collect()  # rank one
    assert {r["component"] for r in low if r["whitened"] is not None} == {1} and len(low) == 15
    huge = whitening.whitened_rows(vectors(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e30, 0.0])])).collect()
    assert {r["vec_id"] for r in huge} == {1, 2}
    x = [int(np.floor(1024.0 * float(np.float32(s * 1e12)))) for s in (1, -1)]
    assert {int(r["deviation"]) for r in huge} == {(x[0] - x[1]) ** 2 + 1024**2}


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.default_model())


SYMBOLS = ["a", "b", "e", "t", "th", " ", "  ", "\n", "\r", "▁", "é", "日", "🙂", "\x00", "0", "==", "{", "\t", "(", ");", "in", "er", "́", "ing", "</s>", "<0x41>"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SYMBOLS), st.characters(exclude_categories=["Cs"])), max_size=25))
def test_encoding_equals_the_library(own, library, symbols):
    text = "".join(symbols)
    ids = np.frombuffer(own.encode(text), "i4").tolist()
    assert ids == library.encode(text, add_eos=True)
    assert own.decode(ids) == library.decode(ids)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 400), st.integers(0, 31999), st.sampled_from([1, 2, 0, 259, 230, 153, 168, 198, 194])), max_size=12))
def test_decoding_any_ids_equals_the_library(own, library, ids):
    assert own.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 400), st.integers(0, 31999), st.sampled_from([1, 2, 0, 259, 230, 153, 168, 198, 194, 2, 2])), max_size=7), max_size=6))
def test_decoding_many_equals_one_by_one(own, library, lists):
    assert own.decode_all(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [library.decode(x) for x in lists]
    sliced = pa.array([[5, 6], *lists, None], pa.list_(pa.int32()))
    assert own.decode_all(sliced[1:]).to_pylist() == [*[library.decode(x) for x in lists], None]
    assert own.decode_all(sliced[1:-1]).to_pylist() == [library.decode(x) for x in lists]


def test_every_pair_test_agrees_with_merging(own, library):
    """Compatibility of two pieces is what encoding their concatenation says."""
    rng = random.Random(3)
    some = [k for k in rng.sample(sorted(own.ids.values()), 3000)]
    for a, b in zip(some[::2], some[1::2]):
        text = own.strings[a] + own.strings[b]
        assert own.compatible(a, b) == (np.frombuffer(own.encode_stretch(text), "i4").tolist() == [a, b])


def test_encoding_of_whole_tables(spark, library):
    rng = random.Random(8)
    rare = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))  # no blank at all
    long = " ".join(rng.choice(["the", "quality", "Straße", "x1", "日本"]) for _ in range(600_000))  # more than one part
    texts = [None, "", " ", "plain text", "plain text", "line\nend\n\n x", rare, long]
    docs = spark.createDataFrame([(k, t, [1], 5) for k, t in enumerate(texts)], "doc_id int, text string, ids array<int>, n_tokens int")
    got = {r["doc_id"]: r for r in pieces.decode(pieces.encode(docs)).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        assert got[k]["ids"] == ids and got[k]["text"] == library.decode(ids)
    assert pieces.decode(pieces.encode(docs.limit(0))).collect() == []
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")).collect()[0]["text"] is None


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "other.model"))


def words_by_force(rows):
    low, counts = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) == len(s) + 1 and any(t[:k] + t[k + 1 :] == s for k in range(len(t)))


def variants_by_force(rows):
    n = words_by_force(rows)
    near = {w: [o for o in n if one_apart(w, o)] for w in n}
    form = {w: min(near[w], key=lambda o: (-n[o], o)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_variants_against_brute_force(spark):
    rng = random.Random(5)
    stems = ["garden", "gardén", "quality", "Straßen", "aaaaaaa", "ÀÉÎÕÜÿ", "letters", "lettres"]
    vocabulary = list(stems)
    for _ in range(40):  # variants of variants, so that forms make chains
        w, at = rng.choice(vocabulary), rng.randrange(6)
        vocabulary.append(rng.choice([w[:at] + w[at + 1 :] + "x", w[:at] + "e" + w[at:], w[:at] + "o" + w[at + 1 :]]))
    weights = [rng.choice([1, 6, 40, 250]) for _ in vocabulary]
    rows = [(rng.choice([k, k, None]), " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(vocabulary, weights, k=120)) + rng.choice(["", "_x9", "\n…"])) for k in range(220)]
    rows += [(500, None), (501, ""), (502, "short wo"), (503, "z" * 5000), *[(504, "y" * 3000 + " " + "y" * 2999)] * 25, *[(505, "chain " + "chains " * 30)]]
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id bigint, text string, word string, id int")
    got = [tuple(r) for r in spelling.variants(docs.repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == variants_by_force(rows)
    assert any(g[1] and g[2] != g[1] for g in got)  # a chain of two links at least
    assert spelling.variants(docs.limit(0)).collect() == []


def test_long_texts_are_cut_between_words():
    text = ("garden Straße " * 200_000).strip()
    found = spelling.observed(1, text)
    assert sum(found.values()) == 400_000 and max(len(p) for p in spelling.parts(text.encode())) < spelling.PART + 50


def test_keys_are_shared_by_words_one_apart():
    words = ["aab", "abb", "ab", "aaaa", "aaa", "xyz", "", "z"]
    owner, key = spelling.keys_of(words)
    shared = {(a, b) for a in range(len(words)) for b in range(len(words)) if a < b and set(key[owner == a]) & set(key[owner == b])}
    assert {(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if one_apart(words[a], words[b])} <= shared
    assert sum(owner == 3) == 2  # itself and one deletion


def test_the_three_queries(spark, tmp_path, library):
    docs = [(k, t) for k, t in enumerate(["garden garden garden gardn gardens " * 9, None, "", "Ä b\n"])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.standard_normal(3)]) for k in range(30)]
    vectors(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: [r.asDict() for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    assert {r["component"] for r in run("op11_whitening")} == {1, 2, 3}
    for r in run("op12_pieces"):
        ids = library.encode(dict(docs)[r["doc_id"]] or "", add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in run("op13_spelling")}
    assert got == variants_by_force(docs)
