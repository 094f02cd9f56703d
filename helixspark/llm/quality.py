"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks. Each byte has a learned vector; learned filters of
eight bytes slide over a chunk in steps of four, and each filter's largest response is kept for the chunk. One more response compares windows
with their neighbours: bytes that end a window of ECHO bytes met within the REACH bytes before it count by a learned weight each, which
shows words repeated on and on. The chunks' pooled responses are combined in HIDDEN units a chunk;
means of both and maxima of the units over the document go into one logistic unit, which gives the
probability. Every byte of a text is read, whatever its length, SLAB chunks at a time, so memory follows the number of chunks,
not that of bytes times filters.

The model is fitted on whole texts of a bounded sample: at most FIT_ROWS labelled rows, taken in the order of a hash of doc_id up to
the first that no longer fits into FIT_CHARS characters in all.

Defined results: a null or empty text is scored as a chunk of padding; repeated rows get equal scores; an
empty table gives an empty result; a table without usable labels gives 0.5 everywhere. Columns other than doc_id, text and quality
take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import bounded_batches, private, remembered, without

CHUNK, STEP, HOP = 256, 224, 4
DIM, FILTERS, HIDDEN, SLAB = 8, 40, 16, 512
#: Bytes of a window that is compared with those before it, and how far back.
ECHO, REACH = 4, 32
#: Labelled rows at most that a model is fitted on, and characters of all of them together.
FIT_ROWS, FIT_CHARS = 7000, 12_000_000
#: A text of more than one LONGEST_SHARE-th of those characters is not fitted on.
LONGEST_SHARE = 10
#: Of a row with label 0 in the fit: it is the rarer kind, and threshold and score lean towards keeping.
LOW_WEIGHT, THRESHOLD = 4.0, 0.3


@dataclass
class ByteConvNet:
    vectors: np.ndarray  # 256 x DIM
    filters: np.ndarray  # HOP * DIM x 2 * FILTERS: for the first and the second half of a window
    bias: np.ndarray  # FILTERS
    echo: np.ndarray  # 256
    unit: np.ndarray  # FILTERS + 1 x HIDDEN
    unit_bias: np.ndarray  # HIDDEN
    out: np.ndarray  # FILTERS + 1 + 2 * HIDDEN
    out_bias: float

    @staticmethod
    def fresh(seed: int = 7) -> ByteConvNet:
        g = np.random.default_rng(seed)
        return ByteConvNet(g.normal(0, 0.5, (256, DIM)).astype("f4"), g.normal(0, 0.18, (HOP * DIM, 2 * FILTERS)).astype("f4"), np.zeros(FILTERS, "f4"), np.full(256, 4, "f4"), g.normal(0, 0.2, (FILTERS + 1, HIDDEN)).astype("f4"), np.full(HIDDEN, 0.2, "f4"), g.normal(0, 0.1, FILTERS + 1 + 2 * HIDDEN).astype("f4"), 0.0)

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """chunks x windows x FILTERS before pooling; chunks: n x CHUNK bytes."""
        n = len(chunks)
        half = (self.vectors[chunks].reshape(n * (CHUNK // HOP), HOP * DIM) @ self.filters).reshape(n, CHUNK // HOP, 2 * FILTERS)
        return half[:, :-1, :FILTERS] + half[:, 1:, FILTERS:]

    def echoes(self, chunks: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Each chunk's response to repetition: n x 1."""
        return (self.echo[chunks] * mask).sum(1, keepdims=True)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """chunks x FILTERS + 1: the largest responses, and that to repetition."""
        return np.maximum(np.hstack([self.responses(chunks).max(axis=1) + self.bias, self.echoes(chunks, repeated(chunks))]), 0)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability for each text; text i is data[offsets[i]:offsets[i + 1]]."""
        start, end, first = chunk_places(offsets)
        top = [self.pooled(chunks_at(data, start[i : i + SLAB], end[i : i + SLAB])) for i in range(0, len(start), SLAB)]
        return self.combined(np.concatenate(top), first)[0]

    def combined(self, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the texts, their features and the chunks' hidden units."""
        counts = np.diff(np.append(first, len(pooled)))[:, None]
        units = np.maximum(pooled @ self.unit + self.unit_bias, 0)
        feats = np.hstack([np.add.reduceat(pooled, first) / counts, np.add.reduceat(units, first) / counts, np.maximum.reduceat(units, first)])
        return 1 / (1 + np.exp(-np.clip(feats.astype("f8") @ self.out + self.out_bias, -30, 30))), feats, units


def repeated(chunks: np.ndarray) -> np.ndarray:
    """For each byte of each chunk its share of the chunk's bytes if the window that it ends is met again within REACH bytes before, else 0."""
    seen = np.zeros(chunks.shape, bool)
    for lag in range(1, REACH + 1):
        same = chunks[:, lag:] == chunks[:, :-lag]
        run = same[:, ECHO - 1 :].copy()
        for k in range(1, ECHO):
            run &= same[:, ECHO - 1 - k : -k]
        seen[:, lag + ECHO - 1 :] |= run
    real = chunks != 0
    return (seen & real) / np.maximum(real.sum(1, keepdims=True), 1).astype("f4")


def chunk_places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each chunk of each text starts, where its text ends, and the row of each text's first chunk."""
    sizes = np.diff(offsets)
    counts = 1 + np.maximum(0, -(-(sizes - CHUNK) // STEP))
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(sizes)), counts)
    begin, end = offsets[:-1][owner], offsets[1:][owner]
    # the last chunk ends with its text, so only texts shorter than a chunk are padded
    return np.maximum(begin, np.minimum(begin + (np.arange(len(owner)) - first[owner]) * STEP, end - CHUNK)), end, first


def chunks_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The chunks that start there; what lies beyond a text's end is zero."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    return data[np.where(inside, at, 0)] * inside if len(data) else np.zeros(at.shape, np.uint8)


def cut_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all texts, and the row of each text's first chunk. A text shorter than a chunk is padded with zeros."""
    start, end, first = chunk_places(offsets)
    return chunks_at(data, start, end), first


def fit(texts: list[str], labels: list[int], epochs: int = 9, batch: int = 48, seed: int = 7) -> ByteConvNet | None:
    """Fit by Adam on logistic loss; gradients reach the filters through each pool's winning window."""
    if not texts:
        return None
    net, g = ByteConvNet.fresh(seed), np.random.default_rng(seed)
    raw, want = [t.encode("utf-8", "replace") for t in texts], np.asarray(labels, "f8")
    net.out_bias = float(np.log((want.sum() + 1) / (len(want) - want.sum() + 1)))
    names = ("vectors", "filters", "bias", "echo", "unit", "unit_bias", "out", "out_bias")
    moments = {n: (np.zeros_like(getattr(net, n), dtype="f8"), np.zeros_like(getattr(net, n), dtype="f8")) for n in names}
    step = 0
    for epoch in range(epochs):
        order = g.permutation(len(raw))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            data = np.frombuffer(b"".join(raw[i] for i in own), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in own])])
            chunks, first = cut_chunks(data, offsets)
            resp = net.responses(chunks)
            arg = resp.argmax(axis=1)  # chunks x FILTERS
            top = np.take_along_axis(resp, arg[:, None, :], 1)[:, 0]
            mask = repeated(chunks)
            pooled = np.maximum(np.hstack([top + net.bias, net.echoes(chunks, mask)]), 0)
            prob, feats, units = net.combined(pooled, first)
            err = (prob - want[own]) / len(own) * np.where(want[own] > 0, 1, LOW_WEIGHT)
            grad = {"out": feats.T @ err + 1e-4 * net.out, "out_bias": np.float64(err.sum())}
            counts = np.diff(np.append(first, len(chunks)))
            owner = np.repeat(np.arange(len(own)), counts)
            mean, of_units, most = net.out[: FILTERS + 1], net.out[FILTERS + 1 : FILTERS + 1 + HIDDEN], net.out[FILTERS + 1 + HIDDEN :]
            share = (err[owner] / counts[owner])[:, None]
            d_unit = (share * of_units + (units == feats[owner, FILTERS + 1 + HIDDEN :]) * err[owner][:, None] * most) * (units > 0)
            grad["unit"], grad["unit_bias"] = pooled.T @ d_unit + 1e-5 * net.unit, d_unit.sum(0)
            d_pool = (share * mean + d_unit @ net.unit.T) * (pooled > 0)
            grad["echo"] = np.bincount(chunks.ravel(), (d_pool[:, FILTERS :] * mask).ravel(), 256)
            d_pool = d_pool[:, :FILTERS]
            grad["bias"] = d_pool.sum(0)
            # bytes of each winning window: chunks x FILTERS x 8
            at = arg[:, :, None] * HOP + np.arange(2 * HOP)
            won = np.take_along_axis(np.broadcast_to(chunks[:, None, :], (len(chunks), FILTERS, CHUNK)), at, 2)
            vec = net.vectors[won]  # chunks x FILTERS x 8 x DIM
            d_win = np.einsum("cf,cfbd->fbd", d_pool, vec)
            grad["filters"] = np.concatenate([d_win[:, :HOP].reshape(FILTERS, -1).T, d_win[:, HOP:].reshape(FILTERS, -1).T], 1)
            weights = np.concatenate([net.filters[:, :FILTERS].T.reshape(FILTERS, HOP, DIM), net.filters[:, FILTERS:].T.reshape(FILTERS, HOP, DIM)], 1)
            d_vec = (d_pool[:, :, None, None] * weights[None]).reshape(-1, DIM)
            grad["vectors"] = np.stack([np.bincount(won.ravel(), d_vec[:, k], 256) for k in range(DIM)], 1)
            step += 1
            for n in names:
                m, v = moments[n]
                m[...] = 0.9 * m + 0.1 * grad[n]
                v[...] = 0.99 * v + 0.01 * np.square(grad[n])
                rate = 0.01 if epoch < epochs - 2 else 0.003
                new = getattr(net, n) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
                setattr(net, n, float(new) if n == "out_bias" else new.astype("f4"))
    return net


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> ByteConvNet | None:
    """Fit on at most rows labelled documents of at most chars characters in all, whole texts, taken in the order of a hash of doc_id from all labels whose
    crc32(doc_id) mod 5 is not 0. First only their ids and lengths come to the driver, then the chosen texts: both are bounded."""
    chosen = (
        labels.where("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 5 != 0")
        .select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    # at most `rows` rows of two numbers: bounded, so broadcast; a doc_id may repeat, so the result is limited again
    sized = docs.select("doc_id", F.length(text).alias("n"), F.xxhash64(text).alias("th")).join(F.broadcast(chosen), "doc_id")
    left, picked = chars, []
    for r in sized.select("doc_id", "n", "th").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "n", "th").limit(rows).collect():
        if r.n > chars // LONGEST_SHARE:
            continue
        if r.n > left:  # not on to shorter ones, so that long texts are as likely as short ones
            break
        left -= r.n
        picked.append((r.doc_id, r.th))
    if not picked:
        return None
    wanted = docs.sparkSession.createDataFrame(picked, "doc_id long, th long")
    found = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th")).join(F.broadcast(wanted), ["doc_id", "th"])
    got = found.groupBy("doc_id", "th").agg(F.any_value("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").limit(2 * rows).collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, r.text))
    return fit([r.text for r in got], [int(r.quality) for r in got])


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets in them; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def scorer(net: ByteConvNet | None):
    """A column function: text to probability."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        remembered("quality", dict)
        for texts in batches:
            if net is None or len(texts) == 0:
                yield pa.array([0.5] * len(texts), pa.float64())
            else:
                yield pa.array(net.scores(*utf8_parts(texts)), pa.float64())

    return score


def score_quality(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` and ``predicted`` (1 if the score is at least threshold); columns of these names
    are replaced."""
    bounded_batches(docs.sparkSession)
    out = without(docs, "score", "predicted").withColumn("score", scorer(net)(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with the columns that they came with."""
    bounded_batches(docs.sparkSession)
    scored, name = private(docs, score=scorer(learn(docs, labels))(F.col("text")))
    return scored.where(F.col(name["score"]) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
