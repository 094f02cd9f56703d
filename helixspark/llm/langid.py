"""Language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary (a SentencePiece model file whose path is a parameter); only
their probabilities are learned here, one distribution for each language. A word's likelihood in a language
is the sum over all ways to cut it into pieces, found by a forward pass; a text's is the product over its
words. Probabilities are fitted by expectation-maximisation on whole texts of a bounded sample of each language: about FIT_TEXTS texts,
taken in the order of a hash of doc_id up to the first that no longer fits into FIT_CHARS characters in all. All pieces of the vocabulary keep a floor
of probability, also those that the sample does not have.

Defined results: a null text, or one without a letter, is ``und`` with score 0 (numerals such as a half or a Roman four are no
letters); so is every text if nothing could be learned. Ties go to the language that sorts first. Words of any length are fitted and scored whole.
Columns other than doc_id, text and lang take no part; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import bounded_batches, remembered, slices, without

#: Texts of each language (in expectation) that a model is fitted on, and characters of all of a language's together.
FIT_TEXTS, FIT_CHARS = 250, 600_000
#: A text of more than one LONGEST_SHARE-th of those characters is not fitted on.
LONGEST_SHARE = 4
WORD = re.compile(r"[^\W\d_]+")
#: Words remembered by a worker before its memory of them is cleared.
CACHE_WORDS = 400_000
UNSEEN = 1e-9


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for w in found for c in w + " ").split()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, a word's start marked by U+2581, lower-cased and distinct."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in found if WORD.fullmatch(p.removeprefix("▁")))


class PieceModel:
    """Piece probabilities by language, in the order of ``langs``."""

    def __init__(self, langs: list[str], probs: dict[str, tuple[float, ...]]):
        self.langs, self.probs, self.name = langs, probs, uuid.uuid4().hex
        self.longest = max(map(len, probs), default=1)
        # An open-addressed table of all beginnings of pieces: the row of the piece that it is (the last row says none), and whether a longer piece begins so.
        starts = {p[:n] for p in probs for n in range(1, len(p))}
        strings = [*probs, *(starts - probs.keys())]
        self.bits = max(4, int(2 * len(strings) + 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, len(probs), np.int32)
        self.longer = np.zeros(1 << self.bits, bool)
        self.values = np.vstack([np.array(list(probs.values()), "f8").reshape(len(probs), len(langs)), np.zeros((1, len(langs)))])
        self.tries, used = 1, np.zeros(1 << self.bits, bool)
        for row, (string, key) in enumerate(zip(strings, hashes_of(strings))):
            slot, tried = int(key >> np.uint64(64 - self.bits)), 1
            while used[slot]:
                slot, tried = (slot + 1) % len(self.rows), tried + 1
            used[slot] = True
            self.keys[slot], self.rows[slot], self.longer[slot], self.tries = key, min(row, len(probs)), string in starts, max(self.tries, tried)

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each hash, len(probs) if there is no such piece, and whether a longer piece begins so."""
        slot = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        out, longer = np.full(len(hashed), len(self.probs), np.int32), np.zeros(len(hashed), bool)
        left = np.arange(len(hashed))
        for k in range(self.tries):
            at = (slot[left] + k) % len(self.rows)
            key = self.keys[at]
            same = key == hashed[left]
            out[left[same]], longer[left[same]] = self.rows[at[same]], self.longer[at[same]]
            left = left[~same & (key != 0)]  # an empty place ends the search
            if not len(left):
                break
        return out, longer

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods, words x languages: for each word the forward sum over all its segmentations.

        A single character outside the vocabulary counts as a piece of probability UNSEEN. Words of one length
        go through the pass together; sums are rescaled as they grow long, so nothing underflows."""
        out = np.zeros((len(words), len(self.langs)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            members = np.flatnonzero(sizes == size)
            step = max(1, 400_000 // int(size + 1))
            for lo in range(0, len(members), step):
                own = members[lo : lo + step]
                out[own] = self._forward(np.frombuffer("".join(["▁" + words[i] for i in own]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), int(size) + 1))
        return out

    def _forward(self, chars: np.ndarray) -> np.ndarray:
        """From each place the pieces that begin there are followed only as long as some piece of the vocabulary goes on so."""
        n, shape = chars.shape[1], (len(chars), len(self.langs))
        prefix = prefix_hashes(chars)
        sums = {0: np.ones(shape)}
        shift = np.zeros(len(chars))
        for i in range(n):
            if i % 8 == 0 and i:  # the sums still needed share one scale
                big = np.maximum.reduce([x.max(1) for x in sums.values()])
                big = np.where(big > 0, big, 1)
                shift += np.log(big)
                for j in sums:
                    sums[j] = sums[j] / big[:, None]
            here, alive = sums.pop(i), np.arange(len(chars))
            for j in range(i + 1, min(n, i + self.longest) + 1):
                power = POWERS[j - i] if j - i < len(POWERS) else np.uint64(pow(BASE, j - i, 2**64))
                row, longer = self.find(mixed(prefix[alive, j] - prefix[alive, i] * power))
                hit = row < len(self.probs)
                total = sums.get(j)
                if total is None:
                    total = sums[j] = np.zeros(shape)
                at = alive[hit]
                total[at] += here[at] * self.values[row[hit]]
                if j == i + 1:
                    miss = alive[~hit]
                    total[miss] += here[miss] * UNSEEN
                alive = alive[longer]
                if not len(alive):
                    break
        return np.log(np.maximum(sums[n], 1e-300)) + shift[:, None]


BASE = 0x9E3779B97F4A7C15
POWERS = np.array([pow(BASE, i, 2**64) for i in range(64)], np.uint64)


def prefix_hashes(chars: np.ndarray) -> np.ndarray:
    """Polynomial hashes of each row's prefixes, modulo 2**64; those of substrings follow by subtraction."""
    out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    for j in range(chars.shape[1]):
        out[:, j + 1] = out[:, j] * np.uint64(BASE) + chars[:, j].astype(np.uint64) + np.uint64(1)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)


def hashes_of(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        chars = np.frombuffer("".join([pieces[k] for k in own]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), size)
        out[own] = mixed(prefix_hashes(chars)[:, -1])
    return out


def expected_pieces(model: PieceModel, column: int, words: Counter) -> Counter:
    """Expected piece counts of one language's words (forward-backward), for one step of the fit. Sums that get small are
    scaled up, with the scale kept beside them, so words of any length count."""
    out: Counter = Counter()
    probs, longest = model.probs, model.longest
    for word, times in words.items():
        s = "▁" + word
        n = len(s)
        arcs = [[(j, p[column] if (p := probs.get(s[i:j])) else UNSEEN) for j in range(i + 1, min(n, i + longest) + 1) if s[i:j] in probs or j == i + 1] for i in range(n)]
        fore, back, scale, scale_back = [0.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1)
        fore[0] = back[n] = 1.0
        now = 0.0
        for i in range(n + 1):
            if 0 < fore[i] < 1e-100:
                by = fore[i]
                now += math.log(by)
                for j in range(i, min(n, i + longest) + 1):
                    fore[j] /= by
            scale[i] = now
            for j, p in arcs[i] if i < n else ():
                fore[j] += fore[i] * p
        now = 0.0
        for i in range(n - 1, -1, -1):
            total = sum(p * back[j] * (math.exp(scale_back[j] - now) if scale_back[j] != now else 1.0) for j, p in arcs[i])
            if 0 < total < 1e-100:
                now += math.log(total)
                total = 1.0
            back[i], scale_back[i] = total, now
        if fore[n] > 0:
            for i in range(n):
                for j, p in arcs[i]:
                    off = scale[i] + scale_back[j] - scale[n]
                    share = fore[i] * p * back[j] / fore[n] * (math.exp(off) if off else 1.0)
                    if share > 0 and s[i:j] in probs:
                        out[s[i:j]] += times * share
    return out


def fit(texts: dict[str, list[str]], pieces: list[str], rounds: int = 3, smooth: float = 0.02) -> PieceModel:
    """Fit by rounds of expectation-maximisation. The vocabulary is all pieces, and single characters that they lack."""
    langs = sorted(texts)
    words = {x: Counter(w for t in texts[x] for w in letter_runs(t)) for x in langs}
    have = set(pieces)
    vocab = [*pieces, *sorted({c for x in langs for w in words[x] for c in "▁" + w} - have)]
    model = PieceModel(langs, {p: (1.0 / len(vocab) / len(p),) * len(langs) for p in vocab})
    for _ in range(rounds):
        counts = [expected_pieces(model, k, words[x]) for k, x in enumerate(langs)]
        totals = [sum(c.values()) + 1e-9 for c in counts]
        shared = {p: sum(c[p] / t for c, t in zip(counts, totals)) / len(langs) for p in vocab}
        floor = 0.1 / len(vocab)
        model = PieceModel(langs, {p: tuple((1 - smooth) * c[p] / t + smooth * (0.9 * shared[p] + floor) for c, t in zip(counts, totals)) for p in vocab})
    return model


def learn(docs: DataFrame, vocabulary: str | None = None, texts_of_each: int = FIT_TEXTS, chars: int = FIT_CHARS) -> PieceModel:
    """Fit on rows with a lang whose crc32(doc_id) mod 3 is not 1: of each language about texts_of_each rows,
    those whose hash of doc_id falls below that language's rate, as far as chars characters hold. The rates come from counts over all rows."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 != 1")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    pieces = load_pieces(vocabulary or default_vocabulary())
    if not counts:
        return PieceModel([], {})
    order = F.xxhash64("doc_id")
    rate = F.create_map(*[F.lit(y) for x, n in sorted(counts.items()) for y in (x, min(1.0, texts_of_each / n))])
    drawn = rows.where(F.shiftrightunsigned(order, 11) / float(2**53) < rate[F.col("lang")])
    most = 2 * texts_of_each * len(counts)
    # numbers first, then the texts that they choose: both bounded, also if a doc_id repeats
    sizes = drawn.select("lang", "doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("th")).distinct().orderBy(order, "doc_id", "lang", "n", "th").limit(most).collect()
    left, picked = dict.fromkeys(counts, chars), []
    for r in sizes:  # in their order up to the first that does not fit, so that long texts are as likely as short ones
        if r.n > chars // LONGEST_SHARE:
            continue
        if r.n > left[r.lang]:
            left[r.lang] = -1
        elif left[r.lang] >= 0:
            left[r.lang] -= r.n
            picked.append((r.lang, r.doc_id, r.th))
    texts: dict[str, list[str]] = {x: [] for x in counts}
    if picked:
        wanted = docs.sparkSession.createDataFrame(picked, "lang string, doc_id long, th long")
        found = drawn.select("lang", "doc_id", "text", F.xxhash64("text").alias("th")).join(F.broadcast(wanted), ["lang", "doc_id", "th"])
        got = found.groupBy("lang", "doc_id", "th").agg(F.any_value("text").alias("text")).limit(most).collect()
        for r in sorted(got, key=lambda r: (r.lang, r.doc_id, r.text)):
            texts[r.lang].append(r.text)
    return fit(texts, pieces)


class WordMemory:
    """The likelihoods of words met before, up to CACHE_WORDS of them."""

    def __init__(self, model: PieceModel):
        self.model, self.rows = model, {}
        self.values = np.zeros((1024, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.rows]
        if len(self.rows) + len(fresh) > CACHE_WORDS:
            self.rows.clear()
            fresh = list(words)
        if not fresh:
            return
        n = len(self.rows)
        while len(self.values) < n + len(fresh):
            self.values = np.vstack([self.values, np.zeros_like(self.values)])
        self.values[n : n + len(fresh)] = self.model.words(fresh)
        self.rows.update(zip(fresh, range(n, n + len(fresh))))


def memory_of(model: PieceModel) -> WordMemory:
    """The process's memory for a model: a Python worker keeps that of its last model from task to task."""
    return remembered(f"words of {model.name}", lambda: WordMemory(model))


def identify(memory: WordMemory, texts: list[str | None]) -> tuple[list[str], list[float]]:
    model = memory.model
    counts = [Counter(letter_runs(t)) if t and model.langs else None for t in texts]
    memory.learn(set().union(*filter(None, counts)))
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    for k, words in enumerate(counts):
        if words:
            rows = [memory.rows[w] for w in words]
            total = np.fromiter(words.values(), "f8", len(words)) @ memory.values[rows]
            best = int(total.argmax())
            langs[k], scores[k] = model.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())
    return langs, scores


def identifier(model: PieceModel):
    """A column function: text to struct<lang_pred, score>."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def lang(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = memory_of(model)
        for texts in batches:
            langs, scores = [], []
            for lo, hi in slices(texts):
                for out, more in zip((langs, scores), identify(memory, texts[lo:hi].to_pylist())):
                    out += more
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return lang


def identify_language(docs: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    kept = without(docs, "lang_pred", "score")
    names = kept.columns
    out = kept.withColumn("__lang", identifier(model)(F.col(text_col)))
    return out.select(*[out[f"`{c}`"] for c in names], out["__lang.lang_pred"], out["__lang.score"])
