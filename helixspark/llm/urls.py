"""URL filter: rules, and for the rest a logistic regression on hashed character n-grams of host and path.

The regression is trained here on a small labelled table of made-up URLs (``training_urls``): hosts and paths
of names that adverts, spam, adult and gambling sites carry, against those of ordinary sites.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
``#`` or the end. A rule fits its host and all subdomains if the path starts with the rule's; the longest
rule (host and path) wins, of equally long ones the first. Defined results: a null URL, or one without ``://``, has
empty host and path, fits no rule and is allowed (the model sees no n-gram and its bias is on that side);
repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixspark.llm.common import without

BUCKETS, SIZES = 1 << 16, (3, 4, 5)
#: (verdict, rule) as host, slash, path prefix
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

# Parts of the labelled URLs.
BAD = """ads adserver adtrack track tracker tracking click clicks banner popunder popup spam spamfarm farm
linkfarm cheap discount pills pharma meds viagra casino poker bet bets betting win winner bonus prize slots lottery
jackpot adult porn xxx sex nude escort cams hot dating hookup torrent warez crack keygen malware phish phishing
scam free money cash payday loans replica seo backlinks traffic""".split()
GOOD = """news blog daily times science nature history library museum school college research journal health
garden kitchen recipes travel weather sport music books review forum wiki docs help support city gov energy
weekly post herald press science-today home family culture art theatre local village community""".split()
SECTIONS = "en fr de es about article story posts archive 2023 2024 page item topic category read".split()


def training_urls(rows: int = 4000, seed: int = 3) -> list[tuple[str, str, int]]:
    """(host, path, blocked): from the words above and, for ordinary sites, names of random syllables too."""
    g = np.random.default_rng(seed)
    syllable = lambda: g.choice("b c d f g h l m n p r s t v w th st tr".split()) + g.choice(list("aeiou")) + g.choice(["", "n", "r", "th", "s", "nd", "ng"])
    name = lambda: "".join(syllable() for _ in range(g.integers(2, 4)))
    out = []
    for k in range(rows):
        bad = k % 2
        words = [str(w) for w in g.choice(BAD if bad else GOOD, 2, replace=False)]
        kind = g.random()
        if bad:
            core = words[0] + g.choice(["-", "-", "", "."]) + words[1] if kind < 0.75 else words[0] + g.choice(["-x", "-", ""]) + (name() if kind < 0.85 else "")
        else:
            core = name() + (g.choice(["", "-"]) + name() if kind < 0.2 else "") if kind < 0.65 else words[0] + g.choice(["-", "", "."]) + words[1] if kind < 0.85 else words[0] + name()
        host = g.choice(["", "www.", "m.", "blog."]) + core.strip("-.") + "." + g.choice(["example.", "site.", ""]) + g.choice(["com", "org", "net"])
        out.append((str(host), "/" + "/".join(str(x) for x in [g.choice(SECTIONS), g.integers(1, 999)]) + g.choice(["", "/", ".html"]), bad))
    return out


#: Multipliers of an n-gram's code points, and of host and path.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(1, max(SIZES) + 3)], np.uint64)


def gram_rows(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed n-grams of URLs; those of host and path are told apart. All strings are hashed together."""
    rows, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mark, texts in enumerate(([f"^{h}$" if h or p else "" for h, p in zip(hosts, paths)], [f"{p}$" if p else "" for p in paths])):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        owner, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        for n in SIZES:
            if len(codes) >= n:
                h = FACTORS[-1 - mark] + sum((codes[k : len(codes) - n + 1 + k] * FACTORS[k] for k in range(n)), np.uint64(n))
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                whole = left[: len(h)] >= n  # the n-gram ends inside its string
                rows.append(owner[: len(h)][whole])
                buckets.append(((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[whole])
    both = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets))
    return both // BUCKETS, both % BUCKETS


def grams(host: str, path: str) -> np.ndarray:
    """The buckets of one URL."""
    return gram_rows([host], [path])[1]


def scores(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The model's scores; 0 for a URL without an n-gram."""
    rows, buckets = gram_rows(hosts, paths)
    n = np.bincount(rows, minlength=len(hosts))
    total = np.bincount(rows, weights[buckets], len(hosts)) / np.sqrt(np.maximum(n, 1))
    return np.where(n > 0, 1 / (1 + np.exp(-(total + weights[-1]))), 0.0)


def fit(rows: list[tuple[str, str, int]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights of the buckets, and the bias last. A URL's vector is its n-grams, scaled to unit length."""
    g, w = np.random.default_rng(seed), np.zeros(BUCKETS + 1)
    data = [(f, 1 / np.sqrt(len(f)), y) for h, p, y in rows if len(f := grams(h, p))]
    w[-1] = -0.5
    for epoch in range(epochs):
        for k in g.permutation(len(data)):
            f, scale, y = data[k]
            err = 1 / (1 + np.exp(-(w[f].sum() * scale + w[-1]))) - y
            w[f] -= rate * (err * scale + decay * w[f])
            w[-1] -= 0.02 * rate * err
    w[-1] = min(w[-1], -0.1)
    return w


def parted(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. The rules are one chain of conditions, for
    lists of up to some hundreds; nothing is shuffled."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for _, (verdict, rule) in sorted(enumerate(rules), key=lambda r: (len(r[1][1]), -r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


@lru_cache(1)
def default_model() -> np.ndarray:
    return fit(training_urls())


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, weights: np.ndarray | None = None, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score (the model's, 0 to 1) and verdict; columns of these names are replaced."""
    model = default_model() if weights is None else weights

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            yield pa.array(scores(model, hosts.to_pylist(), paths.to_pylist()), pa.float64())

    host, path = parted(F.col(f"`{url_col}`"))
    kept = without(pages, *[n for n in ("host", "path", "rule", "score", "verdict") if n != url_col])
    out = kept.withColumns({"host": host, "path": path})
    out = out.withColumns({"__fit": fitting(F.col("host"), F.col("path"), rules), "score": score("host", "path")})
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.withColumns({"rule": F.col("__fit.rule"), "verdict": F.coalesce(F.col("__fit.verdict"), learned)}).drop("__fit")
