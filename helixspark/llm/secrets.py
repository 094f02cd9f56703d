"""Secret scan with a battery of randomness tests, with DataFrame functions only.

Base spans follow three fixed patterns. The method adds runs of 20 or more key-like characters that look
random. For each run an encoding is inferred (hexadecimal, base 32, lower-case and digits, base 62, base 64) and its
symbols' numbers go through three tests: chi-squared uniformity over groups of the alphabet, the number of
runs above and below the alphabet's middle, and the serial correlation of neighbours. Their p-values are
combined by Fisher's method; a random string's p is uniform, that of words or names is near 0.

False discoveries are controlled for each length class and encoding by themselves, over all documents: the
strings with p of at least 1/2 tell how many random ones there are (twice as many, whatever their length), so
of all strings with p >= c a share of 1 - random * (1 - c) / all is false; the lowest cut c is taken for which
that estimate, and those of all higher cuts up to 1/2, is at most FALSE_RATE. A class without random strings accepts none.

Defined results: a null text is an empty one and has no spans; positions are code points, ends exclusive;
repeated rows are scanned each; an empty table gives no rows. A text of any length is scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import without

# The patterns, least lengths and order of kinds of base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the leftmost AKIA of a run holds all later ones, so asking for 20 characters at once is the same
HEX = r"[0-9a-f]{24,}"  # a run of the class is taken whole, so asking for 24 at once is the same
KINDS = ["assign", "access", "hex", "random"]
LEAST_SECRET = 6

RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
FALSE_RATE = 0.05
BINS = 50
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: encoding: (alphabet, symbols in a group of the chi-squared test)
ENCODINGS = {"hex": (DIGITS + "abcdef", 2), "base32": (UPPER + "234567", 4), "base36": (LOWER + DIGITS, 6), "base62": (UPPER + LOWER + DIGITS, 8), "base64": (UPPER + LOWER + DIGITS + "+/", 8)}


#: Hits that are gathered at once: arrays grow by copying, so a text's hits are gathered in groups, and these joined.
GROUP = 128
#: Characters of the pieces that a text is cut into where spans are taken out of it.
PIECE = 512


def located(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0, tokens: bool = False) -> Column:
    """array<struct<start, end, kind>> of a pattern's leftmost matches, those kept whose group has least characters; with
    tokens each match's text too.

    What lies between matches (split) and the matches themselves give every position in one pass."""
    p = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    more = ["token"] if tokens else []
    found = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.regexp_extract_all(text, p, F.lit(group)).alias("part"))
    sized = F.transform(found, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["part"]).alias("part"), *[x["hit"].alias("token") for _ in more]))
    kinds = "start:int,end:int,kind:int" + (",token:string" if tokens else "")
    none = F.array().cast(f"array<struct<{kinds}>>")

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["gap"]
        hi = lo + x["hit"]
        span = F.array(F.struct(lo.alias("start"), hi.alias("end"), F.lit(kind).alias("kind"), *[x["token"].alias("token") for _ in more]))
        return F.struct(hi.alias("at"), F.when(x["part"] >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def some(acc: Column, part: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), none.alias("spans"))
        return F.aggregate(part, start, step, lambda s: F.struct(s["at"].alias("at"), F.concat(acc["spans"], F.array(s["spans"])).alias("spans")))

    # the last gap has no hit
    def whole(sizes: Column) -> Column:
        n = F.size(sizes) - 1
        parts = F.transform(F.sequence(F.lit(0), F.greatest((n - 1) / GROUP, F.lit(0)).cast("int")), lambda k: F.slice(sizes, k * GROUP + 1, F.greatest(F.least(n - k * GROUP, F.lit(GROUP)), F.lit(0))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<struct<{kinds}>>>").alias("spans"))
        return F.flatten(F.aggregate(parts, start, some)["spans"])

    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(sized), whole))).otherwise(none)


def gathered(items: Column, state: dict[str, Column], step, kind: str) -> Column:
    """What step adds to ``out`` along items, in order: array<kind>. step gets a struct of the state's fields and out, and an item, and
    returns such a struct. Additions are gathered in groups, as in ``located``."""
    none = F.array().cast(f"array<{kind}>")
    held = lambda acc: [acc[n].alias(n) for n in state]

    def some(acc: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(*held(acc), none.alias("out")), step, lambda s: F.struct(*held(s), F.concat(acc["all"], F.array(s["out"])).alias("all")))

    def whole(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / GROUP).cast("int")), lambda k: F.slice(xs, k * GROUP + 1, GROUP))
        start = F.struct(*[c.alias(n) for n, c in state.items()], F.array().cast(f"array<array<{kind}>>").alias("all"))
        return F.flatten(F.aggregate(parts, start, some)["all"])

    return F.element_at(F.transform(F.array(items), whole), 1)  # items are computed once


SPAN = "struct<start:int,end:int,kind:int>"


def clear_of(runs: Column, base: Column) -> Column:
    """The runs that overlap no base span; both sorted by start, runs apart from one another. One walk along both: a run
    is given out when the next run (or the end) comes and no base span has reached into it."""
    item = lambda s, is_run: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(is_run).alias("run"))
    last = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit(0).alias("kind"), F.lit(True).alias("run")))
    both = F.array_sort(F.concat(F.transform(base, lambda s: item(s, False)), F.transform(runs, lambda s: item(s, True)), last))
    state = {"at": F.lit(0), "held": F.lit(None).cast(SPAN)}

    def step(acc: Column, x: Column) -> Column:
        held, span = acc["held"], F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        free = F.when(x["start"] >= acc["at"], span)
        return F.struct(
            F.when(x["run"], acc["at"]).otherwise(F.greatest(acc["at"], x["end"])).alias("at"),
            F.when(x["run"], free).when(x["start"] >= held["end"], held).alias("held"),
            F.when(x["run"] & held.isNotNull(), F.concat(acc["out"], F.array(held))).otherwise(acc["out"]).alias("out"),
        )

    return F.when((F.size(base) > 0) & (F.size(runs) > 0), gathered(both, state, step, SPAN)).otherwise(runs)


def fisher(*ps: Column) -> Column:
    """Combined p of three independent p-values (chi-squared with 6 degrees of freedom, in closed form)."""
    half = -sum((F.ln(F.greatest(p, F.lit(1e-12))) for p in ps), F.lit(0.0))
    return F.exp(-half) * (1 + half + half * half / 2)


def two_sided(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by a logistic approximation (error below 2e-4)."""
    a = F.abs(z)
    return F.least(F.lit(1.0), 2 / (1 + F.exp(F.least(1.5976 * a + 0.07056 * a * a * a, F.lit(700.0)))))


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), "hex").when(token.rlike("^[A-Z2-7]+$"), "base32").when(token.rlike("^[a-z0-9]+$"), "base36")
        .when(token.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    )


def battery(token: Column, kind: Column) -> Column:
    """Combined p of the tests on one token (without padding signs)."""
    url_safe = F.translate(token, "-_=", "+/")
    plain = F.when(kind == "hex", F.lower(url_safe)).otherwise(url_safe)
    alphabet, size, width = F.lit("+/"), F.lit(64), F.lit(8)
    for name, (symbols, group) in ENCODINGS.items():
        alphabet = F.when(kind == name, F.lit(symbols)).otherwise(alphabet)
        size = F.when(kind == name, F.lit(len(symbols))).otherwise(size)
        width = F.when(kind == name, F.lit(group)).otherwise(width)
    # later lambdas read the numbers through one-element arrays, so that each is computed once
    state = F.struct(F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c) - 1).alias("xs"), size.alias("a"), width.alias("w"))
    state = F.transform(F.array(state), lambda s: F.struct(F.filter(s["xs"], lambda x: x >= 0).alias("xs"), s["a"].alias("a"), s["w"].alias("w")))

    def measured(s: Column) -> Column:
        xs, a, w = s["xs"], s["a"], s["w"]
        n = F.size(xs)
        groups = F.ceil(a / w).cast("int")
        wanted = lambda b: n * F.least(w, a - b * w) / a
        chi = F.aggregate(F.sequence(F.lit(0), groups - 1), F.lit(0.0), lambda acc, b: acc + F.pow(F.size(F.filter(xs, lambda x: F.floor(x / w) == b)) - wanted(b), 2.0) / wanted(b))
        df = (groups - 1).cast("double")
        z_chi = (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        one = 1 / (1 + F.exp(F.greatest(F.least(1.5976 * z_chi + 0.07056 * z_chi * z_chi * z_chi, F.lit(700.0)), F.lit(-700.0))))
        high = F.transform(xs, lambda x: (x * 2 >= a).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda acc, x: acc + x).cast("double")
        n2 = n - n1
        pairs = F.arrays_zip(F.slice(xs, 1, n - 1).alias("x"), F.slice(xs, 2, n - 1).alias("y"))
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["x"] * 2 >= a) != (p["y"] * 2 >= a)))
        mean_runs = 1 + 2 * n1 * n2 / n
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        p_runs = F.when(var_runs > 0, two_sided((runs - mean_runs) / F.sqrt(var_runs))).otherwise(0.0)
        mid = (a - 1) / 2
        var = (a * a - 1) / 12
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["x"] - mid) * (p["y"] - mid)) / (var * F.sqrt((n - 1).cast("double")))
        return F.when(n >= 2, fisher(one, p_runs, two_sided(serial))).otherwise(0.0)

    return F.element_at(F.transform(state, measured), 1)


def length_class(n: Column) -> Column:
    return F.when(n < 24, 20).when(n < 32, 24).when(n < 48, 32).when(n < 80, 48).otherwise(80)


def runs_of(text: Column) -> Column:
    """array<struct<start, end, kind, enc, len, p>> of the key-like runs of a text."""
    spans = located(text, RUN, KINDS.index("random"), tokens=True)
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["token"].alias("token"), encoding(F.rtrim(s["token"], F.lit("="))).alias("enc")))
    return F.transform(named, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["enc"].alias("enc"), length_class(s["end"] - s["start"]).alias("len"), battery(s["token"], s["enc"]).alias("p")))


def thresholds(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: a map from "encoding/length class" to the least accepted p. Counts are over all documents; the
    table of counts has at most encodings x length classes x bins rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = docs.where(text.rlike(RUN)).select(F.explode(runs_of(text)).alias("r")).select(F.concat_ws("/", "r.enc", "r.len").alias("cls"), F.least((F.col("r.p") * BINS).cast("int"), F.lit(BINS - 1)).alias("bin"))
    counts = runs.groupBy("cls", "bin").count().groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("by"))
    above = lambda c: F.aggregate(F.sequence(c, F.lit(BINS - 1)), F.lit(0.0), lambda acc, b: acc + F.coalesce(F.element_at(F.col("by"), b), F.lit(0)))
    false_share = lambda c: 1 - 2 * above(F.lit(BINS // 2)) * (1 - c / BINS) / above(c)
    good = F.filter(F.sequence(F.lit(0), F.lit(BINS // 2)), lambda c: (above(c) > 0) & (above(F.lit(BINS // 2)) > 0) & (false_share(c) <= FALSE_RATE))
    # the lowest cut above which all cuts are good too
    ok = F.filter(F.sequence(F.lit(0), F.lit(BINS // 2)), lambda c: F.forall(F.sequence(c, F.lit(BINS // 2)), lambda d: F.array_contains(good, d)))
    cuts = counts.select("cls", (F.array_min(ok) / BINS).alias("cut")).where("cut is not null")
    return cuts.agg(F.map_from_entries(F.collect_list(F.struct("cls", "cut"))).alias("__cuts"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``base`` and ``spans``, arrays of struct<start, end, kind>, sorted; kind is a place in KINDS.

    A run that overlaps a base span is not added. Columns named base and spans are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = without(docs, "base", "spans")
    base = F.array_sort(F.concat(located(text, ASSIGN, 0, LEAST_SECRET, 2), located(text, ACCESS, 1), located(text, HEX, 2)))
    order = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = kept.withColumn("base", order(base)).withColumn("__runs", F.when(text.rlike(RUN), runs_of(text)))
    out = out.crossJoin(F.broadcast(thresholds(docs, text_col)))  # one row, of at most 25 entries
    random = F.filter("__runs", lambda r: r["p"] >= F.element_at(F.col("__cuts"), F.concat_ws("/", r["enc"], r["len"].cast("string"))))
    random = F.transform(random, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind")))
    random = clear_of(random, F.col("base"))
    return out.withColumn("spans", F.coalesce(order(F.concat("base", random)), F.col("base"))).drop("__runs", "__cuts")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by a mark and n_chars set anew; texts without spans stay as
    they are, and so does every other column, whatever its name. Overlapping spans are replaced together."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # the scan's columns can't meet these
    found = scan(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()]), names["text"])
    text = F.col(names["text"])

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    gaps = gathered(F.col("spans"), {"at": F.lit(0)}, step, "struct<a:int,b:int>")
    tail = F.array(F.struct(F.array_max(F.transform("spans", lambda s: s["end"])).alias("a"), F.length(text).alias("b")))
    # a place in a text is found by walking to it, so the text is cut into pieces once and places are looked up in these
    cut = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.concat(gaps, tail).alias("gaps"))

    def between(pieces: Column, g: Column) -> Column:
        a, b = F.floor(g["a"] / PIECE).cast("int"), F.floor(g["b"] / PIECE).cast("int")
        head, end = F.coalesce(F.get(pieces, a), F.lit("")), F.coalesce(F.get(pieces, b), F.lit(""))
        inside = F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
        return F.when(a == b, F.substring(head, g["a"] % PIECE + 1, g["b"] - g["a"])).otherwise(F.concat(F.substring(head, g["a"] % PIECE + 1, F.lit(PIECE)), inside, F.substring(end, F.lit(1), g["b"] % PIECE)))

    clean = F.element_at(F.transform(F.array(cut), lambda c: F.array_join(F.transform(c["gaps"], lambda g: between(c["pieces"], g)), mark)), 1)
    hit = F.size("spans") > 0
    out = found.withColumn(names["text"], F.when(hit, clean).otherwise(text))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.when(hit, F.length(text).cast("bigint")).otherwise(F.col(names["n_chars"])))
    return out.select(*[F.col(k).alias(c) for c, k in names.items()])
