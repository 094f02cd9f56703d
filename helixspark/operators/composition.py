"""Word counts and composition statistics. Sequences are rows (id columns, seq); results are DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.functions import sequence as S


def words_table(df: DataFrame, size: int, alphabet: str = K.BASES) -> DataFrame:
    """All words of a size, one a row: a table of a fixed size, made by the executors."""
    n = len(alphabet)
    letters = [F.substring(F.lit(alphabet), (F.floor(F.col("id") / n**k) % n).cast("int") + 1, F.lit(1)) for k in range(size - 1, -1, -1)]
    return df.sparkSession.range(n**size).select(F.concat(*letters).alias("word"))


def count_words(df: DataFrame, keys: list[str], size: int, first: int = 0, by: int = 1, alphabet: str = K.BASES, seq: str = "seq", zeros: bool = True) -> DataFrame:
    """keys, word, n: how often each word of the alphabet occurs; words with other characters are not counted.

    Counts are combined before the shuffle. With zeros every word has a row for every key: each key's counts
    become one map (at most alphabet ** size entries), which is then read for every word."""
    found = df.select(*keys, F.explode_outer(S.kmers(F.col(seq), size, first, by)).alias("word"))
    valid = F.col("word").rlike(f"^[{alphabet}]+$")
    counts = found.withColumn("word", F.when(valid, F.col("word"))).groupBy(*keys, "word").agg(F.count("word").alias("n"))
    if not zeros:
        return counts.where("word is not null")
    entries = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "n")))
    maps = counts.groupBy(*keys).agg(F.map_from_entries(entries).alias("counts"))
    every = F.array(*[F.lit(w) for w in K.words(size, alphabet)])
    return maps.select(*keys, "counts", F.explode(every).alias("word")).select(*keys, "word", F.coalesce(F.try_element_at("counts", F.col("word")), F.lit(0)).cast("bigint").alias("n"))


def letter_counts(df: DataFrame, keys: list[str], letters: str, seq: str = "seq") -> DataFrame:
    """One column n_<letter> for each letter, summed over the key's rows; no explode."""
    return df.groupBy(*keys).agg(*[F.sum(S.times(F.col(seq), c)).cast("bigint").alias(f"n_{'stop' if c == '*' else c}") for c in letters])


def dinucleotides(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, word, n, total (of all words), length, and the two letters' counts n1 and n2. One shuffle of counts:
    letters' counts come from the sequence itself."""
    pairs = count_words(df, keys, 2, seq=seq)
    singles = letter_counts(df, keys, K.BASES, seq)
    joined = pairs.join(singles, keys).join(df.groupBy(*keys).agg(F.sum(F.length(seq)).alias("length")), keys)
    of = lambda i: F.coalesce(*[F.when(F.substring("word", i, 1) == b, F.col(f"n_{b}")) for b in K.BASES])
    total = F.aggregate("all_n", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    sums = pairs.groupBy(*keys).agg(F.collect_list("n").alias("all_n")).select(*keys, total.alias("total"))
    return joined.join(sums, keys).select(*keys, "word", "n", "total", "length", of(1).alias("n1"), of(2).alias("n2"), sum((F.col(f"n_{b}") for b in K.BASES), F.lit(0)).alias("letters"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rho(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, word, rho: frequency of a dinucleotide over the product of its letters'; null without data."""
    d = dinucleotides(df, keys, seq)
    return d.select(*keys, "word", ratio(F.col("n").cast("double") * F.col("letters") * F.col("letters"), F.col("total").cast("double") * F.col("n1") * F.col("n2")).alias("rho"))


def root(x: Column) -> Column:
    return F.when(x > 0, F.sqrt(x))


def zscore_base(df: DataFrame, keys: list[str], exact: bool = False, seq: str = "seq") -> DataFrame:
    """keys, word, z: rho against its expectation when bases are shuffled; null where the variance is not
    positive. exact takes the exact moments instead of the large-sample ones."""
    d = dinucleotides(df, keys, seq).withColumn("rho", ratio(F.col("n").cast("double") * F.col("letters") * F.col("letters"), F.col("total").cast("double") * F.col("n1") * F.col("n2")))
    n, x, y = F.col("length").cast("double"), F.col("n1").cast("double"), F.col("n2").cast("double")
    if not exact:
        fx, fy = ratio(x, F.col("letters")), ratio(y, F.col("letters"))
        return d.select(*keys, "word", F.try_divide(F.col("rho") - 1, root(F.try_divide((1 - fx) * (1 - fy), n * fx * fy))).alias("z"))
    same = F.substring("word", 1, 1) == F.substring("word", 2, 1)
    e = F.when(same, F.try_divide(n * (x - 1), x * (n - 1))).otherwise(F.try_divide(n, n - 1))
    v_same = F.try_divide(n * n * (x - 1), x * x * (n - 1) * (n - 1)) * (1 - x + F.try_divide(n, x) * (1 + F.try_divide(2 * (x - 2), n - 1) + F.try_divide((n - 4) * (x - 2) * (x - 3), (n - 2) * (n - 3))))
    v_diff = F.try_divide(n * n * n, (n - 1) * (n - 1) * x * y - F.try_divide(n * n, (n - 1) * (n - 1)) + F.try_divide(n * n * n * (n - 4) * (x - 1) * (y - 1), x * y * (n - 2) * (n - 3) * (n - 1) * (n - 1)))
    return d.select(*keys, "word", F.try_divide(F.col("rho") - e, root(F.when(same, v_same).otherwise(v_diff))).alias("z"))


def zscore_simulated(df: DataFrame, keys: list[str], model: str = "base", simulations: int = 100, seed: int = 1, seq: str = "seq") -> DataFrame:
    """keys, word, rho, mean, var, z: rho against its mean and variance over shuffled replicates of the sequences (base, position, codon or
    syncodon; see ``codon.permuted``). Replicates are rows, dealt by key and number, so those of one sequence are spread over tasks;
    only the replicates' moments come together. Numbers seed the shuffles, so all runs agree. z is null where the variance is not positive."""
    from helixspark.operators.codon import permuted

    copies = df.select(*keys, F.col(seq).alias("seq"), F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("replicate")).repartition(*keys, "replicate")
    shuffled = copies.select(*keys, "replicate", permuted(F.col("seq"), model, F.xxhash64(F.lit(seed), "replicate")).alias("seq"))
    moments = rho(shuffled, [*keys, "replicate"]).groupBy(*keys, "word").agg(F.avg("rho").alias("mean"), F.var_samp("rho").alias("var"))
    return rho(df, keys, seq).join(moments, [*keys, "word"], "left").select(*keys, "word", "rho", "mean", "var", F.try_divide(F.col("rho") - F.col("mean"), root(F.col("var"))).alias("z"))


def rho_words(df: DataFrame, keys: list[str], size: int = 2, seq: str = "seq") -> DataFrame:
    """keys, word, rho of words of any size: a word's frequency over the product of its letters'; null without data."""
    counts = count_words(df, keys, size, seq=seq)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    singles = letter_counts(df, keys, K.BASES, seq).withColumn("letters", sum((F.col(f"n_{b}") for b in K.BASES), F.lit(0)))
    of = lambda i: F.coalesce(*[F.when(F.substring("word", i, 1) == b, F.col(f"n_{b}")) for b in K.BASES])
    expected = F.lit(1.0)
    for i in range(1, size + 1):
        expected = expected * ratio(of(i), F.col("letters"))
    return counts.join(totals, keys).join(singles, keys).select(*keys, "word", F.try_divide(ratio(F.col("n"), F.col("total")), expected).alias("rho"))


def zscore_codon(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, word, z: dinucleotides across codon borders (last base, next first base) against shuffled codons.
    Rows of one key count as one sequence each; keys should be those of a sequence."""
    whole = S.splitseq(F.col(seq))
    ends = df.select(*keys, whole.alias("codons"), F.col(seq).alias("s"))
    border = S.kmers(F.col("s"), 2, 2, 3)
    first = lambda b: F.size(F.filter("codons", lambda c: F.substring(c, 1, 1) == b))
    third = lambda b: F.size(F.filter("codons", lambda c: F.substring(c, 3, 1) == b))
    rows = []
    for w in K.words(2):
        rows.append(F.struct(F.lit(w).alias("word"), third(w[0]).alias("n1"), first(w[1]).alias("n2"), _both(w).alias("n3")))
    d = ends.where(F.length("s") >= 4).withColumn("borders", border).select(*keys, "borders", F.size("codons").cast("double").alias("n"), F.explode(F.array(*rows)).alias("r"))
    xy = F.size(F.filter("borders", lambda p: p == F.col("r.word"))).cast("double")
    n, n1, n2, n3 = F.col("n"), F.col("r.n1").cast("double"), F.col("r.n2").cast("double"), F.col("r.n3").cast("double")
    e = F.try_divide(n1 * n2 - n3, n)
    v = e + F.try_divide(2 * n3 * (n1 + n2 - n1 * n2 - 1) + n1 * n2 * (n1 - 1) * (n2 - 1), n * (n - 1)) - e * e
    return d.select(*keys, F.col("r.word").alias("word"), F.try_divide(xy - e, root(v)).alias("z"))


def _both(word: str) -> Column:
    """Codons that end with the word's first letter and begin with its second."""
    last, first = word
    return F.size(F.filter("codons", lambda c: (F.substring(c, 3, 1) == last) & (F.substring(c, 1, 1) == first)))


def amino_table(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, aa, n over the 21 symbols, zeros included."""
    counted = letter_counts(df, keys, "".join(K.AMINO), seq)
    cells = [F.struct(F.lit(aa).alias("aa"), F.col(f"n_{'stop' if aa == '*' else aa}").alias("n")) for aa in K.AMINO]
    return counted.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.aa", "c.n")


def residue_classes(seq: Column) -> dict[str, Column]:
    """Share of the residues in each physico-chemical class."""
    return {name: F.try_divide(S.times(seq, members).cast("double"), F.length(seq)) for name, members in K.CLASSES.items()}


def molecular_weight(seq: Column, gravity: float = 9.81, unit: str = "gram") -> Column:
    """Of a protein, free of stops: residues' weights less a water for each bond; null if it has no residue."""
    scale = gravity / 9.81 if unit == "gram" else gravity / 1000
    n = S.times(seq, "ACDEFGHIKLMNPQRSTVWY")
    total = sum((S.times(seq, aa) * K.residue_mass(aa) for aa in K.FORMULAS), F.lit(0.0))
    return F.when(n > 0, (total - (n - 1) * K.WATER) * scale)


def isoelectric_point(seq: Column, steps: int = 14, newton: int = 4) -> Column:
    """The pH at which the net charge is zero: bisection on the charge, which falls with pH, and then Newton's steps within
    the bracket, which double the digits each time."""
    clean = F.replace(seq, F.lit("*"), F.lit(""))
    first, last = F.substring(clean, 1, 1), F.substring(clean, -1, 1)
    n_term, c_term = F.lit(K.PK_N_TERM), F.lit(K.PK_C_TERM)
    for aa, pk in K.PK_N_SPECIAL.items():
        n_term = F.when(first == aa, pk).otherwise(n_term)
    for aa, pk in K.PK_C_SPECIAL.items():
        c_term = F.when(last == aa, pk).otherwise(c_term)
    counts = F.struct(*[S.times(clean, aa).cast("double").alias(aa) for aa in K.PK_SIDE], n_term.alias("n_term"), c_term.alias("c_term"))

    def solved(c: Column) -> Column:
        one = F.lit(1.0)
        groups = [(one, c["n_term"], 1.0), *((c[aa], F.lit(K.PK_SIDE[aa]), 1.0) for aa in "RHK"), (one, c["c_term"], -1.0), *((c[aa], F.lit(K.PK_SIDE[aa]), -1.0) for aa in "DECY")]
        part = lambda ph, pk, sign: 1 / (1 + F.pow(F.lit(10.0), (ph - pk) * sign))
        charge = lambda ph: sum((n * part(ph, pk, sign) * sign for n, pk, sign in groups), F.lit(0.0))

        def step(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            return F.element_at(F.transform(F.array(charge(mid) > 0), lambda up: F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))), 1)

        def sharper(acc: Column, _: Column) -> Column:
            ph = acc["ph"]
            of = F.array(*[part(ph, pk, sign) for _, pk, sign in groups])  # computed once for charge and slope
            move = lambda f: F.struct(
                sum((n * f[k] * sign for k, (n, _, sign) in enumerate(groups)), F.lit(0.0)).alias("up"),
                sum((n * f[k] * (1 - f[k]) for k, (n, _, _) in enumerate(groups)), F.lit(0.0)).alias("fall"),
            )
            new = lambda m: ph + F.coalesce(F.try_divide(m["up"], m["fall"] * math.log(10)), F.lit(0.0))
            moved = F.element_at(F.transform(F.transform(F.array(of), move), new), 1)
            return F.struct(F.least(F.greatest(moved, acc["lo"]), acc["hi"]).alias("ph"), acc["lo"].alias("lo"), acc["hi"].alias("hi"))

        def finish(acc: Column) -> Column:
            start = F.struct(((acc["lo"] + acc["hi"]) / 2).alias("ph"), acc["lo"].alias("lo"), acc["hi"].alias("hi"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(newton)), start, sharper, lambda a: a["ph"])

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi")), step, finish)

    return F.when(F.length(clean) > 0, F.element_at(F.transform(F.array(counts), solved), 1))


def moving_gc_skew(df: DataFrame, keys: list[str], window: int, seq: str = "seq") -> DataFrame:
    """keys, w, c, g, skew over fixed windows: (c - g) / (c + g), null without either. A row of any length is cut
    into windows before anything is counted."""
    pieces = F.when(F.length(seq) > 0, F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{window}}}"), F.lit(0))).otherwise(F.array(F.lit("")))
    cut = df.select(*keys, F.posexplode(pieces).alias("w", "s"))
    c, g = S.times(F.col("s"), "c").cast("bigint"), S.times(F.col("s"), "g").cast("bigint")
    return cut.select(*keys, "w", c.alias("c"), g.alias("g"), ratio(c - g, c + g).alias("skew"))
