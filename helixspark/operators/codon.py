"""Codon usage and synonymous codons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.functions import sequence as S
from helixspark.operators.composition import count_words


def amino_of(codon: Column, numcode: int = 1) -> Column:
    return S.translate(codon, numcode=numcode)


def usage(df: DataFrame, keys: list[str], frame: int = 0, seq: str = "seq") -> DataFrame:
    """keys, codon, aa, eff, freq, rscu over all 64 codons. freq divides by the whole codons that the sequences'
    lengths hold, whatever the frame and whether they are valid; rscu is relative to the mean of the codons of the amino acid
    in the standard code, null if that has none."""
    counts = count_words(df, keys, 3, frame, 3, seq=seq).withColumnRenamed("word", "codon").withColumn("aa", amino_of(F.col("codon")))
    sizes = df.groupBy(*keys).agg(F.sum(F.floor(F.length(seq) / 3)).cast("bigint").alias("whole"))
    within = Window.partitionBy(*keys, "aa")
    out = counts.withColumn("rscu", F.try_divide(F.col("n") * F.count("*").over(within).cast("double"), F.sum("n").over(within)))
    return out.join(sizes, keys).select(*keys, "codon", "aa", F.col("n").alias("eff"), F.try_divide(F.col("n").cast("double"), F.col("whole")).alias("freq"), "rscu")


def usage_ranks(used: DataFrame, keys: list[str], value: str = "eff") -> DataFrame:
    """used (keys, codon, aa, value) with the amino acid's total, its place among the amino acids by total (the smallest first) and the codon's
    place among its amino acid's by value; equal values share the first place."""
    within = Window.partitionBy(*keys, "aa")
    rows = used.withColumns({"total": F.sum(value).over(within), "place": F.rank().over(within.orderBy(value))})
    totals = rows.groupBy(*keys, "aa", "total").agg(F.count("*").alias("codons"))
    ranked = totals.withColumn("aa_place", F.rank().over(Window.partitionBy(*keys).orderBy("total"))).select(*keys, "aa", "aa_place")
    return rows.join(ranked, [*keys, "aa"])


def weights(counts: DataFrame, numcode: int = 1) -> DataFrame:
    """codon, w from (codon, n): a codon's count over the largest of its amino acid. At most 64 rows."""
    within = Window.partitionBy("aa")
    return counts.withColumn("aa", amino_of(F.col("codon"), numcode)).select("codon", F.try_divide(F.col("n").cast("double"), F.max("n").over(within)).alias("w"))


def cai(df: DataFrame, keys: list[str], w: DataFrame, numcode: int = 1, least: float = 1e-4, instead: float = 0.01, seq: str = "seq") -> DataFrame:
    """keys, cai: the geometric mean of the codons' weights; stops and amino acids with one codon are left out."""
    single = [aa for aa in K.AMINO if K.CODES[numcode].count(aa) == 1]
    used = w.withColumn("aa", amino_of(F.col("codon"), numcode)).where(~F.col("aa").isin(["*", *single])).select("codon", F.ln(F.when(F.col("w") < least, instead).otherwise(F.col("w"))).alias("ln_w"))
    table = used.agg(F.map_from_entries(F.collect_list(F.struct("codon", "ln_w"))).alias("__m")).select(F.array(*[F.try_element_at("__m", F.lit(c)) for c in K.words(3)]).alias("__ln_w"))
    # one row of 64 numbers; a sequence is then read once, where it is, and only its sum and number are grouped
    place = lambda c, i: F.instr(F.lit(K.BASES), F.substring(c, i, 1)) - 1
    of = lambda c: F.when(c.rlike("^[acgt]{3}$"), F.get("__ln_w", 16 * place(c, 1) + 4 * place(c, 2) + place(c, 3)))
    known = F.filter(F.transform(S.splitseq(F.lower(F.col(seq))), of), lambda x: x.isNotNull())
    both = F.element_at(F.transform(F.array(known), lambda xs: F.struct(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(xs).alias("n"))), 1)
    rows = df.where(F.col(seq).isNotNull()).crossJoin(F.broadcast(table)).select(*keys, both.alias("__b"))
    sums = rows.groupBy(*keys).agg(F.sum("__b.s").alias("__s"), F.sum("__b.n").alias("__n")).where("__n > 0")
    return sums.select(*keys, F.exp(F.col("__s") / F.col("__n")).alias("cai"))


def synonyms(codon: Column, numcode: int = 1) -> Column:
    """The codons of the same amino acid, in alphabetical order."""
    table = K.code(numcode)
    sets = {c: sorted(d for d in table if table[d] == aa) for c, aa in table.items()}
    pairs = [x for c, ds in sets.items() for x in (F.lit(c), F.array(*[F.lit(d) for d in ds]))]
    return F.try_element_at(F.create_map(*pairs), F.lower(codon))


def by_amino(df: DataFrame, keys: list[str], numcode: int = 1, seq: str = "seq") -> DataFrame:
    """keys, aa, codons: counts of each amino acid's codons as a map, in alphabetical order."""
    counts = count_words(df, keys, 3, 0, 3, seq=seq).withColumn("aa", amino_of(F.col("word"), numcode))
    return counts.groupBy(*keys, "aa").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "n")))).alias("codons"))


def code_table(spark, numcode: int = 1) -> DataFrame:
    """codon, aa of a genetic code."""
    return spark.createDataFrame(sorted(K.code(numcode).items()), "codon string, aa string")


def permuted(seq: Column, model: str, seed: int | Column = 1, numcode: int = 1) -> Column:
    """A shuffled sequence. base: all letters; position: the letters of each codon position among themselves;
    codon: whole codons; syncodon: codons within their amino acid, so the protein stays. Letters after the last
    whole codon stay at the end, but for base. The order follows a hash of the sequence, seed and place."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    mixed = lambda xs, salt: F.transform(F.array_sort(F.transform(xs, lambda x, i: F.struct(F.xxhash64(seq, seed, F.lit(salt), i).alias("h"), x.alias("x")))), lambda p: p["x"])
    if model == "base":
        return S.join(mixed(S.chars(seq), 0))
    rest = F.substring(seq, F.length(seq) - F.length(seq) % 3 + 1, F.length(seq) % 3)
    codons = S.splitseq(seq)
    if model == "codon":
        return F.concat(S.join(mixed(codons, 0)), rest)
    if model == "position":
        thirds = [mixed(_letters(codons, k), k) for k in (1, 2, 3)]
        return F.concat(S.join(F.zip_with(F.zip_with(thirds[0], thirds[1], lambda a, b: F.concat(a, b)), thirds[2], lambda a, b: F.concat(a, b))), rest)
    if model != "syncodon":
        raise ValueError(f"no such model: {model}")
    # places sorted by (amino acid, place) take codons sorted by (amino acid, hash)
    tagged = F.transform(codons, lambda c, i: F.struct(amino_of(c, numcode).alias("aa"), i.alias("i"), c.alias("c")))
    places = F.array_sort(F.transform(tagged, lambda t: F.struct(t["aa"].alias("aa"), t["i"].alias("i"))))
    drawn = F.array_sort(F.transform(tagged, lambda t: F.struct(t["aa"].alias("aa"), F.xxhash64(seq, seed, t["i"]).alias("h"), t["c"].alias("c"))))
    put = F.array_sort(F.zip_with(places, drawn, lambda p, d: F.struct(p["i"].alias("i"), d["c"].alias("c"))))
    return F.concat(S.join(F.transform(put, lambda p: p["c"])), rest)


def drawn(seq: Column, weights: dict[str, float], seed: int | Column = 1, numcode: int = 1) -> Column:
    """A sequence with the same protein whose codons are drawn by weights, independently in each place. Of an amino acid's codons that
    with the smallest exponential of rate w is taken, which is codon c with probability w(c) over the amino acid's sum; the exponentials
    come from a hash of sequence, seed, place and codon. Codons with other letters than acgt, and letters after the last whole
    codon, stay. An amino acid of the sequence without any weight is an error."""
    table = K.code(numcode)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    sets = {aa: [(c, float(weights.get(c, 0))) for c in sorted(table) if table[c] == aa and weights.get(c, 0) > 0] for aa in set(table.values())}
    urns = F.create_map(*[x for aa, urn in sorted(sets.items()) if urn for x in (F.lit(aa), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(w).alias("w")) for c, w in urn]))])
    rest = F.substring(seq, F.length(seq) - F.length(seq) % 3 + 1, F.length(seq) % 3)

    def draw(codon: Column, i: Column) -> Column:
        # 53 bits of the hash; never 0
        u = lambda x: (F.shiftrightunsigned(F.xxhash64(seq, seed, i, x["c"]), 11) + 0.5) / float(2**53)
        keys = F.transform(F.try_element_at(urns, amino_of(codon, numcode)), lambda x: F.struct((-F.ln(u(x)) / x["w"]).alias("key"), x["c"].alias("c")))
        found = F.array_min(keys)["c"]
        return F.when(codon.rlike("^[acgt]{3}$"), F.coalesce(found, F.raise_error(F.concat(F.lit("no weight for any codon of the amino acid of "), codon)))).otherwise(codon)

    return F.concat(S.join(F.transform(S.splitseq(F.lower(seq)), draw)), rest)


def _letters(codons: Column, k: int) -> Column:
    return F.transform(codons, lambda c: F.substring(c, k, 1))
