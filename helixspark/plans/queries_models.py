"""Queries of simulations, near matches, breaks, class analyses and drawn sequences, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.functions import sequence as S
from helixspark.functions import sql as functions_sql
from helixspark.operators import alignment as A
from helixspark.operators import codon as C
from helixspark.operators import composition as P
from helixspark.operators import forensics as X
from helixspark.operators import genome as G
from helixspark.operators import multivariate as M
from helixspark.plans.queries import B, CODE, DNA, _translate_sql, dna, query, r6, sql_words, t


@query()
def zscore_replicates(spark, d):
    """Dinucleotides of the benchmark's items against shuffles of their codons."""
    items = t(spark, d, "benchmark").select("item_id", S.dna(F.col("text")).alias("seq"))
    return P.zscore_simulated(items, ["item_id"], "codon", 24)


@query(f"""WITH {DNA}, k AS (SELECT lang, word, count(*) AS n FROM {sql_words(3)} GROUP BY lang, word), s AS (SELECT lang, sum(n) AS total FROM k GROUP BY lang),
l AS (SELECT lang, CAST(sum(length(seq)) AS DOUBLE) AS len, {', '.join(f"sum(length(seq) - length(replace(seq, '{b}', ''))) AS n_{b}" for b in 'acgt')} FROM dna GROUP BY lang), w AS (SELECT a.x || b.x || c.x AS word FROM {B} a(x), {B} b(x), {B} c(x))
SELECT l.lang, w.word, round((coalesce(n, 0) / total) / nullif({' * '.join(f"(CASE substr(w.word, {i}, 1) WHEN 'a' THEN n_a WHEN 'c' THEN n_c WHEN 'g' THEN n_g ELSE n_t END / len)" for i in (1, 2, 3))}, 0), 6) AS rho
FROM l JOIN s USING (lang) CROSS JOIN w LEFT JOIN k ON k.lang = l.lang AND k.word = w.word""")
def rho3(spark, d):
    return P.rho_words(dna(spark, d), ["lang"], 3).withColumn("rho", r6(F.col("rho")))


NEAR = " UNION ".join(f"SELECT a.id_a, b.id_b, a.i, b.j, a.w AS wa, b.w AS wb FROM a JOIN b ON substr(a.w, {8 * k + 1}, 8) = substr(b.w, {8 * k + 1}, 8)" for k in range(3))


@query(f"""WITH {DNA}, m AS (SELECT item_id, lower(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS seq FROM benchmark),
a AS (SELECT doc_id AS id_a, i, substr(seq, i, 24) AS w FROM (SELECT doc_id, seq, unnest(range(1, greatest(length(seq) - 22, 1))) AS i FROM dna)), b AS (SELECT item_id AS id_b, j, substr(seq, j, 24) AS w FROM (SELECT item_id, seq, unnest(range(1, greatest(length(seq) - 22, 1), 3)) AS j FROM m)), n AS ({NEAR})
SELECT id_a, id_b, i, j, CAST(24 - hamming(wa, wb) AS BIGINT) AS same FROM n WHERE hamming(wa, wb) <= 2""")
def dotplot_near(spark, d):
    """Windows of 24 that agree in 22 places at least; the items' windows in steps of 3."""
    items = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), S.dna(F.col("text")).alias("seq"))
    out = A.near_dot_plot(dna(spark, d).withColumnRenamed("doc_id", "id"), items, 24, 22, steps=(1, 3))
    return out.select("id_a", "id_b", *[F.col(c).cast("bigint").alias(c) for c in ("i", "j", "same")])


CELLS = """s AS (SELECT user_id, min(epoch(ts)) AS lo, max(epoch(ts)) AS hi FROM events WHERE value IS NOT NULL GROUP BY user_id),
e AS (SELECT e.user_id, epoch(ts) - lo AS u, value AS v, lo, hi FROM events e JOIN s USING (user_id) WHERE value IS NOT NULL),
c AS (SELECT user_id, least(coalesce(CAST(floor(u * 20 / nullif(hi - lo, 0)) AS INT), 0), 19) AS cell, count(*) AS n, sum(u) AS u, sum(v) AS v, sum(u * v) AS uv FROM e GROUP BY ALL)"""


def _timed(spark, d):
    return t(spark, d, "events").where("value is not null").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "value")


@query(f"WITH {CELLS} SELECT user_id, cell, n, round(u / 1e3, 3) AS u, round(v, 3) AS v, round(uv / 1e6, 3) AS uv FROM c")
def break_cells(spark, d):
    """The sums by cell from which breaks are found."""
    c = G.cell_sums(_timed(spark, d), ["user_id"], "at", "value", 20)
    return c.select("user_id", "cell", F.col("n").cast("bigint").alias("n"), F.round(F.col("u") / 1e3, 3).alias("u"), F.round("v", 3).alias("v"), F.round(F.col("uv") / 1e6, 3).alias("uv"))


@query()
def skew_breaks(spark, d):
    """Three breaks in each language's cumulated skew."""
    return G.breakpoints(G.origin_walk(dna(spark, d), ["lang"], "doc_id"), ["lang"], "doc_id", "skew", 3)


def _codon_table(spark, d, key):
    return P.count_words(dna(spark, d), [key], 3, by=3).groupBy(key).pivot("word", K.words(3)).agg(F.first("n"))


INERTIA = f"""WITH {DNA}, {CODE}, k AS (SELECT lang, word AS codon, CAST(count(*) AS DOUBLE) AS n FROM {sql_words(3, 3)} GROUP BY ALL), x AS (SELECT k.*, aa FROM k JOIN code USING (codon)), t AS (SELECT sum(n) AS t FROM x),
r AS (SELECT lang, sum(n) AS r FROM x GROUP BY lang), c AS (SELECT codon, aa, sum(n) AS c FROM x GROUP BY ALL), g AS (SELECT aa, sum(n) AS g FROM x GROUP BY aa), rg AS (SELECT lang, aa, sum(n) AS rg FROM x GROUP BY ALL),
z AS (SELECT coalesce(x.n, 0) AS n, r, c, t, coalesce(rg, 0) AS rg, g FROM r CROSS JOIN c CROSS JOIN t JOIN g USING (aa) LEFT JOIN x ON x.lang = r.lang AND x.codon = c.codon LEFT JOIN rg ON rg.lang = r.lang AND rg.aa = c.aa)
SELECT round(sum(pow(n - r * c / t, 2) * t / (r * c)) / any_value(t), 7) AS total, round(sum(pow(rg * c / g - r * c / t, 2) * t / (r * c)) / any_value(t), 7) AS between_classes, round(sum(pow(n - rg * c / g, 2) * t / (r * c)) / any_value(t), 7) AS within_classes FROM z"""


@query(INERTIA)
def codon_inertia(spark, d):
    """Inertia of languages' codon use, between and within amino acids; from the eigenvalues of either analysis."""
    table = _codon_table(spark, d, "lang")
    _, between, inertia = M.class_analysis(table, "lang", K.words(3), K.code(1), "between")
    _, within, _ = M.class_analysis(table, "lang", K.words(3), K.code(1), "within")
    row = (inertia["total"], float(sum(between)), float(sum(within)))
    return spark.createDataFrame([tuple(round(x, 7) for x in row)], "total double, between_classes double, within_classes double")


@query()
def codon_within(spark, d):
    """Documents on the axes of synonymous codon use."""
    return M.class_analysis(_codon_table(spark, d, "doc_id"), "doc_id", K.words(3), K.code(1), "within", axes=4)[0]


@query(f"""SELECT doc_id, protein, CASE WHEN len(list_distinct(list_transform(range(1, length(seq) - 1, 3), lambda i: substr(seq, i, 3)))) >= 40 THEN true END AS moved
FROM ({_translate_sql('seq', 1, 0)}) JOIN (WITH {DNA} SELECT doc_id, seq FROM dna) USING (doc_id)""")
def synonymous_draws(spark, d):
    """Codons drawn by their use in all documents (64 numbers): the protein stays, the sequence does not."""
    seqs = dna(spark, d)
    use = P.count_words(seqs.select(F.lit(1).alias("one"), "seq"), ["one"], 3, by=3).collect()
    drawn = seqs.select("doc_id", "seq", C.drawn(F.col("seq"), {r["word"]: float(r["n"]) for r in use}).alias("new"))
    varied = F.size(F.array_distinct(S.splitseq(F.col("seq")))) >= 40
    return drawn.select("doc_id", S.translate(F.col("new")).alias("protein"), F.when(varied, F.col("new") != F.col("seq")).alias("moved"))


@query()
def trace_stutters(spark, d):
    """Peaks of users' values taken as alleles, with what comes before them."""
    from pyspark.sql import Window

    e = t(spark, d, "events").where("value is not null").withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    top = e.groupBy("user_id").agg(F.max_by("at", F.struct("value", -F.col("at"))).alias("place"))
    return X.stutters(e, top, ["user_id"], "at", "value")


@query(f"WITH {DNA} SELECT lang, word, count(*) AS n FROM {sql_words(2)} WHERE lang IS NOT NULL GROUP BY lang, word")
def lateral_words(spark, d):
    """Words by the table function, in SQL."""
    functions_sql.register(spark)
    dna(spark, d).createOrReplaceTempView("helix_dna")
    return spark.sql("SELECT lang, w.word, count(*) AS n FROM helix_dna, LATERAL seq_words(seq, 2) w WHERE lang IS NOT NULL GROUP BY lang, w.word")


PRIMERS = ("gattac", "catgca")


def _site_sql(name: str, primer: str) -> str:
    miss = " + ".join(f"CAST(substr(seq, i + {k}, 1) <> '{c}' AS INT)" for k, c in enumerate(primer))
    return f"""{name}w AS (SELECT doc_id, i, {miss} AS miss FROM (SELECT doc_id, seq, unnest(range(1, greatest(length(seq) - {len(primer) - 2}, 1))) AS i FROM dna)),
{name} AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY miss, i) AS r FROM {name}w) WHERE r = 1 AND miss <= 2)"""


@query(f"""WITH {DNA}, {_site_sql('p', 'gtaatc')}, {_site_sql('q', 'tgcatg')} SELECT p.doc_id, CAST(abs(q.i - p.i) + 6 AS BIGINT) AS length, p.i AS pos_first, q.i AS pos_second FROM p JOIN q USING (doc_id)""")
def primer_fragments(spark, d):
    """Fragments between two primers of the other strand, two mismatches allowed in each."""
    found = dna(spark, d).select("doc_id", S.amplified(F.col("seq"), *PRIMERS, forward=False, most=2).alias("f")).where("f is not null")
    return found.select("doc_id", *[F.col(f"f.{c}").cast("bigint").alias(c) for c in ("length", "pos_first", "pos_second")])


@query(f"""WITH {DNA}, {CODE}, k AS (SELECT lang, word AS codon, count(*) AS n FROM {sql_words(3, 3)} GROUP BY ALL), u AS (SELECT l.lang, codon, aa, coalesce(k.n, 0) AS eff FROM (SELECT DISTINCT lang FROM dna) l CROSS JOIN code LEFT JOIN k USING (lang, codon)),
t AS (SELECT lang, aa, CAST(sum(eff) AS BIGINT) AS total FROM u GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY total) AS aa_place FROM t)
SELECT u.lang, u.aa, codon, eff, total, aa_place, rank() OVER (PARTITION BY u.lang, u.aa ORDER BY eff) AS place FROM u JOIN r USING (lang, aa)""")
def usage_ranks(spark, d):
    """Codons by use inside their amino acid, and amino acids by use."""
    out = C.usage_ranks(C.usage(dna(spark, d), ["lang"]).select("lang", "codon", "aa", "eff"), ["lang"])
    return out.select("lang", "aa", "codon", "eff", "total", *[F.col(c).cast("bigint").alias(c) for c in ("aa_place", "place")])


@query("""WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, CAST(sum(length(o_orderpriority)) AS BIGINT) AS r FROM orders GROUP BY ALL)
SELECT CAST(y * 100 + m AS DOUBLE) AS release, lpad(CAST(m AS VARCHAR), 2, '0') || '/' || y AS month, CAST(n AS DOUBLE) AS entries, CAST(r AS DOUBLE) AS nucleotides, round((m - 1) / 12.0::DOUBLE + y, 8) AS date FROM m""")
def growth_read_back(spark, d):
    """Orders by month written as release notes, and their table read back."""
    from helixspark.sources.fasta import read_growth
    from helixspark.sources.shared import new_path

    o = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"), F.sum(F.length("o_orderpriority")).alias("r"))
    line = F.concat_ws("   ", F.col("y") * 100 + F.col("m"), F.concat(F.lpad(F.col("m").cast("string"), 2, "0"), F.lit("/"), "y"), "n", "r")
    path = new_path(spark, "notes")
    notes = o.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t")).select(F.concat(F.lit("Notes\n\n   Release  Month  Entries  Nucleotides\n\n"), "t"))  # a line for each month
    notes.write.text(path)
    return read_growth(spark, path).withColumn("date", F.round("date", 8))


GENOME = f"""WITH {DNA}, g AS (SELECT doc_id, length(seq) AS n, lower(substr(seq, 5) || left(seq, 4)) AS seq, seq AS was FROM dna WHERE length(seq) >= 80),
c AS (SELECT doc_id, n, seq, unnest([{{'gene': 1, 's': 11, 'e': 40}}, {{'gene': 2, 's': n, 'e': n - 22}}, {{'gene': 3, 's': n - 9, 'e': 18}}, {{'gene': 4, 's': 14, 'e': n - 7}}, {{'gene': 5, 's': 50 + doc_id % 9, 'e': 30}}]) AS c FROM g),
r AS (SELECT doc_id, n, seq, c.gene AS gene, CASE WHEN c.s - 4 < 1 THEN c.s - 4 + n ELSE c.s - 4 END AS s, CASE WHEN c.e - 4 < 1 THEN c.e - 4 + n ELSE c.e - 4 END AS e FROM c),
w AS (SELECT *, abs(e - s) > n / 2.0 AS wraps FROM r), d AS (SELECT *, CASE WHEN wraps THEN s > e ELSE s < e END AS direct FROM w),
p AS (SELECT doc_id, gene, n, seq, s, e, direct, unnest(CASE WHEN direct THEN range(s + 2, CASE WHEN wraps THEN n + e ELSE e END + 1, 3) ELSE range(s - 2, CASE WHEN wraps THEN e - n ELSE e END - 1, -3) END) AS i FROM d),
l AS (SELECT doc_id, gene, substr(seq, CASE WHEN i > n THEN i - n WHEN i < 1 THEN i + n ELSE i END, 1) AS b FROM p),
k AS (SELECT doc_id, gene, count_if(b = 't') - count_if(b = 'a') AS x, count_if(b = 'c') - count_if(b = 'g') AS y FROM l GROUP BY ALL)
SELECT d.doc_id, CAST(d.gene AS BIGINT) AS gene, (s + e) / 2000.0::DOUBLE AS place, CAST(CASE WHEN direct THEN 1 ELSE -1 END AS BIGINT) AS excess, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM d JOIN k USING (doc_id, gene)"""


def _genome(spark, d):
    seqs = dna(spark, d).where("length(seq) >= 80").select("doc_id", "seq")
    n = F.length("seq")
    ends = {1: (F.lit(11), F.lit(40)), 2: (n, n - 22), 3: (n - 9, F.lit(18)), 4: (F.lit(14), n - 7), 5: (50 + F.col("doc_id") % 9, F.lit(30))}
    cells = F.array(*[F.struct(F.lit(k).alias("gene"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end")) for k, (a, b) in ends.items()])
    return seqs, seqs.select("doc_id", F.explode(cells).alias("g")).select("doc_id", "g.gene", "g.start", "g.end")


@query(GENOME)
def gene_skews(spark, d):
    """Third positions of genes on both strands of circular genomes, some around the origin, which is moved by four bases."""
    return G.gene_skews(*_genome(spark, d), "doc_id", rotation=4)


@query(f"""WITH s AS ({GENOME}), c AS (SELECT doc_id, place, gene, CAST(sum(excess) OVER w AS BIGINT) AS excess, CAST(sum(x) OVER w AS DOUBLE) AS x, CAST(sum(y) OVER w AS DOUBLE) AS y FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY place, gene ROWS UNBOUNDED PRECEDING)),
m AS (SELECT doc_id, atan2(2 * sum(x * y), sum(x * x) - sum(y * y)) / 2 AS angle FROM c GROUP BY doc_id), p AS (SELECT c.*, x * cos(angle) + y * sin(angle) AS s FROM c JOIN m USING (doc_id)), g AS (SELECT doc_id, CASE WHEN covar_pop(s, y) < -1e-9 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM p GROUP BY doc_id)
SELECT doc_id, gene, excess, x, y, round(abs(s), 5) AS skew FROM p JOIN g USING (doc_id)""")
def genome_walk(spark, d):
    """The walk over these genes; the projection's size."""
    return G.genome_walk(*_genome(spark, d), "doc_id", rotation=4).select("doc_id", "gene", "excess", "x", "y", F.round(F.abs("skew"), 5).alias("skew"))
