"""Queries of windows, stretches between stops and their tests, as-of matches and files read back, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.functions import tails
from helixspark.operators import genome as G
from helixspark.operators import ordered as O
from helixspark.operators import recstat as R
from helixspark.plans.queries import DNA, dna, query, r6, t
from helixspark.sources import fasta
from helixspark.sources.shared import new_path

# Files ---------------------------------------------------------------------------------------------------------


@query(f"WITH {DNA} SELECT 'd' || doc_id AS name, '>d' || doc_id || ' ' || coalesce(source, '-') AS annot, coalesce(seq, '') AS seq FROM dna")
def fasta_read_back(spark, d):
    """Written as FASTA, read by byte ranges."""
    path = new_path(spark, "fasta")
    rows = dna(spark, d).select(F.concat(F.lit("d"), "doc_id", F.lit(" "), F.coalesce("source", F.lit("-"))).alias("name"), F.coalesce("seq", F.lit("")).alias("seq"))
    fasta.write_fasta(rows, path)
    return fasta.read_fasta(spark, path).select("name", "annot", "seq")


GENES = "WITH s AS (SELECT doc_id, coalesce(lang, '-') AS lang, 20 + doc_id % 7 AS n FROM documents)"


@query(f"""{GENES}, e AS (SELECT lang AS gene, 1 + doc_id % 5 AS b, n AS e FROM s UNION SELECT lang, n + 5, n + 30 FROM s UNION SELECT '', n + 60 + doc_id % 3, n + 40 FROM s)
SELECT gene, CAST(b AS INT) AS "begin", CAST(e AS INT) AS "end" FROM e""")
def exon_table(spark, d):
    """A GenBank entry a document, written and read back: one joined CDS with a gene, one on the complement without."""
    pad = "\n" + " " * 21
    path = new_path(spark, "genbank")
    n = 20 + F.col("doc_id") % 7
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    entry = text(
        "LOCUS       D", F.col("doc_id"), " 9 bp\nFEATURES             Location/Qualifiers\n     source          1..9\n     CDS             join(", 1 + F.col("doc_id") % 5, "..", n, f",{pad}<", n + 5, "..>", n + 30, f"){pad}/note=\"x\"{pad}/gene=\"",
        F.coalesce("lang", F.lit("-")), "\"\n     CDS             complement(", n + 40, "..", n + 60 + F.col("doc_id") % 3, f"){pad}/product=\"p\"\n     gene            3..7{pad}/gene=\"other\"\nORIGIN\n        1 acgtacgta\n//",
    )
    t(spark, d, "documents").select(entry.alias("value")).write.text(path)
    return fasta.exon_table(fasta.features_of(fasta.genbank_entries(spark, path))).select("gene", "begin", "end").distinct()


# As-of and ordered -----------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
n AS (SELECT *, min(CASE WHEN event_type = 'click' THEN r END) OVER w AS c, min(CASE WHEN event_type = 'view' THEN r END) OVER w AS v FROM r WINDOW w AS (PARTITION BY user_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT n.event_id, n.user_id, c.event_id AS next_click, c.value AS click_value FROM n LEFT JOIN r c ON c.user_id = n.user_id AND c.r = n.c AND (n.v IS NULL OR n.c < n.v) WHERE n.event_type = 'purchase'""")
def next_click(spark, d):
    """The first click after a purchase and before the next view, as the first gene after a coding sequence and before the next feature."""
    e = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "ts", "event_id")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id", F.col("event_id").alias("next_click"), F.col("value").alias("click_value"))
    out = O.first_after(of("purchase"), clicks, ["user_id"], ["ts", "event_id"], ["next_click", "click_value"], of("view"))
    return out.select("event_id", "user_id", "next_click", "click_value")


@query("""WITH w AS (SELECT event_id AS w, user_id, CAST(floor(value) AS BIGINT) AS at FROM events WHERE value IS NOT NULL),
s AS (SELECT p_partkey AS s, CAST(floor(p_retailprice / 10) AS BIGINT) AS low, CAST(floor(p_retailprice / 10) AS BIGINT) + p_size AS high FROM part)
SELECT s.s, count(*) AS n, min(w.w) AS first FROM s JOIN w ON w.at BETWEEN s.low AND s.high GROUP BY s.s""")
def range_matches(spark, d):
    """Marks that lie in intervals, counted by interval."""
    points = t(spark, d, "events").where("value is not null").select(F.col("event_id").alias("w"), F.floor("value").alias("at"))
    low = F.floor(F.col("p_retailprice") / 10)
    spans = t(spark, d, "part").select(F.col("p_partkey").alias("s"), low.alias("low"), (low + F.col("p_size")).alias("high"))
    totals = O.range_totals(points, spans, [], "at", "low", "high", "w")
    return spans.join(totals, ["low", "high"]).groupBy("s").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


# Windows and stretches between stops ------------------------------------------------------------------------------

STRANDS = f"{DNA}, st AS (SELECT doc_id, 'F' AS strand, seq FROM dna WHERE length(seq) > 0 UNION ALL SELECT doc_id, 'R', reverse(translate(seq, 'acgt', 'tgca')) FROM dna WHERE length(seq) > 0)"
WINDOWS = f"""{STRANDS}, fr AS (SELECT st.*, f, length(seq) AS n FROM st CROSS JOIN (VALUES (0), (1), (2)) f(f) WHERE length(seq) > f),
win AS (SELECT doc_id, strand, f, k, f + 1 + 30 * k AS start, substr(seq, f + 1 + 30 * k, 90) AS w FROM (SELECT *, unnest(range(0, greatest(0, CAST(floor((n - 90 - f - 1) / 30.0) AS BIGINT) + 1) + 1)) AS k FROM fr))"""


@query(f"""WITH {WINDOWS} SELECT doc_id, strand, CAST(f AS BIGINT) AS frame, k, start, CAST(length(w) // 3 AS BIGINT) AS codons,
CAST(len(list_filter(range(1, length(w) - 1, 3), lambda i: substr(w, i, 3) = 'att')) AS BIGINT) AS att, CAST(len(list_filter(range(1, length(w) - 1, 3), lambda i: substr(w, i, 1) = 'g')) AS BIGINT) AS g_first FROM win""")
def recstat_windows(spark, d):
    """Both strands, all frames, the short last window too."""
    w = R.windows(dna(spark, d), ["doc_id"])
    words = K.words(3)
    count = lambda *at: sum((F.get("counts", F.lit(k)) for k in at), F.lit(0)).cast("bigint")
    total = F.aggregate("counts", F.lit(0), lambda a, x: a + x).cast("bigint")
    first = [k for k, x in enumerate(words) if x[0] == "g"]
    return w.select("doc_id", "strand", F.col("frame").cast("bigint").alias("frame"), "k", "start", total.alias("codons"), count(words.index("att")).alias("att"), count(*first).alias("g_first"))


SEGMENTS = """cut AS (SELECT doc_id, strand, f, f + 1 + 3 * i AS p FROM (SELECT *, unnest(range(0, CAST((n - f) // 3 AS BIGINT))) AS i FROM fr) WHERE substr(seq, f + 1 + 3 * i, 3) IN ('taa', 'tag', 'tga')
 UNION SELECT doc_id, strand, f, f - 2 FROM st CROSS JOIN (VALUES (0), (1), (2)) f(f) UNION SELECT doc_id, strand, f, length(seq) - (length(seq) - f + 3) % 3 - 2 FROM st CROSS JOIN (VALUES (0), (1), (2)) f(f)),
seg AS (SELECT * FROM (SELECT doc_id, strand, f, p AS before, lead(p) OVER (PARTITION BY doc_id, strand, f ORDER BY p) AS stop FROM cut) WHERE stop - before > 150)"""


@query(f"WITH {WINDOWS}, {SEGMENTS} SELECT doc_id, strand, CAST(f AS BIGINT) AS frame, before, stop FROM seg")
def stretches_between_stops(spark, d):
    return R.inter_stop(dna(spark, d), ["doc_id"]).withColumn("frame", F.col("frame").cast("bigint"))


def _p_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's law by Simpson's rule on the angle whose tangent is t / sqrt(df)."""
    n = 600
    f = lambda x: f"pow(cos({x}), {df} - 1)"
    top = f"atan(abs({t}) / sqrt({df}))"
    inner = f"list_sum(list_transform(range(1, {n}), lambda i: CASE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END * {f(f'{top} * i / {n}.0::DOUBLE')}))"
    return f"1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {top} / {3 * n}.0::DOUBLE * (1 + {inner} + {f(top)})"


def _segment_sql() -> str:
    cells = ", ".join(f"avg(CASE WHEN w.f = {g} THEN w.score END) AS m{g}, var_samp(CASE WHEN w.f = {g} THEN w.score END) AS v{g}, count(CASE WHEN w.f = {g} THEN w.score END) AS n{g}" for g in range(3))
    pick = lambda c, own: "CASE s.f " + " ".join(f"WHEN {g} THEN {c}{h}" for g, h in enumerate(own)) + " END"
    own, sides = (0, 1, 2), {"a": (1, 0, 0), "b": (2, 2, 1)}
    moments = ", ".join(f"{pick('m', o)} AS m_{k}, {pick('v', o)} / {pick('n', o)} AS u_{k}, CAST({pick('n', o)} AS DOUBLE) AS n_{k}" for k, o in {"o": own, **sides}.items())
    stats = ", ".join(f"(m_o - m_{k}) / sqrt(nullif(u_o + u_{k}, 0)) AS t_{k}, pow(u_o + u_{k}, 2) / nullif(u_o * u_o / nullif(n_o - 1, 0) + u_{k} * u_{k} / nullif(n_{k} - 1, 0), 0) AS df_{k}" for k in sides)
    ps = ", ".join(f"{_p_sql(f't_{k}', f'df_{k}')} AS p_{k}" for k in sides)
    return f"""WITH {WINDOWS}, {SEGMENTS}, sc AS (SELECT doc_id, strand, f, start AS at, CAST(length(w) - length(replace(replace(w, 'c', ''), 'g', '')) AS DOUBLE) AS score FROM (SELECT * REPLACE (left(w, 3 * CAST(length(w) // 3 AS INT)) AS w) FROM win) WHERE length(w) > 0),
j AS (SELECT s.doc_id, s.strand, s.f, s.before, s.stop, {cells} FROM seg s LEFT JOIN sc w ON w.doc_id = s.doc_id AND w.strand = s.strand AND w.at >= ceil(s.before - 18) AND w.at <= floor(s.stop - 72) GROUP BY ALL),
m AS (SELECT s.*, {moments} FROM j s), x AS (SELECT *, {stats} FROM m), p AS (SELECT *, {ps} FROM x)
SELECT doc_id, strand, CAST(f AS BIGINT) AS frame, before + 3 AS start, stop + 2 AS "end", round(m0, 5) AS mean_1, round(m1, 5) AS mean_2, round(m2, 5) AS mean_3, round(p_a, 5) AS p_a, round(p_b, 5) AS p_b, coalesce(p_a < 0.05 AND p_b < 0.05, false) AS cds FROM p"""


@query(_segment_sql())
def stretch_decisions(spark, d):
    """Stretches between stops whose windows differ from the other frames' in G and C."""
    seqs = dna(spark, d)
    strong = [k for k, w in enumerate(K.words(3)) for x in w if x in "cg"]
    score = sum((F.get("counts", F.lit(k)) for k in strong), F.lit(0)).cast("double")
    w = R.windows(seqs, ["doc_id"]).where(F.aggregate("counts", F.lit(0), lambda a, x: a + x) > 0)
    scored = w.select("doc_id", "strand", F.col("frame").alias("w_frame"), F.col("start").alias("at"), score.alias("score"))
    out = R.score_tests(scored, R.inter_stop(seqs, ["doc_id"]), ["doc_id"])
    return out.select("doc_id", "strand", F.col("frame").cast("bigint").alias("frame"), "start", "end", *[F.round(c, 5).alias(c) for c in ("mean_1", "mean_2", "mean_3", "p_a", "p_b")], "cds")


@query()
def recstat_scores(spark, d):
    """The same on the first axis of each sequence's correspondence analysis."""
    return R.test_scores(dna(spark, d), ["doc_id"])


@query()
def recstat_codons(spark, d):
    return R.test_codons(dna(spark, d), ["doc_id"])


@query(f"""WITH s AS (SELECT user_id, avg(CASE event_type WHEN 'click' THEN value END) AS ma, avg(CASE event_type WHEN 'view' THEN value END) AS mb, var_samp(CASE event_type WHEN 'click' THEN value END) / count(CASE event_type WHEN 'click' THEN value END) AS va,
 var_samp(CASE event_type WHEN 'view' THEN value END) / count(CASE event_type WHEN 'view' THEN value END) AS vb, count(CASE event_type WHEN 'click' THEN value END) AS na, count(CASE event_type WHEN 'view' THEN value END) AS nb FROM events GROUP BY user_id),
x AS (SELECT user_id, (ma - mb) / nullif(sqrt(va + vb), 0) AS t, pow(va + vb, 2) / nullif(va * va / nullif(na - 1, 0) + vb * vb / nullif(nb - 1, 0), 0) AS df FROM s)
SELECT user_id, round({_p_sql('t', 'df')}, 6) AS p FROM x""")
def welch_p(spark, d):
    out = G.welch(t(spark, d, "events"), ["user_id"], "click", "view", "event_type", "value")
    return out.select("user_id", r6(tails.t_tail(F.col("t"), F.col("df"))).alias("p"))


def _chi2_sql(h: str, k: str) -> str:
    """Upper tail of the chi-squared law by Simpson's rule on the square root of the statistic."""
    n, top = 600, f"sqrt({h})"
    f = lambda y: f"pow({y}, {k} - 1) * exp(-pow({y}, 2) / 2)"
    inner = f"list_sum(list_transform(range(1, {n}), lambda i: CASE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END * {f(f'({top} * i / {n}.0::DOUBLE)')}))"
    return f"1 - pow(2.0::DOUBLE, 1 - {k} / 2.0::DOUBLE) / exp(lgamma({k} / 2.0::DOUBLE)) * {top} / {3 * n}.0::DOUBLE * (CASE WHEN {k} = 1 THEN 1 ELSE 0 END + {inner} + {f(top)})"


@query(f"""WITH c AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, sum(n) / count(*) AS e, count(*) AS k FROM c GROUP BY user_id),
h AS (SELECT c.user_id, sum(pow(n - e, 2) / e) AS h, any_value(k) - 1 AS k FROM c JOIN s USING (user_id) GROUP BY c.user_id)
SELECT user_id, round(h, 6) AS h, CAST(k AS BIGINT) AS df, round(CASE WHEN k > 0 THEN {_chi2_sql('h', 'k')} END, 6) AS p FROM h""")
def uniform_types_p(spark, d):
    """Whether a user's events fall evenly on the types that occur: chi-squared statistic and its tail."""
    c = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    s = c.groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    h = F.col("nn") * F.col("k") / F.col("n") - F.col("n")
    s = s.select("user_id", F.greatest(h, F.lit(0.0)).alias("h"), (F.col("k") - 1).alias("df"))
    return s.select("user_id", r6(F.col("h")).alias("h"), "df", r6(tails.chi2_tail(F.col("h"), F.col("df"))).alias("p"))
