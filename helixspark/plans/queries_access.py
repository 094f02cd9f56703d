"""Queries of a bank's criteria and of access to its entries, beside their SQL.

In the bank of ``queries.bank`` a sequence's accession is made of its part and supplier, its reference of priority, year and
day, its author of its customer; a customer's number is its taxon id."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixspark import constants as K
from helixspark.functions import sequence as S
from helixspark.plans import access as A
from helixspark.plans.bank import Bank, where_is
from helixspark.plans.queries import BANK, DNA, bank, dna, query, t
from helixspark.sources.shared import new_path


def linked_bank(spark, d) -> Bank:
    b = bank(spark, d)
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    seq = (F.col("o_orderkey") * 8).alias("seq_id")
    b.links = {
        "accession": li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq_id"), F.concat(F.lit("AC"), F.col("l_suppkey"), F.lit("."), F.col("l_linenumber")).alias("value")).distinct(),
        "reference": o.select(seq, F.concat_ws("/", F.substring_index("o_orderpriority", "-", -1), F.year("o_orderdate"), F.dayofyear("o_orderdate")).alias("value")),
        "author": o.select(seq, F.concat(F.lit("Author"), F.col("o_custkey") % 50).alias("value")),
    }
    b.species_table = b.species_table.withColumn("tax_id", F.regexp_extract("id", r"^c(\d+)$", 1).try_cast("bigint"))
    return b


REFS = "ref AS (SELECT o_orderkey * 8 AS id, regexp_extract(o_orderpriority, '([^-]*)$', 1) AS j, year(o_orderdate) AS y, dayofyear(o_orderdate) AS p FROM orders)"
ACCS = "acc AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, 'AC' || l_suppkey || '.' || l_linenumber AS v FROM lineitem)"


@query(f"WITH {BANK} SELECT id FROM seqs WHERE year(date) = 1996")
def list_year(spark, d):
    return linked_bank(spark, d).year(1996).ids


@query(f"WITH {BANK} SELECT id FROM seqs WHERE year(date) >= 1997 OR year(date) <= 1993")
def list_year_open(spark, d):
    """Y> and Y<, which include the year."""
    b = linked_bank(spark, d)
    return (b.year(1997, ">") | b.year(1993, "<")).ids


@query(f"WITH {REFS} SELECT DISTINCT id FROM ref WHERE upper(j) = 'URGENT' AND y = 1995 AND CAST(p AS VARCHAR) LIKE '1%'")
def list_reference(spark, d):
    return linked_bank(spark, d).reference("urgent/1995/1@").ids


@query(f"WITH {REFS} SELECT DISTINCT id FROM ref WHERE upper(j) = 'LOW'")
def list_journal(spark, d):
    return linked_bank(spark, d).journal("low").ids


@query("SELECT DISTINCT o_orderkey * 8 AS id FROM orders WHERE o_custkey % 50 = 7")
def list_author(spark, d):
    return linked_bank(spark, d).author("AUTHOR7").ids


@query(f"WITH {ACCS} SELECT DISTINCT id FROM acc WHERE v LIKE 'AC3.%'")
def list_accession(spark, d):
    return linked_bank(spark, d).accession("ac3.@").ids


@query("SELECT DISTINCT o_orderkey * 8 AS id FROM orders WHERE o_custkey = 42")
def list_taxon_id(spark, d):
    return linked_bank(spark, d).taxon(42).ids


@query(f"WITH {BANK} SELECT id FROM seqs WHERE id % 8 = 0 AND 'O' || (id // 8) LIKE 'O1%5'")
def list_name(spark, d):
    return linked_bank(spark, d).by_name("o1@5").ids


@query(f"WITH {BANK} SELECT DISTINCT id FROM sk WHERE p_type IN (SELECT p_type FROM sk WHERE id IN (SELECT id FROM seqs WHERE type = 'A' AND status = 'F' AND length >= 50))")
def list_unproject(spark, d):
    """UN: sequences attached to the keywords of a list."""
    b = linked_bank(spark, d)
    return (b.where(type="A") & b.where(status="F")).longer(50).keywords().sequences().ids


@query(f"WITH {ACCS} SELECT 'lines' AS bank, id AS seq_id FROM acc WHERE v = 'AC5.1'")
def where_accession(spark, d):
    """The first bank, by name, that has an accession."""
    b = linked_bank(spark, d)
    other = Bank(b.sequences, links={"accession": b.links["accession"].where("value LIKE 'AC9%'")})
    return where_is("AC5.1", {"lines": b, "nines": other}, first_only=True)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT c_custkey AS seq_id, string_agg(o_orderkey || '..' || (o_orderkey + length(o_orderstatus)), ',' ORDER BY r) AS spans FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_custkey""")
def get_location(spark, d):
    """Orders of a customer as extents that each point to the next; customers without orders are parents."""
    from pyspark.sql import Window

    o = t(spark, d, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    extents = o.select(F.col("o_orderkey").alias("extent"), F.col("o_orderkey").alias("begin"), (F.col("o_orderkey") + F.length("o_orderstatus")).alias("end"), after.alias("next"))
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("extent"))
    seqs = t(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("seq_id"), "extent")
    spans = A.locations(seqs, extents)
    return spans.select("seq_id", F.nullif(F.array_join(F.transform("spans", lambda s: F.concat_ws("..", s["begin"], s["end"])), ","), F.lit("")).alias("spans"))


@query("SELECT l_orderkey AS seq_id, l_linenumber AS line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS line FROM lineitem GROUP BY ALL)) WHERE r <= 2 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def get_annotations(spark, d):
    """The first two lines of the members' annotations."""
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq_id"), F.col("l_linenumber").alias("line_no")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("line"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("seq_id"), F.col("o_orderstatus").alias("status"))
    b = Bank(o, annots=lines)
    return A.annotations(b.where(status="F"), 2)


@query(f"WITH {BANK}, {ACCS}, q AS (SELECT DISTINCT 'ac' || s_suppkey || '.2' AS asked FROM supplier), f AS (SELECT v, min(id) AS number, count(*) > 1 AS more FROM acc GROUP BY v) SELECT asked, number, CAST(length AS BIGINT) AS length, CASE WHEN parent IS NOT NULL THEN CAST(number % 3 AS INT) END AS frame, more AS other_matches FROM q LEFT JOIN f ON upper(asked) = upper(v) LEFT JOIN seqs ON seqs.id = number")
def sequence_numbers(spark, d):
    """Sequences by accession: number, length, frame, and whether there are more."""
    b = linked_bank(spark, d)
    b.sequences = b.sequences.withColumn("frame", (F.col("seq_id") % 3).cast("int"))
    asked = t(spark, d, "supplier").select(F.concat(F.lit("ac"), "s_suppkey", F.lit(".2")).alias("asked"))
    return A.numbers(b, asked, "access").select("asked", "number", "length", "frame", "other_matches")


@query(f"WITH {BANK} SELECT id FROM seqs WHERE type = 'R' AND status = 'F'")
def saved_list(spark, d):
    """A list's names written to files, and the list read back from them."""
    b = linked_bank(spark, d)
    path = new_path(spark, "list")
    A.save_list(b.where(type="R") & b.where(status="F"), path)
    return b.from_file(path).ids


@query(f"""WITH {DNA}, f AS (SELECT doc_id, source AS name, seq, 11 AS b, 30 + doc_id % 20 AS e FROM dna), c AS (SELECT *, b - 5 AS lo, e + 9 AS hi, length(seq) AS n FROM f)
SELECT doc_id AS seq_id, name || '.0' AS name, CASE WHEN hi <= n THEN substr(seq, CAST(lo AS INT), CAST(hi - lo + 1 AS INT)) ELSE substr(seq, CAST(lo AS INT)) END AS seq FROM c WHERE name IS NOT NULL AND (hi <= n OR e <= n)""")
def extract_region(spark, d):
    """From five before a feature to nine after it, or what there is of it where the feature itself is whole."""
    seqs = dna(spark, d).where("source is not null").select(F.col("doc_id").alias("seq_id"), F.col("source").alias("name"), "seq")
    features = seqs.select("seq_id", F.lit(0).alias("ord"), F.lit(11).alias("begin"), (30 + F.col("seq_id") % 20).alias("end"))
    return A.extract(seqs, features, "region", "-4,e+9", "1,e")


CODE_CASE = "CASE doc_id % 3 WHEN 0 THEN '{0}' WHEN 1 THEN '{1}' ELSE '{2}' END".format(K.CODES[1], K.CODES[2], K.CODES[5])


@query(f"""WITH {DNA}, q AS (SELECT doc_id, {CODE_CASE} AS code, substr(seq, CAST(doc_id % 2 AS INT) + 1) AS s FROM dna)
SELECT doc_id, array_to_string(list_transform(range(1, greatest(length(s) - 1, 1), 3), lambda i: substr(code, CAST(16 * (instr('tcag', substr(s, i, 1)) - 1) + 4 * (instr('tcag', substr(s, i + 1, 1)) - 1) + instr('tcag', substr(s, i + 2, 1)) AS INT), 1)), '') AS protein FROM q""")
def translate_by_row(spark, d):
    """Each row by a genetic code and a frame of its own."""
    code = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(5)), (F.col("doc_id") % 3 + 1).cast("int"))
    seqs = dna(spark, d).select(F.col("doc_id").alias("seq_id"), F.lit("n").alias("name"), "seq", code.alias("numcode"), (F.col("doc_id") % 2).cast("int").alias("frame"))
    return A.extract(seqs, operation="translate").select(F.col("seq_id").alias("doc_id"), F.col("seq").alias("protein"))


@query("SELECT doc_id, " + "array_to_string(list_transform(string_split(text, ''), lambda c: CASE c " + " ".join("WHEN '{}' THEN '{}'".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in K.ESCAPES.items()) + " ELSE c END), '') AS escaped FROM documents")
def text_escapes(spark, d):
    return t(spark, d, "documents").select("doc_id", S.stresc(F.col("text")).alias("escaped"))


@query("WITH s AS (SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents), c AS (SELECT unnest(list_transform(range(1, length(seq) + 1), lambda i: substr(seq, i, 1))) AS ch FROM s), m AS (SELECT ch, count(*) AS n FROM c GROUP BY ch) SELECT ch, n, CASE ch " + " ".join(f"WHEN '{s}' THEN '{b}'" for s, b in {**K.IUPAC, 'u': 't'}.items()) + " END AS bases FROM m")
def ambiguous_bases(spark, d):
    """Letters of all texts with the bases that they stand for."""
    letters = t(spark, d, "documents").select(F.explode(S.chars(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")))).alias("ch"))
    return letters.groupBy("ch").agg(F.count("*").alias("n")).select("ch", "n", F.array_join(S.amb(F.col("ch")), "").alias("bases"))
