"""FASTA, GenBank and alignment files as DataFrames, and FASTA files from DataFrames.

FASTA and GenBank files are split at their record separators, so one file of any size is read by many tasks; a record is one row,
so it must fit in memory, as any sequence does. Alignment files are small families of sequences: each file's lines are numbered where they are read,
and put together in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.constants import code
from helixspark.sources.records import read_records


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, no, line of text files; each file is split by the task that reads it, whatever its line ends."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("no", "line"))


def read_fasta(spark: SparkSession, path: str, seqtype: str = "DNA", lower: bool = True, comments: bool = True, whole_header: bool = False, strip: bool = False, line_end: str = "\n") -> DataFrame:
    """path, record (from 1 in each file, in its order), name, annot, seq. comments drops lines that begin with ``;``; DNA is
    lower-cased if lower.

    A record ends where a line begins with ``>``, which is the separator that the file is split by: one file of any size is read by
    many tasks, each record by the task in whose byte range it begins, and no line is handled by itself. Lines before the first
    header are no record; a file without any header is an error. line_end: where a file's lines end by carriage returns alone, say so."""
    first = F.startswith("value", F.lit(">"))
    rows = read_records(spark, path, f"{line_end}>", head=first)
    none = (F.col("records") == 1) & ~F.col("headed")
    rows = rows.where(F.when(none, F.raise_error(F.concat(F.lit("no line starting with a > character found in "), "path"))).otherwise(F.col("headed") | (F.col("record") > 0)))
    # the file's first record is the only one that the separator did not take the > from
    text = F.when(F.col("record") == 0, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    if line_end == "\r":
        text = F.replace(text, F.lit("\r"), F.lit("\n"))
    rows = rows.select("path", (F.col("record") + F.when(F.col("headed"), 1).otherwise(0)).alias("record"), text.alias("text"))
    header = F.regexp_replace(F.substring_index("text", "\n", 1), "\r$", "")
    rows = rows.select("path", "record", header.alias("header"), F.when(F.contains("text", F.lit("\n")), F.substr("text", F.length(F.substring_index("text", "\n", 1)) + 1)).otherwise("").alias("body"))
    body = F.col("body")
    if comments:
        body = F.when(F.contains(body, F.lit("\n;")), F.regexp_replace(body, "\n;[^\n]*", "\n")).otherwise(body)
    seq = F.replace(F.replace(body, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))
    name = F.col("header") if whole_header else F.substring_index("header", " ", 1)
    annot = F.col("header") if strip else F.concat(F.lit(">"), "header")
    return rows.select("path", "record", name.alias("name"), annot.alias("annot"), (F.lower(seq) if seqtype == "DNA" and lower else seq).alias("seq"))


def assembled(lines: DataFrame, seqtype: str = "DNA", lower: bool = True, comments: bool = True, whole_header: bool = False, strip: bool = False) -> DataFrame:
    """FASTA records from (path, no, line). Lines before a file's first header are no record."""
    if comments:
        lines = lines.where(~F.startswith("line", F.lit(";")))
    head = F.startswith(F.col("line"), F.lit(">"))
    numbered = lines.withColumns({"head": head, "record": F.sum(head.cast("int")).over(Window.partitionBy("path").orderBy("no"))}).where("record > 0")
    grouped = numbered.groupBy("path", "record").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("annot"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("no", "line")))).alias("lines"))
    seq = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    name = F.substring("annot", 2, 1 << 30) if whole_header else F.substring_index(F.substring("annot", 2, 1 << 30), " ", 1)
    return grouped.select("path", "record", name.alias("name"), (F.substring("annot", 2, 1 << 30) if strip else F.col("annot")).alias("annot"), (F.lower(seq) if seqtype == "DNA" and lower else seq).alias("seq"))


def fasta_text(name: Column, seq: Column, width: int = 60) -> Column:
    """A record's text: header and lines of a width."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 60, mode: str = "errorifexists") -> None:
    """A folder of FASTA files, one for each partition."""
    df.select(fasta_text(F.col(name), F.col(seq), width).alias("value")).write.mode(mode).text(path)


def genbank_entries(spark: SparkSession, path: str) -> DataFrame:
    """path, entry (from 1 in each file) and text of GenBank entries. ``//`` lines separate them, and files are split there: one file is
    read by many tasks."""
    rows = read_records(spark, path, "\n//").select("path", (F.col("record") + 1).alias("entry"), F.replace("value", F.lit("\r"), F.lit("")).alias("text"))
    return rows.where(F.col("text").rlike("(?m)^LOCUS"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """path, entry, locus, length, seq of GenBank entries, many to a file."""
    entries = genbank_entries(spark, path)
    line = F.regexp_extract("text", r"(?m)^LOCUS\s+(.*)$", 1)
    tokens = F.split(line, r"\s+")
    origin = F.when(F.contains("text", F.lit("\nORIGIN")), F.regexp_replace(F.substring_index("text", "\nORIGIN", -1), r"^[^\n]*\n?|[0-9\s]", "")).otherwise("")
    return entries.select("path", "entry", F.get(tokens, F.lit(0)).alias("locus"), F.get(tokens, F.lit(1)).try_cast("int").alias("length"), origin.alias("seq"))


def gb2fasta(entries: DataFrame) -> DataFrame:
    """FASTA text of GenBank entries: name, length, sequence."""
    return entries.select(fasta_text(F.concat_ws(" ", "locus", "length", F.lit("bp")), F.col("seq")).alias("value"))


def features_of(entries: DataFrame) -> DataFrame:
    """path, entry, no (of the feature in its entry, from 0), key, location (in one piece) and qualifiers (the text after it) of entries.
    A feature begins where a line has a letter in its sixth place; all of an entry's are cut in one pass, without a window over lines."""
    table = F.regexp_extract("text", r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\n\S|$)", 1)
    cut = entries.select("path", "entry", F.posexplode(F.split(F.concat(F.lit("\n"), table), r"\n {5}(?=\S)")).alias("no", "text")).where(F.col("text").rlike(r"^\S"))
    head = F.regexp_extract("text", r"(?s)^(.*?)(?:\n {21}/.*)?$", 1)
    return cut.select(
        "path", "entry", "no", F.regexp_extract("text", r"^(\S+)", 1).alias("key"), F.regexp_replace(F.regexp_replace(head, r"^\S+", ""), r"\s", "").alias("location"),
        F.regexp_extract("text", r"(?s)\n {21}(/.*)$", 1).alias("qualifiers"),
    )


def spans_of(features: DataFrame) -> DataFrame:
    """features with a row for each span of their locations: complement, part (from 1), begin, end; < and > are dropped."""
    spans = F.regexp_extract_all("location", F.lit(r"<?[0-9]+(?:\.\.>?[0-9]+)?"), F.lit(0))
    d = features.select(*features.columns, F.contains("location", F.lit("complement")).alias("complement"), F.posexplode(spans).alias("part", "s")).withColumn("s", F.regexp_replace("s", "[<>]", ""))
    return d.select(*features.columns, "complement", (F.col("part") + 1).alias("part"), F.substring_index("s", "..", 1).cast("int").alias("begin"), F.substring_index("s", "..", -1).cast("int").alias("end"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """path, entry, no, complement, begin, end, part: the spans of CDS features, with the spans of joins one a row; < and > are
    dropped. Locations over several lines are put together."""
    return spans_of(features_of(genbank_entries(spark, path)).where("key = 'CDS'")).select("path", "entry", "no", "complement", "begin", "end", "part")


def exon_table(features: DataFrame) -> DataFrame:
    """path, gene, begin, end: the distinct exons of CDS features with the gene that the feature's first /gene names ("" if none does). An exon
    on the complement begins at its larger place."""
    gene = F.regexp_extract("qualifiers", r'(?:^|\n\s*)/gene="([^"]*)"', 1)
    rows = spans_of(features.where("key = 'CDS'").withColumn("gene", gene))
    c = F.col("complement")
    return rows.select("path", "gene", F.when(c, F.col("end")).otherwise(F.col("begin")).alias("begin"), F.when(c, F.col("begin")).otherwise(F.col("end")).alias("end")).distinct()


def glimmer_coordinates(features: DataFrame) -> DataFrame:
    """path, entry, no, start, end of CDS without joins: the start codon first, the stop codon left out."""
    one = features.withColumn("parts", F.count("*").over(Window.partitionBy("path", "entry", "no"))).where("parts = 1")
    c = F.col("complement")
    return one.select("path", "entry", "no", F.when(c, F.col("end")).otherwise(F.col("begin")).alias("start"), F.when(c, F.col("begin") + 3).otherwise(F.col("end") - 3).alias("end"))


def read_alignment(spark: SparkSession, path: str, form: str, lower: bool = True) -> DataFrame:
    """aln (the path), idx, nam, seq, com of alignment files: fasta, mase, phylip, msf or clustal. A file is one
    alignment, a family of sequences."""
    lines = file_lines(spark, path)
    if form == "fasta":
        out = assembled(lines, "AA", whole_header=True).select(F.col("path").alias("aln"), F.col("record").cast("int").alias("idx"), F.col("name").alias("nam"), F.regexp_replace("seq", r"\s", "").alias("seq"), F.lit(None).cast("string").alias("com"))
    elif form == "mase":
        w = Window.partitionBy("path").orderBy("no")
        d = lines.where("line <> '' and not startswith(line, ';;')").withColumn("c", F.startswith("line", F.lit(";")))
        d = d.withColumn("starts", F.col("c") & ~F.coalesce(F.lag("c").over(w), F.lit(False)))
        d = d.withColumn("idx", F.sum(F.col("starts").cast("int")).over(w)).where("idx > 0")
        d = d.withColumn("body", F.sum((~F.col("c")).cast("int")).over(Window.partitionBy("path", "idx").orderBy("no")))
        own = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("no", "line")))), lambda x: x["line"]), "\n")
        out = d.groupBy("path", "idx").agg(F.max(F.when((~F.col("c")) & (F.col("body") == 1), F.col("line"))).alias("nam"), own((~F.col("c")) & (F.col("body") > 1)).alias("s"), own(F.col("c")).alias("com"))
        out = out.select(F.col("path").alias("aln"), F.col("idx").cast("int").alias("idx"), F.trim("nam").alias("nam"), F.regexp_replace("s", r"\s", "").alias("seq"), "com")
    elif form in ("clustal", "msf"):
        d = lines.where("no > 0") if form == "clustal" else lines.withColumn("b", F.max(F.when(F.startswith(F.trim("line"), F.lit("//")), F.col("no"))).over(Window.partitionBy("path"))).where("no > b")
        d = d.where(r"line rlike '^\\s*\\S+\\s+\\S' and " + ("line rlike '^\\\\S'" if form == "clustal" else "true"))
        d = d.select("path", "no", F.regexp_extract("line", r"^\s*(\S+)\s+(.*)$", 1).alias("nam"), F.regexp_replace(F.regexp_extract("line", r"^\s*(\S+)\s+(.*)$", 2), r"\s+[0-9]+\s*$|\s", "").alias("s"))
        g = d.groupBy("path", "nam").agg(F.min("no").alias("first"), F.array_sort(F.collect_list(F.struct("no", "s"))).alias("ls"))
        seq = F.array_join(F.transform("ls", lambda x: x["s"]), "")
        out = g.select(F.col("path").alias("aln"), F.row_number().over(Window.partitionBy("path").orderBy("first")).alias("idx"), "nam", (F.translate(seq, ".~", "--") if form == "msf" else seq).alias("seq"), F.lit(None).cast("string").alias("com"))
    elif form == "phylip":
        d = lines.where("trim(line) <> ''")
        d = d.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("no")) - 2)
        n = F.max(F.when(F.col("k") == -1, F.regexp_extract("line", r"^\s*([0-9]+)", 1).cast("int"))).over(Window.partitionBy("path"))
        d = d.withColumn("n", n).where("k >= 0").withColumns({"idx": (F.col("k") % F.col("n")) + 1, "row": F.floor(F.col("k") / F.col("n"))})
        g = d.groupBy("path", "idx").agg(F.max(F.when(F.col("row") == 0, F.trim(F.substring("line", 1, 10)))).alias("nam"), F.array_sort(F.collect_list(F.struct("row", F.when(F.col("row") == 0, F.substring("line", 11, 1 << 30)).otherwise(F.col("line")).alias("s")))).alias("ls"))
        out = g.select(F.col("path").alias("aln"), F.col("idx").cast("int").alias("idx"), "nam", F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["s"]), ""), r"\s", "").alias("seq"), F.lit(None).cast("string").alias("com"))
    else:
        raise ValueError(f"no such format: {form}")
    return out.withColumn("seq", F.lower("seq")) if lower else out


def code_listing(spark: SparkSession, numcode: int = 1) -> DataFrame:
    """The 64 codons of a genetic code in textbook order, a row for each."""
    return spark.createDataFrame([(k + 1, c, aa) for k, (c, aa) in enumerate(code(numcode).items())], "place int, codon string, aa string")


def read_growth(spark: SparkSession, path: str) -> DataFrame:
    """release, month, entries, nucleotides, date (in years) of a bank's release notes: the table that begins two lines after
    a heading with Release and Month."""
    lines = file_lines(spark, path)
    head = F.min(F.when(F.col("line").rlike("Release.+Month"), F.col("no"))).over(Window.partitionBy("path"))
    rows = lines.withColumn("head", head).where("no >= head + 2").select(F.split(F.trim("line"), r"\s+").alias("t")).where(F.size("t") == 4)
    month = F.split(F.col("t")[1], "/")
    return rows.select(F.col("t")[0].try_cast("double").alias("release"), F.col("t")[1].alias("month"), F.col("t")[2].try_cast("double").alias("entries"), F.col("t")[3].try_cast("double").alias("nucleotides"), ((month[0].try_cast("double") - 1) / 12 + month[1].try_cast("double")).alias("date"))
