"""Access to a bank's entries: numbers, annotations, locations, extraction and saved lists.

Entries are asked for as tables, never one by one: a table of names gives a table of numbers, a list its annotations. Locations
of subsequences are records that point to the next one; their order is found by doubling the pointers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.functions import sequence as S
from helixspark.plans.bank import Bank, Lst
from helixspark.sources.shared import written


def chain_places(links: DataFrame, id_column: str = "id", next_column: str = "next", most_rounds: int = 40) -> DataFrame:
    """id, head, place (from 0) of records that point to the next one (null: the last): the chain's first record and the
    record's place in it. Each round every record learns what the record that it knows knows, so chains of n records take
    log2(n) rounds of one join each; a round's result is written. Records in a circle are an error, as they have no first."""
    own = links.select(F.col(id_column).alias("id"), F.col(next_column).alias("next")).where("id is not null")
    before = own.where("next is not null").select(F.col("next").alias("id"), F.col("id").alias("before"))
    now = written(own.select("id").join(before, "id", "left").select("id", F.coalesce("before", "id").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("place")), "chains")
    for _ in range(most_rounds):
        known = now.select(F.col("id").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        now = written(now.join(known, "head").select("id", F.col("further").alias("head"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")), "chains")
        if now.where("moved").isEmpty():
            return now.select("id", "head", "place")
    raise ValueError("records point to one another in a circle")


def locations(sequences: DataFrame, extents: DataFrame) -> DataFrame:
    """seq_id, spans (array<struct<begin, end>>) of sequences (seq_id, extent): the extents (extent, begin, end, next) from the
    sequence's first one on. A parent sequence has no extent and gets null."""
    places = chain_places(extents, "extent")
    rows = places.join(extents.select(F.col("extent").alias("id"), "begin", "end"), "id")
    spans = rows.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "begin", "end"))), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"))).alias("spans"))
    return sequences.select("seq_id", F.col("extent").alias("head")).join(spans, "head", "left").select("seq_id", "spans")


def annotations(lst: Lst, lines: int = 100) -> DataFrame:
    """seq_id, line_no, line: the first annotation lines (one at least) of a list's members."""
    rows = lst.bank.annots.join(lst.ids.withColumnRenamed("id", "seq_id"), "seq_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("seq_id").orderBy("line_no"))
    return rows.withColumn("__place", place).where(F.col("__place") <= max(1, lines)).select("seq_id", "line_no", "line")


def numbers(bank: Bank, asked: DataFrame, by: str = "name") -> DataFrame:
    """asked, number, length, frame, gencode, ncbigc, other_matches of each distinct name or accession, whatever its case; nulls if there is no such
    sequence. Of several sequences tied to an accession the first number is given and other_matches is true. Parents have no frame and codes."""
    if by not in ("name", "access"):
        raise ValueError("by must be name or access")
    wanted = asked.toDF("asked").distinct().withColumn("key", F.upper("asked"))
    columns = [F.col(c) if c in bank.sequences.columns else F.lit(None).cast("int").alias(c) for c in ("frame", "gencode", "ncbigc")]
    seqs = bank.sequences.select("seq_id", "name", "parent_id", "length", *columns)
    keyed = seqs.withColumn("key", F.upper("name")) if by == "name" else bank.links["accession"].select("seq_id", F.upper("value").alias("key")).distinct().join(seqs, "seq_id")
    of_child = lambda c: F.when(F.col("parent_id").isNotNull(), F.col(c)).alias(c)
    found = keyed.groupBy("key").agg(F.min(F.struct(F.col("seq_id").alias("number"), "length", of_child("frame"), of_child("gencode"), of_child("ncbigc"))).alias("f"), (F.count("*") > 1).alias("other_matches"))
    return wanted.join(found, "key", "left").select("asked", "f.number", "f.length", "f.frame", "f.gencode", "f.ncbigc", "other_matches")


def list_names(lst: Lst, kind: str = "N") -> DataFrame:
    """value: the names (N) or accessions (A) of a list of sequences."""
    if lst.kind != "SQ" or kind not in ("N", "A"):
        raise ValueError("a list of sequences and kind N or A are needed")
    members = lst.ids.withColumnRenamed("id", "seq_id")
    if kind == "N":
        return lst.bank.sequences.join(members, "seq_id", "left_semi").select(F.col("name").alias("value"))
    return lst.bank.links["accession"].join(members, "seq_id", "left_semi").select("value").distinct()


def save_list(lst: Lst, path: str, kind: str = "N") -> None:
    """A folder of text files with a name on each line, which ``Bank.from_file`` reads again; names are in order over all files."""
    list_names(lst, kind).where("value is not null").orderBy("value").write.text(path)


BOUND = re.compile(r"^(?:(e)([+-]\d+)?|(-?\d+))$")


def parsed(bounds: str) -> list[tuple[bool, int]]:
    """Two places such as "1,300", "-50,e" or "e-20,e+10": (whether it counts from the end, offset)."""
    found = [BOUND.match(part.strip().lower()) for part in bounds.split(",")]
    if len(found) != 2 or not all(found):
        raise ValueError(f"no bounds: {bounds}")
    return [(True, int(m[2] or 0)) if m[1] else (False, int(m[3])) for m in found]


def extract(seqs: DataFrame, features: DataFrame | None = None, operation: str = "simple", bounds: str | None = None, least_bounds: str | None = None) -> DataFrame:
    """seq_id, name, seq by an operation on sequences (seq_id, name, seq; numcode and frame for translate).

    simple: as they are. translate: proteins by each row's genetic code and reading frame. fragment: the part within bounds, counted
    from the sequence's first place (1) or its end (e). feature: the spans (seq_id, ord, begin, end) of each feature joined in
    order. region: the part within bounds counted from a feature's begin and end, a row for each span. A part that the sequence doesn't
    hold whole is left out, unless the part within least_bounds is held: then what there is of it is given."""
    if operation == "simple":
        return seqs.select("seq_id", "name", "seq")
    if operation == "translate":
        return seqs.select("seq_id", "name", S.translate(F.col("seq"), F.col("frame"), "F", F.col("numcode")).alias("seq"))
    if operation == "feature":
        from helixspark.plans.bank import fragments

        return fragments(seqs, features, "feature")
    if operation not in ("fragment", "region"):
        raise ValueError(f"no such operation: {operation}")
    if bounds is None or operation == "region" and features is None:
        raise ValueError("bounds, and for a region features, are needed")
    n = F.length("seq")
    rows = seqs.select("seq_id", "name", "seq")
    rows = rows.withColumns({"begin": F.lit(1), "end": n}) if operation == "fragment" else rows.join(features.select("seq_id", "ord", "begin", "end"), "seq_id").withColumn("name", F.concat_ws(".", "name", "ord"))

    def place(side: tuple[bool, int]) -> Column:
        return F.col("end") + side[1] if side[0] else F.col("begin") + side[1] - 1

    a, b = map(place, parsed(bounds))
    whole = (a >= 1) & (b <= n) & (a <= b)
    taken = F.when(whole, F.substring("seq", a.cast("int"), (b - a + 1).cast("int")))
    if least_bounds:
        c, d = map(place, parsed(least_bounds))
        lo, hi = F.greatest(a, F.lit(1)), F.least(b, n)
        taken = taken.when((c >= 1) & (d <= n) & (c <= d) & (lo <= hi), F.substring("seq", lo.cast("int"), (hi - lo + 1).cast("int")))
    return rows.select("seq_id", "name", taken.alias("seq")).where("seq is not null")
