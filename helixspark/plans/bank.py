"""A bank of annotated sequences: criteria and list algebra as joins.

A bank is a set of tables (DataFrames); a list is a DataFrame of ids with a kind: sequences, species or keywords.
Criteria give lists, and lists combine by methods; Spark plans what they add up to. There is no query text to
parse: ``bank.species("Homo@") & bank.where(type="CDS") - bank.keyword("PARTIAL")``.

Tables: sequences(seq_id, name, parent_id, length, ...), species(id, name, parent_id), keywords(id, name,
parent_id), seq_species(seq_id, id), seq_keyword(seq_id, id), annots(seq_id, line_no, line); more tables of
(seq_id, value) may be added by name for criteria such as journals, authors or accessions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wildcard(name: str) -> str:
    """A name with @ for any characters, as a LIKE pattern."""
    return name.upper().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("@", "%")


def named(column: str, name: str) -> Column:
    return F.upper(F.col(column)).like(wildcard(name))


@dataclass
class Lst:
    """A list of a bank: one column id, distinct; kind SQ, SP or KW."""

    bank: Bank
    ids: DataFrame
    kind: str = "SQ"

    def _of(self, ids: DataFrame, kind: str | None = None) -> Lst:
        return Lst(self.bank, ids, kind or self.kind)

    def __and__(self, other: Lst) -> Lst:
        return self._of(self.ids.join(other.ids, "id", "left_semi"))

    def __or__(self, other: Lst) -> Lst:
        return self._of(self.ids.union(other.ids).distinct())

    def __sub__(self, other: Lst) -> Lst:
        """Members that are not in other."""
        return self._of(self.ids.join(other.ids, "id", "left_anti"))

    def __invert__(self) -> Lst:
        """The complement in all ids of this kind."""
        return self._of(self.bank.universe(self.kind).join(self.ids, "id", "left_anti"))

    def parents(self) -> Lst:
        """PAR: members that have no parent, and the parents of the others."""
        rows = self.bank.sequences.join(self.ids, F.col("seq_id") == F.col("id"), "left_semi")
        return self._of(rows.select(F.coalesce("parent_id", "seq_id").alias("id")).distinct())

    def with_subsequences(self) -> Lst:
        """SUB: members and all their subsequences."""
        subs = self.bank.sequences.join(self.ids, F.col("parent_id") == F.col("id"), "left_semi").select(F.col("seq_id").alias("id"))
        return self._of(self.ids.union(subs).distinct())

    def species(self) -> Lst:
        """PS: species of the members."""
        return self._of(self.bank.seq_species.join(self.ids.withColumnRenamed("id", "seq_id"), "seq_id", "left_semi").select("id").distinct(), "SP")

    def keywords(self) -> Lst:
        """PK: keywords of the members."""
        return self._of(self.bank.seq_keyword.join(self.ids.withColumnRenamed("id", "seq_id"), "seq_id", "left_semi").select("id").distinct(), "KW")

    def sequences(self) -> Lst:
        """UN: sequences attached to the members of a species or keyword list."""
        links = self.bank.seq_species if self.kind == "SP" else self.bank.seq_keyword
        return self._of(links.join(self.ids, "id", "left_semi").select(F.col("seq_id").alias("id")).distinct(), "SQ")

    def descendants(self) -> Lst:
        """SD, KD: the members and all below them in their tree."""
        return self._of(self.bank.below(self.kind, self.ids))

    def longer(self, n: int) -> Lst:
        return self & self.bank.where(F.col("length") >= n)

    def shorter(self, n: int) -> Lst:
        return self & self.bank.where(F.col("length") <= n)

    def since(self, date: str, column: str = "date") -> Lst:
        """Dated at or after a day written like 1/jul/2001 or 2001-07-01."""
        return self & self.bank.where(F.col(column) >= day(date))

    def until(self, date: str, column: str = "date") -> Lst:
        return self & self.bank.where(F.col(column) < F.date_add(day(date), 1))

    def scan(self, text: str) -> Lst:
        """Members with text in some annotation line, whatever the case."""
        hits = self.bank.annots.where(F.contains(F.upper("line"), F.lit(text.upper()))).select(F.col("seq_id").alias("id"))
        return self._of(self.ids.join(hits, "id", "left_semi"))

    def rows(self) -> DataFrame:
        return self.bank.table(self.kind).join(self.ids, F.col("seq_id" if self.kind == "SQ" else "id") == self.ids["id"], "left_semi")

    def count(self) -> DataFrame:
        """One row: members, members that are subsequences, and residues in all."""
        return self.rows().agg(F.count("*").alias("members"), F.count("parent_id").alias("subsequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("residues"))


def day(date: str) -> Column:
    """A date of either form; years of two digits are of this or the last century."""
    if "/" not in date:
        return F.to_date(F.lit(date))
    d, m, y = date.split("/")
    full = y if len(y) == 4 else ("19" if int(y) > 50 else "20") + y
    return F.to_date(F.lit(f"{int(d):02d}/{m.capitalize()}/{full}"), "dd/MMM/yyyy")


@dataclass
class Bank:
    sequences: DataFrame
    species_table: DataFrame | None = None
    keyword_table: DataFrame | None = None
    seq_species: DataFrame | None = None
    seq_keyword: DataFrame | None = None
    annots: DataFrame | None = None
    links: dict[str, DataFrame] = field(default_factory=dict)
    lists: dict[str, Lst] = field(default_factory=dict)

    def table(self, kind: str) -> DataFrame:
        return {"SQ": self.sequences, "SP": self.species_table, "KW": self.keyword_table}[kind]

    def universe(self, kind: str = "SQ") -> DataFrame:
        return self.sequences.select(F.col("seq_id").alias("id")) if kind == "SQ" else self.table(kind).select("id")

    def all(self) -> Lst:
        return Lst(self, self.universe())

    def where(self, condition: Column | None = None, **equal: str) -> Lst:
        """Sequences by a condition on their columns, and by columns' values, whatever the case."""
        rows = self.sequences if condition is None else self.sequences.where(condition)
        for column, value in equal.items():
            rows = rows.where(F.upper(F.col(column)) == value.upper())
        return Lst(self, rows.select(F.col("seq_id").alias("id")))

    def by_name(self, name: str) -> Lst:
        return Lst(self, self.sequences.where(named("name", name)).select(F.col("seq_id").alias("id")))

    def year(self, year: int, relation: str = "=", column: str = "date") -> Lst:
        """Y: sequences published in a year, in it or later (>), in it or earlier (<)."""
        y = F.year(column)
        return self.where({"=": y == year, ">": y >= year, "<": y <= year}[relation])

    def reference(self, code: str) -> Lst:
        """R: sequences from a reference written as journal/volume/page; parts may hold @."""
        if code.count("/") != 2:
            raise ValueError("a reference is written as journal/volume/page")
        return self.linked("reference", code)

    def journal(self, code: str) -> Lst:
        """J: sequences published in a journal, the first part of their references."""
        journal = F.upper(F.substring_index("value", "/", 1)).like(wildcard(code))
        return Lst(self, self.links["reference"].where(journal).select(F.col("seq_id").alias("id")).distinct())

    def author(self, name: str) -> Lst:
        return self.linked("author", name)

    def accession(self, number: str) -> Lst:
        return self.linked("accession", number)

    def taxon(self, number: int) -> Lst:
        """TID: sequences of the taxon of a number and of all below it."""
        return Lst(self, self.species_table.where(F.col("tax_id") == number).select("id"), "SP").descendants().sequences()

    def from_accessions(self, path: str) -> Lst:
        """FA: sequences attached to the accessions in a file, one on each line."""
        wanted = self.sequences.sparkSession.read.text(path).select(F.upper(F.trim("value")).alias("wanted")).distinct()
        links = self.links["accession"]
        return Lst(self, links.join(wanted, F.upper(links["value"]) == F.col("wanted"), "left_semi").select(F.col("seq_id").alias("id")).distinct())

    def linked(self, link: str, value: str) -> Lst:
        """Sequences tied to a value in one of ``links``: journals, authors, accessions and the like."""
        return Lst(self, self.links[link].where(named("value", value)).select(F.col("seq_id").alias("id")).distinct())

    def below(self, kind: str, ids: DataFrame) -> DataFrame:
        """ids and everything under them, however deep, and in a tree with a cycle too; one join for each level, which ends
        when nothing is new. Every few levels the lineage is cut, if the session has a checkpoint folder."""
        tree = self.table(kind).select("id", "parent_id")
        out = level = ids.distinct()
        for depth in count(1):
            level = tree.join(level.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id").join(out, "id", "left_anti")
            if level.isEmpty():
                break
            out = out.union(level)
            if depth % 8 == 0 and tree.sparkSession.sparkContext.getCheckpointDir():
                out, level = out.checkpoint(), level.checkpoint()
        return out

    def species(self, name: str) -> Lst:
        """SP: sequences of a taxon and of all below it."""
        return self.species_list(name).descendants().sequences()

    def keyword(self, name: str) -> Lst:
        return self.keyword_list(name).descendants().sequences()

    def species_list(self, name: str) -> Lst:
        return Lst(self, self.species_table.where(named("name", name)).select("id"), "SP")

    def keyword_list(self, name: str) -> Lst:
        return Lst(self, self.keyword_table.where(named("name", name)).select("id"), "KW")

    def from_file(self, path: str, kind: str = "SQ") -> Lst:
        """A list from a file with a name on each line."""
        names = self.sequences.sparkSession.read.text(path).select(F.upper(F.trim("value")).alias("wanted")).distinct()
        key = F.col("seq_id") if kind == "SQ" else F.col("id")
        return Lst(self, self.table(kind).join(names, F.upper(F.col("name")) == F.col("wanted"), "left_semi").select(key.alias("id")), kind)

    def keep(self, name: str, lst: Lst) -> Lst:
        self.lists[name] = lst
        return lst


def fragments(seqs: DataFrame, features: DataFrame, operation: str = "fragment") -> DataFrame:
    """(seq_id, name, seq) of features (seq_id, ord, begin, end) cut out of their sequences: each alone, or joined in order
    as one (operation "feature")."""
    from helixspark.functions.sequence import frag

    cut = seqs.join(features, "seq_id").select("seq_id", "name", "ord", frag(F.col("seq"), F.col("begin"), F.col("end")).alias("seq"))
    if operation == "fragment":
        return cut.select("seq_id", F.concat_ws(".", "name", "ord").alias("name"), "seq")
    return cut.groupBy("seq_id", "name").agg(F.array_sort(F.collect_list(F.struct("ord", "seq"))).alias("parts")).select("seq_id", "name", F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("seq"))


def where_is(accession: str, banks: dict[str, Bank], link: str = "accession", first_only: bool = False) -> DataFrame:
    """bank, seq_id for each bank that has an accession, or for the first of them by name."""
    if first_only:
        every = where_is(accession, banks, link)
        return every.join(F.broadcast(every.agg(F.min("bank").alias("bank"))), "bank")  # one row
    found = [b.linked(link, accession).ids.select(F.lit(n).alias("bank"), F.col("id").alias("seq_id")) for n, b in sorted(banks.items())]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
