"""Genotyping files: panels and bins (text sections), ABIF traces and MAQ binary FASTA (binary)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.sources.fasta import file_lines


def sections(lines: DataFrame, title: str) -> DataFrame:
    """lines with ``panel``, the last title before them."""
    head = F.col("line").rlike(f"^{title}\t")
    own = F.when(head, F.get(F.split("line", "\t+"), F.lit(1)))
    return lines.withColumns({"panel": F.last(own, ignorenulls=True).over(Window.partitionBy("path").orderBy("no")), "head": head}).where("not head and panel is not null and trim(line) <> ''").drop("head")


def read_panels(spark: SparkSession, path: str) -> DataFrame:
    """panel and nine columns for each marker."""
    f = F.split(F.regexp_replace("line", "\t+$", ""), "\t+")
    names = ["marker", "dye_col", "min_bp", "max_bp", "exp_pcg", "repeat_bp", "stutter_pc", "uknw", "alleles"]
    numbers = {"min_bp", "max_bp", "repeat_bp", "stutter_pc"}
    cells = [F.trim(F.get(f, F.lit(i))).alias(n) if n not in numbers else F.trim(F.get(f, F.lit(i))).try_cast("double").alias(n) for i, n in enumerate(names)]
    return sections(file_lines(spark, path), "Panel").where(F.size(f) >= 8).select("path", "no", "panel", *cells)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """panel, marker and four columns for each allele."""
    d = sections(file_lines(spark, path), "Panel Name")
    head = F.col("line").rlike("^Marker Name\t")
    w = Window.partitionBy("path", "panel").orderBy("no")
    d = d.withColumns({"marker": F.last(F.when(head, F.get(F.split("line", "\t+"), F.lit(1))), ignorenulls=True).over(w), "head": head}).where("not head and marker is not null")
    f = F.split("line", "\t+")
    return d.select("path", "no", "panel", F.trim("marker").alias("marker"), F.trim(F.get(f, F.lit(0))).alias("allele"), *[F.trim(F.get(f, F.lit(i))).try_cast("double").alias(n) for i, n in enumerate(["size_bp", "minus_bp", "plus_bp"], 1)])


# Element types of the format, as struct codes.
ABIF_TYPES = {1: "B", 2: "c", 3: "H", 4: "h", 5: "i", 7: "f", 8: "d"}


def abif_entries(raw: bytes) -> Iterator[tuple]:
    """(tag, number, index, value, text) of every element of a file's directory."""
    if raw[:4] != b"ABIF":
        raise ValueError("not an ABIF file")
    _, _, _, _, count, _, place = struct.unpack_from(">4sihhiii", raw, 6)
    for k in range(count):
        at = place + 28 * k
        tag, number, kind, _, n, size, offset = struct.unpack_from(">4sihhiii", raw, at)
        start = at + 20 if size <= 4 else offset
        data, name = raw[start : start + size], tag.decode("latin-1")
        if kind in (2, 18, 19):
            text = data[1 : 1 + data[0]] if kind == 18 and data else data
            yield name, number, 0, None, text.split(b"\0")[0].decode("latin-1")
        elif kind == 10 and size >= 4:
            yield name, number, 0, None, "%04d-%02d-%02d" % struct.unpack_from(">hBB", data)
        elif kind == 11 and size >= 4:
            yield name, number, 0, None, "%02d:%02d:%02d.%02d" % struct.unpack_from(">BBBB", data)
        elif kind in ABIF_TYPES:
            for i, x in enumerate(struct.unpack_from(f">{n}{ABIF_TYPES[kind]}", data)):
                yield name, number, i, float(x), None
        else:
            yield name, number, 0, None, None


def read_abif(spark: SparkSession, path: str) -> DataFrame:
    """path, tag, number, idx, value, text: the elements of ABIF files; types out of use give a row of nulls."""
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, raw in zip(b["path"], b["content"]):
                yield pd.DataFrame([(file, *e) for e in abif_entries(bytes(raw))], columns=["path", "tag", "number", "idx", "value", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parsed, "path string, tag string, number int, idx int, value double, text string")


def bfa_records(raw: bytes) -> Iterator[tuple[str, str]]:
    """(name, seq) of a MAQ binary FASTA file: two bits a base in little-endian words of 32 bases, and a mask in which a zero
    pair marks an unknown base."""
    at = 0
    while at + 4 <= len(raw):
        (size,) = struct.unpack_from("<i", raw, at)
        name = raw[at + 4 : at + 4 + size].split(b"\0")[0].decode("latin-1")
        length, n = struct.unpack_from("<ii", raw, at + 4 + size)
        at += 12 + size
        words = struct.unpack_from(f"<{2 * n}Q", raw, at)
        at += 16 * n
        out = []
        for w, m in zip(words[:n], words[n:]):
            out += ["acgt"[(w >> s) & 3] if (m >> s) & 3 else "n" for s in range(62, -2, -2)]
        yield name, "".join(out)[:length]


def read_bfa(spark: SparkSession, path: str) -> DataFrame:
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, raw in zip(b["path"], b["content"]):
                yield pd.DataFrame([(file, *r) for r in bfa_records(bytes(raw))], columns=["path", "name", "seq"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, "path string, name string, seq string")
