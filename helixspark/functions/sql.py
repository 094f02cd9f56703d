"""The pure sequence functions under SQL names, and table functions. They are SQL functions, so Spark inlines them into a query's plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from helixspark import constants as K

FROM, TO = K.COMPLEMENT

#: name: (arguments, result, expression)
FUNCTIONS = {
    "dna_gc": ("s STRING", "DOUBLE", "try_divide(CAST(length(lower(s)) - length(translate(lower(s), 'cg', '')) AS DOUBLE), length(lower(s)) - length(translate(lower(s), 'acgt', '')))"),
    "dna_comp": ("s STRING", "STRING", f"translate(lower(s), '{FROM}', '{TO}')"),
    "dna_revcomp": ("s STRING", "STRING", f"reverse(translate(lower(s), '{FROM}', '{TO}'))"),
    "dna_kmers": ("s STRING, k INT", "ARRAY<STRING>", "regexp_extract_all(s, concat('(?s)(?=(.{', CAST(k AS STRING), '})).'), 1)"),
    "dna_codons": ("s STRING", "ARRAY<STRING>", "regexp_extract_all(s, '(?s)(.{3})', 1)"),
    "dna_third": ("s STRING, pos INT", "STRING", "regexp_replace(substring(s, pos), '(?s)(.).{0,2}', '$1')"),
    "seq_frag": ("s STRING, b INT, e INT", "STRING", "CASE WHEN b >= 1 AND b <= e AND e <= length(s) THEN substring(s, b, e - b + 1) END"),
    "seq_only": ("s STRING, letters STRING", "STRING", "regexp_replace(s, concat('[^', letters, ']'), '')"),
}

#: name: (arguments, columns, query): table functions, for use with LATERAL
TABLE_FUNCTIONS = {
    "seq_words": ("s STRING, k INT", "pos INT, word STRING", "SELECT pos + 1, col FROM posexplode(regexp_extract_all(s, concat('(?s)(?=(.{', CAST(k AS STRING), '})).'), 1))"),
    "seq_codons": ("s STRING, frame INT", "pos INT, codon STRING", "SELECT 3 * pos + frame + 1, col FROM posexplode(regexp_extract_all(substring(s, frame + 1), '(?s)(.{3})', 1))"),
    "seq_windows": ("s STRING, size INT, step INT", "start INT, win STRING", "SELECT pos * step + 1, col FROM posexplode(regexp_extract_all(s, concat('(?s)(?=(.{', CAST(size AS STRING), '})).{1,', CAST(step AS STRING), '}'), 1))"),
    "fasta_records": (
        "text STRING", "record INT, name STRING, annot STRING, seq STRING",
        "SELECT pos, substring_index(substring_index(replace(col, '\r', ''), '\n', 1), ' ', 1), substring_index(replace(col, '\r', ''), '\n', 1),"
        " replace(regexp_replace(substring(replace(col, '\r', ''), length(substring_index(replace(col, '\r', ''), '\n', 1)) + 1), '\n;[^\n]*', ''), '\n', '')"
        " FROM posexplode(split(concat('\n', text), '\n>')) WHERE pos > 0",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to a session; returns their names."""
    for name, (args, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {body}")
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return sorted([*FUNCTIONS, *TABLE_FUNCTIONS])
