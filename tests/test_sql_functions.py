from helixspark.functions import sql


def test_sql_functions(spark):
    assert "dna_gc" in sql.register(spark)
    row = spark.sql("SELECT dna_gc('ACGTNN') gc, dna_revcomp('aacg') rc, dna_kmers('abcd', 2) ks, dna_codons('aaacccg') cs, dna_third('abcdefg', 3) t, seq_frag('abcd', 2, 3) f, seq_frag('abcd', 2, 9) g, seq_only('aXc', 'acgt') o, dna_gc('nn') none").first()
    assert (row.gc, row.rc, row.ks, row.cs, row.t, row.f, row.g, row.o, row.none) == (0.5, "cgtt", ["ab", "bc", "cd"], ["aaa", "ccc"], "cf", "bc", None, "ac", None)


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "aacgt"), (2, None), (3, "a")], "id int, seq string").createOrReplaceTempView("own_seqs")
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    assert rows("SELECT id, w.pos, w.word FROM own_seqs, LATERAL seq_words(seq, 2) w") == [(1, 1, "aa"), (1, 2, "ac"), (1, 3, "cg"), (1, 4, "gt")]
    assert rows("SELECT id, c.* FROM own_seqs, LATERAL seq_codons(seq, 1) c") == [(1, 2, "acg")]
    assert rows("SELECT id, w.* FROM own_seqs, LATERAL seq_windows(seq, 3, 2) w") == [(1, 1, "aac"), (1, 3, "cgt")]
    spark.createDataFrame([(">a b\r\nAC\r\n; note\r\nGT\r\n>c\n",), ("none",), (None,)], "text string").createOrReplaceTempView("own_texts")
    assert rows("SELECT f.* FROM own_texts, LATERAL fasta_records(text) f") == [(1, "a", "a b", "ACGT"), (2, "c", "c", "")]
    assert rows("SELECT w.word, count(*) FROM own_texts, LATERAL fasta_records(text) f, LATERAL seq_words(f.seq, 1) w GROUP BY ALL") == [(c, 1) for c in "ACGT"]
