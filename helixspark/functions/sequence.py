"""Column functions on sequences (strings). All are built-in expressions; a null sequence gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixspark import constants as K


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def chars(seq: Column) -> Column:
    """The characters in order; an empty sequence has none."""
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def join(letters: Column) -> Column:
    return F.array_join(letters, "")


def kmers(seq: Column, size: int, first: int | Column = 0, by: int = 1) -> Column:
    """All whole words of a size, from position first + 1 in steps of by. One pass of a regular expression, so the
    time grows with the sequence's length alone (a substring by position would count characters from its start)."""
    rest = seq if isinstance(first, int) and not first else F.substring(seq, first + 1, F.lit(1 << 30) if isinstance(first, Column) else 1 << 30)
    return F.regexp_extract_all(rest, F.lit(f"(?s)(?=(.{{{size}}})).{{1,{by}}}"), F.lit(1))


def splitseq(seq: Column, frame: int | Column = 0, word: int = 3) -> Column:
    """Non-overlapping words; a short one at the end is dropped."""
    return kmers(seq, word, frame, word)


def comp(seq: Column, ambiguous: bool = False) -> Column:
    """Complement in lower case. Without ambiguous, characters other than acgt are dropped."""
    low = F.lower(seq)
    if not ambiguous:
        low = F.regexp_replace(low, "[^acgt]", "")
    return F.translate(low, *K.COMPLEMENT)


def revcomp(seq: Column, ambiguous: bool = False) -> Column:
    return F.reverse(comp(seq, ambiguous))


def rot13(text: Column) -> Column:
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, low + up, low[13:] + low[:13] + up[13:] + up[:13])


def dna(text: Column) -> Column:
    """The letters acgt of any text, lower-cased."""
    return F.lower(F.regexp_replace(text, "[^acgtACGT]", ""))


def protein(text: Column) -> Column:
    """The amino-acid letters of any text, upper-cased."""
    return F.regexp_replace(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "")


def times(seq: Column, letters: str) -> Column:
    """How many characters of the sequence are among letters; no array is built. Letters are taken out one after another, which
    searches bytes; a translation looks every character up."""
    rest = seq
    for c in letters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(seq) - F.length(rest)


def gc(seq: Column) -> Column:
    """(c + g) / (a + c + g + t) of the lower-cased sequence; null if there is none of them."""
    low = F.lower(seq)
    return F.try_divide(times(low, "cg").cast("double"), times(low, "acgt"))


def gc_exact(seq: Column) -> Column:
    """G+C content in which each ambiguous base counts in the proportion of the bases it stands for; null if
    nothing informative is left."""
    low = F.lower(seq)
    n = {b: times(low, b).cast("double") for b in K.BASES}
    strong, total = n["c"] + n["g"] + times(low, "s"), times(low, "acgtsw").cast("double")
    for symbol, bases in K.IUPAC.items():
        if symbol in "acgtswn":
            continue
        here = sum((n[b] for b in bases), F.lit(0.0))
        count = times(low, symbol)
        part = sum((n[b] for b in bases if b in "cg"), F.lit(0.0))
        strong = strong + F.coalesce(F.try_divide(count * part, here), F.lit(0.0))
        total = total + F.when(here > 0, count).otherwise(0)
    return F.try_divide(strong, total)


def every_third(seq: Column, pos: int, frame: int = 0) -> Column:
    """The characters at codon position pos (1 to 3)."""
    return F.regexp_replace(F.substring(seq, frame + pos, 1 << 30), "(?s)(.).{0,2}", "$1")


def gc_pos(seq: Column, pos: int, frame: int = 0) -> Column:
    return gc(every_third(seq, pos, frame))


def translate(seq: Column, frame: int | Column = 0, sens: str = "F", numcode: int | Column = 1, unknown: str = "X", ambiguous: bool = False) -> Column:
    """The protein of a sequence. Codons of the lower-cased sequence that the code lacks give unknown; with
    ambiguous, codons of IUPAC symbols are translated if all their readings agree. frame and numcode may differ by row (columns);
    a row whose code isn't in use is null. ambiguous needs one code."""
    by_row = isinstance(numcode, Column)
    if by_row and ambiguous:
        raise ValueError("ambiguous codons are read by one code")
    codes = F.try_element_at(literal_map(K.CODES), numcode.cast("int")) if by_row else F.lit(K.CODES[numcode] if numcode in K.CODES else K.code(numcode))
    table = {} if by_row else K.code(numcode)
    if ambiguous:
        table = dict(table)
        for codon in (a + b + c for a in K.IUPAC for b in K.IUPAC for c in K.IUPAC):
            read = {K.code(numcode)[x + y + z] for x in K.IUPAC[codon[0]] for y in K.IUPAC[codon[1]] for z in K.IUPAC[codon[2]]}
            if len(read) == 1:
                table[codon] = read.pop()
    low = F.lower(seq)
    if sens == "R":
        low = F.reverse(F.translate(low, *K.COMPLEMENT))
    if ambiguous:
        aa = literal_map(table)
        return join(F.transform(splitseq(low, frame), lambda c: F.coalesce(F.try_element_at(aa, c), F.lit(unknown))))
    # a codon's place in the code is found by arithmetic, which is cheaper than a lookup
    place = lambda c, i: F.instr(F.lit(K.CODE_ORDER), F.substring(c, i, 1)) - 1
    known = lambda c: c.rlike("^[acgt]{3}$")
    whole = F.when(codes.isNotNull(), splitseq(low, frame)) if by_row else splitseq(low, frame)
    return join(F.transform(whole, lambda c: F.when(known(c), F.substring(codes, 16 * place(c, 1) + 4 * place(c, 2) + place(c, 3) + 1, F.lit(1))).otherwise(unknown)))


def words_pos(seq: Column, word: str) -> Column:
    """1-based starts of all occurrences of a word, overlapping ones too."""
    return F.filter(F.transform(kmers(seq, len(word)), lambda w, i: F.when(w == word, i + 1)), lambda i: i.isNotNull())


def s2n(letter: Column, levels: str = K.BASES, base4: bool = True) -> Column:
    return F.nullif(F.instr(F.lit(levels), letter), F.lit(0)) - (1 if base4 else 0)


def n2s(number: Column, levels: str = K.BASES, base4: bool = True) -> Column:
    i = number + (1 if base4 else 0)
    return F.when((i >= 1) & (i <= len(levels)), F.substring(F.lit(levels), i.cast("int"), F.lit(1)))


def aaa(letter: Column) -> Column:
    """Three-letter names; null if unknown."""
    return F.try_element_at(literal_map(K.AMINO), letter)


def a(name: Column) -> Column:
    return F.try_element_at(literal_map({v: k for k, v in K.AMINO.items()}), name)


def amb(symbol: Column) -> Column:
    """The bases of an IUPAC symbol; u is t; null if it is none."""
    return F.try_element_at(F.create_map(*[x for s, b in {**K.IUPAC, "u": "t"}.items() for x in (F.lit(s), F.array(*[F.lit(c) for c in b]))]), F.lower(symbol))


def mask(symbol: Column) -> Column:
    """A set of bases as four bits; null for what is no IUPAC symbol."""
    bits = {s: sum(1 << K.BASES.index(c) for c in b) for s, b in {**K.IUPAC, "u": "t"}.items()}
    return F.try_element_at(literal_map(bits), F.lower(symbol))


def of_mask(bits: Column) -> Column:
    return F.try_element_at(literal_map({sum(1 << K.BASES.index(c) for c in b): s for s, b in K.IUPAC.items()}), bits)


def bma(letters: Column) -> Column:
    """The IUPAC symbol of an array of symbols; null if any is none."""
    bits = F.transform(letters, mask)
    return F.when(F.size(letters) > 0, of_mask(F.aggregate(bits, F.lit(0), lambda acc, x: acc.bitwiseOR(x))))


def al2bp(allele: Column, repeat_bp: int = 4) -> Column:
    """Allele name to base pairs: "9.3" is 9 repeats and 3; names off the ladder (<, >, letters) give null."""
    text = F.trim(allele.cast("string"))
    ok = text.rlike(r"^[0-9]+(\.[0-9]+)?$")
    return F.when(ok, F.split_part(text, F.lit("."), F.lit(1)).try_cast("int") * repeat_bp + F.coalesce(F.nullif(F.split_part(text, F.lit("."), F.lit(2)), F.lit("")).try_cast("int"), F.lit(0)))


def trim_space(text: Column, leading: bool = True, trailing: bool = True) -> Column:
    out = F.regexp_replace(text, r"^\s+", "") if leading else text
    return F.regexp_replace(out, r"\s+$", "") if trailing else out


def stresc(text: Column) -> Column:
    """Typesetting escapes, each character once."""
    table = literal_map(K.ESCAPES)
    return join(F.transform(chars(text), lambda c: F.coalesce(F.try_element_at(table, c), c)))


def frag(seq: Column, begin: Column | int, end: Column | int) -> Column:
    """Positions begin to end, 1-based and inclusive; null if they are out of bounds."""
    b, e = (x if isinstance(x, Column) else F.lit(x) for x in (begin, end))
    return F.when((b >= 1) & (b <= e) & (e <= F.length(seq)), F.substring(seq, b, e - b + 1))


def reply_values(line: Column) -> Column:
    """The values of k=v&k=v."""
    return F.regexp_extract_all(line, F.lit("=([^=&]*)"), F.lit(1))


def shared_alleles(a: Column, b: Column) -> Column:
    """Bits set in both of two arrays of octets."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, x: acc + x)


def best_site(seq: Column, primer: str, most: int = 3) -> Column:
    """struct<mismatches, pos> of the window nearest to a primer, the first of equals; null if it has more than
    most mismatches."""
    letters = list(primer)
    miss = lambda w: sum(((F.substring(w, k + 1, 1) != c).cast("int") for k, c in enumerate(letters)), F.lit(0))
    sites = F.transform(kmers(seq, len(primer)), lambda w, i: F.struct(miss(w).alias("mismatches"), (i + 1).alias("pos")))
    return F.array_min(F.filter(sites, lambda s: s["mismatches"] <= most))


def amplified(seq: Column, first: str, second: str, forward: bool = True, most: int = 3) -> Column:
    """struct<length, pos_first, pos_second> of the fragment between two primers' best sites, the later one's length included; on the
    other strand their reverse complements are looked for. Null if either has more than most mismatches."""
    turned = lambda p: p if forward else p.translate(str.maketrans(*K.COMPLEMENT))[::-1]
    a, b = (best_site(seq, turned(p.lower()), most)["pos"] for p in (first, second))
    length = F.abs(b - a) + len(second if forward else first)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(length.alias("length"), a.alias("pos_first"), b.alias("pos_second")))
