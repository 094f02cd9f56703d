"""Fixed values of molecular biology, as published (NCBI genetic codes, IUPAC codes, atomic masses, Bjellqvist pK)."""

from __future__ import annotations

from itertools import product

BASES = "acgt"
#: Order of the bases in the NCBI code tables below: first base slowest.
CODE_ORDER = "tcag"
# Amino acids of the 64 codons in the order above, by NCBI number.
CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    9: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    10: "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    12: "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    13: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    14: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    15: "FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    16: "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    21: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    22: "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    23: "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
# IUPAC symbols and the bases that they stand for.
IUPAC = {"a": "a", "c": "c", "g": "g", "t": "t", "m": "ac", "r": "ag", "w": "at", "s": "cg", "y": "ct", "k": "gt", "v": "acg", "h": "act", "d": "agt", "b": "cgt", "n": "acgt"}
# Complements in the same order.
COMPLEMENT = ("acgtbdhkmsvwnyr", "tgcavhdmksbwnry")
# One- and three-letter names.
AMINO = {
    "*": "Stp", "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu",
    "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr",
}
# Standard atomic weights and the atoms (C, H, O, N, S) of free amino acids.
ATOMS = {"C": 12.0107, "H": 1.00794, "O": 15.9994, "N": 14.0067, "S": 32.065}
FORMULAS = {
    "A": (3, 7, 2, 1, 0), "C": (3, 7, 2, 1, 1), "D": (4, 7, 4, 1, 0), "E": (5, 9, 4, 1, 0), "F": (9, 11, 2, 1, 0), "G": (2, 5, 2, 1, 0),
    "H": (6, 9, 2, 3, 0), "I": (6, 13, 2, 1, 0), "K": (6, 14, 2, 2, 0), "L": (6, 13, 2, 1, 0), "M": (5, 11, 2, 1, 1), "N": (4, 8, 3, 2, 0),
    "P": (5, 9, 2, 1, 0), "Q": (5, 10, 3, 2, 0), "R": (6, 14, 2, 4, 0), "S": (3, 7, 3, 1, 0), "T": (4, 9, 3, 1, 0), "V": (5, 11, 2, 1, 0),
    "W": (11, 12, 2, 2, 0), "Y": (9, 11, 3, 1, 0),
}
# pK of side chains and termini (Bjellqvist et al. 1993); termini differ for some residues.
PK_SIDE = {"C": 9.0, "D": 4.05, "E": 4.45, "H": 5.98, "K": 10.0, "R": 12.0, "Y": 10.0}
PK_C_TERM, PK_C_SPECIAL = 3.55, {"D": 4.55, "E": 4.75}
PK_N_TERM, PK_N_SPECIAL = 7.5, {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
# Classes of residues (EMBOSS pepstats).
CLASSES = {
    "Tiny": "ACGST", "Small": "ABCDGNPSTV", "Aliphatic": "AILV", "Aromatic": "FHWY", "Non.polar": "ACFGILMPVWY", "Polar": "DEHKNQRSTZ",
    "Charged": "BDEHKRZ", "Basic": "HKR", "Acidic": "BDEZ",
}
# Likelihoods of amino-acid replacements by which paths between codons are weighed (Li, Wu and Luo 1985); each row holds
# those of its amino acid with all that follow it in the order FWYHMLIVPCAGTSQNKRED.
REPLACEMENTS = {
    "F": [0.382, 0.382, 0.343, 0.382, 0.382, 0.382, 0.382, 0.128, 0.040, 0.128, 0.040, 0.128, 0.040, 0.128, 0.040, 0.128, 0.343, 0.128, 0.040],
    "W": [0.382, 0.128, 0.343, 0.343, 0.343, 0.343, 0.128, 0.040, 0.128, 0.040, 0.128, 0.040, 0.128, 0.040, 0.128, 0.128, 0.040, 0.040],
    "Y": [0.343, 0.382, 0.382, 0.382, 0.343, 0.128, 0.040, 0.128, 0.128, 0.343, 0.128, 0.343, 0.128, 0.343, 0.343, 0.128, 0.040],
    "H": [0.343, 0.343, 0.343, 0.343, 0.343, 0.040, 0.343, 0.343, 0.382, 0.343, 0.382, 0.343, 0.382, 0.382, 0.382, 0.343],
    "M": [0.382, 0.382, 0.382, 0.343, 0.040, 0.343, 0.128, 0.343, 0.128, 0.128, 0.128, 0.343, 0.343, 0.128, 0.040],
    "L": [0.382, 0.382, 0.343, 0.040, 0.343, 0.128, 0.343, 0.128, 0.128, 0.040, 0.128, 0.128, 0.128, 0.040],
    "I": [0.382, 0.343, 0.040, 0.343, 0.128, 0.343, 0.128, 0.128, 0.128, 0.128, 0.343, 0.128, 0.040],
    "V": [0.343, 0.040, 0.343, 0.128, 0.343, 0.128, 0.343, 0.128, 0.343, 0.343, 0.128, 0.040],
    "P": [0.040, 0.382, 0.382, 0.382, 0.343, 0.343, 0.343, 0.128, 0.128, 0.343, 0.128],
    "C": [0.040, 0.040, 0.128, 0.128, 0.040, 0.128, 0.040, 0.040, 0.040, 0.040],
    "A": [0.343, 0.343, 0.343, 0.343, 0.128, 0.128, 0.128, 0.128, 0.128],
    "G": [0.343, 0.343, 0.343, 0.343, 0.128, 0.128, 0.343, 0.343],
    "T": [0.343, 0.382, 0.343, 0.343, 0.343, 0.343, 0.343],
    "S": [0.343, 0.382, 0.128, 0.128, 0.343, 0.343],
    "Q": [0.382, 0.343, 0.382, 0.382, 0.343],
    "N": [0.343, 0.343, 0.382, 0.382],
    "K": [0.382, 0.343, 0.128],
    "R": [0.343, 0.343],
    "E": [0.382],
}
# Escapes of text for typesetting, in one pass over the characters.
ESCAPES = {"\\": "\\textbackslash{}", "{": "\\{", "}": "\\}", "$": "\\$", "^": "\\^{}", "_": "\\_", "%": "\\%", "#": "\\#", "&": "\\&", "~": "\\~{}", "[": "\\[", "]": "\\]", "|": "\\textbar{}"}


def code(numcode: int = 1) -> dict[str, str]:
    """codon: amino acid, for one genetic code."""
    if numcode not in CODES:
        raise ValueError(f"genetic code {numcode} is not in use")
    return {"".join(c): aa for c, aa in zip(product(CODE_ORDER, repeat=3), CODES[numcode])}


def replacement(a: str, b: str) -> float:
    """Likelihood of one amino acid in place of another; 1 for the same, the least of all for stops."""
    if "*" in (a, b):
        return min(min(r) for r in REPLACEMENTS.values())
    order = "FWYHMLIVPCAGTSQNKRED"
    i, j = sorted((order.index(a), order.index(b)))
    return 1.0 if i == j else REPLACEMENTS[order[i]][j - i - 1]


def words(length: int = 3, alphabet: str = BASES) -> list[str]:
    """All words of a length, the first letter varying slowest."""
    return ["".join(w) for w in product(alphabet, repeat=length)]


def residue_mass(aa: str) -> float:
    return sum(n * m for n, m in zip(FORMULAS[aa], ATOMS.values()))


WATER = 2 * ATOMS["H"] + ATOMS["O"]
