"""Residue alphabets: symbols to codes and back, reverse complement, genetic codes, translation.

A text becomes a sequence by keeping the characters that its alphabet maps and dropping all others, so white space,
digits and punctuation may stand anywhere. Symbols are the stored form; codes exist only inside kernels.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Symbols in the order of their codes.
PROTEIN = "-ABCDEFGHIKLMNPQRSTVWXYZU*OJ"
NUCLEOTIDE = "-ACMGRSVTWYHKDBN"
SOUND = "-ABCDEFGHIJKLMNOPQRSTUVWXYZabcde"
# The standard genetic code in the order T, C, A, G of each codon position, and how others differ from it.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
DIFFERENCES = {
    1: "",
    2: "AGA* AGG* ATAM TGAW",
    3: "ATAM CTTT CTCT CTAT CTGT TGAW",
    4: "TGAW",
    5: "AGAS AGGS ATAM TGAW",
    6: "TAAQ TAGQ",
    9: "AAAN AGAS AGGS TGAW",
    10: "TGAC",
    11: "",
    12: "CTGS",
    13: "AGAG AGGG ATAM TGAW",
    14: "AAAN AGAS AGGS TAAY TGAW",
    15: "TAGQ",
    16: "TAGL",
    21: "AAAN AGAS AGGS ATAM TGAW",
    22: "TCA* TAGL",
    23: "TTA*",
}
KINDS = {"protein": PROTEIN, "nucleotide": NUCLEOTIDE, "sound": SOUND}


def residues(column: Column, kind: str) -> Column:
    """The residue symbols of a text; null stays null. Protein J, O and U are residues; nucleotide U reads as T."""
    if kind == "protein":
        kept = F.regexp_replace(column, r"[^A-Za-z*\-]", "")
        return F.translate(kept, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if kind == "nucleotide":
        kept = F.regexp_replace(column, r"[^ACGTURYMKSWBDHVNacgturymkswbdhvn\-]", "")
        return F.translate(kept, "acgturymkswbdhvnU", "ACGTTRYMKSWBDHVNT")
    if kind == "sound":
        return F.regexp_replace(column, r"[^A-Za-e\-]", "")
    raise ValueError(f"no alphabet {kind!r}")


def clean(text: str, kind: str) -> str:
    """residues() for a Python string."""
    if kind != "sound":
        text = "".join(c.upper() if c.isascii() else "" for c in text)
    if kind == "nucleotide":
        text = text.replace("U", "T")
    return "".join(c for c in text if c in KINDS[kind])


@lru_cache
def _table(kind: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for code, symbol in enumerate(KINDS[kind]):
        table[ord(symbol)] = code
    return table


def encode(symbols: str | bytes, kind: str) -> np.ndarray:
    """Codes of residue symbols."""
    raw = symbols.encode() if isinstance(symbols, str) else symbols
    return _table(kind)[np.frombuffer(raw, np.uint8)]


def decode(codes: np.ndarray, kind: str) -> str:
    return "".join(KINDS[kind][c] for c in codes)


def codes(column: Column, kind: str) -> Column:
    """Codes of residue symbols as an array<int>."""
    place = F.create_map(*[F.lit(x) for code, symbol in enumerate(KINDS[kind]) for x in (symbol, code)])
    letters = F.filter(F.split(column, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.element_at(place, c))


def symbols(column: Column, kind: str) -> Column:
    """Residue symbols of an array of codes."""
    names = F.array(*map(F.lit, KINDS[kind]))
    return F.array_join(F.transform(column, lambda c: F.element_at(names, (c + 1).cast("int"))), "")


def reverse_complement(column: Column) -> Column:
    return F.translate(F.reverse(column), "ACGTRYMKSWBDHVN", "TGCAYRKMSWVHDBN")


def reverse_complement_text(text: str) -> str:
    return text[::-1].translate(str.maketrans("ACGTRYMKSWBDHVN", "TGCAYRKMSWVHDBN"))


def genetic_code(number: int) -> str:
    """64 amino acids in the order T, C, A, G; 17 codes exist."""
    if number not in DIFFERENCES:
        raise ValueError(f"no genetic code {number}")
    acids = list(STANDARD)
    for change in DIFFERENCES[number].split():
        acids[sum("TCAG".index(base) * 4 ** (2 - i) for i, base in enumerate(change[:3]))] = change[3]
    return "".join(acids)


@lru_cache
def codon_table(number: int = 1) -> dict[str, str]:
    """Amino acid of all 16**3 codons of nucleotide symbols.

    A codon stands for all that its ambiguity symbols allow: one acid if they agree, B for D or N, Z for E or Q, else X.
    "-" allows no base, so such a codon is X.
    """
    acids = genetic_code(number)
    allowed = {s: [i for i, base in enumerate("TCAG") if NUCLEOTIDE.index(s) & NUCLEOTIDE.index(base)] for s in NUCLEOTIDE}
    out = {}
    for codon in product(NUCLEOTIDE, repeat=3):
        found = {acids[16 * a + 4 * b + c] for a, b, c in product(*(allowed[s] for s in codon))}
        out["".join(codon)] = found.pop() if len(found) == 1 else "B" if found == {"D", "N"} else "Z" if found == {"E", "Q"} else "X"
    return out


def translate_text(dna: str, strand: int, frame: int, table: dict[str, str]) -> str:
    """Amino acids of a reading frame: strand 1 reads the reverse complement."""
    dna = reverse_complement_text(dna) if strand else dna
    return "".join(table[dna[i : i + 3]] for i in range(frame, len(dna) - 2, 3))


def translated(dna: Column, strand: Column, frame: Column, number: int = 1) -> Column:
    """translate_text() as an expression: frames of a nucleotide column, strand and frame per row.

    A codon's three codes are its place among 16**3 acids. A batch's bytes are coded at once; each row is three strided
    slices and one look-up.
    """
    acids = np.frombuffer("".join(codon_table(number).values()).encode(), np.uint8)
    codes, minus = np.zeros(256, np.uint16), np.zeros(256, np.uint16)
    for i, symbol in enumerate(NUCLEOTIDE):
        codes[ord(symbol)], minus[ord(symbol)] = i, NUCLEOTIDE.index(reverse_complement_text(symbol))

    @arrow_udf("string")
    def read(dna: pa.Array, strand: pa.Array, frame: pa.Array) -> pa.Array:
        text = dna.cast(pa.large_string())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1].tolist() if len(text) else [0]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8) if len(text) else np.zeros(0, np.uint8)
        out = []
        for low, high, s, f, known in zip(at, at[1:], strand.to_pylist(), frame.to_pylist(), dna.is_valid().to_pylist()):
            if not known:
                out.append(None)
                continue
            own = minus[data[low:high][::-1]] if s == 1 else codes[data[low:high]]
            n = 3 * max((len(own) - f) // 3, 0)
            own = own[f : f + n]
            out.append(acids[own[0::3] * 256 + own[1::3] * 16 + own[2::3]].tobytes().decode())
        return pa.array(out, pa.string())

    return read(dna, strand, frame)
