"""BLAST version 4 databases as a Spark data source: volumes, alias files, membership masks, taxid lists.

read_database() gives one row per sequence: seqno (over all volumes), volume, residues, length, deflines, masked. A volume's
mask is the one that the alias naming the volume names, and its bits are the volume's own numbers. Volumes are cut
into ranges of sequences, one input partition each, so readers seek to their part; files must lie where all executors
see them. The driver reads no more than each volume's fixed header.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quiverseq.functions.alphabets import NUCLEOTIDE, PROTEIN
from quiverseq.sources.asn1 import DEFLINES, deflines

SCHEMA = f"seqno long, volume int, residues string, length int, deflines {DEFLINES}, masked boolean"
#: SCHEMA as Arrow types.
LINE = pa.struct([("ids", pa.list_(pa.string())), ("gi", pa.int64()), ("title", pa.string()), ("taxid", pa.int64()), ("memberships", pa.int64()), ("links", pa.int64())])
ARROW = pa.schema([("seqno", pa.int64()), ("volume", pa.int32()), ("residues", pa.string()), ("length", pa.int32()), ("deflines", pa.list_(LINE)), ("masked", pa.bool_())])
RANGE = 20_000
#: Sequences and residues of an Arrow batch at most (one sequence may be longer).
ROWS, RESIDUES = 1024, 1 << 22


@dataclass
class Volume:
    """The header of an index file and where its offset arrays begin."""

    base: str
    protein: bool
    title: str
    time: str
    sequences: int
    residues: int
    longest: int
    headers_at: int

    def file(self, part: str) -> str:
        return f"{self.base}.{'p' if self.protein else 'n'}{part}"

    def offsets(self, array: int, first: int, last: int) -> np.ndarray:
        """Entries first to last (inclusive) of offset array 0 (headers), 1 (sequences) or 2 (ambiguities)."""
        with open(self.file("in"), "rb") as index:
            index.seek(self.headers_at + 4 * (array * (self.sequences + 1) + first))
            return np.frombuffer(index.read(4 * (last - first + 1)), ">u4").astype(np.int64)


def open_volume(base: str, protein: bool) -> Volume:
    with open(f"{base}.{'pin' if protein else 'nin'}", "rb") as index:
        version, _, size = struct.unpack(">III", index.read(12))
        if version != 4:
            raise ValueError("the database version must be 4")
        title = index.read(size).decode("latin-1")
        (size,) = struct.unpack(">I", index.read(4))
        time = index.read(size).decode("latin-1").rstrip("\0")
        index.read(-index.tell() % 4)
        (sequences,) = struct.unpack(">I", index.read(4))
        (residues,) = struct.unpack("<Q", index.read(8))
        (longest,) = struct.unpack(">I", index.read(4))
        return Volume(base, protein, title, time, sequences, residues, longest, index.tell())


@dataclass
class Alias:
    title: str
    volumes: list[str] = field(default_factory=list)
    masks: list[str] = field(default_factory=list)
    length: int = 0
    sequences: int = 0
    max_oid: int = 0
    membership_bit: int = 0


def names(line: str) -> list[str]:
    """Names parted by blanks, quoted where they hold some."""
    return [a or b for a, b in re.findall(r'"([^"]*)"|([^\s"]+)', line)]


def read_alias(base: str, protein: bool) -> Alias | None:
    """The alias file of a database, or None if there is none."""
    path = f"{base}.{'pal' if protein else 'nal'}"
    if not os.path.exists(path):
        return None
    alias = Alias(title=base)
    with open(path, encoding="latin-1") as lines:
        for line in lines:
            key, _, rest = line.strip().partition(" ")
            if key == "GILIST":
                raise ValueError("GILIST in alias files isn't supported")
            if key == "TITLE":
                alias.title = rest.strip()
            elif key in ("DBLIST", "OIDLIST"):
                setattr(alias, "volumes" if key == "DBLIST" else "masks", names(rest))
            elif key in ("LENGTH", "NSEQ", "MAXOID", "MEMB_BIT"):
                setattr(alias, {"LENGTH": "length", "NSEQ": "sequences", "MAXOID": "max_oid", "MEMB_BIT": "membership_bit"}[key], int(rest))
    return alias


@dataclass
class Masked:
    """A volume, the number of its first sequence over all volumes, and its mask file with the last number that may pass."""

    volume: Volume
    start: int
    mask: str | None = None
    max_oid: int = 0


def volumes_of(base: str, protein: bool) -> list[Masked]:
    """All volumes in order; aliases nest one level deep.

    Masks apply if the outer alias has a membership bit. Each volume's mask then comes from the alias that names it, which
    must name that one volume and that one mask; an outer alias that names volumes itself but no mask asks for none.
    """
    top = read_alias(base, protein)
    if top is None:
        return [Masked(open_volume(base, protein), 0)]
    folder = os.path.dirname(base)
    named = []
    for name in top.volumes:
        inner_base = os.path.join(folder, name)
        inner = read_alias(inner_base, protein)
        named += [(top, inner_base)] if inner is None else [(inner, os.path.join(os.path.dirname(inner_base), n)) for n in inner.volumes]
    masks = top.membership_bit and not any(alias is top and not top.masks for alias, _ in named)
    found, start = [], 0
    for alias, path in named:
        if masks and (len(alias.volumes), len(alias.masks)) != (1, 1):
            raise ValueError("an alias with a mask must name one volume and one mask")
        volume = open_volume(path, protein)
        found.append(Masked(volume, start, os.path.join(folder, alias.masks[0]), alias.max_oid) if masks else Masked(volume, start))
        start += volume.sequences
    return found


def unpack_nucleotides(packed: bytes, ambiguities: bytes) -> str:
    """Symbols of a 2-bit packed sequence; runs of ambiguous bases overwrite what they cover."""
    raw = np.frombuffer(packed, np.uint8)
    pairs = np.stack([raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3], axis=1).ravel()
    codes = (1 << pairs[: 4 * (len(raw) - 1) + (int(raw[-1]) & 3)]).astype(np.uint8)
    if len(ambiguities) >= 4:
        wide = ambiguities[0] >> 7
        entries = np.frombuffer(ambiguities[4:], ">u8" if wide else ">u4").astype(np.uint64)
        runs = zip(entries >> (60 if wide else 28), (entries >> (48 if wide else 24)) & (0xFFF if wide else 0xF), entries & ((1 << 48) - 1 if wide else 0xFFFFFF))
        for code, more, at in runs:
            codes[int(at) : int(at) + int(more) + 1] = code
    return np.frombuffer(NUCLEOTIDE.encode(), np.uint8)[codes].tobytes().decode()


@dataclass
class _Range(InputPartition):
    number: int
    source: Masked
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.protein = options.get("protein", "true").lower() == "true"
        self.base, self.headers = options["path"], options.get("headers", "true").lower() == "true"
        self.step = int(options.get("range", RANGE))

    def partitions(self):
        return [_Range(i, m, low, min(low + self.step, m.volume.sequences)) for i, m in enumerate(volumes_of(self.base, self.protein)) for low in range(0, m.volume.sequences, self.step)]

    def read(self, part):
        rows, held = [], 0
        for row in self._rows(part):
            rows.append(dict(zip(ARROW.names, row)))
            held += row[3]
            if len(rows) == ROWS or held > RESIDUES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _rows(self, part):
        v, first, last = part.source.volume, part.first, part.last
        at = v.offsets(1, first, last)
        spoiled = None if v.protein else v.offsets(2, first, last)
        names_at = v.offsets(0, first, last) if self.headers else None
        passes = read_mask(part.source.mask, part.source.max_oid, first, last) if part.source.mask else np.ones(last - first, bool)
        symbols = np.frombuffer(PROTEIN.ljust(256, "-").encode(), np.uint8)
        keys = ("ids", "gi", "title", "taxid", "memberships", "links")
        with open(v.file("sq"), "rb") as body, open(v.file("hr"), "rb") as header:
            for i in range(last - first):
                body.seek(at[i])
                raw = body.read(at[i + 1] - at[i])
                if v.protein:
                    residues = symbols[np.frombuffer(raw[:-1], np.uint8)].tobytes().decode()
                else:
                    residues = unpack_nucleotides(raw[: spoiled[i] - at[i]], raw[spoiled[i] - at[i] :])
                lines = None
                if names_at is not None:
                    header.seek(names_at[i])
                    lines = [{k: d[k] for k in keys} for d in deflines(header.read(names_at[i + 1] - names_at[i]))]
                yield part.source.start + first + i, part.number, residues, len(residues), lines, bool(passes[i])


class BlastDatabase(DataSource):
    """format("blastdb"): options path, protein (true), headers (true), range (sequences a partition)."""

    @classmethod
    def name(cls):
        return "blastdb"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_mask(path: str, max_oid: int, first: int, last: int) -> np.ndarray:
    """Whether sequences first to last - 1 of a volume pass: a 4-byte header, then bits from the most significant on; none beyond max_oid."""
    with open(path, "rb") as mask:
        mask.seek(4 + (first >> 3))
        bits = np.unpackbits(np.frombuffer(mask.read((last + 7 >> 3) - (first >> 3)), np.uint8))
    out = np.zeros(last - first, bool)
    own = bits[first & 7 :][: max(min(last, max_oid + 1) - first, 0)]
    out[: len(own)] = own
    return out


def read_database(spark: SparkSession, base: str, protein: bool = True, headers: bool = True) -> DataFrame:
    """All sequences with their number over all volumes and, where aliases name masks, whether they pass."""
    spark.dataSource.register(BlastDatabase)
    return spark.read.format("blastdb").option("protein", str(protein).lower()).option("headers", str(headers).lower()).load(base)


def with_taxids(rows: DataFrame, taxids: DataFrame) -> DataFrame:
    """The sequences of rows (seqno, deflines, ...) that have a def-line of one of the taxids, by a semi-join."""
    own = rows.select("seqno", F.explode("deflines").alias("line")).select("seqno", F.col("line.taxid").alias("taxid"))
    return rows.join(own.join(taxids.select("taxid"), "taxid", "left_semi").select("seqno").distinct(), "seqno", "left_semi")


def read_taxids(spark: SparkSession, path: str) -> DataFrame:
    """taxid: one integer per line."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) as bigint)").alias("taxid")).where("taxid is not null")
