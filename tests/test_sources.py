import struct

import numpy as np
import pytest

from quiverseq.functions.alphabets import NUCLEOTIDE, encode
from quiverseq.sources import asn1, blastdb
from quiverseq.sources.fasta import fasta, read_fasta, read_queries


def tlv(tag, body):
    """Constructed values of indefinite length, as databases hold them; primitive ones of definite length."""
    if tag & 0x20:
        return bytes([tag, 0x80]) + body + b"\0\0"
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")) + body


def string(text):
    return tlv(0x1A, text.encode())


def integer(n):
    return tlv(0x02, n.to_bytes((n.bit_length() + 8) // 8, "big"))


def text_id(choice, accession, name="", version=0, release=""):
    parts = (tlv(0xA0, string(name)) if name else b"") + tlv(0xA1, string(accession)) + (tlv(0xA2, string(release)) if release else b"") + (tlv(0xA3, integer(version)) if version else b"")
    return tlv(0xA0 + choice, tlv(0x30, parts))


def defline(ids, title="", taxid=0, memberships=0, links=0):
    body = (tlv(0xA0, string(title)) if title else b"") + tlv(0xA1, tlv(0x30, b"".join(ids)))
    body += tlv(0xA2, integer(taxid)) if taxid else b""
    body += tlv(0xA3, tlv(0x30, integer(memberships))) if memberships else b""
    body += tlv(0xA4, tlv(0x30, integer(links))) if links else b""
    return tlv(0x30, body)


def write_volume(base, protein, sequences, headers):
    """A version 4 volume of residue strings; nucleotides may hold ambiguity symbols."""
    body, starts, spoiled = (b"\0" if protein else b""), [], []
    for s in sequences:
        starts.append(len(body))
        if protein:
            body += encode(s, "protein").tobytes() + b"\0"
            continue
        codes = encode(s, "nucleotide")
        bases = np.array([{1: 0, 2: 1, 4: 2, 8: 3}.get(int(c), 0) for c in codes])
        packed = np.concatenate([bases, np.zeros(4 - len(bases) % 4 if len(bases) % 4 else 4, int)]).reshape(-1, 4)
        raw = (packed @ np.array([64, 16, 4, 1])).astype(np.uint8)
        raw[-1] = (raw[-1] & 0xFC) | len(bases) % 4
        body += raw.tobytes()
        spoiled.append(len(body))
        odd = [(int(c), i) for i, c in enumerate(codes) if c not in (1, 2, 4, 8)]
        if odd:
            body += struct.pack(">I", len(odd)) + b"".join(struct.pack(">I", c << 28 | i) for c, i in odd)
    ends = [*starts, len(body)]
    names = b"".join(headers)
    name_ends = np.concatenate([[0], np.cumsum([len(h) for h in headers])]).astype(int)
    title, time = b"test database", b"Jan 1, 2020  1:00 PM"
    index = struct.pack(">III", 4, int(protein), len(title)) + title + struct.pack(">I", len(time)) + time
    index += b"\0" * (-len(index) % 4)
    index += struct.pack(">I", len(sequences)) + struct.pack("<Q", sum(map(len, sequences))) + struct.pack(">I", max(map(len, sequences)))
    index += b"".join(struct.pack(">I", x) for x in [*name_ends, *ends, *([*spoiled, len(body)] if not protein else [])])
    kind = "p" if protein else "n"
    for suffix, data in (("in", index), ("hr", names), ("sq", body)):
        with open(f"{base}.{kind}{suffix}", "wb") as f:
            f.write(data)


def headed(*lines):
    return tlv(0x30, b"".join(lines))


def test_identifiers_and_deflines():
    gi = tlv(0xAB, integer(77))
    pdb = lambda chain: tlv(0xAE, tlv(0x30, tlv(0xA0, string("1ABC")) + tlv(0xA1, integer(chain))))
    local = tlv(0xA0, tlv(0xA1, string("mine")))
    general = tlv(0xAA, tlv(0x30, tlv(0xA0, string("DB")) + tlv(0xA1, tlv(0xA0, integer(12)))))
    patent = tlv(0xA8, tlv(0x30, tlv(0xA0, integer(3)) + tlv(0xA1, tlv(0x30, tlv(0xA0, string("US")) + tlv(0xA1, tlv(0xA0, string("5555")))))))
    data = headed(
        defline([gi, text_id(4, "A1", "NAME", 2)], "a title", 9606, 1, 4),
        defline([text_id(7, "P1", "N_X", 1, "unreviewed"), pdb(65), pdb(97), local, general, patent]),
        defline([text_id(9, "NP_1")], "x" * 300),
    )
    first, second, third = asn1.deflines(data)
    assert (first["ids"], first["gi"], first["taxid"], first["memberships"], first["links"]) == (["gb|A1.2|NAME"], 77, 9606, 1, 4)
    assert second["ids"] == ["tr|P1.1|N_X", "pdb|1ABC|A", "pdb|1ABC|AA", "lcl|mine", "gnl|DB|12", "pat|US|5555|3"]
    assert second["title"] == "unnamed protein product"
    assert third["title"] == "x" * 300
    assert asn1.text(first) == "gb|A1.2|NAME a title"
    assert asn1.text(first, show_gis=True, show_taxid=True) == "gi|77|gb|A1.2|NAME|taxid|9606|link|4|memb|1 a title"
    for cut in range(1, len(data)):
        with pytest.raises(ValueError):
            asn1.deflines(data[:cut])


def test_protein_database_with_volumes_and_mask(spark, tmp_path):
    sequences = [["MKVL*", "ACDEFGHIKLMNPQRSTVWYBZXUOJ"], ["GG", "WWW", "AA"]]
    for v, part in enumerate(sequences):
        write_volume(str(tmp_path / f"vol.{v:02}"), True, part, [headed(defline([text_id(4, f"A{v}{i}")], f"title {i}", 9606 + v)) for i in range(len(part))])
    (tmp_path / "db.pal").write_text('TITLE all of it\nDBLIST vol.00 "vol.01"\nNSEQ 5\nLENGTH 39\n')
    rows = blastdb.read_database(spark, str(tmp_path / "db")).orderBy("seqno").collect()
    assert [(r["seqno"], r["volume"], r["residues"], r["length"], r["masked"]) for r in rows] == [(i, v, s, len(s), True) for i, (v, s) in enumerate((v, s) for v, part in enumerate(sequences) for s in part)]
    assert rows[1]["deflines"][0]["ids"] == ["gb|A01|"] and rows[1]["deflines"][0]["taxid"] == 9606
    alias = blastdb.read_alias(str(tmp_path / "db"), True)
    assert (alias.title, alias.volumes, alias.sequences, alias.length) == ("all of it", ["vol.00", "vol.01"], 5, 39)
    one = blastdb.with_taxids(blastdb.read_database(spark, str(tmp_path / "db")), spark.createDataFrame([(9607,), (1,)], "taxid long"))
    assert sorted(r["seqno"] for r in one.collect()) == [2, 3, 4]


def test_each_volume_has_the_mask_of_its_alias(spark, tmp_path):
    parts = [["MK", "AC", "GH"], ["W" * i for i in range(1, 12)]]
    for v, part in enumerate(parts):
        write_volume(str(tmp_path / f"vol.{v:02}"), True, part, [headed(defline([text_id(4, f"A{v}{i}")])) for i in range(len(part))])
        (tmp_path / f"in{v}.pal").write_text(f"DBLIST vol.{v:02}\nOIDLIST m{v}.msk\nMAXOID {(2, 9)[v]}\nMEMB_BIT 1\n")
    (tmp_path / "m0.msk").write_bytes(struct.pack(">I", 2) + bytes([0b01011111]))
    (tmp_path / "m1.msk").write_bytes(struct.pack(">I", 10) + bytes([0b10000001, 0b11111111]))
    (tmp_path / "db.pal").write_text("DBLIST in0 in1\nMEMB_BIT 1\n")
    read = lambda name: [(r["seqno"], r["masked"]) for r in blastdb.read_database(spark, str(tmp_path / name)).orderBy("seqno").collect()]
    assert read("db") == [(i, i in (1, 3, 10, 11, 12)) for i in range(14)]  # number 10 of the second volume lies beyond its last
    assert blastdb.read_mask(str(tmp_path / "m1.msk"), 9, 5, 11).tolist() == [False, False, True, True, True, False]
    (tmp_path / "free.pal").write_text("DBLIST in0 in1\n")
    assert read("free") == [(i, True) for i in range(14)]  # without a bit of its own the outer alias asks for no mask
    (tmp_path / "one.pal").write_text("DBLIST vol.00\nOIDLIST m0.msk\nMAXOID 2\nMEMB_BIT 1\n")
    assert read("one") == [(0, False), (1, True), (2, False)]
    (tmp_path / "two.pal").write_text("DBLIST vol.00 vol.01\nOIDLIST m0.msk\nMAXOID 2\nMEMB_BIT 1\n")
    with pytest.raises(ValueError):
        blastdb.volumes_of(str(tmp_path / "two"), True)


def test_nucleotide_database_with_ambiguities(spark, tmp_path):
    sequences = ["ACGTACG", "ACGT", "NNACGTRYKA", "T"]
    write_volume(str(tmp_path / "nt"), False, sequences, [headed(defline([text_id(4, f"N{i}")])) for i in range(4)])
    rows = blastdb.read_database(spark, str(tmp_path / "nt"), protein=False).orderBy("seqno").collect()
    assert [r["residues"] for r in rows] == sequences
    assert all(r["masked"] for r in rows)
    assert blastdb.unpack_nucleotides(b"\x1b\x00", b"\x80\x00\x00\x01" + struct.pack(">Q", 15 << 60 | 1 << 48 | 2)) == "ACNN"
    assert NUCLEOTIDE[15] == "N"


def test_bad_database_version(tmp_path):
    (tmp_path / "x.pin").write_bytes(struct.pack(">III", 5, 1, 0))
    with pytest.raises(ValueError):
        blastdb.open_volume(str(tmp_path / "x"), True)
    (tmp_path / "y.pal").write_text("GILIST some\n")
    with pytest.raises(ValueError):
        blastdb.read_alias(str(tmp_path / "y"), True)


def test_taxids(spark, tmp_path):
    (tmp_path / "t.txt").write_text("9606\n\n 10090 \nnone\n")
    assert sorted(r[0] for r in blastdb.read_taxids(spark, str(tmp_path / "t.txt")).collect()) == [9606, 10090]


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "q.fa").write_text("ac gt\n>one first > not a record\nAC\nGT 12\n\n>two\r\nTTU\r\n>" + "l" * 5000 + "\nA\n")
    rows = [tuple(r) for r in read_queries(spark, str(tmp_path / "q.fa"), "nucleotide").collect()]
    assert rows == [("", "ACGT"), ("one first > not a record", "ACGT"), ("two", "TTT"), ("l" * 5000, "A")]
    (tmp_path / "db.fa").write_text(">a b\nMK\nV\n>c\n" + "A" * 160 + "\n")
    db = read_fasta(spark, str(tmp_path / "db.fa"))
    assert sorted(map(tuple, db.collect())) == [("a b", "MKV"), ("c", "A" * 160)]
    records = [r["record"] for r in fasta(db, "description").orderBy("description").collect()]
    assert records == [">a b\nMKV\n", ">c\n" + "A" * 80 + "\n" + "A" * 80 + "\n"]
