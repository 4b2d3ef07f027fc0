"""BLAST def-lines: BER-encoded ASN.1 (Blast-def-line-set) to dictionaries, and their text forms."""

from __future__ import annotations

# Tags of sequence identifiers in the order of their choice numbers.
DATABASES = ["lcl", "bbs", "bbm", "gim", "gb", "emb", "pir", "sp", "pat", "ref", "gnl", "gi", "dbj", "prf", "pdb", "tpg", "tpe", "tpd", "gpp", "nat"]
INTEGER, STRING, SEQUENCE = 0x02, 0x1A, 0x30
DEFLINES = "array<struct<ids:array<string>,gi:bigint,title:string,taxid:bigint,memberships:bigint,links:bigint>>"


def parse(data: bytes) -> list[tuple[int, object]]:
    """All values in the data as (tag, value): a list for constructed ones, int, str or bytes for others."""
    return _items(data, 0, len(data), False)[0]


def _items(data: bytes, at: int, end: int, open_ended: bool) -> tuple[list, int]:
    found = []
    while at < end:
        if open_ended and data[at : at + 2] == b"\0\0":
            return found, at + 2
        if at + 2 > end:
            raise ValueError("the def-line data ends early")
        tag, size = data[at], data[at + 1]
        at += 2
        if size == 0x80:
            value, at = _items(data, at, end, True)
            found.append((tag, value))
            continue
        if size > 0x80:
            wide = size & 0x7F
            if at + wide > end:
                raise ValueError("the def-line data ends early")
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + size > end:
            raise ValueError("the def-line data ends early")
        raw = data[at : at + size]
        at += size
        if tag & 0x20:
            found.append((tag, _items(raw, 0, size, False)[0]))
        elif tag == INTEGER:
            found.append((tag, int.from_bytes(raw, "big")))
        else:
            found.append((tag, raw.decode("latin-1") if tag == STRING else raw))
    if open_ended:
        raise ValueError("the def-line data ends early")
    return found, at


def _fields(items) -> dict[int, object]:
    """Context-tagged members of a sequence by number."""
    inner = items[0][1] if len(items) == 1 and items[0][0] == SEQUENCE else items
    return {tag & 0x1F: value for tag, value in inner if tag & 0x80}


def _plain(value, default=""):
    """The one primitive value inside."""
    while isinstance(value, list):
        if not value:
            return default
        value = value[0][1]
    return value


def _object(value) -> str:
    return str(_plain(value))


def identifier(choice: int, value) -> str:
    """Text of a sequence identifier, such as gb|accession.version|name."""
    name = DATABASES[choice]
    if choice in (1, 2, 11):
        return f"{name}|{_plain(value, 0)}"
    if choice == 0:
        return f"{name}|{_object(value)}"
    parts = _fields(value)
    if choice == 3:
        return f"{name}|{_plain(parts.get(0), 0)}"
    if choice == 8:
        about = _fields(parts.get(1, []))
        number = about.get(1, [])
        granted = not number or number[0][0] & 0x1F == 0
        return f"{'pat' if granted else 'pgp'}|{_plain(about.get(0))}|{_plain(number)}|{_plain(parts.get(0), 0)}"
    if choice == 10:
        return f"{name}|{_plain(parts.get(0))}|{_object(parts.get(1, []))}"
    if choice == 14:
        chain = _plain(parts.get(1, []), 32)
        return f"{name}|{_plain(parts.get(0))}|{chr(chain - 32) * 2 if chain > 95 else chr(chain)}"
    accession, version = _plain(parts.get(1, [])), _plain(parts.get(3, []), 0)
    if name == "sp" and _plain(parts.get(2, [])) == "unreviewed":
        name = "tr"
    return f"{name}|{accession}.{version}|{_plain(parts.get(0, []))}" if version else f"{name}|{accession}|{_plain(parts.get(0, []))}"


def _last(value) -> int:
    inner = value[0][1] if value and isinstance(value[0][1], list) else value
    return inner[-1][1] if inner else 0


def deflines(data: bytes) -> list[dict]:
    """The def-lines of one sequence: ids without gi, gi, title, taxid, memberships, links (0 where absent)."""
    found = []
    for _, lines in parse(data):
        for _, line in lines:
            parts = {tag & 0x1F: value for tag, value in line}
            ids = parts.get(1, [])
            ids = ids[0][1] if len(ids) == 1 and ids[0][0] == SEQUENCE else ids
            chosen = [(tag & 0x1F, value) for tag, value in ids]
            gi = next((_plain(v, 0) for c, v in chosen if c == 11), 0)
            title = _plain(parts.get(0, [])) or "unnamed protein product"
            found.append({"ids": [identifier(c, v) for c, v in chosen if c != 11], "gi": gi, "title": title, "taxid": _plain(parts.get(2, []), 0), "memberships": _last(parts.get(3, [])), "links": _last(parts.get(4, []))})
    return found


def text(line: dict, show_gis: bool = False, show_taxid: bool = False) -> str:
    """One def-line as text: identifiers, optional extras, a blank, the title."""
    ids = ([f"gi|{line['gi']}"] if show_gis and line["gi"] else []) + list(line["ids"])
    extras = [f"{label}|{line[key]}" for label, key in (("taxid", "taxid"), ("link", "links"), ("memb", "memberships")) if show_taxid and line[key]]
    head = "|".join(ids + extras)
    return f"{head} {line['title']}" if head and line["title"] else head + line["title"]
