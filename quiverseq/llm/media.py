"""Interleaved document sequences: HTML becomes an ordered list of text and media references, resolved by digest.

Media are stored by digest, once per task, as 8-bit grey PNG images of 576 samples a row, in a table of the shared folder. HTML
is parsed into one struct per piece, in document order: position, kind (text or media), text, digest, caption. What is
known of a payload is computed once per digest from the bytes read back from the store, and joined to the references
by digest; positions and captions stay with their references. Copies thus cost one stored payload, and a digest that
a third of all documents refer to joins small rows, which Spark may split.

Null text is empty; an empty payload is 576 bytes of 255. A reference to an unknown digest keeps its place with null
features. Null HTML gives an empty sequence. Repeated rows come back once each, empty tables give empty results, and
other columns than those named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

WIDTH = 576
PIECES = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Fixed value of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """The bytes followed by 255 up to a positive multiple of 576; UTF-8 text never holds a byte 255."""
    return data + b"\xff" * (WIDTH * max(1, -(-len(data) // WIDTH)) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image whose samples, row by row, are the payload; its length must be a multiple of 576."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image as to_png() writes them; checks the checksums."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, height = 8, [], 0
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", data)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an 8-bit grey image of 576 samples a row")
        elif kind == b"IDAT":
            packed.append(data)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered PNG lines are not read")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """64-bit median hash of 8 x 8 equal stretches over the samples, and the 16-bin histogram in 255ths, as hexadecimal digits."""
    samples = np.frombuffer(payload, np.uint8)
    cells = samples[: len(samples) // 64 * 64].reshape(64, -1).mean(axis=1)
    bits = np.packbits(cells > np.median(cells)).tobytes().hex()
    bins = np.bincount(samples >> 4, minlength=16)
    return f"{bits}-{(bins * 255 // len(samples)).astype(np.uint8).tobytes().hex()}"


class _Pieces(HTMLParser):
    """Collects text runs and media references in order; a figure's caption belongs to its last reference."""

    BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 article section figure table tr nav header footer".split())
    HIDDEN = frozenset(("script", "style", "title"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[dict] = []
        self.run: list[str] = []
        self.caption: list[str] | None = None
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, **values) -> None:
        self.pieces.append({"position": len(self.pieces), "kind": kind, "text": None, "digest": None, "caption": None} | values)

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in ("img", "video", "audio", "source"):
            values = dict(attrs)
            digest = values.get("data-digest") or (values.get("src") or "").removeprefix("digest:")
            self.flush()
            self.add("media", digest=digest or None, caption=values.get("alt") or None)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            media = next((p for p in reversed(self.pieces) if p["kind"] == "media"), None)
            if media is None and text:
                self.add("text", text=text)
            elif media is not None and text:
                media["caption"] = text
            self.caption = None
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    parser = _Pieces()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.pieces


def sequences(pages: DataFrame, html: str = "html", out: str = "pieces") -> DataFrame:
    """Adds the ordered pieces of each row's HTML."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(PIECES)
    def pieces(column):
        return column.map(parse)

    return pages.withColumn(out, pieces(html))


def store(media: DataFrame) -> DataFrame:
    """(digest, media) of rows (digest, data): payloads padded and encoded, in a table that is read back.

    A task stores a payload once however often it meets it, and no payload is shuffled; another task may store it
    again, under the same digest with the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            digests, images = [], []
            for digest, data in zip(batch.column("digest").to_pylist(), batch.column("data")):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    images.append(to_png(padded(data.as_py() or b"")))
            if len(seen) > 1 << 18:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], ["digest", "media"])

    return written(media.select("digest", "data").mapInArrow(run, "digest string, media binary"), "media")


def described(media: DataFrame) -> DataFrame:
    """What the stored bytes say, once per digest: FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column("digest").to_pylist(), batch.column("media")):
                image = image.as_py()
                payload = from_png(image)
                data = payload.rstrip(b"\xff")
                rows.append((digest, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            names = [f.split()[0] for f in FEATURES.split(", ")]
            kinds = [pa.int64() if f.endswith("long") else pa.string() for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return media.mapInArrow(run, FEATURES).dropDuplicates(["digest"])


def resolved(pages: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """One row per media reference: key, position, caption, digest and the payload's features (null if unknown)."""
    refs = pages.select(key, F.explode("pieces").alias("p")).where("p.kind = 'media'").select(key, "p.position", "p.caption", "p.digest")
    return refs.join(features, "digest", "left")


def interleaved(pages: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """key and sequence: every row's pieces in order, each media reference with its payload's features (null if unknown).

    Text stays where it is; only references travel to the features, by digest, and back, as one map for each key.
    """
    held = F.struct("n_bytes", "payload_sha256", "feature").alias("payload")
    known = resolved(pages, features, key).where("feature is not null").select(key, "digest", held).distinct()
    found = known.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("digest", "payload"))).alias("_found"))
    joined = pages.select(F.col(key).alias("_key"), "pieces").join(found, F.col("_key").eqNullSafe(F.col(key)), "left")
    whole = F.transform("pieces", lambda p: F.struct(p["position"].alias("position"), p["kind"].alias("kind"), p["text"].alias("text"), p["digest"].alias("digest"), p["caption"].alias("caption"), F.try_element_at("_found", p["digest"]).alias("payload")))
    return joined.select(F.col("_key").alias(key), whole.alias("sequence"))


def page_sequences(spark, sf_dir: str) -> DataFrame:
    """Every page's HTML as an ordered sequence: page_id, n_pieces, n_media, n_resolved, text_sha256 of its text pieces.

    The pages refer to no media, so each gets, before its closing article or at its end, a figure of the document whose
    number is the page's, which is stored and resolved by digest.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").select("page_id", "html")
    data = text_or_empty().cast("binary")
    shown = docs.select(F.col("doc_id").alias("page_id"), F.sha2(data, 256).alias("digest"), data.alias("data")).join(pages.select("page_id").distinct(), "page_id", "left_semi")
    features = written(described(store(shown)), "media-features")
    named = shown.groupBy("page_id").agg(F.min("digest").alias("digest"))
    figure = F.concat(F.lit('<figure><img src="digest:'), F.coalesce("digest", F.lit("none")), F.lit('"><figcaption>page '), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit("</figcaption></figure>"))
    cut = F.locate("</article>", F.coalesce("html", F.lit("")))
    given = F.coalesce("html", F.lit(""))
    place = F.when(cut > 0, cut - 1).otherwise(F.length(given))
    html = F.concat(F.substring(given, F.lit(1), place), figure, F.substring(given, place + 1, F.length(given)))
    whole = interleaved(sequences(pages.join(named, "page_id", "left").select("page_id", html.alias("html"))), features, "page_id")
    kind = lambda name: F.filter("sequence", lambda p: p["kind"] == name)
    text = F.array_join(F.transform(kind("text"), lambda p: p["text"]), "\n")
    return whole.select("page_id", F.size("sequence").alias("n_pieces"), F.size(kind("media")).alias("n_media"), F.size(F.filter("sequence", lambda p: p["payload"].isNotNull())).alias("n_resolved"), F.sha2(text, 256).alias("text_sha256"))


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes as a stored image, referred to by digest from an HTML page, parsed and resolved."""
    docs = table(spark, sf_dir, "documents")
    data = text_or_empty().cast("binary")
    hashed = docs.select("doc_id", F.sha2(data, 256).alias("digest"), data.alias("data"))
    features = written(described(store(hashed)), "media-features")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    html = F.concat(F.lit("<article><h1>Document "), name, F.lit('</h1><figure><img src="digest:'), F.col("digest"), F.lit('"><figcaption>Text of document '), name, F.lit("</figcaption></figure></article>"))
    pages = sequences(hashed.select("doc_id", html.alias("html")))
    return resolved(pages, features, "doc_id").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
