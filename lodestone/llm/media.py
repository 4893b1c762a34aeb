"""Media columns: documents as interleaved sequences of text and media.

HTML is parsed into an ordered array of segments, each text or a reference to a medium by the digest of its
stored form, with its caption. Payloads lie in a store, a table with the bytes of each digest; they are kept
losslessly as 8-bit grey samples, 64 to a row (binary PGM). Joining references with the store, or with the
catalogue of what is known of its media, resolves them by digest; positions and captions come from the
sequence, so they stay aligned whatever order the join works in.

``op5_media`` makes each text a medium, writes the store, and describes the media from the bytes that it reads
back. Each document is then a page of its own paragraphs with the medium among them; the page is parsed, and
its reference resolved by digest. The join takes the catalogue, not the bytes: those are read once, in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, crc, encoded, materialise, table, texts_of

WIDTH = 64
SEGMENT = "position int, kind string, text string, ref string, caption string"
BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "blockquote", "pre", "header", "footer", "nav", "figure", "body", "title"}
MEDIA = {"img", "video", "audio", "source", "embed"}
HIDDEN = {"script", "style", "template", "noscript"}


def payload_of(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the row width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def store(payload: bytes) -> bytes:
    """The stored form: a PGM image of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def load(medium: bytes) -> np.ndarray:
    """The samples of a stored form, one row per WIDTH of them."""
    magic, shape, _, samples = medium.split(b"\n", 3)
    if magic != b"P5":
        raise ValueError("not a binary grey image")
    width, height = map(int, shape.split())
    return np.frombuffer(samples, np.uint8).reshape(height, width)


def features(samples: np.ndarray) -> str:
    """Mean, deviation, horizontal and vertical change, and the shares of eight brightness bands."""
    n = samples.size
    bands = np.bincount(samples.ravel() >> 5, minlength=8)[:8]
    counts = np.bincount(samples.ravel(), minlength=256).astype(np.int64)
    levels = np.arange(256, dtype=np.int64)
    total, squares = int(counts @ levels), int(counts @ (levels * levels))
    wide = samples.astype(np.int16)
    across, down = int(np.abs(np.diff(wide, axis=1)).sum()), int(np.abs(np.diff(wide, axis=0)).sum())
    variance = max(0, squares * n - total * total) / (n * n)
    return f"mean={total / n:.4f};dev={variance**0.5:.4f};across={across / n:.4f};down={down / n:.4f};bands=" + ",".join(f"{x / n:.4f}" for x in bands)


class Sequence(HTMLParser):
    """Ordered segments of an HTML text. A figure's caption belongs to the media in it.

    A caption that is never closed ends with its figure. If that is never closed either, the caption is the
    text up to the next block, and what follows is text of the page. A caption outside a figure is text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.parts: list[str] | None = None  # blocks of an open caption
        self.hidden, self.figure = 0, None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text and self.parts is not None:
            self.parts.append(text)
        elif text:
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self, whole: bool):
        self.flush()
        parts, self.parts = self.parts, None
        if parts:
            for x in self.out[self.figure :]:
                if x["kind"] == "media":
                    x["caption"] = " ".join(parts if whole else parts[:1])
            for text in [] if whole else parts[1:]:
                self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_figure(self, whole: bool):
        self.flush()
        if self.parts is not None:
            self.end_caption(whole)
        self.figure = None

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA:
            source, given = dict(attrs).get("src"), dict(attrs)
            if source and not self.hidden:
                self.flush()
                self.out.append({"kind": "media", "text": None, "ref": source, "caption": given.get("alt")})
        elif tag == "figcaption":
            self.flush()
            if self.parts is not None:
                self.end_caption(False)
            self.parts = [] if self.figure is not None else None
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_figure(False)
                self.figure = len(self.out)

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.flush()
            if self.parts is not None:
                self.end_caption(True)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_figure(True)

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def parse(html: str) -> list[dict]:
    """The segments of a page. Markup that the parser gives up on ends the page there."""
    reader = Sequence()
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:  # a broken marked section
        pass
    reader.end_figure(False)
    return [{"position": i, **x} for i, x in enumerate(reader.out)]


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, segments): the ordered segments of each page. A null or empty page has none."""
    kind = dict(pages.dtypes)[key]
    segment = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([parse(x) for x in texts_of(batch, html)], segment)], [key, "segments"])

    return arrow_map(pages.select(key, html), run, f"{key} {kind}, segments array<struct<position:int,kind:string,text:string,ref:string,caption:string>>")


def references(sequence: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, position, ref, caption, n_segments) of the media segments."""
    return sequence.select(key, F.size("segments").alias("n_segments"), F.explode("segments").alias("s")).where("s.kind = 'media'").select(key, "s.position", "s.ref", "s.caption", "n_segments")


def resolve(refs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """References with the columns of a catalogue or store (null where a digest is unknown).

    ``catalogue`` has one row per ``digest``. Both sides are plain scans or exchanges, so that AQE can split
    a digest that many references share.
    """
    return refs.join(catalogue, refs["ref"] == catalogue["digest"], "left")


def interleaved(pages: DataFrame, store: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, segments): sequences whose media segments also hold their bytes, ``medium``, from the store.

    Pages are told apart by ``key``, which must be theirs alone; a page without segments has no row. Bytes of
    unknown digests are null.
    """
    found = sequences(pages, key, html).select(key, F.explode("segments").alias("s")).select(key, "s.*")
    whole = found.join(store, found["ref"] == store["digest"], "left").drop("digest")
    ordered = F.sort_array(F.collect_list(F.struct("position", "kind", "text", "ref", "caption", "medium")))
    return whole.groupBy(key).agg(ordered.alias("segments"))


def digest_of(medium: bytes) -> str:
    return f"sha256:{hashlib.sha256(medium).hexdigest()}"


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, medium): each text in its stored form, once for each task that meets it.

    A null text is empty; an empty text has one row of zero samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        for batch in batches:
            rows = {}
            for data in encoded(batch, text):
                medium = store(payload_of(data))
                digest = digest_of(medium)
                if digest not in met:
                    met.add(digest)
                    rows[digest] = medium
            yield pa.RecordBatch.from_arrays([pa.array([*rows], pa.string()), pa.array([*rows.values()], pa.binary())], ["digest", "medium"])

    return arrow_map(docs.select(text), run, "digest string, medium binary")


VALUES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def described(store_: DataFrame) -> DataFrame:
    """The catalogue of a store: one row a digest, computed from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for medium in batch.column("medium").to_pylist():
                samples = load(medium)
                back = samples.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), crc(back[-WIDTH:]), len(medium), hashlib.sha256(medium).hexdigest(), features(samples)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(x, t) for x, t in zip([*zip(*rows)] or [[]] * 6, kinds))], ["digest", *VALUES])

    # Equal digests have equal rows, so any of them serves; partial aggregation leaves one per task.
    return arrow_map(store_, run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").distinct()


def pages_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, html): each text's lines as paragraphs, and after the first its medium, by digest, its size as caption."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = []
            for data in encoded(batch, text):
                first, *rest = escape(data.decode(), False).split("\n")
                figure = f'<figure><img src="{digest_of(store(payload_of(data)))}"><figcaption>{len(data)} bytes</figcaption></figure>'
                pages.append(f"<p>{first}</p>{figure}" + "".join(f"<p>{x}</p>" for x in rest))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(pages, pa.string())], [key, "html"])

    return arrow_map(docs.select(key, text), run, f"{key} {kind}, html string")


def media_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's medium, resolved from its page: key, n_bytes, the catalogue's values, position, caption, n_segments.

    A null text is empty. A null key stays null, and repeated rows each give a row. An empty table gives none.
    Other columns are not read.
    """
    catalogue = materialise(described(materialise(stored(docs, text), "media")), "catalogue")
    refs = references(sequences(pages_of(docs, key, text), key), key)
    found = resolve(refs, catalogue).withColumn("n_bytes", F.regexp_extract("caption", "^([0-9]+) bytes$", 1).cast("long"))
    return found.select(key, "n_bytes", *VALUES, "position", "caption", "n_segments")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as a medium of its page."""
    return media_of(table(spark, sf_dir, "documents"))


QUERIES = {"op5_media": op5_media}
SQL: dict[str, str] = {}
