"""Media columns: types told by magic bytes and structure, embedded media carved, payloads stored as images."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import filled

#: Samples in a row of a stored image; payloads are padded to a positive multiple of it.
WIDTH = 64
UNKNOWN = "application/octet-stream"


class Media(bytes):
    """Bytes that look each mark up once, so that a search for it from many places takes no more than one pass."""

    def next(self, mark: bytes, i: int) -> int:
        """Place of the first ``mark`` from ``i`` on, -1 without one."""
        marks = self.__dict__
        if mark not in marks:
            marks[mark] = np.array([m.start() for m in re.finditer(re.escape(mark), self)], dtype=np.int64)
        known = marks[mark]
        at = int(np.searchsorted(known, i))
        return int(known[at]) if at < len(known) else -1


# Each validator returns the length of the medium that starts at ``i``, or 0 if structure or lengths don't hold.
def png_length(b: bytes, i: int) -> int:
    at, first = i + 8, True
    while at + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        end = at + 12 + size
        if end > len(b) or first and (kind != b"IHDR" or size != 13) or zlib.crc32(b[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        at, first = end, False
        if kind == b"IEND":
            return end - i
    return 0


def gif_length(b: bytes, i: int) -> int:
    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += 1 + b[at]
        return at + 1

    if i + 13 > len(b):
        return 0
    at = i + 13 + (3 << (b[i + 10] & 7) + 1 if b[i + 10] & 0x80 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - i
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = blocks(at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def jpeg_length(b: bytes, i: int) -> int:
    at = i + 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark = b[at + 1]
        if mark == 0xD9:
            return at + 2 - i
        size = struct.unpack_from(">H", b, at + 2)[0]
        if size < 2 or not 0xC0 <= mark <= 0xFE:
            return 0
        at += 2 + size
        if mark == 0xDA:  # entropy-coded data lasts until a marker other than a restart
            while (at := b.find(b"\xff", at)) >= 0 and at + 1 < len(b) and (b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7):
                at += 2
            if at < 0 or at + 1 >= len(b):
                return 0
            if b[at + 1] == 0xD9:
                return at + 2 - i
    return 0


def bmp_length(b: bytes, i: int) -> int:
    if i + 54 > len(b):
        return 0
    size, zero, data, head = struct.unpack_from("<IIII", b, i + 2)
    planes, bits = struct.unpack_from("<HH", b, i + 26)
    ok = zero == 0 and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 54 <= data <= size and i + size <= len(b)
    return size if ok else 0


def riff_length(b: bytes, i: int) -> int:
    if i + 12 > len(b) or b[i + 8 : i + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    end, at = i + 8 + struct.unpack_from("<I", b, i + 4)[0], i + 12
    if end > len(b):
        return 0
    while at + 8 <= end:
        at += 8 + struct.unpack_from("<I", b, at + 4)[0]
        at += at - i & 1
    return end - i if at in (end, end + 1) else 0


def gzip_length(b: bytes, i: int) -> int:
    if i + 18 > len(b) or b[i + 3] & 0xE0:
        return 0
    unpack = zlib.decompressobj(31)
    try:
        at = i
        while at < len(b) and not unpack.eof:  # what is unpacked isn't kept
            rest = unpack.unconsumed_tail or b[at : at + 65536]
            at += 0 if unpack.unconsumed_tail else len(rest)
            unpack.decompress(rest, 1 << 20)
    except zlib.error:
        return 0
    return at - i - len(unpack.unused_data) if unpack.eof else 0


def pdf_length(b: Media, i: int) -> int:
    end = b.next(b"%%EOF", i)
    return end + 5 - i if end >= 0 and 0 <= b.next(b"startxref", i) <= end - 9 and 0 <= b.next(b" obj", i) <= end - 4 else 0


def zip_length(b: Media, i: int) -> int:
    end = b.next(b"PK\x05\x06", i)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    ok = i + start + size == end and (size == 0 or b[i + start : i + start + 4] == b"PK\x01\x02") and end + 22 + note <= len(b)
    return end + 22 + note - i if ok else 0


def flac_length(b: bytes, i: int) -> int:
    """Metadata blocks up to the last; frames have no length, so the medium runs to the end."""
    at = i + 4
    while at + 4 <= len(b):
        head = struct.unpack_from(">I", b, at)[0]
        if at == i + 4 and head & 0x7FFFFFFF != 34:
            return 0
        at += 4 + (head & 0xFFFFFF)
        if head >> 31:
            return len(b) - i if at <= len(b) else 0
    return 0


#: Magic bytes, type and validator.
MAGIC: dict[bytes, tuple[str, Callable[[Media, int], int]]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", png_length),
    b"GIF87a": ("image/gif", gif_length),
    b"GIF89a": ("image/gif", gif_length),
    b"\xff\xd8\xff": ("image/jpeg", jpeg_length),
    b"BM": ("image/bmp", bmp_length),
    b"RIFF": ("audio/wav", riff_length),
    b"\x1f\x8b\x08": ("application/gzip", gzip_length),
    b"%PDF-": ("application/pdf", pdf_length),
    b"PK\x03\x04": ("application/zip", zip_length),
    b"fLaC": ("audio/flac", flac_length),
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in MAGIC:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def carve(b: bytes, magics: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Type, offset and length of every valid medium. Media inside another one's bytes are its own and are not listed."""
    b, out, end = Media(b), [], 0
    starts = sorted((last + 1 - len(magic), magic) for last, magic in magics.iter(b.decode("latin-1")))
    for at, magic in starts:
        kind, length = MAGIC[magic]
        if at >= end and (n := length(b, at)):
            out.append((RIFF_TYPES[b[at + 8 : at + 12]] if magic == b"RIFF" else kind, at, n))
            end = at + n
    return out


def sniff(b: bytes, declared: str | None, magics: ahocorasick.Automaton) -> tuple[str, bool, list[tuple[str, int, int]]]:
    """The type, whether it corrects the declared one, and media embedded after or before the main one.

    A medium that starts at byte 0 gives the type; without one the type is unknown, whatever was declared,
    unless the declared type has no signature here.
    """
    media = carve(b, magics)
    main = media[0] if media and media[0][1] == 0 else None
    signed = {kind for kind, _ in MAGIC.values()} | set(RIFF_TYPES.values())
    kind = main[0] if main else UNKNOWN if declared is None or declared in signed else declared
    return kind, kind != declared, media[1:] if main else media


def sniff_media(df: DataFrame, bytes_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """Add media_type, type_corrected and embedded (array of type, start, length); null bytes count as empty."""

    @F.pandas_udf("media_type string, type_corrected boolean, embedded array<struct<type:string,start:long,length:long>>")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        magics = automaton()
        for media, declared in batches:
            rows = [sniff(bytes(b or b""), d, magics) for b, d in zip(media, declared, strict=True)]
            yield pd.DataFrame({"media_type": [r[0] for r in rows], "type_corrected": [r[1] for r in rows], "embedded": [[{"type": k, "start": i, "length": n} for k, i, n in r[2]] for r in rows]})

    kept = [c for c in df.columns if c not in ("media_type", "type_corrected", "embedded")]
    return df.withColumn("__told", told(bytes_col, declared_col)).select(*kept, "__told.*")


def padded(b: bytes) -> bytes:
    return b + b"\0" * (WIDTH - len(b) % WIDTH if len(b) % WIDTH or not b else 0)


def store(payload: bytes) -> bytes:
    """The payload as a PNG of 8-bit grey samples, WIDTH in a row."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def read_back(media: bytes) -> bytes:
    """The samples of a PNG that ``store`` made."""
    at, packed, width = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        if kind == b"IHDR":
            width = struct.unpack_from(">I", media, at + 8)[0]
        elif kind == b"IDAT":
            packed.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the whole text's UTF-8 bytes, padded, as a PNG), declared (unknown: nothing has told it yet)."""

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([store(padded(t.encode())) for t in texts], dtype=object)

    text = filled(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), stored(text).alias("media"), F.lit(UNKNOWN).alias("declared"))


def media_features(media: DataFrame) -> DataFrame:
    """Read media back and describe them: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The feature has the told type, the image's height, mean and entropy of its samples, and the types of media carved
    from the samples themselves.
    """

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def described(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        magics = automaton()
        for media, kinds in batches:
            rows = []
            for b, kind in zip(media, kinds, strict=True):
                b = bytes(b)
                payload = read_back(b)
                n = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
                p = n[n > 0] / len(payload)
                inside = ",".join(k for k, _, _ in carve(payload, magics)) or "none"
                feature = f"{kind};{WIDTH}x{len(payload) // WIDTH};mean={int(n @ np.arange(256)) / len(payload):.4f};bits={float(-(p * np.log2(p)).sum()) + 0.0:.4f};inside={inside}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(b), hashlib.sha256(b).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.withColumn("__d", described("media", "media_type")).select("doc_id", "n_bytes", "__d.*")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null texts count as empty and store 64 zero samples. Equal texts give equal values. Ids may be null or repeat;
    other columns are not read. An empty table gives an empty result.
    """
    return media_features(sniff_media(store_media(docs, id_col, text_col)))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as images, told by their signature, read back and described."""
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
