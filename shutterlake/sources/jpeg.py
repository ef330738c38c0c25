"""What a JPEG file says about itself, read from its segments without decoding the image."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The EXIF tags that are read.
TAGS = {271: "Make", 272: "Model", 306: "DateTime", 33434: "ExposureTime", 33437: "FNumber", 34855: "ISOSpeedRatings", 36867: "DateTimeOriginal", 37378: "ApertureValue", 37383: "MeteringMode", 37385: "Flash", 37386: "FocalLength", 41989: "FocalLengthIn35mmFilm", 42036: "LensModel"}
#: The order in which a JPEG file lists the entries of an 8 x 8 table.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
SCHEMA = "hash string, width int, height int, luminance array<int>, exif map<string, string>"


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of the segments before the image itself; a broken file gives what comes before the break."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xDA or size < 2:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def luminance(body: bytes) -> list[int] | None:
    """The first quantisation table of a DQT segment, row by row."""
    at = 0
    while at < len(body):
        wide, number = body[at] >> 4, body[at] & 15
        size = 128 if wide else 64
        entries = body[at + 1 : at + 1 + size]
        if number == 0 and len(entries) == size:
            values = struct.unpack(f">64{'H' if wide else 'B'}", entries)
            out = [0] * 64
            for place, v in zip(ZIGZAG, values):
                out[place] = v
            return out
        at += 1 + size
    return None


def exif(body: bytes) -> dict[str, str]:
    """Known tags of an EXIF segment as texts; rationals as '[numerator, denominator]'."""
    if body[:6] != b"Exif\0\0" or body[6:8] not in (b"II", b"MM"):
        return {}
    t, e = body[6:], "<" if body[6:8] == b"II" else ">"
    out: dict[str, str] = {}
    todo, seen = [struct.unpack(e + "I", t[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(t):
            continue
        seen.add(at)
        for i in range(struct.unpack(e + "H", t[at : at + 2])[0]):
            entry = t[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, count = struct.unpack(e + "HHI", entry[:8])
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 0) * count
            raw = entry[8 : 8 + size] if size <= 4 else t[(o := struct.unpack(e + "I", entry[8:12])[0]) : o + size]
            if len(raw) < size or not size:
                continue
            if tag == 34665:  # where the camera's own tags are
                todo.append(struct.unpack(e + "I", entry[8:12])[0])
            elif tag in TAGS:
                if kind == 2:
                    out[TAGS[tag]] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
                elif kind in (5, 10):
                    out[TAGS[tag]] = "[%d, %d]" % struct.unpack(e + ("II" if kind == 5 else "ii"), raw[:8])
                elif kind in (3, 4, 9):
                    out[TAGS[tag]] = str(struct.unpack(e + {3: "H", 4: "I", 9: "i"}[kind], raw[: {3: 2, 4: 4, 9: 4}[kind]])[0])
    return out


def headers(files: DataFrame, key: str = "hash", content: str = "content") -> DataFrame:
    """(hash, width, height, luminance, exif) of JPEG files; what a file doesn't say, or is no JPEG, is null or empty."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, data in zip(b.iloc[:, 0], b.iloc[:, 1]):
                w = h = table = None
                tags: dict = {}
                for marker, body in segments(bytes(data or b"")):
                    if marker == 0xDB:
                        table = luminance(body) or table
                    elif marker == 0xE1:
                        tags |= exif(body)
                    elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
                        h, w = struct.unpack(">HH", body[1:5])
                rows.append((k, w, h, table, tags))
            yield pd.DataFrame(rows, columns=["hash", "width", "height", "luminance", "exif"]).astype({"width": "Int32", "height": "Int32"})

    return files.select(key, content).mapInPandas(read, SCHEMA)
