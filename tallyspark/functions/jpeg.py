"""JPEG, EXIF, multi-picture and HEIF headers, parsed from bytes in vectorised functions.

Parsers never raise on hostile input: what can't be read is null, and every offset is checked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import zigzag

#: Comment that marks files this engine has written.
MARKER = b"tallyspark"
# Names that gain maps and motion photos go by.
GAIN_MAPS = [b"hdrgm", b"HDRGainMap", b"aux:hdrgainmap"]
MOTION = [b"MotionPhoto", b"MicroVideo"]
_ALONE = {0x01, *range(0xD0, 0xD9)}
_FRAMES = {0xC0: "baseline", 0xC1: "extended", 0xC2: "progressive"}
_SOF = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def is_jpeg(content):
    """Column test of the magic bytes."""
    return (F.substring(content, 1, 3) == F.lit(b"\xff\xd8\xff")) & (F.octet_length(content) > 3)


def segments(data: bytes) -> list[tuple[int, bytes]]:
    """(marker, body) up to the first scan; stops at anything malformed."""
    return walk(data)[0]


def walk(data: bytes) -> tuple[list[tuple[int, bytes]], int | None]:
    """Segments up to the first scan, and where that scan's marker is; None if something malformed comes before it."""
    out, at = [], 2
    if data[:2] != b"\xff\xd8":
        return out, None
    while at + 1 < len(data):
        if data[at] != 0xFF:
            break
        while at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 1 >= len(data):
            break
        marker, at = data[at + 1], at + 2
        if marker in _ALONE:
            continue
        if marker == 0xD9 or at + 2 > len(data):
            break
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            break
        out.append((marker, data[at + 2 : at + size]))
        if marker == 0xDA:
            return out, at - 2
        at += size
    return out, None


def inspect(data: bytes) -> dict | None:
    """Frame, first luma table and markers of a JPEG; None without a frame."""
    out: dict = {"kind": None, "width": None, "height": None, "bits": None, "components": None, "table": None, "adobe_transform": None, "orientation": 1, "has_marker": False, "gain_map": False}
    for marker, body in segments(data):
        if marker in _SOF and out["kind"] is None and len(body) >= 6:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            out |= {"kind": _FRAMES.get(marker, "exotic"), "width": width, "height": height, "bits": bits, "components": n}
        elif marker == 0xDB and out["table"] is None:
            out["table"] = _luma_table(body)
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12 and out["adobe_transform"] is None:
            out["adobe_transform"] = body[11]
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            out["orientation"] = orientation(body[6:])
        elif marker == 0xFE and body.startswith(MARKER):
            out["has_marker"] = True
    out["gain_map"] = has_gain_map(data)
    return out if out["kind"] else None


def has_gain_map(data: bytes) -> bool:
    """A second image with the light that a wide range needs, by any of the names it goes by, anywhere in the file."""
    return any(name in data for name in GAIN_MAPS)


def _luma_table(body: bytes) -> list[int] | None:
    at = 0
    while at < len(body):
        wide, slot = body[at] >> 4, body[at] & 15
        size = 128 if wide else 64
        if wide > 1 or at + 1 + size > len(body):
            return None
        if slot == 0:
            values = struct.unpack_from(">64H" if wide else ">64B", body, at + 1)
            table = [0] * 64
            for place, value in zip(zigzag(), values):
                table[place] = value
            return table
        at += 1 + size
    return None


def primary_end(data: bytes) -> int | None:
    """Where the first image ends: behind the first end marker after its scan; thumbnails inside header segments don't count."""
    scan = walk(data)[1]
    end = data.find(b"\xff\xd9", scan) if scan is not None else -1
    return end + 2 if end >= 0 else None


def has_embedded_media(data: bytes) -> bool:
    """A motion-photo packet, or a video container anywhere behind the image."""
    if any(name in data for name in MOTION):
        return True
    end = primary_end(data)
    return end is not None and data.find(b"ftyp", end) >= 0


def _ifd(tiff: bytes, at: int, order: str) -> list[tuple[int, int, int, int]]:
    """(tag, type, count, place of the value field) of a directory."""
    if at < 8 or at + 2 > len(tiff):
        return []
    n = struct.unpack_from(order + "H", tiff, at)[0]
    return [(*struct.unpack_from(order + "HHI", tiff, p), p + 8) for p in range(at + 2, min(at + 2 + 12 * n, len(tiff) - 11), 12)]


def _tiff(tiff: bytes) -> tuple[str, int] | None:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8 or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
        return None
    return order, struct.unpack_from(order + "I", tiff, 4)[0]


def orientation(tiff: bytes) -> int:
    """EXIF orientation, 1 if there is none that can be read."""
    if not (head := _tiff(tiff)):
        return 1
    for tag, kind, _, place in _ifd(tiff, head[1], head[0]):
        if tag == 0x0112 and kind == 3:
            value = struct.unpack_from(head[0] + "H", tiff, place)[0]
            return value if 1 <= value <= 8 else 1
    return 1


def set_orientation(tiff: bytes, value: int) -> bytes | None:
    """The block with its orientation patched in place; None if it has none."""
    if not (head := _tiff(tiff)):
        return None
    for tag, kind, _, place in _ifd(tiff, head[1], head[0]):
        if tag == 0x0112 and kind == 3:
            return tiff[:place] + struct.pack(head[0] + "H", value) + tiff[place + 2 :]
    return None


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def strip_gps(tiff: bytes) -> bytes:
    """The block, as long as before, with the GPS directory and its values zeroed and its pointer dropped."""
    if not (head := _tiff(tiff)):
        return tiff
    order, first = head
    out, entries = bytearray(tiff), _ifd(tiff, first, order)
    for number, (tag, _, _, place) in enumerate(entries):
        if tag != 0x8825:
            continue
        at = struct.unpack_from(order + "I", tiff, place)[0]
        inner = _ifd(tiff, at, order)
        for _, kind, count, value in inner:
            size = _SIZES.get(kind, 0) * count
            if size > 4:
                where = struct.unpack_from(order + "I", tiff, value)[0]
                if where + size <= len(out):
                    out[where : where + size] = bytes(size)
        if inner:
            out[at : at + 2 + 12 * len(inner)] = bytes(2 + 12 * len(inner))
        start = first + 2
        rest = bytes(out[start + 12 * (number + 1) : start + 12 * len(entries)])
        out[start + 12 * number : start + 12 * number + len(rest)] = rest
        out[start + 12 * (len(entries) - 1) : start + 12 * len(entries)] = bytes(12)
        struct.pack_into(order + "H", out, first, len(entries) - 1)
        break
    return bytes(out)


def secondary_images(data: bytes) -> list[tuple[int, int]] | None:
    """(start, size) of the further images that a multi-picture index lists; None without a readable index."""
    at = 2
    for marker, body in segments(data):
        start = data.find(body, at) if body else at
        at = start + len(body)
        if marker != 0xE2 or body[:4] != b"MPF\0" or not (head := _tiff(body[4:])):
            continue
        tiff, base = body[4:], start + 4
        for tag, _, count, place in _ifd(tiff, head[1], head[0]):
            if tag == 0xB002:
                where = struct.unpack_from(head[0] + "I", tiff, place)[0]
                if where + count > len(tiff) or count % 16:
                    return None
                images = [struct.unpack_from(head[0] + "IIIHH", tiff, where + 16 * i)[1:3] for i in range(count // 16)]
                found = [(base + offset, size) for size, offset in images[1:]]
                return found if all(a + n <= len(data) for a, n in found) else None
    return None


_HEIF_BRANDS = {b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1"}


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first, last + 1 of the body) of ISO boxes; stops at anything malformed."""
    while start + 8 <= end:
        size, kind, head = int.from_bytes(data[start : start + 4], "big"), data[start + 4 : start + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def inspect_heif(data: bytes) -> dict | None:
    """Brands, primary item, items by type and flags of a HEIF file, without decoding pixels; None if it is none."""
    top = list(boxes(data, 0, len(data)))
    if not top or top[0][0] != b"ftyp":
        return None
    brands = data[top[0][1] : top[0][2]]
    names = {brands[i : i + 4] for i in range(0, len(brands) - 3, 4) if i != 4}
    if not names & _HEIF_BRANDS:
        return None
    out = {"primary": None, "items": {}, "sequence": bool(names & {b"hevc", b"hevx", b"msf1"}) and not names & {b"heic", b"heix", b"mif1"}, "stereo": False, "hdr": False, "references": [], "properties": [], "associations": {}}
    for kind, a, b in top:
        if kind == b"meta":
            for inner, x, y in boxes(data, a + 4, b):
                _heif_meta(data, inner, x, y, out)
    out["hdr"] = _is_hdr(out)
    return out


def _heif_meta(data: bytes, kind: bytes, a: int, b: int, out: dict) -> None:
    version = data[a] if a < b else 0
    if kind == b"pitm" and a + 6 <= b:
        out["primary"] = int.from_bytes(data[a + 4 : a + (8 if version else 6)], "big")
    elif kind == b"iinf":
        for inner, x, y in boxes(data, a + (8 if version else 6), b):
            if inner == b"infe" and y - x >= 12 and data[x] >= 2:
                wide = 4 if data[x] >= 3 else 2
                out["items"][int.from_bytes(data[x + 4 : x + 4 + wide], "big")] = data[x + 6 + wide : x + 10 + wide].decode("latin-1")
    elif kind == b"iref":
        wide = 4 if version else 2
        for inner, x, y in boxes(data, a + 4, b):
            start, n = int.from_bytes(data[x : x + wide], "big"), int.from_bytes(data[x + wide : x + wide + 2], "big")
            to = [int.from_bytes(data[p : p + wide], "big") for p in range(x + wide + 2, min(x + wide + 2 + n * wide, y - wide + 1), wide)]
            out["references"].append((inner.decode("latin-1"), start, to))
    elif kind == b"grpl":
        out["stereo"] = out["stereo"] or any(inner == b"ster" for inner, _, _ in boxes(data, a, b))
    elif kind == b"iprp":
        for inner, x, y in boxes(data, a, b):
            if inner == b"ipco":
                out["properties"] = [(name.decode("latin-1"), data[first:end]) for name, first, end in boxes(data, x, y)]
            elif inner == b"ipma":
                out["associations"].update(_associations(data[x:y]))


def _associations(body: bytes) -> dict[int, list[int]]:
    """item -> places (from 1 on) of its properties, of an association box's body."""
    if len(body) < 8:
        return {}
    wide, long, at, out = (4 if body[0] else 2), bool(body[3] & 1), 8, {}
    for _ in range(int.from_bytes(body[4:8], "big")):
        if at + wide + 1 > len(body):
            break
        item, n = int.from_bytes(body[at : at + wide], "big"), body[at + wide]
        at += wide + 1
        size = 2 if long else 1
        places = [int.from_bytes(body[p : p + size], "big") & (0x7FFF if long else 0x7F) for p in range(at, min(at + n * size, len(body) - size + 1), size)]
        out.setdefault(item, []).extend(p for p in places if p)
        at += n * size
    return out


def properties_of(found: dict, item: int | None) -> list[tuple[str, bytes]]:
    """The properties that are associated with an item; places that don't exist are left out."""
    places = found["associations"].get(item, [])
    return [found["properties"][p - 1] for p in places if p <= len(found["properties"])]


def _is_hdr(found: dict) -> bool:
    """A transfer function of wide range (PQ or HLG) on the primary item; without associations on any property."""
    for name, body in properties_of(found, found["primary"]) if found["associations"] else found["properties"]:
        if name == "colr" and body[:4] == b"nclx" and len(body) >= 8 and int.from_bytes(body[6:8], "big") in (16, 18):
            return True
    return False


HEADER = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("bits", T.LongType()),
        T.StructField("components", T.LongType()), T.StructField("table", T.ArrayType(T.IntegerType())), T.StructField("adobe_transform", T.IntegerType()),
        T.StructField("orientation", T.LongType()), T.StructField("has_marker", T.BooleanType()), T.StructField("gain_map", T.BooleanType()), T.StructField("embedded", T.BooleanType()), T.StructField("indexed", T.BooleanType()),
    ]
)


def with_headers(photos: DataFrame, content: str = "content") -> DataFrame:
    """photos with the fields of their JPEG headers in place of the bytes; all null where there is no frame."""
    others = [f for f in photos.schema.fields if f.name != content]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch[content]:
                data = bytes(raw) if raw is not None else b""
                found = inspect(data)
                rows.append({**found, "embedded": has_embedded_media(data), "indexed": bool(secondary_images(data))} if found else dict.fromkeys(f.name for f in HEADER))
            made = pd.DataFrame(rows, columns=HEADER.names, index=batch.index, dtype=object)
            yield pd.concat([batch.drop(columns=[content]), made], axis=1)

    return photos.mapInPandas(read, T.StructType([*others, *HEADER.fields]))


def segment(marker: int, body: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body


def synthetic_jpeg(kind: str, width: int, height: int, bits: int, components: int, table: list[int], turn: int, marked: bool, embedded: int, gain_map: int, thumbnail: bool) -> bytes:
    """A file that is all header: what ``inspect`` needs and an empty scan.

    embedded: 0 none, 1 a motion-photo packet, 2 a video behind the image; gain_map: 0 none, else which of the names it has.
    """
    tiff = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, turn, 0) + b"\0\0\0\0"
    small = b"\xff\xd8" + segment(0xDA, b"\0" * 6) + b"\x33\xff\xd9" if thumbnail else b""
    frame = struct.pack(">BHHB", bits, height, width, components) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(components))
    sof = {"baseline": 0xC0, "progressive": 0xC2, "exotic": 0xC3}[kind]
    xmp = segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x MotionPhoto='1'/>") if embedded == 1 else b""
    light = segment(0xE2, b"urn:" + GAIN_MAPS[gain_map - 1]) if gain_map else b""
    parts = [segment(0xE1, b"Exif\0\0" + tiff + small), xmp, light, segment(0xFE, MARKER) if marked else b"", segment(0xDB, b"\0" + bytes(table[p] for p in zigzag())), segment(sof, frame), segment(0xDA, b"\0" * 6)]
    video = bytes(100) + b"\0\0\0\x18ftypmp42" if embedded == 2 else b""
    return b"\xff\xd8" + b"".join(parts) + b"\x11\x22\xff\xd9" + video


def synthesize(photos: DataFrame) -> DataFrame:
    """(id, content) of photos with kind, width, height, bits, components, table, orientation, has_marker, embedded, gain_map."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["id"], b["kind"], b["width"], b["height"], b["bits"], b["components"], b["table"], b["orientation"], b["has_marker"], b["embedded"], b["gain_map"])
            yield pd.DataFrame(
                {
                    "id": b["id"],
                    "content": [
                        synthetic_jpeg(k, int(w), int(h), int(d), int(c), [int(x) for x in t], int(o), bool(m), (1 + i % 2) * bool(e), (1 + i // 4 % 3) * bool(g), i % 5 == 0)
                        for i, k, w, h, d, c, t, o, m, e, g in rows
                    ],
                }
            )

    return photos.select("id", "kind", "width", "height", "bits", "components", "table", "orientation", "has_marker", "embedded", "gain_map").mapInPandas(make, "id long, content binary")
