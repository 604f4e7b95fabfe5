"""Metadata segments of JPEG files: taken out, filtered, rewritten and put in front of other image data.

Byte functions for one file, and ``kept_segments`` for arrays of segments, which needs no Python.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jpeg import MARKER, _ifd, _tiff, segment, set_orientation, strip_gps, walk

# Markers and headers of published formats.
APP1, APP2, APP14, COMMENT = 0xE1, 0xE2, 0xEE, 0xFE
EXIF, XMP, EXTENDED_XMP, ICC, MULTI = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0", b"ICC_PROFILE\0", b"MPF\0"
BODY, ENTRY = 65_533, 16
ORIENTATION = 0x0112

Segments = list[tuple[int, bytes]]


def is_metadata(marker: int) -> bool:
    return 0xE0 <= marker <= 0xEF or marker == COMMENT


def split(data: bytes) -> tuple[Segments, bytes]:
    """(metadata segments in file order, the rest from the first other marker on); ValueError if there is no image data."""
    found, at = walk(data)[0], 2
    first = None
    for marker, body in found:
        while data[at + 1] == 0xFF or data[at + 1] == 0x01 or 0xD0 <= data[at + 1] <= 0xD8:
            at += 1 if data[at + 1] == 0xFF else 2
        if first is None and not is_metadata(marker):
            first = at
        at += 4 + len(body)
    if first is None:
        raise ValueError("no image data")
    return [s for s in found if is_metadata(s[0])], data[first:]


def splice(data: bytes, segments: Segments) -> bytes:
    """data with these metadata segments in place of its own."""
    return b"\xff\xd8" + b"".join(segment(m, b) for m, b in segments) + split(data)[1]


def icc_segments(profile: bytes) -> Segments:
    """The profile in numbered segments, 255 at most."""
    room = BODY - len(ICC) - 2
    parts = [profile[i : i + room] for i in range(0, len(profile), room)]
    total = min(len(parts), 255)
    return [(APP2, ICC + bytes([i + 1, total]) + part) for i, part in enumerate(parts[:255])]


def dropped(marker: int, body: bytes, strip_location: bool) -> bool:
    """Segments that don't go on: our own marker, an index of further images, the colour note of the old encoding, and with it the parts of XMP that may hold places."""
    return (
        (marker == COMMENT and body.startswith(MARKER)) or (marker == APP2 and body.startswith(MULTI)) or marker == APP14
        or (strip_location and marker == APP1 and body.startswith(EXTENDED_XMP))
    )


def kept_segments(segments: Column, strip_location: bool, marker_text: str) -> Column:
    """The same for an array of (marker, body) structs, our marker at the end."""
    starts = lambda s, head: F.startswith(s["body"], F.lit(head))
    gone = lambda s: (
        ((s["marker"] == COMMENT) & starts(s, MARKER)) | ((s["marker"] == APP2) & starts(s, MULTI)) | (s["marker"] == APP14)
        | (F.lit(strip_location) & (s["marker"] == APP1) & starts(s, EXTENDED_XMP))
    )
    own = F.struct(F.lit(COMMENT).alias("marker"), F.lit(MARKER + b" " + marker_text.encode()).alias("body"))
    return F.concat(F.filter(segments, lambda s: ~gone(s)), F.array(own))


def strip_places(xmp: bytes) -> bytes:
    """XMP without attributes and elements of GPS data."""
    import re

    name = rb"exif:GPS[A-Za-z]*"
    without = re.sub(rb"<(" + name + rb")\b[^>]*?/>|<(" + name + rb")\b[^>]*>.*?</\2>", b"", xmp, flags=re.S)
    return re.sub(rb"\s+" + name + rb"\s*=\s*(\"[^\"]*\"|'[^']*')", b"", without)


def set_xmp_orientation(xmp: str, value: int) -> str:
    """XMP with the orientation it states, as an attribute or an element, replaced."""
    import re

    said = re.sub(r"(tiff:Orientation\s*=\s*[\"'])\d+([\"'])", rf"\g<1>{value}\g<2>", xmp)
    return re.sub(r"(<tiff:Orientation\s*>\s*)\d+(\s*</tiff:Orientation\s*>)", rf"\g<1>{value}\g<2>", said)


def upright(xmp: Column) -> Column:
    """The same for a column of XMP texts and upright pixels."""
    return F.regexp_replace(F.regexp_replace(xmp, r"(tiff:Orientation\s*=\s*[\"'])\d+([\"'])", "$11$2"), r"(<tiff:Orientation\s*>\s*)\d+(\s*</tiff:Orientation\s*>)", "$11$2")


def prepared(segments: Segments, strip_location: bool, marker_text: str) -> Segments:
    """What of a file's metadata its new version gets, in the same order, with our marker at the end."""
    out = []
    for marker, body in segments:
        if dropped(marker, body, strip_location):
            continue
        if strip_location and marker == APP1 and body.startswith(EXIF):
            body = EXIF + strip_gps(body[len(EXIF) :])
        elif strip_location and marker == APP1 and body.startswith(XMP):
            body = XMP + strip_places(body[len(XMP) :])
        out.append((marker, body))
    return [*out, (COMMENT, MARKER + b" " + marker_text.encode())]


def with_orientation(tiff: bytes, value: int) -> bytes | None:
    """An EXIF block that states this orientation: patched where it has one, else with its first directory moved behind the block and one entry longer; None if it can't be read."""
    if (patched := set_orientation(tiff, value)) is not None:
        return patched
    if not (head := _tiff(tiff)):
        return None
    order, at = head
    if at + 2 > len(tiff):
        return None
    n = struct.unpack_from(order + "H", tiff, at)[0]
    end = at + 2 + 12 * n
    if len(_ifd(tiff, at, order)) != n or end + 4 > len(tiff):
        return None
    entries = [tiff[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n)]
    new = struct.pack(order + "HHIHH", ORIENTATION, 3, 1, value, 0)
    place = next((i for i, e in enumerate(entries) if struct.unpack_from(order + "H", e)[0] > ORIENTATION), n)
    body = tiff + bytes(len(tiff) % 2)
    table = struct.pack(order + "H", n + 1) + b"".join([*entries[:place], new, *entries[place:]]) + tiff[end : end + 4]
    return body[:4] + struct.pack(order + "I", len(body)) + body[8:] + table


def orientation_only(value: int) -> bytes:
    """The smallest EXIF block that states an orientation."""
    return b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, ORIENTATION, 3, 1, value, 0, 0)


def index_of(images: list[tuple[int, int, int]]) -> bytes:
    """Body of a multi-picture index: (attribute, size, offset) of each image, the primary first."""
    rows = b"".join(struct.pack("<IIIHH", attribute, size, offset, 0, 0) for attribute, size, offset in images)
    tags = [(0xB000, 7, 4, int.from_bytes(b"0100", "little")), (0xB001, 4, 1, len(images)), (0xB002, 7, len(rows), 50)]
    return MULTI + b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4) + rows


def append_images(primary: bytes, images: list[tuple[int, bytes]]) -> bytes:
    """primary followed by further (attribute, bytes) images, indexed right behind its JFIF, EXIF and XMP segments."""
    if not images:
        return primary
    segments = [s for s in split(primary)[0] if not (s[0] == APP2 and s[1].startswith(MULTI))]
    place = next((i for i, (marker, _) in enumerate(segments) if marker > APP1), len(segments))
    base = 2 + sum(4 + len(body) for _, body in segments[:place]) + 4 + len(MULTI)

    def indexed(rows: list[tuple[int, int, int]]) -> bytes:
        return splice(primary, [*segments[:place], (APP2, index_of(rows)), *segments[place:]])

    size = len(indexed([(0, 0, 0)] * (len(images) + 1)))
    rows, at = [(0x030000, size, 0)], size
    for attribute, body in images:
        rows.append((attribute, len(body), at - base))
        at += len(body)
    return indexed(rows) + b"".join(body for _, body in images)


def further_images(data: bytes) -> list[tuple[int, bytes]]:
    """(attribute, bytes) of the images that a multi-picture index lists behind the primary; ValueError if it can't be read."""
    at = 2
    for marker, body in walk(data)[0]:
        at = data.index(body, at)
        if marker == APP2 and body.startswith(MULTI):
            base, tiff = at + len(MULTI), body[len(MULTI) :]
            if not (head := _tiff(tiff)):
                raise ValueError("unreadable index")
            order, first = head
            tags = {tag: struct.unpack_from(order + "I", tiff, place)[0] for tag, _, _, place in _ifd(tiff, first, order)}
            if 0xB001 not in tags or 0xB002 not in tags or tags[0xB002] + ENTRY * tags[0xB001] > len(tiff):
                raise ValueError("unreadable index")
            out = []
            for i in range(1, tags[0xB001]):
                attribute, size, offset = struct.unpack_from(order + "III", tiff, tags[0xB002] + ENTRY * i)
                image = data[base + offset : base + offset + size]
                if len(image) != size or image[:2] != b"\xff\xd8":
                    raise ValueError("an indexed image is not there")
                out.append((attribute, image))
            return out
        at += len(body)
    raise ValueError("no index")
