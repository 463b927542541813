"""Metadata and dimensions of still pictures from the structure of their files: JPEG, HEIF (HEIC, AVIF), PNG, WebP, TIFF, GIF, BMP.

No picture is decoded and no image library is needed. Readers take bytes by position, through
the handle that is open already, and stop quietly where a file was cut short; an item table
that points outside its file is refused (ValueError), as nothing it says can be trusted.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths
from .structures import Read, box_at, boxes, payload, tiff_tags

#: A metadata block is at most this long; items of a HEIF file, and chunks or segments of others, at most so many.
MOST_BLOCK, MOST_ITEMS, MOST_PARTS = 4 << 20, 4096, 10_000
#: EXIF segments of a JPEG are looked for as far as this.
HEAD_BYTES = 64 << 10
_EXIF = b"Exif\0\0"
_RAW_PROFILE = b"Raw profile type exif\0"


def _uint(data: bytes, at: int, width: int) -> int:
    """Big-endian number; ValueError where the data end before it does."""
    if at + width > len(data):
        raise ValueError("a table ends inside an entry")
    return int.from_bytes(data[at : at + width])


def _block_tags(block: bytes) -> dict[str, object]:
    """Tags of a TIFF block in memory, with or without the EXIF mark before it."""
    base = len(_EXIF) if block.startswith(_EXIF) else 0
    return tiff_tags(lambda at, n: block[at : at + n] if at >= 0 else b"", base)


# JPEG ------------------------------------------------------------------------------------------


def jpeg_segments(read: Read) -> Iterator[tuple[int, int, int]]:
    """Marker, start and length of the segments before the picture's data."""
    at = 2
    for _ in range(MOST_PARTS):
        mark = read(at, 4)
        if len(mark) < 4 or mark[0] != 0xFF or mark[1] in (0xDA, 0xD9):
            return
        length = int.from_bytes(mark[2:])
        yield mark[1], at + 4, length - 2
        at += 2 + length


def jpeg_tags(read: Read) -> dict[str, object]:
    """Tags of the first EXIF segment among the segments that begin in the head."""
    for marker, at, length in jpeg_segments(read):
        if at >= HEAD_BYTES + 4:
            break
        if marker == 0xE1 and read(at, len(_EXIF)) == _EXIF:
            return _block_tags(read(at, max(length, 0)))
    return {}


def _jpeg_size(read: Read) -> tuple[int, int] | None:
    for marker, at, _ in jpeg_segments(read):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            frame = read(at, 5)
            return (int.from_bytes(frame[3:5]), int.from_bytes(frame[1:3])) if len(frame) == 5 else None
    return None


# HEIF ------------------------------------------------------------------------------------------


@dataclass
class Items:
    """The item table of a HEIF file."""

    kinds: dict[int, bytes] = field(default_factory=dict)
    hidden: set[int] = field(default_factory=set)
    extents: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    parts: set[int] = field(default_factory=set)  # thumbnails, auxiliary pictures and tiles
    primary: int = 0
    sizes: list[tuple[int, int] | None] = field(default_factory=list)
    holds: dict[int, list[int]] = field(default_factory=dict)


def _item_kinds(data: bytes, items: Items) -> None:
    wide = _uint(data, 0, 1) > 0
    count = _uint(data, 4, 4 if wide else 2)
    at = 8 if wide else 6
    inside = lambda pos, n: data[pos : pos + n]
    for (_, s, _e), _ in zip(boxes(inside, at, len(data)), range(min(count, MOST_ITEMS)), strict=False):
        version = _uint(data, s, 1)
        if version >= 2:
            id_bytes = 2 if version == 2 else 4
            number = _uint(data, s + 4, id_bytes)
            items.kinds[number] = data[s + 6 + id_bytes : s + 10 + id_bytes]
            if _uint(data, s + 1, 3) & 1:
                items.hidden.add(number)


def _item_extents(data: bytes, size: int, stored: tuple[int, int] | None, items: Items) -> None:
    """Places of every item in the file; ``stored`` is the room of the box that holds small items itself."""
    version, widths = _uint(data, 0, 1), _uint(data, 4, 2)
    offset_w, length_w, base_w, index_w = widths >> 12, widths >> 8 & 15, widths >> 4 & 15, widths & 15 if version in (1, 2) else 0
    id_w = 4 if version == 2 else 2
    count, at = _uint(data, 6, id_w), 6 + id_w

    def take(width: int) -> int:
        nonlocal at
        value = _uint(data, at, width)
        at += width
        return value

    for _ in range(min(count, MOST_ITEMS)):
        number = take(id_w)
        method = take(2) & 15 if version in (1, 2) else 0
        take(2)
        base, found = take(base_w), []
        room = {0: (0, size), 1: stored}.get(method)
        for _ in range(take(2)):
            take(index_w)
            start = base + take(offset_w)
            length = take(length_w)
            if room is None or start + length > room[1] - room[0]:
                found = None
                continue
            if found is not None:
                found.append((room[0] + start, length or room[1] - room[0] - start))
        # an item whose place is wrong is known as such, and refused when it is read
        items.extents[number] = found


def _item_links(read: Read, where: tuple[int, int], items: Items) -> None:
    id_w = 4 if read(where[0], 1) > b"\0" else 2
    for kind, s, e in boxes(read, where[0] + 4, where[1]):
        data = payload(read, (s, e))
        source, count = _uint(data, 0, id_w), _uint(data, id_w, 2)
        if kind in (b"thmb", b"auxl"):
            items.parts.add(source)
        elif kind == b"dimg":
            items.parts.update(_uint(data, id_w + 2 + i * id_w, id_w) for i in range(count))


def _item_properties(read: Read, where: tuple[int, int], items: Items) -> None:
    held, owners = box_at(read, where, b"ipco"), box_at(read, where, b"ipma")
    if not held or not owners:
        return
    for kind, s, e in boxes(read, *held):
        data = payload(read, (s, e)) if kind == b"ispe" else b""
        items.sizes.append((_uint(data, 4, 4), _uint(data, 8, 4)) if data else None)
    data = payload(read, owners)
    id_w, index_w = (4 if _uint(data, 0, 1) else 2), (2 if _uint(data, 3, 1) & 1 else 1)
    at = 8
    for _ in range(min(_uint(data, 4, 4), MOST_ITEMS)):
        number, count = _uint(data, at, id_w), _uint(data, at + id_w, 1)
        at += id_w + 1
        items.holds[number] = [_uint(data, at + i * index_w, index_w) & ((1 << 8 * index_w - 1) - 1) for i in range(count)]
        at += count * index_w


def heif_items(read: Read, size: int) -> Items:
    """The item table of a HEIC or AVIF file of ``size`` bytes; ValueError where a table is cut short."""
    items, meta = Items(), box_at(read, (0, size), b"meta")
    if meta is None:
        return items
    inside = (meta[0] + 4, meta[1])
    found = {kind: (s, e) for kind, s, e in boxes(read, *inside)}
    if b"iinf" in found:
        _item_kinds(payload(read, found[b"iinf"]), items)
    if b"iloc" in found:
        _item_extents(payload(read, found[b"iloc"]), size, found.get(b"idat"), items)
    if b"iref" in found:
        _item_links(read, found[b"iref"], items)
    if b"iprp" in found:
        _item_properties(read, found[b"iprp"], items)
    if b"pitm" in found:
        data = payload(read, found[b"pitm"])
        items.primary = _uint(data, 4, 4 if _uint(data, 0, 1) else 2)
    return items


def _item_bytes(read: Read, extents: list[tuple[int, int]] | None) -> bytes:
    if extents is None or sum(n for _, n in extents) > MOST_BLOCK:
        raise ValueError("an item lies outside its file")
    data = b"".join(read(at, n) for at, n in extents)
    if len(data) != sum(n for _, n in extents):
        raise ValueError("an item ends behind its file")
    return data


def heif_tags(read: Read, size: int) -> tuple[dict[str, object], int]:
    """Tags of the EXIF item, and the number of pictures (thumbnails, tiles and auxiliary ones apart)."""
    items = heif_items(read, size)
    whole = [n for n, kind in items.kinds.items() if kind not in (b"Exif", b"mime", b"uri ") and n not in items.parts and n not in items.hidden]
    for number, kind in items.kinds.items():
        if kind == b"Exif" and number in items.extents:
            data = _item_bytes(read, items.extents[number])
            return _block_tags(data[4 + _uint(data, 0, 4) :] if len(data) >= 4 else b""), max(len(whole), 1)
    return {}, max(len(whole), 1)


def _heif_size(read: Read, size: int) -> tuple[int, int] | None:
    items = heif_items(read, size)
    held = [items.sizes[i - 1] for i in items.holds.get(items.primary, []) if 0 < i <= len(items.sizes)]
    return next((s for s in held if s), None)


# PNG and WebP ----------------------------------------------------------------------------------


def png_chunks(read: Read) -> Iterator[tuple[bytes, int, int]]:
    """Type, start and length of the chunks that are all there."""
    at = 8
    for _ in range(MOST_PARTS):
        head = read(at, 8)
        if len(head) < 8:
            return
        length, kind = struct.unpack(">I4s", head)
        if kind == b"IEND" or len(read(at + 8 + length, 4)) < 4:
            return
        yield kind, at + 8, length
        at += 12 + length


def _raw_profile(block: bytes) -> bytes:
    """Bytes of a profile written in hexadecimal: a line break, its name and its length come before it."""
    lines = block.decode("latin-1").split("\n")[3:]
    try:
        return bytes.fromhex("".join(lines))
    except ValueError:
        return b""


def png_tags(read: Read) -> dict[str, object]:
    """Tags of the EXIF chunk, or of a text chunk that older programs kept them in."""
    older: dict[str, object] = {}
    for kind, at, length in png_chunks(read):
        if length > MOST_BLOCK:
            continue
        if kind == b"eXIf":
            return _block_tags(read(at, length))
        if kind in (b"tEXt", b"zTXt") and not older and read(at, len(_RAW_PROFILE)) == _RAW_PROFILE:
            text = read(at, length)[len(_RAW_PROFILE) :]
            try:
                older = _block_tags(_raw_profile(zlib.decompressobj().decompress(text[1:], MOST_BLOCK) if kind == b"zTXt" else text))
            except zlib.error:
                continue
    return older


def _png_size(read: Read) -> tuple[int, int] | None:
    head = read(8, 16)
    return struct.unpack(">II", head[8:]) if len(head) == 16 and head[4:8] == b"IHDR" else None


def webp_chunks(read: Read) -> Iterator[tuple[bytes, int, int]]:
    """Type, start and length of the chunks that are all there."""
    at = 12
    for _ in range(MOST_PARTS):
        head = read(at, 8)
        if len(head) < 8:
            return
        kind, length = struct.unpack("<4sI", head)
        if length and len(read(at + 7 + length, 1)) < 1:
            return
        yield kind, at + 8, length
        at += 8 + length + length % 2


def webp_tags(read: Read) -> dict[str, object]:
    held = ((at, n) for kind, at, n in webp_chunks(read) if kind == b"EXIF" and n <= MOST_BLOCK)
    found = next(held, None)
    return _block_tags(read(*found)) if found else {}


def _webp_size(read: Read) -> tuple[int, int] | None:
    kind, data = read(12, 4), read(20, 10)
    if len(data) < 10:
        return None
    if kind == b"VP8X":
        return int.from_bytes(data[4:7], "little") + 1, int.from_bytes(data[7:10], "little") + 1
    if kind == b"VP8L" and data[0] == 0x2F:
        bits = int.from_bytes(data[1:5], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and data[3:6] == b"\x9d\x01\x2a":
        return int.from_bytes(data[6:8], "little") & 0x3FFF, int.from_bytes(data[8:10], "little") & 0x3FFF
    return None


# All formats -----------------------------------------------------------------------------------


def picture_tags(read: Read, fmt: str, size: int) -> tuple[dict[str, object], int]:
    """Tags by name and the number of pictures; {} and 1 for formats without metadata."""
    if fmt in ("HEIC", "AVIF"):
        return heif_tags(read, size)
    found = {"JPEG": jpeg_tags, "TIFF": tiff_tags, "PNG": png_tags, "WEBP": webp_tags}.get(fmt)
    return (found(read) if found else {}), 1


def dimensions(read: Read, fmt: str, size: int) -> tuple[int, int] | None:
    """Width and height of the picture as it is stored, None where the file does not tell."""
    if fmt in ("HEIC", "AVIF"):
        got = _heif_size(read, size)
    elif fmt == "TIFF":
        tags = tiff_tags(read)
        got = (tags.get("width"), tags.get("height"))
    elif fmt in ("GIF", "BMP"):
        at, shape = (6, "<HH") if fmt == "GIF" else (18, "<ii")
        data = read(at, struct.calcsize(shape))
        got = struct.unpack(shape, data) if len(data) == struct.calcsize(shape) else None
    else:
        of = {"JPEG": _jpeg_size, "PNG": _png_size, "WEBP": _webp_size}.get(fmt)
        got = of(read) if of else None
    if got is None or not all(isinstance(x, int) and 0 < abs(x) < 1 << 31 for x in got):
        return None
    return abs(got[0]), abs(got[1])


def header_size(head: Column) -> Column:
    """Struct of w and h from the first bytes of a file, nulls where these do not tell."""

    @F.pandas_udf("w int, h int")
    def measured(heads: pd.Series) -> pd.DataFrame:
        out = []
        for data in heads:
            data = b"" if data is None else bytes(data)
            try:
                got = dimensions(lambda at, n, data=data: data[at : at + n], paths.sniff_bytes(data[:32]), len(data))
            except (ValueError, IndexError):
                got = None
            out.append(got or (None, None))
        return pd.DataFrame(out, columns=["w", "h"]).astype("Int32")

    return measured(head)
