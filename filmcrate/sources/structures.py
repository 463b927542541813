"""Containers that media files are built of: TIFF directories and ISO media boxes, read by position. Nothing here raises for malformed bytes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

BOX_BYTES = 1 << 20
# TIFF tags that are read, and bytes per value of each TIFF type.
TAGS = {0x0100: "width", 0x0101: "height", 0x0112: "orientation", 0x010F: "make", 0x0110: "model", 0x0132: "datetime", 0x8769: "exif", 0x9003: "original", 0x9004: "digitized"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
MOST_ENTRIES, MOST_VALUE = 1000, 4096

#: bytes of a file from a position on, fewer at its end
Read = Callable[[int, int], bytes]


def _directory(read: Read, base: int, at: int, order: str) -> dict[str, object]:
    """Known tags of one TIFF directory by name."""
    head = read(base + at, 2)
    count = struct.unpack(order + "H", head)[0] if len(head) == 2 else 0
    found: dict[str, object] = {}
    if count > MOST_ENTRIES:
        return found
    table = read(base + at + 2, 12 * count)
    for tag, kind, n, inline in struct.iter_unpack(order + "HHI4s", table[: len(table) // 12 * 12]):
        width = TYPE_BYTES.get(kind, 0) * n
        if tag not in TAGS or kind not in TYPE_BYTES or width > MOST_VALUE:
            continue
        value = inline[:width] if width <= 4 else read(base + struct.unpack(order + "I", inline)[0], width)
        if kind == 2:
            found[TAGS[tag]] = value.partition(b"\0")[0].decode("ascii", "replace")
        elif kind in (3, 4) and len(value) >= TYPE_BYTES[kind]:
            found[TAGS[tag]] = struct.unpack_from(order + ("H" if kind == 3 else "I"), value)[0]
    return found


def tiff_tags(read: Read, base: int = 0) -> dict[str, object]:
    """First directory and the EXIF directory it points to."""
    head = read(base, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        return {}
    main = _directory(read, base, struct.unpack(order + "I", head[4:])[0], order)
    main = {k: v for k, v in main.items() if k not in ("original", "digitized")}
    place = main.pop("exif", 0)
    inner = _directory(read, base, place, order) if isinstance(place, int) and place else {}
    return main | {k: v for k, v in inner.items() if k in ("original", "digitized")}


def _header(head: bytes, room: int) -> tuple[bytes, int, int] | None:
    """Type, header length and whole length of a box; None where it is malformed or longer than the room it has."""
    if len(head) < 8:
        return None
    short, kind = struct.unpack_from(">I4s", head)
    wide = int.from_bytes(head[8:16]) if len(head) == 16 else 0
    # a length of 0 means all the room, 1 that the length follows in eight bytes
    length, own = {0: (room, 8), 1: (wide, 16)}.get(short, (short, 8))
    return (kind, own, length) if own <= length <= room else None


def boxes(read: Read, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, payload start and payload end of the boxes between two places, up to the first malformed one."""
    while (room := end - start) >= 8 and (found := _header(read(start, 16), room)):
        kind, own, length = found
        yield kind, start + own, start + length
        start += length


def box_at(read: Read, where: tuple[int, int] | None, *path: bytes) -> tuple[int, int] | None:
    """The first box at a path of types below ``where``."""
    for kind in path:
        if where is None:
            return None
        where = next(((s, e) for k, s, e in boxes(read, *where) if k == kind), None)
    return where


def payload(read: Read, where: tuple[int, int]) -> bytes:
    return read(where[0], min(where[1] - where[0], BOX_BYTES))
