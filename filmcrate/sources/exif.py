"""EXIF blocks written anew: for a picture that was turned upright, has another size and carries no thumbnail.

A block is a TIFF file of directories. All entries are read with their values, changed, and
laid out again in the block's own byte order. Nothing here raises for malformed bytes.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

from .structures import MOST_ENTRIES

MARK = b"Exif\0\0"
# Bytes per value of each TIFF type, tags that point to further directories, and tags that say where image data lie.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
EXIF, GPS, INTEROP = 0x8769, 0x8825, 0xA005
IMAGE_DATA = {0x0111, 0x0117, 0x0144, 0x0145, 0x014A, 0x0201, 0x0202}
ORIENTATION, WIDTH, HEIGHT, PIXEL_X, PIXEL_Y = 0x0112, 0x0100, 0x0101, 0xA002, 0xA003
NAMES = {ORIENTATION: "Orientation", 0x010F: "Make", 0x0110: "Model", 0x0132: "DateTime", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x927C: "MakerNote", 0x9286: "UserComment"}
#: A JPG segment's length, two bytes, counts itself and the mark.
MOST_BLOCK = 0xFFFF - 2 - len(MARK)
UNREADABLE = "(unreadable EXIF)"


class Entry(NamedTuple):
    kind: int
    count: int
    value: bytes


Directory = dict[int, Entry]


def _named(where: str, tag: int) -> str:
    return f"{where}:{NAMES.get(tag, hex(tag))}"


def _read(block: bytes, at: int, order: str, where: str, refused: list[str]) -> Directory | None:
    """Entries of the directory at a place; None where it does not lie in the block. Entries of no known type, or whose value is not there, are refused."""
    count = struct.unpack_from(order + "H", block, at)[0] if 8 <= at <= len(block) - 2 else MOST_ENTRIES + 1
    if count > MOST_ENTRIES or at + 2 + 12 * count > len(block):
        return None
    found: Directory = {}
    for tag, kind, n, inline in struct.iter_unpack(order + "HHI4s", block[at + 2 : at + 2 + 12 * count]):
        size = TYPE_BYTES.get(kind, 0) * n
        start = struct.unpack(order + "I", inline)[0]
        value = inline[:size] if size <= 4 else block[start : start + size]
        if not size or len(value) < size:
            refused.append(_named(where, tag))
        else:
            found[tag] = Entry(kind, n, value)
    return found


def _below(block: bytes, parent: Directory, tag: int, order: str, where: str, refused: list[str]) -> Directory:
    """The directory that an entry points to, the entry taken out; empty where there is none. A pointer to nowhere is refused."""
    link = parent.pop(tag, None)
    if link is None:
        return {}
    found = _read(block, struct.unpack(order + "I", link.value[:4])[0], order, where, refused) if link.kind == 4 else None
    if found is None:
        refused.append(_named(where, tag))
    return found or {}


def _size(directory: Directory) -> int:
    """Bytes of a directory with its values, each at an even place."""
    return 2 + 12 * len(directory) + 4 + sum(len(e.value) + len(e.value) % 2 for e in directory.values() if len(e.value) > 4)


def _write(directory: Directory, at: int, order: str) -> bytes:
    head, behind = struct.pack(order + "H", len(directory)), b""
    values = at + 2 + 12 * len(directory) + 4
    for tag, e in sorted(directory.items()):
        if len(e.value) <= 4:
            inline = e.value.ljust(4, b"\0")
        else:
            inline = struct.pack(order + "I", values + len(behind))
            behind += e.value + b"\0" * (len(e.value) % 2)
        head += struct.pack(order + "HHI", tag, e.kind, e.count) + inline
    return head + b"\0" * 4 + behind


def _laid_out(main: Directory, exif: Directory, gps: Directory, interop: Directory, order: str) -> bytes:
    """Header, first directory and those below it, one behind the other; empty ones are left out, and nothing follows the first."""
    link = Entry(4, 1, b"\0" * 4)
    exif = exif | ({INTEROP: link} if interop else {})
    main = main | {EXIF: link} | ({GPS: link} if gps else {})
    at = 8 + _size(main)
    places = {}
    for tag, part in ((EXIF, exif), (GPS, gps), (INTEROP, interop)):
        places[tag] = Entry(4, 1, struct.pack(order + "I", at))
        at += _size(part) if part else 0
    main |= {t: places[t] for t in (EXIF, GPS) if t in main}
    exif |= {INTEROP: places[INTEROP]} if interop else {}
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    for part in (main, exif, gps, interop):
        out += _write(part, len(out), order) if part else b""
    return out


def upright(block: bytes, width: int, height: int) -> tuple[bytes, list[str]]:
    """The block for an upright picture of a size, and names of the tags it lost.

    Orientation is 1 and the size the new one. Thumbnails and places of image data go without
    a word. If the rest is too long for a JPG segment, the longest values go. An empty block
    stays empty; of one that cannot be read nothing is kept.
    """
    block = block.removeprefix(MARK)
    if not block:
        return b"", []
    order, refused = {b"II": "<", b"MM": ">"}.get(block[:2]), []
    main = _read(block, struct.unpack_from(order + "I", block, 4)[0], order, "0th", refused) if order and len(block) >= 8 else None
    if main is None:
        return b"", [UNREADABLE]
    exif = _below(block, main, EXIF, order, "Exif", refused)
    gps = _below(block, main, GPS, order, "GPS", refused)
    interop = _below(block, exif, INTEROP, order, "Interop", refused)
    long = lambda n: Entry(4, 1, struct.pack(order + "I", n))
    main = {t: e for t, e in main.items() if t not in IMAGE_DATA} | {ORIENTATION: Entry(3, 1, struct.pack(order + "H", 1))}
    main |= {t: long(n) for t, n in ((WIDTH, width), (HEIGHT, height)) if t in main}
    exif = exif | {PIXEL_X: long(width), PIXEL_Y: long(height)}
    parts = {"0th": main, "Exif": exif, "GPS": gps, "Interop": interop}
    while len(made := _laid_out(main, exif, gps, interop, order)) > MOST_BLOCK:
        where, tag = max(((w, t) for w, part in parts.items() for t in part), key=lambda k: len(parts[k[0]][k[1]].value))
        del parts[where][tag]
        refused.append(_named(where, tag))
    return made, refused


def in_jpg(data: bytes, block: bytes) -> bytes:
    """A JPG with the block as its EXIF segment, in place of those it had; as it was where it is no JPG."""
    if data[:2] != b"\xff\xd8":
        return data
    kept, at = b"", 2
    while data[at : at + 1] == b"\xff" and 0xE0 <= (data[at + 1 : at + 2] or b"\0")[0] <= 0xEF:
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4])
        if data[at + 1] != 0xE1 or data[at + 4 : at + 10] != MARK:
            kept += data[at:end]
        at = end
    own = b"\xff\xe1" + struct.pack(">H", len(block) + len(MARK) + 2) + MARK + block if block else b""
    return data[:2] + own + kept + data[at:]
