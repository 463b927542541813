"""EXIF blocks written anew, read back with the reader of the catalog and entry by entry."""

import os
import random
import struct
import sys
import types

import pytest

from filmcrate.plans import execution
from filmcrate.sources import binary, exif, structures

from test_catalog_e2e import tiff


def block(main, exif_=(), gps=(), interop=(), order="<", thumbnail=False):
    """Directories of (tag, type, count, value) as a TIFF block, laid out with values before their directories."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))

    def put(entries, following=0):
        rows = []
        for tag, kind, n, value in entries:
            if len(value) > 4:
                rows.append((tag, kind, n, struct.pack(order + "I", len(out))))
                out.extend(value + b"\0" * (len(value) % 2))
            else:
                rows.append((tag, kind, n, value.ljust(4, b"\0")))
        at = len(out)
        out.extend(struct.pack(order + "H", len(rows)) + b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in rows) + struct.pack(order + "I", following))
        return at

    link = lambda tag, at: (tag, 4, 1, struct.pack(order + "I", at))
    inner = [*exif_, *([link(0xA005, put(interop))] if interop else [])]
    links = ([link(0x8769, put(inner))] if inner else []) + ([link(0x8825, put(gps))] if gps else [])
    first = put([(0x0201, 4, 1, b"\1\2\3\4"), (0x0202, 4, 1, b"\1\2\3\4")]) if thumbnail else 0
    out[4:8] = struct.pack(order + "I", put([*main, *links], first))
    return bytes(out)


def tags(data):
    return structures.tiff_tags(lambda at, n: data[at : at + n])


def entries(data, refused=None):
    order = "<" if data[:2] == b"II" else ">"
    refused = [] if refused is None else refused
    main = exif._read(data, struct.unpack_from(order + "I", data, 4)[0], order, "0th", refused)
    inner = exif._below(data, main, exif.EXIF, order, "Exif", refused)
    return {"0th": main, "Exif": inner, "GPS": exif._below(data, main, exif.GPS, order, "GPS", refused), "Interop": exif._below(data, inner, exif.INTEROP, order, "Interop", refused)}


@pytest.mark.parametrize("order", ["<", ">"])
def test_everything_but_turn_size_and_thumbnail_stays(order):
    short = lambda n: struct.pack(order + "H", n)
    long = lambda n: struct.pack(order + "I", n)
    main = [(0x0100, 4, 1, long(4000)), (0x010F, 2, 6, b"Apple\0"), (0x0110, 2, 3, b"X1\0"), (0x0111, 4, 1, long(7)), (0x0112, 3, 1, short(6)), (0x011A, 5, 1, long(72) + long(1))]
    inner = [(0x9003, 2, 20, b"2024:01:02 03:04:05\0"), (0x927C, 7, 5, b"maker"), (0xA002, 4, 1, long(4000)), (0xA003, 3, 1, short(3000))]
    gps = [(1, 2, 2, b"N\0"), (2, 5, 3, long(1) * 6)]
    interop = [(1, 2, 4, b"R98\0")]
    old = block(main, inner, gps, interop, order, thumbnail=True)
    new, refused = exif.upright(old, 3000, 4000)
    assert refused == []
    assert tags(new) == {"width": 3000, "make": "Apple", "model": "X1", "orientation": 1, "original": "2024:01:02 03:04:05"}
    was, now = entries(old), entries(new)
    assert now["GPS"] == was["GPS"] and now["Interop"] == was["Interop"]
    assert {t: e for t, e in now["Exif"].items() if t not in (0xA002, 0xA003)} == {t: e for t, e in was["Exif"].items() if t not in (0xA002, 0xA003)}
    assert now["Exif"][0xA002].value == long(3000) and now["Exif"][0xA003] == exif.Entry(4, 1, long(4000))
    assert set(was["0th"]) - set(now["0th"]) == {0x0111} and now["0th"][0x011A] == was["0th"][0x011A]
    at = struct.unpack_from(order + "I", new, 4)[0]
    end = at + 2 + 12 * struct.unpack_from(order + "H", new, at)[0]
    assert new[end : end + 4] == b"\0" * 4
    assert exif.upright(new, 3000, 4000) == (new, []) and exif.upright(exif.MARK + old, 3000, 4000)[0] == new


def test_no_block_and_a_block_without_directories():
    assert exif.upright(b"", 1, 2) == (b"", []) and exif.upright(b"Exif\0\0", 1, 2) == (b"", [])
    for bad in (b"II", b"II*\0\xff\xff\0\0", b"nonsense", b"MM\0*\0\0\0\x08", b"II*\0\0\0\0\0" + b"\0" * 20):
        assert exif.upright(bad, 1, 2) == (b"", [exif.UNREADABLE])
    new, refused = exif.upright(block([]), 5, 6)
    assert refused == [] and tags(new) == {"orientation": 1} and set(entries(new)["Exif"]) == {0xA002, 0xA003}


def test_refused_tags_are_told():
    main = [(0x010F, 2, 900, b"\xff\xff\0\0"), (0x0110, 99, 1, b"abcd"), (0x0132, 2, 4, b"now\0")]
    new, refused = exif.upright(block(main, [(0x9003, 2, 0, b"")]), 5, 6)
    assert refused == ["0th:Make", "0th:Model", "Exif:DateTimeOriginal"] and tags(new) == {"datetime": "now", "orientation": 1}
    nowhere = block([(0x8825, 4, 1, b"\xff\xff\xff\0"), (0x8769, 3, 1, b"\1\0")])
    assert exif.upright(nowhere, 5, 6)[1] == ["Exif:0x8769", "GPS:0x8825"]


def test_too_long_values_go_longest_first():
    big = [(0x927C, 7, 60_000, b"m" * 60_000), (0x9286, 7, 9_000, b"u" * 9_000), (0x9003, 2, 5, b"2024\0")]
    new, refused = exif.upright(block([(0x0110, 2, 3, b"X1\0")], big), 5, 6)
    assert refused == ["Exif:MakerNote"] and len(new) <= exif.MOST_BLOCK and len(entries(new)["Exif"][0x9286].value) == 9_000
    assert tags(new)["original"] == "2024"


def test_cut_and_random_blocks_raise_nothing():
    whole = block([(0x010F, 2, 6, b"Apple\0"), (0x0112, 3, 1, b"\6\0")], [(0x9003, 2, 20, b"2024:01:02 03:04:05\0")], [(1, 2, 2, b"N\0")], [(1, 2, 4, b"R98\0")])
    rng = random.Random(1)
    for n in range(len(whole)):
        new, refused = exif.upright(whole[:n], 5, 6)
        assert new == b"" or tags(new)["orientation"] == 1
    for _ in range(2000):
        broken = bytearray(whole)
        for _ in range(rng.randrange(1, 6)):
            broken[rng.randrange(4, len(broken))] = rng.randrange(256)
        new, _ = exif.upright(bytes(broken), 5, 6)
        again = []
        assert new == b"" or (entries(new, again) and again == [])


def test_jpg_gets_one_segment():
    jfif = b"\xff\xe0\0\x07JFIF\0"
    xmp = b"\xff\xe1\0\x0ahttp://x"
    old = b"\xff\xe1" + struct.pack(">H", 8 + len(tiff("2001:02:03 04:05:06"))) + b"Exif\0\0" + tiff("2001:02:03 04:05:06")
    rest = b"\xff\xdb\0\x02\xff\xda\0\x02data\xff\xe1\xff\xd9"
    new, _ = exif.upright(tiff("2023:07:08 09:10:11"), 5, 6)
    made = exif.in_jpg(b"\xff\xd8" + jfif + old + xmp + rest, new)
    assert made == b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(new)) + b"Exif\0\0" + new + jfif + xmp + rest
    assert exif.in_jpg(made, b"") == b"\xff\xd8" + jfif + xmp + rest and exif.in_jpg(b"GIF89a", new) == b"GIF89a"
    assert exif.in_jpg(b"\xff\xd8", new)[2:4] == b"\xff\xe1"


class Picture:
    """Stands for a picture of the image library: saves the head of a JPG that says what it was asked for."""

    mode, saved, turned = "RGBA", {}, None

    def __init__(self, block, profile, size=(30, 40)):
        self.info, (self.width, self.height) = {"exif": block, "icc_profile": profile}, size

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def convert(self, mode):
        made = Picture(self.info["exif"], self.info["icc_profile"], (self.width, self.height))
        made.mode = mode
        return made

    def save(self, path, fmt, **options):
        if self.info["icc_profile"] == b"broken":
            raise ValueError("no such profile")
        Picture.saved = {"fmt": fmt, "mode": self.mode, **options}
        with open(path, "wb") as f:
            f.write(b"\xff\xd8\xff\xe0\0\x07JFIF\0\xff\xc0\0\x08\x08" + struct.pack(">HH", self.height, self.width) + b"\xff\xd9")


@pytest.fixture
def library(monkeypatch):
    """An image library with just what a conversion asks for."""

    def put(block, profile=b""):
        pil, heif = types.ModuleType("PIL"), types.ModuleType("pillow_heif")
        pil.Image = types.SimpleNamespace(open=lambda path: Picture(block, profile, (40, 30)))
        pil.ImageOps = types.SimpleNamespace(exif_transpose=lambda p: Picture(p.info["exif"], p.info["icc_profile"], (p.height, p.width)))
        profiles = types.SimpleNamespace(ImageCmsProfile=lambda x: types.SimpleNamespace(tobytes=lambda: b"of " + str(x).encode()), createProfile=lambda name: name)
        profiles.profileToProfile = lambda picture, old, new, outputMode: picture.convert(f"{outputMode} in srgb")
        pil.ImageCms, heif.register_heif_opener = profiles, lambda: None
        for name, module in (("PIL", pil), ("pillow_heif", heif)):
            monkeypatch.setitem(sys.modules, name, module)

    return put


def test_conversion_keeps_metadata(library, tmp_path):
    src, jpg = tmp_path / "a.heic", str(tmp_path / "a.jpg")
    src.write_bytes(b"heic")
    os.utime(src, (1_600_000_000, 1_600_000_000))
    library(exif.MARK + block([(0x0112, 3, 1, b"\6\0"), (0x0110, 99, 1, b"x")], [(0x9003, 2, 20, b"2024:01:02 03:04:05\0")]), b"wide")
    made = execution.convert_file(str(src), jpg, 10)
    assert made["ok"] and made["error"] == "" and made["in_size"] == 4 and made["refused"] == ["0th:Model"]
    got = binary.read_file(f"{jpg}.part", os.path.getsize(f"{jpg}.part"), "jpeg")
    assert (got["fmt"], got["w"], got["h"]) == ("JPEG", 30, 40) and got["tags"] == {"orientation": 1, "original": "2024:01:02 03:04:05"}
    assert made["out_size"] == os.path.getsize(f"{jpg}.part") and os.path.getmtime(f"{jpg}.part") == 1_600_000_000
    assert Picture.saved == {"fmt": "JPEG", "mode": "RGB", "quality": 80, "icc_profile": b"wide"}
    execution.convert_file(str(src), jpg, 95, "srgb")
    assert Picture.saved == {"fmt": "JPEG", "mode": "RGB in srgb", "quality": 95, "icc_profile": b"of sRGB"}


def test_conversion_without_metadata_or_with_an_error(library, tmp_path):
    jpg = str(tmp_path / "a.jpg")
    library(b"", b"")
    (tmp_path / "a.heic").write_bytes(b"heic")
    assert execution.convert_file(str(tmp_path / "a.heic"), jpg, icc="srgb")["ok"] and "icc_profile" not in Picture.saved
    assert b"Exif" not in (tmp_path / "a.jpg.part").read_bytes()
    library(b"", b"broken")
    made = execution.convert_file(str(tmp_path / "a.heic"), jpg)
    assert not made["ok"] and "no such profile" in made["error"] and not os.path.exists(f"{jpg}.part")
