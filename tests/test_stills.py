"""Metadata and sizes out of files built byte by byte."""

import struct
import zlib

import pytest

from filmcrate.functions import paths
from filmcrate.sources import binary, stills

from test_catalog_e2e import box, tiff

WHEN = "2023:07:08 09:10:11"


def full(kind, payload, version=0, flags=0):
    return box(kind, bytes([version]) + flags.to_bytes(3) + payload)


def heic(block=None, size=(640, 480), offset=0, length=0, stored=False, pictures=1, base=0, brand=b"heic"):
    """A HEIC file with an EXIF item (in the file, or in the item table itself), pictures, a thumbnail and a tile."""
    exif = struct.pack(">I", 6) + b"Exif\0\0" + (tiff(WHEN) if block is None else block)
    kinds = [(n, b"hvc1", 0) for n in range(1, pictures + 1)] + [(50, b"hvc1", 0), (51, b"hvc1", 1), (60, b"Exif", 0)]
    infe = b"".join(full(b"infe", struct.pack(">HH4s", n, 0, kind) + b"\0", 2, hidden) for n, kind, hidden in kinds)
    iinf = full(b"iinf", struct.pack(">H", len(kinds)) + infe)
    iref = full(b"iref", box(b"thmb", struct.pack(">HHH", 50, 1, 1)))
    props = box(b"iprp", box(b"ipco", full(b"colr", b"") + full(b"ispe", struct.pack(">II", *size))) + full(b"ipma", struct.pack(">IHBBB", 1, 1, 2, 1, 0x82)))

    def whole(at):
        n = length or len(exif)
        iloc = full(b"iloc", struct.pack(">BBHHHHIHII", 0x44, 0x40, 1, 60, int(stored), 0, base, 1, max(at - base, 0), n), 1)
        meta = full(b"meta", full(b"hdlr", b"\0" * 20) + full(b"pitm", b"\0\1") + iinf + iref + iloc + props + (box(b"idat", exif) if stored else b""))
        return box(b"ftyp", brand + b"\0\0\0\0mif1") + meta

    if stored:
        return whole(0 + offset)
    return whole((len(whole(0)) + 8) + offset) + box(b"mdat", exif)


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(*chunks, size=(320, 200)):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", *size, 8, 2, 0, 0, 0)) + b"".join(chunks) + chunk(b"IEND", b"")


def webp(*chunks):
    body = b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def opened(tmp_path, data, kind="image"):
    path = tmp_path / "picture"
    path.write_bytes(data)
    return binary.read_file(str(path), len(data), kind)


@pytest.mark.parametrize("data", [heic(), heic(stored=True), heic(base=100), heic() + b"\0" * 200_000])
def test_heic_gives_tags_and_size_in_one_opening(tmp_path, data):
    got = opened(tmp_path, data, "heic")
    assert (got["fmt"], got["error"], got["frames"], got["w"], got["h"]) == ("HEIC", "", 1, 640, 480)
    assert (got["tags"]["original"], got["tags"]["make"], got["tags"]["model"]) == (WHEN, "Apple", "iPhone")


def test_heic_counts_pictures_without_thumbnails_and_tiles(tmp_path):
    assert opened(tmp_path, heic(pictures=3), "heic")["frames"] == 3
    assert opened(tmp_path, heic(brand=b"avif"), "avif")["fmt"] == "AVIF"


@pytest.mark.parametrize("wrong", [{"offset": 10_000}, {"length": 1 << 20}, {"offset": 1 << 31}, {"stored": True, "length": 5000}, {"stored": True, "offset": 100}])
def test_heic_extents_outside_the_file_are_refused(tmp_path, wrong):
    got = opened(tmp_path, heic(**wrong), "heic")
    assert got["tags"] == {} and got["error"].startswith("ValueError") and got["quick"]


def test_heic_cut_at_every_place_never_raises(tmp_path):
    whole = heic()
    for n in range(12, len(whole), 7):
        got = opened(tmp_path, whole[:n], "heic")
        assert got["fmt"] == "HEIC" and (got["error"] or got["tags"] in ({}, got["tags"]))


def test_png(tmp_path):
    for data in (png(chunk(b"eXIf", tiff(WHEN))), png(chunk(b"IDAT", b"x" * 300_000), chunk(b"eXIf", tiff(WHEN)))):
        got = opened(tmp_path, data)
        assert (got["fmt"], got["tags"]["original"], got["w"], got["h"], got["error"]) == ("PNG", WHEN, 320, 200, "")
    block = (b"Exif\0\0" + tiff(WHEN)).hex()
    text = f"\nexif\n{len(block) // 2:8}\n{block[:72]}\n{block[72:]}\n".encode()
    for data in (chunk(b"tEXt", b"Raw profile type exif\0" + text), chunk(b"zTXt", b"Raw profile type exif\0\0" + zlib.compress(text))):
        assert opened(tmp_path, png(data))["tags"]["model"] == "iPhone"
    cut = png(chunk(b"eXIf", tiff(WHEN)))
    for n in range(8, len(cut) - 12, 5):
        got = opened(tmp_path, cut[:n])
        assert got["error"] == "" and (got["tags"] == {} or n >= len(cut) - 16)
    assert opened(tmp_path, png(chunk(b"zTXt", b"Raw profile type exif\0\0broken")))["error"] == ""


def test_webp(tmp_path):
    canvas = b"\0\0\0\0" + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")
    for block in (tiff(WHEN), b"Exif\0\0" + tiff(WHEN)):
        got = opened(tmp_path, webp((b"VP8X", canvas), (b"ICCP", b"odd"), (b"EXIF", block)))
        assert (got["fmt"], got["tags"]["original"], got["w"], got["h"], got["error"]) == ("WEBP", WHEN, 800, 600, "")
    lossless = b"\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 8
    lossy = b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 33, 44 | 1 << 14) + b"\0" * 4
    for chunk_, want in (((b"VP8L", lossless), (100, 50)), ((b"VP8 ", lossy), (33, 44))):
        got = opened(tmp_path, webp(chunk_))
        assert (got["w"], got["h"], got["tags"]) == (*want, {})
    whole = webp((b"VP8X", canvas), (b"EXIF", tiff(WHEN)))
    for n in range(12, len(whole), 5):
        assert opened(tmp_path, whole[:n])["error"] == ""


def test_other_sizes(tmp_path):
    frame = b"\xff\xd8\xff\xe1\0\x08Exif\0\0\xff\xc4\0\x02\xff\xc2\0\x08\x08" + struct.pack(">HH", 11, 22)
    sized = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 0x100, 4, 1, 70) + struct.pack("<HHIHH", 0x101, 3, 1, 80, 0) + b"\0" * 4
    for data, want in ((frame, (22, 11)), (b"GIF89a" + struct.pack("<HH", 5, 6), (5, 6)), (b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -8), (7, 8)), (sized, (70, 80)), (b"GIF87a\0", (None, None)), (b"\xff\xd8\xff\xc0", (None, None))):
        got = opened(tmp_path, data)
        assert (got["w"], got["h"], got["error"]) == (*want, "")


def test_formats_as_bytes_and_as_column(spark):
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"GIF87a", b"GIF89a", b"RIFF\0\0\0\0WEBP", b"BM", b"II*\0", b"MM\0*", b"IIRO", b"IIU\0", b"MM*\0", b"", b"RIFF", b"\0\0\0\1moov"]
    heads += [b"\0\0\0\x18ftyp" + b for b in (b"heic", b"mif2", b"avif", b"avis", b"qt  ", b"crx ", b"3gp4", b"3g2a", b"isom", b"")]
    rows = spark.createDataFrame([(bytearray(h),) for h in heads], "head binary").select("head", paths.sniff("head").alias("fmt")).collect()
    assert all(r["fmt"] == paths.sniff_bytes(bytes(r["head"])) for r in rows)
    assert [r["fmt"] for r in rows][:12] == ["JPEG", "PNG", "GIF", "GIF", "WEBP", "BMP", "TIFF", "TIFF", "TIFF", "TIFF", "", ""]
    assert [r["fmt"] for r in rows][14:] == ["HEIC", "HEIC", "AVIF", "AVIF", "MOV", "CR3", "3GP", "3GP", "MP4", "MP4"]
