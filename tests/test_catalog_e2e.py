"""Whole runs on real folders: nothing lost, quiet second run, undo gives back what was there."""

import datetime
import hashlib
import json
import os
import random
import struct
import threading
import time

import pytest

from filmcrate.operators import history, incremental
from filmcrate.plans import cli, execution, planner, steps
from filmcrate.plans.options import Options
from filmcrate.plans.progress import Cancelled, watched
from filmcrate.sources import binary, files, runlog, stills, tree


def tiff(when, make=b"Apple\0", model=b"iPhone\0"):
    text = when.encode() + b"\0"
    data = bytearray(b"II*\0" + struct.pack("<I", 8))
    n = 3
    extra = 8 + 2 + 12 * n + 4
    rows = []
    for tag, value in ((0x010F, make), (0x0110, model)):
        rows.append(struct.pack("<HHI", tag, 2, len(value)) + struct.pack("<I", extra))
        extra += len(value)
    rows.append(struct.pack("<HHII", 0x8769, 4, 1, extra))
    data += struct.pack("<H", n) + b"".join(rows) + struct.pack("<I", 0) + make + model
    data += struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(text), extra + 2 + 12 + 4) + struct.pack("<I", 0) + text
    return bytes(data)


def jpeg(when="", tail=b""):
    body = b"\xff\xd8\xff"[:2]
    if when:
        exif = b"Exif\0\0" + tiff(when)
        body += b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif
    return body + (b"\xff\xda" if when else b"\xff\xdb\x00\x02\xff\xda") + tail


def box(kind, payload):
    return struct.pack(">I", len(payload) + 8) + kind + payload


def movie(seconds, text=b""):
    header = box(b"mvhd", b"\0\0\0\0" + struct.pack(">I", seconds + 2082844800) + b"\0" * 12)
    udta = box(b"udta", box(b"\xa9day", struct.pack(">HH", len(text), 0) + text)) if text else b""
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", header + udta)


def fill(root, seed=0):
    rng = random.Random(seed)
    files = {
        "a/IMG_0001.dng": tiff("2024:03:15 12:34:56"),
        "a/IMG_0001.mov": movie(1711185560, b"2024-03-15T12:34:56+0900"),
        "a/IMG_0001.AAE": b"<x/>",
        "a/IMG_1234.jpg": jpeg(tail=b"no date"),
        "b/KakaoTalk_20240316_083000123.jpg": jpeg(tail=b"k"),
        "b/copy/20240320_141516.jpg": jpeg("2024:03:20 14:15:16"),
        "c/20240320_141516.jpg": jpeg("2024:03:20 14:15:16"),
        "c/20240320_141516(1).jpg": jpeg("2024:03:20 14:15:17", b"other"),
        "d/20240320_141516.jpg": jpeg("2024:03:20 14:15:16", b"same name, other bytes"),
        "d/VID_20240323_181920.mp4": movie(1711185560),
        "e/empty.jpg": b"",
        "e/Thumbs.db": b"junk",
        "e/notes.txt": b"stays",
        "f/._x.jpg": b"junk",
        "f/Screenshot_20240318_101112.png": b"\x89PNG\r\n\x1a\n",
        "_under/.hidden.jpg": jpeg("2001:01:02 03:04:05"),
        "g/lone.xmp": b"<x/>",
    }
    for i in range(12):
        day = rng.randrange(1, 28)
        files[f"r{rng.randrange(4)}/{rng.choice(['IMG', 'DSC', 'photo'])}{rng.randrange(4)}.jpg"] = jpeg(f"2023:05:{day:02d} 10:00:00", bytes([rng.randrange(3)]))
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    return files


def snapshot(root):
    out = {}
    for top, _, names in os.walk(root):
        for n in names:
            if not n.startswith("organize_log"):
                with open(os.path.join(top, n), "rb") as f:
                    out[os.path.relpath(os.path.join(top, n), root)] = hashlib.sha1(f.read()).hexdigest()
    return out


def dirs(root):
    return sorted(os.path.relpath(os.path.join(t, d), root) for t, ds, _ in os.walk(root) for d in ds)


@pytest.mark.parametrize("seed,more", [(0, {}), (1, {"rename": True, "include_nodate": True, "template": "{yyyy}/{source}/{ext}"}), (2, {"jpg_pair_as_dupe": True, "template": "{yyyy-mm-dd}"})])
def test_run_again_and_undo(spark, tmp_path, seed, more):
    root = str(tmp_path / "photos")
    fill(root, seed)
    before, folders = snapshot(root), dirs(root)
    opts = Options(root, **more)
    plan = planner.make_plan(spark, opts)
    rows = plan.items.collect()
    targets = [d.lower() for r in rows for d in r["dsts"] if d]
    assert len(targets) == len(set(targets)) and all(len(t) < 260 for t in targets)
    done = execution.execute(plan)
    assert not done.failed and done.done > 5
    after = snapshot(root)
    assert sorted(after.values()) == sorted(v for k, v in before.items() if not (os.path.basename(k) in ("Thumbs.db", "._x.jpg") and k not in after))
    again = planner.make_plan(spark, opts)
    assert [r["members"][0]["path"] for r in again.items.where("acts").collect()] == []
    back = execution.undo(done.log_path)
    assert not back.skipped and back.restored >= done.done
    restored = snapshot(root)
    assert {k: v for k, v in before.items() if os.path.basename(k) not in ("Thumbs.db", "._x.jpg")} == {k: v for k, v in restored.items() if os.path.basename(k) not in ("Thumbs.db", "._x.jpg")}
    assert dirs(root) == folders
    assert execution.undo(done.log_path).nothing


def test_dates_items_and_states(spark, tmp_path):
    root = str(tmp_path / "photos")
    fill(root)
    rows = {os.path.relpath(r["members"][0]["path"], root): r for r in planner.make_plan(spark, Options(root)).items.collect()}
    pair = rows["a/IMG_0001.dng"]
    assert [m["name"] for m in pair["members"]] == ["IMG_0001.dng", "IMG_0001.mov", "IMG_0001.AAE"]
    assert pair["basis"] == "exif" and pair["when"] == datetime.datetime(2024, 3, 15, 12, 34, 56) and pair["source"] == "camera"
    assert rows["a/IMG_1234.jpg"]["status"] == "nodate" and rows["e/empty.jpg"]["notes"] == ["empty"]
    assert rows["b/KakaoTalk_20240316_083000123.jpg"]["basis"] == "name" and rows["b/KakaoTalk_20240316_083000123.jpg"]["source"] == "kakao"
    assert rows["d/VID_20240323_181920.mp4"]["basis"] == "video"
    assert rows["b/copy/20240320_141516.jpg"]["status"] == "dup" and rows["b/copy/20240320_141516.jpg"]["dup_of"].endswith("c/20240320_141516.jpg")
    assert rows["d/20240320_141516.jpg"]["status"] == "conflict" and rows["d/20240320_141516.jpg"]["dsts"][0].endswith("2024-03-20/20240320_141516 (2).jpg")
    assert rows["g/lone.xmp"]["status"] == "same" and "_under/.hidden.jpg" in rows


def test_copy_mode_is_quiet_the_second_time(spark, tmp_path):
    root, dest = str(tmp_path / "in"), str(tmp_path / "out")
    fill(root)
    before = snapshot(root)
    opts = Options(root, dest, mode="copy")
    done = execution.execute(planner.make_plan(spark, opts))
    assert not done.failed and snapshot(root) == before
    again = planner.make_plan(spark, opts)
    assert again.items.where("acts and status <> 'dup'").count() == 0
    back = execution.undo(done.log_path)
    assert not back.skipped and snapshot(dest) == {} and snapshot(root) == before


def test_a_photo_of_yesterday_is_dated(spark, tmp_path, capsys):
    """The command line takes the present from the clock, not from a constant."""
    day = datetime.datetime.now() - datetime.timedelta(days=1)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jpg").write_bytes(jpeg(day.strftime("%Y:%m:%d %H:%M:%S")))
    assert cli.run(spark, cli.parser().parse_args([str(tmp_path)])) == 0
    assert any(day.strftime("%Y-%m") in os.path.join(t, n) for t, _, ns in os.walk(tmp_path) for n in ns if n == "x.jpg")


def test_undo_sees_runs_of_other_logs(tmp_path):
    """A later run, in another log, took what the run placed: it must be undone first."""
    one, two = tmp_path / "one", tmp_path / "two"
    for folder in (one, two):
        folder.mkdir()
    (one / "p.jpg").write_bytes(b"picture")
    logs = []
    for src, dst, when in ((one / "p.jpg", one / "d" / "p.jpg", "2024-01-01T00:00:00"), (one / "d" / "p.jpg", two / "p.jpg", "2024-01-02T00:00:00")):
        log = runlog.RunLog(str(dst.parent if dst.parent != one / "d" else one), str(one), "move")
        log.head["time"] = when
        execution.Executor(log, execution.Result(), "move").place(steps.Move(str(src), str(dst)))
        log.finish()
        logs.append(log.path)
    assert execution.undo(logs[0], other_logs=tuple(logs)).blocked_by and (two / "p.jpg").exists()
    assert execution.undo(logs[1], other_logs=tuple(logs)).restored == 1
    back = execution.undo(logs[0], other_logs=tuple(logs))
    assert back.restored == 1 and (one / "p.jpg").read_bytes() == b"picture" and not (one / "d").exists()


def test_files_are_never_replaced(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(b"1")
    b.write_bytes(b"2")
    for act in (files.relocate, files.duplicate):
        with pytest.raises(files.Refused):
            act(str(a), str(b))
    assert (a.read_bytes(), b.read_bytes()) == (b"1", b"2")
    with pytest.raises(ZeroDivisionError), files.replacing(str(b)) as part:
        open(part, "w").write("3")
        raise ZeroDivisionError
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a", "b"] and b.read_bytes() == b"2"
    files.relocate(str(a), str(tmp_path / "A"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["A", "b"]


def test_readers():
    read = lambda data: lambda at, n: data[at : at + n]
    assert stills.jpeg_tags(read(jpeg("2024:01:02 03:04:05")))["original"] == "2024:01:02 03:04:05"
    assert stills.tiff_tags(read(tiff("2024:01:02 03:04:05")))["make"] == "Apple"
    clip = movie(1711185560, b"2024-03-15T12:34:56+0900")
    assert binary.video_dates(read(clip), len(clip)) == {"video_utc": datetime.datetime(2024, 3, 23, 9, 19, 20), "video_local": datetime.datetime(2024, 3, 15, 12, 34, 56)}
    keys = box(b"keys", b"\0\0\0\0" + struct.pack(">I", 1) + box(b"mdta", b"com.apple.quicktime.creationdate"))
    items = box(b"ilst", box(struct.pack(">I", 1), box(b"data", b"\0" * 8 + b"2020-05-06T07:08:09Z")))
    clip = box(b"moov", box(b"mvhd", b"\0" * 24) + box(b"meta", box(b"hdlr", b"\0" * 8) + keys + items))
    assert binary.video_dates(read(clip), len(clip)) == {"video_utc": datetime.datetime(2020, 5, 6, 7, 8, 9), "video_local": None}
    assert binary.video_dates(read(b"\0\0\0\x01moov"), 8) == {"video_utc": None, "video_local": None}
    assert binary.movie_seconds(b"\1\0\0\0" + struct.pack(">Q", 2082844801)) == 1 and binary.movie_seconds(b"\0" * 12) is None


def test_listing_hides_links_and_exclusions(spark, tmp_path):
    fill(str(tmp_path))
    os.symlink(tmp_path / "a", tmp_path / "a" / "loop")
    rows = tree.listing(spark, str(tmp_path), [str(tmp_path / "b")])
    found = {os.path.relpath(r["path"], tmp_path) for r in tree.media_files(rows).collect()}
    assert "_under/.hidden.jpg" in found and "e/empty.jpg" in found and not any("loop" in f or f.startswith("b/") or "Thumbs" in f for f in found)
    assert {os.path.relpath(r["path"], tmp_path) for r in tree.folders(rows).collect()} >= {".", "a", "e", "g"}


def test_listing_in_rounds_gives_the_same_rows(spark, tmp_path):
    """One chain fifteen folders deep beside a folder of sixty folders: with three folders a task, many rounds and many tasks."""
    deep = tmp_path / "deep"
    for n in range(15):
        deep = deep / f"d{n}"
        deep.mkdir(parents=True)
        (deep / f"f{n}.jpg").write_bytes(b"x" * n)
    for n in range(60):
        (tmp_path / "wide" / f"w{n}" / "in").mkdir(parents=True)
        (tmp_path / "wide" / f"w{n}" / "in" / "a b.jpg").write_bytes(b"")
    (tmp_path / "wide" / "w7" / "link").symlink_to(tmp_path / "deep")
    gone = str(tmp_path / "wide" / "w9").upper()
    wanted = sorted((r[0], r[1], r[2], r[8], r[9]) for r in tree.walk([str(tmp_path)], frozenset([gone.lower()])))
    assert sum(w[0] == "file" for w in wanted) == 15 + 59 + 1 and len({w[1] for w in wanted}) == len(wanted)
    for first, most in ((1, 3), (5, 1), (10**6, 1)):
        rows = tree.listing(spark, str(tmp_path), [gone], first, most)
        assert sorted((r["what"], r["path"], r["size"], r["files"], r["subdirs"]) for r in rows.collect()) == wanted
    ahead = [(str(tmp_path / "wide" / f"w{n}"),) for n in range(8)]
    one = tree._round(spark.createDataFrame(ahead, "folder string").coalesce(1), frozenset(), 3).groupBy("what").count().collect()
    assert {r["what"]: r["count"] for r in one} == {"dir": 8, "file": 1, "todo": 8}  # the link is a file
    assert [tuple(r)[:2] for r in tree.listing(spark, str(tmp_path / "absent")).collect()] == [("denied", str(tmp_path / "absent"))]


def test_log_recovery(spark, tmp_path):
    log = runlog.RunLog(str(tmp_path), "/src", "move")
    log.add(op="move", src="/src/a", dst="/x/a")
    log.journal.write('{"op": "move", "src"')
    log._close()
    data = runlog.load(log.path)
    assert data["runs"][-1]["ops"] == [{"op": "move", "src": "/src/a", "dst": "/x/a"}] and "open" not in data["runs"][-1]
    runlog.save(log.path, data)
    runs = runlog.runs_table(spark, [log.path]).collect()
    assert len(runs) == 1 and runs[0]["ops"][0]["dst"] == "/x/a"
    with open(log.path, "w") as f:
        f.write("broken")
    runlog.RunLog(str(tmp_path), "/src", "move").discard()
    assert any(".broken-" in n for n in os.listdir(tmp_path))


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "p")
    fill(root)
    parse = cli.parser().parse_args
    assert cli.run(spark, parse([root + "/none"])) == 2
    assert cli.run(spark, parse([root, "--pattern", "{nope}"])) == 2
    assert cli.run(spark, parse([root, "--copy"])) == 2
    before = snapshot(root)
    assert cli.run(spark, parse([root, "--dry-run", "--dedupe"])) == 0 and snapshot(root) == before
    assert cli.run(spark, parse([root, "--dedupe"])) == 0 and snapshot(root) != before
    assert cli.run(spark, parse([root, "--undo"])) == 0
    assert cli.run(spark, parse([root, "--undo"])) == 1


def test_a_second_plan_opens_only_what_changed(spark, tmp_path):
    root, snap = str(tmp_path / "in"), str(tmp_path / "snapshot")
    fill(root)
    opts = Options(root, str(tmp_path / "out"))
    rows = lambda plan: sorted((r["key"], str(r["when"]), r["basis"], r["status"], r["dsts"]) for r in plan.items.collect())
    plain = rows(planner.make_plan(spark, opts))
    first = planner.make_plan(spark, opts, snapshot=snap)
    n = sum(len(names) for _, _, names in os.walk(root))
    assert rows(first) == plain and n - 3 <= first.opened <= n
    again = planner.make_plan(spark, opts, snapshot=snap)
    assert again.opened == 0 and rows(again) == plain
    # one file changes, one is new, one moves inside the drive, one goes
    with open(f"{root}/a/IMG_1234.jpg", "wb") as f:
        f.write(jpeg("2021:01:01 01:01:01", b"changed"))
    with open(f"{root}/a/new.jpg", "wb") as f:
        f.write(jpeg("2021:02:02 02:02:02", b"new"))
    os.rename(f"{root}/b/copy/20240320_141516.jpg", f"{root}/b/copy/renamed.jpg")
    os.remove(f"{root}/d/20240320_141516.jpg")
    third = planner.make_plan(spark, opts, snapshot=snap)
    assert third.opened == 2 and rows(third) == rows(planner.make_plan(spark, opts))
    assert incremental.versions(spark, snap) == [2, 3]
    held = {r["path"] for r in spark.read.parquet(f"{snap}/version=3").collect()}
    assert f"{root}/b/copy/renamed.jpg" in held and f"{root}/d/20240320_141516.jpg" not in held


def test_bad_settings_in_a_file_do_no_harm(spark, tmp_path, capsys):
    root = str(tmp_path / "in")
    fill(root)
    (tmp_path / "settings.json").write_text('{"pattern": "{bogus}/../x", "name_patterns": ["(", 3, "(?P<y>\\\\d{4})x(?P<m>\\\\d\\\\d)x(?P<d>\\\\d\\\\d)"], "quality": "high"}')
    (tmp_path / "in" / "2019x05x06.jpg").write_bytes(jpeg(tail=b"by pattern"))
    assert cli.run(spark, cli.parser().parse_args([root, "--dry-run", "--settings", str(tmp_path / "settings.json")])) == 0
    told = capsys.readouterr().out
    assert "bogus" not in told and "2019/2019-05-06/2019x05x06.jpg" in told


def test_many_journals_fold_like_one(spark, tmp_path):
    """Documents and journals of every kind, recovered as tables and one by one."""
    step = lambda i: {"op": "move", "src": f"/a/{i}", "dst": f"/b/{i}", "size": i}
    head = lambda name, open_=True: {"journal": {"id": name, "time": "t", "source": "/a", "dest": "/b", "mode": "move", "undone": False, "open": open_}}
    run = lambda name, n, **more: {"id": name, "ops": [step(i) for i in range(n)], **more}
    cases = [
        ([run("x", 0, open=True)], [head("x"), *map(step, range(5))], ""),
        ([run("x", 3, open=True)], [head("x"), step(0)], ""),
        ([run("x", 2)], [head("x"), *map(step, range(5))], ""),
        ([run("w", 1)], [head("x"), *map(step, range(4))], '{"op": "mo'),
        ([run("w", 1)], [head("x", False), step(1)], ""),
        ([], [step(0), step(1)], ""),
        ([run("w", 2), run("x", 0, open=True)], [head("x"), step(0), [1], 3, step(1)], "\n" + json.dumps(step(9))),
        ([run("x", 1)], [], ""),
        ([run("x", 0, open=True)], [head("x"), *map(step, range(3000))], ""),
    ]
    logs = []
    for i, (runs, rows, tail) in enumerate(cases):
        (tmp_path / str(i)).mkdir()
        logs.append(runlog.log_path(str(tmp_path / str(i))))
        with open(logs[-1], "w") as f:
            json.dump({"version": 1, "runs": runs}, f)
        if rows:
            with open(logs[-1] + runlog.JOURNAL, "w") as f:
                f.write("".join(json.dumps(r) + "\n" for r in rows) + tail)
    want = sorted((log, r["id"], k, s.get("src")) for log in logs for r in runlog.load(log)["runs"] for k, s in enumerate(r["ops"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        lines = runlog.journals_table(spark, logs)
        got = history.recovered_steps(runlog.runs_table(spark, logs), lines, runlog.OP).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(("/" + r["log"].removeprefix("file:").lstrip("/"), r["id"], r["seq"], r["src"]) for r in got) == want
    assert runlog.journals_table(spark, [str(tmp_path / "none")]).collect() == []


def test_a_plan_tells_its_progress_and_can_be_cancelled(spark, tmp_path):
    for i in range(6000):
        os.makedirs(tmp_path / str(i % 20), exist_ok=True)
        (tmp_path / str(i % 20) / f"IMG_{i}.jpg").write_bytes(jpeg("2024:01:02 03:04:05", str(i).encode()))
    told, cancel, when = [], threading.Event(), []

    def progress(done, total):
        told.append((done, total))
        if len(told) == 5:
            when.append(time.monotonic())
            cancel.set()

    with pytest.raises(Cancelled):
        planner.make_plan(spark, Options(str(tmp_path)), progress=progress, cancel=cancel)
    assert time.monotonic() - when[0] < 2
    assert all(0 <= done <= total for done, total in told)
    with pytest.raises(Cancelled):
        planner.make_plan(spark, Options(str(tmp_path)), cancel=cancel)
    # jobs outside the block go on
    assert spark.range(10).count() == 10
    few = []
    with watched(spark, lambda *counts: few.append(counts), threading.Event()):
        assert spark.range(0, 1000, 1, 40).selectExpr("reflect('java.lang.Thread', 'sleep', 20L)").count() == 1000
    assert few
