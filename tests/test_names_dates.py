"""Dates in names and metadata, by tables of cases."""

import datetime

from pyspark.sql import functions as F

from filmcrate.functions import dates, labels, paths, templates

D = datetime.datetime
NAMES = [
    # each known pattern in two shapes, with times of its own
    ("KakaoTalk_19991130_235901777", D(1999, 11, 30, 23, 59, 1), "kakao", False),
    ("KAKAOTALK_Audio_2015-02-28_00-00-07", D(2015, 2, 28, 0, 0, 7), "kakao", False),
    ("screenshot-2019-06-01 at 7.05.09", D(2019, 6, 1, 7, 5, 9), "screenshot", False),
    ("屏幕截图_20210908-174002", D(2021, 9, 8, 17, 40, 2), "screenshot", False),
    ("20160229_000000~2", D(2016, 2, 29), "camera", False),
    ("BURST_20250704_183020_COVER", D(2025, 7, 4, 18, 30, 20), "camera", False),
    ("stk-20180812-wa77", D(2018, 8, 12), "messenger", False),
    ("Band_20201224 evening", D(2020, 12, 24), "messenger", False),
    ("LINE_P123_20170505", D(2017, 5, 5), "messenger", False),
    # dates anywhere in a name
    ("attic_2008_11_09T06:07:08", D(2008, 11, 9, 6, 7, 8), "", False),
    ("from 2012.01.31 to 2012.02.01", D(2012, 1, 31), "", True),
    ("2012.01.31 and again 2012.01.31", D(2012, 1, 31), "", False),
    ("2022-10-11_212223_PXL_20050607_080910", D(2022, 10, 11, 21, 22, 23), "camera", False),
    ("VID_20231301_101010 2011-12-13", D(2011, 12, 13), "", False),
    # no dates
    ("PANO_20230229_010203", None, None, None),
    ("P1070001", None, None, None),
    ("1066-10-14", None, None, None),
    ("2014.07-13", None, None, None),
    ("920141225", None, None, None),
]
METADATA = [
    ("2009:09:09 09:09:09", D(2009, 9, 9, 9, 9, 9)),
    ("2011: 1: 2 23:00:59", D(2011, 1, 2, 23, 0, 59)),
    ("2016:05:06 07:08:60", None),
    ("2016:05:06 24:08:09", None),
    ("2016-05-06 29:08:09", D(2016, 5, 6)),
    ("2021-08-19T20:21:22-03:30", D(2021, 8, 19, 20, 21, 22)),
    ("1995/12/01 00:01:02", D(1995, 12, 1, 0, 1, 2)),
    ("2003:04:05 06:07", D(2003, 4, 5, 6, 7)),
    ("2018:7:9 5:4:3", D(2018, 7, 9, 5, 4, 3)),
    ("\x00 2001-10-20 \x00", D(2001, 10, 20)),
    ("0000:00:00 00:00:00", None),
    ("\t  ", None),
    ("sometime", None),
]


def test_names(spark):
    rows = spark.createDataFrame([(n,) for n, *_ in NAMES], "s string").withColumn("d", dates.name_date(F.col("s"))).collect()
    got = [(r["s"], *((r["d"]["when"], r["d"]["source"], r["d"]["multiple"]) if r["d"] else (None, None, None))) for r in rows]
    assert got == NAMES


def test_metadata(spark):
    rows = spark.createDataFrame([(t,) for t, _ in METADATA], "t string").withColumn("d", dates.parse_meta_date(F.col("t"))).collect()
    assert [(r["t"], r["d"]) for r in rows] == METADATA


def test_user_patterns_that_do_not_work_are_named():
    good, bad = dates.user_patterns((r"(?P<y>\d{4})x(?P<m>\d\d)x(?P<d>\d\d)", "(", r"(?P<y>\d)"))
    assert len(good) == 1 and bad == ["(", r"(?P<y>\d)"]


def test_templates_and_settings():
    cases = {"": "err_pattern_empty", "{yyyy}/{source}": "", "{nope}": "err_pattern_unknown", "{yyyy}}": "err_pattern_braces", "/x": "err_pattern_absolute", "C:\\x": "err_pattern_absolute", "a/../b": "err_pattern_absolute"}
    assert {t: templates.template_problem(t) for t in cases} == cases
    got = labels.coerce_settings({"quality": 85, "mode": "steal", "rename": 1, "year_min": True, "similar_threshold": 17, "dest": "/x", "name_patterns": ["a"]})
    assert (got["quality"], got["mode"], got["rename"], got["year_min"], got["similar_threshold"], got["dest"], got["name_patterns"]) == (85, "move", False, 1990, 6, "/x", ["a"])
    assert labels.coerce_settings({"pattern": "{bogus}/../x"})["pattern"] == labels.coerce_settings({"pattern": " "})["pattern"] == templates.DEFAULT_TEMPLATE
    assert labels.coerce_settings({"pattern": "{mm}/{source}"})["pattern"] == "{mm}/{source}"
    assert labels.coerce_settings({"name_patterns": ["a", 3, "", " ", None, "(?P<y>", "b"]})["name_patterns"] == ["a", "(?P<y>", "b"]
    assert labels.coerce_settings({"name_patterns": "a", "year_max": [1], "quality": 101, "icc": ["srgb"]}) == labels.coerce_settings({})
    assert labels.coerce_settings({"update_check_last": " 2024-01-02T03:04 ", "update_check_skipped": "9" * 40}) | {"update_check_last": "2024-01-02", "update_check_skipped": "9" * 32} == labels.coerce_settings({"update_check_last": "2024-01-02", "update_check_skipped": "9" * 32})
    assert labels.filled("{a} {b}", a=1) == "{a} {b}" and labels.filled("{a}", a=1) == "1"


def test_path_edges(spark):
    cases = [("/a/b.jpg", "/a", "b", ".jpg"), ("/.bashrc", "/", ".bashrc", ""), ("/a.b.HEIC", "/", "a.b", ".HEIC"), ("/x/noext", "/x", "noext", ""), ("/x/a.", "/x", "a", "."), ("/x/...a.x", "/x", "...a", ".x"), ("/x/..jpg", "/x", "..jpg", "")]
    p = spark.createDataFrame([(c[0],) for c in cases], "p string")
    name = paths.basename(F.col("p"))
    assert [tuple(r) for r in p.select("p", paths.dirname(F.col("p")), paths.stem(name), paths.extension(name)).collect()] == cases


def test_stacked_prefixes_are_looked_through_as_long_as_they_are_dates(spark):
    day = "2024-03-15_123456_"
    cases = {
        day * 5 + "KakaoTalk_20200101_010101": ("2024-03-15 12:34:56", "kakao"),
        day + "2024-02-30_000000_KakaoTalk_20200101_010101": ("2024-03-15 12:34:56", ""),
        "2024-02-30_000000_x": None,
        "1970-03-15_123456_IMG-20240315-WA0001": ("2024-03-15 00:00:00", ""),
        day: ("2024-03-15 12:34:56", ""),
        "": None,
    }
    rows = spark.createDataFrame([(s,) for s in [*cases, None]], "s string").select("s", dates.name_date(F.col("s")).alias("d"), dates.strip_renamed(F.col("s")).alias("left")).collect()
    for r in rows:
        want = cases.get(r["s"])
        assert (None if r["d"] is None else (str(r["d"]["when"]), r["d"]["source"])) == want, r["s"]
    left = {r["s"]: r["left"] for r in rows}
    assert left[day * 5 + "KakaoTalk_20200101_010101"] == day * 4 + "KakaoTalk_20200101_010101"
    assert left["2024-02-30_000000_x"] == "2024-02-30_000000_x"
