"""Dates in names and metadata, and the one date of a file by priority.

All times are naive wall-clock times (TIMESTAMP_NTZ). The present day is given as ``as_of``,
never read from a clock, so that results repeat.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCES = ("kakao", "screenshot", "messenger", "camera", "other")
# The name patterns, in order; groups are year, month, day and, where there, hour, minute, second.
NAME_PATTERNS = (
    ("kakao", "kakao", r"(?iu)^KakaoTalk_(?:[A-Za-z]+_)?(\d{4})-?(\d{2})-?(\d{2})[-_](\d{2})-?(\d{2})-?(\d{2})", 6),
    ("screenshot", "screenshot", r"(?iu)^(?:Screenshot|Screen ?Shot|스크린샷|スクリーンショット|屏幕截图|截屏)[ _-]?(\d{4})-?(\d{2})-?(\d{2})(?:[ _-]|\s+at\s+)(\d{1,2})[.\-]?(\d{2})[.\-]?(\d{2})", 6),
    ("samsung", "camera", r"(?iu)^(\d{4})(\d{2})(\d{2})_([01]\d|2[0-3])([0-5]\d)([0-5]\d)(?!\d)", 6),
    ("google", "camera", r"(?iu)^(?:PXL|IMG|VID|MVIMG|PANO|BURST)_(\d{4})(\d{2})(\d{2})_([01]\d|2[0-3])([0-5]\d)([0-5]\d)", 6),
    ("whatsapp", "messenger", r"(?iu)^(?:IMG|VID|AUD|PTT|STK)-(\d{4})(\d{2})(\d{2})-WA\d+", 3),
    ("band", "messenger", r"(?iu)^band_(\d{4})(\d{2})(\d{2})(?!\d)", 3),
    ("line", "messenger", r"(?iu)^LINE_.*?(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", 3),
)
# A date anywhere in a name, stems that were renamed before (a prefix and its length), and days that clocks are reset to.
GENERAL = r"(?<!\d)((?:19|20)\d{2})([-._]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])(?:[ _T-]([01]\d|2[0-3])[.:\-]?([0-5]\d)[.:\-]?([0-5]\d))?(?!\d)"
RENAMED = r"^(?:\d{4}-\d{2}-\d{2}_\d{6}_)+"
RENAMED_LENGTH = 18
RESETS = ("1970-01-01", "1980-01-01", "2000-01-01")
# Shapes of dates in metadata that are not the standard one, in order, and how many characters each reads.
META_SHAPES = (
    (r"^(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$", 19),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$", 19),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})$", 19),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$", 19),
    (r"^(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}):(\d{1,2})$", 16),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2})$", 16),
    (r"^(\d{4}):(\d{1,2}):(\d{1,2})$", 10),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 10),
)
# What a user may type as a date.
MANUAL_SHAPES = (
    r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$",
    r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2})$",
    r"^(\d{4})-(\d{1,2})-(\d{1,2})$",
    r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$",
    r"^(\d{4})(\d{2})(\d{2})$",
)


@dataclass(frozen=True)
class DateOptions:
    as_of: datetime.datetime = datetime.datetime(2026, 1, 1)
    use_mtime: bool = False
    year_min: int = 1990
    year_max: int = 0  # 0: the year of as_of
    user_patterns: tuple[str, ...] = ()
    time_zone: str = "UTC"

    @property
    def years(self) -> tuple[int, int]:
        return self.year_min, self.year_max or self.as_of.year


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used: a transform of a one-element array.

    Without it every use would be a copy of the whole expression, and nested uses would multiply.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def make_date(parts: list[Column], years: tuple[int | Column, int | Column] = (1, 9999)) -> Column:
    """A time from year, month, day and optional hour, minute, second (numbers); null for what no calendar has.

    Missing or null hours or minutes mean midnight; seconds count only with both.
    """
    names = ("y", "mo", "d", "h", "mi", "s")
    given = [*parts, *[F.lit(None).cast("int")] * (6 - len(parts))]

    def clock(p: Column) -> Column:
        timed = p["h"].isNotNull() & p["mi"].isNotNull()
        zero = lambda x: F.when(timed, F.coalesce(x, F.lit(0))).otherwise(0)
        return F.struct(p["y"].alias("y"), p["mo"].alias("mo"), p["d"].alias("d"), zero(p["h"]).alias("h"), zero(p["mi"]).alias("mi"), zero(p["s"]).alias("s"))

    def build(p: Column) -> Column:
        good = (p["y"] >= 1) & p["y"].between(*years) & (p["s"] <= 59) & (p["h"] <= 23) & (p["mi"] <= 59)
        return F.when(good, F.try_make_timestamp_ntz(p["y"], p["mo"], p["d"], p["h"], p["mi"], p["s"].cast("decimal(8,6)")))

    return let(F.struct(*[g.alias(n) for g, n in zip(given, names, strict=True)]), lambda p: let(clock(p), build))


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def _parts(text: Column, pattern: str, groups: tuple[int, ...] | range) -> Column:
    """Texts of groups of a match that reaches from the beginning of ``text``, in one replacement; groups that took no part are empty."""
    flags, bare = re.match(r"(\(\?\w+\))?(.*)", pattern, re.DOTALL).groups()
    whole = (flags or "") + bare.removesuffix("$") + r"[\s\S]*$"
    return F.split(F.regexp_replace(text, whole, ",".join(f"${g}" for g in groups)), ",")


def _placed(text: Column, places: tuple[tuple[int, int], ...]) -> Column:
    """Trimmed texts at fixed places (from 1 on) with fixed lengths."""
    return F.array(*[F.trim(F.substring(text, at, n)) for at, n in places])


def _made(parts: Column, years: tuple[int | Column, int | Column] = (1, 9999)) -> Column:
    """The time that an array of up to six texts names, null for none."""
    return make_date([_number(F.get(parts, F.lit(i))) for i in range(6)], years)


def _first_made(parts: Column) -> Column:
    """The first time of an array of arrays of texts."""
    return F.get(F.filter(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: _made(p)), lambda d: d.isNotNull()), F.lit(0))


def _shaped(text: Column, shape: str) -> Column:
    """Groups of ``text`` if it has a shape, else null."""
    return F.when(text.rlike(shape), _parts(text, shape, range(1, shape.count("(") + 1)))


def _own_pattern(text: str) -> re.Pattern | None:
    """A user's pattern, if it compiles and names a year, month and day."""
    try:
        rx = re.compile(text, re.IGNORECASE)
    except re.error:
        return None
    return rx if rx.groupindex.keys() >= {"y", "m", "d"} else None


def user_patterns(patterns: tuple[str, ...]) -> tuple[list[re.Pattern], list[str]]:
    """The usable ones of a user's patterns, and the texts of the others."""
    made = {text: _own_pattern(text) for text in patterns}
    return [rx for rx in map(made.get, patterns) if rx], [text for text in patterns if not made[text]]


def user_date(stem: Column, opts: DateOptions) -> Column:
    """Struct of when and has_time by the first of the user's patterns with a valid date.

    These are Python expressions, hence an Arrow function; it is a column of its own because
    Spark allows none inside the lambdas of array functions.
    """
    good, _ = user_patterns(opts.user_patterns)
    years = opts.years
    texts = [p.pattern for p in good]

    @F.pandas_udf("when timestamp_ntz, has_time boolean")
    def search(stems: pd.Series) -> pd.DataFrame:
        made = [re.compile(t, re.IGNORECASE) for t in texts]

        def one(s: str | None) -> tuple:
            for rx in made:
                if s is None or not (m := rx.search(s)):
                    continue
                g = m.groupdict()
                timed = g.get("H") is not None and g.get("M") is not None
                clock = [int(g["H"]), int(g["M"]), int(g.get("S") or 0)] if timed else []
                try:
                    when = datetime.datetime(int(g["y"]), int(g["m"]), int(g["d"]), *clock)
                except (TypeError, ValueError):
                    continue
                if years[0] <= when.year <= years[1]:
                    return when, timed
            return None, None

        out = pd.DataFrame([one(s) for s in stems], columns=["when", "has_time"])
        return out.assign(when=out["when"].astype("datetime64[us]"))

    return search(stem)


def _plain_name_date(stem: Column, years: tuple[Column, Column], own: Column | None = None) -> Column:
    """Date of a name without the prefix of a renamed file.

    The known patterns and every date anywhere in the name become rows of one array, which
    one expression turns into times: a name costs one date expression, not one a pattern.
    """
    entry = lambda parts, timed, source, known: F.struct(parts.alias("parts"), timed.alias("has_time"), F.lit(source).alias("source"), F.lit(known).alias("known"))
    rows = [entry(F.when(stem.rlike(p), _parts(stem, p, range(1, n + 1))), F.lit(n == 6), source, True) for _, source, p, n in NAME_PATTERNS]
    anywhere = F.transform(F.regexp_extract_all(stem, F.lit(GENERAL), F.lit(0)), lambda m: _parts(m, GENERAL, (1, 3, 4, 5, 6, 7)))
    anywhere = F.transform(anywhere, lambda parts: entry(parts, parts[3] != "", "", False))
    matched = F.filter(F.concat(F.array(*rows), anywhere), lambda e: e["parts"].isNotNull())
    made = F.transform(matched, lambda e: F.struct(_made(e["parts"], years).alias("when"), e["has_time"].alias("has_time"), e["source"].alias("source"), e["known"].alias("known")))

    def choose(dates: Column) -> Column:
        days = F.array_distinct(F.transform(F.filter(dates, lambda d: ~d["known"]), lambda d: F.to_date(d["when"])))
        first = F.get(dates, F.lit(0))
        if own is not None:
            typed = F.when(own["when"].isNotNull(), F.struct(own["when"].alias("when"), own["has_time"].alias("has_time"), F.lit("").alias("source"), F.lit(True).alias("known")))
            first = F.when(F.coalesce(first["known"], F.lit(False)), first).otherwise(F.coalesce(typed, first))
        return let(first, lambda d: F.when(d.isNotNull(), F.struct(d["when"].alias("when"), d["has_time"].alias("has_time"), d["source"].alias("source"), (F.size(days) > 1).alias("multiple"))))

    return let(F.filter(made, lambda d: d["when"].isNotNull()), choose)


def _prefixes(stem: Column) -> Column:
    """Struct of the time of the first sortable prefix (null for none that is a real date) and ``n``, how many real ones are stacked."""

    def read(count: Column) -> Column:
        at = lambda i: F.substring(stem, (i - 1) * RENAMED_LENGTH + 1, F.lit(RENAMED_LENGTH))
        made = F.transform(F.sequence(F.lit(1), count), lambda i: _made(_placed(at(i), ((1, 4), (6, 2), (9, 2), (12, 2), (14, 2), (16, 2)))))

        def ahead(times: Column) -> Column:
            broken = F.array_position(F.transform(times, lambda w: w.isNull()), True)
            return F.struct(times[0].alias("when"), F.when(broken == 0, count).otherwise(broken - 1).cast("int").alias("n"))

        return F.when(count > 0, let(made, ahead))

    return let((F.length(F.regexp_extract(stem, RENAMED, 0)) / RENAMED_LENGTH).cast("int"), read)


def strip_renamed(stem: Column) -> Column:
    """The name without the first sortable prefix, where that is a real date."""
    return let(_prefixes(stem), lambda p: F.when(p["n"] > 0, F.substring(stem, F.lit(RENAMED_LENGTH + 1), F.length(stem))).otherwise(stem))


def name_date(stem: Column, opts: DateOptions = DateOptions(), own: Column | None = None) -> Column:
    """Struct of when, has_time, source and multiple from a file name without extension; null without a date.

    A sortable prefix wins; then the known patterns in order, the user's (``own``, a column
    made by ``user_date``), any date. A renamed name has the source of what follows all its
    stacked prefixes, the user's patterns having none.
    """
    low, high = opts.years

    def choose(prefix: Column) -> Column:
        renamed = F.coalesce(F.year(prefix["when"]).between(low, high), F.lit(False))
        rest = F.when(renamed, F.substring(stem, prefix["n"] * RENAMED_LENGTH + 1, F.length(stem))).otherwise(stem)
        years = F.when(renamed, 1).otherwise(low), F.when(renamed, 9999).otherwise(high)
        named = F.struct(prefix["when"].alias("when"), F.lit(True).alias("has_time"))
        with_source = lambda d: F.when(renamed, F.struct(named["when"].alias("when"), named["has_time"].alias("has_time"), F.coalesce(d["source"], F.lit("")).alias("source"), F.lit(False).alias("multiple"))).otherwise(d)
        return let(rest, lambda r: let(_plain_name_date(r, years, own), with_source))

    return let(_prefixes(stem), choose)


def source_of(stem: Column) -> Column:
    """Source by the first pattern that matches, valid date or not; '' for none."""
    plain, out = strip_renamed(stem), None
    for _, source, pattern, _ in NAME_PATTERNS:
        out = (F if out is None else out).when(plain.rlike(pattern), source)
    return out.otherwise("")


def parse_meta_date(text: Column) -> Column:
    """A date as cameras write it: the standard shape by position, other shapes by their beginning, zeros and blanks null."""
    blank = r"(?U)^\s+|\s+$"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, blank, ""), r"^\x00+|\x00+$", ""), blank, "")

    def parse(s: Column) -> Column:
        standard = (F.length(s) == 19) & s.rlike(r"(?s)^.{4}:.{2}:.{2} .{2}:.{2}:.{2}$")
        fixed = _placed(s, ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)))
        whole = let(fixed, lambda p: F.when(F.forall(F.slice(p, 4, 3), lambda x: _number(x).isNotNull()), p))
        free = F.array(*[_shaped(F.substring(s, 1, n), shape) for shape, n in META_SHAPES])
        return _first_made(F.when((s == "") | s.startswith("0000"), None).when(standard, F.array(whole)).otherwise(free))

    return let(F.substring(bare, 1, 19), parse)


def parse_manual(text: Column) -> Column:
    s = F.trim(text)
    return _first_made(F.array(*[_shaped(s, shape) for shape in MANUAL_SHAPES]))


def in_range(when: Column, opts: DateOptions) -> Column:
    latest = opts.as_of + datetime.timedelta(days=1)
    low, high = opts.years
    return F.coalesce(F.year(when).between(low, high) & (when <= F.lit(latest.isoformat()).cast("timestamp_ntz")), F.lit(False))


def is_reset(when: Column) -> Column:
    return when.isin(*[F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in RESETS])


def utc_to_local(when: Column, time_zone: str) -> Column:
    """A naive UTC time shown in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(time_zone), when)


def mtime_to_local(seconds: Column, time_zone: str) -> Column:
    return utc_to_local(F.timestamp_seconds(seconds).cast("timestamp_ntz"), time_zone)


def resolve(meta: Column, stem: Column, mtime: Column, opts: DateOptions = DateOptions(), own: Column | None = None) -> Column:
    """Struct of when, basis and source: metadata, video, name, then (by option) the modification time.

    A metadata date that a reset clock writes yields to the name's date, and counts as
    suspect where the name has none. Basis '' and a null ``when`` mean no date.
    """
    found = lambda when, basis: F.struct(when.alias("when"), basis.alias("basis"))
    shown = utc_to_local(meta["video_utc"], opts.time_zone)

    def choose(c: Column) -> Column:
        named = c["named"]
        name_basis = F.when(named["multiple"], "name_multi").otherwise("name")
        source = F.coalesce(F.nullif(named["source"], F.lit("")), F.when(F.coalesce(meta["camera"], F.lit("")) != "", "camera").otherwise("other"))
        out = F.when(F.lit(False), found(F.lit(None).cast("timestamp_ntz"), F.lit("")))
        for i in range(len(fields)):
            when = c["read"][i]
            reset = F.coalesce(is_reset(when), F.lit(False))
            out = out.when(reset & named.isNotNull(), found(named["when"], name_basis))
            out = out.when(reset & in_range(when, opts), found(when, F.lit("exif_suspect")))
            out = out.when(~reset & in_range(when, opts), found(when, F.lit("exif")))
        out = out.when(in_range(meta["video_local"], opts), found(meta["video_local"], F.lit("video")))
        out = out.when(in_range(c["shown"], opts), found(c["shown"], F.lit("video")))
        out = out.when(named.isNotNull(), found(named["when"], name_basis))
        if opts.use_mtime:
            out = out.when((mtime > 0) & in_range(c["changed"], opts), found(c["changed"], F.lit("mtime")))
        out = out.otherwise(found(F.lit(None).cast("timestamp_ntz"), F.lit("")))
        return let(out, lambda o: F.struct(o["when"].alias("when"), o["basis"].alias("basis"), source.alias("source")))

    fields = ("original", "digitized", "datetime")
    read = F.transform(F.array(*[meta[f"exif_{p}"] for p in fields]), parse_meta_date)
    changed = mtime_to_local(mtime, opts.time_zone) if opts.use_mtime else F.lit(None).cast("timestamp_ntz")
    return let(F.struct(name_date(stem, opts, own).alias("named"), read.alias("read"), shown.alias("shown"), changed.alias("changed")), choose)


def displayed(when: Column) -> Column:
    """The date, and the time unless it is midnight; '' for none."""
    midnight = F.date_format(when, "HH:mm:ss") == "00:00:00"
    return F.coalesce(F.when(midnight, F.date_format(when, "yyyy-MM-dd")).otherwise(F.date_format(when, "yyyy-MM-dd HH:mm:ss")), F.lit(""))
