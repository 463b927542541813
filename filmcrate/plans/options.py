"""Options of a run, and the overrides a user makes."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from ..functions import labels
from ..functions.dates import DateOptions
from ..functions.templates import DEFAULT_TEMPLATE

OVERRIDES = "key string, date timestamp_ntz, dup boolean, unchecked boolean"


@dataclass(frozen=True)
class Options:
    root: str
    dest: str = ""
    mode: str = "move"
    template: str = DEFAULT_TEMPLATE
    rename: bool = False
    include_nodate: bool = False
    convert: bool = False
    convert_avif: bool = False
    heic_only: bool = False
    heic_original: str = "keep"
    remove_empty: bool = True
    dupes_action: str = "move"
    jpg_pair_as_dupe: bool = False
    dates: DateOptions = field(default_factory=DateOptions)
    language: str = "en"
    case_insensitive: bool = True

    @property
    def target(self) -> str:
        return (self.dest or self.root).rstrip("/") or "/"

    def word(self, key: str) -> str:
        return labels.WORDS.get(self.language, labels.WORDS["en"]).get(key, key)

    @property
    def source_names(self) -> dict[str, str]:
        return {s: self.word(f"source_{s}") for s in ("kakao", "screenshot", "messenger", "camera", "other")}


def from_settings(settings: dict, root: str, dest: str = "", mode: str = "", heic_only: bool = False, convert: bool | None = None, now: datetime.datetime | None = None, time_zone: str = "UTC", **more) -> Options:
    """Options of checked settings. Dates up to a day after ``now`` (local time) count; without it those of ``DateOptions``. Conversion is off where the JPG of a pair counts as a duplicate, unless only conversion is asked for."""
    wants = settings["convert"] if convert is None else convert
    return Options(
        root=root,
        dest=dest or settings["dest"] or root,
        mode=mode or settings["mode"],
        template=settings["pattern"],
        convert=wants and (heic_only or not settings["jpg_pair_as_dupe"]),
        heic_only=heic_only,
        dates=DateOptions(**({"as_of": now} if now else {}), time_zone=time_zone, use_mtime=settings["use_mtime"], year_min=settings["year_min"], year_max=settings["year_max"], user_patterns=tuple(settings["name_patterns"])),
        **{k: settings[k] for k in ("rename", "include_nodate", "convert_avif", "heic_original", "remove_empty", "dupes_action", "jpg_pair_as_dupe")},
        **more,
    )
