"""Words in four languages, settings and other small tables, and the checks on them."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .templates import template_problem

# Folder names and source names by language.
WORDS = {
    "en": {"folder_nodate": "No Date", "folder_dupes": "_Duplicates", "folder_heic": "_Original_HEIC", "source_kakao": "KakaoTalk", "source_screenshot": "Screenshots", "source_messenger": "Messengers", "source_camera": "Camera", "source_other": "Other"},
    "ja": {"folder_nodate": "日付なし", "folder_dupes": "_重複", "folder_heic": "_元HEIC", "source_kakao": "KakaoTalk", "source_screenshot": "スクリーンショット", "source_messenger": "メッセンジャー", "source_camera": "カメラ", "source_other": "その他"},
    "ko": {"folder_nodate": "날짜 없음", "folder_dupes": "_중복", "folder_heic": "_원본HEIC", "source_kakao": "카카오톡", "source_screenshot": "스크린샷", "source_messenger": "메신저", "source_camera": "카메라", "source_other": "기타"},
    "zh-CN": {"folder_nodate": "无日期", "folder_dupes": "_重复", "folder_heic": "_原始HEIC", "source_kakao": "KakaoTalk", "source_screenshot": "截图", "source_messenger": "聊天软件", "source_camera": "相机", "source_other": "其他"},
}
# Settings with their defaults, choices and ranges.
SETTINGS = {
    "theme": "light", "pattern": "{yyyy}/{yyyy-mm-dd}", "dest": "", "mode": "move", "rename": False, "use_mtime": False, "include_nodate": False, "year_min": 1990, "year_max": 0, "name_patterns": [],
    "convert": False, "convert_avif": False, "quality": 92, "icc": "keep", "heic_original": "keep", "dedupe": True, "similar": False, "similar_threshold": 6, "jpg_pair_as_dupe": False,
    "dupes_action": "move", "remove_empty": True, "thumbnails": False, "last_log": "", "update_check": True, "update_check_last": "", "update_check_skipped": "",
}
CHOICES = {"theme": ("light", "dark", "system"), "mode": ("move", "copy"), "icc": ("keep", "srgb"), "heic_original": ("keep", "move"), "dupes_action": ("move", "trash")}
RANGES = {"quality": (80, 100), "year_min": (1900, 2100), "year_max": (0, 2100), "similar_threshold": (0, 16)}
#: A version text is at most this long.
VERSION_LENGTH = 32
TEXT_LENGTHS = {"update_check_last": 10, "update_check_skipped": VERSION_LENGTH}


def language_table(spark: SparkSession, words: Mapping[str, Mapping[str, str]] = WORDS) -> DataFrame:
    """lang, key, value: a dimension of a few hundred rows."""
    return spark.createDataFrame([(code, k, v) for code, table in words.items() for k, v in table.items()], "lang string, key string, value string")


def read_language(path: str) -> dict[str, str]:
    """A language's dictionary from a JSON file; {} for what cannot be read or is no object."""
    return {k: v for k, v in _read_object(path).items() if isinstance(v, str)}


def read_settings(path: str) -> dict:
    """Settings from a JSON file, every one checked; see ``coerce_settings``."""
    return coerce_settings(_read_object(path))


def _read_object(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return {}
    return data if isinstance(data, dict) else {}


def coerce_settings(data: Mapping) -> dict:
    """Defaults, replaced by given values of the same type (a boolean is no number), among the choices and in the range.

    Of a list of name patterns the texts that are not blank stay. A folder template that the
    command line would refuse is the default one. Texts about the last check for a newer version are cut to their lengths.
    """
    out = dict(SETTINGS)
    for name in SETTINGS.keys() & data.keys():
        value, default = data[name], SETTINGS[name]
        if type(value) is type(default) and value in CHOICES.get(name, (value,)):
            low, high = RANGES.get(name, (value, value))
            out[name] = value if low <= value <= high else default
    out["name_patterns"] = [p for p in out["name_patterns"] if isinstance(p, str) and p.strip()]
    if not out["pattern"].strip() or template_problem(out["pattern"]):
        out["pattern"] = SETTINGS["pattern"]
    for name, length in TEXT_LENGTHS.items():
        out[name] = out[name].strip()[:length]
    return out


def coerce_column(name: str, value: Column) -> Column:
    """The same for a column of texts of whole numbers or choices, as one setting's values."""
    default = F.lit(SETTINGS[name])
    if name in CHOICES:
        return F.when(value.isin(*CHOICES[name]), value).otherwise(default)
    low, high = RANGES[name]
    number = F.when(value.rlike(r"^-?\d+$"), value.try_cast("long"))
    return F.when(number.between(low, high), number).otherwise(default.cast("long"))


def lookup(keys: DataFrame, languages: DataFrame, lang: str) -> DataFrame:
    """``keys`` (column key) with ``text``: the word in the language, else in English, else the key."""
    own = F.broadcast(languages.where(F.col("lang") == lang).select(F.col("key").alias("k1"), F.col("value").alias("v1")))
    english = F.broadcast(languages.where("lang = 'en'").select(F.col("key").alias("k2"), F.col("value").alias("v2")))
    joined = keys.join(own, F.col("key") == F.col("k1"), "left").join(english, F.col("key") == F.col("k2"), "left")
    return joined.withColumn("text", F.coalesce("v1", "v2", "key")).drop("k1", "v1", "k2", "v2")


def filled(text: str, **values) -> str:
    """A text with its placeholders filled; as it is when they do not fit."""
    try:
        return text.format(**values)
    except (KeyError, IndexError, ValueError):
        return text


def all_values(key: str) -> list[str]:
    """What a word is called in any language."""
    return sorted({table[key] for table in WORDS.values() if key in table})


def special_folders(root: str, dest: str) -> list[str]:
    """Folders a listing never enters: a destination inside the root, and the duplicates and originals folders in every language."""
    root, dest = root.rstrip("/") or "/", (dest or root).rstrip("/") or "/"
    nested = [dest] if dest.lower() != root.lower() and dest.lower().startswith(root.lower().rstrip("/") + "/") else []
    own = [f"{base.rstrip('/')}/{name}" for base in dict.fromkeys((root, dest)) for key in ("folder_dupes", "folder_heic") for name in all_values(key)]
    return nested + own


def special_folders_of(root: Column, dest: Column) -> Column:
    """``special_folders`` of every row's root and destination (null or empty: the root), as an array."""
    bare = lambda path: F.coalesce(F.nullif(F.rtrim(path, F.lit("/")), F.lit("")), F.lit("/"))
    top, to = bare(root), bare(F.coalesce(F.nullif(dest, F.lit("")), root))
    inside = (F.lower(to) != F.lower(top)) & F.lower(to).startswith(F.concat(F.rtrim(F.lower(top), F.lit("/")), F.lit("/")))
    names = F.array(*[F.lit(name) for key in ("folder_dupes", "folder_heic") for name in all_values(key)])
    own = F.transform(F.array_distinct(F.array(top, to)), lambda base: F.transform(names, lambda name: F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), name)))
    return F.concat(F.when(inside, F.array(to)).otherwise(F.array().cast("array<string>")), F.flatten(own))


def is_korean(code: Column, default: str = "en") -> Column:
    """Whether a language code's first part is ko."""
    given = F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit(default))
    return F.lower(F.split(F.translate(given, "_", "-"), "-")[0]) == "ko"


def version_notice(answer: Column, site: str, skipped: Column) -> Column:
    """Struct of latest and url from a JSON answer that names a newer version, null for any doubt about it."""
    get = lambda path: F.get_json_object(answer, f"$.{path}")
    shape = F.from_json(answer, "struct<updateAvailable:boolean,latest:string,url:string,urlEn:string>")
    latest, url = F.trim(shape["latest"]), shape["url"]
    quoted = lambda name: answer.rlike(rf'"{name}"\s*:\s*"')
    good = (get("updateAvailable") == "true") & answer.rlike(r'"updateAvailable"\s*:\s*true') & quoted("latest") & quoted("url")
    good = good & (latest != "") & (F.length(shape["latest"]) <= VERSION_LENGTH) & url.startswith(site) & (latest != F.trim(F.coalesce(skipped, F.lit(""))))
    english = F.when(quoted("urlEn") & shape["urlEn"].startswith(site), shape["urlEn"]).otherwise("")
    return F.when(good, F.struct(latest.alias("latest"), url.alias("url"), english.alias("url_en")))
