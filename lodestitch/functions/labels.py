"""Lookup labels: status, file type, languages, suffixes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------
STATUSES = ("none", "queued", "process", "changing", "done", "failed")
STATUS_LABELS = {"none": "未开始", "queued": "队列中", "changing": "转换中", "process": "进行中", "done": "已完成", "failed": "失败"}
FILE_TYPES = {
    "docx": "Word", "doc": "Word", "xlsx": "Excel", "xls": "Excel", "pptx": "PPT", "ppt": "PPT", "pdf": "PDF",
    "txt": "文本", "md": "文本", "csv": "CSV", "json": "JSON", "js": "JS",
}
OTHER_TYPE, UNKNOWN_TYPE, UNKNOWN_STATUS = "其他", "未知", "未知状态"
LANGUAGE_NAMES = {
    "zh": "中文", "en": "英语", "ja": "日语", "ko": "韩语", "fr": "法语", "de": "德语", "es": "西班牙语", "ru": "俄语", "ar": "阿拉伯语",
    "it": "意大利语", "chinese": "中文", "english": "英语", "japanese": "日语", "korean": "韩语", "中文": "中文", "汉语": "中文",
}
LANGUAGE_CODES = {
    "中文": "zh", "英语": "en", "英文": "en", "日语": "ja", "日文": "ja", "法语": "fr", "法文": "fr", "德语": "de", "德文": "de", "俄语": "ru",
    "俄文": "ru", "西班牙语": "es", "西班牙文": "es", "韩语": "ko", "韩文": "ko", "阿拉伯语": "ar", "葡萄牙语": "pt", "意大利语": "it",
}
UPLOAD_TYPES = ("docx", "xlsx", "pptx", "pdf", "txt", "csv", "md", "xls", "doc")
# -------------------------------------------------------------------------------------


def lookup(value: Column, table: dict[str, str]) -> Column:
    """The table's entry; null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), value)


def status_label(status: Column) -> Column:
    return F.coalesce(lookup(status, STATUS_LABELS), F.lit(UNKNOWN_STATUS))


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def file_type(name: Column) -> Column:
    missing = F.coalesce(name == "", F.lit(True))
    return F.when(missing, UNKNOWN_TYPE).otherwise(F.coalesce(lookup(extension(name), FILE_TYPES), F.lit(OTHER_TYPE)))


def language_name(code: Column) -> Column:
    return F.coalesce(lookup(F.lower(code), LANGUAGE_NAMES), code)


def language_code(name: Column) -> Column:
    return F.coalesce(lookup(name, LANGUAGE_CODES), F.lit("en"))


def may_upload(name: Column) -> Column:
    return F.coalesce(F.contains(name, F.lit(".")) & extension(name).isin(*UPLOAD_TYPES), F.lit(False))


def unique_name(name: Column, stamp_ms: Column) -> Column:
    """``name`` with a millisecond stamp before its extension."""
    return F.concat(
        F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), stamp_ms.cast("string"), F.regexp_extract(name, r"\.[^.]*$", 0)
    )


def converted_name(name: Column, converted: Column) -> Column:
    """A PDF that is delivered as docx carries that suffix."""
    return F.when(converted & F.endswith(F.lower(name), F.lit(".pdf")), F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit(".docx"))).otherwise(name)


def effective_status(deleted: Column, status: Column) -> Column:
    """enabled only for what is not deleted and has that status."""
    return F.when(F.coalesce((deleted == "N") & (status == "enabled"), F.lit(False)), "enabled").otherwise("disabled")
