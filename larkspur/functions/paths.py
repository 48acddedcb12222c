"""Paths of uploaded files: their form, their group, their module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import nfkc, strip

# Folders that hold many groups, folders of content, beginnings of names that say nothing, extensions, keywords.
MANY = r"(?i)^(?:竞品|竞品资料|竞品分析|多竞品|多竞品资料|待分析资料|competitors?|competition|uploads?)$"
CONTENT = r"(?i)^(?:主图|副图|主副图|详情页|评价区|评论区|买家秀|营销文案|视觉|页面框架|图片|文档|素材|images?|documents?|detail|reviews?)$"
SAYS_NOTHING = r"(?i)^(?:页面|图片|主图|副图|详情|评价|评论|买家秀|截图|文件|素材|image|img|page|screen)"
EXTENSIONS = {
    "image": ("jpg", "jpeg", "png", "gif", "webp"),
    "document": ("pdf", "doc", "docx", "ppt", "pptx", "txt", "md"),
    "spreadsheet": ("xls", "xlsx", "csv"),
}
MODULES = {
    "market": ("市场资料", "行业分析", "市场分析", "/market/"),
    "competitor": ("竞品资料", "多竞品", "竞品分析", "/competitor/"),
    "buyer": ("买家秀", "/buyer/", "buyer-show"),
    "detail": ("详情页", "竞品详情", "/detail/", "product-detail"),
    "review": ("评价区", "评价标签", "评论区", "追评", "问大家", "商家回复", "/review/"),
}


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(nfkc(path), r"\\", "/"), "^/+|/+$", "")


def safe_archive_path(path: Column) -> Column:
    """A member's path without empty and dot parts; null if it climbs out or has no parts."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    return F.when((F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def is_system_path(path: Column) -> Column:
    return path.rlike(r"/$|(?:^|/)__MACOSX/|(?:^|/)\.DS_Store$")


def is_temporary(name: Column) -> Column:
    return F.startswith(name, F.lit(".~")) | F.startswith(name, F.lit("~$"))


def _usable(part: Column) -> Column:
    return F.coalesce((part != "") & ~part.rlike(MANY) & ~part.rlike(CONTENT) & ~F.startswith(part, F.lit(".")), F.lit(False))


def clean_group(name: Column) -> Column:
    """A group's name without a leading number, cut."""
    return F.substring(strip(F.regexp_replace(name, r"^[0-9]+[_\-\s]*", "")), 1, 40)


def infer_group(path: Column) -> Column:
    """A normalised path's group: the folder after one that holds many, else an only folder, else the second or the first,
    else the beginning of the file's name; null if none says anything."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    many = F.array_position(F.transform(folders, lambda p: p.rlike(MANY)), F.lit(True))
    at = lambda i: F.get(folders, i)
    after, first, second = at(many.cast("int")), at(F.lit(0)), at(F.lit(1))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")
    prefix = strip(F.get(F.split(stem, r"[_\-\s]+"), F.lit(0)))
    named = F.length(prefix).between(2, 24) & ~prefix.rlike(SAYS_NOTHING)
    return (
        F.when(F.size(parts) == 0, None)
        .when((many > 0) & _usable(after), clean_group(after))
        .when((F.size(folders) == 1) & _usable(first), clean_group(first))
        .when((F.size(folders) >= 2) & _usable(second), clean_group(second))
        .when((F.size(folders) >= 2) & _usable(first), clean_group(first))
        .when(named, clean_group(prefix))
    )


def classify_path(path: Column) -> Column:
    """The first module one of whose keywords a path holds."""
    name = F.lower(F.regexp_replace(nfkc(path), r"\\", "/"))
    out = None
    for module, words in MODULES.items():
        has = F.contains(name, F.lit(words[0]))
        for w in words[1:]:
            has = has | F.contains(name, F.lit(w))
        out = F.when(has, module) if out is None else out.when(has, module)
    return out


def file_type(extension: Column) -> Column:
    out = None
    for kind, names in EXTENSIONS.items():
        out = F.when(extension.isin(*names), kind) if out is None else out.when(extension.isin(*names), kind)
    return out.otherwise("other")
