"""Inventories of files: groups, types, budgets, manifests; tables in Markdown texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import markdown as M
from larkspur.functions.paths import clean_group, file_type, is_system_path, is_temporary
from larkspur.functions.text import cell_units, file_extension, sanitize_text, strip
from larkspur.operators.joins import join_written
from larkspur.operators.numbering import numbered
from larkspur.plans.spill import written

#: Files that one row of a manifest names at most.
FILES = 1000


def drop_temporary(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files without temporary ones, a warning row (id, code, detail) for each that went)."""
    t = is_temporary(F.element_at(F.split("path", "/"), -1))
    return files.where(~t), files.where(t).select("id", F.lit("TEMPORARY_FILE_IGNORED").alias("code"), F.col("path").alias("detail"))


def expand_inventory(files: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taken, skipped) of uploaded files (id, path, size) and the members of archives among them (archive_id, path, size).

    A member's path stands below its archive's path without extension; its archive itself is not taken. skipped: (id, path, code),
    UNSUPPORTED_FILE or SYSTEM_PATH.
    """
    stem = files.select(F.col("id").alias("archive_id"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"))
    inside = members.join(stem.hint("merge"), "archive_id").select(F.col("archive_id").alias("id"), F.concat_ws("/", "stem", "path").alias("path"), "size")
    plain = files.join(members.select(F.col("archive_id").alias("id")).distinct().hint("merge"), "id", "left_anti").select("id", "path", "size")
    every = plain.unionByName(inside)
    code = F.when(is_system_path(F.col("path")), "SYSTEM_PATH").when(file_type(file_extension(F.col("path"))) == "other", "UNSUPPORTED_FILE")
    every = every.withColumn("code", code)
    return every.where("code IS NULL").drop("code"), every.where("code IS NOT NULL").select("id", "path", "code")


def apply_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds group_name: the trimmed assignment if there is one, else what was detected."""
    given = F.when(strip(F.col("assigned")) != "", strip(F.col("assigned")))
    return files.join(overrides.select("id", "assigned").hint("merge"), "id", "left").withColumn("group_name", F.coalesce(given, "detected")).drop("assigned")


def file_type_counts(files: DataFrame) -> DataFrame:
    kind = file_type(file_extension(F.col("path")))
    return files.withColumn("kind", kind).groupBy("group_name").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("image", "document", "spreadsheet", "other")]
    )


def size_budgets(files: DataFrame, most_files: int, most_bytes: int, most_total: int) -> DataFrame:
    """Per group: files, bytes, largest file and whether a limit is broken."""
    s = files.groupBy("group_name").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_bytes"), F.max("size").alias("largest"))
    return s.withColumn("over", (F.col("files") > most_files) | (F.col("largest") > most_bytes) | (F.col("total_bytes") > most_total))


def group_recognition(files: DataFrame) -> DataFrame:
    """(group_name, position, files): groups in the order in which they first occur; a null group is what no rule names."""
    g = files.groupBy("group_name").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("files"))
    n = numbered(g.withColumn("none", F.col("group_name").isNull()), ["none"], ["first_id"], "position")
    return n.select("group_name", F.col("position").cast("int").alias("position"), "files")


def recognise(files: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, entries, unclassified) of files (id, path, group_name, of apply_overrides) and further names (name, position).

    Names are cleaned as folders are: no leading number, 40 characters. Groups stand in the order of the further names, then of
    their first file; a further name without files is a group too. groups: (group_name, position, files and counts by type); entries: (group_name,
    id). A null name is unclassified (id); a name of which nothing is left is no group, and its files are neither.
    """
    named = files.withColumn("group_name", clean_group(F.col("group_name")))
    order = named.where("group_name <> ''").groupBy("group_name").agg(F.min(F.struct(F.lit(1).alias("late"), F.col("id").alias("place"))).alias("o"))
    if extra is not None:
        more = extra.select(clean_group(F.col("name")).alias("group_name"), F.struct(F.lit(0).alias("late"), F.col("position").cast(files.schema["id"].dataType).alias("place")).alias("o")).where("group_name <> ''")
        order = order.unionByName(more).groupBy("group_name").agg(F.min("o").alias("o"))
    places = numbered(order.select("group_name", "o.late", "o.place"), [], ["late", "place", "group_name"], "position").select("group_name", F.col("position").cast("int").alias("position"))
    counts = file_type_counts(named.where("group_name <> ''")).withColumn("files", F.col("image_count") + F.col("document_count") + F.col("spreadsheet_count") + F.col("other_count"))
    groups = places.join(counts.hint("merge"), "group_name", "left").fillna(0)
    return groups, named.where("group_name <> ''").select("group_name", "id"), files.where("group_name IS NULL").select("id")


# Groups and files of a manifest that count, units of a name, of a file and of the whole.
MANIFEST_GROUPS, MANIFEST_FILES, NAME_UNITS, FILE_UNITS, MANIFEST_UNITS = 20, 80, 40, 240, 30_000


def manifest_text(manifests: DataFrame) -> DataFrame:
    """(id, text) of manifests (id, manifest): a JSON object of groups with names and files as numbered lines, else an empty text.

    The first 20 groups count and the first 80 files of each, at the places where they stand; names are cut to 40 and files to
    240 characters, in compatibility form and without control characters; blank files go, then groups without a name or files. What
    is no JSON, longer than 30,000 units, has no array of groups or a null among them is empty. A manifest is bounded so, and its
    parts meet again by its id.
    """
    v = F.try_parse_json("manifest")
    groups = F.slice(F.try_variant_get(v, "$.groups", "array<variant>"), 1, MANIFEST_GROUPS)
    fits = cell_units(F.coalesce("manifest", F.lit(""))) <= MANIFEST_UNITS
    kept = F.when(fits & F.coalesce(F.forall(groups, lambda g: ~F.is_variant_null(g)), F.lit(False)), groups)
    text_of = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise("")
    rows = manifests.select("id", F.posexplode_outer(kept).alias("g", "v")).select("id", "g", text_of(F.try_variant_get("v", "$.name", "variant")).alias("name"), F.slice(F.try_variant_get("v", "$.files", "array<variant>"), 1, MANIFEST_FILES).alias("files"))
    rows = rows.select("id", "g", "name", F.posexplode_outer("files").alias("f", "file")).withColumn("file", F.coalesce(text_of(F.col("file")), F.lit("")))
    rows = rows.select("id", "g", sanitize_text(F.coalesce("name", F.lit("")), NAME_UNITS).alias("name"), "f", sanitize_text(F.col("file"), FILE_UNITS).alias("file"))
    files = F.transform(F.array_sort(F.collect_list(F.when(F.col("file") != "", F.struct("f", "file")))), lambda x: x["file"])
    lines = rows.groupBy("id", "g").agg(F.first("name").alias("name"), files.alias("files")).withColumn("line", F.when((F.col("name") != "") & (F.size("files") > 0), F.concat("name", F.lit("："), F.array_join("files", "、"))))
    whole = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("g", "line")))).alias("l"))
    numbered_lines = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"]))
    return whole.select("id", F.array_join(numbered_lines, "\n").alias("text"))


def manifest_caps(files: DataFrame, groups: int, per_group: int) -> DataFrame:
    """Files of the first groups, as many of each: groups by their first id, files by id."""
    first = files.groupBy("group_name").agg(F.min("id").alias("first_id")).where(F.col("group_name").isNotNull()).orderBy("first_id").limit(groups)
    order = Window.partitionBy("group_name").orderBy("id")
    return files.join(first.select("group_name"), "group_name", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_group).drop("n")


def group_manifest(files: DataFrame) -> DataFrame:
    """(group_name, part, manifest): a JSON object of each group's name and files in order, 1,000 files a part; files of no
    group are a group without a name, the unclassified ones."""
    n = numbered(files.select("group_name", "id", "path"), ["group_name"], ["id", "path"])
    part = (F.floor((F.col("n") - 1) / FILES) + 1).alias("part")
    g = n.groupBy("group_name", part).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("files"))
    named = F.to_json(F.struct(F.col("group_name").alias("name"), "files"))
    return g.select("group_name", "part", F.when(F.col("group_name").isNull(), F.to_json(F.struct(F.col("files").alias("unclassified")))).otherwise(named).alias("manifest"))


def module_counts(files: DataFrame, module: Column, modules) -> DataFrame:
    """Files of each module, with modules without files, and those of none as unclassified. Both tables have a row per module."""
    names = files.sparkSession.createDataFrame([(m,) for m in [*modules, "unclassified"]], "module string")
    n = files.select(F.coalesce(module, F.lit("unclassified")).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    return names.join(F.broadcast(n), "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("files"))


def markdown_tables(lines: DataFrame) -> DataFrame:
    """(doc, table_no, row_no, name, cells) as markdown_rows() gives them, of texts that are tables of lines (doc, pos, line).

    ``pos`` counts a text's lines without gaps. Lines are dealt by ranges of text and place, and what a range must know of those
    before it is carried over from one row per range and text: how many lines without pipes there were, where the island that
    goes on began its table and how wide that is, the last heading and how many tables there were; and whether the line after it is a
    separator. So a text of any length is many tasks. Windows stay within ranges; those over carried rows have a row per range.
    """
    title = F.regexp_extract(strip(F.col("line")), r"^#{1,6}\s+(.+)$", 1)
    x = lines.select("doc", F.coalesce(F.concat(F.lit("="), F.col("doc").cast("string")), F.lit("")).alias("_d"), "pos", "line").repartitionByRange("_d", "pos").withColumn("_r", F.spark_partition_id())
    x = x.withColumn("cells", M.split_row(F.col("line"))).withColumn("piped", F.col("cells").isNotNull()).withColumn("title", title).drop("line")
    x = written(x.withColumn("separator", M.is_separator(F.col("cells"))))
    key = ["_d", "_r"]
    ranges, local = Window.partitionBy("_d").orderBy("_r"), Window.partitionBy(*key).orderBy("pos")
    before, so_far = ranges.rowsBetween(Window.unboundedPreceding, -1), local.rowsBetween(Window.unboundedPreceding, 0)

    ends = x.groupBy(*key).agg(F.min_by("separator", "pos").alias("_s"), F.count_if(~F.col("piped")).alias("_n"))
    carried = ends.select(*key, F.coalesce(F.lead("_s").over(ranges), F.lit(False)).alias("_next"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_islands"))
    x = join_written(x, carried, key).withColumn("island", F.col("_islands") + F.sum(F.when(F.col("piped"), 0).otherwise(1)).over(so_far))
    x = x.withColumn("starts", F.col("piped") & (F.col("title") == "") & F.coalesce(F.lead("separator").over(local), F.col("_next")))
    own = Window.partitionBy(*key, "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = written(x.withColumn("own", F.min(F.when(F.col("starts"), F.struct(F.col("pos").alias("at"), F.size("cells").alias("width")))).over(own)).drop("_next", "_islands", "separator", "starts"))

    ends = x.groupBy(*key).agg(F.min("island").alias("_first"), F.max("island").alias("_last"), F.max_by("own", "pos").alias("_own"))
    ends = ends.withColumn("_own", F.min("_own").over(Window.partitionBy("_d", "_last").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    goes_on = F.lag("_last").over(ranges) == F.col("_first")
    carried = ends.select(*key, "_first", F.when(goes_on, F.lag("_own").over(ranges)).alias("_start"))
    x = join_written(x, carried, key).withColumn("start", F.coalesce(F.when(F.col("island") == F.col("_first"), F.col("_start")), "own"))
    x = x.withColumn("inside", F.col("piped") & F.col("start").isNotNull()).withColumn("begins", F.coalesce(F.col("piped") & (F.col("pos") == F.col("start.at")), F.lit(False)))
    x = x.withColumn("heading", F.when(~F.col("inside") & (F.col("title") != ""), M.clean_heading(F.col("title"))))
    x = written(x.select("doc", *key, "pos", "cells", "inside", "begins", "heading", "start"))

    ends = x.groupBy(*key).agg(F.max(F.when(F.col("heading").isNotNull(), F.struct("pos", "heading"))).alias("_h"), F.count_if("begins").alias("_t"))
    carried = ends.select(*key, F.last("_h.heading", ignorenulls=True).over(before).alias("_heading"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_tables"))
    x = join_written(x, carried, key)
    x = x.withColumn("name", F.coalesce(F.last("heading", ignorenulls=True).over(so_far), "_heading")).withColumn("table_no", (F.col("_tables") + F.sum(F.col("begins").cast("int")).over(so_far)).cast("int"))
    x = x.where(F.col("inside") & (F.col("pos") != F.col("start.at") + 1))
    row_no = F.when(F.col("begins"), 0).otherwise(F.col("pos") - F.col("start.at") - 1).cast("int")
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("分析表 "), "table_no"))
    return x.select("doc", "table_no", row_no.alias("row_no"), name.alias("name"), M.fit_width(F.col("cells"), F.col("start.width")).alias("cells"))


def markdown_rows(texts: DataFrame) -> DataFrame:
    """(doc, table_no, row_no, name, cells) of every table in (doc, markdown); row 0 is the header.

    Lines with pipes that follow each other are an island; its table starts at the first line that is no heading and whose next is a
    separator, which is left out. The latest heading outside islands names the table, else its number does. A text's lines are ordered by window.
    """
    lines = texts.select("doc", F.posexplode(F.split(F.regexp_replace("markdown", "\r\n?", "\n"), "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("cells", M.split_row(F.col("line"))).withColumn("piped", F.col("cells").isNotNull())
    x = x.withColumn("island", F.sum(F.when(F.col("piped"), 0).otherwise(1)).over(so_far)).withColumn("separator", M.is_separator(F.col("cells")))
    title = F.regexp_extract(strip(F.col("line")), r"^#{1,6}\s+(.+)$", 1)
    x = x.withColumn("starts", F.col("piped") & (title == "") & F.coalesce(F.lead("separator").over(order), F.lit(False)))
    island = Window.partitionBy("doc", "island")
    x = x.withColumn("start", F.min(F.when(F.col("starts"), F.col("pos"))).over(island))
    in_table = F.col("piped") & (F.col("pos") >= F.col("start"))
    heading = F.when(~F.coalesce(in_table, F.lit(False)) & (title != ""), M.clean_heading(title))
    x = x.withColumn("name", F.last(heading, ignorenulls=True).over(so_far)).where(in_table & (F.col("pos") != F.col("start") + 1))
    x = x.withColumn("width", F.max(F.when(F.col("pos") == F.col("start"), F.size("cells"))).over(island))
    x = x.withColumn("table_no", F.dense_rank().over(Window.partitionBy("doc").orderBy("start")))
    row_no = F.when(F.col("pos") == F.col("start"), 0).otherwise(F.col("pos") - F.col("start") - 1)
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("分析表 "), "table_no"))
    return x.select("doc", "table_no", row_no.alias("row_no"), name.alias("name"), M.fit_width(F.col("cells"), F.col("width")).alias("cells"))
