"""Batches of rows for a labeller, its results, and what of them counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import cell_units, in_order, is_blank, quote_contained, strip
from larkspur.operators.joins import join_written
from larkspur.operators.numbering import numbered

LABELS = "struct<labels:array<struct<rowId:bigint,typeId:string,evidenceSource:string,evidenceQuote:string>>>"


def batch_rows(rows: DataFrame, task: str, size: int = 50) -> DataFrame:
    """Adds request_id (task:product:list:number) and place: batches of ``size`` rows of each product and list, in row order.

    Only keys are numbered, which a list of any length allows; the rows join them.
    """
    n = numbered(rows.select("product_id", "sort", "row_id"), ["product_id", "sort"], ["row_id"], "_n").withColumn("_n", F.col("_n") - 1)
    x = rows.join(n.hint("merge"), ["product_id", "sort", "row_id"])
    number = (F.floor(F.col("_n") / size) + 1).cast("string")
    return x.withColumn("place", (F.col("_n") % size + 1).cast("int")).withColumn("request_id", F.concat_ws(":", F.lit(task), "product_id", "sort", number)).drop("_n")


def requests(batched: DataFrame, *columns: str) -> DataFrame:
    """(request_id, n_rows, payload): one JSON text per batch with an id and the given columns of each row, no others."""
    row = F.struct("place", F.col("row_id").alias("rowId"), *columns)
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(r["rowId"].alias("rowId"), *[r[c].alias(c) for c in columns]))
    g = batched.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_rows"), rows.alias("rows"))
    return g.select("request_id", "n_rows", F.to_json(F.struct("rows")).alias("payload"))


def split_results(results: DataFrame, asked: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of results (task, request_id, output) of one task: bad ones, with a code, are of another task or answer a
    request that was not asked. asked: (request_id)."""
    known = asked.select("request_id", F.lit(True).alias("_asked")).distinct()
    x = results.join(known.hint("merge"), "request_id", "left")
    code = F.when(~F.col("task").eqNullSafe(F.lit(task)), "TASK_MISMATCH").when(F.col("_asked").isNull(), "REQUEST_MISMATCH")
    x = x.withColumn("code", code).drop("_asked")
    return x.where("code IS NULL").drop("code"), x.where("code IS NOT NULL").drop("output")


def out_of_domain(labels: DataFrame, types: DataFrame) -> DataFrame:
    """(request_id, position, type_id) of labels whose type is not in the catalog (type_id)."""
    return join_written(labels, types.select("type_id").distinct(), "type_id", "left_anti").select("request_id", "position", "type_id")


def results_in_order(labels: DataFrame, collation: str | None = None) -> DataFrame:
    """(request_id, n): labels of each request, in the order of request ids."""
    return labels.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).orderBy(*in_order("request_id", collation))


def assessments_in_order(assessments: DataFrame, collation: str | None = None) -> DataFrame:
    return assessments.orderBy(*in_order("product_id", collation), "rank", *in_order("review_id", collation))


def parse_results(results: DataFrame) -> DataFrame:
    """(request_id, position, row_id, type_id, quote) of JSON results; a text that is not of the declared form gives no rows."""
    parsed = results.select("request_id", F.from_json("output", LABELS).alias("o")).select("request_id", F.posexplode("o.labels").alias("position", "l"))
    return parsed.select("request_id", "position", F.col("l.rowId").alias("row_id"), F.col("l.typeId").alias("type_id"), F.col("l.evidenceQuote").alias("quote"))


def first_label(labels: DataFrame) -> DataFrame:
    """The first label of each row, by request id, then position."""
    n = F.row_number().over(Window.partitionBy("row_id").orderBy("request_id", "position"))
    return labels.withColumn("n", n).where("n = 1").drop("n")


def attach_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(first_label(labels).select("row_id", "type_id", "quote").hint("merge"), "row_id", "left")


def rejected_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(request_id, position, row_id, why): labels of unknown rows and labels after a row's first."""
    n = F.row_number().over(Window.partitionBy("row_id").orderBy("request_id", "position"))
    known = rows.select("row_id", F.lit(True).alias("known"))
    x = labels.withColumn("n", n).join(known.hint("merge"), "row_id", "left")
    why = F.when(F.col("known").isNull(), "UNKNOWN_ROW").when(F.col("n") > 1, "LABELLED_BEFORE")
    return x.select("request_id", "position", "row_id", why.alias("why")).where("why IS NOT NULL")


def results_for_products(results: DataFrame, products: DataFrame) -> DataFrame:
    """Results of the given products: the request id is task:product or goes on with a colon. The product is taken out of
    the id, so this is an equi-join."""
    product = F.get(F.split("request_id", ":"), F.lit(1))
    return results.join(products.select(F.col("product_id").alias("_product")).hint("merge"), product == F.col("_product"), "left_semi")


def request_coverage(batched: DataFrame, labels: DataFrame) -> DataFrame:
    """Per request: rows asked for without a label, labels of other rows, rows with more than one label."""
    got = labels.groupBy("request_id", "row_id").agg(F.count(F.lit(1)).alias("times"))
    both = batched.select("request_id", "row_id", F.lit(True).alias("asked")).join(got.hint("merge"), ["request_id", "row_id"], "full_outer")
    return both.groupBy("request_id").agg(
        F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("foreign"), F.count_if(F.col("times") > 1).alias("repeated")
    )


def top_if_full(reviews: DataFrame, top: int, collation: str | None = None) -> DataFrame:
    """The first ``top`` default rows of each product that has as many."""
    n = F.row_number().over(Window.partitionBy("product_id").orderBy("rank", *in_order("row_id", collation)))
    first = reviews.where("sort = 'default'").withColumn("n", n).where(F.col("n") <= top)
    full = first.groupBy("product_id").agg(F.max("n").alias("m")).where(F.col("m") == top).select("product_id")
    return first.join(full, "product_id", "left_semi").drop("n")


def quote_check(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", quote_contained(F.col("text"), F.col("quote")).alias("ok"))


def score_consistent(flags: Column, quotes: Column, score: Column, text: Column) -> Column:
    """Whether a score is the number of true flags, each of them with a quote from the text and no other with one."""
    fits = F.forall(F.map_entries(flags), lambda e: F.when(e["value"], F.coalesce(quote_contained(text, F.try_element_at(quotes, e["key"])), F.lit(False))).otherwise(F.coalesce(F.try_element_at(quotes, e["key"]), F.lit("")) == ""))
    return (score == F.size(F.filter(F.map_values(flags), lambda v: v))) & fits


def input_limits(batched: DataFrame, texts: str | list[str], longest: int = 20_000, most: int = 50, longest_id: int = 256) -> DataFrame:
    """(request_id, code) of requests that break a limit: on rows, on ids (1 to 256 units, each once), or on texts.

    Of a row's texts one at least is not blank, none is longer than ``longest`` UTF-16 units or a picture's data address.
    """
    texts = [texts] if isinstance(texts, str) else texts
    row_id = F.col("row_id").cast("string")
    empty = reduce(lambda a, b: a & b, [is_blank(F.col(t)) for t in texts])
    size = F.greatest(F.lit(0), *[F.coalesce(cell_units(F.col(t)), F.lit(0)) for t in texts])
    picture = reduce(lambda a, b: a | b, [F.startswith(strip(F.coalesce(t, F.lit(""))), F.lit("data:image/")) for t in texts])
    g = batched.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.max(size).alias("longest"), F.count_if(empty).alias("empty"),
        F.count_if(is_blank(row_id) | (cell_units(F.coalesce(row_id, F.lit(""))) > longest_id)).alias("bad_ids"), F.count_if(picture).alias("pictures"), F.count("row_id").alias("with_id"),
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("n") > most, "TOO_MANY_ROWS"), F.when(F.col("bad_ids") > 0, "INVALID_ID"), F.when(F.col("ids") < F.col("with_id"), "REPEATED_ID"), F.when(F.col("longest") > longest, "TEXT_TOO_LONG"),
            F.when(F.col("empty") > 0, "EMPTY_TEXT"), F.when(F.col("pictures") > 0, "IMAGE_DATA"),
        )
    )
    return g.select("request_id", F.explode(codes).alias("code"))


# Fixed value: a text that is a code fence, of JSON in any case or of nothing named, and what stands in it.
FENCE = r"(?i)^```(?:json)?\s*([\s\S]*?)\s*```$"


def unwrap_fence(text: Column) -> Column:
    """What stands in a code fence, without blanks around it, even if that is nothing; else the trimmed text."""
    plain = strip(text)
    return F.when(plain.rlike(FENCE), F.regexp_extract(plain, FENCE, 1)).otherwise(plain)


def strict_json_error(text: Column, shape: dict) -> Column:
    """The first fault of a JSON object against a shape, null if there is none.

    A shape names the keys, in the order in which they are checked, and no others are allowed. The value of a key is one of:
    ("enum", names), ("int", low, high), ("number", low, high), ("text", longest), ("bool",), each with "?" after its name if it
    may be null, or ("list", shape) for an array of objects. Faults: NOT_AN_OBJECT, MISSING_KEY, FURTHER_KEY, and
    WRONG_ENUM, WRONG_INT, WRONG_NUMBER, WRONG_TEXT, WRONG_BOOL or WRONG_LIST with the key.
    """
    return _object_fault(text, shape)


def _object_fault(text: Column, shape: dict) -> Column:
    keys, want = F.json_object_keys(text), F.array(*[F.lit(k) for k in shape])
    out = F.when(keys.isNull(), "NOT_AN_OBJECT").when(F.size(F.array_except(want, keys)) > 0, "MISSING_KEY").when(F.size(F.array_except(keys, want)) > 0, "FURTHER_KEY")
    # Values as JSON texts: strings keep their quotes.
    values = F.from_json(text, "map<string,variant>")
    for key, (kind, *more) in shape.items():
        v = F.to_json(F.try_element_at(values, F.lit(key)))
        name = kind.rstrip("?")
        plain = F.coalesce(v, F.lit("null"))
        text_of = F.from_json(F.concat(F.lit('{"v":'), plain, F.lit("}")), "v string")["v"]
        if name == "list":
            fault = F.array_compact(F.transform(F.from_json(plain, "array<variant>"), _fault_of(more[0])))
            out = out.when(~F.startswith(plain, F.lit("[")), F.lit(f"WRONG_LIST {key}")).when(F.size(fault) > 0, F.concat(F.lit(f"{key}: "), F.get(fault, F.lit(0))))
            continue
        if name == "enum":
            good = F.startswith(plain, F.lit('"')) & text_of.isin(*more[0])
        elif name == "text":
            good = F.startswith(plain, F.lit('"')) & (F.length(text_of) <= more[0])
        elif name == "bool":
            good = plain.isin("true", "false")
        else:
            form = r"^-?[0-9]+$" if name == "int" else r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
            good = plain.rlike(form) & plain.try_cast("double").between(more[0], more[1])
        good = F.coalesce(good, F.lit(False)) | (F.lit(kind.endswith("?")) & (plain == "null"))
        out = out.when(~good, F.lit(f"WRONG_{name.upper()} {key}"))
    return out


def _fault_of(shape: dict) -> Callable[[Column], Column]:
    return lambda entry: _object_fault(F.to_json(entry), shape)


def label_shape(text: Column) -> tuple[Column, Column]:
    """Type and topic of a label whose fields have one of several names."""
    get = lambda *names: F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])
    return get("typeId", "category", "tier"), get("topicId", "topic")


def dimension_flags(text: Column, dimensions) -> Column:
    """Flags of dimensions as a map, from a JSON object that has them in ``dimensions`` or beside its other fields; a missing one is false."""
    def flag(d: str) -> Column:
        given = F.coalesce(F.get_json_object(text, f"$.dimensions.{d}"), F.get_json_object(text, f"$.{d}"))
        return F.coalesce(F.lower(given).isin("true", "1"), F.lit(False))

    return F.create_map(*[x for d in dimensions for x in (F.lit(d), flag(d))])
