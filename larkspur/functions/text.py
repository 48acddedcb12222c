"""Text functions: Column -> Column, and one Arrow function for Unicode normalisation, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space that texts are trimmed of.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


#: Texts that are Python objects at once; a batch is in Python as Arrow beside them.
SLICE = 64


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode compatibility form; ASCII texts are passed on."""
    form = lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t)
    parts = [pa.array([form(t) for t in texts.slice(i, SLICE).to_pylist()], pa.string()) for i in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def in_order(name: str, collation: str | None = None) -> list[Column]:
    """Sort keys for a column of texts: by bytes, or by a collation (UNICODE is the root locale's) and then by bytes, so that texts
    that count as equal there have an order too."""
    return [F.collate(F.col(name), collation), F.col(name)] if collation else [F.col(name)]


def is_ascii(text: Column) -> Column:
    return F.coalesce(F.octet_length(text) == F.length(text), F.lit(True))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null or white space alone: seen at its first other character."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE[1:]}")


def text_value(value: Column) -> Column:
    """A cell as trimmed text; null is empty."""
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def date_value(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit(""))


def normalize_exact(text: Column, unicode: bool = True) -> Column:
    """Compatibility form without any white space: equal for texts that count as the same."""
    return F.regexp_replace(nfkc(text) if unicode else text, SPACE, "")


def normalize_header(cell: Column) -> Column:
    return strip(nfkc(F.coalesce(cell, F.lit(""))))


def rank_value(text: Column) -> Column:
    """A positive integer up to 2^53 - 1 written in digits, else null; blanks around it and full-width digits count."""
    bare = strip(text)
    # An ASCII character stays one that is no digit, so such texts need no other form.
    plain = nfkc(F.when(~bare.rlike(r"[\x00-/:-\x7F]"), bare))
    n = F.when(plain.rlike("^[0-9]+$"), F.regexp_replace(plain, "^0+(?=[0-9])", "").try_cast("long"))
    return F.when((n > 0) & (n <= (1 << 53) - 1), n)


def _tenths(x: Column) -> Column:
    """The nearest number of tenths of a double that is not negative, by the exact value of its bits, ties up.

    The fraction is split after 26 bits, so twenty times either part has no rounding error; the carry between them is found by a
    comparison that has none either. Twenty times a tie is an odd number.
    """
    whole = F.floor(x)
    fraction = x - whole
    cut = F.lit(float(1 << 26))
    head = F.floor(fraction * cut) / cut
    high, low = head * 20, (fraction - head) * 20
    twentieths = F.floor(high) + (low >= 1 - (high - F.floor(high))).cast("long")
    return whole * 10 + F.shiftright(twentieths + 1, 1)


def percent1(share: Column, unit: str = "%") -> Column:
    """A share in hundredths with one decimal: that nearest to the double's exact value, of two as near the one farther from 0."""
    x = share.cast("double") * 100
    n = _tenths(F.abs(x))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit(unit))


def extract_refs(reason: Column, kind: str) -> Column:
    """Sorted distinct finding or evidence ids in a text; word boundaries are ASCII ones."""
    pattern = r"(?<![A-Za-z0-9_])F[0-9]+(?![A-Za-z0-9_])" if kind == "finding" else r"(?<![A-Za-z0-9_])(?:AGG|DATA)-[A-Za-z0-9:_-]*[A-Za-z0-9_](?![A-Za-z0-9_])"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(reason, F.lit(pattern), 0)))


def quote_contained(text: Column, quote: Column) -> Column:
    return F.coalesce(~is_blank(quote) & F.contains(text, quote), F.lit(False))


def safe_cell(cell: Column, trusted: bool = False) -> Column:
    """Untrusted text that a spreadsheet would take for a formula gets a leading apostrophe."""
    return cell if trusted else F.when(cell.rlike(f"^{SPACE}*[=+\\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def clean_xml_text(text: Column) -> Column:
    """Code points that XML 1.0 does not allow become U+FFFD."""
    last = "".join(chr(0x10000 * p + x) for p in range(1, 17) for x in (0xFFFE, 0xFFFF))
    return F.regexp_replace(text, f"[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}{last}]", "�")


def cell_units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def sanitize_text(text: Column, longest: int) -> Column:
    """Compatibility form, control characters and runs of blanks as one space, trimmed, cut."""
    plain = F.regexp_replace(F.regexp_replace(nfkc(text), r"[\x00-\x1F\x7F]", " "), f"{SPACE}+", " ")
    return F.substring(strip(plain), 1, longest)


def file_extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def label_name(value: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return F.coalesce(F.try_element_at(table, value), value)


# What follows a minute, and what stands for none.
MINUTE_MARK, NO_MINUTE = "（北京时间）", "时间未知"


def beijing_minute(iso: Column) -> Column:
    """An instant as a Shanghai minute, whatever the session's zone; what is no instant as a fixed text.

    A text without a zone is UTC. The wall time is a timestamp without a zone, so nothing prints it in the session's.
    """
    zoned = F.when(iso.rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})\s*$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    shift = F.unix_seconds(F.from_utc_timestamp(F.try_to_timestamp(zoned), "Asia/Shanghai"))
    wall = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=shift.cast("decimal(18,6)"))
    return F.coalesce(F.concat(F.substring(wall.cast("string"), 1, 16), F.lit(MINUTE_MARK)), F.lit(NO_MINUTE))


# Fixed value: what stands for a reason without its audit prefix.
REASON_KEPT = "具体依据已收纳在审计证据中。"


def business_reason(reason: Column, finding_ids: Column, evidence_ids: Column) -> Column:
    """What follows the audit prefix of a reason, else a fixed sentence."""
    prefix = F.concat(F.array_join(finding_ids, "、"), F.lit("｜"), F.array_join(evidence_ids, "、"), F.lit("："))
    tail = F.call_function("substring_index", reason, prefix, F.lit(-1))
    return F.when(F.contains(reason, prefix), tail).otherwise(REASON_KEPT)
