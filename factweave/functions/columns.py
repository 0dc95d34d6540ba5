"""Column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; Spark's trim() knows the space alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def stripped(c: Column) -> Column:
    """The same of a column that costs nothing to name: the pattern is searched where an end is white space."""
    blank = lambda x: x.rlike(r"(?U)\s")
    return F.when(blank(F.substring(c, 1, 1)) | blank(F.substring(c, -1, 1)), strip(c)).otherwise(c)


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def word_count(c: Column) -> Column:
    return F.size(find_all(c, r"(?U)\S+"))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def float_text(v: Column) -> Column:
    """A double as Python writes it: in full from 1e-4 up to 1e16, with an exponent of two digits outside; Spark itself goes
    over to exponents at 1e7 and below 1e-3."""
    java = v.cast("string")
    mantissa, power = F.regexp_extract(java, r"^(-?[0-9.]+)E", 1), F.regexp_extract(java, r"E(-?[0-9]+)\z", 1).try_cast("int")
    full = F.regexp_replace(F.regexp_replace(java.try_cast("decimal(38,22)").cast("string"), r"0+\z", ""), r"\.\z", ".0")
    sign = F.when(power < 0, "-").otherwise("+")
    short = F.concat(F.regexp_replace(mantissa, r"\.0\z", ""), F.lit("e"), sign, F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    named = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return F.when(v.isNull(), None).when(~java.contains("E"), F.coalesce(named, java)).when(power.between(-4, 15), full).otherwise(short)


def to_number(c: Column) -> Column:
    """What Python's float() makes of a text, null where it refuses; Spark's own cast takes some suffixes."""
    text = F.regexp_replace(strip(c), "(?<=[0-9])_(?=[0-9])", "")
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    named = F.lower(text).rlike(r"^[+-]?(inf|infinity|nan)\z")
    special = F.when(F.lower(text).contains("nan"), F.lit(float("nan"))).when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(plain, text.try_cast("double")).when(named, special)


def money_value(c: Column) -> Column:
    """Number times its suffix: words in any case, single letters as capitals; null where no number is left."""
    return money_number(money_text(c))


def money_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[$,]", ""))


def money_number(text: Column) -> Column:
    """The same of a text without its signs."""
    low = F.lower(text)
    billion, million, thousand = low.contains("billion") | text.endswith("B"), low.contains("million") | text.endswith("M"), text.endswith("K")
    number = lambda pattern: to_number(F.regexp_replace(text, pattern, ""))
    return F.when(billion, number(r"(?i)billion|B\z") * 1e9).when(million, number(r"(?i)million|M\z") * 1e6).when(thousand, number(r"K\z") * 1e3).otherwise(to_number(text))


def parse_value(c: Column) -> Column:
    """The number in a model's answer: as money_value, but every b or m goes once a suffix was seen, and K is none."""
    text = strip(F.regexp_replace(c, r"[$,%]", ""))
    low = F.lower(text)
    billion, million = low.contains("billion") | text.endswith("B"), low.contains("million") | text.endswith("M")
    number = lambda word, letter: to_number(F.replace(F.replace(low, F.lit(word), F.lit("")), F.lit(letter), F.lit("")))
    return F.when(billion, number("billion", "b") * 1e9).when(million, number("million", "m") * 1e6).otherwise(to_number(text))


def parse_unit(c: Column) -> Column:
    return F.when(c.contains("$"), "USD").when(c.contains("%"), "%")


def coord_id(major: Column, type_: Column, subtype: Column, instance: Column) -> Column:
    return F.format_string("%02d-%02d-%02d-%04d", major, type_, subtype, instance)


def coord_parts(node_id: Column) -> list[Column]:
    return [F.split(node_id, "-")[k].cast("int").alias(n) for k, n in enumerate(("major", "type", "subtype", "instance"))]


def coord_valid(major: Column, type_: Column, subtype: Column, instance: Column) -> Column:
    return major.between(1, 8) & type_.between(0, 99) & subtype.between(0, 99) & instance.between(0, 9999)


def distance(a: list[Column], b: list[Column], weights: tuple = (1.0, 0.5, 0.3, 0.1)) -> Column:
    """Weighted Euclidean distance of two coordinates."""
    total = None
    for x, y, w in zip(a, b, weights, strict=True):
        term = F.lit(w) * (x - y) * (x - y)
        total = term if total is None else total + term
    return F.sqrt(total)


def spaced_label(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def dedup_key(label: Column, value_str: Column, unit: Column) -> Column:
    return F.concat_ws("|", label, F.coalesce(value_str, F.lit("None")), F.coalesce(unit, F.lit("None")))


def contains_any(c: Column, words: tuple | list) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out
