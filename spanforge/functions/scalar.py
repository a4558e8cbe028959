"""Type coercion as Column expressions; all run inside generated code, ANSI stays on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge import schema as S


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body reads it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at the ends; the pattern runs only where an end is not a printed ASCII sign."""
    printed = lambda at: F.substring(c, at, 1).between("!", "~")
    return F.when(printed(1) & printed(-1), c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def to_text(c: Column) -> Column:
    """Null is an empty text; white space at the ends goes."""
    return F.coalesce(stripped(c.cast("string")), F.lit(""))


def to_number(c: Column, digits: int) -> Column:
    """Separators and words around the number go; what is no number then is null."""
    t = stripped(F.translate(c.cast("string"), ",， ", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)^[^\d.\-]+", ""), r"(?U)[^\d.]+$", "")
    return F.round(t.try_cast("double"), digits)


def to_date(c: Column) -> Column:
    """YYYYMMDD as text. Eight digits pass unchecked; years before 1911 count from 1911."""
    # Separators are removed and each part is held in a fixed place: one pass of one pattern a value.
    t = F.translate(to_text(c), ". ", "/")
    made = F.regexp_replace(t, r"^(\d{3,4})[/-](\d{1,2})[/-](\d{1,2})$", "$1/0$2/0$3/")

    def parts(p: Column) -> Column:
        piece = lambda k: F.get(p, F.lit(k)).try_cast("int")
        two = lambda k: F.right(F.get(p, F.lit(k)), F.lit(2))
        year = F.lpad(F.when(piece(0) < 1911, piece(0) + 1911).otherwise(piece(0)).cast("string"), 4, "0")
        whole = F.get(p, F.lit(0))
        return F.when((F.size(p) == 1) & whole.rlike(r"^\d{8}$"), whole).when((F.size(p) == 4) & piece(1).between(1, 12) & piece(2).between(1, 31), F.concat(year, two(1), two(2))).otherwise("")

    return let(F.split(made, "/"), parts)


def to_width(c: Column) -> Column:
    return F.regexp_replace(to_text(c), r"(?U)\D", "")


def to_unit(c: Column) -> Column:
    """The code of a known unit word, else the word itself."""
    t = to_text(c)
    table = F.create_map(*[F.lit(x) for kv in S.UNITS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.replace(t, F.lit(" "), F.lit("")))), t)


def coerce(field: str, c: Column) -> Column:
    """The rule of a field."""
    if field in S.DIGITS:
        return to_number(c, S.DIGITS[field])
    return {"NEED_DATE": to_date, "WIDE": to_width, "UNIT": to_unit}.get(field, to_text)(c)


def header_key(c: Column) -> Column:
    return F.coalesce(F.upper(F.regexp_replace(F.translate(c, S.WIDE_ASCII, S.PLAIN_ASCII), r"(?U)[\s/\\|\-_]", "")), F.lit(""))


def _aliases() -> Column:
    return F.array(*[F.struct(F.lit(len(k)).alias("len"), F.lit(-i).alias("ord"), F.lit(f).alias("field"), F.lit(k).alias("key")) for f, k, i in S.ALIAS_KEYS])


def _has_ignored(key: Column) -> Column:
    return F.exists(_words(S.IGNORED_KEYS), lambda w: F.contains(key, w))


def header_field(c: Column) -> Column:
    """Longest alias in the header, the earlier of equals; null for ignored headers and no alias."""
    best = lambda key: F.array_max(F.filter(_aliases(), lambda a: F.contains(key, a["key"])))["field"]
    return let(header_key(c), lambda key: F.when(~_has_ignored(key), best(key)))


def header_ignored(c: Column) -> Column:
    return let(header_key(c), _has_ignored)


def resolve_field(c: Column) -> Column:
    """A field name itself, else the field of a header."""
    return F.when(c.isin(*S.FIELDS), c).otherwise(header_field(c))


def header_candidates(c: Column) -> Column:
    """All fields with an alias in a (merged) header: longest alias first, then name, both descending."""

    def found(key: Column) -> Column:
        per_field = []
        for field in S.ALIASES:
            keys = [k for f, k, _ in S.ALIAS_KEYS if f == field]
            length = F.array_max(F.transform(F.filter(_words(keys), lambda k: F.contains(key, k)), F.length))
            per_field.append(F.struct(length.alias("len"), F.lit(field).alias("field")))
        return F.transform(F.reverse(F.array_sort(F.filter(F.array(*per_field), lambda x: x["len"].isNotNull()))), lambda x: x["field"])

    return let(header_key(c), found)


def code_changed(c: Column) -> Column:
    """Do a colour code at the start and one in brackets differ in O and 0 alone?"""
    p1, p2 = (F.regexp_extract(c, r"^([0O])([A-Z]{2})", k) for k in (1, 2))
    b1, b2 = (F.regexp_extract(c, r"/\(([0O])([A-Z]{2})\)", k) for k in (1, 2))
    return F.coalesce((p1 != "") & (b1 != "") & (p2 == b2) & (p1 != b1), F.lit(False))


def repair_code(c: Column) -> Column:
    return F.when(code_changed(c), F.concat(F.lit("0"), F.substring(c, 2, 2**31 - 1))).otherwise(c)


def answer_null(c: Column) -> Column:
    """Words for "no field" become null."""
    t = stripped(c)
    return F.when(~F.lower(t).isin(*S.ANSWER_NULL_WORDS), t)


def answer_field(c: Column) -> Column:
    t = answer_null(c)
    return F.coalesce(resolve_field(t), t)


def diff_shape(expected: Column, actual: Column) -> Column:
    """The kind of a difference; with both values it names a group of like errors."""
    e, a = to_text(expected), to_text(actual)
    digits = lambda x: F.regexp_replace(x, r"(?U)\D", "")
    return (
        F.when((e == "") | (a == ""), "one side empty").when((F.length(e) == F.length(a)) & (e != a), "same length")
        .when(F.replace(e, F.lit(","), F.lit("")) == F.replace(a, F.lit(","), F.lit("")), "separators").when(digits(e) == digits(a), "same digits").otherwise("other")
    )


def diff_marks(expected: Column, actual: Column) -> Column:
    """A caret under each character that differs."""
    chars = lambda x: F.split(x, "")
    return F.array_join(F.zip_with(chars(to_text(expected)), chars(to_text(actual)), lambda x, y: F.when(x.eqNullSafe(y), " ").otherwise("^")), "")


def display_width(c: Column) -> Column:
    """Columns on a terminal: wide and full-width characters take two."""
    wide = "[\u1100-\u115f\u2e80-\u303e\u3041-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff01-\uff60\uffe0-\uffe6\\x{20000}-\\x{3fffd}]"
    return F.length(c) + F.regexp_count(c, F.lit(wide))


def padded(c: Column, width: int) -> Column:
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - display_width(c))))


def local_time(c: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'+08:00'") -> Column:
    """A UTC timestamp as text at UTC+8."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("+08:00"), c.cast("timestamp_ntz")), pattern)


def time_slug(c: Column) -> Column:
    """A UTC timestamp as a part of file names, at UTC+8."""
    return local_time(c, "yyyyMMdd-HHmmss")
