"""Shape-preserving masks, as expressions over characters, and their audit."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge import schema as S

#: Fixed value: fragments that must not survive.
SENSITIVE = r"(?i)保\d|正\d|興業|股份|有限|公司|供應商|致\s|地址|彰化|社頭|鄉|巷|路|電話|TEL|FAX|統編|統一編號|列印編號|幣別|新台幣|需\s*求|EPM\d"


def _one_of(letters: str, k: Column) -> Column:
    """A character of a ring of letters."""
    return F.substring(F.lit(letters), (F.pmod(k, F.lit(len(letters))) + 1).cast("int"), F.lit(1))


def _by_class(text: Column, seq: Column, digit) -> Column:
    """Digits by rule, letters around a ring by their place; everything else stays."""
    one = lambda ch, i: F.when(ch.between("0", "9"), digit(i)).when(ch.between("A", "Z"), _one_of(S.MASK_LETTERS, seq + i)).when(ch.between("a", "z"), _one_of(S.MASK_LETTERS.lower(), seq + i)).otherwise(ch)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def order_like(text: Column, seq: Column) -> Column:
    """Digits and letters replaced by class; a first digit becomes 6."""
    return _by_class(text, seq, lambda i: F.when(i == 0, "6").otherwise(F.pmod(seq + i, F.lit(10)).cast("string")))


def code_like(text: Column, seq: Column) -> Column:
    return F.when(F.length(text) == 0, "X").otherwise(_by_class(text, seq, lambda i: F.pmod(seq * 3 + i, F.lit(10)).cast("string")))


def desc_like(text: Column, seq: Column) -> Column:
    """Each character replaced inside its class by a rule of its own value and seq, so what is equal
    in a text stays equal (a colour code and its repetition); 0 and O stay, as code repair hangs on
    them; spaces and punctuation stay."""

    upper, digits, n = "ABCDEFGHIJKLMNPQRSTUVWXYZ", "123456789", len(S.MASK_LETTERS)
    ring = lambda k: "".join(S.MASK_LETTERS[((ord(ch) - 65) * 7 + k * 3) % n] for ch in upper)
    small = lambda k: "".join(S.MASK_LETTERS.lower()[((ord(ch) - 97) * 7 + k * 3) % n] for ch in string.ascii_lowercase)
    letters = F.element_at(F.array(*[F.lit(ring(k) + small(k)) for k in range(n)]), (F.pmod(seq, F.lit(n)) + 1).cast("int"))
    numbers = F.element_at(F.array(*[F.lit("".join(str((2 * d + k) % 9 + 1) for d in range(9))) for k in range(9)]), (F.pmod(seq, F.lit(9)) + 1).cast("int"))
    plain = F.call_function("translate", text, F.lit(upper + string.ascii_lowercase + digits), F.concat(letters, numbers))
    sign = lambda ch: F.when(ch.between("\u3400", "\u9fff"), _one_of(S.MASK_SIGNS, F.ascii(ch) + seq)).otherwise(ch)
    return F.when(text.rlike("[\\x{3400}-\\x{9fff}]"), F.array_join(F.transform(F.split(plain, ""), sign), "")).otherwise(plain)


def _moved(text: Column, n: Column, shift: int) -> Column:
    """The first n digits as a number moved by shift, in as many digits; the rest stays."""
    number = F.pmod(F.left(text, n).try_cast("long") + shift, F.pow(F.lit(10.0), n).cast("long"))
    return F.when(n > 0, F.concat(F.lpad(number.cast("string"), n, F.lit("0")), F.substring(text, n + 1, F.length(text)))).otherwise(text)


def _leading_digits(text: Column) -> Column:
    return F.length(F.regexp_extract(text, "^[0-9]{0,15}", 0))


def width_like(text: Column, shift: int = 1) -> Column:
    """The whole number in front moved by shift within its digits; fraction and unit stay."""
    return _moved(text, _leading_digits(text), shift)


def date_like(text: Column, shift: int = 1) -> Column:
    """The year moved within its digits: four of an eight-digit date, else two to four in front; what is no date stays."""
    n = _leading_digits(text)
    return _moved(text, F.when(n == 8, 4).when(n.between(2, 4), n).otherwise(0), shift)


def unit_like(text: Column, seq: Column) -> Column:
    """Another known unit word of the same length, as far along the sorted words as seq tells; an unknown word is masked as a description."""
    rings = {}
    for word in sorted(S.UNITS):
        rings.setdefault(len(word), []).append(word)
    out = desc_like(text, seq)
    for words in rings.values():
        ring = F.array(*[F.lit(w) for w in words])
        out = F.when(F.array_contains(ring, text), F.element_at(ring, (F.pmod(F.array_position(ring, text) + seq, F.lit(len(words))) + 1).cast("int"))).otherwise(out)
    return out


def first_seen(df: DataFrame, column: str, order: str, by: str) -> DataFrame:
    """Adds <column>_seq: the rank of a value by first appearance within by, from 0. All rows of by
    are dealt together once, for whatever number of columns."""
    first = df.withColumn("__first", F.min(order).over(W.partitionBy(by, column)))
    return first.withColumn(f"{column}_seq", F.dense_rank().over(W.partitionBy(by).orderBy("__first", column)) - 1).drop("__first")


#: Columns masked by the rank of their value in the document.
RANKED = ("part_no", "descr", "unit", "cust")


def _ranked(raw: DataFrame) -> DataFrame:
    """Adds the ranks; a row without one of the ranked values, or without a document, is left out."""
    df = raw
    for c in RANKED:
        df = first_seen(df, c, "rec_seq", "doc_id")
    return df.dropna(subset=["doc_id", *RANKED])


def _mask(column: str, text: Column, seq: Column) -> Column:
    """The mask of a column, which hangs on its text and a number only; but for order numbers, what is empty stays."""
    if column == "ord_no":
        return order_like(text, seq)
    return F.when(text == "", text).otherwise({"part_no": code_like, "descr": desc_like, "unit": unit_like, "cust": code_like, "width": lambda t, _: width_like(t), "need_date": lambda t, _: date_like(t)}[column](text, seq))


#: Columns with a mask; the others stay.
MASKED = ("ord_no", *RANKED, "width", "need_date")


def _seq(column: str) -> Column:
    """The number that a column's mask hangs on besides the text."""
    return F.col("rec_seq") - 1 if column == "ord_no" else F.col(f"{column}_seq") if column in RANKED else F.lit(0)


def anonymize(raw: DataFrame) -> DataFrame:
    """raw_orders rows with masked cells; equal values of a document stay equal, numbers stay."""
    cells = [c for c in raw.columns if c not in ("doc_id", "rec_seq")]
    masked = [(_mask(c, F.col(c), _seq(c)) if c in MASKED else F.col(c)).alias(c) for c in cells]
    return _ranked(raw).select("doc_id", "rec_seq", *masked)


def _shape(text: Column) -> Column:
    """One digit and one letter of each case for all: masks by class read no more of a text."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return F.translate(text, string.digits + upper + lower, "0" * 10 + "A" * 26 + "a" * 26)


def _judged(cells: DataFrame, columns: tuple[str, ...], sensitive: str) -> DataFrame:
    """The audit of cells (k: a place in columns, v, b and a: how often v stands before and after). Each
    different value is looked at once."""
    values = cells.groupBy("k", "v").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))

    def side(n: str) -> list[Column]:
        there, known = F.col(n) > 0, F.col("v").isNotNull()
        return [
            F.array_sort(F.collect_set(F.when(there, F.length("v")))).alias(f"len_{n}"), F.sum(F.when(F.contains("v", F.lit(",")), F.col(n)).otherwise(0)).alias(f"commas_{n}"),
            F.count_if(there & known).alias(f"kinds_{n}"), F.sum(n).alias(f"rows_{n}"),
        ]

    leaks = F.sum(F.when((F.col("a") > 0) & F.col("v").rlike(sensitive), F.col("a")).otherwise(0)).alias("leaks")
    both = values.groupBy("k").agg(*side("b"), *side("a"), leaks).where("rows_b > 0 AND rows_a > 0")
    ratio = F.round(F.try_divide("kinds_a", "kinds_b"), 6)
    lengths, commas = F.col("len_a") == F.col("len_b"), F.col("commas_a") == F.col("commas_b")
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("k") + 1)
    return both.select(name.alias("column"), "leaks", lengths.alias("same_lengths"), commas.alias("same_commas"), ratio.alias("distinct_ratio"), ((F.col("leaks") == 0) & lengths & commas & ratio.between(0.5, 1.6)).alias("passed"))


def _cells(df: DataFrame, cells: list) -> DataFrame:
    """One row of (k, v, b, a) for each cell (k, text, before?, after?)."""
    n = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    return df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v"), n(b).alias("b"), n(a).alias("a")) for k, v, b, a in cells])))


def audit(before: DataFrame, after: DataFrame, columns: tuple[str, ...], sensitive: str = SENSITIVE) -> DataFrame:
    """column, leaks, same_lengths, same_commas, distinct_ratio, passed; sensitive: a pattern that nothing may match."""
    one = lambda df, b, a: _cells(df, [(k, F.col(c), b, a) for k, c in enumerate(columns)])
    return _judged(one(before, 1, 0).unionByName(one(after, 0, 1)), columns, sensitive)


def audit_masks(raw: DataFrame, columns: tuple[str, ...], sensitive: str = SENSITIVE) -> DataFrame:
    """audit(raw, anonymize(raw), columns) with less moved and masked: columns without a mask are counted
    once for both sides, without ranks; of the others each pair of a text (its shape, where classes
    decide) and number is masked once, behind the shuffle that counts it."""
    at = dict(zip(columns, range(len(columns)), strict=True))
    marked = raw.withColumn("__whole", ~F.greatest(*[F.col(c).isNull() for c in ("doc_id", *RANKED)]))
    cells = _cells(marked, [(at[c], F.col(c), 1, 0 if c in MASKED else F.col("__whole")) for c in columns])
    masks = [c for c in columns if c in MASKED]
    text = lambda c: _shape(F.col(c)) if c in ("ord_no", "part_no", "cust") else F.col(c)
    pairs = _ranked(raw).select(F.inline(F.array(*[F.struct(F.lit(at[c]).alias("k"), text(c).alias("t"), _seq(c).cast("int").alias("n")) for c in masks])))
    counted = pairs.groupBy("k", "t", "n").agg(F.count("*").alias("a"))
    masked = F.lit(None).cast("string")
    for c in masks:
        masked = F.when(F.col("k") == at[c], _mask(c, F.col("t"), F.col("n"))).otherwise(masked)
    return _judged(cells.unionByName(counted.select("k", masked.alias("v"), F.lit(0).cast("long").alias("b"), "a")), columns, sensitive)


def gate(audited: DataFrame) -> None:
    """Refuses to go on while a column fails its audit."""
    bad = [r["column"] for r in audited.where("NOT passed").select("column").limit(20).collect()]
    if bad:
        raise ValueError(f"audit failed: {', '.join(bad)}")
