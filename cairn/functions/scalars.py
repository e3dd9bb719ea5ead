"""Column expressions: parsing, bands, gates, vectors. All built from Spark's own functions."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Right-open age bands by lower edge.
AGE_BANDS = ((18, "18-39"), (40, "40-54"), (55, "55-64"), (65, "65-74"), (75, "75-89"), (90, "90+"))
#: Texts that count as a missing race. Fixed values.
RACE_MISSING = ("UNKNOWN", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER", "")
#: The order in which conditions are reported.
CONDITIONS = ("full", "a_dropped", "b_dropped")
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(text: Column | str) -> Column:
    """A text as a double if it is written as a finite number, else null (a bare ``try_cast`` takes '55d')."""
    t = F.trim(col(text))
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def percent(text: Column | str) -> Column:
    """``55%`` or ``55`` as a double, else null."""
    return number(F.replace(col(text), F.lit("%"), F.lit("")))


def priority_rank(name: Column | str, order: list[str]) -> Column:
    """The place of a name in ``order``, from 0; names that are not in it come last."""
    place = F.array_position(F.array(*map(F.lit, order)), col(name))
    return F.when(place > 0, place - 1).otherwise(len(order)).cast("int")


def gap_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end, each time truncated to its second."""
    return F.unix_timestamp(col(end).cast("timestamp")) - F.unix_timestamp(col(start).cast("timestamp"))


def gap_hours(start: Column | str, end: Column | str, digits: int = 4) -> Column:
    return F.round(gap_seconds(start, end) / 3600.0, digits)


def age_band(age: Column | str) -> Column:
    """The band of an age; null below the first band or for null."""
    a, out = col(age), F.lit(None).cast("string")
    for edge, label in AGE_BANDS:
        out = F.when(a >= edge, F.lit(label)).otherwise(out)
    return out


def race_group(race: Column | str) -> Column:
    r = F.upper(F.trim(col(race).cast("string")))
    return (
        F.when(r.startswith("WHITE"), "WHITE")
        .when(r.startswith("BLACK"), "BLACK")
        .when(r.startswith("ASIAN"), "ASIAN")
        .when(r.contains("HISPANIC"), "HISPANIC")
        .otherwise("OTHER/UNKNOWN")
    )


def _is_number(value: Column) -> Column:
    """Whether a column is of a numeric type; known when the query is planned."""
    return F.typeof(value).isin("tinyint", "smallint", "int", "bigint", "float", "double") | F.typeof(value).startswith("decimal")


def boolean(value: Column | str) -> Column:
    """true/1/yes/y and false/0/no/n in any case, numeric columns by being nonzero; null for null, NaN or other text (see ``filters.bad_booleans``)."""
    text = col(value).cast("string")
    t = F.lower(F.trim(text))
    number_ = text.try_cast("double")
    told = F.when(t.isin("true", "1", "1.0", "yes", "y"), True).when(t.isin("false", "0", "0.0", "no", "n"), False)
    return F.when(_is_number(col(value)), F.when(~F.isnan(number_), number_ != 0)).otherwise(told)


def strict_boolean(text: Column | str) -> Column:
    """``boolean`` as a flag column needs it: null is false, and text that is neither true nor false fails the job."""
    told = boolean(text)
    return F.when(col(text).isNull(), False).when(told.isNotNull(), told).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), col(text).cast("string"))).cast("boolean"))


def gate(value: Column | str, threshold: float) -> Column:
    """value <= threshold, inclusive."""
    return col(value) <= F.lit(threshold)


def path_ids(path: Column | str) -> tuple[Column, Column]:
    """(subject, study) from ``.../p<digits>/p<subject>/s<study>/...``; null where it does not match."""
    pattern = r"(?:^|/)p\d+/p(\d+)/s(\d+)/"  # the archive's layout, a fixed value
    return tuple(F.nullif(F.regexp_extract(col(path), pattern, i), F.lit("")).try_cast("long") for i in (1, 2))


def path_ids_fallback(path: Column | str) -> tuple[Column, Column]:
    """(subject, study) from path parts: the last ``p`` with over two digits and the last ``s`` with digits; the last part loses its extension."""
    parts = F.split(F.regexp_replace(col(path), r"\.[^./]*$", ""), "/")
    last = lambda pattern: F.try_element_at(F.filter(parts, lambda x: x.rlike(pattern)), F.lit(-1))
    return F.substring(last(r"^p\d{3,}$"), 2, 64).try_cast("long"), F.substring(last(r"^s\d+$"), 2, 64).try_cast("long")


def path_key(path: Column | str, old: str = ".dcm", new: str = ".mp4") -> Column:
    """A path without its first two parts, with another extension."""
    parts = F.split(col(path), "/")
    return F.replace(F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/"), F.lit(old), F.lit(new))


def canonical_id(value: Column | str) -> Column:
    """The digits of the last ``/`` part."""
    return F.regexp_replace(F.element_at(F.split(col(value).cast("string"), "/"), -1), r"\D", "")


# Vectors -----------------------------------------------------------------------------------------


def _numbers(text: Column) -> Column:
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\[\]\(\),;]", " "), r"\s+", " "))
    parts = F.transform(F.split(body, " "), lambda x: F.when(F.lower(x).isin("nan"), F.lit(float("nan"))).otherwise(number(x)))
    return F.when((F.length(body) > 0) & F.forall(parts, lambda x: x.isNotNull()), parts)


#: A bracket inside a bracket.
NESTED = r"^[^\[\(]*[\[\(][^\]\)]*[\[\(]"


def parse_vector(text: Column | str) -> Column:
    """A vector written as a list, or as numbers between brackets, commas or blanks; null for null, empty or unreadable text. Nested lists are a matrix (``parse_matrix``), and an error here."""
    t = col(text)
    return F.when(t.rlike(NESTED), F.raise_error(F.concat(F.lit("a matrix, not a vector: "), F.substring(t, 1, 60))).cast("array<double>")).otherwise(_numbers(t))


def parse_matrix(text: Column | str) -> Column:
    """The rows of a nested list; a plain vector is one row. Null for null, empty or unreadable text, and for rows of different lengths."""
    t = col(text)
    inner = F.transform(F.regexp_extract_all(t, F.lit(r"[\[\(]([^\[\]\(\)]*)[\]\)]"), F.lit(1)), lambda x: _numbers(x))
    rows = F.when(t.rlike(NESTED), inner).otherwise(F.array(_numbers(t)))
    whole = F.forall(rows, lambda r: r.isNotNull()) & (F.size(F.array_distinct(F.transform(rows, lambda r: F.size(r)))) == 1)
    return F.when(whole, rows)


def finite(vector: Column | str) -> Column:
    """Whether every element is a finite number; null for a null vector."""
    return F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def zeros(n: int, kind: str = "float") -> Column:
    return F.array_repeat(F.lit(0).cast(kind), n)


def tile(vector: Column | str, n: int) -> Column:
    """A vector repeated as ``n`` tokens."""
    return F.array_repeat(col(vector), n)


def masked(vector: Column | str, keep: Column, n: int) -> Column:
    """The vector, or zeros where it is masked or missing."""
    return F.when(keep & col(vector).isNotNull(), col(vector)).otherwise(zeros(n))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), operator.add)


def weighted(vector: Column | str, weights: list[float]) -> Column:
    """The inner product with fixed weights."""
    return dot(vector, F.array(*[F.lit(float(w)) for w in weights]))


def mean_of(vector: Column | str) -> Column:
    v = col(vector)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)


def let(value: Column | str, f) -> Column:
    """``f`` of a value that is found once: what a lambda names from outside is else found again for each element."""
    return F.transform(F.array(col(value)), f)[0]


def attention(tokens: Column | str, query: list[float]) -> Column:
    """Softmax of ``tokens . query / sqrt(d)``; null and masked tokens are left out before."""
    d = len(query)
    score = F.transform(col(tokens), lambda t: weighted(t, query) / F.lit(d**0.5))
    e = let(score, lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
    return let(e, lambda e: let(F.aggregate(e, F.lit(0.0), operator.add), lambda total: F.transform(e, lambda x: x / total)))


def pooled(tokens: Column | str, weights: Column | str, d: int) -> Column:
    """The weighted sum of tokens."""
    pairs = F.arrays_zip(col(tokens).alias("t"), col(weights).alias("w"))
    return F.aggregate(pairs, F.array_repeat(F.lit(0.0), d), lambda s, p: F.zip_with(s, p["t"], lambda x, y: x + y.cast("double") * p["w"]))


# Values ------------------------------------------------------------------------------------------


def null_safe(value: Column | str) -> Column:
    """NaN and infinities as null, for output."""
    v = col(value)
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def stratum(value: Column | str) -> Column:
    return F.coalesce(col(value).cast("string"), F.lit("unknown"))


def label_array(flags: list[str], grades: list[str]) -> tuple[Column, Column]:
    """(flags with null as false, grades with null as -1)."""
    return F.array(*[F.coalesce(F.col(c), F.lit(False)) for c in flags]), F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in grades])


def condition_order(condition: Column | str) -> Column:
    return priority_rank(condition, list(CONDITIONS))


def any_of(conditions: list[Column]) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))
