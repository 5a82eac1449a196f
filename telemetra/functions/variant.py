"""Type tests and accessors on VARIANT values parsed from JSON payloads.

``try_variant_get`` casts leniently ("5" becomes 5.0, true becomes 1.0), so every typed
read is guarded by a test on ``schema_of_variant`` first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the type names begin that schema_of_variant reports for JSON numbers: integers, doubles,
# and DECIMAL(p,s). One look at the name, since lambdas evaluate every mention of it anew.
_FLOATS = ("FLOA", "DOUB", "DECI")
_NUMBERS = ("TINY", "SMAL", "INT", "BIGI", *_FLOATS)


def type_of(v: Column) -> Column:
    """Type name of a variant: STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID (JSON null),
    OBJECT<...>, ARRAY<...>; SQL NULL when the value is missing."""
    return F.schema_of_variant(v)


def field(v: Column, path: str, to: str = "variant") -> Column:
    """``try_variant_get``: NULL when the path is missing or the cast fails."""
    return F.try_variant_get(v, path, to)


def is_number(v: Column) -> Column:
    return F.substring(type_of(v), 1, 4).isin(*_NUMBERS)


def is_float(v: Column) -> Column:
    """A number written with a fraction or an exponent, or past 64 bits."""
    return F.substring(type_of(v), 1, 4).isin(*_FLOATS)


def is_number_or_boolean(v: Column) -> Column:
    """What an integer read accepts (booleans count as 0 / 1); one type lookup."""
    return F.substring(type_of(v), 1, 4).isin(*_NUMBERS, "BOOL")


def is_string(v: Column) -> Column:
    return type_of(v) == F.lit("STRING")


def is_object(v: Column) -> Column:
    """True for JSON objects. Casting to a struct succeeds exactly for objects and, unlike
    ``schema_of_variant``, does not walk the whole value."""
    return F.try_variant_get(v, "$", "struct<__probe:int>").isNotNull()


def as_double(v: Column) -> Column:
    """A JSON number as DOUBLE. ``variant_get`` builds a cast (and its settings) for every value
    that is no double already; reading the number's own text gives the same, nearest double."""
    return F.to_json(v).try_cast("double")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` mentions it: inside
    a lambda (tag values are converted in one) Spark shares no common expressions."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def number_text(v: Column) -> Column:
    """A JSON number that is no 64-bit integer as the collector writes it: the shortest digits
    of its double, plain with a fraction up to 15 digits before the point and 4 zeros behind
    it, else with an exponent of two digits (``1.0``, ``0.1``, ``1e+20``, ``1e-05``). Unsigned
    64-bit integers keep their digits."""
    whole = F.when(type_of(v).isin("DECIMAL(19,0)", "DECIMAL(20,0)"), F.try_variant_get(v, "$", "decimal(20,0)"))
    unsigned = whole.between(F.lit(0).cast("decimal(20,0)"), F.lit("18446744073709551615").cast("decimal(20,0)"))
    return F.when(unsigned, F.variant_get(v, "$", "string")).otherwise(_let(as_double(v), double_text))


def double_text(x: Column) -> Column:
    """A double as :func:`number_text` writes it."""
    # the fewest digits that give the number back (Java's own text may have more)
    exact = lambda n, other: _let(F.format_string(f"%.{n}e", x), lambda t: F.when(t.cast("double") == x, t).otherwise(other))
    return _let(exact(14, exact(15, F.format_string("%.16e", x))), _exponent_text)


def _exponent_text(text: Column) -> Column:
    """``-d.ddde±dd`` → sign, then digits without trailing zeros and the digits before the point."""
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    digits = F.rtrim(F.translate(F.substring_index(text, "e", 1), "-.", ""), F.lit("0"))
    point = F.substring_index(text, "e", -1).cast("int") + 1
    parts = F.struct(F.when(digits == "", F.lit("0")).otherwise(digits).alias("digits"), point.alias("point"))
    return F.concat(sign, _let(parts, lambda p: _placed(p["digits"], p["point"])))


def _placed(digits: Column, point: Column) -> Column:
    """Digits with ``point`` of them before the point, plain or with an exponent."""
    size, places = F.length(digits), F.abs(point - 1).cast("string")
    exponent = F.concat(F.when(point > 0, F.lit("e+")).otherwise(F.lit("e-")), F.lpad(places, F.greatest(F.lit(2), F.length(places)), F.lit("0")))
    return (
        F.when((size <= point) & (point <= 15), F.concat(F.rpad(digits, point, F.lit("0")), F.lit(".0")))
        .when((point > 0) & (point <= 15), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
        .when((point > -4) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(F.concat(F.substring(digits, 1, 1), F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(F.lit("")), exponent))
    )


def json_text_values(obj: Column) -> Column:
    """A JSON object as ``map<string,string>``: strings as they are, every other value as
    its compact JSON text (numbers as :func:`number_text`, booleans, ``null``, nested objects
    and arrays).

    The cast to ``map<string,string>`` already writes that text for strings, booleans, 64-bit
    integers and nested values, so it is used where no value is JSON ``null`` (it gives SQL
    NULL) and none looks like a number; only then is each value converted on its own.
    """
    cast = F.try_variant_get(obj, "$", "map<string,string>")
    simple = lambda m: F.forall(F.map_values(m), lambda t: F.coalesce(~F.substring(t, 1, 1).between("-", "9"), F.lit(False)))
    per_value = F.transform_values(
        F.try_variant_get(obj, "$", "map<string,variant>"),
        lambda _k, x: F.when(is_string(x), F.variant_get(x, "$", "string")).when(is_float(x), number_text(x)).otherwise(F.to_json(x)),
    )
    return _let(cast, lambda m: F.when(simple(m), m).otherwise(per_value))
