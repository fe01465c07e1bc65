"""Column expressions for coercion and cleaning. All JVM-side, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token sets of the two boolean readers.
TRUE_TOKENS = ["1", "true", "t", "yes", "y", "vrai", "oui"]
FALSE_TOKENS = ["0", "false", "f", "no", "n", "faux", "non"]
NULLABLE_TRUE_TOKENS = ["1", "true", "vrai", "oui", "y", "yes"]
NULLABLE_FALSE_TOKENS = ["0", "false", "faux", "non", "n", "no"]
# Text read as missing by the CSV reader.
NULL_TOKENS = ["", "NA", "N/A", "NaN", "NULL", "null"]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN is a value in Spark but missing in the reference: map it to null."""
    return F.nanvl(col_(c), F.lit(None).cast("double"))


def to_double(c) -> Column:
    """Invalid text -> null (``try_cast``), NaN -> null."""
    return nan_to_null(col_(c).try_cast("double"))


_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def as_double(df, c: str) -> Column:
    """``to_double`` that knows the schema: a column already numeric is only
    cast (keeps expressions small when they are referenced many times, and
    keeps predicates pushable); text goes through ``try_cast``."""
    if dict(df.dtypes).get(c, "").split("(")[0] in _NUMERIC:
        return nan_to_null(F.col(c).cast("double"))
    return to_double(c)


def to_timestamp_any(c, formats=("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")) -> Column:
    """Invalid -> null; the first format that parses wins."""
    x = col_(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def clean_european_number(c) -> Column:
    """Keep digits and ``. , + -``; decimal comma becomes a point; coerce."""
    kept = F.regexp_replace(col_(c).cast("string"), r"[^\d.,+\-]", "")
    return to_double(F.replace(kept, F.lit(","), F.lit(".")))


def boolify(c, dtype: str = "string") -> Column:
    """Filter reader: null -> false, numbers -> int != 0, known tokens, any
    other non-empty text -> true."""
    x = col_(c)
    if dtype == "boolean":
        return F.coalesce(x, F.lit(False))
    if dtype in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        xd = nan_to_null(x.cast("double"))
        # int() truncates toward zero: 0.5 -> 0 -> false
        return F.coalesce(F.abs(xd) >= 1, F.lit(False))
    v = F.lower(F.trim(x))
    return (
        F.when(x.isNull(), F.lit(False))
        .when(v.isin(TRUE_TOKENS), F.lit(True))
        .when(v.isin(FALSE_TOKENS), F.lit(False))
        .otherwise(F.length(x) > 0)
    )


def boolify_nullable(c, dtype: str = "string") -> Column:
    """Analysis reader: unknown text -> int(text) != 0 when it parses, else null;
    null stays null."""
    x = col_(c)
    if dtype == "boolean":
        return x
    if dtype in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        return F.abs(nan_to_null(x.cast("double"))) >= 1
    v = F.lower(F.trim(x.cast("string")))
    return (
        F.when(v.isin(NULLABLE_TRUE_TOKENS), F.lit(True))
        .when(v.isin(NULLABLE_FALSE_TOKENS), F.lit(False))
        .otherwise(v.try_cast("int") != 0)
    )


def clean_text(c, missing: str = "Inconnu") -> Column:
    """null -> ``missing``, trim, upper case."""
    return F.upper(F.trim(F.coalesce(col_(c).cast("string"), F.lit(missing))))


def null_tokens_to_null(c, tokens=NULL_TOKENS) -> Column:
    x = col_(c)
    return F.when(~F.trim(x).isin(list(tokens)), x)
