"""Where two nested values differ, as an array of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, NumericType, StructType

RELATIVE, ABSOLUTE = 1e-9, 1e-12


def none() -> Column:
    return F.array().cast("array<string>")


def differences(a: Column, b: Column, of: DataType, other: DataType, path: Column | None = None) -> Column:
    """Paths, with what is wrong there, at which a (of type `of`) and b (of type `other`) differ; empty if they are alike.

    Numbers with fractions are alike within a tolerance, all else must be equal; a boolean is never a number. Arrays of
    different length, and fields that one side lacks, are one difference each; null equals only null.
    """
    path = F.lit("$") if path is None else path
    say = lambda text: F.array(F.concat(path, F.lit(text)))
    if isinstance(of, StructType) and isinstance(other, StructType):
        parts = [say(f".{n}: unexpected") for n in of.names if n not in other.names] + [say(f".{n}: missing") for n in other.names if n not in of.names]
        parts += [differences(a[n], b[n], of[n].dataType, other[n].dataType, F.concat(path, F.lit(f".{n}"))) for n in of.names if n in other.names]
        inside = F.concat(*parts) if parts else none()
    elif isinstance(of, ArrayType) and isinstance(other, ArrayType):
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        each = F.flatten(F.transform(a, lambda x, i: differences(x, F.get(b, i), of.elementType, other.elementType, at(i))))
        inside = F.when(F.size(a) != F.size(b), say(": length")).otherwise(each)
    elif isinstance(of, BooleanType) != isinstance(other, BooleanType) or isinstance(of, NumericType) != isinstance(other, NumericType) or isinstance(of, (StructType, ArrayType)) or isinstance(other, (StructType, ArrayType)):
        inside = say(": type")
    elif any(isinstance(t, (DoubleType, FloatType, DecimalType)) for t in (of, other)):
        x, y = a.cast("double"), b.cast("double")
        near = (x == y) | (F.abs(x - y) <= F.greatest(RELATIVE * F.greatest(F.abs(x), F.abs(y)), F.lit(ABSOLUTE)))
        inside = F.when(near, none()).otherwise(say(": value"))
    else:
        inside = F.when(a == b, none()).otherwise(say(": value"))
    return F.when(a.isNull() & b.isNull(), none()).when(a.isNull() | b.isNull(), say(": null")).otherwise(inside)
