"""Vector arithmetic on array columns."""

from pyspark.sql import functions as F


def let(value, body):
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda an outer expression would be computed again for each
    element; binding it as a lambda variable avoids that.
    """
    return F.transform(F.array(value), body)[0]


def dot(left, right):
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vector):
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def normalize(vector):
    """Unit length; a zero vector stays as it is."""

    def scaled(v, n):
        unit = F.transform(v, lambda x: (x / n).cast("float"))
        return F.when(n > 0, unit).otherwise(v.cast("array<float>"))

    return let(vector, lambda v: let(norm(v), lambda n: scaled(v, n)))


def cosine(left, right):
    """Cosine, 0 where either side is a zero vector."""
    return let(
        norm(left) * norm(right),
        lambda n: F.when(n > 0, dot(left, right) / n).otherwise(F.lit(0.0)),
    )


def truncate(vector, dims):
    return F.slice(vector, 1, dims)


def is_finite(vector):
    """No NaN, no infinity, no missing component."""
    return ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
