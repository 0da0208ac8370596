"""Vector Column expressions (JVM-side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm2(v) -> Column:
    """Sum of squares in double."""
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))


def normalise(v) -> Column:
    """Unit-length copy of a vector (query-side normalisation); null when the
    norm is zero or the vector is null."""
    n = F.sqrt(norm2(v))
    return F.when(n > 0, F.transform(_c(v), lambda x: x.cast("double") / n))


def squared_l2(a, b) -> Column:
    """Squared Euclidean distance of two equal-length vectors, in double; null
    when the lengths differ. Per-pair form, for row-aligned pairs only."""
    s = F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )
    return F.when(F.size(_c(a)) == F.size(_c(b)), s)


def cosine_distance(a, b) -> Column:
    dot = F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.lit(1.0) - dot / (F.sqrt(norm2(a)) * F.sqrt(norm2(b))))


def vector_status(v, dim: int | None = None, metric: str = "sql2") -> Column:
    """'ok' or the reason a vector cannot be searched."""
    c = _c(v)
    st = (
        F.when(c.isNull(), F.lit("null_vector"))
        .when(F.exists(c, lambda x: x.isNull() | F.isnan(x)), F.lit("null_element"))
        .when(F.exists(c, lambda x: F.abs(x) == float("inf")), F.lit("not_finite"))
    )
    if dim is not None:
        st = st.when(F.size(c) != F.lit(dim), F.lit("wrong_length"))
    else:
        st = st.when(F.size(c) == 0, F.lit("wrong_length"))
    if metric == "cosine":
        st = st.when(norm2(c) == 0, F.lit("zero_vector"))
    return st.otherwise(F.lit("ok"))
