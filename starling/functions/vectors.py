"""Vector, text and metadata functions as Catalyst expressions, and their SQL registration (F1-F16, K11, S6d)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def dot(a: Column, b: Column) -> Column:
    """Inner product; components are widened to double before they are multiplied."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_from(d: Column, na: Column, nb: Column) -> Column:
    """Cosine distance from an inner product and two squared norms; a zero vector is at distance 1 from everything."""
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - d / F.sqrt(na * nb))


def cosine_distance(a: Column, b: Column) -> Column:
    """F1. 1 - dot / sqrt(na nb) in double precision. Null for a null operand or unequal lengths; validate at ingest."""
    return cosine_from(dot(a, b), dot(a, a), dot(b, b))


def cosine_distance_f32(a: Column, b: Column) -> Column:
    """F2. Products in single precision, sums in double; the norms' roots are multiplied."""
    prod = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: (p.cast("float") * q.cast("float")).cast("double")))
    na, nb = prod(a, a), prod(b, b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - prod(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def euclidean_distance(a: Column, b: Column) -> Column:
    """F3. Differences in single precision, squares summed in double."""
    return F.sqrt(_sum(F.transform(F.zip_with(a, b, lambda x, y: (x - y).cast("double")), lambda d: d * d)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """F8. A zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def similarity_percent(score: Column) -> Column:
    """F5. `%.1f` of 100 (1 - score)."""
    return F.format_string("%.1f", F.lit(100.0) * (F.lit(1.0) - score))


def metadata_source(metadata: Column, key: str = "source") -> Column:
    """F6. A key of JSON metadata, `unknown` on any failure."""
    return F.coalesce(F.get_json_object(metadata, f"$.{key}"), F.lit("unknown"))


def metadata_json(source: Column) -> Column:
    """F7."""
    return F.to_json(F.struct(source.alias("source")))


def vector_text(v: Column) -> Column:
    """F11, K11. `[a, b, ...]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("]"))


def parse_vector(s: Column) -> Column:
    """S6d. Between the first `[` and the last `]`, both optional; a bad number fails."""
    inner = F.regexp_replace(F.regexp_replace(s, r"(?s)^[^\[]*\[", ""), r"(?s)\][^\]]*$", "")
    return F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("float"))


def truncate_text(s: Column, most: int) -> Column:
    """F12."""
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit("... ("), F.length(s).cast("string"), F.lit(" chars total)")))


def stripe(x: Column, n: int) -> Column:
    """F13."""
    return F.pmod(x, F.lit(n))


def tolerance(cutoff: Column) -> Column:
    """F14."""
    return F.lit(1e-6) * F.greatest(F.lit(1.0), F.abs(cutoff))


def memory_estimate(n: Column, dim: int, engine: str = "graph") -> Column:
    """F15. Bytes of an index over n vectors."""
    each = 2 * (16 + 4 * dim) + 2 * 32 * 4 + 150 if engine == "graph" else 16 + 4 * dim + 100
    return (n * each).cast("long")


def default_count(k: Column, default: int = 5) -> Column:
    """F16."""
    return F.coalesce(k, F.lit(default))


def is_link(url: Column) -> Column:
    """P6."""
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def is_image(mime: Column) -> Column:
    """P8."""
    return F.coalesce(mime.startswith("image/"), F.lit(False))


def with_norm(df: DataFrame, vector: str, into: str) -> DataFrame:
    """The squared norm as a column, so that it is computed once a row and not once a pair."""
    return df.withColumn(into, dot(F.col(vector), F.col(vector)))


_SQL = {
    "vector_dot": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, p) -> s + p)"),
    "cosine_distance": (
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
        "CASE WHEN vector_dot(a, a) = 0 OR vector_dot(b, b) = 0 THEN 1D ELSE 1D - vector_dot(a, b) / sqrt(vector_dot(a, a) * vector_dot(b, b)) END",
    ),
    "euclidean_distance": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> x - y), 0D, (s, d) -> s + double(d) * double(d)))"),
    "l2_normalize": ("v ARRAY<FLOAT>", "ARRAY<DOUBLE>", "transform(v, x -> double(x) / CASE WHEN vector_dot(v, v) = 0 THEN 1D ELSE sqrt(vector_dot(v, v)) END)"),
}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions that Catalyst inlines."""
    for name, (args, returns, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
