from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.functions import vector as V


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_lines_end_as_in_python(spark):
    for s in ("", "a", "a\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f g", "\n\n", "a\n\nb\n"):
        assert one(spark, T.split_lines, s) == s.splitlines(), repr(s)
    assert one(spark, T.split_lines, None) is None


def test_tokens_are_unicode(spark):
    assert one(spark, T.tokenize, "Foo_1 é+12") == ["foo_1", "+", "12"]
    assert one(spark, T.token_estimate_counted, "héé wörld, 你好!") == 5
    assert one(spark, T.token_estimate_max, "ééé") == 3
    assert one(spark, T.terms, "The file foo.bar and x 42 Foo.Bar") == ["foo.bar", "foo.bar"]
    assert one(spark, T.identifiers, "a bb Bb c.d") == ["bb", "c.d"]


def test_error_dialects_differ(spark):
    reasons = one(spark, T.line_reasons, "ValueError: x")
    assert "error" not in reasons
    assert spark.sql("SELECT 'ValueError: x' AS t").where(F.col("t").rlike(T.A_ERROR)).count() == 1
    assert one(spark, T.line_reasons, '  File "a/b.py", line 3') == ["trace-frame", "source-location"]
    assert one(spark, T.line_reasons, "def f(): # error") == ["error", "structure", "test-failure"]


def test_paths(spark):
    assert one(spark, T.extract_paths, "see src/a.py, src/a.py and 'b.toml'.") == ["src/a.py", "b.toml"]
    assert one(spark, T.path_terms, "src/httpServer_v2.py") == ["src", "http", "server", "v2", "py"]


def test_vectors(spark):
    row = spark.sql("SELECT array(1D, 0D) a, array(2D, 0D) b, array(0D, 0D) c").select(V.cosine(F.col("a"), F.col("b")).alias("x"), V.cosine(F.col("a"), F.col("c")).alias("y"), V.safe_divide(F.lit(1.0), F.lit(0.0)).alias("z")).first()
    assert (row.x, row.y, row.z) == (1.0, 0.0, 0.0)
