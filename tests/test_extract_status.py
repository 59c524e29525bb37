import pytest
from pyspark.sql import functions as F

from vellum.operators import capture as C

LONG = "ordinary prose goes on and on. " * 60


@pytest.mark.parametrize(
    "text, name, scope, cut, want",
    [
        (LONG, "A title", None, None, "complete"),
        (LONG, "A title", "thread", None, "partial"),
        (LONG, "A title", "page", True, "partial"),
        (LONG + "Sign in to comment", "A title", None, None, "partial"),
        ("Short. Please log in to view this. " + "x" * 60, None, None, None, "auth-required"),
        ("Please wait a moment while things load", "Just a moment...", None, None, "blocked"),
        ("## Access denied.\nRay 12", "x", None, None, "blocked"),
        ("Too many requests were made here today, so the service answers that it is rate limited; please try again later, thank you very much for waiting.", "x", None, None, "blocked"),
        ("Access denied is a phrase that people see. " + "word " * 40, "x", None, None, "complete"),
        ("Access denied. " + "word " * 40 + " Your request was blocked by rules.", "x", None, None, "blocked"),
        ("Access denied. " + "word " * 40 + " Your request was blocked by rules. This article tells why.", "x", None, None, "complete"),
        ("Access denied. You have been blocked. " + LONG * 3, "x", None, None, "complete"),
        ("Subscribe to continue reading!", "x", None, None, "auth-required"),
        ("We discuss why you must create an account to keep reading such stories online.", "x", None, None, "complete"),
        ("The page says: enable JavaScript, and then it would show what it holds to you.", "x", None, None, "unsupported"),
        ("tiny", "x", None, None, "unsupported"),
        (None, None, None, None, "unsupported"),
    ],
)
def test_status(spark, text, name, scope, cut, want):
    df = spark.createDataFrame([(text, name, scope, cut)], "t string, n string, s string, c boolean")
    assert df.select(C.extract_status(F.col("t"), F.col("n"), F.col("s"), F.col("c")).alias("x")).first().x == want
