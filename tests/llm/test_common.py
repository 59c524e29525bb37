from vellum.llm import common


def test_functions_get_parts_of_a_batch(spark):
    """A batch of 20 MB goes to the function in parts, and every row comes back with its own columns."""

    def make():
        def of(texts):
            n = sum(map(len, texts))
            return [[n] * len(texts), [len(t) for t in texts]]

        return of

    df = spark.range(0, 10_000, 1, 1).selectExpr("id", "repeat('x', 2000 + cast(id % 7 as int)) AS text")
    df = df.unionByName(spark.createDataFrame([(10_000, None), (10_001, "")], "id bigint, text string"))
    rows = common.append(df, make, {"n": "bigint", "own": "bigint"}).drop("text").collect()
    assert sorted((r.id, r.own) for r in rows) == [*((i, 2000 + i % 7) for i in range(10_000)), (10_000, 0), (10_001, 0)]
    assert max(r.n for r in rows) <= common.PART
    long = spark.createDataFrame([(1, "y" * (common.PART + 5)), (2, "z")], "id bigint, text string").coalesce(1)
    assert sorted(r.n for r in common.append(long, make, {"n": "bigint", "own": "bigint"}).drop("text").collect()) == [1, common.PART + 5]
