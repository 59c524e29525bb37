"""Reply chains longer than any in the driver's tables."""

from vellum.operators import graph as G
from vellum.operators import threads as TH


def test_a_long_chain_keeps_its_tree(spark):
    n = 2500
    rows = [(1, i, i - 1 if i else None) for i in range(n)] + [(2, 0, 2), (2, 1, 0), (2, 2, 1), (2, 3, 2), (3, 5, 4)]
    got = {(r.conv_id, r.turn): (r.depth, r.root) for r in G.thread_depths(spark.createDataFrame(rows, "conv_id bigint, turn bigint, parent_turn bigint")).collect()}
    assert got == {(1, i): (i, 0) for i in range(n)} | {(2, i): (None, None) for i in range(4)} | {(3, 5): (0, 5)}


def test_flat_items_of_a_long_chain(spark):
    items = spark.createDataFrame([("d", f"i{i}", f"i{i - 1}" if i else None) for i in range(1100)], "document string, id string, parent string")
    deepest = TH.from_edges(items).filter("id = 'i1099'").collect()
    assert [(r.root, r.depth) for r in deepest] == [("i0", 1099)]
