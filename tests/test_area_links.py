from conftest import SF

from pagesift.plans import catalog


def test_area_links_of_every_order_by_hand(spark):
    """Rows of the operator itself: two links of each order's page, none of
    the second copies, which have no content area."""
    got = sorted(tuple(r) for r in catalog.area_links(spark, SF).collect())
    want = []
    for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        context = f"Customerc{r.o_custkey}andtopoutplaced this order with a text longer than fifty characters."
        want.append((2 * r.o_orderkey, 1, f"c{r.o_custkey}", f"https://www.amazonaws.cn/c/{r.o_custkey}", context))
        want.append((2 * r.o_orderkey, 2, "out", f"https://x.example/{r.o_orderkey}", context))
    assert got == sorted(want)
