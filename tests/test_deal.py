from conftest import SF

from pagesift.functions.shred import shred_one
from pagesift.plans import catalog
from pagesift.sources.tables import PAGE_PARTITIONS, deal_rows, read_table


def test_rows_that_become_pages_are_dealt_over_all_cores(spark):
    orders = read_table(spark, SF, "orders", "o_orderkey")
    assert orders.rdd.getNumPartitions() < 4          # one small file
    dealt = deal_rows(orders)
    assert dealt.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert sorted(dealt.collect()) == sorted(orders.collect())
    spark.conf.set(PAGE_PARTITIONS, "3")
    try:
        assert deal_rows(orders).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(PAGE_PARTITIONS)


def test_both_halves_of_a_run_come_from_one_extraction(spark):
    content, failures = catalog._order_results(spark, SF)
    for half in (content, failures):
        assert "MapInArrow" not in half._jdf.queryExecution().executedPlan().toString()


def test_plain_tags_are_read_as_the_tokenizer_reads_them():
    from html.parser import HTMLParser

    from pagesift.functions import shred as S

    class Slow(S._TreeBuilder):
        parse_starttag, parse_endtag, updatepos = HTMLParser.parse_starttag, HTMLParser.parse_endtag, HTMLParser.updatepos
    for page in ('<P Class="a b" ID="x">t</P><a href="/x" href="/y">l</a><br><br/></br>', '<title><p>x</p></title><textarea><b>x</textarea>y',
                 '<script a="b">if (a<b) "<p>"</script><p x="1"y="2">z</p >', '<p a="&amp;"><p a="<b>"><noscript><i>x</i></noscript><x-y>q</x-y>',
                 '<script>a</p></script><style>b</b></style><p', "<a href='q'>w</a></", '<xmp><b></xmp><iframe><i></iframe>'):
        fast, slow = shred_one(page)[0], Slow()
        slow.feed(page)
        slow.finish()
        assert [fast.kind, fast.tag, fast.attrs, fast.text, fast.end, fast.parent] == [
            slow.kind, slow.tag, slow.attrs, slow.text, slow.end, slow.parent]


def test_plain_pages_never_reach_the_tokenizer(monkeypatch):
    from pagesift.functions import shred as S
    fed = []
    monkeypatch.setattr(S._TreeBuilder, "feed", lambda self, text: fed.append(text))
    page = '<html><title>T</title><script type="application/ld+json">{"a": 1}</script><p class="a">x<br>y</p></html>'
    b = shred_one(page)[0]
    assert not fed and b.tag[1:] == ["html", "title", None, "script", None, "p", None, "br", None]
    assert S.page_index(b) is S.page_index(b)
    shred_one("<p>x &amp; y</p>")
    assert fed == ["&amp; y</p>"]
