from pagesift.functions.shred import shred_one


def nodes(html):
    b, _ = shred_one(html)
    return [(b.kind[i], b.tag[i], b.text[i], b.parent[i], b.end[i]) for i in range(len(b.kind))]


def test_unclosed_p_nests_and_end_tag_pops_to_nearest():
    b, _ = shred_one("<p>a<p>b</p>c</p>d")
    kinds = list(zip(b.tag, b.text, b.parent))
    # second p is a child of the first; 'c' is back in the first p; 'd' at top
    assert kinds[1] == ("p", None, 0) and kinds[3] == ("p", None, 1)
    assert kinds[5] == (None, "c", 1) and kinds[6] == (None, "d", 0)


def test_void_and_swallowed_end_tag():
    b, _ = shred_one("<div>a<br>b</br>c</div>")
    assert b.tag[3] == "br" and b.end[3] == 3
    assert b.parent[4] == 1 and b.parent[5] == 1      # b and c stay in the div
    assert b.end[1] == 5


def test_unmatched_end_tag_is_ignored_and_self_closing_closes():
    b, _ = shred_one("<div>x</span><span/>y</div>")
    assert b.tag == ["#document", "div", None, "span", None]
    assert b.parent[4] == 1


def test_entities_kinds_and_whitespace():
    b, _ = shred_one("<!DOCTYPE html><p>a &amp; b</p>\n\n <!-- c --><script>var t='</p>';</script><pre> </pre>")
    assert ("t", "a & b") in list(zip(b.kind, b.text))
    assert ("t", "\n") in list(zip(b.kind, b.text))          # whitespace run collapsed
    assert ("c", " c ") in list(zip(b.kind, b.text))
    assert ("s", "var t='</p>';") in list(zip(b.kind, b.text))
    assert ("t", " ") in list(zip(b.kind, b.text))
    assert b.kind[1] == "d" and b.text[1] == "html"


def test_attributes_lowercased_last_wins_and_valueless():
    b, _ = shred_one('<A HREF="x" href="y" Disabled>t</A>')
    assert b.tag[1] == "a" and b.attrs[1] == {"href": "y", "disabled": ""}


def test_page_that_the_tokenizer_rejects_is_an_error():
    b, error = shred_one("<h1>Some title</h1><![foo[x]]>")
    assert b is None and error.startswith("AssertionError: ")
    assert shred_one(None) == (None, None)


def test_slices_follow_bytes():
    import pyarrow as pa

    from pagesift.functions.shred import byte_slices
    batch = pa.RecordBatch.from_pydict({"html": ["a" * 60, None, "b" * 50, "c" * 200, "", "d"], "i": list(range(6))})
    parts = list(byte_slices([batch], "html", 100))
    assert [p.column("i").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]]
