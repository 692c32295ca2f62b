import bisect
import random

import pytest

from pagesift.llm import html_diff as H


def text(page, *others):
    mine = H.Page(1, "", "h", "/a/1", page)
    return mine.text([H.Page(i, "", "h", f"/a/{i}", o) for i, o in enumerate(others)])


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("bits", [H.TABLE_BITS, 6])
def test_common_lines_against_the_table(monkeypatch, bits):
    monkeypatch.setattr(H, "TABLE_BITS", bits)       # 6: nearly every table is halved
    rng = random.Random(0)
    for _ in range(1500):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 14))]
        found = H.common_lines(a, b)
        assert len(found) == longest(a, b) and found == sorted(set(found))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in found)


def test_long_pages_align_in_bounded_memory():
    a = [f"mine {i}" for i in range(100_000)]
    b = [f"theirs {i}" for i in range(100_000)]
    assert H.common_lines([*a, "foot", "x"], [*b, "foot", "y"]) == [100_000]
    mixed = [i * 7919 % 40_000 for i in range(40_000)]       # every line common, in another order
    found = H.common_lines(mixed, list(range(40_000)))
    assert all(x < y for x, y in zip(found, found[1:])) and all(mixed[x] < mixed[y] for x, y in zip(found, found[1:]))
    tails = []
    for x in mixed:                                          # longest rising run of numbers by patience
        at = bisect.bisect_left(tails, x)
        tails[at:at + 1] = [x]
    assert len(found) == len(tails)


ARTICLE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; line</h1></header>
<p>One <i>two</i>&nbsp;three<p>Four<br>five<aside>Side</aside><div class="advert">Buy</div><ul><li>a<li>b</ul>
<form>f<input name="x"></form><script>var x = "<p>no</p>";</script><div id="comments"><p>Nice!</p></div></article></main>
<footer>foot</footer></body>"""


def test_markup():
    assert text(ARTICLE) == "Head & line\n\nOne two three\n\nFour five\n\na\n\nb"
    assert text("") == ""
    assert text("plain &lt;text&gt;  of\n\tone line") == "plain <text> of one line"
    assert text("<article><p>a<!-- x <p>no --></p><p>b") == "a\n\nb"
    assert text('<article class="post has-sidebar"><p>kept</p><p class="ad">gone</p></article>') == "kept"
    assert text("<article><p>x") == "x" and text("<p>a < b and c > d</p>") == "a < b and c > d"


def test_differencing_without_a_named_article():
    a = "<body><div>Home | News</div><p>Story one text.</p><p>More.</p><div>Copyright X</div>"
    b = "<body><div>Home | News</div><p>Other story.</p><div>Copyright X</div>"
    assert text(a, b) == "Story one text.\n\nMore." and text(b, a) == "Other story."
    assert text(a, a) == "Home | News\n\nStory one text.\n\nMore.\n\nCopyright X"      # a copy tells nothing


def test_shared_prose_of_a_named_article_stays():
    a = "<nav>x</nav><article><p>Quoted passage.</p><p>Own words one.</p><p><a href=1>Read more</a></p></article>"
    b = "<nav>x</nav><article><p>Quoted passage.</p><p>Other words two.</p><p>Third.</p><p><a href=1>Read more</a></p></article>"
    assert text(a, b) == "Quoted passage.\n\nOwn words one."


def test_frame(spark):
    schema = "page_id long, url string, html string, text string, __hostx string"
    page = "<body><div>Menu line</div><p>Story {0} alpha {0}.</p><p>Second {0}.</p><div>Foot line</div>"
    rows = [(i, f"https://Hot.example/{i % 7}/{i}?q={i}#z", page.format(i), "x", "y") for i in range(60)]
    rows += [(100, None, None, None, None), (101, None, "", "x", None), (None, "ftp://x", "<article>a &amp; b</article>", "x", None),
             (102, "https://other.example/a", "<article><p>" + "long words " * 40_000 + "</p></article>", "x", None)]
    rows += rows[:1]
    df = spark.createDataFrame(rows, schema)
    got = H.extract(df.coalesce(1)).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    for i in range(60):
        assert by[i, rows[i][1]].text == f"Story {i} alpha {i}.\n\nSecond {i}."
    assert by[100, None].text == "" and by[101, None].n_chars == 0 and by[None, "ftp://x"].text == "a & b"
    assert by[102, "https://other.example/a"].n_chars == 11 * 40_000 - 1
    assert H.extract(df.limit(0)).collect() == []


def heavy(i, own=5):
    return ("<body>" + "".join(f"<div>Template {k}</div>" for k in range(30))
            + "".join(f"<p>Own {k} of {i}.</p>" for k in range(own)) + "<div>Foot</div>")


def test_a_heavy_template_is_no_copy():
    assert text(heavy(1), heavy(2)) == "\n\n".join(f"Own {k} of 1." for k in range(5))


def test_partners_do_not_depend_on_ranges_or_copies(spark):
    rows = [(i, f"https://h.example/n/{i:03d}", heavy(7 if 5 <= i < 45 else i)) for i in range(60)]     # 40 copies in a row
    rows += [(100 + i, f"https://h.example/n/{i:03d}/empty", "") for i in range(5, 45)]
    rows += [(200 + i, f"https://z{i}.example/", heavy(i)) for i in range(3)]                             # alone on their hosts
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 23):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", n == 1)
            seen.append({r.page_id: r.text for r in H.extract(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)
    for i in range(60):
        assert seen[0][i] == "\n\n".join(f"Own {k} of {7 if 5 <= i < 45 else i}." for k in range(5))
    assert all(seen[0][200 + i].startswith("Template 0") for i in range(3))


def test_pages_equal_the_pairing_of_every_page_with_every_other(spark):
    """Whole texts against partners found by looking at all pages of a host."""
    rng = random.Random(5)
    menu = [f"<div>Menu {k}</div>" for k in range(6)]

    def html_of(i):
        parts = [*rng.sample(menu, 3), *(f"<p>{rng.choice(['Shared words here.', f'Own words {i} {k}.'])}</p>" for k in range(4)),
                 "<p><a href=x>More of this</a></p>"]
        body = "".join(parts) if i % 3 else "<nav>n</nav><article>" + "".join(parts) + "</article>"
        return f"<body>{body}<footer>Foot</footer>"
    pages = [(i, f"https://h{i % 2}.example/{rng.choice('ab')}/{rng.choice('xyz')}/{i:02d}", html_of(i)) for i in range(40)]
    pages += [(100 + i, u, h) for i, u, h in pages[:6]]
    parsed = [H.Page(i, u, u.split("/")[2], "/" + u.split("/", 3)[3], h) for i, u, h in pages]
    parsed.sort(key=lambda p: (p.host, p.steps, p.page_id, p.url))
    want = {}
    for n, p in enumerate(parsed):
        sides = [next((q for q in side if not (q.host == p.host and p.is_copy(q))), None)
                 for side in (parsed[:n][::-1], parsed[n + 1:])]
        sides = [q for q in sides if q is not None and q.host == p.host]
        want[p.page_id] = p.text(sides)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want
    assert sum(want[p.page_id] != p.text([]) for p in parsed) > 20       # sharing decides


def test_differencing_runs_on_pages_that_name_an_article(spark):
    """Shared lines are found on every page; the markup then puts back the quoted passage only."""
    page = ("<body><div class='menu'>Menu line</div><article><p>Quoted passage.</p><p>Own words {0}.</p>"
            "<p><a href=1>Read more</a></p></article><footer>Foot {0}</footer>")
    rows = [(i, f"https://h.example/n/{i}", page.format(i)) for i in range(6)] * 2 + [(9, "https://alone.example/", page.format(9))]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 13
    for r in got:
        if r.page_id == 9:                           # no page to compare with
            assert (r.n_blocks, r.n_shared, r.n_restored) == (5, 0, 0) and r.text.endswith("Read more")
        else:                                        # menu, passage and link are shared
            assert (r.n_blocks, r.n_shared, r.n_restored) == (5, 3, 1) and r.text == f"Quoted passage.\n\nOwn words {r.page_id}."


def test_equal_rows_in_parts(spark):
    """A row that most rows repeat is dealt over parts and keeps its outcome."""
    page = "<body><div>Menu line</div><p>Story {0}.</p><div>Foot line</div>"
    rows = [(1, "https://h.example/1", page.format(1))] * 500 + [(i, f"https://h.example/{i}", page.format(i)) for i in range(2, 2100)]
    got = [(r.page_id, r.text) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, "Story 1.")] * 500 + [(i, f"Story {i}.") for i in range(2, 2100)]
