import random
import time
from html.parser import HTMLParser

from skuforge.functions.pages import DROPPED, VOID, reduce_page, reduce_pages


class Plain(HTMLParser):
    """Text lines, tables and pairs of well-formed pages as the standard library reads them: a tree first, then its parts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = ("root", [])
        self.at = [self.tree]

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.at[-1][1].append(node)
        if tag not in VOID:
            self.at.append(node)

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.at[1:]]:
            while self.at.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if data.strip():
            self.at[-1][1].append(data.strip())


def texts(node, inside=True):
    for x in node[1]:
        if isinstance(x, str):
            yield x
        elif x[0] not in DROPPED and (inside or x[0] not in ("table",)):
            yield from texts(x, inside)


def nodes(node, names, stop=()):
    for x in node[1]:
        if not isinstance(x, str) and x[0] not in DROPPED:
            if x[0] in names:
                yield x
            if x[0] not in stop:
                yield from nodes(x, names, stop)


def brute(page):
    p = Plain()
    p.feed(page)
    p.close()
    tables = []
    for t in nodes(p.tree, ("table",)):
        rows = [[" ".join(texts(c, False)) for c in nodes(r, ("td", "th"), ("table",))] for r in nodes(t, ("tr",), ("table",))]
        rows = [r for r in rows if any(r)]
        if len(rows) >= 2:
            tables.append(rows)
    lists = []
    for d in nodes(p.tree, ("dl",)):
        pairs = list(zip([" ".join(texts(x)) for x in nodes(d, ("dt",), ("dl",))], [" ".join(texts(x)) for x in nodes(d, ("dd",), ("dl",))], strict=False))
        if pairs:
            lists.append(pairs)
    return list(texts(p.tree)), tables, lists


def made(draw, depth=0):
    """Random well-formed markup."""
    out = []
    for _ in range(draw.randint(1, 4)):
        kind = draw.choice(("text", "text", "div", "nav", "b", "p", "table", "dl", "br", "comment", "script", "svg"))
        word = draw.choice(("Voltage", "20 &amp; 30", "x &lt; y", "é&#233;", "a&lt;", " ", "2 &lt; 3", "&copy;"))
        if kind == "text" or depth > 3:
            out.append(f" {word} ")
        elif kind == "br":
            out.append('<br class="a>b">')
        elif kind == "comment":
            out.append("<!-- <p>no</p> -- -->")
        elif kind == "script":
            out.append("<script>if (a<b) { t = '</p><nav>'; }</script>")
        elif kind == "table":
            rows = "".join("<tr>" + "".join(f"<{c}>{made(draw, depth + 1) if draw.random() < 0.3 else word}</{c}>" for c in draw.choices(("td", "th"), k=draw.randint(1, 3))) + "</tr>" for _ in range(draw.randint(1, 3)))
            out.append(f"<table border=0><tbody>{rows}</tbody></table>")
        elif kind == "dl":
            out.append("<dl>" + "".join(f"<dt>{word}</dt><dd><b>{i}</b> mm</dd>" for i in range(draw.randint(0, 3))) + "</dl>")
        else:
            out.append(f"<{kind} id='q\"'>{made(draw, depth + 1)}</{kind}>")
    return "".join(out)


def test_random_pages_against_the_standard_parser():
    draw = random.Random(4)
    for _ in range(400):
        page = made(draw)
        text, tables, lists = reduce_page(page)
        lines, want_tables, want_lists = brute(page)
        assert (tables, lists) == (want_tables, want_lists), page
        assert text.startswith("\n".join(lines) + "\n"), page


def test_tables_and_lists_follow_the_text():
    page = "<h1>Drill</h1><table><tr><th>Power</th><td>500 <b>W</b></td></tr><tr><td>Speed<td>2<br>x</table><table><tr><td>alone</td></tr></table><dl><dt>Mass<dd>2 kg<dt>Use</dl>"
    text, tables, lists = reduce_page(page)
    assert tables == [[["Power", "500 W"], ["Speed", "2 x"]]] and lists == [[("Mass", "2 kg")]]
    assert text == "Drill\nPower\n500\nW\nSpeed\n2\nx\nalone\nMass\n2 kg\nUse\n\n[TABLE on page 0]\nPower | 500 W\nSpeed | 2 x\n\n[SPEC LIST]\nMass | 2 kg"


def test_malformed_pages():
    assert reduce_page("<div><nav><div>no</div>no</nav>yes</div></nav></p>end")[0] == "yes\nend\n"
    assert reduce_page("<div><nav><ul><li>no</div>after")[0] == "after\n"
    assert reduce_page("<nav><nav>a</nav>b</nav>c")[0] == "c\n"
    assert reduce_page("a<!-- never closed <p>b")[0] == "a\n"
    assert reduce_page("a<script>never closed <p>b")[0] == "a\n"
    assert reduce_page("a<svg/>b<SVG><g/></SVG>c")[0] == "a\nb\nc\n"
    assert reduce_page("1 < 2 <3 &lt;b&gt; <")[0] == "1 < 2 <3 <b> <\n"
    assert reduce_page("<a title='x > y")[0] == "\n" and reduce_page("")[0] == "\n"


def test_a_megabyte_of_anything_unclosed_takes_linear_time():
    for unit in ("<div>", "<nav>", "<table><tr><td>x", "<dl><dt>", "<!--", "<script>", "<a b=\"", "<", "</div>", "<p x='", "--", "&#x", "<div></nav>"):
        began = time.time()
        reduce_page(unit * (1_000_000 // len(unit)))
        assert time.time() - began < 8, unit


def test_rows_of_a_table_with_nulls_repeats_and_other_columns(spark):
    rows = [(1, "<p>a</p>b", "t"), (1, "<p>a</p>b", "t"), (None, None, "t"), (2, "<dl><dt>k<dd>v</dl>", "t")]
    got = sorted(map(repr, ((r.page_id, r.text, r.tables, [[tuple(p) for p in x] for x in r.pairs]) for r in reduce_pages(spark.createDataFrame(rows, "page_id long, html string, text string"), "page_id", "html").collect())))
    assert got == sorted(map(repr, [(1, "a\nb\n", [], []), (1, "a\nb\n", [], []), (None, "", [], []), (2, "k\nv\n\n[SPEC LIST]\nk | v", [], [[("k", "v")]])]))
    assert reduce_pages(spark.createDataFrame([], "page_id long, html string"), "page_id", "html").count() == 0


def test_pages_among_documents(spark, tmp_path):
    from skuforge.sources import readers

    (tmp_path / "a.html").write_text("<p>Hi <b>you</b><table><tr><td>k<td>v<tr><td>l<td>w</table>")
    (tmp_path / "b.txt").write_text("plain")
    got = {r.kind: r.text for r in readers.read_documents(spark, str(tmp_path), lines=True).collect()}
    assert got == {"web": "Hi\nyou\nk\nv\nl\nw\n\n[TABLE on page 0]\nk | v\nl | w", "text": "plain"}


def test_the_sql_takes_references_without_semicolon():
    import duckdb

    from skuforge.plans import q_ingest

    source = "<title>a&amp;b&amp</title><p>x &lt y&gt z &amp;lt; &am &copy &middot; &quot</p>"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, ? AS html", [source])
    con.execute(f"SELECT {q_ingest._page_lines_sql('html')} FROM pages")
    assert con.fetchall()[0][0] == reduce_page(source)[0]
