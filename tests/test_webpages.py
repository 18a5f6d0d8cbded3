"""Conversion of web pages, rule by rule; files of many formats; ranges of elements."""

import io
import zipfile

import pytest

from corpusmill.operators import html as H
from corpusmill.sources import reader as R


def said(html):
    return [(k, t, [f"{a}:{b}" for a, b in spans]) for k, t, spans in H.page_paragraphs(html)[1]]


PAGES = [
    ("headings", "<h1>A <b>b</b></h1><h6>x</h6><h2>Two</h2>", [("title", "A b", []), ("title", "Two", [])]),
    ("a heading in a list item", "<ul><li><h3>Head</h3> more</li></ul>", [("listitem", "Head more", [])]),
    ("paragraphs end where blocks begin", "<p>one<p>two<div>three</div>", [("text", "one", []), ("text", "two", []), ("text", "three", [])]),
    ("bullets", "<p>• a b • c d</p>", [("listitem", "a b", []), ("listitem", "c d", [])]),
    ("bare text of the body takes what follows", "start <i>it</i> and <a>link</a><p>two</p>", [("text", "start", []), ("text", "it", ["italic:it"]), ("text", "and link", []), ("text", "two", [])]),
    ("line breaks", "<p>one<br>two<wbr>three</p>", [("text", "one two three", [])]),
    ("bold", "<p>a <b>b</b></p><b>own</b><div><b>in div</b></div>", [("text", "a b", ["bold:b"]), ("text", "own", ["bold:own"]), ("text", "in div", ["bold:in div"])]),
    ("emphasis inside emphasis", "<p><i>a <u>b</u></i> <b>c <i>d</i></b></p>", [("text", "a b c d", ["italic:a b", "bold:c d"])]),
    ("emphasis in a list item", "<ul><li>a <em>b</em></li></ul>", [("listitem", "a b", ["em:b"])]),
    ("emphasis of a cell", "<table><tr><td><i>a1</i><u>b1</u><strong>c1</strong><em>d1</em></td></tr></table>", [("text", "a1", ["italic:a1"]), ("text", "b1", ["bold:b1"]), ("text", "c1", ["bold:c1"]), ("text", "d1", ["em:d1"])]),
    ("table", "<table><caption>cap</caption><tr><th>th1<td>td1<td><a>a1</a><span>s1</span></table>", [("text", "cap", []), ("text", "th1", []), ("text", "td1", []), ("text", "a1", []), ("text", "s1", [])]),
    ("lists drop bare text", "<ol>bare<li>one<li>two</ol>", [("listitem", "one", []), ("listitem", "two", [])]),
    ("paragraphs of a list item's box", "<ul><li><div><p>one</p><p>two</p></div></li></ul>", [("listitem", "one", []), ("listitem", "two", [])]),
    ("a list in a list", "<ul><li>a1</li><ul><li>b1</li></ul></ul>", [("listitem", "a1", []), ("listitem", "b1", [])]),
    ("quote", "<blockquote>said <p>so</p></blockquote>", [("text", "said so", ["quote:said so"])]),
    ("definitions", "<dl><dt>term<dd>meaning</dl>", [("text", "term", []), ("text", "meaning", [])]),
    ("sub and sup", "<p>H<sub>2</sub>O</p><sup>12</sup>", [("text", "H 2 O", []), ("text", "12", [])]),
    ("pre", "<pre>a  b</pre>", [("pre", "a b", [])]),
    ("spans hold blocks", "<span>a1<div>b1</div>c1</span>", [("text", "a1", []), ("text", "b1", []), ("text", "c1", [])]),
    ("links hold headings", "<div><a><h2>Head</h2></a></div>", [("title", "Head", [])]),
    ("killed elements keep what follows", "<div>a1<figure>x</figure>b1<nav>y</nav>c1</div>", [("text", "a1b1c1", [])]),
    ("removed elements take what follows", '<div><div class="ad">x</div>gone<p>stays</p></div>', [("text", "stays", [])]),
    ("names have to be equal", '<div class="ad big">stays</div>', [("text", "stays", [])]),
    ("scripts", "<p>a1<script>if (a < b) x = '<p>'</script>gone</p>", [("text", "a1", [])]),
    ("comments and declarations", "<!DOCTYPE html><!-- x --><?php y ?><p>stays</p>", [("text", "stays", [])]),
    ("unknown elements and fonts leave their text", "<p><blink>a</blink><x-y>b</x-y><font>c</font></p>", [("text", "abc", [])]),
    ("forms", "<form><label>name</label><input value=x><select><option>o</select><textarea>t</textarea></form>", [("text", "name", [])]),
    ("center", "<center>mid</center>", [("text", "mid", [])]),
    ("character references", "<p>&lt;a&gt; &eacute;&nbsp;&#65;</p>", [("text", "<a> é A", [])]),
    ("one character is no paragraph", "<p>x</p><label>y</label><p>xy</p>", [("text", "xy", [])]),
]


@pytest.mark.parametrize(("name", "html", "want"), PAGES, ids=[p[0] for p in PAGES])
def test_rules(name, html, want):
    assert said(f"<html><body>{html}</body></html>") == want
    assert said(html) == want  # a page without a body is one


def test_references_without_a_semicolon_stay():
    """A page's title cut inside of a reference; also in a heading, before a letter, and by a name that there isn't."""
    assert H.page_paragraphs("<title>A &amp;&amp</title><h1>A &amp;&amp</h1>")[0] == "A &&amp"
    assert said("<h1>A &amp;&amp</h1><p>B &lt &copy2 &notit; &am</p><p>&amp;amp &lt; &#65; R&D &") == [("title", "A &&amp", []), ("text", "B &lt &copy2 &notit; &am", []), ("text", "&amp < A R&D &", [])]


def test_odd_pages():
    assert H.page_paragraphs(None) == ("", []) and H.page_paragraphs("") == ("", []) and said("</p></div>") == []
    assert H.page_paragraphs("<title> a\n b </title><p>no end") == ("a b", [("text", "no end", [])])
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert said(deep) == [("text", "deep", [])]
    assert len(said("<p>word</p>" * 20_000)) == 20_000
    assert H.page_paragraphs('<p class="mine">x y</p>', H.removals([("p", "class", "mine")]))[1] == []


def epub(pages, linear=lambda k: True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='c.opf'/></rootfiles></container>")
        refs = "".join(f"<itemref idref='{k}'{'' if linear(k) else ' linear="no"'}/>" for k in range(len(pages)))
        z.writestr("c.opf", "<package><manifest>" + "".join(f"<item id='{k}' href='{k}.xhtml'/>" for k in range(len(pages))) + f"</manifest><spine>{refs}</spine></package>")
        for k, p in enumerate(pages):
            z.writestr(f"{k}.xhtml", f"<html><body>{p}</body></html>")
    return out.getvalue()


BOOK = ["<h1>One</h1><p>p1</p><p>p2</p><div>lead<p>p3</p>t3<p>p4</p></div>", "<p>q1</p><p>q2</p>"]


@pytest.mark.parametrize(
    ("ranges", "want"),
    [
        ("", "One p1 p2 lead p3 t3 p4 q1 q2"), ("body/div[1]/p[1];", "One p2 lead p3 t3 p4 q1 q2"), (".//html:body/html:div[1]/html:p[1];.//html:body/html:div[1]/html:div[1]", "One lead p3 t3 p4 q1 q2"),
        ("body/div[1]/p[2];body/div[1]/div/p[2]", "One p1 lead p4 q1 q2"), ("body/div[1]/div[1]/p[1];body/div[2]/p[2]", "One p1 p2 lead q2"), ("body/div[1]/p[2];body/div[1]/p[9]", "One p1 q1 q2"),
        ("body/div[7]/p;body/div[1]", "One p1 p2 lead p3 t3 p4 q1 q2"), ("body/div[1]/h1;,body/div[2]/p[1];", "p1 p2 lead p3 t3 p4 q2"),
    ],
)
def test_ranges(ranges, want):
    body = R.without_ranges(R.book(epub(BOOK), []), ranges)
    assert " ".join(p[1] for p in H.body_paragraphs(body)) == want


def test_chapters():
    assert [p[1] for p in H.body_paragraphs(R.book(epub(BOOK), [0]))] == ["q1", "q2"]
    assert len(list(R.chapters(epub(BOOK, lambda k: k == 1)))) == 1


def test_a_chapter_that_ends_inside_of_a_reference():
    assert [p[:2] for p in H.body_paragraphs(R.book(epub(["<article><h1>A &amp;&amp</h1><p>B &amp; C</p></article>"]), []))] == [("title", "A &&amp"), ("text", "B & C")]


def test_folder_of_mixed_files(spark, tmp_path):
    """Every file is a row; what can't be read has an error."""
    files = {
        "a.txt": "first\nline\r\n\r\n \t\nsecond".encode(), "b.txt": "Čáhci".encode(), "c.txt": "blåbær “x”".encode("cp1252"), "d.txt": b"caf\xe9 \x81", "e/f.html": b"<title>T</title><p>caf\xe9</p>",
        "g.html": b'<?xml version="1.0" encoding="latin1"?><p>page</p>', "h.epub": epub(["<p>book</p>"]), "bad.epub": b"no zip", "bad.usx": b"<usx", "x.docx": b"zz", "y.zzz": b"what", "blank.txt": b" \n",
        "k.correct.txt": b"one {wrong}${right} word", "nt-bible.xml": b"<bible><book title='Ruth'><chapter number='1'/></book></bible>", "v.sfm": b"\\id x\n\\mt1 Book\n\\c 1\n\\p\n\\v 1 Text", "w.sfm": b"\\zzz what",
        "udhr_x.xml": b"<udhr xmlns='u'><title>Rights</title><article><title>Article 1</title><para>All</para><orderedlist><listitem><para>item</para></listitem></orderedlist></article></udhr>",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = {r["path"].removeprefix(f"file:{tmp_path}/"): r for r in R.folder(spark, str(tmp_path)).collect()}
    assert set(found) == set(files)
    texts = {k: [(p["type"], p["text"]) for p in r["paragraphs"]] for k, r in found.items()}
    assert texts["a.txt"] == [("text", "first\nline"), ("text", "second")] and texts["b.txt"] == [("text", "Čáhci")] and texts["c.txt"] == [("text", "blåbær “x”")] and texts["d.txt"] == [("text", "café \x81")]
    assert found["e/f.html"]["title"] == "T" and texts["e/f.html"] == [("text", "café")] and texts["g.html"] == [("text", "page")] and texts["h.epub"] == [("text", "book")] and texts["blank.txt"] == []
    assert texts["udhr_x.xml"] == [("title", "Rights"), ("title", "Article 1"), ("text", "All"), ("listitem", "item")] and texts["v.sfm"] == [("title", "Book"), ("text", "Text")]
    assert {k for k, r in found.items() if r["error"]} == {"bad.epub", "bad.usx", "x.docx", "y.zzz", "w.sfm"} and all(not texts[k] for k in ("bad.epub", "bad.usx", "x.docx", "y.zzz", "w.sfm"))


def test_lines_of_made_files_lose_white_space_only(spark, tmp_path):
    """Lines that begin or end with the digit of their own number, or with blanks, in each kind of file; against the query's SQL."""
    import duckdb

    from corpusmill.plans import files

    text = "0 zero 0\n1 one 1\n  2 two 2  \n 3\n4 four & <4\nplain\n6"
    spark.createDataFrame([(k, text) for k in range(20)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "<title>T</title><article><h1>Head &amp</h1><p>Text</p></article>")], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    columns = "path, reader, n, digest, failed"
    got = [tuple(r) for r in files.mixed_files(spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect()]
    assert len(got) == 21 and sorted(got, key=str) == sorted(con.sql(f"select {columns} from ({files.ORACLE['mixed_files']})").fetchall(), key=str)
