"""Blocks of pages against the standard library's parser, and records of acts."""

from datetime import date
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import functions as F

from verdigris.functions import html as H
from verdigris.operators.act_records import act_records

PAGES = "/root/testdata/sf0.01/pages.parquet"


class Plain(HTMLParser):
    """The same blocks from events of a parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.tag, self.attributes, self.text, self.depth, self.hidden = [], "", {}, [], 0, 0

    def close_block(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((self.tag, self.depth, self.attributes, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in H.BLOCKS:
            self.close_block()
            self.tag, self.attributes = tag, {}
            for k, v in attrs:
                self.attributes.setdefault(k, v or "")
            self.depth += tag in H.HOLDERS
        else:
            self.text.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag in H.BLOCKS:
            self.close_block()
            self.tag, self.attributes = "", {}
            self.depth -= tag in H.HOLDERS
        else:
            self.text.append(" ")

    def handle_comment(self, data):
        self.text.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def parsed(text):
    parser = Plain()
    parser.feed(text or "")
    parser.close()
    parser.close_block()
    return parser.found


def check(rows):
    for r in rows:
        got = [(b.tag, b.depth, b.attributes, " ".join(unescape(b.text).split())) for b in r.b]
        assert got == parsed(r.html) and [b.place for b in r.b] == list(range(len(got))), r.html


def test_pages_equal_a_parser(spark):
    pages = spark.read.parquet(PAGES)
    rows = pages.select("html", H.blocks(F.col("html")).alias("b")).collect()
    check(rows)
    assert sum(len(r.b) for r in rows) > 5 * len(rows)


def test_awkward_pages(spark):
    given = [
        None, "", "no markup at all", "<p>one<p class='a' ID=x id=y>two &amp; <b>bold</b><br>three</p>after", "<div><ul><li>a<li>b</ul>c</div>d", "<P>Upper</P><pre>x</pre><paragraph>inline</paragraph>",
        "<style>p{}</style><p>t<!-- <p>no</p> -->u</p><script>'</p>'</script>v", "<td data-x=\"1\">cell</td></div></div><h2>\x01h\x02</h2>", "<p>" + "long " * 20_000 + "</p>",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, html string")
    rows = frame.select("i", "html", H.blocks(F.col("html")).alias("b")).collect()
    check([r for r in rows if r.i != 7])
    seventh = next(r for r in rows if r.i == 7).b
    assert [(b.tag, b.depth, b.text) for b in seventh] == [("td", 0, "cell"), ("h2", 0, "h")] and seventh[0].attributes == {"data-x": "1"}
    assert [r.p for r in frame.where("i = 3").select(H.paragraphs(F.col("html")).alias("p")).collect()] == [["one", "two & bold three"]]


def test_records_of_acts(spark):
    url = "http://x/y?tipo=Resolução&numeroAto=0012&valorAno=2019&orgao=ANM&cod_menu=7"
    page = """<html><body><nav><ul><li>menu</li></ul></nav><p>RESOLUÇÃO ANM Nº 12, DE 3 DE MAIO DE 2019</p><p class="e">Disciplina o cadastro de barragens e outras coisas da mineração nacional.</p>
    <p>Publicada no DOU de 06/05/2019</p><p>Esta Resolução entra em vigor após decorridos 30 dias de sua publicação.</p><p>Vigora até 31/12/2020.</p></body></html>"""
    rows = spark.createDataFrame([(1, url, page), (2, "http://x", None), (3, url, "<p>nada</p>")], "i int, u string, h string")
    got = {r.i: r.act for r in act_records(rows, "u", "h").collect()}
    a = got[1]
    assert (a.kind, a.number, a.year, a.organ, a.sequence) == ("Resolução", "12", "2019", "ANM", "000")
    assert a.title.startswith("RESOLUÇÃO ANM") and a.summary.startswith("Disciplina o cadastro") and a.n_paragraphs == 6
    assert (a.signed, a.published, a.start, a.rule, a.delay, a.end) == (date(2019, 5, 3), date(2019, 5, 6), date(2019, 6, 5), "delay", 30, date(2020, 12, 31))
    assert got[2].title is None and got[2].n_paragraphs == 0 and got[2].start is None
    assert got[3].title == "Resolução 12 ANM 2019" and got[3].published is None and got[3].preview == "nada"
