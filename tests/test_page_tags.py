"""Plain tags are read without the full parser, to the same elements."""

from html.parser import HTMLParser

import pytest

from fusegrid.sources.pages import Page

PAGES = [
    '<ul class="experience"><li><h3 class="title">Lead</h3><li>b<br><span class="a b" id="x">c</span></ul>',
    "<DIV Class='q'>a<p>b<p>c</div><script>if (a</p>b) '<li>'</script><p>d</p>",
    '<div title="a &amp; b" class="x">1</div><div hidden>2</div><div a="1" a="2">3</div><span class="">4</span>',
    '<title><li>t</li></title><style><p></style><textarea><div></textarea><p class="z"',
    '</li></ul><li ><a href="http://x.example/?a=1">u</a ><table><tr><td>v</table></TD><header>h</header>',
    '<p class="a"/><div class="b" /><img src="x"/><li class="c"\n>n</li><h1x>m</h1x><b class="d">o</b><section',
]


def shape(page):
    return [(e.tag, e.attributes, e.number, e.ends, e.text("|")) for e in page.elements]


@pytest.mark.parametrize("html", PAGES)
def test_same_elements(html):
    class Full(Page):
        parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag

    assert shape(Page(html)) == shape(Full(html))


def test_plain_tags_are_not_parsed_in_full(monkeypatch):
    def never(self, i):
        raise AssertionError(self.rawdata[i : i + 20])

    monkeypatch.setattr(HTMLParser, "parse_starttag", never)
    monkeypatch.setattr(HTMLParser, "parse_endtag", never)
    assert [e.tag for e in Page(PAGES[0].replace("<br>", "")).elements] == ["ul", "li", "h3", "li", "span"]
