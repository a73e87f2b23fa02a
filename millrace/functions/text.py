"""String, URL, markdown and HTML functions, as column expressions unless they say otherwise."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query words that carry little meaning.
STOP_WORDS = ["the", "is", "of", "and", "a", "an", "in", "to", "for", "with", "on", "at", "by", "from", "that", "this"]

#: Parts of URLs that are dropped from search results.
UNWANTED_URLS = [
    "web.archive.org", "www.youtube.com", "www.youtube.com/watch", "www.wired.com", "www.techcrunch.com", "www.wsj.com", "www.nytimes.com", "www.forbes.com",
    "www.businessinsider.com", "www.theverge.com", "www.thehill.com", "www.theatlantic.com", "www.foxnews.com", "www.theguardian.com", "www.nbcnews.com", "www.msn.com",
    "www.sciencedaily.com", "reuters.com", "bbc.com", "thenewstack.io", "abcnews.go.com", "apnews.com", "bloomberg.com", "polygon.com", "reddit.com", "indeed.com", "test.com",
]

#: Replacements of the HTML pretty-printer, in order of priority.
PRETTY = [
    ("><", ">\n<"), ("<div", "\n<div"), ("</div>", "</div>\n"), ("<p", "\n<p"), ("</p>", "</p>\n"), ("<li", "\n<li"), ("</li>", "</li>\n"),
    ("<ul", "\n<ul"), ("</ul>", "</ul>\n"), ("<optgroup", "\n<optgroup"), ("</optgroup>", "</optgroup>\n"), ("<select", "\n<select"), ("</select>", "</select>\n"),
]

#: Fixed value: what a URL in running text looks like.
URL = r"""(?d)http.*?://[^\t\n\f\r <>{}|\\^`"]+"""
FENCE = "```"
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x) -> Column:
    """x without Unicode white space at its ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+\z", "")


def sanitize_query(q) -> Column:
    """Words of a search query: only [0-9A-Za-z_*"] and white space stay, stop words go, one space joins."""
    bare = F.regexp_replace(_c(q), r'[^0-9A-Za-z_ \t\n\f\r*"]', "")
    return F.array_join(F.filter(F.split(bare, r"[ \t\n\f\r]+"), lambda w: (w != "") & ~F.lower(w).isin(STOP_WORDS)), " ")


def clean_url(url) -> Column:
    """One trailing character each of . , ; ! ? goes, in that order."""
    out = _c(url)
    for c in ".,;!?":
        out = F.when(out.endswith(c), F.substring(out, F.lit(1), F.length(out) - 1)).otherwise(out)
    return out


def extract_urls(text) -> Column:
    return F.transform(F.regexp_extract_all(_c(text), F.lit(URL), F.lit(0)), clean_url)


def remove_urls(text) -> Column:
    """Every literal occurrence of each URL found goes, first found first."""
    t = _c(text)
    return F.aggregate(F.regexp_extract_all(t, F.lit(URL), F.lit(0)), t, lambda s, u: F.replace(s, u, F.lit("")))


def hrefs(page, must_contain: str | None = "http") -> Column:
    """Targets of links in page order, outside comments and scripts; only those with ``must_contain``."""
    bare = F.regexp_replace(_c(page), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    found = F.transform(F.regexp_extract_all(bare, F.lit(HREF), F.lit(0)), lambda a: F.concat(*(F.regexp_extract(a, HREF, i) for i in (1, 2, 3))))
    return found if must_contain is None else F.filter(found, lambda u: u.contains(must_contain))


def first_urls(urls, n: int = 3) -> Column:
    """The first n of a list of URLs, or as many as there are."""
    return F.slice(_c(urls), 1, n)


def is_unwanted_url(url) -> Column:
    out = F.lit(False)
    for part in UNWANTED_URLS:
        out = out | _c(url).contains(part)
    return out


def lite_url(url) -> Column:
    """The first cnn.com becomes lite.cnn.com."""
    return F.regexp_replace(_c(url), r"\A(?s)(.*?)cnn\.com", "$1lite.cnn.com")


def remove_empty_rows(text) -> Column:
    return F.array_join(F.filter(F.transform(F.split(_c(text), "\n", -1), trimmed), lambda x: x != ""), "\n")


def count_of(text, part: str) -> Column:
    """Occurrences of part that don't overlap."""
    t = _c(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("long")


def close_code_fence(text) -> Column:
    t = _c(text)
    return F.when(count_of(t, FENCE) % 2 == 1, F.concat(t, F.lit("\n" + FENCE))).otherwise(t)


def page_markdown(text) -> Column:
    """Lines of a page: capitals become headers, list items stay lines, all else paragraphs.

    Capital letters are compared by simple case mapping, under which a sharp s has no capital.
    """
    lines = F.filter(F.transform(F.split(_c(text), "\n", -1), trimmed), lambda x: x != "")
    flat = lambda x: F.translate(x, "ß", "")
    made = lambda x: F.when(F.upper(flat(x)) == flat(x), F.concat(F.lit("## "), x, F.lit("\n\n"))).when(x.rlike(r"^[*+-] "), F.concat(x, F.lit("\n"))).otherwise(F.concat(x, F.lit("\n\n")))
    return F.array_join(F.transform(lines, made), "")


def fill_template(template, values: dict) -> Column:
    """{key} replaced by its value (a column or a literal), key by key in sorted order."""
    out = _c(template)
    for k in sorted(values):
        v = values[k]
        out = F.replace(out, F.lit("{" + k + "}"), v if isinstance(v, Column) else F.lit(str(v)))
    return out


def wrap_braces(text) -> Column:
    return F.concat(F.lit("{"), _c(text), F.lit("}"))


def inside_braces(text) -> Column:
    """What stands between the first { and the last }; empty without them."""
    return F.regexp_extract(_c(text), r"(?s)\{(.*)\}", 1)


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/", -1), -1)


def file_ext(path) -> Column:
    """From the last dot of the file's name on, dot included; empty without one."""
    return F.regexp_extract(file_name(path), r"(\.[^.]*)\z", 1)


def relative_path(path, root: str) -> Column:
    p, r = _c(path), root.rstrip("/") + "/"
    return F.when(p.startswith(r), F.substring(p, F.lit(len(r) + 1), F.length(p))).otherwise(p)


def enabled_label(flag) -> Column:
    return F.when(_c(flag), "enabled").otherwise("disabled")


@F.pandas_udf(T.StringType())
def pretty_html(content: pd.Series) -> pd.Series:
    """Content with < and > gets line breaks around common tags: one pass, left to right, the first
    replacement in the list that fits wins. (Chained replacements would see each other's output.)"""
    table = dict(PRETTY)
    fits = re.compile("|".join(re.escape(k) for k, _ in PRETTY))
    return content.map(lambda s: fits.sub(lambda m: table[m[0]], s) if isinstance(s, str) and "<" in s and ">" in s else s)


class _Text(HTMLParser):
    BLOCK = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav aside blockquote pre".split())
    OFF = frozenset(("script", "style", "head", "noscript", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in self.OFF
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.off = max(0, self.off - (tag in self.OFF))
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def plain_text(page: str | None) -> str | None:
    if page is None:
        return None
    p = _Text()
    p.feed(page)
    p.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_text(page: pd.Series) -> pd.Series:
    """All text of a page, one block a line (a parser's work, hence no expression)."""
    return page.map(plain_text)


def page_document(url, page) -> Column:
    """A fetched page as text that names its source."""
    return F.concat(F.lit("Source: "), _c(url), F.lit("\n\n"), html_text(_c(page)))
