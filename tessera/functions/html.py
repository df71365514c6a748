"""Text and image of HTML pages, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lines import clean_lines, squeezed
from tessera.functions.papers import html_front_trimmed

# Elements and classes without running text, elements without an end, elements that begin a line. Fixed values.
SKIPPED = frozenset({"script", "style", "noscript", "svg", "canvas", "template", "nav", "header", "footer", "aside", "button"})
SKIPPED_CLASSES = frozenset({"sr-only", "ltx_keywords", "ltx_page_footer", "ltx_page_header", "ltx_note_mark", "ltx_ERROR"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
BLOCKS = frozenset({"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "main", "title", "blockquote", "pre", "body", "figcaption", "figure", "dt", "dd"})
MAIN = ("main", "article")
ROW = "\x1e"  # between the rows of a table
REPEATED = 30  # characters of a block from which on it may stand only once


class _Page(HTMLParser):
    """What a page says, its images, and its formulas and tables in a line of text each.

    Open elements are a stack: an end tag closes what was left open within, so one unclosed element loses nothing behind it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[bool, str]] = []
        self.open: list[tuple[str, bool]] = []
        self.links: dict[str, str] = {}
        self.base = self.image = self.formula = ""
        self.cells: list[list[list[str]]] = []
        self.annotation = False

    def has(self, *tags: str) -> bool:
        return any(t in tags for t, _ in self.open)

    def say(self, text: str) -> None:
        self.out.append((self.has(*MAIN), text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        self.head(tag, a)
        if tag in BLOCKS and not self.cells:
            self.say("\n")
        if tag == "img" and not self.image and self.has(*MAIN, "figure") and usable(a.get("src", "")):
            self.image = a["src"]
        if tag in VOID:
            return
        self.open.append((tag, tag in SKIPPED or not SKIPPED_CLASSES.isdisjoint(a.get("class", "").split())))
        if tag == "math":
            self.formula = a.get("alttext", "").strip() or "[MATH]"
        elif tag == "annotation":
            self.annotation = a.get("encoding") == "application/x-tex"
            self.formula = "" if self.annotation else self.formula
        elif tag == "table":
            self.cells.append([])
        elif tag == "tr" and self.cells:
            self.cells[-1].append([])
        elif tag in ("td", "th") and self.cells:
            (self.cells[-1] or self.cells[-1].append([]) or self.cells[-1])[-1].append("")

    def head(self, tag: str, a: dict[str, str]) -> None:
        names = {"meta": (a.get("property") or a.get("name") or "", a.get("content", "")), "link": ("image_src" if "image_src" in a.get("rel", "").split() else "", a.get("href", ""))}
        name, value = names.get(tag, ("", ""))
        if name in ("og:image", "twitter:image", "image_src"):
            self.links.setdefault(name, value)
        if tag == "base" and not self.base:
            self.base = a.get("href", "")

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.has(tag):
            return
        while True:
            closed, _ = self.open.pop()
            if closed == "math":
                self.handle_data(f" {squeezed(self.formula)} ")
            elif closed == "annotation":
                self.annotation = False
            elif closed == "table":
                self.table()
            if closed in BLOCKS and not self.cells:
                self.say("\n")
            if closed == tag:
                return

    def table(self) -> None:
        rows = [[squeezed(c) for c in r] for r in self.cells.pop()]
        rows = [r for r in rows if any(r)]
        width = max(map(len, rows), default=0)
        lines = [" | ".join(r + [""] * (width - len(r))) for r in rows]
        self.handle_data("\n" + ROW.join([*lines[:1], *([" | ".join(["---"] * width)] if len(lines) > 1 else []), *lines[1:]]) + "\n")

    def handle_data(self, data: str) -> None:
        if any(skipping for _, skipping in self.open):
            return
        if self.has("math"):
            self.formula += data if self.annotation else ""
        elif self.cells:
            if self.cells[-1] and self.cells[-1][-1]:
                self.cells[-1][-1][-1] += data
        else:
            self.say(data)


def parsed(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    while p.open:
        p.handle_endtag(p.open[-1][0])
    return p


def usable(url: str) -> bool:
    return bool(url.strip()) and not url.strip().lower().startswith(("data:", "javascript:"))


def running_text(p: _Page) -> str:
    lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(x for _, x in p.out).replace(ROW, "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def page_text(html: str | None) -> str:
    """Running text: a line for each block, spaces collapsed, one empty line at most between."""
    return running_text(parsed(html))


def paper_text(html: str | None) -> str:
    """The main part's blocks, formulas as TeX, tables as rows with bars, each longer block once; front matter trimmed, lines repaired."""
    p = parsed(html)
    inner = "".join(x for inside, x in p.out if inside)
    said: dict[str, str] = {}
    for k, block in enumerate((inner if inner.strip() else "".join(x for _, x in p.out)).split("\n")):
        text = "\n".join(filter(None, map(squeezed, block.split(ROW))))
        if len(text) > 1:
            said.setdefault(text.lower() if len(text) >= REPEATED else str(k), text)
    # a caption and its table stay together
    joined = "\n\n".join(said.values())
    return clean_lines(html_front_trimmed(re.sub(r"\n\n(?=[^\n]* \| [^\n]*\n--- \| )", "\n", joined)))


def absolute(url: str, page: str | None, base: str) -> str:
    """An image's address; that of a paper's HTML page is a folder, but for paths that begin with its name."""
    page = page or ""
    last = urlsplit(page).path.rsplit("/", 1)[-1]
    folder = not base and (urlsplit(page).hostname or "").endswith("arxiv.org") and urlsplit(page).path.startswith("/html/") and last
    if folder and not url.startswith(f"{last}/"):
        page += "/"
    return urljoin(urljoin(page, base), url)


def image_of(p: _Page, url: str | None) -> str | None:
    found = next((x for x in (*(p.links.get(n, "") for n in ("og:image", "twitter:image", "image_src")), p.image) if usable(x)), None)
    return absolute(found.strip(), url, p.base) if found else None


def page_image(html: str | None, url: str | None) -> str | None:
    """The page's own choice of image, else the first within its main part, as an absolute url."""
    return image_of(parsed(html), url)


def _both(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    pages = [parsed(h) for h in html]
    return pd.DataFrame({"text": [running_text(p) for p in pages], "image_url": pd.Series([image_of(p, u) for p, u in zip(pages, url, strict=True)], dtype="object")})


def _papers(html: pd.Series) -> pd.Series:
    return html.map(paper_text)


def html_page(html: str, url: str) -> Column:
    """struct<text, image_url>: a page is parsed once for both."""
    return F.pandas_udf(_both, "text string, image_url string")(html, url)


def html_paper(html: str) -> Column:
    return F.pandas_udf(_papers, "string")(html)
