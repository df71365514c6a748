"""Text of papers out of pages, PDF blocks, tables and TeX: reading order, line wraps, noise, front matter."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lines import CLOSING, _LEFT_BY_FIGURE, plot_row

FRONT = 260
#: What affiliations and notes of a title page hold, section names, common words, names of columns. Fixed values.
AFFILIATION = re.compile(r"(?i)\b(?:department|university|institute|center|centre|observatory|school|laboratory|correspondence|preprint|fellow)\b|@")
SECTIONS = frozenset("abstract introduction methods results discussion references".split())
COMMON = frozenset("the and for with from this that these those is are was were be in on of to by as we our their".split())
COLUMN_NAMES = frozenset("the and for with from into edge score round query key agent outcome".split())

_NUMBERED = re.compile(r"[\[(]?\d+[\])]?\s")
_GOES_ON = re.compile(r"[a-z0-9(\[]")
_ENDS = re.compile(r"[.!?:)]$")
_NOISE = re.compile(r"[a-z]\)|Fig\.\s+[A-Za-z0-9].*|Figure\s+[A-Za-z0-9]+:.*|(?i:arxiv:|doi:).*|\d+(?:\.\d+)?\s+\d+(?:\.\d+)?\s+[a-zA-Z]\).*|[-−]?\d+(?:\.\d+)?(?:\s+[-−]?\d+(?:\.\d+)?){2,}")


def heading(line: str) -> bool:
    """Whether a line is a heading: numbered, a usual section, or a few words in title case."""
    s = line.strip()
    if re.match(r"\d+(?:\.\d+)*\s+[A-Z]", s) or s.lower() in SECTIONS:
        return True
    return len(s) <= 80 and len(s.split()) <= 10 and s == s.title() and sum(c.isalpha() for c in s) >= 2 and not re.search(r"\d", s)


def reflowed(text: str) -> str:
    """Wrapped lines of a PDF as paragraphs: words split at line ends, lists after commas, keywords, sentences over one empty line. Page numbers go."""
    out: list[str] = []
    for line in map(str.strip, text.splitlines()):
        if not line:
            out += [""] if out and out[-1] else []
        elif re.fullmatch(r"\d+", line):
            continue
        else:
            gap = len(out) > 1 and not out[-1]
            before = out[-2] if gap else out[-1] if out else ""
            plain = before and not heading(line)
            wrapped = plain and not _ENDS.search(before) and _GOES_ON.match(line) and not heading(before)
            if before and not gap and before.endswith("-") and line[0].islower():
                # a compound keeps its hyphen
                out[-1] = before[: len(before) - ("-" not in before[:-1].split(" ")[-1])] + line
            elif gap and wrapped:
                out[-2:] = [f"{before} {line}"]
            elif plain and not gap and (wrapped or before.endswith(",") or (before.lower().startswith("keywords:") and len(line.split()) <= 8 and not re.search("[.!?]", line))):
                out[-1] = f"{before} {line}"
            else:
                out.append(line)
    return "\n".join(out)


def figure_text(line: str) -> bool:
    """Whether a PDF line is what a figure leaves: captions, panels, ticks, dense rows of numbers and signs."""
    s = line.strip()
    if not s or "|" in s:
        return False
    if _NOISE.fullmatch(s) and (not heading(s) or s[0] in "Ff" or s[1:] == ")"):
        return True
    if heading(s):
        return False
    letters, digits, tokens = sum(c.isalpha() for c in s), sum(c.isdigit() for c in s), s.split()
    if _LEFT_BY_FIGURE.fullmatch(s) and not re.fullmatch(r"\d+(?:\.\d+)?\s+\d+(?:\.\d+)?", s) or (digits >= 5 and 0 < letters < 0.22 * len(s)):
        return True
    if len(tokens) < 8 or s.endswith(CLOSING):
        return False
    worded = [t.lower().strip(".,;:()[]{}") for t in tokens if re.search("[A-Za-z]", t)]
    few_common = sum(t in COMMON for t in worded) <= 0.25 * max(1, len(worded))
    numbers, short = sum(bool(re.search(r"\d", t)) for t in tokens), sum(len(t) <= 3 for t in tokens)
    panel, sign = re.search(r"[a-zA-Z]\)", s), re.search(r"[≈±χλμσΣΔ⊙\[\]{}]", s)
    return bool(numbers >= 2 and few_common and sign and (panel or short >= 0.3 * len(tokens))) or bool(panel and plot_row(s))


def without_figure_text(text: str) -> str:
    return "\n".join(x for x in text.splitlines() if not figure_text(x))


def split_comparisons_joined(text: Column) -> Column:
    """A line that ends in a comparison sign and the number on the next line, as one line."""
    return F.regexp_replace(text, r"([<>≤≥])[ \t]*\n[ \t]*(?=\d)", "$1 ")


def front_matter(lines: list[str]) -> tuple[int, str]:
    """The line at which the abstract begins (-1: none) and the first line before it that may be the title."""
    at = next((k for k, x in enumerate(lines[:FRONT]) if x.strip().lower() == "abstract"), -1)
    title = next((s for s in map(str.strip, lines[: max(at, 0)]) if 4 <= len(s.split()) and not AFFILIATION.search(s) and "arxiv:" not in s.lower() and not _NUMBERED.match(s)), "")
    return at, title


def pdf_front_trimmed(text: str) -> str:
    """From the abstract on, under the title."""
    lines = text.splitlines()
    at, title = front_matter(lines)
    if at <= 0:
        return text
    own = "\n".join(lines[at:])
    return own if not title or title in "\n".join(lines[at : at + 12]) else f"{title}\n\n{own}"


def html_front_trimmed(text: str) -> str:
    """The same where enough of what stands before the abstract is affiliations or notes."""
    lines = text.splitlines()
    at, title = front_matter(lines)
    before = [x.strip() for x in lines[: max(at, 0)] if x.strip()]
    notes = sum(bool(AFFILIATION.search(x) or re.match(r"\[?\d+\]?\s", x)) for x in before)
    if at <= 2 or not before or notes < max(4, int(0.35 * len(before))):
        return text
    return "\n".join([*([title, ""] if title and len(title) <= 180 else []), *lines[at:]]).strip()


def pdf_text(text: str | None) -> str:
    """All steps for a PDF's text."""
    flowed = re.sub(r"([<>≤≥])[ \t]*\n[ \t]*(?=\d)", r"\1 ", reflowed(text or ""))
    return re.sub(r"\n{3,}", "\n\n", pdf_front_trimmed(without_figure_text(flowed))).strip()


def in_reading_order(blocks: list[tuple[float, float, float, float, str]], width: float) -> str:
    """Blocks (x0, y0, x1, y1, text) of a page from top to bottom; where there are two columns with a gap between, the left one first."""
    placed = sorted(((y0, x0, x1, t.strip()) for x0, y0, x1, _, t in blocks if t and t.strip()), key=lambda b: b[:2])
    columns: tuple[list, list] = ([], [])
    for b in placed:
        columns[(b[1] + b[2]) / 2 > width / 2].append(b)
    small, large = sorted(map(len, columns))
    if len(placed) >= 6 and width > 0 and small >= 3 and large <= 5 * small and min(b[1] for b in columns[1]) - max(b[2] for b in columns[0]) >= 0.03 * width:
        return "\n".join([*(b[3] for b in columns[0]), "", *(b[3] for b in columns[1])])
    return "\n".join(b[3] for b in placed)


def pipe_rows(rows: Column) -> Column:
    """A table (array of arrays of cells) as rows with bars under a head; null for one too small, too empty, or torn prose taken for a table."""
    cell = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), r"\b([A-Za-z]{2,})- ([a-z]{2,})\b", "$1$2")
    full = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    n, width = F.size(full), F.coalesce(F.array_max(F.transform(full, F.size)), F.lit(0))
    filled = F.size(F.filter(F.flatten(full), lambda c: c != ""))
    words = F.filter(F.flatten(F.slice(full, 2, F.greatest(n - 1, F.lit(0)))), lambda c: c.rlike("^[A-Za-z]{2,12}$"))
    torn = F.size(F.filter(words, lambda c: ~F.lower(c).isin(*COLUMN_NAMES) & F.left(c, F.lit(1)).rlike("[a-z]")))
    prose = (width >= 5) & (filled >= 4 * n) & (torn >= 0.45 * F.greatest(F.size(words), F.lit(1)))
    lines = F.transform(full, lambda r: F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "))
    rule = F.array_join(F.array_repeat(F.lit("---"), width), " | ")
    return F.when((n >= 2) & (width >= 2) & (filled >= 0.3 * n * width) & ~prose, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(n - 1, F.lit(0)))), "\n"))


#: Environments of TeX and what stands for them. Fixed values.
ENVIRONMENTS = {"equation": "MATH", "align": "MATH", "figure": "FIGURE", "table": "TABLE"}


def tex_text(tex: Column) -> Column:
    """TeX as text: comments go, formulas, figures and tables become marks, commands spaces, braces spaces."""
    out = F.regexp_replace(tex, r"(?m)(?<!\\)%.*$", "")
    for name, mark in ENVIRONMENTS.items():
        out = F.regexp_replace(out, rf"(?s)\\begin\{{{name}\*?\}}.*?\\end\{{{name}\*?\}}", f"\n[{mark}]\n")
    out = F.regexp_replace(out, r"\$[^$]+\$", " [MATH] ")
    return F.translate(F.regexp_replace(out, r"\\[a-zA-Z]+\*?(\[[^\]]*\])?", " "), "{}", "  ")


def _pdf(text: pd.Series) -> pd.Series:
    return text.map(pdf_text)


def pdf_cleaned(text: str) -> Column:
    return F.pandas_udf(_pdf, "string")(text)


def _ordered(blocks: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([in_reading_order([(b["x0"], b["y0"], b["x1"], b["y1"], b["text"]) for b in own], w) for own, w in zip(blocks, width, strict=True)], dtype="object")


def read_in_order(blocks: str, width: str) -> Column:
    """Of array<struct<x0,y0,x1,y1,text>> and the page's width."""
    return F.pandas_udf(_ordered, "string")(blocks, width)
