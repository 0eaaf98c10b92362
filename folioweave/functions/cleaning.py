"""Cleaning of text extracted from documents: an ordered chain of rewrites, as one projection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions.patterns import BLANKS, DIGIT, LINES, PLAIN, SPACES, WORDS, S
from folioweave.functions.vectors import bound

# The rewrites and their order, which decide the result
REWRITES: list[tuple[str, str, str]] = [
    ("zero width", "[\\x{feff}\\x{200b}\\x{200c}\\x{200d}]", ""),
    ("page number", f"{WORDS}\\b[Pp]age{S}+{DIGIT}+\\b", ""),
    ("page number, Indonesian", f"{WORDS}\\b[Hh]alaman{S}+{DIGIT}+\\b", ""),
    ("page of pages", f"{WORDS}\\b{DIGIT}+{S}+of{S}+{DIGIT}+\\b", ""),
    ("line of a number in brackets", f"{LINES}^{S}*\\[{DIGIT}+\\]{S}*$", ""),
    ("line of a number", f"{LINES}^{S}*{DIGIT}+{S}*$", ""),
    ("ruled line", f"{LINES}^[{SPACES}\\-_=]{{3,}}$", ""),
    ("copyright sign", f"{LINES}©{S}*{DIGIT}{{4}}.*$", ""),
    ("copyright", f"(?Umd)\\b[Cc]opyright{S}*©?{S}*{DIGIT}{{4}}.*$", ""),
    ("address of a page", "https?://[a-z$-_!]+", ""),
    ("address of mail", f"{WORDS}\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b", ""),
    ("control characters", "[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]", ""),
    ("list marks and blank lines", f"{LINES}^[{SPACES}•\\-\\*\\+●○■□▪▫]+", ""),
    ("footnote in brackets", f"\\[{DIGIT}+\\]", ""),
    ("footnote in parentheses", f"\\({DIGIT}+\\)", ""),
    ("end of line", f"{LINES}[ \\t]+$", ""),
    ("start of line", f"{LINES}^[ \\t]+", ""),
    ("spaces", " {2,}", " "),
    ("tabs", "\\t+", " "),
    ("many line ends", "\\n{3,}", "\n\n"),
    ("broken line", f"{PLAIN}(?<=[a-z,;])\\n(?=[a-z])", " "),
    ("blank line", f"{LINES}^{S}*$\\n", ""),
    ("dots", "\\.{3,}", "..."),
    ("dashes", "-{3,}", ""),
    ("underscores", "_{3,}", ""),
    ("equals signs", "={3,}", ""),
]

#: What a text has if the rewrite of that name finds anything: one of these. Looking for them costs far less than a pattern.
NEEDS = {
    "zero width": "\ufeff\u200b\u200c\u200d", "page number": ["age"], "page number, Indonesian": ["alaman"], "page of pages": ["of"], "line of a number in brackets": ["["],
    "copyright sign": ["©"], "copyright": ["opyright"], "address of a page": ["http"], "address of mail": ["@"], "footnote in brackets": ["["], "footnote in parentheses": ["("],
    "spaces": ["  "], "tabs": ["\t"], "many line ends": ["\n\n\n"], "broken line": ["\n"], "blank line": ["\n"], "dots": ["..."], "dashes": ["---"], "underscores": ["___"], "equals signs": ["==="],
}

# Lines that publications repeat on each page
HEADERS = [
    "^{s}*Badan Pusat Statistik.*$",
    "^{s}*Statistics Indonesia.*$",
    "^{s}*www\\.bps\\.go\\.id.*$",
    "^{s}*Katalog.*:.*$",
    "^{s}*ISSN.*:.*$",
    "^{s}*ISBN.*:.*$",
]


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def _rewritten(text: Column, rewrites: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), rewrites, text)


def clean_text(text: Column) -> Column:
    """The whole chain; null as empty."""

    def step(text: Column, rewrite: tuple[str, str, str]) -> Column:
        name, pattern, to = rewrite
        if name not in NEEDS:
            return _rewritten(text, [(pattern, to)])
        return bound(text, lambda t: F.when(reduce(or_, (t.contains(x) for x in NEEDS[name])), _rewritten(t, [(pattern, to)])).otherwise(t))

    return strip(reduce(step, REWRITES, F.coalesce(text, F.lit(""))))


def clean_text_advanced(text: Column, *, remove_numbers: bool = False, remove_punctuation: bool = False) -> Column:
    """The chain, then numbers and punctuation if asked for; runs of spaces and of line ends are shortened in any case."""
    more = [(f"{DIGIT}+", "")] * remove_numbers + [(f"(?U)[^\\w{SPACES}]", "")] * remove_punctuation
    return strip(_rewritten(clean_text(text), [*more, (" {2,}", " "), ("\\n{3,}", "\n\n")]))


def remove_headers_footers(text: Column, patterns: Sequence[str] | None = None) -> Column:
    """Without the lines that match one of ``patterns``, in any case; ``{s}`` in a default stands for any white space."""
    found = [p.replace("{s}", S) for p in HEADERS] if patterns is None else patterns
    return strip(_rewritten(F.coalesce(text, F.lit("")), [*((f"(?imd){p}", "") for p in found), ("\\n{3,}", "\n\n")]))


def reduction_percent(before: Column, after: Column) -> Column:
    """By how much shorter a text has become; 0 for an empty one."""
    size = F.coalesce(F.length(before), F.lit(0))
    return F.when(size == 0, F.lit(0.0)).otherwise((size - F.length(after)) / size * 100)


def stem(name: Column) -> Column:
    """A file's name without directories and its last suffix."""
    return F.regexp_replace(F.regexp_replace(name, "^.*/", ""), "(?<=.)\\.[^.]+$", "")


def join_pages(pages: Column) -> Column:
    """Pages that aren't blank, a line end between each two."""
    return F.array_join(F.filter(pages, lambda p: F.length(strip(p)) > 0), "\n")
