"""Readers that turn files and pages into blocks (kind, text, level, page) on Spark rows."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.sources import tables

BLOCKS = "title string, blocks array<struct<kind: string, text: string, level: int, page: int>>"

# Types that are read, and marks of executable files.
READ = ["text/plain", "text/markdown", "text/html", "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
FORBIDDEN = ["application/x-dosexec", "application/x-executable", "application/x-mach-binary"]
SKIPPED = {"nav", "header", "footer", "aside", "script", "style", "noscript", "form"}
CLOSED = {"br", "img", "hr", "meta", "link", "input"}


def normalize(text: str) -> str:
    """Composes signs, drops soft hyphens, and evens out white space."""
    text = unicodedata.normalize("NFKC", text).replace("­", "")
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", text)
    text = re.sub(r"[ \t ]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalized(text: Column) -> Column:
    """`normalize` as a column. Signs are composed in Python, for texts that aren't plain ASCII only."""
    return even(F.coalesce(composed(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text))


def even(text: Column) -> Column:
    """What `normalize` does once signs are composed."""
    bare = F.translate(text, "\u00ad", "")
    spaced = F.regexp_replace(F.regexp_replace(bare, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "), r"[ \t\xa0]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(spaced, r" *\n *", "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


def text_blocks(texts: DataFrame) -> DataFrame:
    """doc_id, ordinal (from 0), text: the paragraphs of plain texts (doc_id, text), cut at blank lines and normalised; empty ones and
    null texts have none. Signs are composed once a text, which no cut depends on: line ends have no other forms."""
    parts = F.transform(F.split("text", r"\n\s*\n"), even)
    wide = composed(F.when(F.col("text").rlike(r"[^\x00-\x7f]"), F.col("text")))
    whole = texts.select("doc_id", F.coalesce(wide, "text").alias("text"))
    return whole.select("doc_id", F.posexplode(F.filter(parts, lambda p: p != "")).alias("ordinal", "text"))


def mime_type(path: Column, head: Column) -> Column:
    """From the first 8 KiB (binary), and the name where these are text. A zip file is a document if it has its members;
    scripts have types of their own, which aren't read."""
    magic = F.hex(F.substring(head, 1, 4))
    plain = F.decode(head, "ISO-8859-1")
    starts = F.lower(F.trim(F.substring(F.decode(F.substring(head, 1, 256), "ISO-8859-1"), 1, 256)))
    name = F.lower(path)
    return (
        F.when(magic == "25504446", "application/pdf")
        .when(magic.startswith("4D5A"), FORBIDDEN[0])
        .when(magic == "7F454C46", FORBIDDEN[1])
        .when(magic.isin("CFFAEDFE", "FEEDFACF"), FORBIDDEN[2])
        .when(magic == "504B0304", F.when(plain.contains("word/"), READ[4]).otherwise("application/zip"))
        .when(magic == "89504E47", "image/png").when(magic.startswith("FFD8FF"), "image/jpeg").when(magic == "47494638", "image/gif")
        .when(plain.contains("\x00"), "application/octet-stream")
        .when(plain.startswith("#!") & F.regexp_extract(plain, r"^#!([^\r\n]*)", 1).contains("python") | name.rlike(r"\.py$"), "text/x-python")
        .when(plain.startswith("#!") | name.rlike(r"\.sh$"), "text/x-shellscript")
        .when(starts.rlike("^(<!doctype html|<html)") | name.rlike(r"\.html?$"), "text/html")
        .when(name.rlike(r"\.(md|markdown)$"), "text/markdown")
        .otherwise("text/plain")
    )


def refusal(mime: Column) -> Column:
    """Why a file isn't read; null if it is."""
    return F.when(mime.isin(FORBIDDEN), "forbidden_type").when(~mime.isin(READ), "unsupported_type")


def table_text(cells: list[list[str]]) -> str:
    """Lists of cells as the lines of a table, the first one its head; lists without text go, short ones are filled up."""
    columns = list(itertools.zip_longest(*filter(any, cells), fillvalue=""))
    lines = [f"| {' | '.join(line)} |" for line in zip(*columns)]
    return "\n".join([*lines[:1], "|" + "---|" * len(columns), *lines[1:]]) if lines else ""


def block(kind: str, text: str, level: int = 0) -> list[dict]:
    return [{"kind": kind, "text": text, "level": level, "page": None}] if text else []


def markdown_blocks(text: str) -> list[dict]:
    """Headings, lists, fenced code, tables and paragraphs of Markdown, without front matter."""
    if text.startswith("---\n") and (end := text.find("\n---", 4)) >= 0:
        text = text[end + 4 :]
    out: list[dict] = []
    lines, k = text.split("\n"), 0
    item = re.compile(r"^(\s*)(?:[-*+]|\d+[.)])\s+(.*)")
    while k < len(lines):
        line = lines[k]
        if m := re.match(r"^ {0,3}(```+|~~~+)", line):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
            out += block("code", "\n".join(lines[k + 1 : end]).rstrip())
            k = end + 1
        elif m := re.match(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out += block("heading", normalize(m[2]), len(m[1]))
            k += 1
        elif "|" in line and k + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[k + 1]) and "-" in lines[k + 1]:
            end = next((j for j in range(k + 2, len(lines)) if "|" not in lines[j]), len(lines))
            rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in (line, *lines[k + 2 : end])]
            shown = ["| " + " | ".join(r) + " |" for r in rows]
            out += block("table", "\n".join([shown[0], "|" + "|".join("---" for _ in rows[0]) + "|", *shown[1:]]))
            k = end
        elif item.match(line):
            items: list[str] = []
            while k < len(lines) and lines[k].strip():
                if m := item.match(lines[k]):
                    items.append("  " * (len(m[1].expandtabs(4)) // 2) + "- " + normalize(m[2]))
                else:
                    items[-1] += " " + normalize(lines[k])
                k += 1
            out += block("list", "\n".join(items))
        elif line.strip():
            end = k + 1
            while end < len(lines) and lines[end].strip() and not re.match(r"^ {0,3}(#{1,6}\s|```|~~~)", lines[end]) and not item.match(lines[end]):
                end += 1
            out += block("paragraph", normalize("\n".join(lines[k:end])))
            k = end
        else:
            k += 1
    return out


class Page(HTMLParser):
    """The main content of an HTML page as blocks; navigation and scripts are left out."""

    def __init__(self, precise: bool = False) -> None:
        """precise: of what is inside main or article tags only."""
        super().__init__(convert_charrefs=True)
        self.precise = precise
        self.out: list[dict] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.title: list[str] = []
        self.rows: list[list[str]] = []

    def flush(self, kind: str = "paragraph", level: int = 0) -> None:
        text, self.text = normalize("".join(self.text)), []
        self.out += block(kind, text, level)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSED:
            if tag == "br":
                self.text.append("\n")
            return
        if tag in {"p", "div", "section", "article", "ul", "ol", "table", "pre"} | {f"h{k}" for k in range(1, 7)} and "li" not in self.open:
            self.flush()
        if tag == "tr":
            self.rows.append([])
        if tag in {"li", "td", "th"}:
            self.text = [] if tag != "li" or not self.text else self.text
        self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open.pop() != tag:
            pass
        if tag in {f"h{k}" for k in range(1, 7)}:
            self.flush("heading", int(tag[1]))
        elif tag == "li":
            text, self.text = normalize("".join(self.text)), []
            if text and not any(t in SKIPPED for t in self.open):
                self.rows.append(["- " + text])
        elif tag in {"td", "th"} and self.rows:
            self.rows[-1].append(normalize("".join(self.text)).replace("|", "/"))
            self.text = []
        elif tag in {"ul", "ol"}:
            rows, self.rows = self.rows, []
            self.out += block("list", "\n".join(r[0] for r in rows if r))
        elif tag == "table":
            cells, self.rows = self.rows, []
            self.out += block("table", table_text(cells))
        elif tag == "pre":
            text, self.text = "".join(self.text).rstrip(), []
            self.out += block("code", text)
        elif tag in {"p", "div", "section", "article", "body", "html"}:
            self.flush()

    def handle_data(self, data: str) -> None:
        if "title" in self.open:
            self.title.append(data)
        elif not any(t in SKIPPED for t in self.open) and "head" not in self.open and (not self.precise or "main" in self.open or "article" in self.open):
            self.text.append(data)


# Fixed value: the share of all text that the main part must hold to be taken alone.
PRECISE_SHARE = 0.6
MAIN = re.compile(r"<(?:main|article)[\s>]", re.IGNORECASE)


def read_page(html: str, precise: bool) -> Page:
    page = Page(precise)
    page.feed(html)
    page.close()
    page.flush()
    return page


def html_blocks(html: str) -> tuple[str | None, list[dict]]:
    """Title and blocks of a page; the title is cut at " | "."""
    page = read_page(html, False)
    if MAIN.search(html):
        precise = read_page(html, True)
        signs = [sum(len(b["text"]) for b in p.out) for p in (precise, page)]
        page = precise if signs[0] >= PRECISE_SHARE * signs[1] else page
    first = next((b["text"] for b in page.out if b["kind"] == "heading"), None)
    title = normalize("".join(page.title)).split(" | ")[0] or first
    return title, page.out


def parsed(rows: DataFrame, content: str, kind: str) -> DataFrame:
    """rows with title and blocks of the text column `content`; kind: markdown or html. The title is null
    where the content names none; null content has no blocks. Batches are bounded by bytes, as pages and their blocks lie in a task's memory."""
    tables.bounded_batches(rows.sparkSession)

    @F.pandas_udf(BLOCKS)
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                if kind == "html":
                    out.append(html_blocks(t or ""))
                else:
                    blocks = markdown_blocks(t or "")
                    out.append((next((b["text"] for b in blocks if b["kind"] == "heading" and b["level"] == 1), None), blocks))
            yield pd.DataFrame(out, columns=["title", "blocks"])

    return rows.withColumn("parsed", each(content)).withColumns({"title": F.col("parsed.title"), "blocks": F.col("parsed.blocks")}).drop("parsed")
