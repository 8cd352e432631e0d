"""Sources of files: directory scans, DOCX, corpus texts with front matter and pages, data sets, and dispatch by type."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parsers

PAGE = "<<<PAGE>>>"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCX = parsers.READ[4]
IN_CELL = str.maketrans("|\n", "/ ")


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """path, collection (the first folder below root), raw_sha256 and content of all files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_extract("path", f"\\Q{root.rstrip('/').split('://')[-1].lstrip('/')}\\E/(.+)$", 1)
    return files.select(below.alias("path"), F.split(below, "/")[0].alias("collection"), F.sha2("content", 256).alias("raw_sha256"), "content")


def to_register(files: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned files but those that are ready with the same bytes. known: path, raw_sha256, status."""
    return files.join(known.where("status = 'ready'").select("path", "raw_sha256"), ["path", "raw_sha256"], "left_anti")


def front_matter(text: Column) -> Column:
    """The key: value lines between --- lines at a text's beginning, as a map."""
    head = F.regexp_extract(text, r"^---\r?\n((?s:.*?))\r?\n---(?:\r?\n|$)", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda s: s.rlike(r"^\s*[^:\s][^:]*:"))
    pair = lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)), F.trim(F.regexp_replace(F.regexp_replace(s, r"^[^:]*:", ""), r"^\s*[\"']|[\"']\s*$", "")))
    return F.map_from_entries(F.transform(lines, pair))


def body(text: Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(text, r"^---\r?\n(?s:.*?)\r?\n---(?:\r?\n|$)", "")


def pages(texts: DataFrame) -> DataFrame:
    """doc_id, page (from 1), text: the pages of texts (doc_id, text), without front matter."""
    return texts.select("doc_id", F.posexplode(F.split(body(F.col("text")), PAGE)).alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("page"), F.trim("text").alias("text"))


def dataset_version(items: DataFrame, digest: Column) -> DataFrame:
    """One row: n and version (golden-{n}q- and ten digits), of items (item_id). The version is the digest of the items' digests in
    order of their ids, so a task holds 32 bytes an item and no texts."""
    digests = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "digest"))), lambda x: x["digest"]), "\n")
    whole = items.select("item_id", digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.sha2(digests, 256).alias("sha"))
    return whole.select("n", F.concat(F.lit("golden-"), "n", F.lit("q-"), F.substring("sha", 1, 10)).alias("version"))


def docx_blocks(content: bytes) -> tuple[str | None, list[dict], dict[str, str]]:
    """Title, blocks and metadata of a DOCX file: Title and Heading styles are headings, list paragraphs in a row one list, tables
    Markdown. A file that isn't one has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as parts:
            root = ElementTree.fromstring(parts.read("word/document.xml"))
            core = ElementTree.fromstring(parts.read("docProps/core.xml")) if "docProps/core.xml" in parts.namelist() else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, [], {}
    said = lambda node: "".join((t.text or "") if t.tag == W + "t" else "\n" if t.tag == W + "br" else "\t" if t.tag == W + "tab" else "" for t in node.iter())
    out: list[dict] = []
    items: list[str] = []
    title = None

    def close() -> None:
        nonlocal items
        out.extend(parsers.block("list", "\n".join(items)))
        items = []

    for node in root.find(W + "body") if root.find(W + "body") is not None else ():
        if node.tag == W + "tbl":
            close()
            cells = [[parsers.normalize(said(c)).translate(IN_CELL) for c in r.iter(W + "tc")] for r in node.iter(W + "tr")]
            out += parsers.block("table", parsers.table_text(cells))
        elif node.tag == W + "p":
            style = node.find(f"{W}pPr/{W}pStyle")
            name = (style.get(W + "val") or "").replace(" ", "").lower() if style is not None else ""
            text = parsers.normalize(said(node))
            if name.startswith("list") and text:
                items.append("- " + text)
                continue
            close()
            if name == "title":
                title = title or text or None
                out += parsers.block("heading", text, 1)
            elif name.startswith("heading") and name[7:].isdigit():
                out += parsers.block("heading", text, min(6, max(1, int(name[7:]))))
            else:
                out += parsers.block("paragraph", text)
    close()
    author = next((e.text for e in core.iter() if e.tag.endswith("}creator") and e.text), None) if core is not None else None
    return title or next((b["text"] for b in out if b["kind"] == "heading"), None), out, {"author": author} if author else {}


def read_as(mime: str | None, content: bytes | None) -> tuple[str | None, list[dict]]:
    """Title and blocks of a file by its type; of a type that isn't read, none."""
    if content is None or mime is None:
        return None, []
    if mime == DOCX:
        return docx_blocks(content)[:2]
    text = content.decode("utf-8", "replace")
    if mime == "text/html":
        return parsers.html_blocks(text)
    if mime == "text/markdown":
        blocks = parsers.markdown_blocks(text)
        return next((b["text"] for b in blocks if b["kind"] == "heading" and b["level"] == 1), None), blocks
    if mime == "text/plain":
        return None, [b for part in re.split(r"\n\s*\n", text) for b in parsers.block("paragraph", parsers.normalize(part))]
    return None, []


def ingested(files: DataFrame) -> DataFrame:
    """files (path, content) with mime, refusal, title and blocks: each is read by the parser of its type, which its first bytes and
    name tell. Refused files have no blocks; a title that the content doesn't give is made from the name."""
    @F.pandas_udf(parsers.BLOCKS)
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for mimes, contents in batches:
            yield pd.DataFrame([read_as(m, c) for m, c in zip(mimes, contents)], columns=["title", "blocks"])

    from corpusloom.functions import text as T

    mime = parsers.mime_type(F.col("path"), F.substring("content", 1, 8192))
    typed = files.withColumn("mime", mime).withColumn("refusal", parsers.refusal(F.col("mime")))
    read = typed.withColumn("parsed", each(F.when(F.col("refusal").isNull(), F.col("mime")), F.col("content")))
    return read.withColumns({"title": F.coalesce("parsed.title", T.title_from_filename(F.col("path"))), "blocks": F.col("parsed.blocks")}).drop("parsed")
