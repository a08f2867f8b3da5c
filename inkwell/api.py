"""What a user calls: text, pages and structure of PDF files, as tables or written out.

    from inkwell import api
    api.extract_text(spark, "store/*.pdf", page_numbers=[0, 1]).show()
    api.write(spark, "store/*.pdf", "out", output_type="xml", all_texts=True)
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import sinks
from inkwell.sources.pdf import read_pdf
from inkwell.sources.shared import shared_dir

#: Output types by name and by file extension.
OUTPUTS = {"text": "text", "xml": "xml", "html": "html", "hocr": "hocr", "tag": "tagged"}
EXTENSIONS = {".htm": "html", ".html": "html", ".xml": "xml", ".tag": "tag", ".txt": "text", ".hocr": "hocr"}


def _ordered(pages: DataFrame) -> DataFrame:
    """(doc_id, parts): the strings of a document's pages in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    return pages.filter("error IS NULL").groupBy("doc_id").agg(parts.alias("parts"))


def extract_text(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """(doc_id, text) of all files."""
    return _ordered(read_pdf(spark, path, "text", **options)).select("doc_id", F.array_join("parts", "").alias("text"))


def extract_pages(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """(doc_id, page_no, lines): lines of a page in reading order with their boxes."""
    lines = read_pdf(spark, path, "text_lines", **options).filter("error IS NULL")
    return lines.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("line_id", "box_id", "vertical", "x0", "y0", "x1", "y1", "text"))).alias("lines"))


def documents(spark: SparkSession, path: str, output_type: str = "text", codec: str | None = "utf-8", **options: Any) -> DataFrame:
    """(doc_id, text): whole documents of an output type. Pages are put between a head and a foot with built-in functions."""
    if output_type not in OUTPUTS:
        raise ValueError(f"output type {output_type}")
    parts = _ordered(read_pdf(spark, path, OUTPUTS[output_type], **options))
    body = F.array_join("parts", "")
    if output_type in ("xml", "hocr"):
        head, foot = (sinks.xml_document if output_type == "xml" else sinks.hocr_document)(["\0"], codec).split("\0")
        body = F.concat(F.lit(head), body, F.lit(foot))
    elif output_type == "html":
        head, _ = sinks.html_document(["\0"], codec).split("\0")
        links = F.array_join(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.format_string('<a href="#%d">%d</a>', i, i)), ", ")
        body = F.concat(F.lit(head), body, F.lit('<div style="position:absolute; top:0px;">Page: '), links, F.lit("</div>\n</body></html>\n"))
    return parts.select("doc_id", body.alias("text"))


def write(spark: SparkSession, path: str, target: str, output_type: str = "text", **options: Any) -> None:
    """Write whole documents as Parquet rows of (doc_id, text), one file per task."""
    documents(spark, path, output_type, **options).write.mode("overwrite").parquet(target)


def write_images(spark: SparkSession, path: str, folder: str, **options: Any) -> DataFrame:
    """Put the images of all files into a folder on a path that all executors can open: one folder for each document, named by its file and a checksum of its
    path, with the images' names in it (signs other than letters, digits and ``_.-~`` as ``%xx``). Gives (doc_id, name, file, size) of what was written. An image is
    written aside and renamed, so a task that runs twice leaves whole files.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"images go to a folder that executors can open, not to {folder}")
    folder = folder.removeprefix("file://")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, sizes = [], []
            for doc_id, name, extension, data in zip(*(b[c].to_pylist() for c in ("doc_id", "name", "extension", "data")), strict=True):
                stem = quote(os.path.basename(doc_id).removesuffix(".pdf"), safe="")
                own = os.path.join(folder, f"{stem}-{zlib.crc32(doc_id.encode()):08x}")
                os.makedirs(own, exist_ok=True)
                files.append(os.path.join(own, quote(name, safe="") + extension))
                aside = os.path.join(own, f".{uuid.uuid4().hex}")
                with open(aside, "wb") as f:
                    f.write(data)
                os.replace(aside, files[-1])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["name"], pa.array(files, pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", "name", "file", "size"])

    images = read_pdf(spark, path, "images", **options).filter("error IS NULL").select("doc_id", "name", "extension", "data")
    written = shared_dir(spark, "images")
    images.mapInArrow(put, "doc_id string, name string, file string, size long").write.parquet(written)  # once, however often the result is read
    return spark.read.parquet(written)


def toc(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return read_pdf(spark, path, "outlines", **options).select("doc_id", "seq", "level", "title", "page_no")


def main(argv: list[str] | None = None) -> None:
    """Command line: files to standard output or to a folder."""
    import argparse

    p = argparse.ArgumentParser(prog="inkwell", description="Text and structure of PDF files")
    p.add_argument("path")
    p.add_argument("-o", "--outfile", help="a folder; standard output without it")
    p.add_argument("-O", "--output-dir", help="a folder for the images")
    p.add_argument("-t", "--output_type", choices=[*OUTPUTS, "objects", "outlines", "trailers"], default=None)
    p.add_argument("-p", "--page-numbers", type=int, nargs="*", default=[], help="from 1")
    p.add_argument("-m", "--maxpages", type=int, default=0)
    p.add_argument("-P", "--password", default="")
    p.add_argument("-R", "--rotation", type=int, default=0)
    p.add_argument("-n", "--no-laparams", action="store_true")
    p.add_argument("-V", "--detect-vertical", action="store_true")
    p.add_argument("-A", "--all-texts", action="store_true")
    p.add_argument("-S", "--strip-control", action="store_true")
    p.add_argument("--line-overlap", type=float, default=0.5)
    p.add_argument("-M", "--char-margin", type=float, default=2.0)
    p.add_argument("-W", "--word-margin", type=float, default=0.1)
    p.add_argument("-L", "--line-margin", type=float, default=0.5)
    p.add_argument("-F", "--boxes-flow", default="0.5")
    p.add_argument("-s", "--scale", type=float, default=1.0)
    p.add_argument("-Y", "--layoutmode", choices=["normal", "exact", "loose"], default="normal")
    a = p.parse_args(argv)
    kind = a.output_type or EXTENSIONS.get(os.path.splitext(a.outfile or "")[1], "text")
    options = {k: getattr(a, k) for k in ("maxpages", "password", "rotation", "detect_vertical", "all_texts", "strip_control", "line_overlap", "char_margin", "word_margin", "line_margin", "boxes_flow", "scale", "layoutmode")}
    options |= {"page_numbers": tuple(n - 1 for n in a.page_numbers), "layout": not a.no_laparams}
    spark = SparkSession.builder.getOrCreate()
    if a.output_dir:
        options["image_names"] = kind in ("xml", "html")
        write_images(spark, a.path, a.output_dir, **options)
    df = read_pdf(spark, a.path, kind, **options) if kind in ("objects", "outlines", "trailers") else documents(spark, a.path, kind, **options)
    if a.outfile:
        df.write.mode("overwrite").parquet(a.outfile)
        return
    for row in df.toLocalIterator():
        print(row["text"] if "text" in row else row.asDict(), end="" if "text" in row else "\n")


if __name__ == "__main__":
    main()
