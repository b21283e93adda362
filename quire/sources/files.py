"""Files of attachments: listing, path resolution, snapshots, and the text inside HTML, EPUB and PDF files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType

from quire.config import DEFAULT, EngineConfig
from quire.runtime import ship

_CHARSET = re.compile(rb"charset\s*=\s*['\"]?\s*([\w-]+)", re.I)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, size) of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))


def resolve_paths(attachments: DataFrame, files: DataFrame, data_dir: str, home: str = "~") -> DataFrame:
    """(attachmentKey, pdf_path): the absolute path, the ``storage:`` path or the file name below
    ``storage/KEY``, the first that is there.  Attachments (attachmentKey, path, filename) without any are dropped."""
    root = F.concat(F.lit(data_dir.rstrip("/") + "/storage/"), F.col("attachmentKey"), F.lit("/"))
    absolute = F.when(F.col("path").startswith("~/"), F.concat(F.lit(home), F.substring("path", 2, 1 << 20))).when(F.col("path").startswith("/"), F.col("path"))
    stored = F.when(F.col("path").startswith("storage:"), F.concat(root, F.substring("path", 9, 1 << 20)))
    named = F.when(F.coalesce("filename", F.lit("")) != "", F.concat(root, F.col("filename")))
    wanted = attachments.select("attachmentKey", F.posexplode(F.array(absolute, stored, named)).alias("rank", "candidate")).where("candidate IS NOT NULL")
    there = wanted.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi")
    return there.groupBy("attachmentKey").agg(F.min_by("candidate", "rank").alias("pdf_path"))


def snapshot_files(files: DataFrame) -> DataFrame:
    """(folder, path): of each folder index.html, index.htm, or its first HTML file by name; none gives none."""
    name = F.element_at(F.split("path", "/"), -1)
    low = F.lower(name)
    found = files.where(low.rlike(r"\.html?$")).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.struct(F.when(low == "index.html", 0).when(low == "index.htm", 1).otherwise(2).alias("rank"), name.alias("name"), "path").alias("f"))
    return found.groupBy("folder").agg(F.min("f").alias("f")).select("folder", F.col("f.path").alias("path"))


def decode_html(raw: bytes | None) -> str | None:
    """By the charset that the head names, else as UTF-8; what cannot be decoded is replaced."""
    if raw is None:
        return None
    m = _CHARSET.search(raw[:8192])
    for name in ([m.group(1).decode("ascii", "ignore")] if m else []) + ["utf-8"]:
        try:
            return raw.decode(name, "replace")
        except LookupError:
            continue
    return None


@F.pandas_udf(StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(decode_html, na_action="ignore")


def html_of(content: Column, config: EngineConfig = DEFAULT) -> Column:
    """Text of HTML bytes, cut silently at the size cap."""
    return _decoded(F.substring(content, 1, config.max_html_bytes))


def epub_chapters(raw: bytes) -> Iterator[tuple[int, str | None]]:
    """(chapter index, HTML) in the order of the spine; a chapter that cannot be read counts on with a null."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        base = opf.rpartition("/")[0]
        hrefs = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item") or e.tag == "item"}
        for i, ref in enumerate(e.get("idref") for e in package.iter() if e.tag.endswith("itemref")):
            try:
                yield i, decode_html(z.read(f"{base}/{hrefs[ref]}" if base else hrefs[ref]))
            except (KeyError, zipfile.BadZipFile):
                yield i, None


def read_epubs(files: DataFrame, owner: str = "attachmentKey", content: str = "content") -> DataFrame:
    """(owner, chapter_index, html, error); a broken file gives one row with its error."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, raw in zip(f[owner], f[content]):
                try:
                    rows += [(key, i, h, None) for i, h in epub_chapters(bytes(raw))]
                except Exception as e:  # a broken archive of whatever kind
                    rows.append((key, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[owner, "chapter_index", "html", "error"]).astype({"chapter_index": "Int32"})

    return files.select(owner, content).mapInPandas(run, f"{owner} string, chapter_index int, html string, error string")


def contents(wanted: DataFrame) -> DataFrame:
    """``wanted`` (path and other columns) with the ``content`` of each file, read by the executors that need it; null for
    a file that cannot be read.  Only files named are opened."""
    ship(wanted.sparkSession)
    at = wanted.columns.index("path")
    schema = T.StructType([*wanted.schema.fields, T.StructField("content", T.BinaryType())])

    def read(path: str | None) -> bytes | None:
        try:
            source, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{quote(path)}")
            with source.open_input_stream(name) as f:
                return f.read()
        except Exception:  # gone, forbidden or broken, on whatever file system
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(at).to_pylist()):  # one file a batch, whatever its size
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([read(path)], pa.binary())], names=schema.names)

    return wanted.mapInArrow(run, schema)


def page_blocks(page) -> list[tuple[int, float, float, float, int, str]]:
    """(number, x0, y0, y1, type, text) of a page's blocks; where they fail or hold no text, the paragraphs of its
    plain text, far enough apart to stay so."""
    try:
        found = [(no, float(b[0]), float(b[1]), float(b[3]), int(b[6]), str(b[4])) for no, b in enumerate(page.get_text("blocks"))]
    except Exception:
        found = []
    if any(kind == 0 and text.strip() for *_, kind, text in found):
        return found
    plain = [p for p in re.split(r"\n[^\S\n]*\n", str(page.get_text("text") or "")) if p.strip()]
    return [(no, 0.0, 1000.0 * no, 1000.0 * no, 0, p) for no, p in enumerate(plain)]


def pdf_blocks(raw: bytes, library, timeout: float) -> Iterator[tuple]:
    """Rows of PDF_BLOCKS without the key; a page that fails, or takes longer than ``timeout`` seconds, is an empty page."""
    with library.open(stream=raw, filetype="pdf") as pdf:
        for n, page in enumerate(pdf):
            # a page that never ends keeps its thread, so each has one of its own
            pool = ThreadPoolExecutor(1)
            try:
                blocks = pool.submit(page_blocks, page).result(timeout)
                label = page.get_label() or ""
            except Exception:
                continue
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
            for no, x0, y0, y1, kind, text in blocks:
                yield n, label, no, x0, y0, y1, kind, text


def read_pdfs(files: DataFrame, owner: str = "attachmentKey", content: str = "content", config: EngineConfig = DEFAULT) -> DataFrame:
    """Text blocks of PDF pages (schema ``PDF_BLOCKS`` and error), where a PDF library is installed.

    A file that fails gives one row with its error."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [owner, "page_index", "page_label", "block_no", "x0", "y0", "y1", "block_type", "text", "error"]
        for f in frames:
            rows = []
            for key, raw in zip(f[owner], f[content]):
                try:
                    import fitz  # optional

                    rows += [(key, *b, None) for b in pdf_blocks(bytes(raw), fitz, config.page_timeout)]
                except Exception as e:
                    rows.append((key, *[None] * 8, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names).astype({"page_index": "Int32", "block_no": "Int32", "block_type": "Int32"})

    return files.select(owner, content).mapInPandas(run, f"{owner} string, page_index int, page_label string, block_no int, x0 double, y0 double, y1 double, block_type int, text string, error string")
