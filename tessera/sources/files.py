"""Files with receipts, documents' pages, and addresses that may be fetched."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sizes import maybe_broadcast
from ..operators.governance import enforce, url_rule

MAX_FILE_BYTES = 25 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, size_bytes, sha256, content of every file below ``path``."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def receipt_violations(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """filename and rule of receipts that their file doesn't match, and of files too large or no PDF."""
    got = files.select("filename", F.col("size_bytes").alias("_n"), F.col("sha256").alias("_h"), F.substring("content", 1, 5).alias("_magic"))
    rows = receipts.join(got, "filename", "left")
    rule = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > MAX_FILE_BYTES, "too large").when(F.col("_n") != F.col("size_bytes"), "size")
        .when(F.col("_h") != F.col("sha256"), "sha256").when(F.col("_magic") != F.encode(F.lit("%PDF-"), "UTF-8"), "not a PDF")
    )
    return rows.select("filename", rule.alias("rule")).where("rule IS NOT NULL")


def fetch_violations(receipts: DataFrame, hosts: list[str]) -> DataFrame:
    """document_id and rule of downloads whose first or final address or media type isn't allowed."""
    rules = [url_rule(F.col(c), hosts) for c in ("download_url", "resolved_url")]
    rules.append(F.when(T.media_type(F.col("content_type")) != "application/pdf", "media type"))
    return receipts.select("document_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def _allowed(url: str, hosts: list[str]) -> str:
    parts = urllib.parse.urlsplit(url)
    if parts.scheme != "https" or (parts.hostname or "").lower() not in hosts:
        raise ValueError(f"not an allowed address: {url}")
    return url


class _Redirects(urllib.request.HTTPRedirectHandler):
    """Follows redirects to allowed addresses only."""

    def __init__(self, hosts: list[str]) -> None:
        self.hosts = hosts

    def redirect_request(self, req: Any, fp: Any, code: int, msg: str, headers: Any, newurl: str) -> Any:
        return super().redirect_request(req, fp, code, msg, headers, _allowed(newurl, self.hosts))


def download(url: str, target: str, hosts: list[str], opener: Any = None, timeout: float = 60, limit: int = MAX_FILE_BYTES) -> dict[str, Any]:
    """Fetch one PDF to ``target``, hashing it as it comes, and give its receipt.

    Every address on the way must be HTTPS on one of ``hosts``; the media
    type, the first bytes and the size, as declared and as received, are
    checked. ``target`` appears only once the whole file is there.
    """
    opener = opener or urllib.request.build_opener(_Redirects(hosts))
    with opener.open(_allowed(url, hosts), timeout=timeout) as response, tempfile.NamedTemporaryFile(dir=Path(target).parent, delete=False) as part:
        try:
            resolved, kind = _allowed(response.geturl(), hosts), response.headers.get("Content-Type", "")
            if kind.partition(";")[0].strip().lower() != "application/pdf":
                raise ValueError(f"media type {kind!r}")
            if int(response.headers.get("Content-Length") or 0) > limit:
                raise ValueError("too large")
            digest, size = hashlib.sha256(), 0
            while block := response.read(1 << 16):
                if not size and not block.startswith(b"%PDF-"):
                    raise ValueError("not a PDF")
                size += len(block)
                if size > limit:
                    raise ValueError("too large")
                digest.update(block)
                part.write(block)
            if not size:
                raise ValueError("no content")
            part.flush()
            os.replace(part.name, target)
        finally:
            Path(part.name).unlink(missing_ok=True)
    return {"filename": Path(target).name, "download_url": url, "resolved_url": resolved, "content_type": kind, "size_bytes": size, "sha256": digest.hexdigest()}


def guarded(reader: Callable[[bytes], Any]) -> Callable[[], Callable[[bytes], list[str | None]]]:
    """What :func:`extract_pages` takes, from a PDF library's reader: encrypted files are tried with no password."""

    def extract(content: bytes) -> list[str | None]:
        document = reader(content)
        if getattr(document, "is_encrypted", False) and not document.decrypt(""):
            raise ValueError("encrypted")
        return [page.extract_text() for page in document.pages]

    return lambda: extract


Extractor = Callable[[], Callable[[bytes], list[str | None]]]


def extract_pages(files: DataFrame, extractor: Extractor | dict[str, Extractor], name: str = "plain", version: str = "1", kind_col: str = "kind") -> DataFrame:
    """document_id, page_id, page_number, page_count, character_count, is_empty, text of each file's pages.

    ``extractor`` makes, once per worker, what turns a file's bytes into its
    pages' texts: a PDF library, where one is installed. Several are chosen
    from by a file's ``kind_col``, and a page names the one it came from. A
    file without pages, or of a kind that none takes, is an error;
    :func:`extraction_violations` lists them all instead.
    """
    return _pages(files, extractor, name, version, kind_col, strict=True).drop("failure")


def extraction_violations(files: DataFrame, extractor: Extractor | dict[str, Extractor], kind_col: str = "kind") -> DataFrame:
    """document_id and rule of files that give no pages: "kind", "no pages", or what their extractor said."""
    rows = _pages(files, extractor, "", "", kind_col, strict=False)
    return rows.where("failure IS NOT NULL").select("document_id", F.col("failure").alias("rule"))


#: What a worker holds of pages before it hands them on, however many files one Arrow batch has.
HELD_CHARS, HELD_ROWS = 1 << 20, 4096
PAGE_TYPES = {"document_id": pa.string(), "kind": pa.string(), "page_number": pa.int32(), "page_count": pa.int32(), "text": pa.string(), "failure": pa.string()}


def _pages(files: DataFrame, extractor: Extractor | dict[str, Extractor], name: str, version: str, kind_col: str, strict: bool) -> DataFrame:
    several = isinstance(extractor, dict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Callable[[bytes], list[str | None]]] = {}

        def pages_of(kind: str, content: bytes) -> list[str | None]:
            if several and kind not in extractor:
                raise ValueError("kind")
            if kind not in made:
                made[kind] = (extractor[kind] if several else extractor)()
            found = made[kind](content)
            if not found:
                raise ValueError("no pages")
            return found

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PAGE_TYPES.values(), strict=True)], list(PAGE_TYPES))

        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for document, kind, content in zip(*batch.columns, strict=True):  # one file's bytes at a time
                document, kind, content = document.as_py(), kind.as_py(), content.as_py()
                try:
                    pages = pages_of(kind, content)
                except ValueError as e:
                    if strict:
                        raise ValueError(f"{document}: {e}") from e
                    pages = []
                    rows.append((document, kind, None, None, None, str(e)))
                n = len(pages)
                for i, t in enumerate(pages):
                    rows.append((document, kind, i + 1, n, t, None))
                    held += len(t or "")
                    if held > HELD_CHARS or len(rows) >= HELD_ROWS:
                        yield given(rows)
                        rows, held = [], 0
            if rows:
                yield given(rows)
            del batch
            pa.default_memory_pool().release_unused()

    kind = F.coalesce(F.col(kind_col).cast("string"), F.lit("")) if several else F.lit(name)
    rows = files.select(F.col("document_id").cast("string").alias("document_id"), kind.alias("kind"), "content").mapInArrow(run, "document_id string, kind string, page_number int, page_count int, text string, failure string")
    text = T.normalize_newlines(F.col("text"))
    return rows.select(
        "document_id", T.page_id(F.col("document_id"), F.col("page_number")).alias("page_id"), "page_number", "page_count", F.length(text).alias("character_count"),
        (T.strip(text) == "").alias("is_empty"), text.alias("text"), F.col("kind").alias("extractor"), F.lit(version).alias("extractor_version"), "failure",
    )


#: What a page says of its document, and of the file that was fetched for it.
DOCUMENT_FIELDS = ("title", "organization", "source_url", "download_url", "publication_date", "adoption_date", "version", "jurisdiction", "document_category", "legal_status", "language")


def page_records(pages: DataFrame, documents: DataFrame, receipts: DataFrame, corpus_id: str, corpus_version: str, method: str = "text") -> DataFrame:
    """Each page with all that a citation needs: its corpus, document, file and extraction.

    ``pages`` are those of :func:`extract_pages`; ``documents`` has
    document_id and ``DOCUMENT_FIELDS``, ``receipts`` document_id, filename,
    sha256 and retrieved_date. A page without either, or with several, is an
    error: see :func:`record_violations`.
    """
    enforce(record_violations(pages, documents, receipts), "page records")
    about = documents.select(F.col("document_id").cast("string").alias("document_id"), *DOCUMENT_FIELDS)
    file = receipts.select(F.col("document_id").cast("string").alias("document_id"), F.col("filename").alias("source_filename"), F.col("sha256").alias("document_sha256"), "retrieved_date")
    rows = pages.join(maybe_broadcast(about), "document_id").join(maybe_broadcast(file), "document_id")
    return rows.select(
        F.lit("1.0").alias("schema_version"), F.lit(corpus_id).alias("corpus_id"), F.lit(corpus_version).alias("corpus_version"), "page_id", "document_id", *DOCUMENT_FIELDS, "source_filename", "document_sha256", "retrieved_date",
        "page_number", "page_count", F.lit(method).alias("extraction_method"), "extractor", "extractor_version", "character_count", "is_empty", "text",
    )


def record_violations(pages: DataFrame, documents: DataFrame, receipts: DataFrame) -> DataFrame:
    """document_id and rule of documents whose pages cannot be cited: "no document", "no receipt", "document repeated", "receipt repeated", "no pages"."""
    found = pages.select(F.col("document_id").cast("string").alias("document_id")).distinct().withColumn("_pages", F.lit(1))
    count = lambda df, n: df.groupBy(F.col("document_id").cast("string").alias("document_id")).agg(F.count("*").alias(n))
    rows = found.join(count(documents, "_documents"), "document_id", "full_outer").join(count(receipts, "_receipts"), "document_id", "full_outer")
    faults = F.array_compact(F.array(
        F.when(F.col("_pages").isNull(), "no pages"), F.when(F.col("_documents").isNull(), "no document"), F.when(F.col("_receipts").isNull(), "no receipt"),
        F.when(F.col("_documents") > 1, "document repeated"), F.when(F.col("_receipts") > 1, "receipt repeated"),
    ))
    return rows.select("document_id", F.explode(faults).alias("rule"))


def page_totals(pages: DataFrame) -> DataFrame:
    """Pages, characters and empty pages per document and, with a null document, of all."""
    return pages.rollup("document_id").agg(F.count("*").alias("page_count"), F.sum("character_count").alias("character_count"), F.count_if(F.col("is_empty")).alias("empty_page_count"))


def html_text(html: str | F.Column) -> F.Column:
    """Visible text of a raw page: scripts, styles and tags dropped, entities of markup resolved."""
    out = F.regexp_replace(F.col(html) if isinstance(html, str) else html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n"), r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out
