"""Uploaded files as text: byte decoding, Word and PDF extraction, dispatch by
extension. Failures are values (an error column), never exceptions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspring.functions import visible
from wayspring.runtime import small_batches, table

# Extensions read as text, and those refused with a hint.
TEXT_TYPES = ("txt", "md", "markdown", "json", "csv", "log", "text", "")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Result = tuple[str | None, str | None]


def decode_text(raw: bytes) -> Result:
    """(text, error): UTF-16 only with a byte order mark, then UTF-8 with or without
    one, then GB18030; text with control characters is binary."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        codecs = ["utf-16"]
    else:
        codecs = ["utf-8-sig", "gb18030"]
    for c in codecs:
        try:
            text = raw.decode(c)
        except UnicodeDecodeError:
            continue
        return (None, "binary") if _CONTROL.search(text) else (text, None)
    return None, "undecodable"


def docx_text(raw: bytes) -> Result:
    """Paragraphs of a Word document, runs joined, blank ones dropped."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            body = next((n for n in z.namelist() if re.fullmatch(r"word/(?:.*/)?document[^/]*\.xml", n)), None)
            if body is None:
                return None, "no document"
            root = ElementTree.fromstring(z.read(body))
    except (zipfile.BadZipFile, OSError, KeyError, RuntimeError):
        return None, "not a docx"
    except ElementTree.ParseError:
        return None, "broken document"
    lines = ("".join(t.text or "" for t in p.iter(_WORD + "t")).strip() for p in root.iter(_WORD + "p"))
    text = "\n".join(filter(None, lines))
    return (text, None) if text else (None, "no text")


def pdf_text(raw: bytes) -> Result:
    """Pages joined by line ends, where a PDF reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None, "no pdf reader"
    try:
        text = "\n".join((p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(raw)).pages).strip()
    except Exception:  # the reader raises many kinds on broken files
        return None, "broken pdf"
    return (text, None) if text else (None, "no text")


def reader_of(name: str | None) -> str:
    """How an upload of this name is read: text, word, pdf, refused or unsupported."""
    ext = name.rsplit(".", 1)[1].lower() if name and "." in name else ""
    return {"docx": "word", "pdf": "pdf", "doc": "refused"}.get(ext, "text" if ext in TEXT_TYPES else "unsupported")


def file_text(name: str | None, raw: bytes | None) -> Result:
    """Text of an upload by its extension; empty bytes are empty text."""
    if not raw:
        return "", None
    read = {"word": docx_text, "pdf": pdf_text, "text": decode_text, "refused": lambda _: (None, "old word format"), "unsupported": lambda _: (None, "unsupported type")}
    return read[reader_of(name)](raw)


def upload_text(content: Column, text: Column, error: Column) -> tuple[Column, Column]:
    """(text, error) of a submission: its content if there is any, then the file's
    text; the file's error counts only without content."""
    own = visible(content)
    return F.when(own, F.trim(content)).otherwise(F.trim(text)), F.when(~own, error)


def extract(df: DataFrame, name: str = "file_name", raw: str = "raw") -> DataFrame:
    """df with columns text and error for a binary column."""
    small_batches(df.sparkSession, 200)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for n, r in batches:
            yield pd.DataFrame([file_text(a if isinstance(a, str) else None, bytes(b) if b is not None else None) for a, b in zip(n, r)], columns=["text", "error"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return df.withColumn("x", F.pandas_udf(run, "text string, error string")(name, raw)).select(*df.columns, "x.text", "x.error")


def read_uploads(spark, path: str, glob: str = "*") -> DataFrame:
    """(file_name, text, error) of a folder of uploads."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return extract(raw.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("content").alias("raw"))).drop("raw")


def submission_text(spark, sf_dir: str) -> DataFrame:
    """Content wins over the file. Every submission gets a file of its own name whose
    bytes hold its notes in one of three encodings (by their length); two thirds
    keep their content too."""
    c = table(spark, sf_dir, "contributions").select("id", "file_name", "content", "notes").dropDuplicates(["id"])
    code = F.length("notes") % 3
    raw = F.when(code == 0, F.encode("notes", "UTF-8")).when(code == 1, F.encode("notes", "UTF-16")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("notes", "UTF-8")))
    own = F.when(F.length("id") % 3 + F.length("content") % 3 != 0, F.col("content"))
    got = extract(c.select("id", own.alias("content"), "file_name", raw.alias("raw")))
    text, error = upload_text(F.col("content"), F.col("text"), F.col("error"))
    return got.select("id", F.md5(F.coalesce(text, F.lit(""))).alias("text_md5"), F.coalesce(error, F.lit("")).alias("error"))


def upload_types(spark, sf_dir: str) -> DataFrame:
    """File names of submissions by how they are read."""
    small_batches(spark)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda n: reader_of(n) if isinstance(n, str) else "none")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    c = table(spark, sf_dir, "contributions").select("id", "file_name").distinct()
    return c.select(F.pandas_udf(run, "string")("file_name").alias("how")).groupBy("how").agg(F.count("*").alias("n"))


QUERIES = {"submission_text": submission_text, "upload_types": upload_types}
ORACLE = {
    "submission_text": r"""with c as (select id, any_value(file_name) as f, any_value(case when length(id) % 3 + length(content) % 3 <> 0 then content end) as own, any_value(notes) as notes from contributions group by id),
e as (select *, lower(regexp_extract(coalesce(f, ''), '\.([^.]+)$', 1)) as ext, length(regexp_replace(coalesce(own, ''), '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g')) > 0 as has, length(coalesce(notes, '')) = 0 as nothing from c),
t as (select *, ext in ('txt', 'md', 'markdown', 'json', 'csv', 'log', 'text', '') as plain from e)
select id, md5(case when has then trim(own, ' ') when nothing or not plain then '' else trim(notes, ' ') end) as text_md5,
  case when has or nothing or plain then '' when ext = 'docx' then 'not a docx' when ext = 'doc' then 'old word format' when ext = 'pdf' then 'no pdf reader' else 'unsupported type' end as error from t""",
    "upload_types": """with c as (select distinct id, file_name, lower(regexp_extract(coalesce(file_name, ''), '\\.([^.]+)$', 1)) as ext from contributions)
select case when file_name is null then 'none' when ext in ('txt', 'md', 'markdown', 'json', 'csv', 'log', 'text', '') then 'text' when ext = 'docx' then 'word' when ext = 'pdf' then 'pdf' when ext = 'doc' then 'refused' else 'unsupported' end as how, count(*) as n from c group by 1""",
}
