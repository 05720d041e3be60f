"""File listing and document text."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.errors import SourceUnavailable


def any_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern names at least one file, on any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(path)
    return found is not None and len(found) > 0


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the folders that a pattern names, in order, on any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(path)
    return sorted(one.getPath().toString() for one in found or [] if one.isDirectory())


def read_binary(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files with path, length and content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def write_packed(files: DataFrame, folder: str) -> None:
    """Lay files (path, content) together in packs under ``folder``, one row each.

    A file system takes milliseconds to make, list and open a file, so many small documents are kept
    by the thousand. The paths are those the files have, or would have, on their own.
    """
    files.select("path", F.length("content").cast("bigint").alias("length"), "content").write.parquet(folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of :func:`write_packed` with path, length and content, as :func:`read_binary` gives them."""
    return spark.read.schema("path string, length bigint, content binary").parquet(folder)


def _pdf(content: bytes) -> tuple[str, int | None]:
    from pypdf import PdfReader

    pages = [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]
    return "\n\n".join(pages), len(pages)


def _docx(content: bytes) -> tuple[str, int | None]:
    import docx

    document = docx.Document(io.BytesIO(content))
    lines = [p.text for p in document.paragraphs]
    for table in document.tables:
        lines += [" | ".join(cell.text for cell in row.cells) for row in table.rows]
    return "\n".join(lines), None


def _plain(content: bytes) -> tuple[str, int | None]:
    return content.decode("utf-8", errors="replace"), None


_READERS = {"pdf": _pdf, "docx": _docx, "txt": _plain, "md": _plain}


_EXTRACTED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("problem", T.StringType()),
    ]
)


@F.pandas_udf(_EXTRACTED)
def _extract(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    def one(name, data):
        reader = _READERS.get(name.rsplit(".", 1)[-1].lower())
        if reader is None:
            return None, None, "unsupported file type"
        try:
            text, pages = reader(data)
        except ImportError as missing:
            return None, None, f"reader not installed: {missing.name}"
        except Exception as error:  # one broken file must not stop the others
            return None, None, f"unreadable: {type(error).__name__}"
        if not text.strip():
            return None, pages, "no text"
        return text, pages, None

    rows = [one(p, c) for p, c in zip(path, content)]
    frame = pd.DataFrame(rows, columns=["text", "page_count", "problem"])
    frame["page_count"] = frame["page_count"].astype("Int32")
    return frame


def document_text(files: DataFrame) -> DataFrame:
    """Text and page count of PDF, DOCX, TXT and Markdown files.

    Files that give no text keep their row, with the ``problem`` named.
    """
    return files.select(
        "path", F.sha2("content", 256).alias("sha256"), _extract("path", "content").alias("x")
    ).select("path", "sha256", "x.*")


def judgment_text(files: DataFrame) -> DataFrame:
    """Judgment text with a marker where a PDF has no text layer."""
    read = document_text(files)
    return read.withColumn(
        "text",
        F.when(F.col("problem").isNull(), F.trim("text")).otherwise(
            F.concat(F.lit("[no text: "), F.col("problem"), F.lit("]"))
        ),
    )


def require_text(documents: DataFrame) -> DataFrame:
    """Documents with text; fails when none of them has any."""
    usable = documents.where(F.col("problem").isNull())
    if usable.isEmpty():
        raise SourceUnavailable("no text could be read from any of the files")
    return usable
