"""Converters by file extension, the scan that applies them, and sinks.

A converter is ``fn(content: bytes, options) -> (markdown, title, warnings)``; the one registered last
for an extension wins.  The table of converters is frozen when a plan is made.  One bad document
gives a row with ``error`` instead of failing the job, unless ``strict``.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import normalize_extension
from ..functions.options import ConversionOptions
from ..session import ship
from .docx import ConversionError, convert_docx, read_docx
from .html import convert_html, decode_html

Converter = Callable[[bytes, ConversionOptions], tuple[str, "str | None", list[str]]]

_registered: list[tuple[frozenset[str], Converter]] = []


def register_converter(extensions: list[str], fn: Converter) -> None:
    """Serve extensions (with or without dot, any case) by ``fn`` from now on."""
    names = frozenset("." + e.strip().lower().lstrip(".") for e in extensions if e.strip())
    if not names:
        raise ValueError("no extension named")
    _registered.append((names, fn))


def converters() -> dict[str, Converter]:
    return {e: fn for names, fn in _registered for e in names}


def supported_extensions() -> list[str]:
    return sorted(converters())


def _pdf(content: bytes, options: ConversionOptions) -> tuple[str, str | None, list[str]]:
    raise ConversionError("no PDF parser is installed; register one for .pdf, or start from layout tables")


register_converter(["html", "htm"], lambda content, options: convert_html(decode_html(content), options))
register_converter(["docx"], convert_docx)
register_converter(["pdf"], _pdf)

OUT = "markdown string, title string, warnings array<string>, error struct<kind:string,message:string>"


def convert_one(content: bytes | None, extension: str, options: ConversionOptions, table: dict[str, Converter]) -> tuple:
    fn = table.get(extension)
    if fn is None:
        hint = " save it as .docx" if extension == ".doc" else ""
        return None, None, None, {
            "kind": "unsupported_format",
            "message": f"{extension or 'no extension'} is not one of {', '.join(sorted(table))}{hint}"
        }
    if not content:
        return None, None, None, {"kind": "invalid_argument", "message": "empty content"}
    try:
        markdown, title, warnings = fn(content, options)
        return markdown, title, list(warnings), None
    except ConversionError as e:
        return None, None, None, {"kind": "conversion", "message": str(e)}
    except Exception as e:  # a converter of the user's may raise anything
        return None, None, None, {"kind": "conversion", "message": f"{type(e).__name__}: {e}"}


def convert_binary(
    df: DataFrame, content: str = "content", name: str = "path", options: ConversionOptions = ConversionOptions(),
    strict: bool = False
) -> DataFrame:
    """Rows with bytes and a file name (or extension) to Markdown; other columns stay, the bytes go."""
    ship(df.sparkSession)
    table, kept = converters(), [c for c in df.columns if c not in (content, "markdown", "title", "warnings", "error")]
    rows = df.select(*kept, F.col(content).alias("__content"), normalize_extension(F.col(name)).alias("__ext"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [convert_one(c, e, options, table) for c, e in zip(pdf["__content"], pdf["__ext"])]
            yield pdf[kept].assign(**{k: [r[j] for r in out] for j, k in enumerate(("markdown", "title", "warnings", "error"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    out = rows.mapInPandas(run, f"{schema}, {OUT}")
    if strict:
        out = out.withColumn(
            "markdown",
            F.when(
                F.col("error").isNotNull(),
                F.raise_error(F.concat_ws(": ", "error.kind", "error.message")).cast("string")
            ).otherwise(F.col("markdown"))
        )
    return out


def read_documents(
    spark: SparkSession, path: str, options: ConversionOptions = ConversionOptions(), glob: str | None = None
) -> DataFrame:
    """Scan files and convert them; only files of known extensions are read."""
    pattern = glob or "*.{" + ",".join(e[1:] for e in supported_extensions()) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return convert_binary(files.select("path", "length", "content"), options=options)


def docx_images(df: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """(key, image_ix, name, image, error): the images of Word documents, numbered in order of use; a broken document is a row with ``error``."""
    ship(df.sparkSession)
    options = ConversionOptions(extract_images=True, image_directory="-")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, c in zip(pdf[key], pdf[content]):
                try:
                    rows += [(k, i, n, b, None) for i, (n, b) in enumerate(read_docx(c, options).images, 1)]
                except ConversionError as e:
                    rows.append((k, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "image_ix", "name", "image", "error"]).astype({"image_ix": "Int32"})

    return df.select(key, content).mapInPandas(
        run, f"`{key}` {df.schema[key].dataType.simpleString()}, image_ix int, name string, image binary, error string"
    )


def inside(name: str) -> str:
    """A relative file name that stays in its folder."""
    path = posixpath.normpath(name or "..")
    if posixpath.isabs(path) or path.split("/")[0] in ("..", "."):
        raise ValueError(f"the name {name!r} leaves the folder")
    return path


def write_files(df: DataFrame, directory: str, name: str, data: str) -> None:
    """One file for each row, below ``directory`` on storage that all executors reach (a path or a URI, as of HDFS or S3); text as UTF-8.

    Each file is written beside its place and moved, so a retried task leaves no half file.  A name
    that would leave the directory is an error.
    """

    def run(rows) -> None:
        files, root = fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), directory)
        for row in rows:
            target = posixpath.join(root, inside(row[name]))
            files.create_dir(posixpath.dirname(target), recursive=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as f:
                f.write(row[data].encode() if isinstance(row[data], str) else bytes(row[data]))
            files.move(part, target)

    df.select(name, data).foreachPartition(run)
