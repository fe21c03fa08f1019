"""Sinks beside Spark's own: pretty JSON and XLSX for results that are small by nature, written by the driver."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import xml_safe

MOST_ROWS = 1_000_000  # a sheet holds no more


class _Stream(io.RawIOBase):
    """Bytes into an output stream of the JVM."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self):
        return True

    def write(self, data):
        self.stream.write(bytearray(data))
        return len(data)


@contextlib.contextmanager
def one_file(spark: SparkSession, path: str):
    """A text file at a path of any file system that Spark knows, written by the driver; it replaces what is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        with io.TextIOWrapper(io.BufferedWriter(_Stream(stream), 1 << 20), "utf-8", newline="") as f:
            yield f
    finally:
        stream.close()


def write_pretty_json(records: DataFrame, path: str) -> None:
    """All records as one indented JSON array, a partition at a time on the driver."""
    with one_file(records.sparkSession, path) as f:
        start = "[\n"
        for r in records.toLocalIterator():
            f.write(start + json.dumps(r.asDict(recursive=True), ensure_ascii=False, indent=2, default=str))
            start = ",\n"
        f.write("[]\n" if start == "[\n" else "\n]\n")


def write_one_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header and no index, rows in the frame's order; nulls are empty."""
    with one_file(df.sparkSession, path) as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())


def write_records_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """A summary (a row a model) as one indented JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(recursive=True) for r in summary.toLocalIterator()], f, ensure_ascii=False, indent=2, default=str)


def write_xlsx(df: DataFrame, path: str, sheet: str = "Dettaglio") -> bool:
    """One sheet with a bold header; False, and no error, if the file can't be written. Rows are streamed, not collected."""
    safe = df.select(*[(xml_safe(f"`{n}`").alias(n) if t == "string" else df[f"`{n}`"]) for n, t in df.dtypes])
    head = "http://schemas.openxmlformats.org"
    cell = lambda v, bold: f'<c t="inlineStr"{" s=\"1\"" if bold else ""}><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    try:
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{head}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
            rel = f"{head}/officeDocument/2006/relationships"
            z.writestr("_rels/.rels", f'<Relationships xmlns="{head}/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{head}/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
            main = f"{head}/spreadsheetml/2006/main"
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
            with z.open("xl/worksheets/sheet1.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData><row>{"".join(cell(n, True) for n in df.columns)}</row>'.encode())
                for i, r in enumerate(safe.toLocalIterator()):
                    if i >= MOST_ROWS:
                        raise ValueError("more rows than a sheet holds")
                    f.write(f"<row>{''.join(cell(v, False) for v in r)}</row>".encode())
                f.write(b"</sheetData></worksheet>")
        return True
    except OSError:
        return False
