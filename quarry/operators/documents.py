"""Reports of document files by an extractor plug-in, each file in a process of its own with limits.

An extractor is a function from a file's bytes to an iterator that first gives the number of pages and then each page's
text, or an exception object for a page that failed. A file that exhausts memory or time, or kills its process, costs a
report with the reason and nothing else. sources.pdf.pages is an extractor for simple files; others plug in.
"""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .extract import MAX_PDF_BYTES

#: Limits of a file's process.
MEMORY_KB = 3_000_000
CPU_S = 120
REPORT = "location string, page_count int, failed_pages array<int>, text string, document_error string"

_CHILD = """
import json, pickle, resource, sys
memory, seconds = int(sys.argv[1]), int(sys.argv[2])
resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
resource.setrlimit(resource.RLIMIT_CPU, (seconds, seconds))
made = pickle.load(sys.stdin.buffer)
report = {"page_count": 0, "failed_pages": [], "text": "", "document_error": None}
try:
    pages = iter(made[0](made[1]))
    report["page_count"] = next(pages)
    texts = []
    for n, page in enumerate(pages, 1):
        if isinstance(page, BaseException):
            report["failed_pages"].append(n)
        else:
            texts.append(page)
    report["text"] = "\\n".join(texts)
except Exception as e:
    report["document_error"] = f"{type(e).__name__}: {e}"
sys.stdout.buffer.write(json.dumps(report).encode())
"""


def report(extractor: Callable, content: bytes) -> dict:
    """The report of one file."""
    try:
        run = subprocess.run([sys.executable, "-c", _CHILD, str(MEMORY_KB * 1024), str(CPU_S)], input=cloudpickle.dumps((extractor, content)), capture_output=True, timeout=2 * CPU_S, check=False)
    except subprocess.TimeoutExpired:
        return {"page_count": 0, "failed_pages": [], "text": "", "document_error": "extractor timed out"}
    if run.returncode:
        last = (run.stderr.decode(errors="replace").strip().splitlines() or [""])[-1]
        reason = f"extractor killed by signal {-run.returncode}" if run.returncode < 0 else last or f"extractor ended with {run.returncode}"
        return {"page_count": 0, "failed_pages": [], "text": "", "document_error": reason}
    return json.loads(run.stdout)


def reports(files: DataFrame, extractor: Callable) -> DataFrame:
    """(location, page_count, failed_pages, text, document_error) of files (location, size, content) up to the size limit."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for location, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = report(extractor, content)
                columns = [[location], [r["page_count"]], [r["failed_pages"]], [r["text"]], [r["document_error"]]]
                types = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["location", "page_count", "failed_pages", "text", "document_error"])

    return files.where(f"size <= {MAX_PDF_BYTES}").select("location", "content").mapInArrow(each, REPORT)
