"""OCR of image and PDF files through external programs, one row per file.

Engines are tried in the order given; one that is not installed answers ``skipped`` and the
next one is used. Programs run inside tasks, file by file.
"""

from __future__ import annotations

import json
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions import text as T

RESULT = "source_file_id string, text string, status string, pages int, metadata string, engine_order int"


def tesseract(name: str, content: bytes, languages: str = "rus+eng", max_pages: int | None = None, dpi: int = K.OCR_DPI):
    """(text, status, pages, metadata) from the ``tesseract`` program; PDFs are rendered by ``pdftoppm``."""
    program, renderer = shutil.which("tesseract"), shutil.which("pdftoppm")
    is_pdf = name.lower().endswith(".pdf")
    if not program or (is_pdf and not renderer):
        return "", "skipped", 0, {"reason": "ocr program not found"}
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder) / ("in.pdf" if is_pdf else "in" + Path(name).suffix)
        source.write_bytes(content)
        if is_pdf:
            limit = ["-l", str(max_pages)] if max_pages else []
            render = [renderer, "-r", str(dpi), *limit, "-png", str(source), f"{folder}/page"]
            subprocess.run(render, check=False, capture_output=True, timeout=300)
            images = sorted(Path(folder).glob("page*.png"))
        else:
            images = [source]
        texts = []
        for image in images:
            done = subprocess.run([program, str(image), "stdout", "-l", languages, "--psm", "6"], check=False, capture_output=True, timeout=120)
            if done.returncode == 0:
                texts.append(done.stdout.decode("utf-8", errors="ignore").strip())
    text = "\n\n".join(t for t in texts if t)
    return text, "completed" if text else "failed", len(images), {"ocr_engine": "tesseract", "ocr_chars": len(text), "pages_read": len(images), "page_limit": max_pages}


Engine = Callable[[str, bytes], tuple[str, str, int, dict]]


def recognise(files: DataFrame, engines: Sequence[Engine] = (tesseract,)) -> DataFrame:
    """OCR results of files (``source_file_id, path, content``) with their quality score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, path, content in zip(batch["source_file_id"], batch["path"], batch["content"]):
                outcome, order = ("", "skipped", 0, {}), 0
                for order, engine in enumerate(engines):
                    try:
                        outcome = engine(path.rsplit("/", 1)[-1], bytes(content))
                    except Exception as exc:
                        outcome = ("", "failed", 0, {"error": str(exc)})
                    if outcome[1] != "skipped":
                        break
                text, status, pages, metadata = outcome
                rows.append((file_id, text, status, pages, json.dumps(metadata), order))
            yield pd.DataFrame(rows, columns=["source_file_id", "text", "status", "pages", "metadata", "engine_order"])

    results = files.select("source_file_id", "path", "content").mapInPandas(run, RESULT)
    return results.withColumn("quality_score", T.ocr_quality(F.col("text"), F.col("pages")))


def needs_assist(results: DataFrame) -> DataFrame:
    """Results that a cleanup provider should look at."""
    return results.where(T.needs_ocr_assist(F.col("status"), F.col("text"), F.col("quality_score")))
