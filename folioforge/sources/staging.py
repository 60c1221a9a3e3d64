"""What is done with files beside the tables: staging copies, archive and error folders, and OCR by an outside program.

Files are copied after a scan has registered its rows, and OCR runs where files are read, all in tasks: the folders must
be ones that all machines share.
"""

from __future__ import annotations

import logging
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from logging.handlers import RotatingFileHandler
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def local(path: str) -> Path:
    return Path(unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path)


def stage(source: str, target: str) -> Path:
    """Copy a file to its staging place if nothing is there yet."""
    if not Path(target).exists():
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(local(source), target)
    return Path(target)


def archive(staged: str, folder: str) -> Path:
    """Copy a staged file to the archive if it isn't there yet."""
    return stage(staged, str(Path(folder) / Path(staged).name))


def set_aside(source: str, folder: str) -> None:
    """Copy a file that failed to the error folder; the source stays, and a copy that fails is only logged."""
    try:
        stage(source, str(Path(folder) / local(source).name))
    except OSError as exc:
        logging.getLogger(__name__).warning("%s was not set aside: %s", source, exc)


def file_scan(rows: DataFrame, archive_dir: str, error_dir: str) -> int:
    """Stage and archive, or set aside, the files of register rows that have a ``path``; how many that was. Each task acts on its own rows."""

    @F.pandas_udf("int")
    def acted(paths: pd.Series, copies: pd.Series, states: pd.Series) -> pd.Series:
        for path, copy, state in zip(paths, copies, states):
            if state == "error":
                set_aside(path, error_dir)
            else:
                archive(str(stage(path, copy)), archive_dir)
        return pd.Series(1, index=paths.index)

    return rows.select(acted("path", "copied_file_path", "processing_status").alias("n")).agg(F.sum("n")).first()[0] or 0


def ocr_command(source: str, target: str, language: str, program: str = "ocrmypdf") -> list[str]:
    return [program, "--skip-text", "--deskew", "--rotate-pages", "--language", language, source, target]


def run_ocr(source: str, target: str, language: str, timeout_seconds: int, program: str = "ocrmypdf") -> str:
    """Run OCR into ``target``; the reason if it gave nothing, else empty. A partial file is removed."""
    try:
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        ran = subprocess.run(ocr_command(source, target, language, program), capture_output=True, text=True, timeout=timeout_seconds)
        if ran.returncode == 0:
            return ""
        why = fixed.OCR_FAILED_NOTE.format(why=(ran.stderr or ran.stdout).strip()[:600])
    except subprocess.TimeoutExpired:
        why = fixed.OCR_TIMEOUT_NOTE.format(seconds=timeout_seconds)
    except PermissionError as exc:
        why = fixed.OCR_BLOCKED_NOTE.format(why=exc)
    except OSError as exc:
        why = fixed.OCR_FAILED_NOTE.format(why=exc)
    Path(target).unlink(missing_ok=True)
    return why


def with_ocr(files: DataFrame, stem: Column, wanted: Column, reader: Callable[[bytes], list[str]], folder: str, enabled: bool, language: str, timeout_seconds: int, program: str = "ocrmypdf", to: str = "seen") -> DataFrame:
    """``files`` with a struct of the pages that OCR gave before (``cached``) or gives now (``fresh``), null where there are none, and why it ``failed``.

    Only rows that are ``wanted`` are looked at. Results are kept in ``folder`` by ``stem``; without one they are not kept.
    """

    def seen(content: bytes, name: str) -> tuple:
        with tempfile.TemporaryDirectory() as own:  # what the outside program reads; nothing that another task needs
            target = Path(local(folder) if folder else own) / f"{name}__ocr.pdf"
            if target.exists() and target.stat().st_size:
                return reader(target.read_bytes()), None, ""
            if not enabled:
                return None, None, ""
            source = Path(own) / "source.pdf"
            source.write_bytes(content)
            why = run_ocr(str(source), str(target), language, timeout_seconds, program)
            if why or not target.exists():
                return None, None, why
            return None, reader(target.read_bytes()), ""

    @F.pandas_udf("struct<cached:array<string>,fresh:array<string>,failed:string>")
    def ocr(contents: pd.Series, names: pd.Series, ask: pd.Series) -> pd.DataFrame:
        found = [seen(bytes(c), n) if a and c is not None else (None, None, "") for c, n, a in zip(contents, names, ask)]
        return pd.DataFrame(found, columns=["cached", "fresh", "failed"])

    return files.withColumn(to, ocr(F.col("content"), stem, wanted))


def created_at(path: Column) -> Column:
    """When a file that this machine reaches was made, in seconds; null for others."""

    @F.pandas_udf("double")
    def made(paths: pd.Series) -> pd.Series:
        return paths.map(lambda x: local(x).stat().st_ctime if x and local(x).exists() else None).astype("float64")

    return made(path)


def log_to(folder: str, level: str = "INFO") -> None:
    """Log to a file of 5 MiB with five older ones beside it, and to the console."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    rotating = RotatingFileHandler(Path(folder) / "intake.log", maxBytes=5 * 1024 * 1024, backupCount=5, encoding="utf-8")
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=[rotating, logging.StreamHandler()], force=True)
