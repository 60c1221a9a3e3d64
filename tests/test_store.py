"""Commits, indexes and the reply cache; scans that meet damaged files, end early, or find nothing new."""

import dataclasses
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioforge.functions import detect
from folioforge.operators import model, register
from folioforge.plans import intake
from folioforge.sources import files, staging, store

LEASE = "CONTRATO DE ARRENDAMENTO\nSenhorios: Ana Maria Silva\nrenda mensal de 500,00 EUR\n" + "x" * 300


@pytest.fixture
def config(tmp_path):
    (tmp_path / "in").mkdir()
    at = lambda name: str(tmp_path / name)
    return files.Config(at("in"), at("register"), at("work"), at("done"), at("bad"), minimum_file_age_seconds=0)


def rows_of(spark, *hashes, **more):
    return spark.createDataFrame([(h, h.upper()) for h in hashes], "sha256 string, lessor string").withColumns({k: F.lit(v) for k, v in more.items()})


# --- sets and batches ------------------------------------------------------------------------------------------------------


def test_batches_are_committed_once(spark, tmp_path):
    path = str(tmp_path / "register")
    assert register.read(spark, path).count() == 0 and register.hashes(spark, path).count() == 0
    assert register.append(rows_of(spark, "aa", "ab"), path, batch="1")["rows"] == 2
    assert register.append(rows_of(spark, "zz"), path, batch="1")["rows"] == 2  # run again: nothing is added
    register.to_register(rows_of(spark, "ba"), more=register.FILED).write.parquet(register.Log(path).folder("2"))  # ended before its commit
    assert {r["sha256"] for r in register.read(spark, path).collect()} == {"aa", "ab"}
    assert {r["sha256"] for r in register.hashes(spark, path).collect()} == {"aa", "ab"}
    register.append(rows_of(spark, "ba", processing_status="error"), path, batch="2", listed=7)
    assert {r["sha256"] for r in register.read(spark, path).collect()} == {"aa", "ab", "ba"}
    told = {r["batch"]: r for r in register.scans(spark, path).collect()}
    assert (told["1"]["rows"], told["1"]["errors"], told["2"]["rows"], told["2"]["errors"], told["2"]["listed"]) == (2, 0, 1, 1, 7)


def test_hashes_are_looked_up_by_prefix(spark, tmp_path):
    """Only the folders of the first digits that are asked for are read, and nothing but the index."""
    path = str(tmp_path / "register")
    register.append(rows_of(spark, "aa1", "ab1", "ab2"), path)
    register.append(rows_of(spark, "ab3"), path)
    got = register.hashes(spark, path, rows_of(spark, "ab9", "cc1"))
    assert {r["sha256"] for r in got.collect()} == {"ab1", "ab2", "ab3"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.partition("PartitionFilters: [")[2].partition("]")[0] and "batch=" not in plan
    assert all("register-hashes" in f for f in got.inputFiles()) and all("prefix=ab" in r[0] for r in got.select(F.input_file_name()).collect())


def test_registers_of_before_batches(spark, tmp_path):
    path = str(tmp_path / "register")
    spark.createDataFrame([("h1", "gone")], "sha256 string, old_column string").write.parquet(path)
    for _ in range(2):
        assert {r["sha256"] for r in register.hashes(spark, path).collect()} == {"h1"}
    assert len(register.hash_index(path).files(spark)) == 1
    register.append(rows_of(spark, "h2"), path)
    assert {r["sha256"] for r in register.hashes(spark, path).collect()} == {"h1", "h2"} and register.read(spark, path).count() == 2


def test_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_FILES", 3)
    monkeypatch.setattr(store, "MOST_BATCHES", 3)
    path = str(tmp_path / "register")
    for i in range(6):
        register.append(rows_of(spark, f"aa{i}", f"b{i}"), path, batch=str(i))
        register.hashes(spark, path)
        for what in register.MARKS:
            register.Log(path).done(spark, str(i), what)
    register.append(rows_of(spark, "cc"), path, batch="open")  # not filed yet: stays as it is
    register.compact(spark, path)
    assert len(register.Log(path).live(spark)) == 2 and "open" in register.Log(path).live(spark)
    assert sorted(os.listdir(path))[:1] != [] and len([x for x in os.listdir(path) if x.startswith("batch=")]) == 2
    assert register.read(spark, path).count() == 13 and register.read(spark, path).where("lessor = 'AA3'").count() == 1
    assert register.append(rows_of(spark, "zz"), path, batch="4")["rows"] == 2 and register.read(spark, path).count() == 13
    assert register.hashes(spark, path).distinct().count() == 13
    per_folder = {}
    for f in register.hash_index(path).files(spark):
        per_folder[os.path.dirname(f)] = per_folder.get(os.path.dirname(f), 0) + 1
    assert max(per_folder.values()) <= 3 and register.unfiled(spark, path)[0] == ["open"]


def test_index_of_files(spark, tmp_path):
    """A file is known while its path, time and length are the same."""
    index = files.file_index(str(tmp_path / "register"))
    listed = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30)], "path string, t long, length long").select("path", F.timestamp_seconds("t").alias("modificationTime"), "length")
    assert files.known_hashes(listed, index.read(spark)).where("sha256 IS NOT NULL").count() == 0
    for _ in range(2):  # rows that are there twice are one
        index.add(listed.withColumn("sha256", F.upper("path")))
    changed = listed.withColumn("length", F.col("length") + F.when(F.col("path") == "b", 1).otherwise(0)).withColumn("modificationTime", F.when(F.col("path") == "c", F.timestamp_seconds(F.lit(9))).otherwise(F.col("modificationTime")))
    assert sorted((r["path"], r["sha256"]) for r in files.known_hashes(changed, index.read(spark)).collect()) == [("a", "A"), ("b", None), ("c", None)]


# --- readers and models that fail --------------------------------------------------------------------------------------------


def test_reader_that_fails(spark):
    def strict(content: bytes) -> list[str]:
        if content == b"bad":
            raise ValueError("damaged")
        if content == b"worse":
            raise RecursionError
        return [content.decode()]

    rows = spark.createDataFrame([(1, b"good"), (2, b"bad"), (3, None), (4, b"worse")], "id int, content binary")
    got = {r["id"]: (r["pages"], r["read_error"]) for r in files.with_pages(rows, strict).collect()}
    assert got == {1: (["good"], ""), 2: ([], "damaged"), 3: ([], ""), 4: ([], "RecursionError")}


class Counting:
    """Answers, and leaves a file for each question; fails as its settings say."""

    def __init__(self, folder, fail=None):
        self.folder, self.fail = str(folder), fail

    def _said(self, prompt, reply):
        Path(self.folder).mkdir(exist_ok=True)
        (Path(self.folder) / os.urandom(8).hex()).write_text(prompt)
        if self.fail and self.fail in prompt:
            raise {"LATE": model.ModelTimeout("slow"), "ODD": KeyError("odd")}[self.fail]
        return reply

    def classify(self, prompt):
        return self._said(prompt, '{"document_category": "lease_contract", "confidence": "high"}')

    def extract(self, prompt):
        return self._said(prompt, '{"lessor": "Ana"}')


def test_replies_are_kept(spark, tmp_path):
    """Each document has two prompts at most, of its own category; equal ones are asked once, and answered ones not again."""
    asked = lambda: [p.read_text() for p in sorted((tmp_path / "asked").iterdir())] if (tmp_path / "asked").exists() else []
    rows = spark.createDataFrame([(1, "a.pdf", LEASE + "LATE"), (2, "b.pdf", LEASE), (3, "b.pdf", LEASE), (4, "c.pdf", "short")], "id int, file_name string, text string")
    shown = detect.with_signals(rows).withColumns({"sample": F.col("text"), "context": F.col("text")})
    shown = spark.createDataFrame(shown.collect(), shown.schema)  # written down, as scans do it
    cache = model.reply_cache(str(tmp_path / "register"))
    run = lambda fail, batch: {r["id"]: r for r in model.merged(model.asked(shown, Counting(tmp_path / "asked", fail), cache=cache, batch=batch)).collect()}
    got = run("LATE", "1")
    assert len(asked()) == 3 and got[2]["lessor"] == got[3]["lessor"] == "Ana" and "Timeout" in got[1]["extraction_notes"] and got[4]["reply_1"] is None
    assert sum("Fields: " in x for x in asked()) == 1 and all(x.count("Category: ") <= 1 for x in asked() if "Fields: " in x)
    got = run(None, "2")  # a timeout is no answer: it alone is asked again, and then its second prompt
    assert len(asked()) == 5 and got[1]["lessor"] == "Ana"
    run(None, "3")
    assert len(asked()) == 5
    direct = {r["id"]: r for r in model.merged(model.asked(shown, Counting(tmp_path / "direct"))).collect()}
    assert {i: (r["lessor"], r["document_category"], r["confidence"]) for i, r in direct.items()} == {i: (r["lessor"], r["document_category"], r["confidence"]) for i, r in got.items()}


def test_model_error_is_the_documents_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.pdf", LEASE + "ODD"), (2, "b.pdf", LEASE)], "id int, file_name string, text string")
    shown = detect.with_signals(rows).withColumns({"sample": F.col("text"), "context": F.col("text")})
    shown = spark.createDataFrame(shown.collect(), shown.schema)  # written down, as scans do it
    got = {r["id"]: r for r in model.asked(shown, Counting(tmp_path / "asked", "ODD")).collect()}
    assert got[1]["model_error"] == "'odd'" and got[2]["model_error"] == "" and got[2]["reply_2"]


# --- scans -------------------------------------------------------------------------------------------------------------------


def test_scan_of_good_and_damaged_files(spark, config):
    """A damaged file gives an error row and a copy in the error folder, good ones are registered; the second scan reads nothing."""
    folder = Path(config.input_dir)
    (folder / "good.pdf").write_text(LEASE)
    (folder / "broken.pdf").write_bytes(b"%PDF-1.5\n1 0 obj\n<< /Type /ObjStm /First 4 >>\nstream\nabcd efgh\nendstream\nendobj\n")
    assert intake.scan(spark, config, 2026) == 2
    rows = {r["source_file_name"]: r for r in register.read(spark, config.register_path, wide=True).collect()}
    bad, good = rows["broken.pdf"], rows["good.pdf"]
    assert (bad["processing_status"], bad["processed_ok"], bad["needs_review"], bad["confidence"]) == ("error", "no", "yes", "low") and "invalid literal" in bad["error_message"]
    assert bad["document_category"] == bad["raw_json"] == bad["quality_score"] == "" and len(bad["sha256"]) == 64 and bad["file_modified_at"]
    assert good["document_category"] == "lease_contract" and good["processing_status"] != "error"
    assert os.listdir(config.error_dir) == ["broken.pdf"] and len(os.listdir(config.archive_dir)) == 1
    told = register.scans(spark, config.register_path).first()
    assert (told["rows"], told["errors"], told["listed"], told["read"]) == (2, 1, 2, 2) and told["read_bytes"] > 300 and told["seconds"] > 0
    # same path, time and length: it isn't read, so a change that leaves these alone isn't seen
    stat = (folder / "good.pdf").stat()
    (folder / "good.pdf").write_text(LEASE[:-1] + "y")
    os.utime(folder / "good.pdf", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert intake.scan(spark, config, 2026) == 0
    index = files.file_index(config.register_path).read(spark)
    assert intake.unread(files.listing(spark, config.input_dir, ".pdf", 0), index).count() == 0 and index.count() == 2


def test_scan_that_ends_after_its_commit(spark, config, monkeypatch):
    """Killed between commit and filing: the next scan files what is registered and registers nothing twice."""
    (Path(config.input_dir) / "a.pdf").write_text(LEASE)
    real = staging.file_scan

    def killed(*args):
        raise SystemExit("killed")

    monkeypatch.setattr(staging, "file_scan", killed)
    with pytest.raises(SystemExit):
        intake.scan(spark, config, 2026, batch="stream-1")
    assert register.read(spark, config.register_path).count() == 1 and not Path(config.archive_dir).exists()
    monkeypatch.setattr(staging, "file_scan", real)
    assert intake.scan(spark, config, 2026, batch="stream-1") == 1  # the same batch, run again
    assert register.read(spark, config.register_path).count() == 1 and len(os.listdir(config.archive_dir)) == 1
    assert intake.scan(spark, config, 2026) == 0 and register.unfiled(spark, config.register_path)[0] == []


def test_config_names_the_programs(config):
    assert dataclasses.replace(config, ocr_program="/x/ocr").ocr_program == "/x/ocr" and staging.ocr_command("a", "b", "por", "/x/ocr")[0] == "/x/ocr"
