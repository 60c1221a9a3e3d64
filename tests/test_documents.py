"""Detection, rules, recovery, the model stage, the register, scans and streams, on single documents."""

import hashlib
import json
import random
import re
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioforge.functions import checksums, detect, fixed, text
from folioforge.operators import model, quality, recover, register, rules
from folioforge.plans import intake
from folioforge.sources import files, staging
from folioforge.streaming import watch

IBAN = "PT50 0002 0123 1234 5678 9015 4"
LEASE = """CONTRATO DE ARRENDAMENTO
Senhorios: Maria Antonia Lopes, NIF 1, e Jose Carlos Pires
Arrendataria GESTO ENERGIA, S.A.
artigo 440, seccao J
renda mensal de 500,00 EUR
Assinado em Lisboa, 31/05/2024"""


def signals(spark, name, body):
    df = spark.createDataFrame([(name, body)], "file_name string, text string")
    return detect.with_signals(df).first()["signals"].asDict()


def record(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))


def value(spark, f, *args):
    return spark.range(1).select(f(*map(F.lit, args)).alias("y")).first()["y"]


# --- detection -----------------------------------------------------------------------------------------------------------


def test_bank_details(spark):
    got = signals(spark, "dados_IBAN.pdf", f"Titular: A\nIBAN {IBAN}\nNIB 000201231234567890154")
    assert got["ibans"] == ["PT50000201231234567890154"] and got["suggested_category"] == "bank_details"
    assert got["nibs"] == []  # equal to the IBAN's digits


def test_bank_like(spark):
    assert value(spark, detect.bank_like, IBAN) and value(spark, detect.bank_like, "0002 0123 1234 5678 9015 4")
    assert not value(spark, detect.bank_like, "500,00 EUR")


@pytest.mark.parametrize("name,want", [("PR1_CA_X.pdf", "lease_contract"), ("Caderneta Predial.pdf", "property_document"), ("a_crp_1.pdf", "property_document"), ("Meu NIB.pdf", "bank_details"), ("comprovativo.pdf", "payment_proof"), ("CASA.pdf", ""), ("ratificação CA.pdf", "lease_contract")])
def test_file_names(spark, name, want):
    assert signals(spark, name, "")["file_category"] == want


def test_places_and_sections(spark):
    got = signals(spark, "x.pdf", "MATRIZ 140 SECÇÃO J\nFreguesia de: Castelo Branco, concelho Mogadouro\nMunicípio: Mogadouro.\nDISTRITO\n04 - BRAGANÇA")
    assert (got["property_article"], got["property_section"], got["property_parish"], got["property_municipality"], got["property_district"]) == ("140", "J", "Castelo Branco", "Mogadouro", "BRAGANÇA")
    assert signals(spark, "x.pdf", "artigo 440 da secção de")["property_section"] == ""


@pytest.mark.parametrize("digits,want", [("123456789", True), ("123456780", False), ("12345678", False)])
def test_tax_ids(spark, digits, want):
    assert value(spark, checksums.portuguese_tax_id, digits) is want


def test_ibans_of_other_countries(spark):
    assert value(spark, checksums.any_iban, "DE89370400440532013000") and value(spark, checksums.any_iban, "GB82WEST12345698765432")
    assert not value(spark, checksums.any_iban, "GB82WEST12345698765433")


def test_amount_context(spark):
    assert value(spark, detect.amount_in_context, "valor: 500,00 pago", "500,00") and not value(spark, detect.amount_in_context, "x 500,00 y", "500,00")
    assert value(spark, detect.amount_in_context, "nothing", "500,00 EUR") and not value(spark, detect.amount_in_context, "nothing", "")


# --- rules and quality -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("issues,points,band,rank", [([], 100, "EXCELLENT", "NONE"), (["low_confidence"], 90, "EXCELLENT", "MEDIUM"), (["generic_lessor"], 80, "GOOD", "HIGH"), (["missing_lessor", "missing_lessee", "missing_lessee "], 50, "REVIEW_REQUIRED", "HIGH"), ([f"missing_{f}" for f in fixed.CRITICAL["lease_contract"]], 0, "CRITICAL", "HIGH"), (["odd"], 95, "EXCELLENT", "LOW"), (["future_date_signed_date"], 80, "GOOD", "MEDIUM")])
def test_scores(spark, issues, points, band, rank):
    column = F.array(*map(F.lit, issues)).cast("array<string>")
    got = spark.range(1).select(quality.score(column).alias("s"), quality.band(quality.score(column)).alias("b"), quality.priority(column).alias("p")).first()
    assert tuple(got) == (points, band, rank)


def test_penalties(spark):
    assert [value(spark, quality.penalty, x) for x in ("", " Missing_IBAN ", "invalid_iban_format", "what")] == [0, 25, 25, 5]
    assert value(spark, lambda p, i: quality.apply_penalty(p, i), 130, "low_confidence") == 90


def test_clean_lease_is_approved(spark):
    row = record(spark, document_category="lease_contract", lessor="Ana Silva", lessee="GESTO ENERGIA, S.A.", signed_date="2024-05-31", property_article="440", monthly_rent="500,00 EUR", confidence="high")
    got = rules.validated(row, 2026).first()
    assert (got["validation_status"], got["quality_score"], got["needs_review"], got["review_reason"]) == ("AUTO_APPROVED", "100", "no", "")


def test_error_rows(spark):
    got = rules.validated(record(spark, processing_status=" ERROR ", confidence="low"), 2026).first()
    assert (got["validation_status"], got["review_priority"], got["needs_review"]) == ("ERROR", "HIGH", "yes")


@pytest.mark.parametrize("given,want", [("2021-3-7", "2021-03-07"), ("7/3/2021", "2021-03-07"), ("7.3.69", "1969-03-07"), ("7-3-68", "2068-03-07"), ("31/02/2021", "31/02/2021"), (" March ", "March"), ("", "")])
def test_iso_dates(spark, given, want):
    assert value(spark, rules.iso_date, given) == want


def test_negative_rules(spark):
    row = record(spark, text="dados bancarios", document_category="bank_details", payment_amount="500,00 EUR", property_name="Banco BPI", property_address="Sede na Rua A", property_number=IBAN, confidence="high", file_name="x_iban.pdf")
    got = rules.ruled(detect.with_signals(row)).first()
    assert (got["payment_amount"], got["property_name"], got["property_address"], got["owner_address"], got["property_number"]) == ("", "", "", "Sede na Rua A", "")
    for reason in ("property_name_looked_like_bank_name", "property_address_looked_like_owner_address", "property_number_looked_like_bank_number", "bank_details_payment_amount_cleared", "missing_bank_name"):
        assert reason in got["review_reason"]


def test_profiles(spark):
    row = detect.with_signals(record(spark, text=LEASE, file_name="a_CA_b.pdf", document_category="lease_contract", confidence="medium", extraction_notes="n", native_text_chars="400"))
    full, strict = (rules.apply(row, p, 2026).first()["review_reason"] for p in ("full", "strict"))
    assert "confidence=medium" not in full and "confidence=medium" in strict and "extraction_notes" in strict
    with pytest.raises(ValueError):
        rules.apply(row, "other", 2026)


# --- recovery ------------------------------------------------------------------------------------------------------------


def test_recovery(spark):
    row = record(spark, document_category="lease_contract", lessor="Senhorio", lessee="", text=LEASE, file_name="[3]_PR_CA_Maria Antonia Lopes e Jose Carlos Pires_SP12__0123456789abcdef.pdf", confidence="high")
    got = recover.recovered(row).first()
    assert [got[f] for f in ("lessor", "lessee", "property_article", "property_section", "monthly_rent", "signed_date")] == ["Maria Antonia Lopes; Jose Carlos Pires", "GESTO ENERGIA, S.A.", "440", "J", "500,00 EUR", "2024-05-31"]
    assert len(got["recovery"]["changes"]) == 6 and got["recovery"]["unresolved_fields"] == [] and got["currency"] == "EUR"
    done = rules.validated(recover.recovered(row), 2026).first()
    assert (done["validation_status"], done["quality_score"]) == ("AUTO_APPROVED", "100")


def test_recovery_leaves_other_documents_alone(spark):
    got = recover.recovered(record(spark, document_category="bank_details", lessor="", text=LEASE, file_name="x.pdf")).first()
    assert got["lessor"] == "" and got["recovery"]["attempted_fields"] == [] and got["extraction_notes"] == ""


def test_recovery_asks_for_the_rest(spark):
    row = record(spark, document_category="lease_contract", lessor="", lessee="", text="Zeferino Brito assina", file_name="x.pdf")
    ask = lambda df: df.withColumn("answers", F.create_map(F.lit("lessor"), F.lit("zeferino brito"), F.lit("lessee"), F.lit("Not There"), F.lit("monthly_rent"), F.lit("1,00 EUR")))
    got = recover.recovered(row, ask=ask).first()
    assert (got["lessor"], got["lessee"], got["monthly_rent"]) == ("zeferino brito", "", "1,00 EUR") and got["recovery"]["ai_attempted"]


@pytest.mark.parametrize("candidate,body,want", [("Ana Maria Silva", "x ANA MARIA SILVA y", True), ("Ana Maria Silva", "ANA, MARIA - SILVA", True), ("Ana Maria Silva", "SILVA OUTRA COISA MARIA", True), ("Ana Maria Silva", "SILVA", False), ("Ana", "MARIA", False), ("A.C+ (Ltda", "X A.C+ Y", False), ("", "X", False)])
def test_support(spark, candidate, body, want):
    assert value(spark, lambda c, b: recover.supported(c, b, F.split(b, r"(?U)\W+")), candidate, body) is want


def test_recovery_when_asking_fails(spark):
    """A document whose question fails keeps what native rules gave it, and says why in 500 characters; others are answered."""
    rows = record(spark, document_category="lease_contract", lessor="", lessee="", text="Zeferino Brito assina; artigo 12", file_name="x.pdf").crossJoin(spark.createDataFrame([("bad",), ("good",)], "which string"))
    answers = F.create_map(F.lit("lessor"), F.lit("Zeferino Brito"))
    ask = lambda df: df.withColumns({"answers": answers, "answer_error": F.when(F.col("which") == "bad", F.repeat(F.lit("timeout "), F.lit(100)))})
    got = {r["which"]: r for r in recover.recovered(rows, ask=ask).collect()}
    assert got["bad"]["recovery"]["ai_error"] == ("timeout " * 100)[:500] and got["bad"]["lessor"] == "" and got["bad"]["property_article"] == "12"
    assert got["good"]["recovery"]["ai_error"] == "" and got["good"]["lessor"] == "Zeferino Brito" and "answer_error" not in got["good"].asDict()
    full = recover.recovered(record(spark, document_category="lease_contract", lessor="A Silva", lessee="B Lda", signed_date="2024-01-02", property_article="1", property_section="A", monthly_rent="1,00 EUR", text="x", file_name="x.pdf"), ask=lambda df: df.withColumn("answers", answers)).first()
    assert full["recovery"]["ai_attempted"] is False and full["lessor"] == "A Silva"


def supported(candidate, body):
    """The plain rule: whole, its longer words in order with little between them, or all of them but one."""
    if not candidate or not body:
        return False
    words = [w for w in candidate.split() if len(w) >= 3]
    near = len(words) > 1 and re.search(r"\b" + r"\W{0,30}".join(map(re.escape, words)) + r"\b", body)
    return candidate in body or bool(near) or len(words) > 1 and sum(bool(re.search(rf"\b{re.escape(w)}\b", body)) for w in words) >= max(2, len(words) - 1)


def test_support_like_patterns(spark):
    """Random names and texts, many of them run together, apart by just about the gap or with other characters in their words."""
    rng = random.Random(11)
    parts = ["ANA", "ANANA", "RUI", "D'EL", "A.C+", "(LTDA)", "SÃO", "R&D-X", "LIMA", "XLIMA", "-AB-", "ANA.", "12A"]
    rows = []
    for i in range(4000):
        words = [rng.choice(parts) for _ in range(rng.randrange(0, 6))]
        gap = lambda: rng.choice(["", " ", " ", ", ", "-", "." * rng.choice([28, 29, 30, 31, 32]), " E ", "(", "X"])
        body = "".join(w + gap() for _ in range(rng.randrange(3)) for w in ([rng.choice(parts)] + words if rng.random() < 0.7 else rng.sample(words, len(words))))
        rows.append((i, " ".join(words), " ".join(body.split())))
    plain = lambda v: " ".join("".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).upper().split())
    rows = [(i, c, plain(b)) for i, c, b in rows]
    tell = recover.supported(F.col("c"), F.col("b"), F.split("b", r"(?U)\W+"))
    frame = spark.createDataFrame(rows, "i int, c string, b string").repartition(4).select("i", tell.alias("y"))
    got = dict(frame.collect())
    want = {i: supported(plain(c), b) for i, c, b in rows}
    assert [rows[i] for i in want if got[i] is not want[i]] == []
    near_only = [1 for i, c, b in rows if want[i] and plain(c) not in b and sum(bool(re.search(rf"\b{re.escape(w)}\b", b)) for w in plain(c).split() if len(w) > 2) < max(2, len(plain(c).split()) - 1)]
    assert len(near_only) > 20
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    patterns = re.findall(r"RLIKE\((?:[^()]|\([^()]*\))*?, ([^)]*)\)", plan)
    assert all(p.startswith(("(?U", "[")) for p in patterns) and "lambda" not in "".join(patterns)


def test_known_names_like_containment(spark, monkeypatch):
    """A table of names against plain containment: short, long, overlapping and repeated fragments, nulls, ties; joined either way."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    names = [(letters(rng.randrange(9)) or None, rng.choice(["x", "y", None]), rng.choice([None, *range(20)])) for _ in range(300)]
    names += [("São ", "s", 99), (None, "n", 0), ("sao", "t", 99)]
    texts = [None, "", " "] + [letters(rng.randrange(120)) for _ in range(150)] + ["zz SÃO zz"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").withColumn("known_name", F.lit("old"))
    plain = lambda v: " ".join("".join(c for c in unicodedata.normalize("NFKD", v or "") if not unicodedata.combining(c)).upper().split())
    ranked = sorted((2**63 - 1 if r is None else r, plain(f), n or "") for f, n, r in names if plain(f))
    want = {}
    for i, x in enumerate(texts):
        found = next(((n, f) for _, f, n in ranked if plain(x) and f in plain(x)), ("", ""))
        want[i] = found
    table = spark.createDataFrame(names, "fragment string, name string, rank long")
    for few in (recover.FEW_NAMES, 10):
        monkeypatch.setattr(recover, "FEW_NAMES", few)
        out = recover.known_names(rows, table, text.comparable("x"))
        assert out.columns == ["i", "x", "known_name", "known_fragment"]
        assert {r["i"]: (r["known_name"], r["known_fragment"]) for r in out.collect()} == want
    assert {r["known_name"] for r in recover.known_names(rows, table.limit(0), text.comparable("x")).collect()} == {""}


def test_recovery_by_a_table_of_lessees(spark):
    row = record(spark, document_category="lease_contract", lessor="A B", lessee="", text="a favor de Energía  Nova", file_name="x.pdf")
    table = spark.createDataFrame([("energia nova", "ENERGIA NOVA, LDA.", 1), ("energia", "other", 2)], "fragment string, name string, rank int")
    got = recover.recovered(row, lessees=table).first()
    assert got["lessee"] == "ENERGIA NOVA, LDA." and got["recovery"]["changes"][0]["evidence"] == "ENERGIA NOVA"


# --- the model stage -------------------------------------------------------------------------------------------------------


class Scripted:
    def __init__(self, classify=None, extract=None):
        self.replies = {"classify": classify, "extract": extract}

    def _give(self, what):
        reply = self.replies[what]
        if isinstance(reply, Exception):
            raise reply
        return reply

    def classify(self, prompt):
        return self._give("classify")

    def extract(self, prompt):
        assert "Category: lease_contract" in prompt and "Fields: signed_date" in prompt
        return self._give("extract")


def answered(spark, scripted, body=LEASE + "." * 300):
    df = detect.with_signals(record(spark, file_name="a_CA_b.pdf", text=body)).withColumns({"sample": F.col("text"), "context": F.col("text")})
    return model.merged(model.asked(df, scripted)).first()


def test_model_replies(spark):
    got = answered(spark, Scripted('x {"document_category": "Lease_contract", "confidence": "high", "lessor": "from first"} y', '{"lessor": " Ana ", "monthly_rent": 5}'))
    assert (got["document_category"], got["confidence"], got["lessor"], got["monthly_rent"]) == ("lease_contract", "high", "Ana", "5")


def test_first_call_times_out(spark):
    got = answered(spark, Scripted(model.ModelTimeout("slow")))
    assert (got["document_category"], got["confidence"]) == ("lease_contract", "low") and "Timeout" in got["extraction_notes"]
    assert json.loads(got["llm_json"])["error"] == {"step": "classification", "message": "slow"}


def test_second_call_times_out(spark):
    got = answered(spark, Scripted('{"document_category": "lease_contract", "document_type": "t", "confidence": "medium"}', model.ModelTimeout("slow")))
    assert (got["document_type"], got["confidence"]) == ("t", "low") and "segunda avaliacao" in got["extraction_notes"]


def test_short_text_is_not_asked_about(spark):
    got = answered(spark, Scripted(AssertionError("asked")), body="short")
    assert (got["confidence"], got["extraction_notes"]) == ("low", fixed.SHORT_TEXT_NOTE)


def test_unreachable_model_ends_the_job(spark):
    with pytest.raises(Exception, match="ModelUnreachable"):
        answered(spark, Scripted(model.ModelUnreachable("down")))


def test_reply_shapes(spark):
    reply = '{"fields": {"lessee": "C", "property_details": {"property_article": "9"}, "contract_duration": {"start_date": "2020-01-01"}}, "lessors": ["X"], "currency": 3}'
    got = value(spark, lambda r, k: model.normalised(r, k), reply, "lease_contract")
    assert (got["values"]["lessee"], got["values"]["property_article"], got["values"]["contract_start_date"], got["values"]["lessor"]) == ("C", "9", "2020-01-01", '["X"]')
    assert got["unknown_keys"] == ["fields", "lessors"] and got["invalid_value_types"] == ["currency"] and not got["schema_valid"]


# --- files, register, scans and streams --------------------------------------------------------------------------------------


@pytest.fixture
def config(tmp_path):
    for name in ("in", "work"):
        (tmp_path / name).mkdir()
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"input_dir": "in", "register_path": "register", "processing_dir": "work", "archive_dir": "done", "error_dir": "bad", "minimum_file_age_seconds": 0, "ocr_enabled": "sim", "model_url": "http://x/"}))
    return files.Config.from_json(str(path))


def put(config, name, body):
    Path(config.input_dir, name).write_text(body)


def test_config(config, tmp_path):
    assert config.input_dir == str(tmp_path / "in") and config.ocr_enabled and config.model_url == "http://x" and config.max_pages == 12
    config.make_folders()
    assert (tmp_path / "bad").is_dir()


def test_scan_registers_each_content_once(spark, config):
    put(config, "a_CA_Maria Antonia Lopes.PDF", LEASE + "\f" + "segunda pagina " * 60)
    put(config, "copy.pdf", LEASE + "\f" + "segunda pagina " * 60)
    put(config, "other.txt", "no")
    assert intake.scan(spark, config, 2026) == 1 and intake.scan(spark, config, 2026) == 0
    put(config, "b.pdf", "outro documento")
    assert intake.scan(spark, config, 2026) == 1
    rows = register.read(spark, config.register_path, wide=True)
    assert rows.columns == fixed.REGISTER + fixed.QUALITY and rows.count() == 2 and len(fixed.REGISTER) == 62
    lease = rows.where("property_article = '440'").first()
    assert lease["document_category"] == "lease_contract" and lease["lessee"] == "GESTO ENERGIA, S.A." and lease["copied_file_path"].startswith(config.processing_dir) and "critical_recovery" in lease["raw_json"]


def test_scan_writes_nothing_when_the_model_is_gone(spark, config):
    put(config, "a.pdf", LEASE + "x" * 400)
    with pytest.raises(Exception, match="ModelUnreachable"):
        intake.scan(spark, config, 2026, asked=Scripted(model.ModelUnreachable("down")))
    assert register.read(spark, config.register_path).count() == 0


def test_stream_of_files(spark, config, tmp_path):
    put(config, "a.pdf", LEASE)
    for _ in range(2):
        watch.scan_available(spark, config, 2026, str(tmp_path / "stream")).awaitTermination()
    assert register.read(spark, config.register_path).count() == 1
    put(config, "b.pdf", LEASE)  # another file of the same content
    put(config, "c.pdf", "novo")
    watch.scan_available(spark, config, 2026, str(tmp_path / "stream")).awaitTermination()
    assert register.read(spark, config.register_path).count() == 2


def made_pdf(pages, packed=True):
    """A PDF of some pages of text lines, with compressed contents and, if ``packed``, its other objects in an object stream."""
    import zlib

    def stream(data, extra=b""):
        data = zlib.compress(data)
        return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(data), extra, data)

    kids = [10 + 2 * k for k in range(len(pages))]
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"}
    streams = {5: stream(b"1 beginbfchar <0001> <00E7> endbfchar 1 beginbfrange <0041> <005A> <0061> endbfrange")}
    for n, lines in zip(kids, pages):
        plain[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        escaped = [x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") for x in lines]
        body = b"BT /F1 12 Tf 50 700 Td " + b" T* ".join(b"(%s) Tj" % x for x in escaped) + b" T* [(Con) -20 (trato) -400 (novo)] TJ /F2 12 Tf T* <000100410042> Tj ET"
        streams[n + 1] = stream(body)
    out = b"%PDF-1.5\n"
    if packed:
        bodies = list(plain.items())
        heads, data = b"", b""
        for n, body in bodies:
            heads += b"%d %d " % (n, len(data))
            data += body + b" "
        streams[99] = stream(heads + data, b"/Type /ObjStm /N %d /First %d" % (len(bodies), len(heads)))
        plain = {}
    for n, body in [*plain.items(), *streams.items()]:
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_pages(packed):
    got = files.document_pages(made_pdf([["Primeira (1) página", "renda 500,00 EUR"], ["Segunda"]], packed))
    tidy = [" ".join(x.split()) for x in got]
    assert tidy == ["Primeira (1) página renda 500,00 EUR Contrato novo çab", "Segunda Contrato novo çab"]
    assert files.document_pages(b"plain\ftext") == ["plain", "text"] and files.document_pages(b"%PDF-1.4 damaged") == []


def test_scan_of_pdfs(spark, config):
    """A PDF's text is registered, not its bytes; it is staged and archived, and its times are there."""
    Path(config.input_dir, "a.pdf").write_bytes(made_pdf([["contrato de arrendamento com a renda de 500,00 EUR"] * 20]))
    assert intake.scan(spark, config, 2026) == 1
    row = register.read(spark, config.register_path, wide=True).first()
    assert int(row["native_text_chars"]) > 600 and row["text_source"] == "native_pdf_text" and "500,00 EUR" in row["deterministic_json"] and "%PDF" not in str(row)
    assert Path(row["copied_file_path"]).exists() and (Path(config.archive_dir) / Path(row["copied_file_path"]).name).exists()
    assert row["file_created_at"] and row["file_modified_at"]


def test_scan_with_ocr(spark, config, tmp_path):
    """OCR runs where native text is short, says why if it can't, and its results are used again."""
    import dataclasses

    config = dataclasses.replace(config, ocr_dir=str(tmp_path / "ocr"))
    Path(config.input_dir, "short.pdf").write_bytes(made_pdf([["pouco"]]))
    assert intake.scan(spark, config, 2026) == 1
    assert "OCR indisponivel" in register.read(spark, config.register_path).first()["extraction_notes"]
    tool = tmp_path / "bin" / "ocrmypdf"
    tool.parent.mkdir()
    (tmp_path / "read.pdf").write_bytes(made_pdf([["texto lido por OCR"] * 60]))
    tool.write_text(f"#!/bin/sh\nfor last; do :; done\ncp {tmp_path}/read.pdf \"$last\"\n")
    tool.chmod(0o755)
    config = dataclasses.replace(config, ocr_program=str(tool))
    for name, note in (("other.pdf", "OCR executado"), ("again.pdf", "OCR existente reutilizado")):
        Path(config.input_dir, name).write_bytes(made_pdf([["outro", name]]))
        if name == "again.pdf":
            digest = hashlib.sha256(Path(config.input_dir, name).read_bytes()).hexdigest()
            (tmp_path / "ocr" / f"again__{digest[:12]}__ocr.pdf").write_bytes((tmp_path / "read.pdf").read_bytes())
        assert intake.scan(spark, config, 2026) == 1
        row = register.read(spark, config.register_path).where(F.col("source_file_name") == name).first()
        assert note in row["extraction_notes"] and row["text_source"] == "cached_ocr_pdf_text" and int(row["ocr_text_chars"]) > 600


def test_unsettled_files_are_seen_later(spark, config, tmp_path):
    import dataclasses
    import os
    import time

    config = dataclasses.replace(config, minimum_file_age_seconds=3600)
    put(config, "Late.PDF", LEASE)
    watch.scan_available(spark, config, 2026, str(tmp_path / "stream")).awaitTermination()
    assert register.read(spark, config.register_path).count() == 0
    os.utime(Path(config.input_dir, "Late.PDF"), (time.time() - 7200,) * 2)
    watch.scan_available(spark, config, 2026, str(tmp_path / "stream")).awaitTermination()
    assert register.read(spark, config.register_path).count() == 1


def test_contents_are_not_shuffled(spark, config):
    """Hashes, paths and times are dealt to find what is new; contents are read for what is left."""
    put(config, "a.pdf", LEASE)
    found = files.listing(spark, config.input_dir, ".pdf", 0)
    plan = intake.new_files(found, register.hashes(spark, config.register_path))._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line or "Window" in line:
            assert "content" not in line


def test_register_header_changes(spark, tmp_path):
    path = str(tmp_path / "register")
    spark.createDataFrame([("h1", "gone")], "sha256 string, old_column string").write.parquet(path)
    register.append(record(spark, sha256="h2", lessor="A"), path)
    rows = {r["sha256"]: r for r in register.read(spark, path).collect()}
    assert rows["h1"]["lessor"] == "" and rows["h2"]["lessor"] == "A" and {r["sha256"] for r in register.hashes(spark, path).collect()} == {"h1", "h2"}


def test_error_row(spark):
    row = spark.range(1).withColumns(register.error_row(F.lit("x" * 2000))).first()
    assert row["processing_status"] == "error" and len(row["error_message"]) == 1000


def test_pages(spark):
    df = spark.createDataFrame([(["a  b", " ", "c" * 50, "d"],)], "pages array<string>")
    assert df.select(files.page_text(F.col("pages"), 3, 1000).alias("y")).first()["y"] == "[Page 1] a b\n\n[Page 3] " + "c" * 50
    assert df.select(files.page_text(F.col("pages"), 4, 20).alias("y")).first()["y"] == ("[Page 1] a b\n\n[Page 3] " + "c" * 50)[:20]


@pytest.mark.parametrize("native,cached,fresh,failure,enabled,source,ocr", [("n" * 700, "c" * 900, None, "", True, "native_pdf_text", 0), ("n", "c" * 90, None, "", False, "cached_ocr_pdf_text", 90), ("nnn", "c", None, "", False, "native_pdf_text", 1), ("n", None, None, "", False, "native_pdf_text", 0), ("n", None, "f" * 9, "", True, "cached_ocr_pdf_text", 9), ("n", None, None, "blocked", True, "native_pdf_text", 0)])
def test_ocr_choice(spark, native, cached, fresh, failure, enabled, source, ocr):
    text = lambda x: F.lit(x).cast("string")
    got = spark.range(1).select(files.ocr_choice(text(native), text(cached), text(fresh), text(failure), enabled).alias("c")).first()["c"]
    assert (got["source"], got["ocr_text_chars"]) == (source, ocr) and (got["notes"] != "") == (native != "n" * 700)


def test_staging_names(spark):
    assert value(spark, files.staging_name, " a/b:ç ", "0123456789abcdef") == "a_b_ç__0123456789ab.pdf"
    assert value(spark, files.staging_name, " ", "0123456789abcdef") == "document__0123456789ab.pdf"
