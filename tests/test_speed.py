"""What keeps the intake queries fast over large tables: rows on all cores, and short tests before patterns that miss nothing."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from folioforge.functions import checksums, detect, fixed, text
from folioforge.operators import model, rules
from folioforge.plans import queries
from folioforge.plans.fixtures import TABLES, made

PATTERNS = {
    "iban": [fixed.IBAN], "nib": [fixed.NIB_LABELLED], "bic": [fixed.BIC], "tax_id": [fixed.TAX_ID], "money": [fixed.MONEY], "article": [fixed.ARTICLE_AND_SECTION, fixed.ARTICLE, fixed.MATRIX_ARTICLE], "section": [fixed.SECTION, fixed.ARTICLE_AND_SECTION],
    "bank": [fixed.BANK_TERMS], "payment": [fixed.PAYMENT_TERMS], "property": [fixed.PROPERTY_TERMS], "lease": [fixed.LEASE_TERMS],
} | {word: [pattern] for pattern, word in fixed.PLACES.values()}
SAMPLES = (
    "NIB: 000201231234567890154|PT50 0002 0123 1234 5678 9015 4|BCOMPTPL|NIF 123456789|NIPC: 123456789|número fiscal 123456789|n. de contribuinte 123456789|1.234,56 EUR|12 USD|5 £|7 €|8 $|GBP 12 EUR|artigo matricial n.º 77|art. 12|matriz predial rústica 5"
    "|matriz 9, secção B|secçao J|seccao n. J|secão K|IBAN|NIB|BIC|SWIFT|dados bancários|conta bancaria|instituição bancária|banco|comprovativo|pagamento|transferência|montante|valor pago|beneficiário|ordenante|caderneta|certidão"
    "|conservatória|registo predial|CRP|prédio|contrato de arrendamento|senhorio|arrendatário|renda|locador|locatário|freguesia de: Vila|paróquia X|concelho: Mogadouro|município Y|distrito 04"
).split("|")


def test_rows_go_to_all_cores(spark, tmp_path):
    """A table in one row group is no single task."""
    for table, columns in (("orders", "id AS o_orderkey, id AS o_custkey"), ("customer", "id AS c_custkey, 'n' AS c_name"), ("documents", "id AS doc_id, 's' AS source, 'x' AS text")):
        spark.range(2000).selectExpr(*columns.split(", ")).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name in TABLES:
        tasks = made(spark, str(tmp_path), name).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in tasks) == 2000, name


def test_stems_miss_nothing(spark):
    """Where a pattern matches, in whatever letters, a stem of its name is in the folded text."""
    draw = random.Random(3)
    odd = {"i": "ıİI", "s": "ſS", "a": "AáÁâ", "o": "OóºÓ", "c": "çÇC", "e": "EêÊ", "u": "ÚU", "í": "Íi", "t": "T", "r": "R", "n": "N", "p": "P", "k": "\u212a"}
    change = lambda c: draw.choice(odd[c.lower()]) if c.lower() in odd and draw.random() < 0.35 else c
    rows = [(s,) for s in SAMPLES] + [("".join(map(change, draw.choice(SAMPLES))) + draw.choice(["", " x", "\u0301"]),) for _ in range(6000)]
    df = spark.createDataFrame(rows, "x string").withColumn("low", text.folded("x"))
    for name, patterns in PATTERNS.items():
        for pattern in patterns:
            met = df.where(F.regexp_like("x", F.lit(pattern)))
            assert met.count() > 10 and met.where(~detect.may(F.col("low"), fixed.STEMS[name])).count() == 0, name


def test_white_space_like_patterns(spark):
    """strip, collapse, lines, labels and searchable texts against the plain patterns."""
    draw = random.Random(4)
    signs = [*"\t\n\x0b\f\r \x1c\x1e\x1f\x85\xa0\u1680\u2007\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\u180e", "  ", "a", "É", "ß", "\r\n"]
    rows = [("".join(draw.choice(signs) for _ in range(draw.randrange(9))),) for _ in range(4000)] + [(None,)]
    x = text.text("x")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "[\xa0\u2007\u202f]", " "), "[ \t]+", " ")
    want = {"strip": F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), "collapse": F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), "lines": F.split(x, r"\R|[\x1c-\x1e]").cast("string"), "searchable": plain}
    want["label"] = F.regexp_replace(text.without_marks(F.lower(want["strip"])), r"(?U)\s+", " ")
    got = {name: getattr(text, name)("x").cast("string") for name in want}
    df = spark.createDataFrame(rows, "x string").select("x", *[F.struct(got[n].alias("got"), want[n].alias("want")).alias(n) for n in want])
    for n in want:
        assert df.where(f"NOT {n}.got <=> {n}.want").count() == 0, n


def test_patterns_that_look_ahead(spark):
    """Keywords by their first letters, starts of dates, amounts and months, and the count of letters match as the plain patterns do."""
    draw = random.Random(5)
    odd = {"i": "ıİíI", "s": "ſS", "a": "áA", "c": "ç", "j": "J", "m": "M"}
    change = lambda c: draw.choice(odd[c]) if c in odd and draw.random() < 0.2 else c
    parts = [*fixed.KEYWORDS, "artigo matricia", "12/03/2024", "1.3.99", "2024-01-02", "EUR 1.234,56 EUR", "usd5 €", "7 euros", "março", "september", "janeiro", " ", " ", "x", "-", "9", "٣", "\u0301", "\U0001d7d8", "\U00010400", "\n"]
    rows = [("".join(change(c) for _ in range(draw.randrange(1, 8)) for c in draw.choice(parts)),) for _ in range(6000)]
    keyword = "(?iU)" + "|".join(sorted(fixed.KEYWORDS, key=lambda x: (-len(x), x)))
    pairs = {"keyword": (fixed.KEYWORD, keyword)} | {n: (detect.starting(p, first), p) for n, p, first in (("date", fixed.DATE, r"\d"), ("money", fixed.MONEY, r"EUG\d"), ("mark", fixed.MONEY_MARK, r"EUG\d"), ("month", fixed.MONTH, "ADFJMNOS"))}
    df = spark.createDataFrame(rows, "x string")
    for name, (fast, plain) in pairs.items():
        assert df.where(F.size(detect.found(F.col("x"), plain)) > 0).count() > 40, name
        assert df.where(detect.found(F.col("x"), fast) != detect.found(F.col("x"), plain)).count() == 0, name
    assert df.where(text.has_text("x") != (text.letters_and_digits("x") >= 20)).count() == 0 and 0 < df.where(text.has_text("x")).count() < 6000


def test_types_of_replies(spark):
    """Values that aren't texts are told by the reply's own types, with no pattern made for each key."""
    replies = ['{"lessor": "A", "lessee": 5, "currency": "EUR"}', '{"lessor": ["A"], "lessee": {"currency": 1}, "currency": null}', '{"currency": "x"}', '{"lessee": "a, lessor: STRING,", "lessor": true}', "[1]", "", "{}"]
    df = spark.createDataFrame([(r,) for r in replies], "x string").withColumn("n", model.normalised(F.col("x"), F.lit("lease_contract")))
    assert [r["wrong"] for r in df.select(F.col("n.invalid_value_types").alias("wrong")).collect()] == [["lessee"], ["currency", "lessee", "lessor"], [], ["lessor"], [], [], []]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "STRING(?:" not in plan


def test_account_rules_work_values_out_once(spark, tmp_path):
    """A tax number is looked for once, and remainders take several digits a step; the codes are those of plain Python."""
    draw = random.Random(6)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    def iban():
        body = draw.choice([lambda: digits(21), lambda: digits(13), lambda: digits(30), lambda: "".join(draw.choice("ABWZ059") for _ in range(draw.randrange(10, 31)))])()
        land = draw.choice(["PT", "GB", "ZZ", "AA"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        whole = f"{land}{check if draw.random() < 0.6 else draw.randrange(100):02}{body}"
        return draw.choice([whole, whole, whole.lower(), " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)), whole.replace("A", "Á") + "\xa0", whole[:12], whole + "0" * 12, digits(25)])
    def number():
        first = digits(8)
        check = 11 - sum(int(c) * (9 - i) for i, c in enumerate(first)) % 11
        whole = first + (str(check % 11 % 10) if draw.random() < 0.6 else digits(1))
        return draw.choice([whole, whole, f"{whole[:3]} {whole[3:6]}.{whole[6:]}", whole + "0", whole[:8], f"{whole}/{whole}", "n. " + whole + "x", "٣" + whole])
    def codes(iban, number):
        plain = re.sub("[^A-Z0-9]", "", "".join(c for c in unicodedata.normalize("NFKD", iban) if not unicodedata.combining(c)).upper())
        shaped = re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", plain)
        sound = shaped and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        ids = re.findall("(?<![0-9])[0-9]{9}(?![0-9])", re.sub(r"[.\s-]", "", number))
        right = len(ids) == 1 and (11 - sum(int(c) * (9 - i) for i, c in enumerate(ids[0][:8])) % 11) % 11 % 10 == int(ids[0][8])
        one = [] if not plain or sound else ["invalid_iban_checksum" if shaped else "invalid_iban_format"]
        return one, [] if not number.strip() or right else ["invalid_owner_tax_id_checksum" if len(ids) == 1 else "invalid_or_multiple_owner_tax_id"]
    rows = [(iban(), number()) for _ in range(3000)] + [("", ""), (" \xa0", "\t"), ("-", "-")]
    df = spark.createDataFrame(rows, "iban string, owner_tax_id string").coalesce(1)
    got = df.select("iban", "owner_tax_id", rules.iban(rules.getter(df)).alias("a"), rules.owner_tax_id(rules.getter(df)).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [codes(*row) for row in rows]
    assert len({tuple(r["a"]) for r in got}) == len({tuple(r["b"]) for r in got}) == 3
    spark.range(9).selectExpr("id AS c_custkey", "'n' AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    plan = queries.account_rules(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == plan.count("aggregate(") == 1


def test_checksums_of_other_shapes(spark):
    """Remainders of any length; false for what isn't upper-case letters and digits."""
    draw = random.Random(7)
    numbers = ["", "0", "97", "000000000098", *["".join(draw.choice("0123456789") for _ in range(n)) for n in range(1, 80)]]
    df = spark.createDataFrame([(n,) for n in numbers], "x string").coalesce(1)
    assert [r["r"] for r in df.select(checksums.remainder_97(F.col("x")).alias("r")).collect()] == [int(n or 0) % 97 for n in numbers]
    odd = ["GB82WEST12345698765432", "gb82west12345698765432", "GB82 WEST12345698765432", "GB82-", "é", ""]
    df = spark.createDataFrame([(o,) for o in odd], "x string").coalesce(1)
    assert [r["r"] for r in df.select(checksums.any_iban(F.col("x")).alias("r")).collect()] == [True, False, False, False, False, False]


def test_replies_are_read_once(spark):
    """The second prompt reads the first reply once, and a record's values are had without the types of its reply; they are those of ``normalised``."""
    replies = ['{"document_category": " Identification ", "lessor": 5}', 'x {"fields": {"lessee": "C"}} y', "none", "{}", None, '{"document_category": "heard of", "lessors": ["A"]}']
    signals = F.struct(*[F.lit("lease_contract").alias(n) if n == "suggested_category" else F.lit("s").alias(n) for n in ("suggested_category", "dates")])
    df = spark.createDataFrame([(r,) for r in replies], "x string")
    both = df.select(model.values(F.col("x"), F.lit("lease_contract")).alias("a"), model.normalised(F.col("x"), F.lit("lease_contract"))["values"].alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both] and both[1]["a"]["lessee"] == "C" and both[0]["a"]["lessor"] == "5"
    shown = spark.createDataFrame([("f", "t" * 300)], "file_name string, text string").withColumns({"sample": F.col("text"), "context": F.col("text"), "signals": signals})
    asked = model.asked(shown, model.OfflineModel())
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    calls = [part.split("\n+-")[0] for part in plan.split("ArrowEvalPython")[1:]]
    assert len(calls) == 2 and max(c.count("from_json(") for c in calls) <= 2
    assert "schema_of_variant" not in model.merged(asked)._jdf.queryExecution().optimizedPlan().toString().lower().replace("schemaofvariant", "schema_of_variant")
    assert asked.first()["reply_2"].startswith('{"signed_date": ""')
