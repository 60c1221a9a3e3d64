"""Text functions and selection, on single values."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioforge.functions import fixed, select, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (text.document, "a\r\nb  c\r\n\r\n\r\n d\x00e ", "a\nb c\n\nde"),
        (text.document, None, ""),
        (text.without_noise, "abc\n\n" + "#* " * 10 + "\nx  y", "abc\nx y"),
        (text.searchable, "a  \tb\rc", "a b\nc"),
        (text.account, "pt50 0002-01.23", "PT5000020123"),
        (text.label, "  Secção  Única ", "seccao unica"),
        (text.comparable, " josé  ﬁm ", "JOSE FIM"),
        (text.alphanumeric, "é-1 b", "E1B"),
        (lambda x: text.first_words(x, 2), " a  b c", "a b"),
        (lambda x: text.has_text(x), "a" * 19 + " -", False),
        (lambda x: text.has_text(x), "a1" * 10, True),
        (lambda x: text.notes(x, F.lit(" "), F.lit("b ")), " a", "a | b"),
        (text.whole_number, " 12 ", 12),
        (text.whole_number, "1x", 0),
    ],
)
def test_function(spark, f, value, want):
    assert one(spark, value, f) == want


def without_marks(value):
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


def test_no_marks_in_all_of_unicode(spark):
    """Every code point alone, in runs of its neighbours and in random company, as unicodedata has it."""
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x30000 or unicodedata.category(chr(c)) != "Cn" and c < 0xE0200)]
    rng = random.Random(5)
    values = [chr(c) for c in codes] + ["".join(map(chr, codes[i : i + 64])) for i in range(0, len(codes), 64)]
    values += ["".join(rng.choice(["a", "é", "e\u0301\u0327", "ﬃ", "각", "힣", "½", "𝔸", "㌀", " ", chr(rng.choice(codes))]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").repartition(4)
    got = dict(rows.select("i", text.without_marks("x")).collect())
    assert [(i, v) for i, v in enumerate(values) if got[i] != without_marks(v)] == []
    assert one(spark, None, text.without_marks) == ""
    assert one(spark, " ÁÇÕüñ  Ελλάδα Й ｶﾞ ", text.comparable) == "ACOUN ΕΛΛΑΔΑ И カ"


def test_first_pages(spark):
    pages = "\n\n".join(f"[Page {i}] page number {i} with enough letters in it" for i in (1, 2, 3))
    sample = one(spark, pages, select.classification_sample)
    assert "[Page 1]" in sample and "[Page 2]" in sample and "[Page 3]" not in sample and "\n\n---\n\n" in sample


def test_first_words_without_pages(spark):
    words = " ".join(f"word{i}" for i in range(700))
    assert one(spark, words, select.classification_sample).split() == words.split()[:500]


def test_highlight(spark):
    marked = one(spark, "Pagamento de 1.234,56 EUR em 12/03/2024, no mês de março", select.highlight)
    for want in ("[[KEYWORD:Pagamento]]", "[[MONEY:1.234,56 EUR]]", "[[DATE:12/03/2024]]", "[[MONTH:março]]"):
        assert want in marked
    assert one(spark, "a contact", select.highlight) == "a [[KEYWORD:conta]]ct"


def plain_highlight(value):
    held = {}
    for name, pattern, flags in (("DATE", fixed.DATE, 0), ("MONEY", fixed.MONEY_MARK, re.I), ("MONTH", fixed.MONTH, re.I), ("KEYWORD", fixed.KEYWORD, re.I)):

        def keep(m, name=name):
            held[key := chr(0xE000 + len(held))] = f"[[{name}:{m[0]}]]"
            return key

        value = re.sub(re.sub(r"^\(\?i?U\)", "", pattern), keep, value, flags=flags)
    return "".join(held.get(c, c) for c in value)


def test_marks_never_overlap(spark):
    """Four passes give what protecting each marked span gives, on random strings of telling parts."""
    draw = random.Random(5)
    parts = ["12/03/2024", "2024-01-02", "1.234,56 EUR", "99 €", "euros", "março", "May", "conta", "data", "valor", "IBAN", "x", " ", ", ", "-", "1", "EUR", "10 euros"]
    texts = ["".join(draw.choice(parts) for _ in range(12)) for _ in range(2000)]
    got = [r["y"] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(select.highlight(F.col("x")).alias("y")).collect()]
    assert got == [plain_highlight(t) for t in texts]


def test_context(spark):
    assert one(spark, " \n ", select.extraction_context) == ""
    assert one(spark, "short", lambda x: select.extraction_context(x, 100)) == "[FULL DOCUMENT TEXT]\nshort"
    long = "\n".join(f"line {i} of a contrato with value {i},00 EUR" for i in range(400))
    got = one(spark, long, lambda x: select.extraction_context(x, 2000))
    assert len(got) <= 2000 and all(f"[{x}]" in got for x in fixed.EXCERPTS[:2])
    assert one(spark, long, lambda x: select.extraction_context(x, 0)) == ""


def test_recovery_excerpt(spark):
    long = "x" * 4000 + "\na renda\n" + "y" * 4000
    got = one(spark, long, select.recovery_excerpt)
    assert got == "x" * 3250 + "\n[RELEVANT LINES]\na renda\n[DOCUMENT END]\n" + "y" * 2167


def test_sections_are_kept_once(spark):
    head = "h" * 240
    got = spark.range(1).select(select.joined_sections(F.array(*map(F.lit, [f"{head}1", " ", f" {head}2", "b"]))).alias("y")).first()["y"]
    assert got == f"{head}1\n\n---\n\nb"
