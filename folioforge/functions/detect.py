"""Signals of a document: account numbers, tax ids, amounts, dates, property identifiers, vocabularies and category.

``with_signals`` adds one struct column. Its parts are added stage by stage, so that later parts read earlier ones
instead of matching again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checksums, fixed
from .text import account, collapse, distinct, first_filled, first_match, first_of, folded, label, let, lines, searchable, strip, strip_of, text, without_marks

SIGNALS = (
    "file_category suggested_category category_reasons ibans nibs bic_swifts tax_ids monetary_values dates property_article property_section "
    "property_parish property_municipality property_district has_bank_terms has_payment_terms has_property_terms has_lease_terms"
).split()


def starting(pattern: str, first: str) -> str:
    """A pattern that looks first whether a character is one with which its matches begin, before its word edges."""
    flags, rest = pattern.split(")", 1)
    return f"{flags})(?=[{first}]){rest}"


def found(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def may(low: Column, stems: list[str]) -> Column:
    """Whether a folded text has one of the stems without which a pattern can't match: a search for bytes, where the pattern would be tried at each character."""
    tests = [F.contains(low, F.lit(stem)) for stem in stems]
    out = tests[0]
    for more in tests[1:]:
        out = out | more
    return out


def if_any(low: Column | None, name: str, value: Column, none: Column | None = None) -> Column:
    """``value``, or ``none`` (an empty list) where the folded text, if given, lacks all stems of that ``name``."""
    return value if low is None else F.when(may(low, fixed.STEMS[name]), value).otherwise(F.array().cast("array<string>") if none is None else none)


def ibans(x: Column) -> Column:
    return distinct(F.filter(F.transform(found(x, fixed.IBAN), account), checksums.portuguese_iban))


def nibs(x: Column, known_ibans: Column, low: Column | None = None) -> Column:
    """Valid 21-digit numbers, labelled ones first, that aren't the digits of a known IBAN."""
    seen = F.concat(if_any(low, "nib", found(x, fixed.NIB_LABELLED, 1)), found(x, fixed.NIB_BARE))
    of = lambda valid: F.when(F.size(valid) == 0, valid).otherwise(distinct(F.array_except(distinct(valid), F.transform(known_ibans, lambda v: F.substr(v, F.lit(5))))))
    return let(F.filter(F.transform(seen, account), checksums.portuguese_nib), of)


def bics(x: Column) -> Column:
    return distinct(F.transform(found(x, fixed.BIC), F.upper))


def tax_ids(x: Column) -> Column:
    return distinct(F.filter(found(x, fixed.TAX_ID, 1), checksums.portuguese_tax_id))


def amounts(x: Column) -> Column:
    return distinct(found(x, starting(fixed.MONEY, r"EUG\d")))


def dates(x: Column) -> Column:
    return distinct(found(x, starting(fixed.DATE, r"\d")))


def identifier(x: Column) -> Column:
    of = lambda value: F.when(F.regexp_like(value, F.lit(r"^(?:\d{1,10}(?:[-/][A-Z0-9]{1,10})?|[A-Z]{1,4}-?\d{1,10})$")), value).otherwise("")
    return let(F.regexp_replace(F.upper(strip(x)), r"(?U)\s*([/-])\s*", "$1"), of)


def section(x: Column) -> Column:
    return let(F.upper(strip(x)), lambda value: F.when(F.regexp_like(value, F.lit("^[A-Z]{1,3}$")) & ~value.isin(fixed.NOT_SECTIONS), value).otherwise(""))


def first_section(x: Column) -> Column:
    return first_of(F.filter(F.transform(found(x, fixed.SECTION, 1), section), lambda v: v != ""))


def article_and_section(x: Column) -> tuple[Column, Column]:
    """The first article that a section may follow, with its own section or else the text's first; or an article of another form."""
    number, letters = (first_match(x, fixed.ARTICLE_AND_SECTION, i) for i in (1, 2))  # a match has a number
    tidy = lambda v: strip_of(F.regexp_replace(v, r"(?U)\s+", " "), " .:-;\n\t")
    other = first_filled(tidy(first_match(x, fixed.ARTICLE)), tidy(first_match(x, fixed.MATRIX_ARTICLE)))
    article = let(let(number, lambda n: F.when(n != "", n).otherwise(other)), identifier)
    return article, let(let(letters, section), lambda own: F.when(own != "", own).otherwise(first_section(x)))


def place(x: Column) -> Column:
    ends = " .,:;-\t"

    def of(value: Column) -> Column:
        good = F.length(value).between(3, 80) & F.regexp_like(value, F.lit(fixed.PLACE)) & ~label(value).isin(fixed.NOT_PLACES)
        return F.when(good, F.regexp_replace(value, r"(?U)\s+", " ")).otherwise("")

    return let(strip_of(F.regexp_replace(strip_of(x, ends), rf"(?s){fixed.PLACE_END}.*", ""), ends), of)


def unmarked_lines(text_lines: Column) -> Column:
    """Lower-cased lines without marks: what a line's label contains of a word they contain too."""
    return F.transform(text_lines, lambda s: without_marks(F.lower(s)))


def place_of(text_lines: Column, pattern: str, word: str, low_lines: Column | None = None) -> Column:
    """The first good place on a line that names its kind; else one in a coded row on such a line or the two after it.

    ``low_lines`` are ``unmarked_lines``, if at hand. Lines without a stem of the kind's names are not matched.
    """
    none = F.array().cast("array<string>")

    def of(rows: Column, low: Column) -> Column:
        named = F.filter(rows, lambda s, i: may(F.translate(F.get(low, i), "ı", "i"), fixed.STEMS[word]))
        given = lambda lines, p: first_of(F.filter(F.transform(F.filter(F.transform(lines, lambda s: F.regexp_extract(s, p, 1)), lambda v: v != ""), place), lambda v: v != ""))
        around = F.flatten(F.transform(rows, lambda s, i: F.when(F.contains(F.get(low, i), F.lit(word)), F.slice(rows, i + 1, 3)).otherwise(none)))
        return let(given(named, pattern), lambda v: F.when(v != "", v).otherwise(given(around, fixed.CODED_PLACE)))

    return let(text_lines, lambda rows: let(unmarked_lines(rows) if low_lines is None else low_lines, lambda low: of(rows, low)))


def has(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(pattern))


def bank_like(x: Column) -> Column:
    value = account(x)
    long_number = (F.length(F.regexp_replace(text(x), r"[^0-9]", "")) >= 16) & ~has(text(x), fixed.MONEY)
    return (F.startswith(value, F.lit("PT50")) & (F.length(value) == 25)) | long_number


def _any_in(x: Column, names: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(x, n))


def bank_name(x: Column) -> Column:
    return _any_in(label(x), fixed.BANK_NAMES)


def generic_property(x: Column) -> Column:
    return label(x).isin(fixed.GENERIC_PROPERTIES)


def near(whole: Column, part: Column, span: int, pattern: str) -> Column:
    """Whether ``pattern`` matches within ``span`` characters of the first place of ``part``; null if it has none."""
    at = F.instr(F.lower(whole), F.lower(part))
    start = F.greatest(F.lit(1), at - span)
    window = F.substr(whole, start, at + F.length(part) + span - start)
    return F.when(at > 0, has(window, pattern))


def amount_in_context(whole: Column, amount: Column) -> Column:
    """Whether an amount stands near a word of payment; one that isn't in the text must look like money."""
    value = strip(amount)
    return (value != "") & ~bank_like(text(amount)) & F.coalesce(near(text(whole), value, 80, fixed.AMOUNT_CONTEXT), has(text(amount), fixed.MONEY))


def file_category(name: Column) -> tuple[Column, Column]:
    """The category that a file's name tells, and why; both empty if none."""
    low = F.lower(text(name))
    rules = [
        (F.contains(F.regexp_replace(low, r"(?U)\s+", ""), F.lit("cadernetapredial")), "property_document", "CadernetaPredial"),
        (has(low, fixed.FILE_CRP), "property_document", "CRP"),
        (_any_in(low, fixed.FILE_BANK), "bank_details", "IBAN/NIB/BIC/SWIFT"),
        (has(text(name), fixed.FILE_LEASE_CODE) | _any_in(low, fixed.FILE_LEASE), "lease_contract", "CA/CAV/Contrato/Arrendamento/Ratificacao"),
        (_any_in(low, fixed.FILE_PAYMENT), "payment_proof", "comprovativo/transferencia/pagamento"),
    ]
    category, why = F.lit(""), F.lit("")
    for test, kind, reason in reversed(rules):
        category, why = F.when(test, kind).otherwise(category), F.when(test, f"filename:{reason}").otherwise(why)
    return category, why


def suggested(s) -> Column:
    """The category that signals suggest; ``s`` gives a signal's column by name."""
    clear = s("has_payment_terms") & (F.size(s("monetary_values")) > 0) & (F.size(s("dates")) > 0)
    return (
        F.when(s("file_category") != "", s("file_category")).when(s("has_lease_terms"), "lease_contract").when(s("has_property_terms"), "property_document")
        .when(clear, "payment_proof").when(s("has_bank_terms"), "bank_details").otherwise("other")
    )


def category(x: Column) -> Column:
    """An official category; any other value is ``other``."""
    of = lambda value: F.when(value == "identification", "identity_document").when(value.isin(list(fixed.CATEGORIES)), value).otherwise("other")
    return let(F.lower(strip(x)), of)


def with_signals(df: DataFrame, file_name: str = "file_name", body: str = "text", to: str = "signals") -> DataFrame:
    """``df`` with a struct of all signals of its text and file name."""
    own = "signal_"
    s = lambda name: F.col(own + name)
    term = lambda name, pattern: if_any(s("low"), name, has(s("body"), pattern), F.lit(False))
    article, letters = article_and_section(s("body"))
    kind, why = file_category(F.col(file_name))
    out = df.withColumn(own + "body", searchable(body)).withColumn(own + "low", folded(s("body")))
    out = out.withColumns({
        own + "lines": F.transform(lines(s("body")), collapse), own + "ibans": if_any(s("low"), "iban", ibans(s("body"))), own + "bic_swifts": if_any(s("low"), "bic", bics(s("body"))), own + "tax_ids": if_any(s("low"), "tax_id", tax_ids(s("body"))),
        own + "monetary_values": if_any(s("low"), "money", amounts(s("body"))), own + "dates": dates(s("body")),
        own + "property_article": if_any(s("low"), "article", article, F.lit("")), own + "property_section": if_any(s("low"), "section", letters, F.lit("")),
        own + "has_payment_terms": term("payment", fixed.PAYMENT_TERMS), own + "has_property_terms": term("property", fixed.PROPERTY_TERMS), own + "has_lease_terms": term("lease", fixed.LEASE_TERMS),
        own + "file_category": kind, own + "why": why,
    }).withColumn(own + "low_lines", unmarked_lines(s("lines")))
    named = {name: if_any(s("low"), word, place_of(s("lines"), pattern, word, s("low_lines")), F.lit("")) for name, (pattern, word) in fixed.PLACES.items()}
    out = out.withColumns({own + name: value for name, value in named.items()} | {own + "nibs": nibs(s("body"), s("ibans"), s("low"))})
    out = out.withColumns({
        own + "has_bank_terms": term("bank", fixed.BANK_TERMS) | (F.size(s("ibans")) + F.size(s("nibs")) + F.size(s("bic_swifts")) > 0),
        own + "category_reasons": F.filter(F.array(s("why")), lambda x: x != ""),
    })
    out = out.withColumn(own + "suggested_category", suggested(s))
    return out.withColumn(to, F.struct(*[s(name).alias(name) for name in SIGNALS])).drop(*[c for c in out.columns if c.startswith(own)])
