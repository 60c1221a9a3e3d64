"""Validation rules of records, and the normalising and negative rules, in three profiles.

A record is a row of text columns; those it lacks count as empty. Each validation rule is a function of a getter (name
-> Column) to an array of issue codes; ``VALIDATORS`` lists them in order, and more can be added to a copy. The rules
that depend on each other run stage by stage, each reading what the stage before left.

Profiles: ``live`` validates and scores; ``full`` first coalesces signals, normalises and clears wrong values, and
reviews by required fields; ``strict`` also reviews medium confidence and any notes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums, fixed
from ..functions.detect import amount_in_context, bank_like, bank_name, category, generic_property, has, near
from ..functions.text import alphanumeric, collapse, comparable, distinct, first_filled, first_of, label, let, notes, sorted_distinct, strip, text, whole_number
from . import quality

Getter = Callable[[str], Column]
NONE = "array<string>"


def getter(df: DataFrame) -> Getter:
    return lambda name: strip(name) if name in df.columns else F.lit("")


def raw(df: DataFrame) -> Getter:
    return lambda name: text(name) if name in df.columns else F.lit("")


def codes(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def code_if(test: Column, code: str | Column) -> Column:
    return F.when(test, F.lit(code) if isinstance(code, str) else code)


def missing_critical(get: Getter, **_) -> Column:
    kind = F.lower(get("document_category"))
    return codes(*[code_if((kind == c) & (get(f) == ""), f"missing_{f}") for c, fields in fixed.CRITICAL.items() for f in fields])


def generic_names(get: Getter, **_) -> Column:
    return codes(*[code_if(comparable(get(f)).isin(fixed.GENERIC_NAMES), f"generic_{f}") for f in fixed.NAMED_FIELDS])


def future_dates(get: Getter, as_of_year: int, **_) -> Column:
    year = lambda f: let(F.regexp_extract(get(f), fixed.YEAR, 1), lambda y: F.when(y != "", y).try_cast("int"))  # a cast that fails costs an exception
    return codes(*[code_if(year(f) > as_of_year + 1, f"future_date_{f}") for f in fixed.DATE_FIELDS])


def property_section(get: Getter, **_) -> Column:
    value = get("property_section")
    return codes(code_if((value != "") & ~F.regexp_like(alphanumeric(value), F.lit("^[A-Z]{1,3}$")), "invalid_property_section"))


def confidence(get: Getter, **_) -> Column:
    value = F.lower(get("confidence"))
    return codes(code_if(value == "low", "low_confidence"), code_if(~value.isin("", "low", "medium", "high"), "invalid_confidence"))


def iban(get: Getter, **_) -> Column:
    shaped = lambda value: F.regexp_like(value, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"))
    wrong = lambda value: F.when(~shaped(value), F.when(value != "", "invalid_iban_format")).when(~checksums.any_iban(value), "invalid_iban_checksum")
    return codes(let(alphanumeric(get("iban")), wrong))


def owner_tax_id(get: Getter, **_) -> Column:
    found = lambda given: F.regexp_extract_all(F.regexp_replace(given, r"(?U)[.\s-]", ""), F.lit(r"(?<![0-9])[0-9]{9}(?![0-9])"), F.lit(0))
    wrong = lambda ids: F.when(F.size(ids) != 1, "invalid_or_multiple_owner_tax_id").when(~checksums.portuguese_tax_id(first_of(ids)), "invalid_owner_tax_id_checksum")
    return codes(let(get("owner_tax_id"), lambda given: F.when(given != "", let(found(given), wrong))))


def _lease(get: Getter, field: str) -> Column:
    return (F.lower(get("document_category")) == "lease_contract") & (get(field) != "")


def lessee(get: Getter, **_) -> Column:
    value = comparable(get("lessee"))
    generic = value.isin(fixed.GENERIC_NAMES)
    return codes(code_if(_lease(get, "lessee") & generic, "generic_lessee"), code_if(_lease(get, "lessee") & ~generic & (F.length(value) < 4), "suspicious_lessee"))


def monthly_rent(get: Getter, **_) -> Column:
    shaped = F.regexp_like(collapse(get("monthly_rent")), F.lit(fixed.RENT_FORMAT))
    nothing = F.regexp_like(F.regexp_replace(get("monthly_rent"), "[^0-9]", ""), F.lit("^0*$"))
    given = _lease(get, "monthly_rent")
    return codes(code_if(given & ~shaped, "invalid_monthly_rent_format"), code_if(given & shaped & nothing, "invalid_monthly_rent_value"))


VALIDATORS = [missing_critical, generic_names, future_dates, property_section, confidence, iban, owner_tax_id, lessee, monthly_rent]


def issues(df: DataFrame, as_of_year: int, validators=VALIDATORS) -> Column:
    """Sorted distinct issue codes of all rules."""
    get = getter(df)
    return sorted_distinct(F.flatten(F.array(*[rule(get, as_of_year=as_of_year) for rule in validators])))


def validated(df: DataFrame, as_of_year: int, validators=VALIDATORS) -> DataFrame:
    """``df`` with score, band, issues, priority, status, needs_review and review_reason."""
    get = getter(df)
    out = df.withColumn("issue_codes", issues(df, as_of_year, validators)).withColumn("old_reasons", quality.reasons(get("review_reason")))
    out = out.withColumn("machine_codes", sorted_distinct(F.concat(quality.machine(F.col("old_reasons")), F.col("issue_codes"))))
    out = out.withColumn("told_reasons", quality.narrative(F.col("old_reasons"))).withColumn("points", quality.score(F.col("issue_codes")))
    error = F.lower(get("processing_status")) == "error"
    review = quality.truthy(get("needs_review")) | (F.size("machine_codes") > 0) | (F.size("told_reasons") > 0)
    out = out.withColumns({
        "quality_score": F.col("points").cast("string"), "quality_band": quality.band(F.col("points")), "validation_issues": F.array_join("issue_codes", "; "),
        "review_priority": F.when(error, "HIGH").otherwise(quality.priority(F.col("issue_codes"))),
        "validation_status": F.when(error, "ERROR").when(review, "NEEDS_REVIEW").otherwise("AUTO_APPROVED"),
        "needs_review": F.when(error | review, "yes").otherwise("no"), "review_reason": F.array_join(distinct(F.concat("machine_codes", "told_reasons")), "; "),
    })
    return out.drop("issue_codes", "old_reasons", "machine_codes", "told_reasons", "points")


# --- normalising and negative rules ------------------------------------------------------------------------------------


def iso_date(x: Column) -> Column:
    """A date of one of seven forms as ISO text; anything else as it is. Two-digit years from 69 on are 19xx."""
    value = strip(x)
    forms = [(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy")]
    out = [F.when(F.regexp_like(value, F.lit(shape)), F.try_to_date(value, form)) for shape, form in forms]
    for shape, form in ((r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{2}$", "d.M.yyyy")):
        year = F.right(value, F.lit(2)).try_cast("int")
        full = F.concat(F.substr(value, F.lit(1), F.length(value) - 2), (year + F.when(year >= 69, 1900).otherwise(2000)).cast("string"))
        out.append(F.when(F.regexp_like(value, F.lit(shape)), F.try_to_date(full, form)))
    return F.coalesce(F.date_format(F.coalesce(*out), "yyyy-MM-dd"), value)


def currency(get: Getter) -> Column:
    value = F.upper(strip(get("currency")))
    both = F.concat_ws(" ", get("monthly_rent"), get("payment_amount"))
    known = F.when(value.isin("€", "EURO", "EUROS", "EUR"), "EUR").when(value.isin("$", "DOLLAR", "DOLLARS", "USD"), "USD").when(value.isin("£", "POUND", "POUNDS", "GBP"), "GBP").otherwise(get("currency"))
    implied = F.contains(both, F.lit("€")) | F.contains(F.upper(both), F.lit("EUR"))
    return F.when((known == "") & implied, "EUR").otherwise(known)


def stable_amount(x: Column) -> Column:
    """Digits with a point before decimals where there was a comma; empty for bank numbers."""
    value = strip(x)
    clean = F.regexp_replace(value, r"[^0-9,.-]", "")
    comma, point = F.contains(clean, F.lit(",")), F.contains(clean, F.lit("."))
    plain = F.when(comma & point, F.replace(F.replace(clean, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(comma, F.replace(clean, F.lit(","), F.lit("."))).otherwise(clean)
    return F.when((value == "") | bank_like(value), "").otherwise(plain)


class Stages:
    """A record under rules that see what earlier ones did; ``why`` gathers the reasons."""

    def __init__(self, df: DataFrame, body: str):
        own = [c for c in [*fixed.REGISTER, body] if c not in df.columns]
        self.df = df.withColumns({c: F.lit("") for c in own} | {c: text(c) for c in fixed.REGISTER if c in df.columns}).withColumn("why", F.array().cast(NONE))
        self.body = text(body)

    def get(self, name: str) -> Column:
        return F.col(name)

    def set(self, **values: Column) -> None:
        self.df = self.df.withColumns(values)

    def because(self, *parts: Column) -> None:
        self.df = self.df.withColumn("why", F.concat("why", codes(*parts)))

    def clear(self, field: str, test: Column, reason: str, **also: Column) -> None:
        """Empty a field that has a value and fails a test, and say why."""
        hit = (F.col(field) != "") & test
        self.set(hit=hit)
        self.set(why=F.concat("why", codes(code_if(F.col("hit"), reason))), **{name: F.when(F.col("hit"), value).otherwise(F.col(name)) for name, value in also.items()})
        self.set(**{field: F.when(F.col("hit"), "").otherwise(F.col(field))})
        self.df = self.df.drop("hit")


def from_signals(s: Stages, signals: str = "signals") -> None:
    """The category, and fields that signals know and the record lacks."""
    got = lambda name: F.col(f"{signals}.{name}")
    lists = {"iban": "ibans", "nib": "nibs", "bic_swift": "bic_swifts", "owner_tax_id": "tax_ids"}
    plain = ["property_article", "property_section", "property_parish", "property_municipality", "property_district"]
    s.set(document_category=category(first_filled(s.get("document_category"), got("suggested_category"))), **{f: first_filled(s.get(f), first_of(got(x))) for f, x in lists.items()}, **{f: first_filled(s.get(f), text(got(f))) for f in plain})


def normalised(s: Stages) -> None:
    s.set(**{f: iso_date(s.get(f)) for f in fixed.DATE_FIELDS})
    s.set(currency=currency(s.get))
    s.set(old_rent=s.get("monthly_rent"), old_amount=s.get("payment_amount"))
    s.set(monthly_rent=stable_amount(s.get("monthly_rent")), payment_amount=stable_amount(s.get("payment_amount")))
    s.clear("payment_amount", ~(amount_in_context(s.body, F.col("old_amount")) | amount_in_context(s.body, s.get("payment_amount"))), "payment_amount_without_clear_payment_context")
    s.clear("monthly_rent", bank_like(F.col("old_rent")) | bank_like(s.get("monthly_rent")), "monthly_rent_looked_like_bank_number")
    s.df = s.df.drop("old_rent", "old_amount")


def negative(s: Stages) -> None:
    """Values that aren't what their field says."""
    s.clear("payment_amount", bank_like(s.get("payment_amount")), "payment_amount_looked_like_bank_number")
    s.clear("property_name", bank_name(s.get("property_name")), "property_name_looked_like_bank_name")
    s.clear("property_display_name", generic_property(s.get("property_display_name")), "property_display_name_generic")
    s.clear("property_name", generic_property(s.get("property_name")), "property_name_generic")
    alike = collapse(F.lower(s.get("bank_account_holder"))) == collapse(F.lower(s.get("property_name")))
    s.clear("property_name", (s.get("bank_account_holder") != "") & alike, "property_name_matched_bank_account_holder")
    s.clear("property_address", has(s.get("property_address"), fixed.OWNER_ADDRESS), "property_address_looked_like_owner_address", owner_address=first_filled(s.get("owner_address"), s.get("property_address")))
    for field in ("property_name", "property_number", "property_display_name"):
        s.clear(field, bank_like(s.get(field)), f"{field}_looked_like_bank_number")
    unpaid = (s.get("document_category") == "bank_details") & ~has(s.body, fixed.CLEAR_PAYMENT)
    s.clear("payment_amount", unpaid, "bank_details_payment_amount_cleared")
    about = F.coalesce(near(s.body, strip(s.get("property_name")), 120, fixed.PROPERTY_CONTEXT), F.lit(False))
    s.clear("property_name", unpaid & ~about, "bank_details_property_name_without_property_context")


def display_name(s: Stages) -> None:
    parts = [s.get("property_name"), *[F.when(s.get(f) != "", F.concat(F.lit(word), s.get(f))).otherwise("") for f, word in (("property_article", "Artigo "), ("property_section", "Secção "))], s.get("property_number")]
    built = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " - ")
    s.set(shown=(s.get("property_display_name") != "") & ~generic_property(s.get("property_display_name")))
    s.set(property_display_name=F.when(F.col("shown"), s.get("property_display_name")).otherwise(built))
    s.clear("property_display_name", ~F.col("shown") & generic_property(s.get("property_display_name")), "property_display_name_generic_after_build")
    s.df = s.df.drop("shown")


def by_category(s: Stages) -> None:
    kind = s.get("document_category")
    s.set(hit=(kind == "property_document") & ((s.get("lessor") != "") | (s.get("lessee") != "")) & ~has(s.body, fixed.PARTY_TERMS))
    s.set(lessor=F.when(F.col("hit"), "").otherwise(s.get("lessor")), lessee=F.when(F.col("hit"), "").otherwise(s.get("lessee")))
    s.because(code_if(F.col("hit"), "property_document_contract_parties_cleared"))
    s.df = s.df.drop("hit")
    s.because(*_missing(s, kind == "payment_proof", fixed.REQUIRED["payment_proof"]))


def _missing(s: Stages, test: Column, fields: list[str]) -> list[Column]:
    return [code_if(test & (strip(s.get(f)) == ""), f"missing_{f}") for f in fields]


def reviewed(s: Stages, strict: bool, signals: str = "signals") -> None:
    """Reasons to look at a record, by its confidence, category, length and required fields."""
    kind, hint, sure = s.get("document_category"), F.col(f"{signals}.suggested_category"), F.lower(strip(s.get("confidence")))
    s.because(
        code_if(sure.isin("", "low", *(["medium"] if strict else [])), F.concat(F.lit("confidence="), F.when(sure == "", "blank").otherwise(sure))),
        code_if(kind == "other", "document_category=other"),
        code_if((hint != "other") & (kind != hint), F.concat(F.lit("category_changed_deterministic="), hint, F.lit("_llm="), kind)),
        code_if(F.greatest(whole_number(s.get("native_text_chars")), whole_number(s.get("ocr_text_chars"))) < 300, "extracted_text_too_short"),
    )
    filled = lambda f: strip(s.get(f)) != ""
    if strict:
        s.because(*[x for c, fields in fixed.REQUIRED.items() for x in _missing(s, kind == c, fields)], code_if(filled("extraction_notes"), "extraction_notes"))
    else:
        register_page = F.contains(label(F.concat_ws(" ", s.get("document_type"), s.get("document_subtype"))), F.lit("caderneta predial"))
        described = [filled(f) for f in ("property_display_name", "property_name", "property_number", "property_article", "property_address", "property_location")]
        anything = described[0]
        for more in described[1:]:
            anything = anything | more
        s.because(
            *_missing(s, kind == "lease_contract", ["lessor", "lessee", "signed_date", "monthly_rent"]), code_if((kind == "lease_contract") & ~anything, "missing_property_identification"),
            *_missing(s, (kind == "property_document") & register_page, ["property_article", "property_section", "property_parish", "property_municipality", "owner_name"]),
            *_missing(s, kind == "bank_details", ["bank_account_holder", "bank_name"]), code_if((kind == "bank_details") & ~filled("iban") & ~filled("nib"), "missing_iban_or_nib"),
        )
    odd = bank_like(s.get("payment_amount")) | bank_like(s.get("property_name")) | bank_like(s.get("property_number"))
    s.because(code_if((s.get("iban") != "") & odd, "iban_detected_in_suspicious_field"))


def ruled(df: DataFrame, body: str = "text", signals: str = "signals", strict: bool = False) -> DataFrame:
    """``df`` under the normalising, negative and review rules; review_reason gets their reasons, processing_status ``processed``."""
    s = Stages(df, body)
    from_signals(s, signals)
    normalised(s)
    negative(s)
    display_name(s)
    by_category(s)
    reviewed(s, strict, signals)
    why = F.array_distinct(F.filter("why", lambda x: x != ""))
    s.set(processing_status=F.lit("processed"), processed_ok=F.lit("yes"), needs_review=F.when(F.size("why") > 0, "yes").otherwise("no"), review_reason=notes(s.get("review_reason"), F.array_join(why, ", ")))
    return s.df.drop("why")


def apply(df: DataFrame, profile: str, as_of_year: int, body: str = "text", signals: str = "signals") -> DataFrame:
    """Validation in one of the profiles ``live``, ``full`` and ``strict``."""
    if profile not in ("live", "full", "strict"):
        raise ValueError(f"no such profile: {profile}")
    return validated(df if profile == "live" else ruled(df, body, signals, strict=profile == "strict"), as_of_year)
