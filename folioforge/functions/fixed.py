"""Word lists, patterns, labels and numbers that results must agree on, stated as they are.

Patterns are for java.util.regex; ``(?iU)`` makes case and character classes follow Unicode.
"""

# --- fixed values: categories and field groups ---------------------------------------------------------------------
CATEGORIES = {
    "lease_contract": "Contrato de arrendamento.",
    "property_document": "Caderneta, certidao, CRP, registo predial, matriz ou averbamento.",
    "bank_details": "Dados bancarios com IBAN, NIB, BIC/SWIFT, titular ou conta, sem prova clara de pagamento.",
    "payment_proof": "Comprovativo de transferencia ou pagamento com data, pagador, beneficiario e valor.",
    "invoice_or_receipt": "Fatura ou recibo que nao seja claramente comprovativo bancario.",
    "identity_document": "Documento de identificacao pessoal ou empresarial.",
    "tax_document": "Documento fiscal.",
    "correspondence": "Carta, notificacao ou comunicacao.",
    "other": "Fallback local.",
}
OPERATIONAL = ["processed_at", "source_file_name", "copied_file_path", "sha256", "file_created_at", "file_modified_at", "processing_status", "processed_ok", "needs_review", "review_reason", "reviewed_by", "reviewed_at", "error_message"]
GENERAL = ["document_category", "document_type", "document_subtype", "document_date", "summary", "language", "confidence", "extraction_notes"]
LEASE = ["signed_date", "contract_type", "lessor", "lessee", "contract_start_date", "contract_end_date", "rent_payment_day", "monthly_rent", "currency"]
PROPERTY = ["property_name", "property_number", "property_display_name", "property_article", "property_section", "property_parish", "property_municipality", "property_district", "property_location", "property_address", "owner_name", "owner_tax_id", "owner_address"]
BANK = ["bank_account_holder", "iban", "nib", "bic_swift", "bank_name", "bank_account_number"]
PAYMENT = ["payment_date", "payer", "payee", "payment_amount", "payment_method", "payment_reference", "payment_description"]
TECHNICAL = ["text_source", "native_text_chars", "ocr_text_chars", "deterministic_json", "llm_json", "raw_json"]
QUALITY = ["quality_score", "quality_band", "validation_status", "validation_issues", "review_priority"]
REGISTER = OPERATIONAL + GENERAL + LEASE + PROPERTY + BANK + PAYMENT + TECHNICAL
OWNER = ["owner_name", "owner_tax_id", "owner_address"]
CATEGORY_FIELDS = {
    "lease_contract": GENERAL + LEASE + PROPERTY,
    "property_document": GENERAL + PROPERTY,
    "bank_details": GENERAL + BANK + PROPERTY,
    "payment_proof": GENERAL + PAYMENT + BANK + PROPERTY,
    "invoice_or_receipt": GENERAL + PAYMENT + PROPERTY,
    "identity_document": GENERAL + OWNER,
    "tax_document": GENERAL + PAYMENT + OWNER[:2],
    "correspondence": GENERAL + PROPERTY,
    "other": GENERAL + PROPERTY + BANK + PAYMENT,
}
CRITICAL = {
    "lease_contract": ["lessor", "lessee", "signed_date", "property_article", "monthly_rent"],
    "property_document": ["property_article", "property_section", "owner_name"],
    "bank_details": ["iban", "bank_account_holder"],
    "payment_proof": ["payment_date", "payer", "payee", "payment_amount"],
}
REQUIRED = {
    "lease_contract": ["lessor", "lessee", "property_display_name", "contract_start_date", "monthly_rent"],
    "payment_proof": ["payment_date", "payer", "payee", "payment_amount"],
}

# --- fixed values: entity patterns -----------------------------------------------------------------------------------
CURRENCY = r"(?:EUR|USD|GBP|€|\$|£)"
NUMBER_MARK = r"(?:n[.ºo°]*\s*)?[:#-]?\s*"
IBAN = r"(?iU)\bPT50(?:[\s.-]*\d){21}\b"
NIB_LABELLED = r"(?iU)\bNIB\D{0,12}((?:\d[\s.-]*){21})"
NIB_BARE = r"(?U)(?<!\d)(?:\d[\s.-]*){21}(?!\d)"
BIC = r"(?iU)\b[A-Z]{4}PT[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"
TAX_ID = r"(?iU)\b(?:NIF|NIPC|n[uú]mero fiscal|n\.?\s*(?:de\s+)?contribuinte|contribuinte)\D{0,20}(\d{9})\b"
MONEY = rf"(?iU)(?:(?:EUR|USD|GBP)\s*)?\b\d{{1,3}}(?:[ .]\d{{3}})*(?:,\d{{2}}|\.\d{{2}})?\b\s*{CURRENCY}"
DATE = r"(?U)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\.\d{1,2}\.\d{2,4})\b"
ARTICLE_AND_SECTION = rf"(?iU)\b(?:artigo|matriz)\s*{NUMBER_MARK}([0-9]{{1,10}})(?:\s*(?:,|-)?\s*sec(?:c|ç)[aã]o\s*[:#-]?\s*([A-Z]{{1,3}}))?\b"
ARTICLE = rf"(?iU)\b(?:artigo(?:\s+matricial)?|art\.?)\s*{NUMBER_MARK}([0-9]{{1,10}}(?:\s*[-/]\s*[A-Z0-9]{{1,10}})?|[A-Z]{{1,4}}\s*-?\s*[0-9]{{1,10}})\b"
MATRIX_ARTICLE = rf"(?iU)\bmatriz(?:\s+predial)?(?:\s+r[uú]stica)?\s*{NUMBER_MARK}([0-9]{{1,10}})\b"
SECTION = rf"(?iU)\bsec(?:c|ç)[aã]o\s*{NUMBER_MARK}([A-Z]{{1,3}})\b"
PLACES = {
    "property_parish": (r"(?iU)\b(?:freguesia|par[oó]quia)(?:\s+de)?\s*[:#-]?\s*(.+)$", "freguesia"),
    "property_municipality": (r"(?iU)\b(?:concelho|munic[ií]pio)(?:\s+de)?\s*[:#-]?\s*(.+)$", "concelho"),
    "property_district": (r"(?iU)\bdistrito(?:\s+de)?\s*[:#-]?\s*(.+)$", "distrito"),
}
CODED_PLACE = r"(?iU)^\s*\d{1,3}\s*[-–:]\s*([A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ' .-]{2,60})\s*$"
PLACE_END = r"(?iU)\b(?:artigo|matriz|sec(?:c|ç)[aã]o|concelho|munic[ií]pio|distrito|morada|titular|confronta(?:ções|coes)?)\b"
PLACE = r"^[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ' .-]*$"
NOT_PLACES = ["artigo", "matriz", "seccao", "concelho", "municipio", "distrito", "morada", "localizacao", "titular", "proprietario", "confronta", "confrontacoes"]
NOT_SECTIONS = ["ART", "DA", "DE", "DO", "DOS", "DAS"]

# --- fixed values: vocabularies --------------------------------------------------------------------------------------
BANK_TERMS = r"(?iU)\b(?:IBAN|NIB|BIC|SWIFT|dados banc[aá]rios|conta banc[aá]ria|institui[cç][aã]o banc[aá]ria|banco)\b"
PAYMENT_TERMS = r"(?iU)\b(?:comprovativo|pagamento|transfer[êe]ncia|montante|valor pago|benefici[aá]rio|ordenante)\b"
PROPERTY_TERMS = r"(?iU)\b(?:caderneta|matriz|certid[aã]o|conservat[oó]ria|registo predial|CRP|artigo matricial|pr[eé]dio)\b"
LEASE_TERMS = r"(?iU)\b(?:contrato\s+de\s+arrendamento|arrendamento|senhorio|arrendat[aá]rio|renda|locador|locat[aá]rio)\b"
AMOUNT_CONTEXT = r"(?iU)\b(?:valor|montante|import[âa]ncia|total|pagamento|transfer[êe]ncia|renda|EUR|€)\b"
OWNER_ADDRESS = r"(?iU)\b(?:domicilio fiscal|domic[ií]lio fiscal|morada fiscal|resid[eê]ncia|sede)\b"
CLEAR_PAYMENT = r"(?iU)\b(?:comprovativo|pagamento|transfer[êe]ncia|valor pago|montante pago|benefici[aá]rio|ordenante)\b"
PARTY_TERMS = r"(?iU)\b(?:senhorio|arrendador|arrendat[aá]rio|inquilino|locador|locat[aá]rio)\b"
PROPERTY_CONTEXT = r"(?iU)\b(?:im[oó]vel|pr[eé]dio|fra[cç][aã]o|artigo|morada|localiza[cç][aã]o)\b"
BANK_NAMES = ["activo bank", "activobank", "banco bpi", "banco ctt", "banco montepio", "banco santander", "bankinter", "bbva", "bcp", "caixa geral de depositos", "credito agricola", "millennium", "novobanco", "santander"]
GENERIC_PROPERTIES = ["averbamento", "certificate", "certidao", "predial rustica", "rural property"]
FILE_LEASE_CODE = r"(?iU)(?:^|[_\-\s(\[])CA(?:V)?(?:$|[_\-\s)\].])"
FILE_CRP = r"(?U)(?:^|[_\-\s])crp(?:[_\-\s.]|$)"
FILE_BANK = ["iban", "nib", "bic", "swift"]
FILE_LEASE = ["contrato", "arrendamento", "aditamento", "ratificacao", "ratificação"]
FILE_PAYMENT = ["comprovativo", "transferencia", "transferência", "pagamento"]

#: Parts of a folded text (``text.folded``) one of which is there wherever the pattern of that name matches.
STEMS = {
    "iban": ["pt50"], "bic": ["pt"], "tax_id": ["nif", "nipc", "fiscal", "contribuinte"], "money": ["eur", "usd", "gbp", "€", "$", "£"],
    "article": ["art", "matriz"], "section": ["artigo", "matriz", "secc", "secao"], "freguesia": ["freguesia", "paroquia"], "concelho": ["concelho", "municipio"], "distrito": ["distrito"],
    "nib": ["nib"], "bank": ["iban", "nib", "bic", "swift", "banc"], "payment": ["comprovativo", "pagamento", "transfer", "montante", "valor pago", "benefici", "ordenante"],
    "property": ["caderneta", "matriz", "certid", "conservat", "registo predial", "crp", "artigo matricial", "predio"], "lease": ["arrenda", "senhorio", "renda", "locador", "locat"],
}

# --- fixed values: highlighting --------------------------------------------------------------------------------------
KEYWORDS = [
    "contrato", "arrendamento", "senhorio", "arrendatario", "arrendatário", "renda", "prazo", "predio", "prédio", "artigo", "seccao", "secção",
    "caderneta", "matriz", "freguesia", "concelho", "distrito", "certidao", "certidão", "conservatoria", "conservatória", "descricao", "descrição", "inscricao",
    "inscrição", "averbamento", "IBAN", "NIB", "SWIFT", "BIC", "titular", "conta", "banco", "pagamento", "transferencia", "transferência",
    "montante", "valor", "beneficiario", "beneficiário", "ordenante", "data", "proprietario", "proprietário", "propriedade", "imovel", "imóvel", "locador",
    "locatario", "locatário", "inquilino", "beneficiaria", "beneficiária", "euros", "artigo matricial", "valor patrimonial",
]


def _branched(words: list[str]) -> str:
    """Words, longer ones first, as alternatives by their first letters, so that few are tried at a character; it matches as they would one after the other."""
    heads = list(dict.fromkeys(w[:1] for w in words))
    if len(words) == 1:
        return words[0]
    return "(?:" + "|".join(h + _branched([w[1:] for w in words if w[:1] == h]) if h else "" for h in sorted(heads, key=lambda h: h == "")) + ")"


KEYWORD = "(?iU)" + _branched(sorted(KEYWORDS, key=lambda x: (-len(x), x)))
MONTH = r"(?iU)\b(?:janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|january|february|march|april|may|june|july|august|september|october|november|december)\b"
MONEY_MARK = MONEY[: -len(CURRENCY)] + r"(?:EUR|USD|GBP|€|\$|£|euros?)"
RECOVERY_KEYWORDS = ["senhorio", "arrendat", "outorgante", "renda", "artigo", "secção", "seccao", "assinado"]

# --- fixed values: recovery ------------------------------------------------------------------------------------------
GENERIC_PARTIES = ["SENHORIO", "SENHORIOS", "ARRENDATARIO", "ARRENDATARIA", "ARRENDATARIOS", "ARRENDATARIAS", "PRIMEIRO OUTORGANTE", "PRIMEIRA OUTORGANTE", "SEGUNDO OUTORGANTE", "SEGUNDA OUTORGANTE", "OUTORGANTE", "OUTORGANTES"]
KNOWN_LESSEES = {"GESTO ENERGIA": "GESTO ENERGIA, S.A.", "GESTAO ENERGIA": "GESTO ENERGIA, S.A.", "Q ENERGY": "Q ENERGY", "UTU ENERGIA": "UTU ENERGIA, S.A."}
RECOVERABLE = ["lessor", "lessee", "signed_date", "property_article", "property_section", "monthly_rent"]
SIGNED = [r"(?iU)(?:assinado|celebrado|outorgado)\s+(?:em|aos?)\s+.{0,40}?(\d{1,2}[/-]\d{1,2}[/-](?:19|20)\d{2})", r"(?U)\b((?:19|20)\d{2}-\d{2}-\d{2})\b"]
RECOVERED_ARTICLE = [r"(?iU)(?:artigo|matriz(?:\s+predial)?(?:\s+n[.ºo°]*)?)\s*[:#-]?\s*(\d{1,8})", r"(?iU)\b(?:art\.?|matriz)\s*(\d{1,8})\b"]
RECOVERED_SECTION = [r"(?iU)sec(?:cao|ção|c[.ªa])\s*[:#-]?\s*([A-Z]{1,3})\b"]
RENT = [r"(?iU)(?:renda\s+mensal|mensalmente)\D{0,40}?(\d{1,3}(?:[.\s]\d{3})*(?:,\d{2})?)\s*(€|EUR)", r"(?iU)(\d{1,3}(?:[.\s]\d{3})*(?:,\d{2})?)\s*(€|EUR)\s*(?:por\s+m[eê]s|mensais)"]
PARTY_LINE = r"(?iU)(?:senhorios?|locadores?|primeiros?\s+outorgantes?)\s*[:,-]?\s*([^\n.;]{5,180})"
PARTY_END = r"(?iU)\b(?:NIF|contribuinte|portador|residente|com sede|doravante)\b"
STEM_MARK = r"(?iU)(?:_CA(?:V|OPC)?_|_CAV_|CONTRATO[^_]*_)(.+)$"
STEM_END = r"(?iU)\b(?:IBAN|RATIFICACAO|RATIFICAÇÃO|RECTIFICADO|RECTIFICADA|ASSINADO|ASSINADA)\b.*$"

# --- fixed values: validation, score and priority --------------------------------------------------------------------
GENERIC_NAMES = ["SENHORIO", "SENHORIOS", "ARRENDATARIO", "ARRENDATARIA", "ARRENDATARIOS", "ARRENDATARIAS", "PROPRIETARIO", "PROPRIETARIA", "TITULAR", "TITULARES", "BENEFICIARIO", "BENEFICIARIA", "PRIMEIRO OUTORGANTE", "SEGUNDO OUTORGANTE", "OUTORGANTE", "OUTORGANTES"]
NAMED_FIELDS = ["lessor", "lessee", "owner_name", "bank_account_holder", "payer", "payee"]
DATE_FIELDS = ["signed_date", "document_date", "contract_start_date", "contract_end_date", "payment_date"]
YEAR = r"(?U)(?<!\d)((?:19|20)\d{2})(?!\d)"
RENT_FORMAT = r"(?iU)^(?:EUR\s*)?(?:\d{1,3}(?:[.\s]\d{3})*|\d+)(?:,\d{1,2})?\s*(?:EUR|€)?$"
PENALTIES = {
    "missing_lessor": 25, "missing_lessee": 25, "missing_signed_date": 20, "missing_monthly_rent": 15, "missing_property_article": 15,
    "missing_property_section": 10, "missing_owner_name": 15, "missing_iban": 25, "missing_bank_account_holder": 20, "missing_payment_date": 15,
    "missing_payer": 15, "missing_payee": 15, "missing_payment_amount": 20, "future_date": 20, "generic_name": 20, "low_confidence": 10,
    "invalid_confidence": 5, "invalid_property_section": 10, "invalid_property_article": 15, "invalid_iban": 25, "invalid_nif": 20,
    "invalid_or_multiple_owner_tax_id": 15, "invalid_monthly_rent": 15, "suspicious_lessee": 15, "unknown_validation_issue": 5,
}
PENALTY_FAMILIES = {"future_date_": "future_date", "generic_": "generic_name", "invalid_iban_": "invalid_iban", "invalid_owner_tax_id_": "invalid_nif", "invalid_monthly_rent_": "invalid_monthly_rent"}
UNKNOWN_PENALTY = PENALTIES["unknown_validation_issue"]
BANDS = [(90, "EXCELLENT"), (80, "GOOD"), (60, "ATTENTION"), (40, "REVIEW_REQUIRED"), (0, "CRITICAL")]
HIGH = ["missing_lessor", "missing_lessee", "missing_iban", "missing_bank_account_holder"]
HIGH_PREFIXES = ["invalid_iban_", "generic_lessor", "generic_lessee"]
MEDIUM = ["missing_signed_date", "missing_monthly_rent", "missing_property_article", "missing_property_section", "missing_owner_name", "invalid_property_section", "invalid_or_multiple_owner_tax_id", "low_confidence"]
MEDIUM_PREFIXES = ["future_date_", "invalid_owner_tax_id_", "invalid_monthly_rent_"]
TRUE_WORDS = ["yes", "true", "1", "sim"]

# --- fixed values: notes ---------------------------------------------------------------------------------------------
SHORT_TEXT_NOTE = "Pouco texto extraido do PDF. Pode ser necessario OCR ou revisao manual."
TIMEOUT_NOTE = "Timeout na {step} do Ollama local; resultado baseado apenas em regras deterministicas."
FAILURE_NOTE = "Falha na {step} do Ollama local; resultado baseado apenas em regras deterministicas: "
SECOND_TIMEOUT_NOTE = "Timeout na segunda avaliacao do Ollama local: "
SECOND_FAILURE_NOTE = "Falha na segunda avaliacao do Ollama local: "
ERROR_REASON = "Erro durante processamento automatico."
OCR_OFF_NOTE = "OCR novo desativado, nenhum OCR reutilizavel foi encontrado e o texto nativo do PDF parece insuficiente."
OCR_NO_BETTER_NOTE = "OCR existente encontrado, mas nao melhorou a quantidade de texto extraido."
OCR_REUSED_NOTE = "OCR existente reutilizado; OCRmyPDF nao foi executado."
OCR_UNREAD_NOTE = "OCR executado, mas o arquivo gerado nao produziu texto reutilizavel."
OCR_USED_NOTE = "OCR executado e texto OCR utilizado."
OCR_FAILED_NOTE = "OCR indisponivel; processamento continuou com o texto nativo. Detalhe: {why}"
OCR_TIMEOUT_NOTE = "OCR excedeu {seconds} segundos; processamento continuou com o texto nativo."
OCR_BLOCKED_NOTE = "OCR bloqueado pela seguranca do Windows ({why}); processamento continuou com o texto nativo."
RECOVERY_NOTE = "Sprint 1B recovered: "
EXCERPTS = ["DOCUMENT BEGINNING - title, parties and initial property description", "KEYWORD-BASED RELEVANT EXCERPTS", "DOCUMENT END - signatures, dates and final clauses"]

#: What a model is told to look for in a document of each category, and what not to take for it.
GUIDANCE = {
    "lease_contract": "A lease, its amendment, renewal or end. The signing date is the day on which the parties sign, not the day from which it counts. Names stand alone, without numbers, addresses or marital status; several lessors are joined by semicolons in lessor. Rent counts only if it is said to be monthly. The property is the one that is let, not a party's address. Bank fields only from payment instructions.",
    "property_document": "A land register or tax record of a property. Article, section, parish, municipality, district, place and owners matter most. There is a lessor or lessee only where a lease is spoken of.",
    "bank_details": "Data of a bank account: numbers, bank, holder. It proves no payment unless a completed one is told with date, payer, payee and amount.",
    "payment_proof": "Proof that a payment was made. The amount stands with a currency or a word for an amount; account numbers and references are no amounts.",
    "invoice_or_receipt": "An invoice or receipt: its date, parties, total and what it is for. Payment fields only where a bank transfer is proven.",
    "identity_document": "Who a person or company is, as far as the document says so itself.",
    "tax_document": "A tax office's paper: taxpayers, their numbers, and amounts that are stated.",
    "correspondence": "A letter or message: who writes to whom, if that helps, and a short summary.",
    "other": "None of the other categories fits safely. Leave a field empty rather than guess.",
}
