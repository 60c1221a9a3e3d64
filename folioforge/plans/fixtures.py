"""Documents and records made from the star schema, by SQL that Spark and DuckDB both read.

``{orders}``, ``{customer}`` and ``{documents}`` stand for the tables. Which fields are blank, generic or wrong goes by
the key, so every rule meets good and bad rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DAY = "lpad(cast(1 + o_orderkey % 28 AS string), 2, '0')"
_MONTH = "lpad(cast(1 + o_orderkey % 12 AS string), 2, '0')"
_YEAR = "cast(1995 + o_orderkey % 37 AS string)"
_NAME = "CASE o_orderkey % 4 WHEN 0 THEN 'Ana Maria Silva e Rui Costa Lima' WHEN 1 THEN 'Pedro Santos Nunes' WHEN 2 THEN 'Carla Dias Moura; Luis Faria' ELSE 'Teresa Alves Brito' END"
#: A 19-digit number and its two check digits, as bank numbers have them.
_BASE = "(1000000 + c_custkey * 7919)"
_NIB = f"lpad(cast({_BASE} AS string), 19, '0') || lpad(cast(98 - ({_BASE} * 100) % 97 AS string), 2, '0')"
_NIF8 = "cast(20000000 + c_custkey * 37 AS string)"
_NIF_SUM = " + ".join(f"cast(substr({_NIF8}, {i + 1}, 1) AS int) * {9 - i}" for i in range(8))
_NIF = f"{_NIF8} || CASE WHEN 11 - ({_NIF_SUM}) % 11 >= 10 THEN '0' ELSE cast(11 - ({_NIF_SUM}) % 11 AS string) END"

#: Lease contracts with a file name, a text and a record that lacks some of what the text says.
LEASES = f"""
SELECT o_orderkey AS id, cast(o_custkey AS string) AS customer,
  'PR' || cast(o_orderkey % 1000 AS string) || CASE WHEN o_orderkey % 5 = 4 THEN '_XX_' ELSE '_CA_' END || replace({_NAME}, '; ', ' & ') || '_SP' || cast(o_custkey AS string) || '.pdf' AS file_name,
  'CONTRATO DE ARRENDAMENTO' || chr(10) || 'Senhorios: ' || {_NAME} || ', NIF 123456789' || chr(10)
    || CASE o_orderkey % 4 WHEN 0 THEN 'Arrendataria GESTO ENERGIA, S.A.' WHEN 1 THEN 'Arrendataria Q Energy Portugal' WHEN 2 THEN 'entre UTU Energia e outros' ELSE 'Arrendataria desconhecida' END || chr(10)
    || 'Predio rustico inscrito na matriz sob o artigo ' || cast(1 + o_orderkey % 900 AS string) || ', seccao ' || substr('ABCDEFGHIJ', cast(1 + o_orderkey % 10 AS int), 1) || chr(10)
    || 'Freguesia: Vila Nova' || chr(10) || 'Concelho: Mogadouro' || chr(10) || 'renda mensal de ' || cast(100 + o_orderkey % 800 AS string) || ',00 EUR por transferencia' || chr(10)
    || 'Assinado em Lisboa a {{day}}' AS text_template,
  'lease_contract' AS document_category,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Senhorio' WHEN 2 THEN 'Carla Dias Moura' ELSE 'Outorgantes' END AS lessor,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Arrendatario' ELSE 'ABC' END AS lessee,
  CASE o_orderkey % 3 WHEN 0 THEN '' ELSE {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} END AS signed_date,
  CASE o_orderkey % 6 WHEN 0 THEN '' ELSE cast(o_orderkey % 900 AS string) END AS property_article,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'B' WHEN 2 THEN 'ABCD' ELSE 'c' END AS property_section,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '500,00 EUR' WHEN 2 THEN '500.00' WHEN 3 THEN '0,00' ELSE '1.250,50' END AS monthly_rent,
  CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'sure' ELSE '' END AS confidence,
  CASE o_orderkey % 7 WHEN 0 THEN 'to be checked; low_confidence, see file' ELSE '' END AS review_reason,
  CASE o_orderkey % 11 WHEN 0 THEN 'error' ELSE '' END AS processing_status,
  {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} AS signed_text
FROM {{orders}}""".replace("'Assinado em Lisboa a {day}' AS text_template", "'Assinado em Lisboa a ' || {0} || '/' || {1} || '/2021' AS text").replace("{0}", _DAY).replace("{1}", _MONTH)

#: Bank letters with account and tax numbers, some of which fail their checks.
LETTERS = f"""
SELECT id, name, nib, nif, CASE id % 6 WHEN 0 THEN 'dados_IBAN_' WHEN 1 THEN 'CadernetaPredial ' WHEN 2 THEN 'x_crp_' WHEN 3 THEN 'Contrato ' WHEN 4 THEN 'comprovativo ' ELSE 'carta ' END || cast(id AS string) || '.pdf' AS file_name,
  'Titular: ' || name || chr(10) || 'IBAN PT50 ' || substr(iban_digits, 1, 4) || ' ' || substr(iban_digits, 5, 4) || ' ' || substr(iban_digits, 9, 13) || chr(10)
    || CASE id % 3 WHEN 0 THEN 'NIB ' || nib || chr(10) ELSE '' END || 'contribuinte n. ' || given_nif || chr(10) || 'BIC BCOMPTPL' || chr(10)
    || CASE id % 2 WHEN 0 THEN 'comprovativo de pagamento de 1.234,56 EUR em 12/03/2024' ELSE 'valor 99,90 EUR' END || chr(10) || CASE id % 4 WHEN 0 THEN 'artigo 140, seccao J' WHEN 1 THEN 'Artigo matricial n. 77' ELSE 'sem mais' END || chr(10)
    || CASE id % 3 WHEN 0 THEN 'Distrito: Braganca' WHEN 1 THEN 'distrito' || chr(10) || '04 - VILA REAL' ELSE 'nada' END AS text,
  'PT50' || iban_digits AS iban, 'bank_details' AS document_category, given_nif AS owner_tax_id
FROM (SELECT c_custkey AS id, c_name AS name, {_NIB} AS nib, {_NIF} AS nif,
  CASE WHEN c_custkey % 5 = 0 THEN '0' || substr({_NIB}, 2, 19) || '7' ELSE {_NIB} END AS iban_digits,
  CASE WHEN c_custkey % 7 = 0 THEN '123456780' ELSE {_NIF} END AS given_nif FROM {{customer}}) AS c"""

#: Payments for the normalising rules.
PAYMENTS = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 8 WHEN 0 THEN '2021-3-7' WHEN 1 THEN '7/3/2021' WHEN 2 THEN '07-03-2021' WHEN 3 THEN '7.3.2021' WHEN 4 THEN '7/3/71' WHEN 5 THEN '7-3-21' WHEN 6 THEN '31/02/2021' ELSE 'March' END AS payment_date,
  CASE o_orderkey % 6 WHEN 0 THEN '1.234,56 EUR' WHEN 1 THEN '99,90' WHEN 2 THEN '500.00' WHEN 3 THEN '1.234' WHEN 4 THEN 'PT50000201231234567890154' ELSE '' END AS payment_amount,
  CASE o_orderkey % 5 WHEN 0 THEN 'euros' WHEN 1 THEN '$' WHEN 2 THEN 'Pounds' WHEN 3 THEN '' ELSE 'CHF' END AS currency,
  CASE o_orderkey % 4 WHEN 0 THEN 'Banco BPI Lisboa' WHEN 1 THEN 'Averbamento' WHEN 2 THEN 'Monte Alto' ELSE '' END AS property_name,
  CASE o_orderkey % 3 WHEN 0 THEN cast(o_orderkey AS string) ELSE '' END AS property_article,
  CASE o_orderkey % 2 WHEN 0 THEN 'B' ELSE '' END AS property_section
FROM {orders}"""

#: Document texts with a line of noise and pages marked in every third.
NOISY = """
SELECT doc_id AS id, source || cast(doc_id AS string) AS file_name, CASE WHEN doc_id % 3 = 0 THEN '[Page 1] ' ELSE '' END || coalesce(text, '') || chr(10) || '#* #* #* #* #* #* #* #* #* #*' || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '[Page 2] o contrato de arrendamento tem o valor de 500,00 EUR' || chr(10) || '[Page 3] ' ELSE '' END || 'pagamento em 12/03/2024 de 1.234,56 EUR por transferencia em janeiro' AS text
FROM {documents}"""

TABLES = {"LEASES": ["orders"], "LETTERS": ["customer"], "PAYMENTS": ["orders"], "NOISY": ["documents"]}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id"}
#: Tasks for each core among which a table's rows are dealt.
TASKS = 4


def spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's rows dealt to all cores by their key. A file has as few tasks as it has row groups, and a row costs much more to work on than to send."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(TASKS * spark.sparkContext.defaultParallelism, KEYS[table])


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    return spark.sql(globals()[name], **{t: spread(spark, sf_dir, t) for t in TABLES[name]})


def as_sql(name: str) -> str:
    """A fixture as a subquery."""
    out = globals()[name]
    for t in TABLES[name]:
        out = out.replace("{" + t + "}", t)
    return f"({out})"
