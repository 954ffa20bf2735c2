"""Dictionaries of spoken forms: the spans that a rule finds in texts made of the tables' numbers and dates, each with its
spoken form made once. SQL says the same from the numbers themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators import rewrite as R
from corpusloom.operators import spoken_tables as S
from corpusloom.plans.base import table

RULES = {r.name: r for r in R.rules()}
BASE = """SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 26 AS h, o_orderkey % 62 AS mi,
    l_partkey % 2000 AS a, l_suppkey % 1000 AS b, l_linenumber AS c, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def two(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


def three(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 3, '0')"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def words(n: str, groups: int = 4) -> str:
    """A whole number in words, as SQL."""
    said = []
    for i in range(groups - 1, -1, -1):
        t = f"(({n}) // {1000**i} % 1000)"
        one = f"CASE WHEN {t} % 10 = 1 THEN '' ELSE {_list(S.ONES)}[{t} % 10 + 1] END" if i == 1 else f"{_list(S.ONES)}[{t} % 10 + 1]"
        parts = f"[CASE WHEN {t} // 100 > 1 THEN {_list(S.ONES)}[{t} // 100 + 1] ELSE '' END, CASE WHEN {t} > 99 THEN '{S.HUNDRED}' ELSE '' END, {_list(S.TENS)}[{t} // 10 % 10 + 1], {one}, '{S.SCALES[i]}']"
        said.append(f"CASE WHEN {t} = 0 THEN '' ELSE array_to_string(list_filter({parts}, lambda x: x <> ''), ' ') END")
    return f"CASE WHEN ({n}) = 0 THEN '{S.ZERO}' ELSE array_to_string(list_filter([{', '.join(said)}], lambda x: x <> ''), ' ') END"


V = "aeəıioöuü"
_LAST = "regexp_extract({0}, '([" + V + "])[^" + V + "]*$', 1)"


def ordinal(w: str) -> str:
    """The ordinal of number words, as SQL."""
    last = _LAST.format(w)
    end = "CASE " + last + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ORDINAL.items()) + " END"
    return f"({w} || CASE WHEN right({w}, 1) = {last} THEN {end} ELSE substr({end}, 3, 1) || {end} END)"


def harmonised_da(w: str) -> str:
    return f"({w} || CASE WHEN {_LAST.format(w)} IN ('a', 'ı', 'o', 'u') THEN 'da' ELSE 'də' END)"


def zeros(x: str, w: str, width: int) -> str:
    """A number written with leading zeros, with each of them said."""
    lead = f"CASE WHEN {x} = 0 THEN {width} ELSE {width} - length(CAST({x} AS VARCHAR)) END"
    return f"array_to_string(list_filter([rtrim(repeat('{S.ZERO} ', {lead}), ' '), CASE WHEN {x} > 0 THEN {w} ELSE '' END], lambda z: z <> ''), ' ')"


MONTH = f"{_list(S.MONTHS)}[m]"
DATE = f"w0 || ' ' || {MONTH} || ' ' || {ordinal('w1')} || ' {S.YEAR}'"
#: name: rule, span of the base's columns (for both engines), numbers w0, w1, ... that SQL says, and the spoken form of them.
SPOKEN = {
    "tx4_phone_spoken": ("phone", f"'0' || {two('a % 100')} || ' ' || {three('b')} || '-' || {two('q')} || '-' || {two('mi')}", ("a % 100", "b", "q", "mi"), f"{zeros('a % 100', 'w0', 3)} || ' ' || {zeros('b', 'w1', 3)} || ' ' || {zeros('q', 'w2', 2)} || ' ' || {zeros('mi', 'w3', 2)}"),
    "tx6_date_iso_spoken": ("date_iso", f"{text('y')} || '-' || {two('m')} || '-' || {two('d')}", ("d", "y"), DATE),
    "tx6_date_dmy_spoken": ("date_dmy", f"{text('d')} || '.' || {two('m')} || '.' || {text('y')}", ("d", "y"), DATE),
    "tx6_date_dm_spoken": ("date_dm", f"{text('d')} || '/0' || {text('m % 9 + 1')}", ("d",), f"w0 || ' ' || {_list(S.MONTHS)}[m % 9 + 1]"),
    "tx7_dotted_spoken": ("dotted", f"{text('a')} || '.' || {text('c')} || '.' || {text('q')}", ("a", "c", "q"), f"w0 || ' {S.DOT} ' || w1 || ' {S.DOT} ' || w2"),
    "tx8_time_spoken": ("time", f"{text('h')} || ':' || {two('mi')}", ("h", "mi"), f"CASE WHEN mi > 59 OR h > 24 OR (h = 24 AND mi > 0) THEN span WHEN mi = 0 AND h = 0 THEN '{S.ZERO} {S.ZERO}' WHEN mi = 0 THEN w0 WHEN mi < 10 THEN w0 || ' {S.ZERO} ' || w1 ELSE w0 || ' ' || w1 END"),
    "tx10_currency_spoken": ("currency", f"{text('b')} || ',' || {two('n % 100')} || ' USD'", (), "CASE WHEN n % 100 = 0 THEN b || ' dollar' WHEN b = 0 THEN (n % 100) || ' sent' ELSE b || ' dollar ' || (n % 100) || ' sent' END"),
    "tx11_percent_spoken": ("percent", f"{text('a')} || '%'", (), f"a || ' {S.PERCENT}'"),
    "tx14_fraction_spoken": ("fraction", f"{text('a')} || '/' || {text('b')}", ("a", "b"), f"CASE WHEN a > 0 AND a < b THEN {harmonised_da('w1')} || ' ' || w0 ELSE w0 || ' {S.DIVIDED} ' || w1 END"),
    "tx15_range_spoken": ("range", f"{text('a')} || '-' || {text('b')}", ("a", "b"), f"w0 || ' {S.TO} ' || w1"),
    "tx16_suffixed_spoken": ("suffixed", f"{text('a')} || '-ci'", ("a",), ordinal("w0")),
    "tx17_decimal_spoken": ("number", f"{text('a')} || ',' || {text('q')}", ("a", "q"), f"w0 || ' {S.WHOLE} ' || CASE WHEN q < 10 THEN '{S.PLACES[0]}' ELSE '{S.PLACES[1]}' END || ' ' || w1"),
    "tx17_number_spoken": ("number", text("n"), ("n",), "w0"),
}


def base(spark, sf):
    for name in ("lineitem", "orders"):
        table(spark, sf, name).createOrReplaceTempView(f"corpusloom_{name}")
    return spark.sql(BASE.replace("FROM lineitem JOIN orders", "FROM corpusloom_lineitem JOIN corpusloom_orders"))


def _register():
    for name, (rule, span, numbers, spoken) in SPOKEN.items():
        said = "".join(f", {words(x)} AS w{i}" for i, x in enumerate(numbers))
        sql = f"WITH base AS ({BASE}), s AS (SELECT DISTINCT ON (span) *, {span} AS span FROM base), w AS (SELECT *{said} FROM s) SELECT span, {spoken} AS spoken FROM w"

        def run(spark, sf, rule=RULES[rule], span=span):
            texts = base(spark, sf).select(F.concat(F.lit("a "), F.expr(span), F.lit(" b")).alias("text")).distinct()
            return R.dictionary(R.spans(texts, rule, "text"), rule)

        query(name, sql)(run)


_register()
NUMBERS = "SELECT DISTINCT CAST(round(l_extendedprice * 100) AS BIGINT) * (l_linenumber * l_linenumber * 1000 + l_partkey % 7) AS n FROM lineitem"


@query("tx20_words_spoken", f"WITH w AS (SELECT n, {words('n', 5)} AS words FROM ({NUMBERS})) SELECT n, words, {ordinal('words')} AS ordinal FROM w")
def tx20_words_spoken(spark, sf):
    """Numbers up to billions, cardinal and ordinal."""
    base(spark, sf)
    said = R.whole_words(F.col("n").cast("string"))
    return spark.sql(NUMBERS.replace("FROM lineitem", "FROM corpusloom_lineitem")).select("n", said.alias("words"), R.ordinal_form(said).alias("ordinal"))


@query("tx5_grouped_spoken", f"SELECT DISTINCT replace(format('{{:,}}', n), ',', ' ') AS span, CAST(n AS VARCHAR) AS joined FROM ({NUMBERS})")
def tx5_grouped_spoken(spark, sf):
    """Numbers whose groups of three stand apart."""
    base(spark, sf)
    span = F.replace(F.format_number("n", 0), F.lit(","), F.lit(" "))
    out = spark.sql(NUMBERS.replace("FROM lineitem", "FROM corpusloom_lineitem")).select(span.alias("span")).distinct()
    return out.select("span", R.thousands("span").alias("joined"))


def roman(n: int) -> str:
    out = ""
    for value, letters in ((50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + letters, n - value
    return out


ROMANS = _list(roman(i) for i in range(1, 51))
SPELLED = "array_to_string(list_transform(string_split(lower(replace(span, 'I', 'ı')), ''), lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LETTER_NAMES.items()) + " ELSE x END), ' ')"


@query("tx13_roman_spoken", f"WITH q AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_quantity BETWEEN 1 AND 50), s AS (SELECT {ROMANS}[q] AS span, {words('q', 1)} AS w FROM q) SELECT span, {ordinal('w')} AS spoken FROM s WHERE length(span) > 1")
def tx13_roman_spoken(spark, sf):
    """Quantities as Roman numerals; lone letters are left to rules that look at what follows."""
    numeral = F.element_at(F.array(*(F.lit(roman(i)) for i in range(1, 51))), F.col("l_quantity").cast("int"))
    texts = table(spark, sf, "lineitem").where("l_quantity BETWEEN 1 AND 50").select(F.concat(F.lit("a "), numeral, F.lit(" b")).alias("text")).distinct()
    return R.dictionary(R.spans(texts, RULES["roman"], "text"), RULES["roman"])


@query("tx12_unit_spoken", "WITH u AS (SELECT * FROM (VALUES ('kq', 'kiloqram'), ('km/saat', 'kilometr saatda'), ('°C', 'dərəcə selsi')) t(u, said)) SELECT DISTINCT CAST(CAST(l_quantity AS BIGINT) % 10 AS VARCHAR) || ' ' || u AS span, CAST(CAST(l_quantity AS BIGINT) % 10 AS VARCHAR) || ' ' || said AS spoken FROM lineitem, u")
def tx12_unit_spoken(spark, sf):
    """Quantities with units; the rule's span begins at the last digit."""
    number = F.col("l_quantity").cast("long").cast("string")
    texts = table(spark, sf, "lineitem").select(F.explode(F.array(*(F.concat(F.lit("a "), number, F.lit(f" {u} b")) for u in ("kq", "km/saat", "°C")))).alias("text")).distinct()
    return R.dictionary(R.spans(texts, RULES["unit"], "text"), RULES["unit"])


@query("tx18_acronym_spoken", f"WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(upper(p_name), '[A-Z]+')) AS span FROM part) SELECT span, {SPELLED} AS spoken FROM s WHERE length(span) BETWEEN 2 AND 5")
def tx18_acronym_spoken(spark, sf):
    """The words of part names in capitals, spelled."""
    texts = table(spark, sf, "part").select(F.concat(F.lit("a "), F.upper("p_name"), F.lit(" b")).alias("text")).distinct()
    return R.dictionary(R.spans(texts, RULES["acronym"], "text"), RULES["acronym"])
