"""Personal data: patterns propose spans, checksums confirm them, words before them adjust their score. DataFrame functions only.

Spark SQL has no function for the place of every match, so the text is also split at the matches: a match ends where the
lengths of all pieces and matches up to it add up. Patterns are written with possessive groups and look-behinds that leave
their matches as they are and keep the matcher linear and free of recursion on very long runs. An account number (iban)
has the length of its country, so it ends where it should whatever follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fenced, query, shielded

#: Characters before a span, back to the span before it of its kind, in which context words count.
REACH = 48
#: Spans of the added kinds need this score; the four base kinds are always kept.
LEAST_SCORE = 0.5
CONTEXT_SCORE = 0.35

# kind: (pattern, score without context, words that raise it)
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# a maximal chain of digits with single separators, of 13 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Length of an account number by its country, of the registry and of the countries that use the form without it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{of.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, of in IBAN_LENGTHS.items())
# the country fixes the length, so no word after the number is taken
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS})(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BASE = {
    "email": (EMAIL, 0.9, "e-?mail|mail|contact|write to"),
    "ip": (IP, 0.6, r"\bip\b|address|host|server|login"),
    "card": (CARD, 0.8, "card|visa|master|credit|debit|payment|pay"),
    "phone": (PHONE, 0.6, "phone|tel|call|mobile|fax|contact"),
}
ADDED = {
    "iban": (IBAN, 0.6, r"iban|account|bank|transfer|konto|compte|cuenta"),
    "ssn": (SSN, 0.3, r"ssn|social|security|tax|insurance"),
}


def running_total(steps: Column) -> Column:
    """Cumulative sums of an array of longs, in blocks of about the square root of its size."""
    none = F.expr("array()").cast("array<bigint>")
    size = F.size(steps)
    block = F.ceil(F.sqrt(size.cast("double"))).cast("int")
    sums = lambda x: F.aggregate(x, none, lambda a, y: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + y)))
    inner = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")), lambda b: sums(F.slice(steps, b * block + 1, block)))
    before = sums(F.concat(F.array(F.lit(0).cast("long")), F.transform(inner, lambda x: F.try_element_at(x, F.lit(-1)))))
    return F.when(size > 0, F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda x, o: F.transform(x, lambda y: y + o)))).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    each = F.filter(F.split(F.reverse(_digits(match)), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(match: Column) -> Column:
    plain = F.regexp_replace(match, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    each = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(x, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, score: float, context: str) -> Column:
    """Array of (start, end, score) of the valid matches, by start; code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)
    ends = running_total(F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: (F.length(m) + F.length(p)).cast("long")))
    raised = lambda p: F.when(F.lower(F.substring(p, -REACH, REACH)).rlike(context), CONTEXT_SCORE).otherwise(0.0)
    every = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p"), ends.alias("e")),
        lambda x: F.struct(
            (x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), F.least(F.lit(1.0), F.lit(score) + raised(x["p"])).alias("score"), _valid(kind, x["m"]).alias("valid")
        ),
    )
    return F.filter(every, lambda x: x["valid"])


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


@shielded
def personal_data(docs: DataFrame) -> DataFrame:
    """`docs` with n_email, n_ip, n_card, n_phone, n_iban, n_ssn (long), base_sha256, spans and n_likely added.

    spans: kind:start:end of every span, by kind in that order, then start; n_likely: those with a score of
    `LEAST_SCORE` or more. base_sha256 is the digest of the first four kinds' part of spans. A null or empty text has no
    spans. Columns of the input with these names are replaced. All is computed within the row: no shuffle.
    """
    out = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    kinds = {**BASE, **ADDED}
    screens = {"email": "@", "ip": r"[0-9]\.[0-9]", "phone": r"\+[0-9]"}
    none = F.expr("array()").cast("array<struct<start:bigint,end:bigint,score:double,valid:boolean>>")
    for kind, (pattern, score, context) in kinds.items():
        hit = F.col("_text").contains("@") if kind == "email" else F.col("_text").rlike(screens.get(kind, pattern))
        out = out.withColumn(f"_{kind}", F.when(hit, _spans(F.col("_text"), kind, pattern, score, context)).otherwise(none))
    for kind in ADDED:
        out = out.withColumn(f"_{kind}", F.filter(f"_{kind}", lambda x: x["score"] >= LEAST_SCORE))
    out = out.withColumns({f"n_{kind}": F.size(f"_{kind}").cast("long") for kind in kinds})
    base = F.array_join(F.flatten(F.array(*(_named(k, F.col(f"_{k}")) for k in BASE))), ",")
    spans = F.array_join(F.flatten(F.array(*(_named(k, F.col(f"_{k}")) for k in kinds))), ",")
    likely = F.size(F.filter(F.flatten(F.array(*(F.col(f"_{k}") for k in kinds))), lambda x: x["score"] >= LEAST_SCORE)).cast("long")
    out = out.withColumn("base_sha256", F.sha2(base.cast("binary"), 256)).withColumn("spans", spans).withColumn("n_likely", likely)
    return fenced(out.drop("_text", *(f"_{k}" for k in kinds)))


@query("op5_personal_data")
def op5(spark, folder):
    found = personal_data(documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_iban", "n_ssn", "n_likely", "base_sha256", "spans")
