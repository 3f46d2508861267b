"""Product and invoice codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.numbers import _let


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def is_article_code(c: Column) -> Column:
    """PF and 5 to 14 letters or digits."""
    return F.coalesce(F.regexp_like(upper_trim(c), F.lit("^PF[A-Z0-9]{5,14}$")), F.lit(False))


def is_local_code(c: Column) -> Column:
    """5 to 8 digits."""
    return F.coalesce(F.regexp_like(F.trim(c), F.lit(r"^\d{5,8}$")), F.lit(False))


def normalized_code(c: Column) -> Column:
    """Letters and digits, upper case; FF reads PF; after PF the letters O I S B read 0 1 5 8."""
    t = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    t = F.regexp_replace(t, "^FF", "PF")
    return _let(t, lambda t: F.when(F.startswith(t, F.lit("PF")), F.concat(F.lit("PF"), F.translate(F.substr(t, F.lit(3)), "OISB", "0158"))).otherwise(t))


def product_code(c: Column) -> Column:
    """PF codes cut to 11; digits padded to 6; more than 7 digits cut to 6."""

    def cut(t: Column) -> Column:
        digits = _let(F.regexp_replace(t, r"\D", ""), lambda d: F.when(F.length(d) == 5, F.lpad(d, 6, "0")).when(F.length(d) > 7, F.left(d, F.lit(6))).when(F.length(d) > 0, d).otherwise(t))
        return F.when(F.startswith(t, F.lit("PF")), F.left(t, F.lit(11))).otherwise(digits)

    return _let(normalized_code(c), cut)


def code_variants(*codes: Column) -> Column:
    """Raw and normalised forms under which a row can be found, without blanks or repeats."""
    every = [f(c) for c in codes for f in (upper_trim, normalized_code)]
    return F.array_distinct(F.filter(F.array(*every), lambda v: v != ""))


def resolved(code: Column, code_pct: Column, code_article: Column) -> Column:
    """struct(primary, mp, article) of the three code fields."""
    own = F.struct(upper_trim(code).alias("code"), upper_trim(code_pct).alias("pct"), upper_trim(code_article).alias("art"))

    def picked(t: Column) -> Column:
        code, pct, art = t["code"], t["pct"], t["art"]
        article = F.when(~is_article_code(art) & is_article_code(code), code).otherwise(art)
        local = F.when(is_local_code(pct), pct)
        # without a code the article is what its own field says, and only the local field is left for the third
        primary = F.coalesce(F.nullif(code, F.lit("")), F.nullif(art, F.lit("")), local, F.lit(""))
        return F.struct(primary.alias("primary"), F.coalesce(local, F.when(is_local_code(code), code), F.lit("")).alias("mp"), article.alias("article"))

    return _let(own, picked)


#: Fixed value: how the reference tables compare texts, without regard to case and accents.
COLLATION = "UNICODE_CI_AI"


def collated(c: Column | str) -> Column:
    """Q5: a text that joins, groups and compares as the reference tables do; it keeps its spelling."""
    return F.collate(c, COLLATION)


def invoice_key(number: Column, fallback: Column | None = None) -> Column:
    """``OCR-`` and the first 12 digits; without digits 1, or ``fallback`` if given."""
    digits = F.nullif(F.regexp_replace(number, r"\D", ""), F.lit(""))
    return F.concat(F.lit("OCR-"), F.left(F.coalesce(digits, fallback if fallback is not None else F.lit("1")), F.lit(12)))


def supplier_name(c: Column) -> Column:
    """Upper-case letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z0-9\s]", " "), r"\s+", " "))


def tax_id(raw: Column) -> Column:
    """``1234567A/P/M/000`` of a noisy tax id; null when it has not that shape."""
    t = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^A-Za-z0-9]", ""))
    shape = "^([0-9]{6,8})([A-Z])([A-Z])([A-Z])([0-9]{3})$"
    pick = F.when(F.regexp_like(t, F.lit(shape)), t).otherwise(F.translate(t, "OIL", "011"))
    return F.when(F.regexp_like(pick, F.lit(shape)), F.regexp_replace(pick, shape, "$1$2/$3/$4/$5"))


def merge_key(code: Column, pct: Column, article: Column, amount: Column, designation: Column, raw: Column) -> Column:
    """Identity of a line when tables and text are merged; amount is a double."""
    pct0, art0, co = upper_trim(pct), upper_trim(article), upper_trim(code)
    free = (pct0 == "") & (co != "")
    digits = free & F.regexp_like(co, F.lit(r"^\d{4,8}$"))
    named = free & ~digits & F.regexp_like(co, F.lit(r"^(PF|[A-Z]{2,4}\d{5,12}$)"))
    return F.struct(
        F.when(digits, co).otherwise(pct0).alias("pct"),
        F.when(named & (art0 == ""), co).otherwise(art0).alias("article"),
        F.when(amount.isNotNull(), F.format_string("%.4f", amount)).otherwise("").alias("amount"),
        F.left(F.trim(F.coalesce(designation, F.lit(""))), F.lit(120)).alias("designation"),
        F.left(F.trim(F.coalesce(raw, F.lit(""))), F.lit(140)).alias("raw"),
    )
