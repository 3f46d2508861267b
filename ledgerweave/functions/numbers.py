"""Money and quantity expressions: text in, double or decimal out, null when it is not a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for an absent price.
ABSENT = ("—", "-", "ND")
#: Fixed value: what Unicode counts as white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TWO_DIGIT_TAIL = r"^\d+[.]\d+$"


def blank_to_null(c: Column) -> Column:
    """Trims every kind of white space; nothing left is null."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and gives it to ``body``; written out, a rule would repeat all that it is made of."""
    return F.transform(F.array(value), body)[0]


def _plain_number(text: Column) -> Column:
    """Blanks dropped, comma as point, all points but the last dropped; null unless a number."""

    def read(t: Column) -> Column:
        several = F.position(F.lit("."), t, F.instr(t, ".") + 1) > 0
        return F.when(several, F.regexp_replace(t, r"\.(?=.*\.)", "")).otherwise(t).try_cast("double")

    return _let(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), read)


def price_of_text(c: Column) -> Column:
    """Price of a text: within (0, 99999], else null (M1)."""
    v = _let(blank_to_null(c), lambda t: F.when(~t.isin(*ABSENT), _plain_number(t)))
    return _let(v, lambda v: F.when((v > 0) & (v <= 99999), v))


def price_of_number(c: Column) -> Column:
    """A numeric price only has to be positive."""
    return F.when(c > 0, c.cast("double"))


def quantity_of_text(c: Column) -> Column:
    """Quantity of a text, 0 when it is none (M2)."""
    return F.coalesce(price_of_text(c), F.lit(0.0))


def coerced_quantity(c: Column) -> Column:
    """Quantity as text: whole numbers lose their decimals; other non-blank texts stay as they are (M2)."""

    def shown(v: Column) -> Column:
        return F.when(v.isNull(), F.coalesce(blank_to_null(c), F.lit(""))).when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))

    return _let(price_of_text(c), shown)


def has_positive_quantity(c: Column) -> Column:
    """the text parses to a positive number, with no upper bound."""
    return F.coalesce(_plain_number(blank_to_null(c)) > 0, F.lit(False))


def float_any_locale(c: Column) -> Column:
    """M3: the later of point and comma is the decimal mark; a lone comma is one only before up to three digits."""

    def pick(s: Column) -> Column:
        after_point, after_comma = F.instr(F.reverse(s), "."), F.instr(F.reverse(s), ",")
        both = F.when(after_point < after_comma, F.translate(s, ",", "")).otherwise(F.translate(s, ",.", "."))
        lone = F.when(F.regexp_like(s, F.lit(r"^[^,]*,\d{0,3}$")), F.translate(s, ",", ".")).otherwise(F.translate(s, ",", ""))
        return F.when(F.contains(s, F.lit(",")), F.when(F.contains(s, F.lit(".")), both).otherwise(lone)).otherwise(s)

    s = F.nullif(F.regexp_replace(c, r"[^\d,.]", ""), F.lit(""))
    return F.round(_let(s, pick).try_cast("double"), 3)


def repaired_digits(c: Column) -> Column:
    """O, l, I, | and S read as digits, in tokens made of digit-like characters only."""

    def read(t: Column) -> Column:
        digit_like = F.regexp_like(F.regexp_replace(t, r"\s+", ""), F.lit(r"(?i)^[\dOlI|,.S§\-]+$"))
        return F.when(digit_like, F.translate(t, "OolI|S§", "0011155")).otherwise(F.coalesce(t, F.lit("")))

    return _let(blank_to_null(c), read)


def french_money(c: Column) -> Column:
    """M4: value of ``1234,56``, ``1 234,567`` or ``1234.56``; null when the token is no money."""

    def value(t: Column) -> Column:
        return F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")

    def read(t: Column) -> Column:
        grouped = F.regexp_like(t, F.lit(r"^\d{1,3}( \d{3})+[,.]\d{1,3}$"))
        plain = F.regexp_like(F.replace(t, F.lit(" "), F.lit("")), F.lit(r"^(\d{1,6},\d{1,3}|\d{1,7}\.\d{1,3})$"))
        return F.when(grouped | plain, value(t))

    # a token that is money as it stands has nothing to repair
    clean = r"^(?:\d{1,3}(?: \d{3})+[,.]\d{1,3}|\d{1,6},\d{1,3}|\d{1,7}\.\d{1,3})$"
    return _let(c, lambda c: F.when(F.regexp_like(c, F.lit(clean)), value(c)).otherwise(_let(F.regexp_replace(repaired_digits(c), r"\s", " "), read)))


def millimes(c: Column) -> Column:
    """M5: decimal(12,3) of a money text, currency words and blanks dropped, half up."""
    t = F.replace(F.regexp_replace(c, "TND|DT| ", ""), F.lit(","), F.lit("."))
    return t.try_cast("decimal(12,3)")


def bounded_float(c: Column, most: float = 999_999_999.0) -> Column:
    """M6: number of a text within (0, most]."""
    return _let(_plain_number(blank_to_null(c)), lambda v: F.when((v > 0) & (v <= most), v))


def money_text(c: Column) -> Column:
    """M8: up to five decimals, trailing zeros dropped."""
    return F.when(c.isNotNull(), F.regexp_replace(F.format_string("%.5f", c.cast("double")), r"\.?0+$", ""))


def score_text(c: Column) -> Column:
    """How a value is compared when an extraction is scored."""
    return F.lower(F.coalesce(blank_to_null(c), F.lit("")))


def with_tax(total: Column, rate: str = "0.19") -> tuple[Column, Column]:
    """M9: (tax, total with tax) as decimal(12,3)."""
    share = F.lit(rate).cast("decimal(5,2)")
    return (total * share).cast("decimal(12,3)"), (total * (share + 1)).cast("decimal(12,3)")
