"""Text repair, noise tests and designation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


#: The characters that count as white space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Trims every kind of white space, as Python does."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(stripped(c), r"(?U)\s+", " ")


def product_label(c: Column) -> Column:
    """Upper case without accents; letters, digits, points and slashes only."""
    t = F.translate(F.upper(stripped(c)), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[\-\s]+", ""), r"[^A-Z0-9\s./]", " "), r"\s+", " "))


def edges_cleaned(c: Column) -> Column:
    """Marks at either end of a designation go, runs of blanks become one."""
    t = stripped(F.regexp_replace(stripped(c), r"^[\-*!~=+#|£/\\]+\s*", ""))
    return F.regexp_replace(stripped(F.regexp_replace(t, r"[!~=*#|£/\\]+$", "")), r"\s{2,}", " ")


def line_cleaned(c: Column) -> Column:
    """Currency marks, parentheses with their content, brackets and underscores go."""
    t = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "$€°", "   "), r"\([^)]*\)", " ")
    return squeezed(F.regexp_replace(t, r"[\[\]_]+", " "))


def has_noise(c: Column) -> Column:
    """a designation that shows scanning noise."""
    t = stripped(c)

    def like(pattern: str) -> Column:
        return F.regexp_like(t, F.lit(pattern))

    quantity_first = like(r"^\d{1,5}\s+[A-Z].+$") & ~like(r"(?i)^\d+\s*MG\b")
    noisy = like(r"""^[\s\d"'#<>.,;:!?~`]""") | like(r"""[\s"'#<>.,;:!?~`]$""") | like(r'[<>~`]|"[^"]*$') | quantity_first | like(r"^[^A-Z]{1,3}\s+[A-Z]")
    return (t != "") & noisy


def text_repaired(c: Column) -> Column:
    """Extraction artefacts of a page text repaired, line by line structure kept."""
    t = F.regexp_replace(c, r"\(cid:\d+\)", "")
    # letters set apart by blanks: a blank goes when the run around it has at least four single capitals
    t = F.regexp_replace(t, r"(?<=(?<![\w])[A-Z]) (?=(?:[A-Z] ){2,}[A-Z](?!\w))|(?<=(?<!\w)[A-Z] [A-Z]) (?=(?:[A-Z] )*[A-Z](?!\w))", "\u0001")
    t = F.regexp_replace(t, "\u0001", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=\d)[lI](?=\d)", "1"), r"(\d)°(o|(?=\d))", "$10")
    t = F.regexp_replace(t, r"(?<=[A-Za-z0-9])\|(?=[A-Za-z0-9])", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^\s*\|\s*$", ""), r"(?i)\b(?<!b)on de (commande|livraison)\b", "Bon de $1")
    return F.regexp_replace(F.regexp_replace(t, r"[=~_—]{2,}", " "), r"[ \t]{2,}", " ")


def is_text_line(line: Column) -> Column:
    """At least 3 letters or digits, at most 60 % other characters, a word or a digit."""
    s = stripped(line)
    good = F.length(F.regexp_replace(s, "[^A-Za-z0-9]", ""))
    return (good >= 3) & (1 - good / (F.length(s) + F.lit(1e-5)) <= 0.60) & F.regexp_like(s, F.lit(r"[A-Za-z]{3,}|\d"))


def phone(c: Column) -> Column:
    """Digits of the first phone number, country code 216 dropped; null unless 8, 10 or 11 digits."""
    d = F.regexp_replace(F.nullif(F.regexp_extract(c, r"(?i)T[eé]l[:.\s/]*(\+?\d[\d\s.\-]{6,20}\d)", 1), F.lit("")), r"\D", "")
    d = F.when(F.startswith(d, F.lit("216")) & (F.length(d) > 8), F.right(d, F.lit(8))).otherwise(d)
    return F.when(F.length(d).isin(8, 10, 11), d)


def fax(c: Column) -> Column:
    d = F.regexp_replace(F.nullif(F.regexp_extract(c, r"(?i)Fax[:.\s]*(\d[\d\s.\-]{6,20}\d)", 1), F.lit("")), r"\D", "")
    return F.when(F.length(d).isin(8, 10, 11), d)


def email(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"[\w.-]+@[\w.-]+\.\w{2,}", 0), F.lit(""))


def trade_register(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)R\.?C\.?\s*[:\-]?\s*([A-Z][A-Z0-9]{5,14})", 1), F.lit(""))


def quantity_repaired(c: Column) -> Column:
    """ND reads 0; quotes before digits go; a section sign before digits reads 5."""
    t = F.regexp_replace(F.regexp_replace(stripped(c), r"""^["']+(?=\d)""", ""), r"§(?=\d)", "5")
    return F.when(F.upper(t) == "ND", "0").otherwise(t)


def merged_amounts(c: Column) -> Column:
    """The blanks inside grouped amounts such as ``1 234,56`` go."""
    # the blank comes first, so that what stands before it is looked at only there
    return F.regexp_replace(c, r" (?=\d{3}(?: \d{3})*[,.]\d{2,3}(?!\d))(?<=(?<![\d,.])\d{1,3}(?: \d{3}){0,2} )", "")


def json_between_braces(c: Column) -> Column:
    """C4: what lies between the first ``{`` and the last ``}``."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


#: Document types in order of priority, with the words that show them.
DOCUMENT_WORDS = (
    ("Proforma", ("proforma", "b.c. interne", "incoterms", "date/heure livraison", "bcm-")),
    ("Bon de Commande", ("bon de commande", "commande fournisseur", "bcn-", "bc n°", "bon de commande n°")),
    ("Facture", ("facture", "invoice", "facture numéro")),
    ("Statistiques", ("statistique", "quantitatif des ventes", "stat. ventes", "quantité proposée", "moyenne des ventes")),
    ("Chiffre d'Affaires", ("chiffre d'affaire", "ventes et chiffre")),
)


def document_type(c: Column) -> Column:
    """First type one of whose words is in the text."""
    t, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(None).cast("string")
    for name, words in reversed(DOCUMENT_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return F.coalesce(out, F.lit("Document"))


def is_order(doc_type: Column, family: Column) -> Column:
    """purchase-order test by family prefix or by a word inside the type ("bc" anywhere counts)."""
    t, f = F.lower(F.coalesce(doc_type, F.lit(""))), F.lower(F.coalesce(family, F.lit("")))
    return F.contains(f, F.lit("bc_")) | F.contains(f, F.lit("bon")) | F.regexp_like(t, F.lit("bon de commande|bon commande|bc"))


#: What no company name holds.
NOT_COMPANY = r"https?://|www\.|stat\s+ventes|statistiques|proforma\s*n[°o]|mdn-pre|mdn-prf|bon\s+de\s+commande\s+n|^\s*(page|cer)\s"


def is_company_name(c: Column) -> Column:
    """F8: three letters at least and a quarter of all characters; no web address, statistics or order heading, and no page
    mark in front."""
    t = stripped(c)
    letters = F.length(F.regexp_replace(t, r"(?U)[^\p{L}]", ""))
    return (letters >= F.greatest(F.lit(3.0), F.length(t) * 0.25)) & ~F.regexp_like(F.lower(t), F.lit(NOT_COMPANY))
