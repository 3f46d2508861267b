"""Header fields and totals of documents, from their numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes, dates, numbers, text
from ledgerweave.functions.fuzzy import fuzzy_type

#: Headings of an order or invoice.
HEADING = r"(?i)bon\s+de\s+commande|proforma|commande\b|facture"
#: Words that mark a company name.
COMPANY_WORDS = (
    r"sarl|s\.a\.r\.l|s\.a\.|s\.a\b|spa|suarl|sas|ste\b|soci[eé]t[eé]|repartition|r[eé]partiteur|grossiste|laboratoire|pharma|distribution|"
    r"m[eé]dicament|medical|import|export|commerce|groupe|holding|avenir|rekik"
)
COMPANY = rf"(?iu)\b({COMPANY_WORDS})\b"
#: Openings that no company name or address has, and words of an address.
NOT_COMPANY = r"(?i)^(route|rue|avenue|av\.|bd\.|date|tel|fax|m\.f|r\.c|page|code|email|sfax|tunis|nabeul|sousse|edite|prepare|medis\b)"
ADDRESS = r"(?i)\b(route|rue|avenue|bd|boulevard|cit[eé]|zone\s+ind|lotissement|impasse|r[eé]sidence|quartier|km\s*\d)\b"
#: Openings that no address has, the form of a tax id, and of an amount.
NOT_ADDRESS = r"(?i)^(tel|t[eé]l|fax|m\.?f|r\.?c|sfax|tunis|nabeul|sousse|date|page|code|email|bon\s+de|facture|proforma|commande|medis|pharma|laboratoire)"
TAX_ID = r"(?i)(?:m\.?\s*f\.?\s*[:\-]\s*)?([0-9A-Z]{6,}[/\\|\s\-]*[A-Z][/\\|\s\-]*[A-Z][/\\|\s\-]*[A-Z][/\\|\s\-]*[0-9]{3,4})\b"
AMOUNT = r"(\d[\d\s]*[,.]\d{2,3}|\d{4,})"


def like(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def header_fields(lines: DataFrame, doc: str) -> DataFrame:
    """One row of header fields for each document of ``lines(doc, line_no, raw_line)``.

    Lines are compared with their neighbours in one window (W7, W8); every field is then the first match in line
    order (W10, W12), so a document needs one aggregate.
    """
    w = Window.partitionBy(doc).orderBy("line_no")
    raw = F.col("raw_line")
    marked = lines.withColumn("__heading", like(raw, HEADING))
    marked = marked.withColumns(
        {"__next": F.lead("raw_line").over(w), "__h1": F.lag("__heading", 1, False).over(w), "__h2": F.lag("__heading", 2, False).over(w), "__rn": F.row_number().over(w)}
    )
    under = F.col("__h1") | F.col("__h2")
    # a pattern runs only on lines with a character that all its matches hold
    slashed, dashed = F.contains(raw, F.lit("/")), F.contains(raw, F.lit("-"))
    pair = F.nullif(F.regexp_replace(F.regexp_extract(raw, r"\b(\d{3,6}\s*/\s*\d{4})\b", 1), r"\s+", ""), F.lit(""))
    # a cast of a blank text costs an exception a line, so the number in front is cast only where there is one
    numero = F.when(slashed & (F.substring_index(pair, "/", 1).try_cast("int") > 12), pair)
    coded = F.when(dashed, F.nullif(F.upper(F.regexp_extract(raw, r"(?i)\b(BC[NM]-[A-Z0-9]{2}-\d{4}|[A-Z]{2,8}-[A-Z]{2,8}-[A-Z0-9]{4,12})\b", 1)), F.lit("")))
    day, named = like(raw, r"\d[/\-.]\d"), like(raw, r"(?i)(?=[tfdr])(?:T[eé]l|Fax|Date|R\.?C)")
    dated = F.nullif(F.regexp_extract(raw, r"(?i)Date\s*[:\-]?\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(raw, r"\b(\d{2}[/\-.]\d{2}[/\-.]\d{4})\b", 1), F.lit(""))
    mf = F.when(like(raw, r"\d{3}"), numbers._let(F.regexp_extract(raw, TAX_ID, 1), lambda t: F.when(t != "", codes.tax_id(t))))
    at = F.when(like(raw, r"(?i)^\s*m\.?\s*f\.?\s*[:\-]"), 0.0).otherwise((F.regexp_instr(raw, F.lit(TAX_ID)) - 1) / F.length(raw))
    company = (F.col("__rn") <= 12) & ~like(raw, NOT_COMPANY) & like(raw, COMPANY)
    plain = (F.col("__rn") <= 6) & ~like(raw, NOT_COMPANY) & like(raw, r"[A-Za-z]{3,}") & like(raw, r"\S\s+\S") & ~like(raw, r"^([A-Z]{2,4}\d|\d)")
    nxt = F.col("__next")
    block = F.concat_ws(" — ", raw, F.when(~like(nxt, NOT_ADDRESS) & F.length(nxt).between(5, 99), nxt))
    address = F.when(like(raw, ADDRESS) & ~like(block, r"(?i)\b(tel|t[eé]l|fax|email)\b|@"), F.left(block, F.lit(120)))
    fields = {
        "n1": F.when(under, F.coalesce(numero, coded)), "n2": coded, "n3": numero, "d1": F.when(named & day, dated), "d2": F.when(day, bare), "f1": F.when(company, F.left(raw, F.lit(120))), "f2": F.when(plain, F.left(raw, F.lit(120))),
        "adresse": address, "tel": F.when(named, text.phone(raw)), "fax": F.when(named, text.fax(raw)), "email": F.when(F.contains(raw, F.lit("@")), text.email(raw)), "rc": F.when(named, text.trade_register(raw)), "mf": mf, "mf_at": F.when(mf.isNotNull(), at),
    }
    seen = marked.select(doc, "line_no", "__rn", *[c.alias(k) for k, c in fields.items()])
    # a line that shows no field goes, save the first of each document; the explode keeps that filter above the rules
    shown = seen.select(doc, "line_no", "__rn", F.inline(F.array(F.struct(*fields))))
    seen = shown.where((F.col("__rn") == 1) | F.coalesce(*[c for c in fields if c != "mf_at"]).isNotNull())

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))

    left, right = F.col("mf_at") < 0.45, F.col("mf_at") >= 0.45
    out = seen.groupBy(doc).agg(
        *[first(c).alias(c) for c in ("n1", "n2", "n3", "d1", "d2", "f1", "f2", "adresse", "tel", "fax", "email", "rc")],
        F.min_by("mf", F.when(left, F.struct("mf_at", "line_no"))).alias("supplier_mf"), F.max_by("mf", F.when(right, F.struct("mf_at", "line_no"))).alias("client_mf"),
    )
    return out.select(
        doc, F.coalesce("n1", "n2", "n3").alias("numero"), F.coalesce("d1", "d2").alias("date"), F.coalesce("f1", "f2").alias("fournisseur_nom"), "adresse", "tel", "fax", "email", "rc", "supplier_mf", "client_mf"
    )


def totals(lines: DataFrame, doc: str, page: str | None = None, bottom: int = 80) -> DataFrame:
    """Totals from the last lines of each page (W9): the first amount at or over the minimum that is no year."""
    keys = [doc, page] if page else [doc]
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("line_no")))
    own = lines.withColumn("__rn", last).where(F.col("__rn") <= bottom)
    raw = F.col("raw_line")
    amounts = F.transform(F.regexp_extract_all(raw, F.lit(AMOUNT), F.lit(1)), numbers.float_any_locale)

    def value(least: float) -> Column:
        return F.get(F.filter(amounts, lambda v: (v >= least) & ~v.between(1900, 2100)), F.lit(0))

    rules = {
        "total_ht": (r"(?i)^(Total\s+Net\s+HT|Total\s+HT|Montant\s+HT|Total\s+H\.T)", 500.0), "tva": (r"(?i)^TVA\s*[:\-](?!.*\b(base|valeur|type)\b)", 100.0),
        "total_ttc": (r"(?i)^(Total\s+TT?C|Net\s+[àa]\s+payer)", 500.0),
    }
    order = F.struct(*[F.col(k) for k in keys[1:]], F.col("line_no"))
    seen = own.select(*keys, "line_no", *[F.when(like(raw, p), value(m)).alias(k) for k, (p, m) in rules.items()])
    return seen.groupBy(doc).agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), order)).alias(k) for k in rules])


def proforma_summary(texts: DataFrame, column: str) -> DataFrame:
    """Gross, discount, net, tax, transport, stamp and total of a proforma's text; the tax of detail rows is
    added up when no tax line states it."""
    c = F.col(column)

    def grab(label: str, least: float) -> Column:
        block = F.regexp_extract(c, rf"(?is){label}\s*[:\s]+([\d\s,.]+)", 1)
        found = F.transform(F.regexp_extract_all(block, F.lit(AMOUNT), F.lit(1)), numbers.float_any_locale)
        last = F.element_at(F.filter(found, lambda v: v >= 0), -1)
        v = F.when(F.size(F.filter(found, lambda v: v >= 0)) > 0, last)
        return F.when(v >= least, v)

    rows = F.transform(F.regexp_extract_all(c, F.lit(r"%\s+\d+[,.]\d{1,2}\s+[\d ]+[,.]\d{2,3}\s+([\d ]+[,.]\d{2,3})"), F.lit(1)), numbers.float_any_locale)
    detail = F.aggregate(rows, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    stated = grab(r"\bTVA", 50.0001)
    return texts.withColumns(
        {
            "total_brut_ht": grab(r"Total\s+Brut\s+HT", 100.0001), "remise_pct": numbers.float_any_locale(F.regexp_extract(c, r"(?i)Total\s+Remis[eé]\s*[:\s]*\(?\s*(\d+[,.]?\d*)\s*%?", 1)),
            "total_ht": grab(r"Total\s+Net\s+HT", 100.0001), "tva": F.coalesce(stated, F.when(detail > 0, F.round(detail, 3))), "transport": grab("Transport", 0.0),
            "timbre_fiscal": grab(r"Timbre\s+Fiscal", 0.0), "total_ttc": grab(r"Total\s+TTC", 100.0001),
        }
    )


def zones(lines: DataFrame, doc: str) -> DataFrame:
    """Header, body or footer of each line: the body starts at the first line with two column words; footer lines
    are the totals words' lines among the last twelve and what follows them."""
    words = ("code", "qte", "quantite", "designation", "prix", "montant")
    t = F.lower(F.translate("raw_line", text.ACCENTED, text.PLAIN))
    hits = sum((like(t, rf"\b{w}\b").cast("int") for w in words), F.lit(0))
    whole = Window.partitionBy(doc)
    own = lines.withColumns({"__head": F.min(F.when(hits >= 2, F.col("line_no"))).over(whole), "__back": F.row_number().over(whole.orderBy(F.desc("line_no")))})
    own = own.withColumn("__foot", F.min(F.when((F.col("__back") <= 12) & like(t, r"\b(total|net a payer|tva|ttc)\b"), F.col("line_no"))).over(whole))
    zone = F.when(F.col("line_no") >= F.col("__foot"), "footer").when(F.col("line_no") < F.coalesce("__head", F.lit(1 << 30)), "header").otherwise("body")
    return own.withColumn("zone", zone).drop("__head", "__back", "__foot")


#: Forms of a document number with their score.
NUMBER_FORMS = ((r"(?i)^(BCN|BCM|FAC|PRO|CMD|INV)[\-/]\w{2}[\-/]\d{4}$", 0.97), (r"^[A-Z]{2,8}-[A-Z]{2,8}-\d{4,12}$", 0.95), (r"^\d{3,6}/\d{4}$", 0.90))
TAX_ID_FORM, EMAIL_FORM = r"^\d{6,8}[A-Z]/[A-Z]/[A-Z]/\d{3}$", r"^[\w\.\-]+@[\w\.\-]+\.\w{2,6}$"
AMOUNTS, TAX_IDS, AMBIGUOUS = ("total_ht", "tva", "total_ttc", "total_brut_ht", "transport", "timbre_fiscal"), ("supplier_mf", "client_mf", "matricule_fiscal"), 0.55


def scored_fields(heads: DataFrame, body: str, as_of: Column) -> DataFrame:
    """Header fields made better where their form allows it, with ``scores`` (a map), ``warnings`` and the
    ``ambiguous`` fields, those below 0.55. ``body`` is the column of the document's text, which decides its type with the
    given ``type``; a column that is not among the known ones scores 0.70."""

    def held(c: str) -> Column:
        return text.stripped(F.col(c).cast("string")) != ""

    have = [c for c in heads.columns if c not in (body, "type")]
    out = heads.withColumn("__kind", fuzzy_type(F.coalesce(F.col(body), F.lit(""))))
    given = F.coalesce(F.col("type"), F.lit("Document")) if "type" in heads.columns else F.lit("Document")
    kind, sure = F.col("__kind.type"), F.col("__kind.score")
    scores = {"type": F.when((given != "Document") & (kind == given) | (given == "Document") & (kind == "Document"), F.greatest(sure, F.lit(0.90))).otherwise(sure)}
    new = {"type": F.when((kind != "Document") & ((given == "Document") | (kind != given) & (sure > 0.80)), kind).otherwise(given)}
    warnings = []
    if "date" in have:
        read = F.when(held("date"), F.col("date"))
        good = dates.validated_date(read, as_of)
        scores["date"] = F.when(read.isNull(), 0.0).when(good.isNull(), 0.30).when(good != read, 0.92).otherwise(0.95)
        warnings += [F.when(good != read, F.format_string("Date corrected: '%s' \u2192 '%s'", read, good)), F.when(read.isNotNull() & good.isNull(), F.format_string("Date: '%s'", read))]
        new["date"] = F.coalesce(good, F.col("date"))
    for c in AMOUNTS:
        if c in have:
            scores[c] = F.when(F.col(c).isNotNull(), 0.90).otherwise(0.0)
    if "numero" in have:
        form = F.when(~held("numero"), 0.0)
        for pattern, s in NUMBER_FORMS:
            form = form.when(like(F.col("numero"), pattern), s)
        scores["numero"] = form.otherwise(0.70)
    for c in TAX_IDS:
        if c in have:
            odd = held(c) & ~like(F.col(c), TAX_ID_FORM)
            scores[c] = F.when(~held(c), 0.0).when(odd, 0.55).otherwise(0.98)
            warnings.append(F.when(odd, F.format_string("%s unusual: '%s'", F.lit(c), F.col(c))))
    if "tel" in have:
        digits = F.length(F.regexp_replace("tel", r"\D", ""))
        scores["tel"] = F.when(~held("tel"), 0.0).when(digits == 8, 0.95).when(digits.isin(10, 11), 0.80).otherwise(0.50)
    if "email" in have:
        scores["email"] = F.when(~held("email"), 0.70).when(like(F.col("email"), EMAIL_FORM), 0.97).otherwise(0.50)
    if "adresse" in have:
        scores["adresse"] = F.when(held("adresse"), 0.75).otherwise(0.70)
    scores |= {c: F.lit(0.70) for c in have if c not in scores}
    # a null score is one of a null field that no form was read from
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("value")) for k, c in scores.items()])
    out = out.withColumns({"scores": F.map_from_entries(entries), "warnings": F.array_compact(F.array(F.lit(None).cast("string"), *warnings))})
    out = out.withColumn("ambiguous", F.map_keys(F.map_filter("scores", lambda _, v: v < AMBIGUOUS)))
    return out.withColumns(new).drop("__kind")


def unresolved_lines(lines: DataFrame) -> DataFrame:
    """lines with a code but no quantity whose designation holds digits or a date."""
    shown = like(F.coalesce("designation", F.lit("")), r"\d{2,5}|[0-9OIlS]{2}[/\-.][0-9OIlS]{2}[/\-.][0-9OIlS]{4}")
    return lines.where((F.coalesce("code", F.lit("")) != "") & (F.coalesce("quantite", F.lit("")) == "") & shown)
