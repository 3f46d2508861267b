"""Body text of many documents to typed line items, in column expressions over exploded lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes, dates, numbers, text

CODE_START = r"(?i)^([A-Z]{2,4}\d{2,14}|\d{4,7})\b"
DOSAGE_NEXT = r"(?i)^\s*(?:MG|ML|G|UI|µG|MCG|GR|%|CP|FL|BT|AMP|INJ|SOL|GEL)(?!\w)"
FORM_BEFORE = r"(?i)(?:COMP|CP|FL|ML|MG|INJ|GEL|SOL)\s*$"
MOST_ORDERED = 8000


def page_lines(pages: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Numbered non-blank lines of a text column."""
    lines = F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), r"\R"))
    out = pages.select(*keys, lines.alias("line_no", "raw_line"))
    return out.withColumn("raw_line", text.stripped(F.col("raw_line"))).where("raw_line <> ''")


def _whole(num: Column) -> Column:
    n = F.when(F.regexp_like(num, F.lit(r"^\d{1,5}$")), num.try_cast("int"))
    return F.coalesce(n.between(1, MOST_ORDERED) & ~n.between(1900, 2100), F.lit(False))


def plausible_prefix(num: Column, following: Column) -> Column:
    """a quantity right after the code, not the number of a dosage."""
    fol = F.ltrim(F.coalesce(following, F.lit("")))
    return _whole(num) & ~F.regexp_like(fol, F.lit(r"(?i)^\d+\s*MG\b")) & ~F.regexp_like(fol, F.lit(DOSAGE_NEXT))


def plausible_column(num: Column, following: Column, preceding: Column) -> Column:
    """a quantity in a column, neither a dosage (10 MG) nor a pack size (B/30)."""
    fol, pre = F.ltrim(F.coalesce(following, F.lit(""))), F.rtrim(F.coalesce(preceding, F.lit("")))
    pack = F.regexp_like(pre, F.lit(r"(?i)(B/|\d+\s*MG)$"))
    beside = F.regexp_like(fol, F.lit(r"(?i)^[A-Z]{3,}")) | F.regexp_like(pre, F.lit(FORM_BEFORE)) | ((fol == "") & (pre == ""))
    return _whole(num) & ~F.regexp_like(fol, F.lit(DOSAGE_NEXT)) & ~pack & beside


def plausible_in_document(num: Column, designation: Column, doc_type: Column, profile: Column) -> Column:
    """soft caps by document type and vendor; not beside a total."""
    t = F.lower(F.coalesce(doc_type, F.lit("")))
    cap = F.when(profile == "pharmasud_medis", 5000).when(F.contains(t, F.lit("proforma")), 10000).otherwise(6000)
    total = F.regexp_like(F.lower(F.coalesce(designation, F.lit(""))), F.lit("total|montant|ttc|ht"))
    return F.coalesce((num > 0) & ~num.between(1900, 2100) & (num <= cap) & ~total, F.lit(False))


def _signal(tok: Column) -> Column:
    return F.regexp_like(tok, F.lit(r"\d")) | (F.upper(F.regexp_replace(tok, "[^A-Za-z]", "")) == "BO")


def _digits(tok: Column) -> Column:
    letters = F.upper(F.regexp_replace(tok, "[^A-Za-z]", ""))
    return F.when(letters == "BO", "80").otherwise(F.regexp_replace(numbers.repaired_digits(tok), r"\D", ""))


def after_code(raw: Column, code: Column) -> Column:
    """Text after the first occurrence of the code, without marks in front; the whole text when it is not there."""
    at = F.instr(F.upper(raw), F.upper(code))
    rest = F.when((code != "") & (at > 0), F.substring(raw, at + F.length(code), F.length(raw))).otherwise(raw)
    return F.when((code != "") & (at > 0), F.regexp_replace(text.stripped(rest), r"^[|.'\"()\[\]\-_\s]+", "")).otherwise(raw)


def with_quantity(lines: DataFrame, raw: str = "raw_line", code: str = "code") -> DataFrame:
    """Adds ``q`` = struct(quantity, rest, source, score); the quantity is null when there is none.

    In order: the integer after a 6-digit code; the first or second token after the code; the last or the one before
    it, after a form word. A quantity found here is final.
    """
    c, r = F.col(code), F.col(raw)
    out = lines.withColumn("__after", after_code(r, c)).withColumn("__t", F.split(text.squeezed(F.translate("__after", "$€°", "   ")), " "))
    t, n = F.col("__t"), F.size("__t")

    def upto(back: int) -> Column:
        return F.array_join(F.slice(t, 1, F.greatest(n - back, F.lit(0))), " ")

    def tail(i: int) -> Column:
        return F.array_join(F.slice(t, i + 1, F.greatest(n - i, F.lit(0))), " ")

    # each intermediate value is a column of its own, so that it is computed once
    fast = F.when(F.regexp_like(c, F.lit(r"^\d{6}$")), F.nullif(F.regexp_extract("__after", r"^(\d{1,5})\b(?![.,]\d)", 1), F.lit("")))
    spots = {"a": F.get(t, F.lit(0)), "b": F.get(t, F.lit(1)), "y": F.when(n > 1, F.get(t, n - 1)), "z": F.when(n > 2, F.get(t, n - 2))}
    out = out.withColumns({f"__{k}": v for k, v in spots.items()} | {"__fa": tail(1), "__fb": tail(2), "__fy": upto(1), "__fz": upto(2), "__fast": fast})
    out = out.withColumn("__ffast", F.regexp_replace(text.stripped(F.regexp_replace("__after", r"^\d{1,5}\b", "")), r"^[Xx×]\s*", ""))
    out = out.withColumns({f"__d{k}": F.when(_signal(F.col(f"__{k}")), _digits(F.col(f"__{k}"))) for k in spots} | {"__marks": F.regexp_like("__a", F.lit(r"^[=—\-_|.\"'\s]+$"))})

    def twin(k: str) -> Column:
        """Two digits of three whose last is doubled by a pen mark."""
        d, fol = F.col(f"__d{k}"), F.col(f"__f{k}")
        return F.when((F.length(d) == 3) & (fol != "") & (F.substring(d, 3, 1) == F.substring(d, 2, 1)), F.left(d, F.lit(2)))

    out = out.withColumns({"__wa": twin("a"), "__wb": twin("b")})
    for k in "ab":
        d, w, fol = F.col(f"__d{k}"), F.col(f"__w{k}"), F.col(f"__f{k}")
        out = out.withColumn(f"__p{k}", F.when(plausible_prefix(w, fol), w).otherwise(d))
        out = out.withColumn(f"__q{k}", F.when((F.length(d) < 5) & plausible_prefix(F.col(f"__p{k}"), fol), F.col(f"__p{k}")))
    for k in "yz":
        d, pre = F.col(f"__d{k}"), F.col(f"__f{k}")
        good = (F.length(pre) >= 4) & F.regexp_like(pre, F.lit("(?i)[A-Z]{3,}")) & (F.length(d) < 5) & plausible_column(d, F.lit(""), pre)
        out = out.withColumn(f"__q{k}", F.when(good, d))
    second = F.when(F.col("__marks") | _signal(F.coalesce("__b", F.lit(""))), F.col("__qb"))
    second_rest = F.when(F.col("__marks"), F.col("__fb")).otherwise(F.concat_ws(" ", "__a", F.nullif(F.col("__fb"), F.lit(""))))
    out = out.withColumns({"__qb": second, "__rb": second_rest, "__qf": F.when(plausible_prefix(F.col("__fast"), F.col("__ffast")), F.col("__fast"))})

    def found(q: str, rest: Column, source: str, score: float) -> Column:
        return F.when(F.col(q).isNotNull(), F.struct(F.col(q).alias("quantity"), rest.alias("rest"), F.lit(source).alias("source"), F.lit(score).alias("score")))

    none = F.struct(F.lit(None).cast("string").alias("quantity"), F.array_join(t, " ").alias("rest"), F.lit("").alias("source"), F.lit(0.0).alias("score"))
    q = F.coalesce(
        found("__qf", F.col("__ffast"), "mp_code_prefix", 0.89), found("__qa", F.col("__fa"), "qty_positional_prefix", 0.86), found("__qb", F.col("__rb"), "qty_positional_prefix", 0.86),
        found("__qy", F.col("__fy"), "qty_positional_suffix", 0.88), found("__qz", F.col("__fz"), "qty_positional_suffix", 0.88), none,
    )
    # exploding a one-element array keeps later filters above these columns: pushed below, they would repeat every rule
    return out.select(*[F.col(f"`{c}`") for c in lines.columns], F.explode(F.array(q)).alias("q"))


def first_of(lines: DataFrame, doc: str, *key: Column) -> DataFrame:
    """The first line of each key of a document."""
    w = Window.partitionBy(doc, *key).orderBy("line_no")
    return lines.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def simple_order_lines(lines: DataFrame, doc: str) -> DataFrame:
    """T5: code, quantity, designation of three-column order lines; U7 dedup."""
    own = lines.withColumn("__line", text.line_cleaned(F.col("raw_line"))).withColumn("__raw_code", F.regexp_extract("__line", CODE_START, 1))
    own = own.withColumn("__code", codes.normalized_code(F.col("__raw_code"))).withColumn("__rest", text.stripped(F.substring("__line", F.length("__raw_code") + 1, F.length("__line"))))
    # above the explode, the filter reads columns instead of repeating their rules
    parts = F.array(F.struct(F.col("__code").alias("code"), "__rest"))
    own = own.select(*[F.col(f"`{c}`") for c in lines.columns if c != "code"], F.inline(parts)).where("length(code) >= 4 and length(__rest) >= 2")
    own = with_quantity(own)
    scan = F.regexp_extract("__rest", r"\b(?!0+\d{3})(\d{1,5})\b", 1)
    late = F.when(F.col("q.quantity").isNull() & scan.try_cast("int").between(1, MOST_ORDERED), scan)
    late_rest = F.regexp_replace("__rest", r"^.*?\b(?!0+\d{3})\d{1,5}\b\s*", "")
    named = F.when(F.col("q.quantity").isNotNull(), F.coalesce(F.nullif(F.col("q.rest"), F.lit("")), "__rest")).when(late.isNotNull(), late_rest).otherwise(F.col("__rest"))
    out = own.withColumns({"quantite": F.coalesce("q.quantity", late, F.lit("")), "designation": text.edges_cleaned(named)})
    out = out.withColumn("line_confidence", F.when(F.col("quantite") == "", 0.42).otherwise(0.72))
    # equal lines have equal designations, so this filter can follow the window and is not pushed into the parsing
    return first_of(out.drop("__rest", "q"), doc, F.col("code"), F.left("raw_line", F.lit(100))).where("length(designation) >= 2")


def dated_order_lines(lines: DataFrame, doc: str) -> DataFrame:
    """Lines around an expiry date: code, quantity and cartons left of it, carton unit right of it; U8 dedup."""
    own = lines.withColumn("__l", dates.repaired_digits_in_date(text.squeezed(F.col("raw_line"))))
    shape = r"^(.*?)\b(\d{2}/\d{2}/\d{4})\b(.*)$"
    own = own.withColumns({"__left": F.trim(F.regexp_extract("__l", shape, 1)), "__date": F.regexp_extract("__l", shape, 2), "__right": F.regexp_extract("__l", shape, 3)}).where("__date <> ''")
    own = own.withColumn("__code", F.regexp_extract("__left", r"(?i)^([A-Z]{2,4}\d{2,12}|\d{4,7})\b", 1)).where("__code <> ''")
    rest = F.trim(F.substring("__left", F.length("__code") + 1, F.length("__left")))
    own = own.withColumns({"__rest": rest}).withColumn("__nums", F.regexp_extract_all("__rest", F.lit(r"\b(\d{1,5})\b"), F.lit(1)))
    units = F.regexp_extract_all("__right", F.lit(r"\b(\d{1,5})\b"), F.lit(1))
    out = own.withColumns(
        {
            "code_pct": codes.normalized_code(F.col("__code")), "quantite_commande": F.coalesce(F.get("__nums", F.lit(0)), F.lit("")), "nb_cartons": F.coalesce(F.get("__nums", F.lit(1)), F.lit("")),
            "unite_carton": F.when(F.size(units) > 0, F.element_at(units, -1)).otherwise(""), "date_peremption": dates.checked_expiry(F.col("__date")),
            "designation": text.edges_cleaned(text.squeezed(F.regexp_replace("__rest", r"\b\d{1,5}\b", " "))),
        }
    )
    score = F.when(F.col("quantite_commande") != "", 0.78).otherwise(0.55) + F.when(F.col("designation") != "", 0.1).otherwise(0.0)
    out = out.withColumn("line_confidence", F.round(F.least(score, F.lit(1.0)), 3)).drop("__l", "__left", "__date", "__right", "__code", "__rest", "__nums")
    return first_of(out, doc, F.col("code_pct"), F.col("date_peremption"), F.left("raw_line", F.lit(120)))


def proforma_lines(lines: DataFrame, doc: str) -> DataFrame:
    """Two codes in front, quantity, price and amount at the end, the designation between; a line with both codes
    but no amounts is salvaged with a low score; U9 dedup."""
    merged = text.merged_amounts(text.line_cleaned(F.col("raw_line")))
    line = F.regexp_replace(merged, r"^(?:\d+[,.]\d{1,3}\s+)+(?=\d{5,7}\b)", "")
    head = r"(?i)^(\d{5,7})\s+([PF]F[A-Z0-9]{4,14})\s+"
    full = head + r"(.*?)\s*\b(\d{1,5}(?:[,.]\d{1,3})?)\s+(\d{1,7}[,.]\d{1,3})\s+(\d{1,9}[,.]\d{1,3})\s*$"
    # every line is read once by each pattern, which sets its parts in order, those without blanks first; a cleaned line
    # begins with no blank, so two blanks in front mark a line with amounts and one a line without
    order = r"$1 $2 $4 $5 $6 $3"
    read = numbers._let(F.regexp_replace(line, full, "  " + order), lambda t: F.when(F.startswith(t, F.lit(" ")), t).otherwise(F.regexp_replace(t, head, " $1 $2    ")))
    kept = [F.col(f"`{c}`") for c in lines.columns]
    # exploding keeps the filter above the patterns: pushed below, it would repeat them
    own = lines.select(*kept, F.explode(F.array(read)).alias("__m")).where("startswith(__m, ' ')")
    own = own.withColumn("__full", F.startswith("__m", F.lit("  "))).withColumn("__p", F.split(F.ltrim("__m"), " ", 6))

    def part(i: int) -> Column:
        return F.get("__p", F.lit(i))

    out = own.withColumns(
        {
            "code_pct": part(0), "code_article": codes.product_code(part(1)), "designation": text.edges_cleaned(part(5)),
            "quantite": part(2), "prix_unitaire": part(3), "montant": part(4), "line_confidence": F.when(F.col("__full"), 0.85).otherwise(0.28),
        }
    ).drop("__m", "__full", "__p")
    key = [F.col(c) for c in ("code_pct", "code_article", "montant", "quantite", "prix_unitaire")]
    return first_of(out, doc, *key, F.left("raw_line", F.lit(120)))


def unknown_lines(lines: DataFrame) -> DataFrame:
    """Code and raw line."""
    code = F.upper(F.regexp_extract("raw_line", CODE_START, 1))
    return lines.where("length(raw_line) >= 5").withColumn("code", code).where("length(code) >= 4").withColumn("line_confidence", F.lit(0.35))


def parsed_lines(lines: DataFrame, doc: str, family: str = "invoice_family") -> DataFrame:
    """T4: each family's lines by its own rules, in one superset of columns."""
    f = F.coalesce(F.col(family), F.lit("unknown"))
    known = ("proforma_modele", "bc_pharmasud", "bc_avenir", "bc_omnipharm")
    parts = [
        proforma_lines(lines.where(f == "proforma_modele"), doc), dated_order_lines(lines.where(f == "bc_pharmasud"), doc),
        simple_order_lines(lines.where(f.isin("bc_avenir", "bc_omnipharm")), doc), unknown_lines(lines.where(~f.isin(*known))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: Vendor profiles in order of choice, with the words that show them and the family they lead to.
PROFILES = (
    ("avenir_medis", ("avenir", "rekik", "medis"), "bc_avenir"),
    ("omnipharm_medis", ("omnipharm", "medis"), "bc_omnipharm"),
    ("pharmasud_medis", ("pharmasud", "medis"), "bc_pharmasud"),
    ("modele_proforma", ("proforma", "modele", "medis"), "proforma_modele"),
)


def vendor_profile(header: Column, body: Column, file: Column) -> Column:
    """Profile with most of its words in the first 400 characters; the first of equals; null without any."""
    hay = F.lower(text.squeezed(F.concat_ws(" ", file, F.left(header, F.lit(400)), F.left(body, F.lit(400)))))
    scored = [F.struct(sum((F.contains(hay, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words, _) in enumerate(PROFILES)]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"])


def invoice_family(profile: Column, doc_type: Column, header: Column, body: Column, file: Column) -> Column:
    """The profile's family; a proforma has to say so; without a profile, words of the text decide."""
    hay = F.lower(text.squeezed(F.concat_ws(" ", file, F.left(header, F.lit(500)), F.left(body, F.lit(800)))))
    said = F.contains(F.lower(F.coalesce(doc_type, F.lit(""))), F.lit("proforma")) | F.contains(F.lower(F.left(body, F.lit(2500))), F.lit("proforma"))
    words = (
        F.when(F.contains(hay, F.lit("pharmasud")), "bc_pharmasud").when(F.contains(hay, F.lit("omnipharm")), "bc_omnipharm")
        .when(F.contains(hay, F.lit("avenir")) & F.contains(hay, F.lit("rekik")), "bc_avenir").when(F.regexp_like(hay, F.lit("pro ?forma")), "proforma_modele").otherwise("unknown")
    )
    mapped = F.create_map(*[F.lit(x) for name, _, family in PROFILES for x in (name, family)])[profile]
    return F.when(profile.isNull(), words).when((profile == "modele_proforma") & ~said, "unknown").otherwise(mapped)


def profile_score(profile: Column, doc_type: Column) -> Column:
    """0.7 when the profile knows the document type, else 0.6; null without a profile."""
    known = F.when(profile == "avenir_medis", doc_type.isin("Bon de Commande", "Proforma", "Facture", "Document")).when(profile == "modele_proforma", doc_type.isin("Proforma", "Document")).otherwise(doc_type.isin("Bon de Commande", "Facture", "Document"))
    return F.when(profile.isNotNull(), F.when(F.coalesce(known, F.lit(False)), 0.7).otherwise(0.6))


def richest_lines(lines: DataFrame, doc: str) -> DataFrame:
    """For each document and leading code the longest line, the first of equals."""
    own = lines.withColumn("code", F.upper(F.regexp_extract("raw_line", r"""(?i)^["']?([A-Z0-9]{4,14})\b""", 1))).where("code <> ''")
    return own.groupBy(doc, "code").agg(F.max_by("raw_line", F.struct(F.length("raw_line"), -F.col("line_no"))).alias("body_line"))


def recovered(items: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """Items without a quantity are read again from the richest body line of their code."""
    found = items.join(richest_lines(lines, doc), [doc, "code"], "left")
    use = F.when(numbers.has_positive_quantity(F.col("quantite")), F.col("raw_line")).otherwise(F.coalesce("body_line", "raw_line"))
    out = with_quantity(found.withColumn("__use", use), "__use")
    empty = ~numbers.has_positive_quantity(F.col("quantite"))
    return out.withColumn("quantite", F.when(empty, F.coalesce("q.quantity", "quantite")).otherwise(F.col("quantite"))).drop("__use", "body_line", "q")
