"""Lines against article and supplier reference tables: codes, prices, status, confidence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes, fuzzy, numbers, text

#: Fixed values of the scoring rules.
TOLERANCE = 0.001
VALID_SCORE, NO_QUANTITY_ORDER, NO_QUANTITY = 0.95, 0.68, 0.55
FIELD_SCORES = ("code", "code_pct", "code_article", "prix_unitaire", "quantite", "designation")


@dataclass(frozen=True)
class Settings:
    """Settings with their defaults."""

    confidence_threshold: float = 0.85
    min_review_score: float = 85.0
    allow_override: bool = True
    alert_enabled: bool = True
    alert_threshold_pct: float = 5.0

    @classmethod
    def merged(cls, given: dict | None) -> Settings:
        """Known keys of the given settings over the defaults; values of another type are ignored."""
        base = cls()
        ok = {k: type(getattr(base, k))(v) for k, v in (given or {}).items() if hasattr(base, k) and isinstance(v, (bool, int, float)) and isinstance(v, bool) == isinstance(getattr(base, k), bool)}
        return cls(**{**base.__dict__, **ok})


def articles(raw: DataFrame) -> DataFrame:
    """One row for each upper-trimmed code, the one with the largest IDArticle."""
    keyed = raw.select("IDArticle", codes.upper_trim(F.col("Code")).alias("key"), "LibProd", "PrixAchat").where("key <> ''")
    last = keyed.groupBy("key").agg(F.max_by(F.struct("IDArticle", "LibProd", F.coalesce(F.col("PrixAchat").cast("double"), F.lit(0.0)).alias("price")), "IDArticle").alias("a"))
    return last.select("key", "a")


def looked_up(lines: DataFrame, dim: DataFrame, most: int = 200_000, several: Column | None = None) -> DataFrame:
    """Adds ``ref`` (article found), ``mp_found`` and ``article_found``; needs the struct column ``codes``.

    The article code falls back to the primary code, the local code to a numeric primary. A dimension of at most ``most``
    rows, which are counted first, is broadcast, so the lines stay where they are. With a larger one every line moves once:
    a local or article code that equals the primary code adds nothing, so most lines need their primary code only. Lines
    with other codes besides are filtered out, their distinct groups of codes are looked up kind by kind, and join the
    dimension's own rows. Lines without a code are spread instead of meeting under one empty key. ``several`` may rule
    lines out before that by a plainer test.
    """
    if dim.limit(most + 1).count() <= most:
        return _fetched(lines, F.broadcast(dim))
    other = {k: F.when(F.col(f"codes.{k}") == F.col("codes.primary"), "").otherwise(F.col(f"codes.{k}")) for k in CODES[1:]}
    # no code begins with this character
    spread = F.concat(F.lit("\x00"), F.pmod(F.monotonically_increasing_id(), F.lit(256)).cast("string"))
    keyed = lines.withColumns({f"__{k}": c for k, c in other.items()} | {"__primary": F.coalesce(F.nullif(F.col("codes.primary"), F.lit("")), spread)})
    # pushed below whatever made the lines, this filter still works out the codes once
    differ = numbers._let(F.col("codes"), lambda c: reduce(Column.__or__, [(c[k] != "") & (c[k] != c["primary"]) for k in CODES[1:]]))
    mixed = lines.where(differ if several is None else several & differ).select(F.col("codes.primary"), *[c.alias(k) for k, c in other.items()]).distinct()
    groups = _fetched(mixed.select(F.struct(*CODES).alias("codes")), dim.hint("merge")).select(*[F.col(f"codes.{k}") for k in CODES], *FOUND)
    alone = dim.select(F.col("key").alias("primary"), F.lit("").alias("mp"), F.lit("").alias("article"), F.col("a").alias("ref"), codes.is_local_code(F.col("key")).alias("mp_found"), F.lit(True).alias("article_found"))
    side = alone.unionAll(groups).withColumnsRenamed({k: f"of_{k}" for k in CODES}).hint("merge")
    out = keyed.join(side, reduce(Column.__and__, [F.col(f"__{k}") == F.col(f"of_{k}") for k in CODES]), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in FOUND[1:]}).drop(*[f"{p}_{k}" for k in CODES for p in ("_", "of")])


#: Fields of the struct of codes, and what a lookup adds.
CODES, FOUND = ("primary", "mp", "article"), ("ref", "mp_found", "article_found")


def _fetched(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Each kind of code meets the dimension in a join of its own, by the strategy that ``dim`` is marked with."""

    def fetch(df: DataFrame, code: str) -> DataFrame:
        side = dim.select(F.col("key").alias("__key"), F.col("a").alias(f"by_{code}"))
        return df.join(side, F.nullif(F.col(f"codes.{code}"), F.lit("")) == F.col("__key"), "left").drop("__key")

    out = reduce(fetch, ("article", "mp", "primary"), rows)
    article = F.coalesce("by_article", "by_primary")
    mp = F.coalesce("by_mp", F.when(codes.is_local_code(F.col("codes.primary")), F.col("by_primary")))
    return out.withColumns({"ref": F.coalesce(article, mp), "mp_found": mp.isNotNull(), "article_found": article.isNotNull()}).drop("by_article", "by_mp", "by_primary")


def field_score(given: Column, line: Column, fields: Column | None = None) -> Column:
    """A19 and the given confidences: the first there is; else the least field confidence, else 1."""
    least = F.array_min(F.array_compact(F.array(*[fields[k] for k in FIELD_SCORES]))) if fields is not None else F.lit(None)
    return F.coalesce(given.cast("double"), line.cast("double"), least.cast("double"), F.lit(1.0))


def reconcile(lines: DataFrame, dim: DataFrame, settings: Settings | None = None) -> DataFrame:
    """R2: status, confidence, price and flags of ``lines``.

    Lines carry code, code_pct, code_article, designation, quantite (text), prix_unitaire and price_unit (double),
    confidence, line_confidence, field_confidence (map), doc_type, invoice_family; all else is passed through.
    """
    settings = settings or Settings()
    # named step by step, so that each rule is computed once; what only the line decides comes before the lookups, so that
    # texts that the result does not show are not moved
    own = lines.withColumns(
        {
            "codes": codes.resolved(F.col("code"), F.col("code_pct"), F.col("code_article")), "__order": text.is_order(F.col("doc_type"), F.col("invoice_family")),
            "__read": numbers.price_of_number(F.coalesce("price_unit", "prix_unitaire")), "__qty": numbers.price_of_text(F.col("quantite")), "__blank": text.stripped(F.col("designation")) == "",
        }
    )
    code, pct, art = (codes.upper_trim(F.col(k)) != "" for k in ("code", "code_pct", "code_article"))
    found = looked_up(own, dim, several=(code & pct) | (code & art) | (pct & art))
    ref, c = F.col("ref"), F.col("codes")
    known = ref.isNotNull()
    order, read, blank = F.col("__order"), F.col("__read"), F.col("__blank")
    found = found.withColumn("__fill", F.coalesce(read.isNull() & known & (order | numbers.price_of_number(F.col("prix_unitaire")).isNull()), F.lit(False)))
    fill, has_qty = F.col("__fill"), F.col("__qty").isNotNull()
    price = F.when(fill, ref["price"]).otherwise(read)
    ocr = F.when(~fill, read)
    coded = (c["primary"] != "") | (c["mp"] != "") | (c["article"] != "")
    mismatch = ocr.isNotNull() & known & (F.abs(ocr - ref["price"]) > TOLERANCE)
    price_ok = fill | (ocr.isNotNull() & ~mismatch) | (order & ocr.isNull())
    status = (
        F.when(~known & coded, "UNKNOWN_PRODUCT")
        .when(mismatch, "PRICE_MISMATCH")
        .when(blank | ~has_qty, "LOW_CONFIDENCE")
        .when(~known, "UNKNOWN_PRODUCT")
        .when(price_ok, "VALID")
        .when(ocr.isNull() & ~order, "UNKNOWN_PRODUCT")
        .otherwise("LOW_CONFIDENCE")
    )
    scored = F.when(blank, 0.0).when(~has_qty, F.when(order, NO_QUANTITY_ORDER).otherwise(NO_QUANTITY)).when(known, VALID_SCORE)
    score = F.coalesce(scored, field_score(F.col("confidence"), F.col("line_confidence"), F.col("field_confidence")))
    quantity = F.coalesce("__qty", F.lit(0.0))
    flags = F.array_compact(
        F.array(
            F.when(F.col("mp_found"), "mp_found").when(c["mp"] != "", "mp_missing"),
            F.when(F.col("article_found"), "article_found").when(c["article"] != "", "article_missing"),
            F.when(has_qty, "qty_present").otherwise("qty_missing"),
            F.when(blank, "designation_empty").otherwise("designation_present"),
        )
    )
    return found.withColumns(
        {
            "primary_code": c["primary"], "erp_price": ref["price"], "erp_name": ref["LibProd"], "id_article": ref["IDArticle"], "ocr_price": ocr, "display_price": price,
            "price_from_db": fill, "validation_status": F.when((status == "VALID") & (F.lit(VALID_SCORE) < settings.confidence_threshold), "LOW_CONFIDENCE").otherwise(status),
            "score": F.round(score, 3), "flags": flags, "qty": quantity, "computed_montant": F.when((quantity > 0) & price.isNotNull(), F.round(quantity * price, 3)),
        }
    ).drop("ref", "codes", "mp_found", "article_found", "__order", "__read", "__qty", "__blank", "__fill")


def _substrings(word: Column, least: int, most: int) -> Column:
    """All substrings of a word from ``least`` to ``most`` characters."""
    n = F.length(word)

    def at(i: Column) -> Column:
        longest = F.least(n - i + 1, F.lit(most))
        some = F.transform(F.sequence(F.lit(least), longest), lambda k: F.substring(word, i, k))
        return F.when(longest >= least, some).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)))


def matched_suppliers(invoices: DataFrame, suppliers: DataFrame, strict: bool = False) -> DataFrame:
    """The first supplier (by IDFournisseur) with the same tax id, whose name is inside the read name, or whose
    name holds a word of the read name longer than three letters. ``strict`` prefers tax id, then name, then word.

    All three tests are equality joins, each against one row for a tax id, a name or a part of a word that holds its
    first supplier: so a word that all suppliers share gives one row for a read name, not one for each supplier. Texts
    are cut to substrings no longer than the longest supplier name or read word (two scalars on the driver). Only
    distinct read names are matched.
    """
    inv = invoices.select("invoice_id", codes.supplier_name(F.col("supplier_name")).alias("n"), codes.upper_trim(F.col("supplier_mf")).alias("mf"))
    sup = suppliers.select("IDFournisseur", codes.supplier_name(F.col("Nom")).alias("nom"), codes.upper_trim(F.col("MF")).alias("smf"))
    first = F.min("IDFournisseur").alias("IDFournisseur")
    ids = sup.where("smf <> ''").groupBy(F.col("smf").alias("mf")).agg(first)
    by_mf = inv.where("mf <> ''").join(ids.hint("merge"), "mf").select("invoice_id", "IDFournisseur", F.lit(0).alias("kind"))
    read = inv.where("n <> ''").select("n").distinct()
    words = read.select("n", F.explode(F.array_distinct(F.split("n", " "))).alias("w")).where("length(w) > 3")
    named = sup.where("nom <> ''")
    longest_name = named.agg(F.max(F.length("nom"))).first()[0] or 0
    longest_word = words.agg(F.max(F.length("w"))).first()[0] or 0
    names = named.groupBy(F.col("nom").alias("w")).agg(first)
    inside = read.select("n", F.explode(_substrings(F.col("n"), 1, longest_name)).alias("w")).join(names.hint("merge"), "w").select("n", "IDFournisseur", F.lit(1).alias("kind"))
    parts = named.select("IDFournisseur", F.explode(F.split("nom", " ")).alias("x")).groupBy("x").agg(first)
    parts = parts.select("IDFournisseur", F.explode(_substrings(F.col("x"), 4, longest_word)).alias("w")).groupBy("w").agg(first)
    token = words.join(parts.hint("merge"), "w").select("n", "IDFournisseur", F.lit(2).alias("kind"))
    rank = F.struct("kind", "IDFournisseur") if strict else F.struct("IDFournisseur", "kind")
    found = inside.unionAll(token).groupBy("n").agg(F.min(rank).alias("r")).select("n", "r.IDFournisseur", "r.kind")
    by_name = inv.join(found.hint("merge"), "n").select("invoice_id", "IDFournisseur", "kind")
    best = by_mf.unionAll(by_name).groupBy("invoice_id").agg(F.min_by("IDFournisseur", rank).alias("IDFournisseur"))
    out = invoices.join(best, "invoice_id", "left").join(suppliers.select("IDFournisseur", F.col("Nom").alias("erp_supplier_name"), F.col("MF").alias("erp_supplier_mf"), F.col("Code").alias("erp_supplier_code")), "IDFournisseur", "left")
    return out.withColumn("supplier_status", F.when(F.col("IDFournisseur").isNull(), "SUPPLIER_UNKNOWN").otherwise("SUPPLIER_MATCH"))


def reconciled_documents(documents: DataFrame, lines: DataFrame, suppliers: DataFrame, dim: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with their matched supplier, and their lines reconciled under the documents' type and family.

    ``documents(invoice_id, supplier_name, supplier_mf, document_type, invoice_family, ...)``; a line's own doc_type
    or invoice_family, where it is not blank, comes before the document's.
    """
    heads = documents.select("invoice_id", F.col("document_type").alias("__type"), F.col("invoice_family").alias("__family"))
    own = lines.join(heads, "invoice_id", "left")
    own = own.withColumns({c: F.coalesce(numbers.blank_to_null(F.col(c)), F.col(d), F.lit("")) for c, d in (("doc_type", "__type"), ("invoice_family", "__family"))}).drop("__type", "__family")
    return matched_suppliers(documents, suppliers), reconcile(own, dim, settings)


#: Similarity from which a read designation is shown, and those of the text-match confidence.
SHOWN_SIMILARITY, SURE_RATIO, MATCH_SURE, MATCH_NOISY = 88, 0.82, 0.95, 0.72


def displayed(rows: DataFrame, read: str, reference: str, quantity: str) -> DataFrame:
    """Adds ``shown`` and ``match_confidence``.

    N12: the cleaned read text is shown unless it is noisy or under 88 like the cleaned reference text. N13: 0.95 for a
    read text without noise at least 82 % like the reference text, else 0.72.
    """
    none = F.lit(None).cast("string")
    cleaned, ref = (fuzzy.clean_designation(F.col(c), F.col(quantity), F.lit(False), none) for c in (read, reference))
    out = rows.withColumn("__t", F.explode(F.array(F.struct(cleaned.alias("read"), ref.alias("ref"), text.product_label(F.col(read)).alias("a"), text.product_label(F.col(reference)).alias("b")))))
    labels = F.explode(F.array(F.struct("__t.*", text.product_label(F.col("__t.read")).alias("c"), text.product_label(F.col("__t.ref")).alias("d"))))
    out = out.withColumn("__t", labels).withColumns({"__shown": fuzzy.similarity(F.col("__t.c"), F.col("__t.d")), "__whole": fuzzy.similarity(F.col("__t.a"), F.col("__t.b"))})
    t, plain = F.col("__t"), ~text.has_noise(F.col(read))
    keep = (t["ref"] == "") | (plain & (t["read"] != "") & (F.col("__shown") >= SHOWN_SIMILARITY))
    sure = plain & (t["a"] != "") & (t["b"] != "") & (F.col("__whole") >= 100 * SURE_RATIO)
    return out.withColumns({"shown": F.when(keep, t["read"]).otherwise(t["ref"]), "match_confidence": F.when(sure, MATCH_SURE).otherwise(MATCH_NOISY)}).drop("__t", "__shown", "__whole")


def canonical_lines(rows: DataFrame) -> DataFrame:
    """Extraction rows to canonical lines; of alias columns that are there, the first that is not blank."""

    def first(*names: str) -> Column:
        have = [numbers.blank_to_null(F.col(n).cast("string")) for n in names if n in rows.columns]
        return F.coalesce(*have, F.lit("")) if have else F.lit("")

    return rows.withColumns(
        {
            "designation": first("designation", "designation_article"), "quantite": numbers.coerced_quantity(first("quantite", "qty")), "prix_unitaire": first("prix_unitaire", "prix_unitaire_ht", "unit_price_ht"),
            "code": first("code"), "code_pct": first("code_pct"), "code_article": first("code_article"), "price_from_db": F.lit(False),
        }
    )


def edited_lines(lines: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Edits laid over lines; an edited price becomes the read price and is no longer from the reference."""
    e = edits.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("designation", "quantite", "price_unit")])
    out = lines.join(e, keys, "left")
    price = F.coalesce("__price_unit", "ocr_price", F.when(~F.col("price_from_db"), F.col("display_price")))
    return out.withColumns(
        {
            "designation": F.coalesce("__designation", "designation"), "quantite": F.coalesce("__quantite", "quantite"), "price_unit": F.lit(None).cast("double"), "prix_unitaire": price,
            "confidence": F.col("score"), "price_from_db": F.coalesce(F.col("price_from_db") & F.col("__price_unit").isNull(), F.lit(False)),
        }
    ).drop("__designation", "__quantite", "__price_unit", "primary_code", "erp_price", "erp_name", "id_article", "ocr_price", "display_price", "validation_status", "score", "flags", "qty", "computed_montant")


def numbered(lines: DataFrame, key: str = "invoice_id", order: str = "line_no") -> DataFrame:
    """Line order 1..n."""
    return lines.withColumn("ordre", F.row_number().over(Window.partitionBy(key).orderBy(order)))
