"""Product lines of free text by vendor row forms and numeric tails, and fields recovered from designations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import codes, dates, numbers, text
from ledgerweave.operators import provenance as V
from ledgerweave.operators.lines import first_of, plausible_in_document, with_quantity
from ledgerweave.operators.shapes import DATE, vendor_row
from ledgerweave.operators.tables import is_item_code

#: Forms of a code at the front, of an article code behind it, and of a price.
CODE_FRONT, ARTICLE_FRONT, PRICE = r"(?i)^([A-Z]{2,4}\d{2,12}|\d{4,6})", r"(?i)^([A-Z]{2,4}\d{5,12})\b", r"\b\d{1,6}[,.]\d{2,3}\b"
SOURCE = "ocr_fallback"


def _step(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns that the next step reads, each computed once."""
    return df.withColumns({f"__{k}": c for k, c in new.items()})


def _valid_date(c: Column, as_of: Column) -> Column:
    return F.when(c.isNotNull(), dates.validated_date(dates.repaired_date(c), as_of))


def _dated(d: Column, as_of: Column) -> tuple[Column, Column]:
    """(date, designation without it) of a designation that holds a valid date."""
    seen = F.nullif(F.regexp_extract(d, f"({DATE})", 1), F.lit(""))
    good = _valid_date(seen, as_of)
    return good, F.when(good.isNotNull(), text.stripped(F.replace(d, seen, F.lit(" ")))).otherwise(d)


def legacy_lines(lines: DataFrame, doc: str, as_of: Column, doc_type: Column | None = None, profile: Column | None = None) -> DataFrame:
    """Cell lines of ``lines(doc, line_no, raw_line)`` that begin with an item code.

    What follows the code, and an article code behind it, is read by the vendor's row form; without a quantity the
    position of numbers decides (T9), then the numbers at the end: tokens from the right are taken while they are whole
    numbers of up to five digits, up to a price, and the leftmost of them is the quantity. Dates and carton counts come
    from the row form or the designation. The first of equal lines stays (W4).
    """
    doc_type, profile = doc_type if doc_type is not None else F.lit(""), profile if profile is not None else F.lit("")
    own = lines.select(doc, "line_no", text.stripped(F.regexp_replace(text.stripped(F.col("raw_line")), r"^[|.\-\s]+", "")).alias("__line"), doc_type.alias("__type"), profile.alias("__profile"))
    own = _step(own, {"front": F.regexp_extract("__line", CODE_FRONT, 1)}).where((F.length("__line") >= 5) & (F.col("__front") != ""))
    own = _step(own, {"code": codes.normalized_code(F.col("__front")), "rest": text.stripped(F.substr("__line", F.length("__front") + 1))})
    own = own.where(is_item_code(F.col("__code")) & (F.length("__rest") >= 2))
    own = _step(own, {"article": F.regexp_extract("__rest", ARTICLE_FRONT, 1)})
    behind = text.stripped(F.ltrim(text.stripped(F.substr("__rest", F.length("__article") + 1)), F.lit("-")))
    own = _step(own, {"rest": F.regexp_replace(F.when(F.col("__article") != "", behind).otherwise(F.col("__rest")), r"^[|.'\"()\[\]\-_\s]+", "")})
    own = _step(own.where("__rest <> ''"), {"row": vendor_row(F.col("__rest"), F.col("__profile"))})
    own = _step(own, {"d": F.coalesce("__row.designation", F.lit("")), "n": numbers.float_any_locale(F.col("__row.quantite"))})
    # the position of numbers is only asked for where the row form gave no quantity
    read = with_quantity(own.withColumns({"__none": F.lit(""), "__raw": F.when(F.col("__n").isNull(), F.col("__rest"))}), raw="__raw", code="__none")

    def ok(q: Column, d: Column) -> Column:
        return F.coalesce(plausible_in_document(q, d, F.col("__type"), F.col("__profile")), F.lit(False))

    found = F.col("q.quantity").try_cast("double")
    taken = F.col("__n").isNull() & ok(found, F.col("q.rest"))
    read = _step(read, {"n": F.when(taken, found).otherwise(F.col("__n")), "d": F.when(taken & (F.col("__d") == ""), F.col("q.rest")).otherwise(F.col("__d"))}).drop("q")
    at = F.regexp_instr("__rest", F.lit(PRICE))
    part = text.squeezed(F.when(at > 0, F.substr(F.col("__rest"), F.lit(1), at - 1)).otherwise(F.col("__rest")))
    # the numbers at the end are only looked for where there is no designation yet
    read = _step(read, {"part": F.when(F.col("__d") == "", part)})
    read = _step(read, {"tail": F.regexp_extract(F.concat(F.lit(" "), F.col("__part")), r"((?: \d{1,5})*)$", 1)})
    bare = text.stripped(F.left(F.col("__part"), F.greatest(F.length("__part") - F.length("__tail"), F.lit(0))))
    first = F.nullif(F.regexp_extract("__tail", r"(\d+)", 1), F.lit("")).try_cast("double")
    open_ = F.col("__d") == ""
    read = _step(read, {"n": F.when(open_ & F.col("__n").isNull() & ok(first, bare), first).otherwise(F.col("__n")), "d": F.when(open_, bare).otherwise(F.col("__d"))})
    read = read.where(F.length("__d") >= 3)

    c = F.col("__code")
    local = F.regexp_like(c, F.lit(r"^\d{4,8}$"))
    article = ~local & (F.startswith(c, F.lit("PF")) | (F.length(c) >= 9) & F.regexp_like(c, F.lit(r"^[A-Z]{2,4}\d{5,12}$")))
    inside = F.nullif(F.regexp_extract("__line", r"\b(\d{5,8})\b", 1), F.lit(""))
    second = codes.normalized_code(F.col("__article"))
    pct = F.when(local, c).when(article, inside)
    counted = ok(F.col("__n"), F.col("__d"))
    late, shorter = _dated(F.col("__d"), as_of)
    read = _step(read, {"date": _valid_date(F.col("__row.date_peremption"), as_of), "late": late})
    date, late = F.col("__date"), F.col("__late")
    shorter = F.when(late.isNotNull(), shorter).otherwise(F.col("__d"))
    nb = numbers.float_any_locale(F.col("__row.nb_crt"))
    q = V.number_text(F.col("__n"))
    made = {
        "code": V.cell(F.coalesce(pct, F.when(article, c), c), SOURCE, 0.85), "code_pct": F.when(pct.isNotNull(), V.cell(pct, SOURCE, F.when(local, 0.86).otherwise(0.68))),
        "code_article": F.when((F.col("__article") != "") & is_item_code(second), V.cell(second, SOURCE, 0.72)).when(article, V.cell(c, SOURCE, 0.82)),
        "designation": V.cell(F.when(date.isNull(), shorter).otherwise(F.col("__d")), SOURCE, 0.7), "quantite": F.when(counted, V.cell(q, SOURCE, 0.85)), "qty": F.when(counted, V.cell(q, None, None)),
        "date_peremption": F.when(date.isNotNull(), V.cell(date, SOURCE, 0.7)).when(late.isNotNull(), V.cell(late, None, None)), "nb_crt": F.when((nb > 0) & (nb < 2000), V.cell(V.number_text(nb), SOURCE, 0.7)),
    }
    out = V.with_made(read, [doc, "line_no", F.col("__line").alias("raw_line"), counted.alias("locked")], made).select(doc, "line_no", "cells", "raw_line", "locked")
    out = counted_from_row(out).where(V.value(F.col("cells"), "designation") != "")
    key = codes.merge_key(*[V.value(F.col("cells"), f) for f in ("code", "code_pct", "code_article")], F.lit(None).cast("double"), V.value(F.col("cells"), "designation"), F.col("raw_line"))
    return first_of(out, doc, key)


def counted_from_row(rows: DataFrame) -> DataFrame:
    """Lines that are not locked take the quantity that their raw text shows behind the code (T9), which locks them; what
    stands behind it becomes the designation."""
    keep = rows.columns
    # a locked line has nothing to read
    read = with_quantity(rows.withColumns({"__code": V.code_of(F.col("cells")), "__raw": F.when(~F.col("locked"), F.nullif(F.col("raw_line"), F.lit("")))}), raw="__raw", code="__code")
    found = ~F.col("locked") & (F.col("__code") != "") & (F.col("raw_line") != "") & F.col("q.quantity").isNotNull()
    own = F.try_element_at("cells", F.lit("designation"))
    fixed = V.locked_cells(F.col("cells"), F.col("q.quantity"), F.col("q.source"), F.col("q.score"))
    named = V.with_cells(fixed, {"designation": F.when(F.col("q.rest") != "", V.cell(F.col("q.rest"), own["source"], own["score"]))})
    return read.withColumn("cells", F.when(found, named).otherwise(F.col("cells"))).withColumn("locked", F.col("locked") | found).select(*keep)


def recovered_fields(lines: DataFrame, as_of: Column, doc_type: Column | None = None, profile: Column | None = None) -> DataFrame:
    """Quantity, date and carton count of cell lines that lack them, out of the raw text and the designation, which
    loses what was read. A quantity read from the designation is not locked."""
    doc_type, profile = doc_type if doc_type is not None else F.lit(""), profile if profile is not None else F.lit("")
    keep = lines.columns
    out = counted_from_row(lines)
    out = _step(out, {"d": V.value(F.col("cells"), "designation"), "none": F.lit(""), "type": doc_type, "profile": profile})
    read = with_quantity(out, raw="__d", code="__none")

    def ok(q: Column, d: Column) -> Column:
        return F.coalesce(plausible_in_document(q, d, F.col("__type"), F.col("__profile")), F.lit(False))

    missing = ~V.has_quantity(F.col("cells")) & (F.col("__d") != "")
    q, front = F.col("q.quantity").try_cast("double"), r"^\s*(\d{1,5})(?:[,.]\d+)?\s+(.+)$"
    lead, behind = F.regexp_extract("__d", front, 1).try_cast("double"), text.stripped(F.regexp_extract("__d", front, 2))
    by_place, by_front = missing & q.isNotNull() & ok(q, F.col("q.rest")), missing & q.isNull() & ok(lead, behind)
    read = _step(read, {"n": F.when(by_place, q).when(by_front, lead), "by": by_place, "d": F.when(by_place, F.col("q.rest")).when(by_front, behind).otherwise(F.col("__d"))}).drop("q")
    late, shorter = _dated(F.col("__d"), as_of)
    undated = V.value(F.col("cells"), "date_peremption") == ""
    read = _step(read, {"date": F.when(undated, late), "d": F.when(undated, shorter).otherwise(F.col("__d"))})
    nb = F.nullif(F.regexp_extract("__d", r"[| ]+(\d{1,4})\s*$", 1), F.lit("")).try_cast("double")
    cartons = (V.value(F.col("cells"), "nb_crt") == "") & F.coalesce((nb > 0) & (nb < 2000), F.lit(False))
    read = _step(read, {"nb": F.when(cartons, nb), "d": F.when(cartons, text.stripped(F.regexp_replace("__d", r"[| ]+\d{1,4}\s*$", ""))).otherwise(F.col("__d"))})
    clean = F.btrim(F.regexp_replace(F.regexp_replace("__d", r"\s*[|]+\s*", " "), r"\s{2,}", " "), F.lit(" -_|"))
    held = F.try_element_at("cells", F.lit("designation"))
    count = F.when(F.col("__by"), V.cell(V.number_text(F.col("__n")), "qty_recovered_designation", 0.84)).otherwise(V.cell(V.number_text(F.col("__n")), None, None))
    new = {
        "designation": F.when(held.isNotNull() & (V.value(F.col("cells"), "designation") != ""), V.cell(clean, held["source"], held["score"])), "quantite": F.when(F.col("__n").isNotNull(), count),
        "date_peremption": F.when(F.col("__date").isNotNull(), V.cell(F.col("__date"), None, None)), "nb_crt": F.when(F.col("__nb").isNotNull(), V.cell(V.number_text(F.col("__nb")), None, None)),
    }
    return read.withColumn("cells", V.with_cells(F.col("cells"), new)).select(*keep)
