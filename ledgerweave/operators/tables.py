"""Table cells and word boxes to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import codes, dates, numbers, text
from ledgerweave.operators import provenance as V
from ledgerweave.operators.lines import plausible_in_document
from ledgerweave.sources.scratch import materialised

#: Each table column with the kind of its cells, the field it fills and the headers it goes by.
COLUMNS = {
    "code_pct": ("code", "code_pct", ("code pct", "code ptc", "pct", "code produit", "code", "code article local", "no article", "ref")),
    "code_article": ("code", "code_article", ("code article", "article code", "ref article", "reference article", "code frs", "code fourn")),
    "designation": ("text", "designation", ("designation", "designation article", "designation produit", "libelle", "article", "produit", "desig")),
    "unit": ("unit", "unite", ("un", "u", "unite", "unit", "u n", "conditionnement", "cond")),
    "quantity": ("integer", "quantite", ("qte", "qty", "quantite", "quantity", "qte cmde", "qtecmde", "qte commande", "qte ord", "quantite commande", "quantite commandee")),
    "nb_crt": ("integer", "nb_crt", ("nb crt", "nombre cartons", "nb carton", "nbre crt", "nbcrt")),
    "unit_price": ("money", "prix_unitaire", ("prix unitaire", "p u", "prix u", "pu", "unit price", "prix", "pu ht")),
    "amount": ("money", "montant", ("montant", "mt", "total ligne", "amount", "prix total", "montant ht", "mnt")),
    "date": ("date", "date_peremption", ("date p", "date peremption", "date limite", "dluo", "date exp", "expiry", "peremption")),
    "u_crt": ("integer", "u_crt", ("u crt", "unite carton", "unites par carton", "ucrt")),
    "promotion": ("text", "promotion", ("promotion", "promo")),
}
KINDS = ("code", "text", "unit", "integer", "money", "date")
LEAST_HEADER, LEAST_CELL, LEAST_CODE, SAMPLES = 0.42, 0.72, 0.55, 4


def header_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, text.ACCENTED, text.PLAIN)), "[^a-z0-9 ]", " "), r"\s+", " "))


def header_score(label: Column, words: str) -> Column:
    """1 for the same text, 0.85 when the words are inside, else the share of the words that occur. A label is words
    set apart by single blanks, so a word of it is looked for with a blank at either side."""
    want = sorted(set(words.split(" ")))
    found = sum((F.contains(F.concat(F.lit(" "), label, F.lit(" ")), F.lit(f" {w} ")).cast("int") for w in want), F.lit(0))
    return F.when(label == "", 0.0).when(label == words, 1.0).when(F.contains(label, F.lit(words)), 0.85).otherwise(found / len(want))


def cell_score(value: Column, kind: Column) -> Column:
    """How well a cell fits the kind of its column."""
    return _fit(text.stripped(value), kind)


def _fit(v: Column, kind: Column) -> Column:
    """``cell_score`` of a cell that is stripped."""

    def like(p: str) -> Column:
        return F.regexp_like(v, F.lit(p))

    number = like(r"\d")
    fit = (
        F.when(kind == "code", F.when(like(r"(?i)^([A-Z]{2,4}\d{2,12}|\d{4,6})$"), 1.0).when(like(r"^\d{5,8}$"), 0.95).otherwise(0.2))
        .when(kind == "integer", F.when(like(r"^\d{1,6}$"), 1.0).when(number, 0.3).otherwise(0.0)).when(kind == "money", F.when(like(r"^\d[\d\s]*[,.]\d{2,3}$"), 1.0).when(number, 0.5).otherwise(0.0))
        .when(kind == "date", dates.is_date_like(v).cast("double")).when(kind == "unit", F.when(like("^[A-Za-z]{1,5}$"), 0.9).otherwise(0.2)).otherwise(F.when(like("[A-Za-z]{3,}"), 1.0).otherwise(0.2))
    )
    return F.when(v == "", 0.0).otherwise(fit)


def mapped_headers(cells: DataFrame, keys: list[str], expected: tuple[str, ...] = ()) -> DataFrame:
    """(keys, col_idx, name, score) of the header cells (row 0) that name a column.

    A header scores by its words, by how the cells of the first four rows below fit the kind of the column, and by its
    place among the ``expected`` columns of a vendor, if given. From left to right each header takes the best of its
    four best columns that is still free and scores 0.42 or more. Scores are plain columns, the choice is a fold over
    the headers of one table; nothing is joined with the list of columns.
    """
    # tables share their headers, so each text is held against the columns once
    texts = cells.where("row_idx = 0 and text is not null").select("text").distinct().withColumn("__label", header_label(F.col("text")))
    known = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(n).alias("name"), F.lit(KINDS.index(k)).alias("kind"), F.array_max(F.array(*[header_score(F.col("__label"), w) for w in words])).alias("best")) for i, (n, (k, _, words)) in enumerate(COLUMNS.items())])
    known = materialised(texts.select("text", F.filter(known, lambda c: c["best"] > 0).alias("__known")), "headers-known")
    # the rows seen of a table are bits of a number
    below = cells.where((F.col("row_idx") > 0) & (F.col("row_idx") <= SAMPLES)).select(*keys, "col_idx", text.stripped(F.col("text")).alias("__v"), F.call_function("shiftleft", F.lit(1), F.col("row_idx").cast("int")).alias("__row"))
    fits = below.groupBy(*keys, "col_idx").agg(F.bit_or("__row").alias("__seen"), *[F.sum(_fit(F.col("__v"), F.lit(k))).alias(f"__{k}") for k in KINDS])
    heads = cells.where("row_idx = 0").join(known, "text").select(*keys, "col_idx", "__known")
    heads = heads.join(fits.hint("merge"), [*keys, "col_idx"], "full").select(*keys, "col_idx", "__known", "__seen", F.array(*[f"__{k}" for k in KINDS]).alias("__fits"))
    heads = heads.withColumn("__rows", F.bit_count(F.bit_or("__seen").over(Window.partitionBy(*keys)))).where("__known is not null")

    places = F.create_map(*[F.lit(x) for i, n in enumerate(expected) for x in (n, i)]) if expected else F.lit(None).cast("map<string, int>")

    def score(c: Column) -> Column:
        near = F.greatest(F.lit(0.0), F.lit(0.08) - F.abs(F.col("col_idx") - F.try_element_at(places, c["name"])) * 0.02)
        best = c["best"] + F.coalesce(near, F.lit(0.0)) if expected else c["best"]
        hits = F.coalesce(F.get("__fits", c["kind"]), F.lit(0.0)) / F.greatest(F.col("__rows"), F.lit(1))
        best = best + F.when(F.col("__rows").isNotNull(), F.least(F.lit(0.12), hits * 0.04)).otherwise(0.0)
        return F.struct(F.round(-best, 4).alias("s"), c["order"].alias("order"), c["name"].alias("name"))

    options = F.slice(F.sort_array(F.transform("__known", score)), 1, 4)
    ranked = heads.select(*keys, "col_idx", options.alias("o")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("col_idx", "o"))).alias("heads"))
    kind = "array<struct<col_idx: int, name: string, score: double>>"

    def take(chosen: Column, h: Column) -> Column:
        free = F.filter(h["o"], lambda o: (-o["s"] >= LEAST_HEADER) & ~F.exists(chosen, lambda c: c["name"] == o["name"]))
        mine = F.get(free, F.lit(0))
        return F.when(mine.isNull(), chosen).otherwise(F.concat(chosen, F.array(F.struct(h["col_idx"].cast("int").alias("col_idx"), mine["name"].alias("name"), (-mine["s"]).alias("score")))))

    return ranked.select(*keys, F.inline(F.aggregate("heads", F.array().cast(kind), take)))


def realigned(cells: DataFrame, keys: list[str], heads: DataFrame) -> DataFrame:
    """(keys, row_idx, named, row_text, alignment) of every row that holds text: its cells under the names of
    their columns. A name left blank takes the cell of the columns without a name that fits its kind best, each cell once,
    in the order of the columns; ``alignment`` is the mean fit of all names."""
    names = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col_idx", "name"))).alias("names"))
    cell = F.struct(F.col("col_idx").alias("i"), F.coalesce("text", F.lit("")).alias("raw"))
    rows = cells.where("row_idx > 0").groupBy(*keys, "row_idx").agg(F.sort_array(F.collect_list(cell)).alias("row"))
    # texts are stripped where they meet the names, so that they are moved once
    rows = rows.join(names.hint("merge"), keys).withColumn("row", F.transform("row", lambda c: F.struct(c["i"].alias("i"), text.stripped(c["raw"]).alias("v"), c["raw"].alias("raw"))))
    rows = rows.where(F.exists("row", lambda c: c["v"] != ""))
    kind_of = F.create_map(*[F.lit(x) for n, (k, _, _) in COLUMNS.items() for x in (n, k)])
    least = F.create_map(*[F.lit(x) for n, (k, _, _) in COLUMNS.items() for x in (n, LEAST_CODE if k == "code" else LEAST_CELL)])
    spare = F.filter("row", lambda c: (c["v"] != "") & ~F.exists("names", lambda n: n["col_idx"] == c["i"]))
    spare = F.transform(spare, lambda c: F.struct(c["i"].cast("int").alias("i"), c["v"].alias("v")))
    start = F.struct(spare.alias("spare"), F.array().cast("array<struct<key: string, value: string>>").alias("named"))

    def put(s: Column, n: Column) -> Column:
        def named(v: Column) -> Column:
            return F.concat(s["named"], F.array(F.struct(n["name"].alias("key"), v.alias("value"))))

        def found(best: Column) -> Column:
            fit = F.coalesce(best["s"] >= least[n["name"]], F.lit(False))
            left = F.filter(s["spare"], lambda c: c["i"] != -best["i"])
            return F.when(fit, F.struct(left.alias("spare"), named(best["v"]).alias("named"))).otherwise(F.struct(s["spare"].alias("spare"), named(F.lit("")).alias("named")))

        def own(v: Column) -> Column:
            # the spare cells are held against a name only where its own cell is blank
            fits = F.transform(s["spare"], lambda c: F.struct(_fit(c["v"], kind_of[n["name"]]).alias("s"), (-c["i"]).alias("i"), c["v"].alias("v")))
            return F.when((v != "") | (F.size(s["spare"]) == 0), F.struct(s["spare"].alias("spare"), named(v).alias("named"))).otherwise(numbers._let(F.array_max(fits), found))

        return numbers._let(F.coalesce(F.get(F.filter("row", lambda c: c["i"] == n["col_idx"]), F.lit(0))["v"], F.lit("")), own)

    rows = rows.select(*keys, "row_idx", F.array_join(F.transform("row", lambda c: c["raw"]), " ").alias("row_text"), F.aggregate("names", start, put)["named"].alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda a, c: a + _fit(c["value"], kind_of[c["key"]]))
    return rows.select(*keys, "row_idx", F.map_from_entries("n").alias("named"), "row_text", F.round(total / F.greatest(F.size("n"), F.lit(1)), 3).alias("alignment"))


def is_item_code(c: Column) -> Column:
    """Two to four letters and digits, or four to six digits."""
    return F.coalesce(F.regexp_like(codes.upper_trim(c), F.lit(r"^([A-Z]{2,4}\d{2,12}|\d{4,6})$")), F.lit(False))


def table_lines(cells: DataFrame, keys: list[str], doc_type: Column | None = None, profile: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(cell lines, rejected rows with reason) of ``cells(keys, row_idx, col_idx, text)`` whose row 0 is the header.

    A row with an item code is a line; one that only has an article code inherits the local code of the last line that
    had one (W2). The designation of other rows goes to the line before (W3), unless it holds an amount. Of equal lines
    the first stays (W4). Lines are (keys, line_no, cells, raw_line, locked, alignment), line_no being the row.
    """
    heads = materialised(mapped_headers(cells, keys), "headers")
    rows = realigned(cells, keys, heads)
    doc_type, profile = doc_type if doc_type is not None else F.lit(""), profile if profile is not None else F.lit("")

    def of(name: str) -> Column:
        return F.coalesce(F.try_element_at("named", F.lit(name)), F.lit(""))

    rows = rows.withColumns({n: of(n) for n in COLUMNS}).withColumn("__raw", F.left(F.trim("row_text"), F.lit(140)))
    w = Window.partitionBy(*keys).orderBy("row_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    amount = numbers.float_any_locale(F.col("amount"))
    rows = rows.withColumn("__amount", F.coalesce(F.when(amount > 0, F.format_string("%.4f", amount)), F.lit("")))
    # only lines of their own local code hand it on, the first of equal ones
    same = ["code_pct", "code_article", "__amount", "designation", "__raw"]
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, *same).orderBy("row_idx")))
    gives = (F.col("__rank") == 1) & is_item_code(F.col("code_pct"))
    rows = rows.withColumn("__last", F.last(F.when(gives, F.col("code_pct")), ignorenulls=True).over(so_far))
    inherits = (F.col("code_pct") == "") & (F.col("code_article") != "") & F.col("__last").isNotNull()
    pct = F.when(inherits, F.col("__last")).otherwise(F.col("code_pct"))
    found = F.upper(F.regexp_extract("row_text", r"(?i)\b([A-Z]{2,4}\d{2,12}|\d{4,8})\b", 1))
    code = F.coalesce(F.nullif(pct, F.lit("")), F.nullif(F.col("code_article"), F.lit("")), found)
    rows = rows.withColumns({"__pct": pct, "__inherits": inherits, "__code": code}).withColumn("__ok", is_item_code(F.col("__code")))
    # the code in front of a row's text is no part of a name; it has no character with a meaning in patterns
    tail = text.stripped(F.regexp_replace(F.col("row_text"), F.concat(F.lit("(?i)^\\s*"), F.when(F.col("__ok"), F.col("__code")).otherwise("x"), F.lit("\\b")), F.lit("")))
    name = F.when(F.length("designation") >= 2, F.col("designation")).otherwise(F.when(F.length(tail) >= 3, tail))
    rows = rows.withColumn("__name", name)
    again = F.row_number().over(Window.partitionBy(*keys, "__ok", "__pct", "code_article", "__amount", F.left(F.coalesce("__name", F.lit("")), F.lit(120)), "__raw").orderBy("row_idx"))
    rows = rows.withColumn("__again", again).withColumn("__line", F.col("__ok") & (F.col("__again") == 1))
    rows = rows.withColumn("__of", F.last(F.when(F.col("__line"), F.col("row_idx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    goes_on = ~F.col("__ok") & F.col("__of").isNotNull() & (F.length("designation") >= 3) & ~F.regexp_like("designation", F.lit(r"\d[\d\s]*[,.]\d{2,3}"))
    rows = rows.withColumn("__on", goes_on)
    more = rows.where("__on").groupBy(*keys, F.col("__of").alias("row_idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("row_idx").alias("at"), "designation"))).alias("__more"))
    lines = rows.where("__line").join(more.hint("merge"), [*keys, "row_idx"], "left")
    added = F.transform(F.coalesce("__more", F.array().cast("array<struct<at: int, designation: string>>")), lambda m: m["designation"])
    whole = F.array_join(F.concat(F.array(F.coalesce("__name", F.lit(""))), added), " ")
    lines = lines.withColumn("__whole", F.nullif(text.stripped(whole), F.lit("")))

    def made(value: Column, score: float, ok: Column | None = None) -> Column:
        return F.when(ok if ok is not None else value != "", V.cell(value, "table_structured", score))

    def number(c: str) -> Column:
        return numbers.float_any_locale(F.when(~dates.is_date_like(F.col(c)), F.col(c)))

    def carton(c: str) -> Column:
        v = number(c)
        return made(V.number_text(v), 0.84, (v > 0) & (v < 100_000))

    q, price = number("quantity"), numbers.float_any_locale(F.col("unit_price"))
    read = (F.col("quantity") != "") & ~dates.is_date_like(F.col("quantity"))
    counted = F.coalesce(read & plausible_in_document(q, F.coalesce("__name", F.lit("")), doc_type, profile), F.lit(False))
    fields = {
        "code": made(F.col("__code"), 0.95), "code_pct": F.when(F.col("__pct") != "", F.when(F.col("__inherits"), V.cell(F.col("__pct"), "inherited_pct", 0.65)).otherwise(V.cell(F.col("__pct"), "table_structured", 0.92))),
        "code_article": made(F.col("code_article"), 0.9), "designation": made(F.col("__whole"), 0.85, F.col("__whole").isNotNull()), "unite": F.when(F.col("unit") != "", V.cell(F.col("unit"), None, None)),
        "quantite": made(V.number_text(q), 0.88, counted), "qty": F.when(counted, V.cell(V.number_text(q), None, None)), "nb_crt": carton("nb_crt"), "u_crt": carton("u_crt"), "date_peremption": made(F.col("date"), 0.8),
        "promotion": made(F.col("promotion"), 0.8), "prix_unitaire": made(V.number_text(price), 0.9, price > 0), "montant": made(V.number_text(amount), 0.9, amount > 0),
    }
    out = lines.select(*keys, F.col("row_idx").alias("line_no"), V.cells(fields).alias("cells"), F.col("row_text").alias("raw_line"), counted.alias("locked"), "alignment")
    bad = rows.where("not __line").select(*keys, "row_idx", F.when(F.col("__on"), "continuation_merged").when(F.col("__ok"), "duplicate_row_key").otherwise("invalid_code").alias("reason"))
    odd = lines.where(read & ~counted).select(*keys, "row_idx", F.lit("invalid_qty").alias("reason"))
    return out, bad.unionByName(odd)


def layout_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of one printed line joined from left to right, with the line's centre."""
    parts = F.sort_array(F.collect_list(F.struct("left", "text")))
    return words.groupBy(*keys, "block", "par", "line").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("line_text"), ((F.min("left") + F.max(F.col("left") + F.col("width"))) / 2).alias("centre")
    )


def word_rows(words: DataFrame, keys: list[str], reach: int = 120, bin_px: int = 15) -> DataFrame:
    """Words below the first header row of a page, put into rows of 15 px and into the nearest header
    lane within 120 px (the left one of equals)."""
    bin_ = (F.floor(F.col("top") / bin_px) * bin_px).cast("int")
    # only words that are a header label count in the search for the header row, so the other words are moved once
    fields: dict[str, str] = {}
    for _, field, headers in COLUMNS.values():
        fields |= {h: field for h in headers if h not in fields}
    names = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    marked = words.where("top is not null").select(*keys, bin_.alias("bin"), "left", F.explode(F.array(header_label(F.col("text")))).alias("label"))
    marked = marked.where(F.col("label").isin(*fields)).select(*keys, "bin", F.struct(F.col("left").alias("x"), F.try_element_at(names, F.col("label")).alias("name")).alias("lane"))
    rows = marked.groupBy(*keys, "bin").agg(F.array_sort(F.collect_list("lane")).alias("lanes")).where(F.size("lanes") >= 2)
    heads = rows.groupBy(*keys).agg(F.min(F.struct(F.col("bin").alias("head"), "lanes")).alias("h")).select(*keys, "h.head", "h.lanes")
    own = words.select(*keys, bin_.alias("bin"), "left", "text")
    below = own.join(heads.hint("merge"), keys).where(F.col("bin") >= F.col("head") + bin_px)
    gaps = F.transform("lanes", lambda l: F.struct(F.abs(l["x"] - F.col("left")).alias("gap"), l["x"].alias("x"), l["name"].alias("name")))
    near = F.array_min(F.filter(gaps, lambda g: g["gap"] < reach))
    below = below.withColumn("lane", near["name"]).where("lane is not null")
    cell = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda p: p["text"]), " ")
    return below.groupBy(*keys, "bin", "lane").agg(cell.alias("cell"))


def discovered_vendors(headers: DataFrame) -> DataFrame:
    """Tax id to vendor name; the last file by name wins."""
    mf = codes.tax_id(F.regexp_extract("text", r"(?i)([0-9]{6,8}[/\s\-]*[A-Z][/\s\-]*[A-Z][/\s\-]*[A-Z][/\s\-]*[0-9]{3})\b", 1))
    first = F.trim(F.regexp_extract("text", r"(?m)^\s*([A-Za-z][^\n]{3,})$", 1))
    return headers.select(mf.alias("tax_id"), first.alias("name"), "file").where("tax_id is not null and name <> ''").groupBy("tax_id").agg(F.max_by("name", "file").alias("name"))


#: Lengths of a tax id with 6, 7 or 8 digits.
ID_LENGTHS = (15, 16, 17)


def known_vendor(documents: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendor whose tax id is inside the read tax id. Ids are 6 to 8 digits and 9 more characters long (see
    ``codes.tax_id``), so a substring join by equality takes three lengths; of several ids the smallest counts."""
    at = F.sequence(F.lit(1), F.greatest(F.length("read_id"), F.lit(1)))
    pieces = F.flatten(F.transform(at, lambda i: F.transform(F.array(*map(F.lit, ID_LENGTHS)), lambda n: F.substring(F.col("read_id"), i, n))))
    known = vendors.groupBy("tax_id").agg(F.min("name").alias("name")).hint("merge")
    hit = documents.select("doc_id", F.explode(F.array_distinct(pieces)).alias("tax_id")).join(known, "tax_id").groupBy("doc_id").agg(F.min(F.struct("tax_id", "name")).alias("v"))
    return documents.join(hit.select("doc_id", F.col("v.name").alias("vendor")).hint("merge"), "doc_id", "left")
