"""Golden lines, truth tables and quirks."""

import datetime
import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import codes, dates, fuzzy, numbers, text
from ledgerweave.operators import gate, rollup
from ledgerweave.operators import lines as L
from ledgerweave.operators import quality as Q
from ledgerweave.operators import reconcile as R
from ledgerweave.operators import reports as P
from ledgerweave.operators import workflow as W
from ledgerweave.sources import files


def table(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def applied(spark, f, values, kind="string"):
    return [r[0] for r in table(spark, values, kind).select(f(F.col("v")).alias("r"), "i").orderBy("i").collect()]


def test_money_and_quantities(spark):
    assert applied(spark, numbers.price_of_text, ["1 234,5", "12.5", "1.234.5", "0", "-3", "100000", "ND", "—", " ", None, "abc", "99999"]) == [1234.5, 12.5, 1234.5, None, None, None, None, None, None, None, None, 99999.0]
    assert applied(spark, numbers.float_any_locale, ["1,234.56", "1.234,56", "12,5", "1,2345", "x", None, "7 DT"]) == [1234.56, 1234.56, 12.5, 12345.0, None, None, 7.0]
    assert applied(spark, numbers.french_money, ["1 234,56", "1234.5", "12", "l23,4O", "1 23,4"]) == [1234.56, 1234.5, None, 123.4, 123.4]
    assert applied(spark, numbers.coerced_quantity, ["24", "24,0", "2,5", "", None, "x1"]) == ["24", "24", "2.5", "", "", "x1"]
    assert applied(spark, numbers.money_text, [1.5, 2.0, 1234.56789, None], "double") == ["1.5", "2", "1234.56789", None]


def test_codes(spark):
    assert applied(spark, codes.normalized_code, ["ff-0001", "PFO12", "PF1OISB", "302970", "", None, "§12"]) == ["PF0001", "PF012", "PF10158", "302970", "", "", "12"]
    assert applied(spark, codes.product_code, ["12345", "12345678", "PF0001234567", "1234567"]) == ["012345", "123456", "PF000123456", "1234567"]
    assert applied(spark, codes.tax_id, ["1234567 A/P/M/000", "l234567APM000", "12/3", None]) == ["1234567A/P/M/000", "1234567A/P/M/000", None, None]
    assert applied(spark, codes.invoice_key, ["N° 12-34/2024", "none", None]) == ["OCR-12342024", "OCR-1", "OCR-1"]
    assert applied(spark, codes.supplier_name, ["Sté  Médis-Co.", None]) == ["ST M DIS CO", ""]


def test_dates(spark):
    day = datetime.date(2024, 2, 1)
    assert applied(spark, dates.invoice_date, ["01/02/2024", "2024-02-01 10:00", "01-02-2024", "2/30", None]) == [day, day, day, None, None]
    assert applied(spark, lambda c: dates.validated_date(c, F.lit("2024-06-01").cast("date")), ["31/12/2023", "12/31/2023", "32/01/2020", "01/13/2020", "01/01/2030", "1-1-2025", "31/02/2024", "1/20/2999", "45/13/2020"]) == ["31/12/2023", "31/12/2023", None, "13/01/2020", None, "01/01/2025", None, "20/1/2999", None]
    assert applied(spark, dates.checked_expiry, ["1/2/2026", "99/99/2026"]) == ["01/02/2026", "99/99/2026"]


def test_text(spark):
    assert applied(spark, text.product_label, [" - Crème  À 5% ", None]) == ["CREME A 5", ""]
    assert applied(spark, text.edges_cleaned, ["## DRUG  10 ~~", "!x"]) == ["DRUG 10", "x"]
    assert applied(spark, text.line_cleaned, ["a (b) [c]_ 5€"]) == ["a c 5"]
    assert applied(spark, text.text_repaired, ["F A C T U R E no 1l2(cid:7)", "on de commande", "A|B 3°o"]) == ["FACTURE no 112", "Bon de commande", "A B 30"]
    assert applied(spark, text.document_type, ["Bon de commande n° 2", "PROFORMA facture", "rien", None]) == ["Bon de Commande", "Proforma", "Document", "Document"]
    assert applied(spark, lambda c: text.is_order(c, F.lit("")), ["Bon de Commande", "abcd", "Facture", None]) == [True, True, False, False]
    assert applied(spark, text.has_noise, ["AMLODIPINE 10 MG", "24 AMLODIPINE", "10 MG", '"x', "", "DRUG >."]) == [False, True, True, True, False, True]


def test_similarity():
    assert fuzzy.token_set_ratio("AMLODIPINE MEDIS 10", "MEDIS AMLODIPINE 10 MG") == 100.0
    assert fuzzy.indel_ratio("abcd", "abxd") == 75.0
    assert fuzzy.partial_ratio("facture", "une facture de") == 100.0


def parsed(spark, f, *raw):
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(raw)], "doc int, line_no int, raw_line string")
    return [r.asDict() for r in f(df, "doc").orderBy("line_no").collect()]


def test_golden_order_lines(spark):
    got = parsed(spark, L.simple_order_lines, "301500 216 ADEX LP 1.5MG B/30 CP", "302970 24 7 AMLODIPINE MEDIS 10 MG B/30 COMP", "Total HT 12", "301500 216 ADEX LP 1.5MG B/30 CP")
    assert [(r["code"], r["quantite"]) for r in got] == [("301500", "216"), ("302970", "24")]
    got = parsed(spark, L.dated_order_lines, "AB1234  PARACETAMOL 500MG  48  2  31/12/2026  24")
    assert [(r["code_pct"], r["date_peremption"], r["quantite_commande"], r["nb_cartons"], r["unite_carton"], r["designation"]) for r in got] == [("AB1234", "31/12/2026", "48", "2", "24", "PARACETAMOL 500MG")]


def test_golden_proforma_lines(spark):
    got = parsed(
        spark, L.proforma_lines, "352730 PF000400001 DMAX 200000 U UML AMP 12 1 234,56 14 567,89", "352730 PF009900011 SOME PRODUCT NAME WITHOUT VALID MONEY TRAILER",
        "123,45 352730 PF000400001 DMAX 12 1 234,56 14 567,89", "Total HT 1 234,56 TVA 560,12 Montant TTC 1 794,68", "352730 PF000400001 DMAX 200000 U 12 1234.56 7890.12",
    )
    assert [(r["code_pct"], r["code_article"], r["quantite"], r["prix_unitaire"], r["montant"]) for r in got] == [
        ("352730", "PF000400001", "12", "1234,56", "14567,89"), ("352730", "PF009900011", "", "", ""), ("352730", "PF000400001", "12", "1234,56", "14567,89"), ("352730", "PF000400001", "12", "1234.56", "7890.12"),
    ]


def test_status_truth_table(spark):
    """Every combination of code, price, text, quantity and document type against the rules written out."""
    dim = R.articles(spark.createDataFrame([(1, " 302970 ", "OLD", 9.0), (7, "302970", "AMLODIPINE", 12.5)], "IDArticle int, Code string, LibProd string, PrixAchat double"))
    cases = list(itertools.product(["302970", "999999", ""], [None, 12.5, 13.0], ["X DRUG", " "], ["24", "", "0"], ["Facture", "Bon de Commande"]))
    rows = [(i, c, "", "", d, q, p, None, None, 0.7, None, t, "") for i, (c, p, d, q, t) in enumerate(cases)]
    schema = "invoice_id int, code string, code_pct string, code_article string, designation string, quantite string, prix_unitaire double, price_unit double, confidence double, line_confidence double, field_confidence map<string,double>, doc_type string, invoice_family string"
    out = {r.invoice_id: r for r in R.reconcile(spark.createDataFrame(rows, schema), dim).collect()}
    for i, (c, p, d, q, t) in enumerate(cases):
        known, order, qty = c == "302970", t != "Facture", q == "24"
        ocr = p
        if not known and c:
            want = "UNKNOWN_PRODUCT"
        elif ocr is not None and known and abs(ocr - 12.5) > 0.001:
            want = "PRICE_MISMATCH"
        elif not d.strip() or not qty:
            want = "LOW_CONFIDENCE"
        elif not known:
            want = "UNKNOWN_PRODUCT"
        else:
            want = "VALID"
        score = 0.0 if not d.strip() else (0.68 if order else 0.55) if not qty else 0.95 if known else 0.7
        assert (out[i].validation_status, out[i].score) == (want, score), cases[i]
        assert out[i].price_from_db == (known and p is None)
    assert {r.validation_status for r in out.values()} == {"VALID", "UNKNOWN_PRODUCT", "PRICE_MISMATCH", "LOW_CONFIDENCE"}


def test_settings_keep_their_types():
    s = R.Settings.merged({"confidence_threshold": 0.9, "allow_override": "yes", "min_review_score": 70, "other": 1})
    assert (s.confidence_threshold, s.allow_override, s.min_review_score) == (0.9, True, 70.0)


def test_supplier_scan_takes_the_first_match(spark):
    sup = spark.createDataFrame([(1, "A", "MEDIS", ""), (2, "B", "OTHER GROUP", "1234567A/P/M/000")], "IDFournisseur int, Code string, Nom string, MF string")
    inv = spark.createDataFrame([(1, "Labo Medis Sa", "1234567a/p/m/000"), (2, "", ""), (3, "group of x", ""), (4, "XMEDISY", ""), (5, "a GROU b", ""), (6, "med is", "")], "invoice_id int, supplier_name string, supplier_mf string")
    assert sorted((r.invoice_id, r.IDFournisseur) for r in R.matched_suppliers(inv, sup).where("IDFournisseur is not null").collect()) == [(1, 1), (3, 2), (4, 1), (5, 2)]
    assert R.matched_suppliers(inv, sup, strict=True).where("invoice_id = 1").first().IDFournisseur == 2


def test_moves_and_posting_repeat(spark):
    events = spark.createDataFrame([(1, 1, 1, "pending"), (2, 1, 2, "held"), (3, 1, 3, "posted"), (4, 1, 4, "held"), (5, 2, 1, "held")], "event_id int, submission_id int, event_at int, state string")
    assert [r.legal for r in W.judged_moves(events).orderBy("event_id").collect()] == [True, True, True, False, False]
    again = spark.createDataFrame([(1, 1, 1, "pending"), (2, 1, 2, "held"), (3, 1, 3, "held"), (4, 1, 4, "pending")], "event_id int, submission_id int, event_at int, state string")
    assert all(r.legal for r in W.judged_moves(again).collect())


def test_exports_and_commit_marker(spark, tmp_path):
    doc = {"schema_version": 2, "invoice_family": "bc_avenir", "line_items": [{"code": "1", "quantite": "2", "line_confidence": 0.5}, {"code": "3"}]}
    (tmp_path / "a_data.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(doc).encode())
    (tmp_path / "b_data.json").write_text('{"line_items": [{"code": "9"}]}')
    rows = files.extraction_exports(spark, str(tmp_path / "*.json")).orderBy("file", "line_no").collect()
    assert [(r.file, r.schema_version, r.code) for r in rows] == [("a_data.json", 2, "1"), ("a_data.json", 2, "3"), ("b_data.json", 1, "9")]
    t = spark.range(3)
    files.write_extraction({"facture": t, "metadata": t.limit(1)}, str(tmp_path / "out"), "b1")
    t.write.parquet(str(tmp_path / "out/facture/batch=b2"))
    assert files.committed(spark, str(tmp_path / "out"), "facture").count() == 3
    lines = spark.createDataFrame([("d", "bc_avenir", 0, "1", "", 0.5)], "doc string, invoice_family string, line_no int, code string, quantite string, line_confidence double")
    files.write_exports(lines, ["doc"], str(tmp_path / "exp"))
    assert "quantite" not in spark.read.text(str(tmp_path / "exp")).first().value


@pytest.mark.parametrize(("zone", "want"), [("header", "a\n\nb"), ("body", "a\nb")])
def test_document_texts(spark, zone, want):
    pages = spark.createDataFrame([(1, 2, zone, "b"), (1, 1, zone, "a")], "doc int, page int, zone string, text string")
    assert files.document_texts(pages, "doc").first().text == want


def test_large_dimensions_give_the_same_articles(spark):
    dim = R.articles(spark.createDataFrame([(i, f"3000{i:02d}", "P", 1.0) for i in range(30)] + [(99, "PF00000001", "Q", 2.0)], "IDArticle int, Code string, LibProd string, PrixAchat double"))
    rows = [(i, f"3000{i:02d}" if i % 3 else "", "" if i % 4 else f"3000{(i + 1) % 30:02d}", "PF00000001" if i % 5 == 0 else "") for i in range(60)]
    own = spark.createDataFrame(rows, "i int, code string, code_pct string, code_article string").withColumn("codes", codes.resolved(F.col("code"), F.col("code_pct"), F.col("code_article")))
    small, large = ([tuple(r) for r in R.looked_up(own, dim, most).orderBy("i").collect()] for most in (1000, 3))
    assert small == large and len({str(r) for r in small}) == 60


def test_invoice_status_truth_table(spark):
    """Open alerts and price gaps, then low confidence and unknown products; unchecked lines change nothing."""
    cases = list(itertools.product([0, 2], repeat=5))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n_price_mismatch int, n_low_confidence int, n_unknown_product int, n_unchecked int, alerts int")
    got = [r[0] for r in df.orderBy("i").select(rollup.invoice_status(F.col("alerts"))).collect()]
    assert got == ["DISCREPANCY" if gap or alerts else "NEEDS_REVIEW" if low or unknown else "VALIDATED" for gap, low, unknown, _, alerts in cases]
    assert {r[0] for r in df.where("n_price_mismatch + n_low_confidence + n_unknown_product = 0").select(rollup.invoice_status()).collect()} == {"VALIDATED"}


def test_a_line_is_posted_once(spark):
    """Two articles of one code, lower case in the line: the article dimension counts."""
    articles = R.articles(spark.createDataFrame([(1, "A1", "OLD", 9.0), (7, "a1 ", "NEW", 5.0)], "IDArticle int, Code string, LibProd string, PrixAchat double"))
    heads = spark.createDataFrame([(1, "OCR-1", 0.0)], "invoice_id int, lib_facture string, stated_total double")
    lines = spark.createDataFrame([(1, 1, "a1", "X", 2, 5.0, None, "VALID", None, None, 0.9)], "invoice_id int, line_no int, code string, designation string, qty int, display_price double, id_article int, validation_status string, ocr_price double, erp_price double, score double")
    t = W.posted_tables(heads, lines, articles, spark.createDataFrame([], "lib_facture string"))
    assert [(r.IDArticle, float(r.Quantite)) for r in t["lignefac"].collect()] == [(7, 2.0)]
    r = t["facture"].first()
    assert float(r.TotalHT) == 10.0 and r.IDFacture >= 0


def test_kpis_without_runs(spark):
    runs = spark.createDataFrame([("FAILED", 2, 100, 1, 0)], "status string, page_count int, duration_ms int, valid_count long, line_count long")
    assert P.kpis(runs, spark.range(3), spark.range(0)).first().asDict() == {"n_runs": 0, "seconds_a_page": 0.0, "valid_pct": 0.0, "n_invoices": 3, "open_alerts": 0}


def test_version_1_rates(spark):
    rows = [(1, "", "x", "", "DRUG | 12"), (1, "None", "—", "1/1", None), (2, " 5", "nan", None, "A 01.02.25 B")]
    df = spark.createDataFrame(rows, "doc int, quantite string, code_article string, date_peremption string, designation string")
    got = {r.doc: tuple(r)[1:] for r in Q.version_1_rates(df, "doc").collect()}
    assert got == {1: (2, 1.0, 0.5, 0.5, 0.5), 2: (1, 0.0, 1.0, 1.0, 1.0), None: (3, 0.6667, 0.6667, 0.6667, 0.6667)}
    assert [tuple(r) for r in Q.version_1_rates(df.limit(0), "doc").collect()] == [(None, 0, 0.0, 0.0, 0.0, 0.0)]


def test_gate_quantities(spark):
    cases = [
        (12.0, "DRUG 12 MG", "", False), (5.0, "DRUG 12.5 MG", "", False), (2.5, "X 2.5 ML", "", False), (12.0, "DRUG 112 MG", "", True), (40.0, "DRUG 40 mcg", "", False), (7.0, "IN 7 IU", "", False),
        (1950.0, "D", "", False), (2101.0, "D", "", True), (6001.0, "D", "Facture", False), (6001.0, "D", "PROFORMA x", True), (10001.0, "D", "proforma", False), (3.0, "le montant", "", False), (3.0, "WEIGHT", "", False),
        (3.0, "HTX", "", True), (0.0, "D", "", False), (None, "D", "", False), (5000.0, "VIT 5000 (5000 IU)", "", False), (5.0, None, None, True),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q double, d string, t string, want boolean")
    got = [(r.i, r.ok) for r in df.orderBy("i").select("i", gate.plausible(F.col("q"), F.col("d"), F.col("t")).alias("ok")).collect()]
    assert got == [(i, c[3]) for i, c in enumerate(cases)]


def test_gate_rows(spark):
    rows = [("", "123456", "d", "5", "2", "20", ""), ("12", "PF00123456789", "DRUG B/30 COMP", "abc", "-1", "x", ""), ("", "AB", "d", "5", "2", "10.1", "")]
    df = spark.createDataFrame(rows, "code_pct string, code_article string, designation string, quantite string, prix_unitaire string, montant string, doc_type string")
    got = [tuple(r)[:6] for r in gate.checked(df).select("code_pct", "code_article", "designation", "quantite", "prix_unitaire", "montant").collect()]
    assert got == [("123456", "", "d", 5.0, None, None), ("12", "PF001234567", "DRUG B/30 COMP", None, None, None), ("", "", "d", 5.0, 2.0, 10.1)]


def plain_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200.0 * table[-1][-1] / (len(a) + len(b))


def plain_partial(a, b):
    """Every window of the shorter text's length, and the shorter windows over either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    best = max(plain_ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))
    return max(best, max(plain_ratio(b, a[max(0, i) : i + len(b)]) for i in range(1 - len(b), len(a)))) if len(a) == len(b) else best


def test_bit_steps_equal_the_table():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc é", k=rng.randint(0, n))) for n in (12, 30))
        assert not a + b or abs(fuzzy.indel_ratio(a, b) - plain_ratio(a, b)) < 1e-9
        assert abs(fuzzy.partial_ratio(a, b) - plain_partial(a, b)) < 1e-9, (a, b)
    long = "ab" * 50
    assert fuzzy.partial_ratio(long, "x" + long) == 100.0


def test_document_types_by_brute_force(spark):
    from ledgerweave.plans import documents as D

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in D.document_openings(spark, sf).limit(120).collect():
        opening, best = re.sub(r"[^\w\s]", " ", r.text[:400].lower()), ("Document", 0.0)
        for name, labels in fuzzy.TYPE_LABELS:
            for label in labels:
                score = plain_partial(label, opening) / 100.0
                best = (name, score) if score > best[1] else best
        want[r.invoice_id] = (best[0], round(best[1], 2))
    got = {r.invoice_id: (r.type, r.score) for r in D.n15(spark, sf).collect()}
    assert {k: got[k] for k in want} == want
    assert len({v[0] for v in got.values()}) >= 4
    assert fuzzy.type_of_texts(["", "zzz"])[0][0] == "Document"


def test_designations(spark):
    rows = [
        ("x 24 AMLODIPINE MEDIS 10 MG B/30 COMP zz", None, None, "AMLODIPINE MEDIS 10 MG B/30 COMP"),
        ("302970 24 7 AMLODIPINE MEDIS 10 MG B/30 COMP", "24", "302970", "AMLODIPINE MEDIS 10 MG B/30 COMP"),
        ("** AB 12 DOLIPRANE 500MG; EFFERALGAN VITAMINE C 1000 MG B/16 COMP ~~", None, None, "EFFERALGAN VITAMINE C 1000 MG B/16 COMP"),
        ("SERUM PHYSIO 5 ML", None, None, "SERUM PHYSIO 5 ML"),
        ("MAXI GEL DOUX 3 #", None, None, "MAXI GEL DOUX 3"),
        ("abc Vitamine 12", None, None, "Vitamine 12"),
        ("Huile (douce)", None, None, "Huile"),
        ("##", None, None, ""),
        (None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, "d string, q string, c string, want string")
    got = df.select("want", fuzzy.clean_designation(F.col("d"), F.col("q"), F.lit(True), F.col("c")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_similarity_of_labels_by_brute_force(spark):
    """Every part name, against the longest common subsequence by plain recursion over both texts."""
    import functools

    from ledgerweave import registry

    def ratio(a, b):
        @functools.lru_cache(None)
        def lcs(i, j):
            return 0 if i == len(a) or j == len(b) else 1 + lcs(i + 1, j + 1) if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

        return 200.0 * lcs(0, 0) / (len(a) + len(b))

    names = {r.p_partkey: r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    for r in registry.queries()["n14_label_similarity"](spark, "/root/testdata/sf0.001").collect():
        name = names[r.p_partkey]
        other = name.split(" ", 1)[1] if " " in name else name
        a, b = set(name.split()), set(other.split())
        both, left = " ".join(sorted(a & b)), " ".join(sorted(a - b))
        want = 100.0 if both and (not left or not b - a) else max(ratio(f"{both} {left}".strip(), both), ratio(both, f"{both} {left}".strip()))
        assert abs(r.token_set - want) < 1e-5
        short, long = sorted((name, other), key=len)
        assert abs(r.partial - plain_partial(short, long)) < 1e-5


def test_streams_do_not_depend_on_the_file_split(spark, tmp_path):
    from ledgerweave.plans import feeds as D
    from ledgerweave.streaming import feeds as S

    sf = "/root/testdata/sf0.001"
    for table, key in (("events", "event_id"), ("lineitem", "l_linenumber")):
        for n in range(2):  # users and orders are in both files
            spark.read.parquet(f"{sf}/{table}.parquet").where(F.col(key) % 2 == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{table}")

    def stream(t):
        return S.tail(spark, f"{tmp_path}/{t}", "*.parquet", spark.read.parquet(f"{sf}/{t}.parquet"))

    def rows(df):
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    assert rows(D.followed(spark, stream("events"))) == rows(D.st5(spark, sf))
    assert rows(rollup.status_counts(D.uploads(spark, sf, stream("lineitem"), "split"))) == rows(D.st1(spark, sf))


def test_moves_are_judged_in_the_order_of_their_times(spark, tmp_path):
    """Late events in every order of the files; with a short watermark the passed ones are folded."""
    from ledgerweave.streaming import feeds as S

    moves = [(1, 7, "2024-01-01", "pending"), (2, 7, "2024-01-02", "held"), (3, 7, "2024-01-03", "posted"), (4, 7, "2024-01-04", "held"), (5, 8, "2024-01-01", "posted"), (6, 8, "2024-01-09", "pending")]
    schema = "event_id long, submission_id long, event_at string, state string"
    for i, order in enumerate([(0, 1, 2, 3, 4, 5), (3, 2, 1, 0, 5, 4), (1, 5, 3, 0, 4, 2)]):
        for late in ("100 days", "0 seconds") if not i else ("100 days",):
            root = f"{tmp_path}/{i}{late[0]}"
            for k in order:
                spark.createDataFrame([moves[k]], schema).withColumn("event_at", F.col("event_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/in")
            like = spark.read.parquet(f"{root}/in")
            out = S.each_batch(S.tracked(S.tail(spark, f"{root}/in", "*.parquet", like), late), lambda b: b, f"{root}/out", "update")
            got = out.groupBy("submission_id").agg(*[F.max_by(c, "n_events").alias(c) for c in ("state", "n_illegal")], F.max("n_events").alias("n_events"))
            assert sorted(tuple(r) for r in got.select("submission_id", "state", "n_events", "n_illegal").collect()) == [(7, "held", 4, 1), (8, "pending", 2, 2) if late != "0 seconds" else (8, "pending", 1, 0)], (order, late)


def test_submissions_over_micro_batches(spark, tmp_path):
    from ledgerweave.plans import feeds as D
    from ledgerweave.streaming import feeds as S

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    cut = orders.approxQuantile("o_orderkey", [0.3, 0.7], 0.0)
    for part in (orders.where(F.col("o_orderkey") <= cut[0]), orders.where(F.col("o_orderkey").between(cut[0] + 1, cut[1])), orders.where(F.col("o_orderkey") > cut[1])):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders")
    got = D.judged_submissions(spark, sf, S.tail(spark, f"{tmp_path}/orders", "*.parquet", orders))
    assert sorted(map(str, got.collect())) == sorted(map(str, D.st3_rejects(spark, sf).collect()))


def test_recorded_moves(spark, tmp_path):
    s = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "submission_id long, lib_facture string").withColumns({"submitted_by": F.lit("u"), "submitted_at": F.lit("2024-01-01").cast("timestamp"), "review_score_pct": F.lit(90)})
    none, root = s.limit(0), f"{tmp_path}/s"
    assert W.recorded(spark, root)["event"].count() == 0
    W.record_submissions(spark, root, "b0", s, none)
    moves = spark.createDataFrame([(1, "2024-01-03", "pending"), (1, "2024-01-02", "held"), (1, "2024-01-04", "held"), (3, "2024-01-02", "posted"), (3, "2024-01-03", "held"), (9, "2024-01-03", "held")], "submission_id long, event_at string, state string")
    W.record_moves(spark, root, "m0", moves.withColumn("event_at", F.col("event_at").cast("timestamp")))
    for _ in range(2):  # the second time nothing is added
        t = W.recorded(spark, root)
        assert sorted((r.submission_id, r.reason) for r in t["reject"].collect()) == [(2, "active submission exists")]
        assert sorted((r.submission_id, r.state, r.n_events) for r in W.current_state(t["event"]).collect()) == [(1, "held", 4), (3, "posted", 2)]
        W.record_submissions(spark, root, "b0", s, none)
        W.record_moves(spark, root, "m0", moves)
    t["event"].limit(1).drop("batch").write.parquet(f"{root}/event/batch=broken")
    assert W.recorded(spark, root)["event"].count() == 6
    W.record_submissions(spark, root, "b1", s.where("submission_id > 1"), none)
    t = W.recorded(spark, root)
    assert sorted((r.submission_id, r.batch) for r in t["submission"].collect()) == [(1, "b0"), (3, "b0"), (3, "b1")]


def test_suppliers_that_share_a_word(spark):
    sup = spark.createDataFrame([(i, f"F{i}", f"PHARMA LABO {i}" if i < 40 else "LABO", f"{i:07d}A/P/M/000") for i in range(41)], "IDFournisseur int, Code string, Nom string, MF string")
    inv = spark.createDataFrame([(1, "ste pharma labo 7 sud", ""), (2, "nobody", ""), (3, "xxlaboyy", ""), (4, "pharma", "0000009A/P/M/000")], "invoice_id int, supplier_name string, supplier_mf string")
    loose = {r.invoice_id: r.IDFournisseur for r in R.matched_suppliers(inv, sup).collect()}
    strict = {r.invoice_id: r.IDFournisseur for r in R.matched_suppliers(inv, sup, True).collect()}
    assert loose == {1: 0, 2: None, 3: 40, 4: 0} and strict == {1: 7, 2: None, 3: 40, 4: 9}
