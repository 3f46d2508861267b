"""Steps whose rows, files or groups must not grow with the tables."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerweave import registry
from ledgerweave.functions import fuzzy
from ledgerweave.operators import benchmark as B
from ledgerweave.operators import gate, headers, legacy, shapes, tables
from ledgerweave.operators import lines as L
from ledgerweave.plans import merging, quality
from test_queries import SF, TABLES, plain


def test_truth_files_hold_few_cases_however_many_there_are(spark, monkeypatch):
    read = []
    monkeypatch.setattr(B, "json_files", lambda s, path, of=B.json_files: read.append(of(s, path)) or read[-1])
    quality._written_cases(spark, "/root/testdata/sf0.01")
    truth = read[0].select("path", F.size(F.expr("variant_get(v, '$.cases', 'array<variant>')")).alias("n")).collect()
    assert sum(r.n for r in truth) == 150 and max(r.n for r in truth) <= quality.CASES_A_FILE


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """The smallest tables with part keys from 99,900 on, so that codes of every eleventh invoice reach seven digits."""
    root, c = tmp_path_factory.mktemp("large-keys"), duckdb.connect()
    for t in TABLES:
        shifted = {"part": "replace (p_partkey + 99900 as p_partkey)", "lineitem": "replace (l_partkey + 99900 as l_partkey)"}.get(t, "")
        c.sql(f"copy (select * {shifted} from '{SF}/{t}.parquet') to '{root}/{t}.parquet' (format parquet)")
        c.sql(f"create view {t} as select * from '{root}/{t}.parquet'")
    return str(root), c


@pytest.mark.parametrize("name", ["a22_row_alignment", "j20_header_mapping", "t14_rejected_rows", "t14_table_lines", "t9_quantity_recovery", "j9_gap_filled_lines"])
def test_codes_of_seven_digits(spark, large_keys, name):
    root, c = large_keys
    frame = registry.queries()[name](spark, root)
    rel = c.sql(registry.oracle_sql()[name])
    rows = sorted(tuple(map(plain, r)) for r in frame.select(*sorted(frame.columns)).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in rel.select(*[f'"{n}"' for n in sorted(rel.columns)]).fetchall())


def test_legacy_lines_with_codes_of_seven_digits(spark, large_keys):
    test_codes_of_seven_digits(spark, large_keys, "t12_legacy_lines")


def test_legacy_lines_with_parts_beyond_key_300000(spark, tmp_path):
    """Codes of six and of seven digits, whose parts are not among the first 300,000."""
    c = duckdb.connect()
    for t in TABLES:
        shifted = {"part": "replace (p_partkey + 699900 as p_partkey)", "lineitem": "replace (l_partkey + 699900 as l_partkey)"}.get(t, "")
        c.sql(f"copy (select * {shifted} from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    test_codes_of_seven_digits(spark, (str(tmp_path), c), "t12_legacy_lines")
    assert registry.queries()["t12_legacy_lines"](spark, str(tmp_path)).count() == 6000


def test_a_second_pass_of_mirrored_quantities_is_not_written_out_inside_the_first(spark):
    rows = spark.createDataFrame([(1, " 7,0", None, None), (2, None, "x", None), (3, "", "", "1.5")], "i int, quantite string, quantite_commande string, qty string")
    out = shapes.mirrored(shapes.mirrored(rows))
    assert [(r.quantite, r.qty) for r in out.orderBy("i").collect()] == [("7", "7"), ("x", "x"), ("1.5", "1.5")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("99999") <= 4


def test_a_long_designation_is_read_once(spark):
    """40,000 words up to one dosage: the work must not grow with the square of their number."""
    long = "AMOX " + "WORD " * 40_000
    rows = spark.createDataFrame([(long + "10 MG zz",), (long + "10 MG B/30 COMP TAIL GELULE 7",)], "d string")
    began = time.time()
    got = [r[0] for r in rows.select(fuzzy.clean_designation(F.col("d"), F.lit(""), F.lit(False), F.lit(""))).collect()]
    assert got == [long + "10 MG", long + "10 MG B/30 COMP"]
    assert time.time() - began < 20


def test_gate_codes_are_worked_out_once(spark):
    names = ["code_pct", "code_article", "designation", "quantite", "prix_unitaire", "montant", "doc_type"]
    rows = spark.createDataFrame([("ff-ooo12", "12345", "VITAMINE 5000 UI AMP", "5000", "", "", ""), ("", "1234567", "AMOX 7 COMP", "7", "2", "14", "Proforma")], ", ".join(f"{n} string" for n in names))
    out = gate.checked(rows)
    assert [(r.code_pct, r.code_article, r.quantite, r.montant) for r in out.orderBy("code_pct").collect()] == [("1234567", "", 7.0, 14.0), ("PF00012", "", None, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("OISB") == 2


def test_words_of_a_page_meet_its_header_in_one_join(spark):
    words = [(1, 50, 107, "Code"), (1, 340, 107, "Désignation Жж"), (1, 345, 108, "Désignation"), (1, 690, 107, "Qté"), (1, 60, 130, "300001"), (1, 700, 131, "7"), (1, 330, 131, "DRUG"), (1, 320, 131, "SOME"), (1, 2000, 131, "far"), (2, 50, 107, "Code"), (2, 60, 130, "8")]
    rows = spark.createDataFrame([*words, (1, 50, None, "Code"), (1, 340, None, "Qté")], "page int, left int, top int, text string")
    out = tables.word_rows(rows, ["page"])
    assert sorted(map(tuple, out.collect())) == [(1, 120, "code_pct", "300001"), (1, 120, "designation", "SOME DRUG"), (1, 120, "quantite", "7")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("[^a-z0-9 ]") == 1


def test_a_line_meets_each_header_pattern_once(spark):
    """Headings are looked for in a line, not again in each of its neighbours; lines that show no field do not reach the aggregate."""
    rows = [(1, 0, "Bon de commande"), (1, 1, "000123 / 2024"), (1, 2, "Date : 01/02/2024"), (1, 3, "M.F: 1234567A/P/M/000"), (1, 4, "E-mail a.b@c.com Fax 71 222 333"), (1, 5, "12 / 2024"), (2, 0, "??")]
    out = headers.header_fields(spark.createDataFrame(rows, "doc int, line_no int, raw_line string"), "doc")
    got = {r.doc: r for r in out.collect()}
    assert tuple(got[1]) == (1, "000123/2024", "01/02/2024", "Bon de commande", None, None, "71222333", "a.b@c.com", None, "1234567A/P/M/000", None)
    assert tuple(got[2]) == (2, *[None] * 10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"commande\b|facture") == 1 and "CASE WHEN (__rn" not in plan and "Filter ((__rn" in plan


def test_a_written_type_label_is_not_measured(monkeypatch):
    """The first label written in an opening fits by 1; only other openings are held against all windows."""
    called = []
    monkeypatch.setattr(fuzzy, "window_ratios", lambda n, t, of=fuzzy.window_ratios: called.extend(t) or of(n, t))
    odd = "une FACTUR nurnero 12 de mars"
    texts = ["le bon de commande et la facture 7", "FACTURE: incoterms du mois", odd, "facture", ""]
    kinds, scores = fuzzy.type_of_texts(texts)
    assert odd.lower() in called and not {"le bon de commande et la facture 7", "facture  incoterms du mois"} & set(called)
    assert kinds == ["Bon de Commande", "Proforma", "Facture", "Facture", "Document"] and list(scores[[0, 1, 3, 4]]) == [1.0, 1.0, 1.0, 0.0]


def test_a_proforma_line_is_read_once_by_each_pattern(spark):
    lines = ["300001 PF000000012 DMAX U  UML 7 1 234,56 17 567,89", "12,5 300001 ff12345 - NAME 10 MG B/30", "300002 PF00001 3 1,5 4,50", "300003 PF00001 ", "300001 12 NAME 7"]
    out = L.proforma_lines(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc int, line_no int, raw_line string"), "doc")
    got = [(r.code_pct, r.code_article, r.designation, r.quantite, r.prix_unitaire, r.montant, r.line_confidence) for r in out.orderBy("line_no").collect()]
    assert got == [("300001", "PF000000012", "DMAX U UML", "7", "1234,56", "17567,89", 0.85), ("300001", "PF12345", "NAME 10 MG B/30", "", "", "", 0.28), ("300002", "PF00001", "", "3", "1,5", "4,50", 0.85)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(.*?)") == 1


def _table(spark):
    """Two tables: one with a repeated column number, a price in a column without a name and a row of blanks, one without rows."""
    heads = [(0, "Code PCT"), (1, "Désignation"), (2, "Qté"), (3, "P.U."), (4, "Note"), (4, "?"), (5, None)]
    rows = [(1, [(0, "300001"), (1, "DRUG 10 MG"), (2, "7"), (3, " "), (4, "12,50")]), (2, [(0, ""), (2, " "), (5, None)]), (3, [(0, "300002"), (1, " OTHER "), (2, ""), (4, "9")])]
    cells = [(t, 0, c, v) for t in (1, 2) for c, v in heads] + [(1, r, c, v) for r, own in rows for c, v in own]
    return spark.createDataFrame(cells, "t int, row_idx int, col_idx int, text string")


def test_headers_that_tables_share_are_scored_once(spark):
    out = tables.mapped_headers(_table(spark), ["t"], ("code_pct", "designation"))
    names = ["code_pct", "designation", "quantity", "unit_price"]
    assert sorted((r.t, r.col_idx, r.name) for r in out.collect()) == [(t, i, n) for t in (1, 2) for i, n in enumerate(names)]
    assert {(r.col_idx, r.score) for r in out.where("t = 2").collect()} == {(0, 1.08), (1, 1.08), (2, 1.0), (3, 1.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "intersect" not in plan and "[^a-z0-9 ]" not in plan


def test_cells_are_held_against_a_blank_name_once(spark):
    heads = spark.createDataFrame([(1, i, n, 1.0) for i, n in enumerate(("code_pct", "designation", "quantity", "unit_price"))], "t int, col_idx int, name string, score double")
    out = tables.realigned(_table(spark), ["t"], heads)
    got = {r.row_idx: (r.named, r.row_text, r.alignment) for r in out.collect()}
    assert got[1] == ({"code_pct": "300001", "designation": "DRUG 10 MG", "quantity": "7", "unit_price": "12,50"}, "300001 DRUG 10 MG 7   12,50", 1.0)
    assert got[3] == ({"code_pct": "300002", "designation": "OTHER", "quantity": "9", "unit_price": ""}, "300002  OTHER   9", 0.75) and len(got) == 2
    assert out._jdf.queryExecution().optimizedPlan().toString().count("conditionnement") == 0
    assert out._jdf.queryExecution().optimizedPlan().toString().count("^[A-Za-z]{1,5}$") <= 2


def test_only_open_lines_are_read_for_a_quantity(spark):
    """A locked line has nothing to read, and a row form that gave a quantity leaves nothing to its position."""
    sql = "SELECT 1 AS doc, i AS line_no, map_from_arrays(array('code'), array(named_struct('value', '300001', 'source', 's', 'score', 0.5D))) AS cells, '300001 7 NAME COMP' AS raw_line, i = 1 AS locked FROM range(2) AS t(i)"
    out = legacy.counted_from_row(spark.sql(sql))
    got = out.selectExpr("line_no", "cells['quantite'].value AS q", "locked").orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [(0, "7", True), (1, None, True)]
    assert "CASE WHEN NOT locked" in out._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_written_small_and_no_more_of_them_is_moved_than_asked_for(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(B, "json_files", lambda s, path, of=B.json_files: paths.append(path) or of(s, path))
    fields, suite = quality.a13(spark, SF), quality.r15_files(spark, SF)
    assert all(p.endswith(".gz") for path in paths for p in spark.read.option("recursiveFileLookup", True).text(path).inputFiles())
    plans = [q._jdf.queryExecution().optimizedPlan().toString() for q in (fields, suite)]
    assert "line_items" not in plans[0] and not any("CASE WHEN NOT match" in p for p in plans)


def test_merged_gated_and_filled_lines_move_no_text_twice(spark, monkeypatch):
    """Merge keys are made where the lines of a document are together, the gate does not join the lines with themselves,
    and what vision saw is not joined with the parts again."""
    j8, t25 = merging.j8(spark, SF), merging.t25_lines(spark, SF)
    plan = j8._jdf.queryExecution().optimizedPlan().toString()
    listed = [p.split(", 0, 0)")[0] for p in plan.split("collect_list(")[1:]]
    assert listed and not any("%.4f" in p for p in listed)
    assert t25._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 2
    seen = []
    monkeypatch.setattr(merging.M, "filled_gaps", lambda lines, vision, doc: seen.append(vision))
    merging._gaps(spark, SF)
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("Relation [p_partkey") == 1
