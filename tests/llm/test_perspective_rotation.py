import pytest

from ledgerweave.llm import perspective_rotation as P

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def esc(s):
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def brute(rows, part_turns):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is None, t or 0, r or "unknown", x or "") for c, t, r, x in rows if c == conv))
        for who in {t[2] for t in turns} - {"system"}:
            for part, at in enumerate(range(0, len(turns), part_turns)):
                text, mask, trained = "", [], 0
                for _, _, role, x in turns[at : at + part_turns]:
                    text += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={esc(role)}|>\n"
                    start = len(text)
                    text += esc(x) + P.END
                    if role == who:
                        trained += 1
                        mask.append(f"{start}-{len(text)}")
                out.append((conv, who, part, len(turns[at : at + part_turns]), trained, text, ",".join(mask)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_turns", [2, 256])
def test_rotation_matches_brute_force(spark, part_turns):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|> \\ there"), (1, 2, "bob", "é\U0001f600"), (1, 3, "ann", None), (1, 3, "ann", None), (1, None, "cy|>", "late"), (2, 0, "system", "only"),
            (3, 5, None, "x"), (None, 1, "ann", "lone"), (None, 0, "bob", ""), *[(4, i, "ab"[i % 2], "y" * i) for i in range(40)]]
    df = spark.createDataFrame([(*r, "p") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in P.rotate(df, part_turns).collect()), key=str)
    assert got == brute(rows, part_turns)
    assert P.rotate(df.limit(0), part_turns).count() == 0
    for r in got:
        for span in filter(None, r[6].split(",")):
            a, b = map(int, span.split("-"))
            assert r[5][:a].endswith("<|assistant|>\n") and r[5][a:b].endswith(P.END)


def test_sql_gives_the_same_rows(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    rel = c.sql(P.ORACLE_SQL)
    want = sorted(map(str, rel.fetchall()))
    assert sorted(str(tuple(r)) for r in P.op1_perspective_rotation(spark, "/root/testdata/sf0.01").select(*rel.columns).collect()) == want
