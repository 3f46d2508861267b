import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm import fill_in_middle as X


def brute(text, doc_id):
    """The transformation by slices of code points."""
    text = text or ""
    n = len(text)
    hx = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hx[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:i], text[i:j], text[j:]
    if h[3] % 100 < 20:
        return n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<>PSM é漢\U0001f600\n", max_size=40), st.one_of(st.none(), st.integers(-5, 5000)))
def test_forms_and_round_trip(text, doc_id):
    n, form, prefix, middle, out = X.apply(text.encode(), doc_id)
    assert (n, form, prefix, middle, out.decode()) == brute(text, doc_id)
    assert X.invert(out, form).decode() == text


@pytest.mark.parametrize("step", [1, 3, 1 << 16])
def test_rotation_by_reversals(monkeypatch, step):
    monkeypatch.setattr(X, "STEP", step)
    rng = np.random.default_rng(1)
    for _ in range(50):
        raw = bytearray(rng.integers(0, 256, 40, dtype=np.uint8).tobytes())
        lo, mid, hi = sorted(rng.integers(0, 41, 3).tolist())
        want = raw[:lo] + raw[mid:hi] + raw[lo:mid] + raw[hi:]
        X.rotate(raw, lo, mid, hi)
        assert raw == want


def test_table_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICE", 1000)
    rows = [(1, None, "a"), (2, "", "a"), (None, "some text", "b"), (3, "x" * 200_000 + "é漢", None), (3, "x" * 200_000 + "é漢", "c"), (4, "has <P> in it", "c"), (5, "<P", "d"), (6, "S>", "d")]
    rows += [(k, f"text number {k} with ünïcödé \U0001f600", "e") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumnRenamed("output", "restored")
    got = X.restored(X.fill_in_middle(df)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    want = [(d, *brute(t, d), t or "") for d, t, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert X.restored(X.fill_in_middle(df.limit(0))).count() == 0
