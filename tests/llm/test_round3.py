"""Fill-in-middle, whitening and license scans against brute force, SQL and the contracts' own words."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from brindle.llm import fim, licenses, whitening

TEXTS = [
    (1, "Alpha beta\n gamma  delta\t"), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "é ß 日本 \x01\x02\x01d \x02e x\x0b y"), (7, "holds <P> itself"), (8, "<S>"), (9, "almost <P < S> <M"), (10, "tail<"),
    (11, "a " * 5000), (None, "no id here at all"), (1, "Alpha beta\n gamma  delta\t"), (1, "another text of that id"), (12, "w" * 300_000 + " end"), (13, " " * 200_000), (14, "\x01\x02"), *[(100 + i, f"word{i} " * (i % 9) + "<M <S <P"[: i % 9]) for i in range(60)],
]


def forms(rows):
    """The contract, unit by unit."""
    for i, text in rows:
        text = text or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        hexed = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        yield i, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text)


def test_fim(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = sorted(map(tuple, fim.op11(rows).collect()), key=repr)
    assert got == sorted(forms(TEXTS), key=repr) and {x[2] for x in got} == {"plain", "spm", "psm"}
    assert fim.op11(rows.limit(0)).count() == 0


def test_fim_keeps_other_columns(spark):
    rows = spark.createDataFrame([(i, f"a b c {i}", "x", 7, "y") for i in range(40)], "doc_id long, text string, form string, n long, __text string")
    out = fim.fim(rows, seed=1, rate=100, spm=0)
    assert out.columns == ["doc_id", "__text", "output", "n", "form", "prefix_chars", "middle_chars"]
    got = out.select("*", fim.restored(out["output"], out["form"]).alias("back")).collect()
    assert all(r.back == f"a b c {r.doc_id}" and r.form == "psm" and r.n == 4 and r.output != r.back and r["__text"] == "y" for r in got) and len(got) == 40


LICENSED = [
    (1, "Alpha. Licensed under the Apache License, Version 2.0 (see there)"), (2, None), (3, ""), (4, "... \n"), (5, "CC BY cc-by Cc\tbY ccby cc é by"), (6, "all rights reserved all rights RESERVED General Public\nLicense"),
    (7, "x " * 61 + "released under the mit license"), (8, "x " * 62 + "released under the mit license"), (9, "x " * 31 + "released under the mit license y " * 40), (10, "released under the other license"), (11, "all rights"), (12, "reserved"),
    (None, "All rights reserved"), (1, "another: released under the MIT license"), (13, "İ Å日本 cc by 日本"), (14, "w" * 200_000 + " cc by " + "q " * 100_000 + "redistribution and use in source and binary forms with or without change are permitted provided that the following conditions are met"),
    (15, "the software is provided as is without warranty of any kind, express or IMPLIED"), (16, "license mit the under released"),
]


def test_licenses(spark):
    rows = spark.createDataFrame(LICENSED, "doc_id long, text string")
    out = licenses.op13(rows)
    got = sorted(map(tuple, out.collect()), key=repr)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, text in LICENSED:
        w = words(text)
        places = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        found = []
        for label, t in licenses.TEMPLATES:
            tokens = set(zip(t.split(), t.split()[1:], strict=False))
            for at in range(0, len(w), 32):
                block = w[at : at + 64]
                same = len(tokens & set(zip(block, block[1:], strict=False)))
                if 100 * same >= 80 * len(tokens):
                    found.append((label, same / len(tokens)))
        base = {x for _, x in places}
        at = [k for k, _ in places]
        want.append((i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), 1.0 if places else max((s for _, s in found), default=0.0)))
    assert got == sorted(want, key=repr)
    c = duckdb.connect()
    documents = rows.toPandas()  # noqa: F841  read by name
    sql = c.sql(licenses.SQL).select(*[duckdb.ColumnExpression(x) for x in out.columns])
    assert sorted(map(tuple, sql.fetchall()), key=repr) == got
    assert licenses.op13(rows.limit(0)).count() == 0


def test_license_templates_and_spans(spark):
    rows = spark.createDataFrame([(1, "a b c d", "kept out")], "doc_id long, text string, labels string")
    r = licenses.scan(rows, [("own", "b c d"), ("own", "b c d"), ("far", "c d e f g h")], []).first()
    assert r.labels == "own" and r.base_labels == "" and r.n_base == 0 and [tuple(x) for x in r.found] == [("own", 0, 1.0)] * 2 and r.score == 1.0
    assert licenses.scan(rows, [], [("a b", "x")]).first().labels == "x"
    for bad in ("one", "w " * 34):
        with pytest.raises(ValueError):
            licenses.scan(rows, [("own", bad)])


def white(rows, components=16):
    """The contract in numpy."""
    x = [(i, np.floor(64 * np.asarray(v, np.float64)).astype(np.int64) + 1_000_000) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.stack([v for _, v in x]), axis=0)
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    return {(i, k + 1, tuple(v)): (n, int(((n * v - s).astype(object) ** 2).sum()), abs(((n * v - s) / n) @ q[:, k]) / np.sqrt(e[k]), e[k] / e.sum()) for i, v in x for k in range(min(components, len(s)))}


def test_whitening(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 20)) * np.geomspace(3, 0.2, 20)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(i + 1000, v[7].tolist()) for i in range(150)] + [(5, v[5].tolist()), (None, v[6].tolist()), (2000, None), (2001, [float("nan"), *v[0][1:].tolist()]), (2002, [None, *v[0][1:].tolist()]), (2003, [float("inf")] * 20), (2004, [0.0] * 20), (2005, [1.0, 2.0]), (2006, [])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    want = white([r for r in rows if r[1] is None or len(r[1]) == 20])
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == 16 * (300 + 150 + 2 + 1) and {k[:2] for k in want} == set(by)
    for (i, k, _), (n, deviation, size, explained) in want.items():
        for r in by[i, k]:
            assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - size) < 1e-6 * (1 + size) and abs(r.explained / explained - 1) < 1e-8 and r.identity_error < 1e-9
    signs = {k: [r.whitened for r in by[7, k]] + [r.whitened for r in by[1000, k]] for k in range(1, 17)}
    assert all(len(set(x)) == 1 for x in signs.values())


def test_whitening_of_little(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long")
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, None, 1), (2, [], 1)])).count() == 0
    one = whitening.whiten(frame([(1, [1.0, 2.0], 5), (2, [1.0, 2.0], 5)])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(i, k, 1, 0, None, 0.0, 0.0) for i in (1, 2) for k in (1, 2)}
    two = sorted((r.vec_id, r.component, r.deviation, r.whitened and abs(round(r.whitened, 9))) for r in whitening.whiten(frame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1)])).collect())
    assert two == [(1, 1, 64 * 64, 1.0), (1, 2, 64 * 64, None), (2, 1, 64 * 64, 1.0), (2, 2, 64 * 64, None)]
    big = whitening.whiten(frame([(1, [3e38], 1), (2, [-3e38], 1), (3, [0.0], 1)])).collect()
    assert {r.vec_id: r.deviation for r in big} == {1: None, 2: None, 3: 0}


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 40):
        scale = np.geomspace(1, 1e-6, d)
        b = rng.normal(size=(d, d)) * 0.1 + np.eye(d)
        v = (b * scale).T @ (b * scale)
        e, q = whitening.jacobi(v)
        assert np.abs(q.T @ q - np.eye(d)).max() < 1e-13 and (np.diff(e) <= 0).all()
        # relative to each eigenvalue's own size: the scaled matrix is well conditioned
        s = np.linalg.svd(b * scale, compute_uv=False) ** 2
        assert np.abs(e / s - 1).max() < 1e-9
        assert np.abs(v @ q - q * e).max() < 1e-12
