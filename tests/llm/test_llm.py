"""The operators against brute force on small tables, with nulls, empty and repeated rows, clashing names and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from brindle.llm import ann, graph, jaccard, langid, lines, mixing, neardup, shingles, tokenops, tokens, toxicity
from brindle.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        text = "\n".join(prose(rng, rng.integers(4, 40)) for _ in range(rng.integers(1, 5)))
        rows.append((i, text, "en", f"s{i % 4}", len(text), 0.5))
    base = prose(rng, 120)
    for i in range(60, 72):  # near copies around one text, one word changed in each
        w = base.split()
        w[i] = f"x{i}"
        rows.append((i, " ".join(w) if i > 60 else base, "en", "s0", 1, None))
    rows += [(80, rows[3][1], "en", "s1", 1, 0.1), (81, None, None, None, None, None), (82, "", "en", None, 0, None), (83, " \n\t ", "en", "s9", 3, None), (84, "one", "en", "s9", 3, None), (85, "One", "en", "s9", 3, None), (86, "é <|endoftext|> Ω日本 don't", "fr", "s9", 3, None), (None, "no id at all here", "en", "s2", 3, None), (3, rows[3][1], "en", "s3", 1, 0.5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def unite(ids, links):
    c = {i: i for i in ids}
    while any(c[a] != c[b] for a, b in links):
        for a, b in links:
            c[a] = c[b] = min(c[a], c[b])
    return c


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard(docs, k, percent):
    got = {r.doc_id: r for r in jaccard.jaccard_groups(docs, k, percent).collect() if r.doc_id is not None}
    s = {r.doc_id: sets_of(r.text, k) for r in docs.collect() if r.doc_id is not None}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    want = unite(s, links)
    assert links
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s[i]), want[i]) for i in s}


def test_jaccard_keeps_one(docs):
    kept = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    assert 60 in kept and not {61, 65, 71, 80} & set(kept) and kept.count(3) == 1 and {81, 82, 83, None} <= set(kept)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_crowd(spark, k, percent):
    """A large group of copies, many of which don't link with its lead but with each other."""
    rng = random.Random(5)
    edits = [(rng.randrange(120), f"e{j}") for j in range(12)]
    texts = []
    for i in range(60):
        words = [f"w{j}" for j in range(120)]
        for at, new in rng.sample(edits, rng.randrange(7)):
            words[at] = new
        for _ in range(rng.randrange(3)):
            words[rng.randrange(120)] = f"u{i}"
        texts.append(words[: 120 - (rng.randrange(14) if i % 5 == 0 else 0)])
    sets = [{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in texts]
    least = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = jaccard.jaccard_groups(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), k, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(least))
    assert len(set(least)) > 1


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    want = unite({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_shingles():
    texts = ["a b c d", "A  b\tC d", "", None, "a b", "x" * 3000000 + " y z", "é b c"]
    got = list(shingles.shingle_sets(texts, 3))
    assert [len(x) for x in got] == [len(sets_of(t, 3)) for t in texts] and (got[0] == got[1]).all()


def test_tokens():
    path, rng = tokens.default_file(), np.random.default_rng(2)
    texts = ["", "<|endoftext|>a <|startoftext|>", "İ ΣΑΣ ﬁ ǅ", "don't 's I'LL", "a" * 999, "a\x00\x1cb\x85c", "😀 日本 12½", *["".join(chr(rng.integers(9, 700)) for _ in range(30)) for _ in range(200)]]
    library = [tokens.library(path).encode(t, add_special_tokens=False).ids for t in texts]
    for coder in (tokens.id_coder(path), tokens.merge_coder(path)):
        ids, n = coder.flat(texts)
        assert n.tolist() == [len(x) for x in library] and ids.tolist() == [i for x in library for i in x] and (coder.lengths(texts) == n).all()


def test_token_queries(docs, empty):
    t = tokens.library(tokens.default_file())
    rows = [r for r in docs.collect() if r.doc_id is not None]
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in rows}
    pack = lambda x: np.array(x, "<u4").tobytes()
    for r in tokenops.op8(docs).collect():
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(pack(ids[r.doc_id])).hexdigest(), hashlib.sha256(t.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest())
    assert {(r.doc_id, r.n_tokens, r.n_bytes) for r in tokenops.op5(docs).collect() if r.doc_id is not None} == {(r.doc_id, len(ids[r.doc_id]), len((r.text or "").encode())) for r in rows}
    files = tokenops.op3(docs).orderBy("start").collect()
    assert [r.doc_id for r in files if r.doc_id is not None] == sorted(r.doc_id for r in rows)
    at = 0
    for r in files:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]) + 1, zlib.crc32(pack([*ids[r.doc_id], 1])))
    assert tokenops.op8(empty).count() == tokenops.op5(empty).count() == tokenops.op3(empty).count() == 0
    back = tokenops.decode(tokenops.encode(docs.select("doc_id", "text"))).where("doc_id = 5").first()
    assert back.decoded == t.decode(ids[5])


def test_mixing(docs, empty):
    rows = mixing.op2(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.op2(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.taken) for r in rows} == again and mixing.op2(empty).count() == 0
    size = {}
    for r in docs.collect():
        size.setdefault(r.source, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sum(size[s]) for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    source = {r.doc_id: r.source for r in docs.collect()}
    for s in order:
        own = [r for r in rows if source[r.doc_id] == s and r.doc_id != 3]
        if s not in ("s3",):
            assert all(abs(r.target - goal[s]) < 1e-6 and r.source_size == sum(size[s]) for r in own)
    assert abs(sum(r.taken for r in rows) - sum(goal.values())) <= len(order) and all(r.taken <= 2 * r.size for r in rows)
    mixed = mixing.mix(docs, exact=False)
    assert mixing.shuffled(mixed).count() == sum(r.copies for r in mixed.collect())


def test_mixing_clashing_names(spark, docs):
    names = ["key", "b", "block", "s", "one", "room", "shard", "full", "row", "target"]
    odd = docs.select("doc_id", "text", "source", *[docs.doc_id.alias(c) for c in names])
    rows = mixing.mix(odd).collect()
    assert all(r[c] == r.doc_id for r in rows for c in names if c != "target") and len(rows) == docs.count()
    want = {(r.doc_id, r.text): (r.copies, r.part_words) for r in mixing.mix(docs).collect()}
    assert {(r.doc_id, r.text): (r.copies, r.part_words) for r in rows} == want


def test_mixing_shards_follow_the_tree(docs, monkeypatch):
    """The tree deals the quotas: another tree, other shards."""
    one = {(r.doc_id, r.text): r.shards for r in mixing.mix(docs, shards=8).collect()}
    monkeypatch.setattr(mixing, "split_tree", lambda quota, shards, rng: np.array([quota] + [quota * 0] * (shards - 1)))
    two = {(r.doc_id, r.text): r.shards for r in mixing.mix(docs, shards=8).collect()}
    assert any(set(x) - {0} for x in one.values()) and all(set(x) <= {0} for x in two.values())


def test_neighbours_with_ties(spark):
    """100 equal vectors among others: ties go to the smaller vec_id, however the rows are partitioned."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1000, 16))
    x[::10] = x[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one, seven = ({(r.query_id, r["rank"], r.vec_id) for r in ann.op7(frame.repartition(n)).collect()} for n in (1, 7))
    assert one == seven and {(0, k + 1, 10 * (k + 1)) for k in range(5)} <= one


def test_split_tree():
    rng = np.random.default_rng(3)
    dealt = mixing.split_tree(np.array([5, 0, 130, 17]), 8, rng)
    assert dealt.sum(0).tolist() == [5, 0, 130, 17] and dealt.sum(1).max() - dealt.sum(1).min() <= 1


def test_lines(spark, docs, empty):
    rng = np.random.default_rng(4)
    long = prose(rng, 60)
    near = long.split()
    near[30] = "other"
    rows = [(1, f"short one\n{long}\nunique line of its own words here"), (2, f"{' '.join(near)}!\nshort one"), (3, long.upper()), (4, None), (5, ""), (None, long)]
    got = {r.doc_id: r for r in lines.op6(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "short one" and got[3].text == "" and got[4].text is None and got[5].text == "" and got[None].text == long
    assert (got[2].n_dropped, got[4].n_lines) == (1, 0) and lines.op6(empty).count() == 0
    assert lines.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]


def test_short_and_unspaced_lines(spark):
    unspaced = "これは空白のない長い一行です"
    rows = [(1, f"All rights reserved\n\nabc\n{unspaced}"), (2, f"all rights  reserved.\n\nabc\n{unspaced}\nAll rights served"), (3, "\n\n\n")]
    got = {r.doc_id: r for r in lines.op6(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "\nabc\nAll rights served" and got[2].n_dropped == 2 and got[3].text == rows[2][1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_lines_find_all(spark):
    """All lines of word edit similarity 0.8 or more, against brute force: words changed, put in and left out."""
    rng = np.random.default_rng(10)
    texts = []
    for n in (5, 6, 9, 10, 11, 15, 20, 24, 30, 50, 64):
        for _ in range(3):
            base = prose(rng, n).split()
            texts.append(base)
            for e in {1, n // 5, n // 5 + 1}:
                new = list(base)
                for at in rng.choice(n, e, replace=False):
                    kind = rng.integers(3)
                    new[at] = f"c{rng.integers(99)}" if kind == 0 else "" if kind == 1 else f"{new[at]} i{rng.integers(99)}"
                texts.append(" ".join(new).split())
    long = [i for i, w in enumerate(texts) if len(w) >= 5]
    links = [(a, b) for a in long for b in long if a < b and 5 * abs(len(texts[a]) - len(texts[b])) <= max(len(texts[a]), len(texts[b])) and edits(texts[a], texts[b]) <= max(len(texts[a]), len(texts[b])) // 5]
    group = unite(range(len(texts)), links)
    got = lines.op6(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_dropped and r.doc_id in long} == {i for i in long if group[i] != i}


def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[100] + 0.05 * rng.normal(size=(40, 16))
    x[200] = x[5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*rows, (900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 1)], "vec_id long, embedding array<float>, label int")


def test_vectors(spark):
    x, frame = vectors(spark)
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = {r.vec_id: r for r in neardup.op9(frame).collect()}
    links = [(int(a), int(b)) for a, b in np.argwhere(s >= 0.9)]
    want = unite(range(300), links)
    assert all(got[i].n_links == (s[i] >= 0.9).sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(300))
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))
    hits = [r for r in ann.op7(frame).collect()]
    assert {r.query_id for r in hits} == {0, 50, 100, 150, 200, 250} and all(abs(r.score - s[r.query_id, r.vec_id]) < 1e-9 for r in hits)
    best = {q: set(np.argsort(-s[q])[:5]) for q in range(0, 300, 50)}
    assert sum(r.vec_id in best[r.query_id] for r in hits) >= 0.9 * 30
    # vectors of other lengths, infinite components, null and repeated ids
    odd = spark.createDataFrame([(950, [1.0, 0.0], 0), (951, [1.0, 0.01], 0), (952, [float("inf"), 1.0], 0), (953, [], 0), (None, [1.0, 0.0], 0), (954, [1.0, 0.0], 0), (954, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    other = [r for r in neardup.op9(frame.unionByName(odd)).collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in other if r.vec_id in got} == {i: (r.n_links, r.component_id) for i, r in got.items()}
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in other if r.vec_id not in got) == [(0, 0, None), (950, 2, 950), (951, 2, 950), (952, 0, 952), (953, 0, 953), (954, 2, 950), (954, 2, 950)]
    assert {(r.query_id, r["rank"], r.vec_id) for r in ann.op7(frame.unionByName(odd)).collect() if r.query_id != 950} == {(r.query_id, r["rank"], r.vec_id) for r in hits}
    none = frame.where("vec_id < 0")
    assert neardup.op9(none).count() == ann.op7(none).count() == 0


def test_neighbours_in_dense_groups(spark):
    """Queries inside large groups of near copies, where codes can't order the members."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for lo, hi, spread in ((0, 1000, 0.1), (1000, 1300, 0.3), (1300, 1500, 0.02)):
        x[lo:hi] = x[lo] + spread * x[lo:hi]
    x[1500:1530] = x[1500]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    found = {}
    for r in ann.op7(frame).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    for lo, hi in ((0, 1000), (1000, 1300), (1300, 1500), (1500, 1530)):
        own = range(lo, hi, 50)
        right = [v >= np.sort(s[q])[-5] - 1e-9 for q in own for v in found[q].values()]
        assert len(right) == 5 * len(own) and sum(right) >= 0.95 * len(right), (lo, hi, sum(right), len(right))
    assert sorted(found[1500]) == [1501, 1502, 1503, 1504, 1505]


def test_single_links_beside_a_large_group():
    """Links of rows outside a large group are found: what the group has can't outvote them in the audit."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:2000] = x[0] + 0.2 * x[:2000]
    x[2000:2200] = x[2200:2400] + 0.25 * x[2000:2200]
    x = x[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, layers = np.arange(len(x)), neardup.build(x)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    a, b = neardup.within(x, x, layers, 0.9, neardup.audited(x, ids, x, ids, layers, 0.9, 0.99, rng))
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a) and (s[a, b] | (a == b)).all()
    got = np.bincount(a[a != b], minlength=len(x))
    single = (s.sum(1) > 0) & (s.sum(1) < 100)
    assert single.sum() >= 390 and (got[single] / s.sum(1)[single]).mean() >= 0.98 and (got[~single].sum() >= 0.98 * s[~single].sum())


def test_language(spark, empty):
    rng = np.random.default_rng(6)
    kinds = {"aa": ["the", "ing", "wh"], "bb": ["sch", "ung", "zu"]}
    rows = [(i, " ".join("".join(rng.choice(p, rng.integers(1, 4))) for _ in range(20)), lang) for i, (lang, p) in enumerate(list(kinds.items()) * 60)]
    frame = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 !", None), (502, "½ ² Ⅳ", None), (503, "wh" * 3000, "aa"), (0, rows[0][1], "aa")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.op1(frame).collect()}
    assert all(got[i].lang_pred == lang and 0.5 <= got[i].score <= 1 for i, _, lang in rows)
    assert got[500].lang_pred == got[501].lang_pred == got[502].lang_pred == "und" and got[503].lang_pred == "aa" and langid.op1(empty).count() == 0
    # the forward algorithm against all segmentations
    p = langid.table(np.arange(1.0, 5)[:, None])
    finder = langid.Pieces(["a", "ab", "b"])

    def every(w):
        return 1.0 if not w else sum(p[i, 0] * every(w[len(x) :]) for i, x in enumerate(["a", "ab", "b"]) if w.startswith(x))

    some = ["aab", "abab", "b", "abbaabab", "ab" * 9]
    assert np.allclose(langid.log_likelihood(some, finder, p)[:, 0], [np.log(every(w)) for w in some])
    # a long run is summed whole: its probability falls by the same factor with each further repeat
    x = langid.log_likelihood(["ab" * n for n in (600, 601, 602)], finder, p)[:, 0]
    assert np.isfinite(x).all() and abs((x[1] - x[0]) - (x[2] - x[1])) < 1e-6


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(7)
    rows, marks = [], []
    for i in range(400):
        toxic = i % 5 == 1
        w = prose(rng, 30).split()
        if toxic:
            w[3] = "vilest"
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    frame, labels = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.op4(frame, labels).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    assert held and sum(got[i].predicted == dict(marks)[i] for i in held) >= 0.95 * len(held)
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert toxicity.op4(empty, labels).count() == 0 and toxicity.op4(frame, labels.where("toxic = 0")).where("predicted = 1").count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got and not got & {61, 65, 71, 80}
