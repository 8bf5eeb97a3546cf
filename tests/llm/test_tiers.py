"""Token counts and ids of texts with characters beyond plain Latin, by chunks and caches, against the library."""

import numpy as np

from brindle.llm import tokenops, tokens

RANGES = [(9, 0x180), (0x2C0, 0x370), (0x370, 0x530), (0x1100, 0x1200), (0x2000, 0x2070), (0x3000, 0x3100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F600, 0x1F640), (0x0900, 0x0980), (0x1E00, 0x2000), (0x10400, 0x10450)]
SAID = ["’", "“it’s”", "—", "don’t", "слово", "日本語の文章", "é", "́a", "ạ̇", "각", "<|endoftext|>", "<|", "|>", "x<|startoftext|>y", " ", "\x0b", "\x0c", "\x1c", "\x85", " ", "ΣΑΣ", "İ", "½", "'s", "ǅ"]


def texts(seed, n=300):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        lo, hi = RANGES[rng.integers(len(RANGES))]
        parts = []
        for _ in range(rng.integers(1, 12)):
            parts += ["".join(chr(rng.integers(lo, hi)) for _ in range(rng.integers(1, 9))), rng.choice(SAID), rng.choice(["", " ", "\n", "\t ", "  "])]
        out.append("".join(parts))
    return out


def expected(path, some):
    return [tokens.library(path).encode(t, add_special_tokens=False).ids for t in some]


def test_tiers_equal_the_library():
    path = tokens.default_file()
    for seed in range(4):
        some = texts(seed)
        want = expected(path, some)
        for coder in (tokens.id_coder(path), tokens.merge_coder(path)):
            ids, n = coder.flat(some)
            assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
            assert (coder.lengths(some) == n).all()


def test_a_pre_token_is_encoded_once():
    path, asked = tokens.default_file(), []
    ids = tokens.library_ids(path)

    def values(words):
        asked.extend(words)
        return [len(x) >> 2 for x in ids(words)]

    coder = tokens.Coder(path, values, counts=True)
    some = [f"it’s the {k} слово — “日本語”" for k in "one two three four".split()] * 5
    for t in some:
        coder.lengths([t])
    assert len(asked) == len(set(asked)) == 13  # it ’ s the (one to four) слово — “ 日本語 ”
    coder = tokens.Coder(path, values, counts=True)
    coder.frequent = {"слово": ids(["слово".encode()])[0].__len__() >> 2}
    asked.clear()
    assert coder.lengths(some).tolist() == [len(x) for x in expected(path, some)] and "слово".encode() not in asked


def test_small_caches_and_long_chunks():
    path = tokens.default_file()
    coder = tokens.Coder(path, tokens.library_ids(path), room=(400, 8))
    some = [*texts(9, 60), "語" * 5000, "a’b" * 3000, *texts(9, 60)]
    want = expected(path, some)
    for t, w in zip(some, want, strict=True):
        assert coder.flat([t])[0].tolist() == w
    assert max(len(coder.words.young), len(coder.words.old), len(coder.chunks.young), len(coder.chunks.old)) <= 4


def test_rows_of_one_id_spread(spark):
    rows = [(None, f"text {i}") for i in range(3000)] + [(7, f"other {i}") for i in range(3000)] + [(1, "it’s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        folder = tokenops.Scratch(spark, "spread").path("files")
        manifest = tokenops.write_ids(docs, folder)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    assert max(m[1] for m in manifest) < 2500 and sum(m[1] for m in manifest) == 6001
    back = tokenops.read_ids(spark, manifest, folder, tokenops.id_width()).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None] * 3000 + [1] + [7] * 3000
