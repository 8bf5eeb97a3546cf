"""License notices in texts: phrases word by word, and an exact set-similarity join of text blocks with templates.

A token is a pair of neighbouring words. Blocks are windows of WINDOW words, one beginning at every WINDOW / 2, so that a run of half
a window's words and one more lies whole in some block. All tokens that stand in a template are counted over all documents; in the order of
these counts, rare ones first, a template of t tokens of which `need` must be in a block shares with it one of its first t - need + 1
(prefix filter), a block holds `need` of them at least (length filter), and what can still follow the first common token on
either side must suffice (positional filter). What passes is compared in full. Only template tokens of a block are kept: no other can be
in common. Templates are a parameter, and the only thing sent to all tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .shingles import BUFFER, U, mix

#: Phrases of the contract and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Openings and key sentences of public license notices.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gnu-gpl", "licensed under the gnu general public license version"),
    ("gnu-gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Words of a block, and the share of a template's tokens, in percent, that a block must hold.
WINDOW, PERCENT = 64, 80

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 text, A-Z lower-cased, and where they begin: runs of ASCII letters, digits and all beyond ASCII."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], _WORD[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[U(1)], np.full(len(b), _BASE)]), dtype=U)
        back = np.cumprod(np.concatenate([[U(1)], np.full(len(b), _BACK)]), dtype=U)
        total = np.concatenate([[U(0)], np.cumsum((_LOW[b].astype(U) + U(1)) * power[: len(b)], dtype=U)])
        return mix((total[end] - total[start]) * back[start] + (end - start).astype(U)), start


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A hash for each word with the one after it."""
    with np.errstate(over="ignore"):
        return mix(words[:-1] * U(0xBF58476D1CE4E5B9) + mix(words[1:])) if len(words) > 1 else words[:0]


def tokens_of(text: str) -> np.ndarray:
    return np.unique(pairs_of(words_of(text.encode())[0]))


def checked(templates: list[tuple[str, str]], window: int, percent: int) -> list[tuple[str, np.ndarray, int]]:
    """(label, tokens, need) of each template; one of fewer than two words, or of more than a block's half and one, is an error."""
    out = []
    for label, text in templates:
        words = words_of(text.encode())[0]
        if not 2 <= len(words) <= window // 2 + 1:
            raise ValueError(f"a template takes 2 to {window // 2 + 1} words: {text!r}")
        tokens = np.unique(pairs_of(words))
        out.append((label, tokens, ceil(Fraction(percent, 100) * len(tokens))))
    return out


READ = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<int>, at array<int>, token array<int>"


def reader(phrases: list[tuple[str, str]], vocabulary: np.ndarray):
    """Arrow batches (row, doc_id, text) -> READ: places of the phrases, and place and number of every pair of the vocabulary (sorted)."""
    asked = [words_of(p.encode())[0] for p, _ in phrases]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, texts = batch.column(0), batch.column(1), batch.column(2)
            lo = 0
            while lo < len(texts):
                parts, size, hi = [], 0, lo
                while hi < len(texts) and (not parts or size < BUFFER):
                    parts.append((texts[hi].as_py() or "").encode("utf-8", "surrogatepass"))
                    size += len(parts[-1]) + 1
                    hi += 1
                yield one(rows.slice(lo, hi - lo), ids.slice(lo, hi - lo), parts)
                lo = hi

    def one(rows: pa.Array, ids: pa.Array, parts: list[bytes]) -> pa.RecordBatch:
        words, start = words_of(b" ".join(parts))
        ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in parts]))
        begins = np.concatenate([[0], ends[:-1]])
        doc = np.repeat(np.arange(len(parts)), ends - begins)  # of each word
        n, first, last = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), -1)
        holds = np.zeros((len(parts), len(asked)), bool)
        for k, phrase in enumerate(asked):
            i = np.flatnonzero(words == phrase[0])
            i = i[i + len(phrase) <= ends[doc[i]]]
            for j in range(1, len(phrase)):
                i = i[words[i + j] == phrase[j]]
            np.add.at(n, doc[i], 1)
            np.minimum.at(first, doc[i], i - begins[doc[i]])
            np.maximum.at(last, doc[i], i - begins[doc[i]])
            holds[doc[i], k] = True
        pairs = pairs_of(words)
        token = np.searchsorted(vocabulary, pairs)
        i = np.flatnonzero((vocabulary[np.minimum(token, len(vocabulary) - 1)] == pairs) & (doc[:-1] == doc[1:])) if len(vocabulary) and len(pairs) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[i], minlength=len(parts)))]).astype(np.int32)
        arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (i - begins[doc[i]], token[i])]
        base = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(holds.sum(1))]).astype(np.int32)), pa.array(np.nonzero(holds)[1].astype(np.int32)))
        none = n == 0
        columns = [rows.cast(pa.int64()), ids.cast(pa.int64()), pa.array(ends - begins), pa.array(n), pa.array(first, mask=none), pa.array(last, mask=none), base, *arrays]
        return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "at", "token"])

    return read


def blocks(rank: np.ndarray, window: int, least: int):
    """Arrow batches (row, at, token) -> (row, block, ranks): the ranks, ascending and distinct, of the template pairs that lie whole in
    each block, if they are `least` at least."""
    half = window // 2

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, (at, token) = batch.column(0), (batch.column(k) for k in (1, 2))
            row = np.repeat(np.arange(len(rows)), at.value_lengths().to_numpy(zero_copy_only=False))
            place, ranks = at.flatten().to_numpy().astype(np.int64), rank[token.flatten().to_numpy()]
            block = place // half
            # a pair lies in the block that begins last at or before its first word, and in the one before if its second word does
            too = (block > 0) & (place % half + half + 2 <= window)
            keys = np.unique(np.stack([np.concatenate([row, row[too]]), np.concatenate([block, block[too] - 1]), np.concatenate([ranks, ranks[too]])], 1), axis=0)
            new = np.flatnonzero(np.concatenate([[True], (keys[1:, :2] != keys[:-1, :2]).any(1)])) if len(keys) else np.zeros(0, np.int64)
            ends = np.concatenate([new[1:], [len(keys)]]) if len(keys) else new
            fit = ends - new >= least
            held = np.repeat(fit, ends - new)
            offsets = np.concatenate([[0], np.cumsum((ends - new)[fit])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[held, 2].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(keys[new[fit], 0])), pa.array(keys[new[fit], 1].astype(np.int32)), lists], names=["row", "block", "ranks"])

    return of


def joined(found: DataFrame, templates: DataFrame, least: int) -> DataFrame:
    """(row, block, template, common, size) of blocks (row, block, ranks) and templates (template, need, ranks) that share `need` or more;
    `least` is the least need."""
    share = lambda c, need: F.slice(c, F.lit(1), F.size(c) - need + 1)  # noqa: E731  the prefix filter of either side
    prefix = templates.select("template", "need", F.col("ranks").alias("t_ranks"), F.posexplode(share("ranks", F.col("need"))).alias("t_at", "token"))
    some = found.where(F.size("ranks") >= least).select("row", "block", "ranks", F.posexplode(share("ranks", F.lit(least))).alias("at", "token"))
    left = F.least(F.size("ranks") - F.col("at"), F.size("t_ranks") - F.col("t_at"))  # this token and those after it on either side
    pairs = some.join(prefix, "token").where((F.size("ranks") >= F.col("need")) & (left >= F.col("need")))
    pairs = pairs.withColumn("both", F.array_intersect("ranks", "t_ranks"))
    # once a pair: at the first token in common
    pairs = pairs.where((F.size("both") >= F.col("need")) & (F.try_element_at("both", F.lit(1)) == F.col("token")))
    return pairs.select("row", "block", "template", F.size("both").alias("common"), F.size("t_ranks").alias("size"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """A row a document: doc_id, n_words; n_base, first_word and last_word of the places where a phrase stands; base_labels and
    labels, comma-joined; score: 1 with a phrase, else the largest share of a template found, else 0; found: (label, first word
    of the block, share) of each template's blocks.

    A null or empty text has no words and no labels; rows of a null or repeated doc_id are scanned row by row; an empty table gives
    no rows; columns besides doc_id and text are not read. Words beyond ASCII are compared byte by byte."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "licenses")
    parts = checked(templates, window, percent)
    vocabulary = np.unique(np.concatenate([x for _, x, _ in parts])) if parts else np.zeros(0, U)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # written, so that a row keeps its number; what follows reads no text
    read = scratch.table(rows.mapInArrow(reader(phrases, vocabulary), READ), "read")
    counts = read.select(F.explode("token").alias("token")).groupBy("token").count()
    count = np.zeros(len(vocabulary), np.int64)
    for r in counts.toLocalIterator():  # a row a template token at most
        count[r["token"]] = r["count"]
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((np.arange(len(vocabulary)), count))] = np.arange(len(vocabulary))
    listed = [(i, need, sorted(rank[np.searchsorted(vocabulary, tokens)].tolist())) for i, (_, tokens, need) in enumerate(parts)]
    table = spark.createDataFrame(listed, "template int, need int, ranks array<int>")
    names = spark.createDataFrame([(i, label) for i, (label, _, _) in enumerate(parts)], "template int, label string")
    least = min((need for _, _, need in parts), default=1)
    held = read.select("row", "at", "token").where(F.size("at") >= least).mapInArrow(blocks(rank, window, least), "row long, block int, ranks array<int>")
    hits = joined(held, table, least).join(names, "template")
    spans = F.array_sort(F.collect_list(F.struct("label", (F.col("block") * (window // 2)).cast("long").alias("word"), (F.col("common") / F.col("size")).alias("share"))))
    of_row = hits.groupBy("row").agg(spans.alias("found"))
    base = F.transform("base", lambda k: F.element_at(F.array(*[F.lit(label) for _, label in phrases]), k + 1)) if phrases else F.array().cast("array<string>")
    out = read.join(of_row, "row", "left")
    found = F.coalesce("found", F.array().cast(of_row.schema["found"].dataType))
    joined_up = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(found, lambda x: x["share"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined_up(base).alias("base_labels"), joined_up(F.concat(base, F.transform(found, lambda x: x["label"]))).alias("labels"), score.alias("score"), found.alias("found"))


def op13(docs: DataFrame) -> DataFrame:
    """Every document's license phrases, labels and score; see scan()."""
    return scan(docs.select("doc_id", "text")).drop("found")


def _sql(templates: list[tuple[str, str]], phrases: list[tuple[str, str]], window: int, percent: int) -> str:
    """The rows of op13 by counting the tokens of every block and template."""
    half, listed = window // 2, []
    for i, (label, text) in enumerate(templates):
        w = text.split()
        pairs = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
        listed += [f"({i}, '{label}', {len(pairs)}, {ceil(Fraction(percent, 100) * len(pairs))}, '{p}')" for p in pairs]
    places = " union all ".join(f"select r, '{label}' as label, i from t where {' and '.join(f"{'w' if not k else f'w{k}'} = '{x}'" for k, x in enumerate(p.split()))}" for p, label in phrases)
    leads = ", ".join(f"lead(w, {k}) over (partition by r order by i) as w{k}" for k in range(1, max(len(p.split()) for p, _ in phrases)))
    return rf"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
    u as (select r, unnest(ws) as w, unnest(range(len(ws))) as i from d), t as (select r, i, w, {leads} from u),
    p as ({places}), b as (select r, count(*) as n, min(i) as f, max(i) as l, string_agg(distinct label, ',' order by label) as labels from p group by 1),
    v(template, label, size, need, pair) as (values {", ".join(listed)}),
    m as (select r, i, template, label, size, need, pair from t join v on v.pair = w || ' ' || w1),
    k as (select r, i // {half} as block, * exclude (r, i) from m union all select r, i // {half} - 1, * exclude (r, i) from m where i >= {half} and i % {half} + {half} + 2 <= {window}),
    h as (select r, block, template, label, size, count(distinct pair) as common from k group by 1, 2, 3, 4, 5 having count(distinct pair) >= any_value(need)),
    g as (select r, max(common / size) as score from h group by 1),
    o as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from h union all select r, label from p) group by 1)
    select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, f::bigint as first_word, l::bigint as last_word, coalesce(b.labels, '') as base_labels, coalesce(o.labels, '') as labels, case when n > 0 then 1.0::double else coalesce(score, 0)::double end as score
    from d left join b using (r) left join g using (r) left join o using (r)"""


SQL = _sql(TEMPLATES, PHRASES, WINDOW, PERCENT)
