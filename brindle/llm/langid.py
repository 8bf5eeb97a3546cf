"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of pieces of one fixed public vocabulary. A word's probability is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its
words. Piece probabilities are learned by expectation-maximisation over forward and backward sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Rows, spread, sums
from .common import Scratch, chosen, held_out, widened
from .tokens import groups

LETTERS = regex.compile(r"\p{L}+")
#: Letters of a piece at most: the fixed vocabulary is that of all pieces up to this length, so that a letter's sum has as many terms.
#: Letters of a run at most that training takes at once (scoring takes whole runs), and an unknown letter's probability.
PIECE, LONGEST, FLOOR = 6, 40, 1e-8
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)


def pieces(path: str | None = None) -> list[str]:
    """The fixed vocabulary: lower-cased all-letter pieces of a public sentencepiece model."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = {model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p.isalpha() and len(p) <= PIECE)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words], np.int64)
    width = int(n.max(initial=1))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat.reshape(len(words), width).astype(U), n


class Pieces:
    """Finds the pieces at all places of a batch of words."""

    def __init__(self, vocabulary: list[str]):
        with np.errstate(over="ignore"):
            hashes = np.array([self.hash(p) for p in vocabulary], U)
        self.order = np.argsort(hashes)
        self.sorted, self.size = hashes[self.order], len(vocabulary)

    @staticmethod
    def hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, h: np.ndarray, lone: bool) -> np.ndarray:
        """The index of the piece of each hash, `size` for a lone letter without a piece, -1 for none."""
        x = np.minimum(np.searchsorted(self.sorted, h), self.size - 1)
        return np.where(self.sorted[x] == h, self.order[x], self.size if lone else -1)

    def at(self, code: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(start, length) -> the piece's index in each word, `size` for a lone letter without a piece, -1 for none."""
        rows, width = code.shape
        found = {}
        with np.errstate(over="ignore"):
            for i in range(width):
                h = np.zeros(rows, U)
                for k in range(1, min(PIECE, width - i) + 1):
                    h = h * BASE + code[:, i + k - 1] + U(1)
                    found[i, k] = self.find(h, k == 1)
        return found


def forward(found: dict, n: np.ndarray, width: int, p: np.ndarray) -> list[np.ndarray]:
    """alpha[j]: each word's probability of its first j letters in each language. p: pieces x languages,
    then a row for unknown letters and one of zeros."""
    alpha = [np.ones((len(n), p.shape[1]))]
    for j in range(1, width + 1):
        a = np.zeros((len(n), p.shape[1]))
        for k in range(1, min(PIECE, j) + 1):
            a += alpha[j - k] * p[found[j - k, k]]
        alpha.append(a)
    return alpha


def by_width(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of like length, in batches."""
    n = np.array([len(w) for w in words])
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + 20_000)
        longest = max(6, int(n[order[at]] * 1.3))
        end = at + max(1, int(np.searchsorted(n[order[at:end]], longest, "right")))
        yield order[at:end]
        at = end


def log_likelihood(words: list[str], finder: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probabilities of whole words, however long: the sums are scaled at each letter, and only those of the last PIECE are held."""
    out = np.zeros((len(words), p.shape[1]))
    for ids in by_width(words):
        code, n = _codes([words[i] for i in ids])
        alpha, hashes, scale = [np.ones((len(n), p.shape[1]))], [], np.zeros(len(n))
        for j in range(1, code.shape[1] + 1):
            with np.errstate(over="ignore"):
                letter = code[:, j - 1] + U(1)
                hashes = [letter, *(h * BASE + letter for h in hashes)][:PIECE]  # of the pieces of 1, 2, .. letters that end here
            a = np.zeros_like(alpha[0])
            for k, h in enumerate(hashes):
                a += alpha[-1 - k] * p[finder.find(h, k == 0)]
            top = a.max(axis=1)
            top = np.where(top > 0, top, 1.0)
            scale += np.log(top)
            alpha = [x / top[:, None] for x in (*alpha[-PIECE + 1 :], a)]
            done = np.flatnonzero(n == j)
            out[ids[done]] = np.log(np.maximum(alpha[-1][done], 1e-300)) + scale[done, None]
    return out


def expected(words: list[str], weight: np.ndarray, finder: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over all segmentations of the words."""
    out = np.zeros((finder.size + 1, p.shape[1]))
    for ids in by_width(words):
        code, n = _codes([words[i] for i in ids])
        width, langs = code.shape[1], p.shape[1]
        found = finder.at(code)
        alpha = forward(found, n, width, p)
        total = np.maximum(np.stack(alpha)[n, np.arange(len(n))], 1e-300)
        beta = [None] * (width + 1)
        for i in range(width, -1, -1):
            b = np.zeros((len(n), langs))
            b[n == i] = 1.0
            for k in range(1, min(PIECE, width - i) + 1):
                step = p[found[i, k]] * beta[i + k]
                use = alpha[i] * step / total * weight[ids]
                at = np.where(found[i, k] < 0, finder.size + 1, found[i, k])
                for lang in range(langs):
                    out[:, lang] += np.bincount(at, use[:, lang], finder.size + 2)[:-1]
                b += step
            beta[i] = b
    return out


def table(counts: np.ndarray) -> np.ndarray:
    """Smoothed probabilities, with the rows of unknown letters and of zeros that forward() asks for."""
    p = (counts[:-1] + 0.02) / (counts[:-1].sum(axis=0) + 0.02 * (len(counts) - 1))
    return np.concatenate([p, np.full((1, p.shape[1]), FLOOR), np.zeros((1, p.shape[1]))])


def letter_runs(chunk: str, most: int | None = None) -> list[str]:
    """Runs of letters in lower case; in training, in parts of `most`."""
    runs = LETTERS.findall(chunk.lower())
    return [w[i : i + most] for w in runs for i in range(0, len(w), most)] if most else runs


def train(docs: DataFrame, rounds: int = 3, per_language: int = 1500, min_share: float = 0.0) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from all of up to about `per_language` documents of each
    language, chosen by a hash of their id: the one bound on what training reads. docs: doc_id, text,
    lang. Languages are a label set: their counts go to the driver."""
    known = docs.where("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("lang").alias("n")).collect()}
    langs = sorted(k for k, v in n.items() if v >= min_share * sum(n.values()))
    vocabulary = pieces()
    if not langs:
        return [], np.zeros((len(vocabulary) + 2, 0))
    rule = F.lit(False)
    for i, lang in enumerate(langs):
        rule = rule | ((F.col("lang") == lang) & chosen(F.col("doc_id"), per_language / n[lang], i))
    words = known.where(rule).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).groupBy("lang", "w").agg(F.count("w").alias("n"))
    scratch = Scratch(docs.sparkSession, "langid")
    words = scratch.table(words.repartition(6), "words")

    def step(p):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder, total = Pieces(vocabulary), None
            for b in batches:
                for i in range(0, b.num_rows, 20_000):
                    part = b.slice(i, 20_000)
                    w = [letter_runs(x, LONGEST) for x in part.column("w").to_pylist()]
                    lang, count = part.column("lang").to_pylist(), part.column("n").to_pylist()
                    flat = [x for y in w for x in y]
                    if not flat:
                        continue
                    weight = np.zeros((len(flat), len(langs)))
                    own = np.repeat(np.arange(len(w)), [len(y) for y in w])
                    weight[np.arange(len(flat)), [langs.index(lang[j]) for j in own]] = np.array(count, float)[own]
                    got = expected(flat, weight, finder, p)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

        return run

    size = np.array([1.0 / 30 ** min(len(x), 3) for x in vocabulary])[:, None].repeat(len(langs), 1)
    p = table(np.concatenate([size * 1e6, np.zeros((1, len(langs)))]))
    for _ in range(rounds):
        counts = np.zeros((len(vocabulary) + 1, len(langs)))
        for row in words.mapInArrow(step(p), "counts binary").toLocalIterator():
            counts += np.frombuffer(row.counts).reshape(counts.shape)
        p = table(counts)
    scratch.drop(words)
    return langs, p


def identify(docs: DataFrame, langs: list[str], p: np.ndarray) -> DataFrame:
    """docs with lang_pred (ties: the first by code point; `und` and score 0 for a null text or one
    without a letter) and score, the posterior of lang_pred under equal priors. Only text is read.
    Columns of docs that have these two names are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    model = spark.sparkContext.broadcast((langs, p, pieces()))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p, vocabulary = model.value
        finder = Pieces(vocabulary)

        def compute(chunks: list[str]) -> np.ndarray:
            runs = [letter_runs(c) for c in chunks]
            flat = [w for r in runs for w in r]
            out = np.zeros((len(chunks), len(langs) + 1))
            if flat:
                new = list(dict.fromkeys(flat))
                at = {w: i for i, w in enumerate(new)}
                each = log_likelihood(new, finder, p)[[at[w] for w in flat]]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                out[:, :-1] = sums(each, ends)
                out[:, -1] = np.diff(ends)
            return out

        cache = Rows(compute, len(langs) + 1)
        for b in batches:
            pred, score = [], []
            for _, texts in groups(b.column("text")):
                chunks, place, ends = spread(texts)
                total = sums(cache.of(chunks)[place], ends) if chunks else np.zeros((len(texts), len(langs) + 1))
                for row in total:
                    if not langs or row[-1] == 0:
                        pred.append("und")
                        score.append(0.0)
                    else:
                        best = int(np.argmax(row[:-1]))
                        pred.append(langs[best])
                        score.append(float(1 / np.exp(np.maximum(row[:-1] - row[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, widened(docs.schema, lang_pred="string", score="double"))


def op1(docs: DataFrame) -> DataFrame:
    """Every document's language, learned where crc32(doc_id) mod 4 is not 2."""
    out = held_out(F.col("doc_id"), 4, 2)
    langs, p = train(docs.select("doc_id", "text", "lang").where(~out))
    return identify(docs.select("doc_id", "text"), langs, p).select("doc_id", out.alias("held_out"), "lang_pred", "score")
