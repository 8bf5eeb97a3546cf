"""Byte-level BPE with word ends over whole texts: pre-tokens, caches, batched numpy merges.

A pre-token never holds white space, and what the normaliser does to a character does not hang on what stands
beyond white space, so every text falls into white-space chunks that are encoded on their own; workers cache
chunks and pre-tokens. A chunk whose characters are all plain (those for which lower-casing, composition
and classes have no special cases) is split by a pattern here; any other goes once through the library's
normaliser and pre-tokeniser, and its pre-tokens through the same caches."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np

from .chunks import spread

#: Bytes, about, and entries that each of a worker's two caches holds at most: beside little else, and in
#: stages that come after others in the same workers. Characters of a key at most: longer ones are made anew.
WIDE, NARROW, LONGEST = (40 << 20, 400_000), (12 << 20, 150_000), 512
#: Printable ASCII, Latin-1 and Latin Extended-A and -B letters without U+0130; of white space the three plain kinds.
PLAIN = re.compile("[\t\n\r -~¡-¬®-įı-ňŊ-žƀ-ǃȀ-ȟ]*")
END = "</w>"


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library(path: str):
    """The library's tokenizer of a file, once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others follow from U+0100 in ascending order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Vocabulary and merges of a tokenizer file as sorted arrays of pair keys."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.size = max(ids.values()) + 1
        self.words = {i: w for w, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words |= {i: w for w, i in self.special.items()}
        letters = byte_letters()
        self.plain = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + END] for x in letters], np.int64)
        self.byte_of = {x: b for b, x in enumerate(letters)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        key, first = np.unique(key, return_index=True)
        self.key, self.rank, self.made = key, first.astype(np.int64), made[first]
        # the tokens' UTF-8, each with a space behind it, by id
        text = [(self.words.get(i, "") + " ").encode() for i in range(max(self.words) + 1)]
        self.blob, self.width = np.frombuffer(b"".join(text), np.uint8), np.array([len(x) for x in text], np.int64)
        self.first = np.cumsum(self.width) - self.width

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array and each word's number of ids.

        Every round merges, in each word that still has a known pair, all of its pairs of lowest
        rank from the left; finished words leave the rounds."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbol, word = self.plain[flat], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbol[ends] = self.last[flat[ends]]
        done_symbol, done_word = [], []
        none = np.iinfo(np.int64).max
        while len(symbol):
            key = np.where(word[1:] == word[:-1], symbol[:-1] * self.size + symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            known = self.key[at] == key
            rank = np.append(np.where(known, self.rank[at], none), none)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, start)
            low = np.repeat(low, np.diff(np.append(start, len(word))))
            active = low < none
            if not active.all():
                done_symbol.append(symbol[~active])
                done_word.append(word[~active])
                symbol, word, rank, low = symbol[active], word[active], rank[active], low[active]
                at = np.append(at, 0)[active]
            else:
                at = np.append(at, 0)
            if not len(symbol):
                break
            hit = rank == low
            # of pairs that overlap (aaa) the first, third, ... of each run merge
            place = np.arange(len(hit))
            begin = hit & ~np.append(False, hit[:-1])
            odd = (place - np.maximum.accumulate(np.where(begin, place, 0))) & 1
            hit &= odd == 0
            symbol = np.where(hit, self.made[at], symbol)
            keep = ~np.append(False, hit[:-1])
            symbol, word = symbol[keep], word[keep]
        if not done_symbol:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the tokens with a space behind each, and where each token ends: files of this kind
        name no decoder, so tokens, special ones too, are joined by spaces."""
        return gather(self.blob, self.first[ids], self.width[ids])


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.cache
def _pieces() -> re.Pattern:
    import regex

    # fixed values: the pattern of the tokenizer file
    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def supported(path: str) -> bool:
    """The chunk path holds for files with this normaliser and pattern only."""
    spec = json.load(open(path, encoding="utf-8"))
    try:
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        return kinds == ["NFC", "Replace", "Lowercase"] and split["pattern"]["Regex"] == _pieces().pattern and spec["model"]["end_of_word_suffix"] == END
    except (KeyError, TypeError, IndexError):
        return False


class Cache:
    """Values by string, in two generations: when the younger is half of what there is room for it becomes the older,
    and the older one goes, so that strings in use stay. A value has as many bytes as four times its key's letters at most."""

    def __init__(self, room: tuple[int, int]):
        self.bytes, self.entries = room[0] // 2, room[1] // 2
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.held = 0

    def look(self, keys: Iterable[str]) -> tuple[dict[str, object], list[str]]:
        """The values of those keys that are here, and the other keys."""
        found, missing, young, old = {}, [], self.young, self.old
        for k in keys:
            v = young.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                    continue
                self.put(k, v)
                young, old = self.young, self.old
            found[k] = v
        return found, missing

    def put(self, key: str, value: object) -> None:
        if len(key) > LONGEST:
            return
        if len(self.young) >= self.entries or self.held >= self.bytes:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[key] = value
        self.held += 5 * len(key)


class Coder:
    """Encodes texts chunk by chunk through caches. values: what a batch of new pre-tokens (as UTF-8)
    maps to: their ids as little-endian unsigned 32-bit bytes, or (counts=True) their numbers of ids."""

    def __init__(self, path: str, values: Callable[[list[bytes]], list], counts: bool = False, room: tuple[int, int] = WIDE):
        import regex

        if not supported(path):
            raise ValueError(f"{path}: unsupported normaliser or pre-tokeniser")
        self.path, self.values, self.counts = path, values, counts
        self.join = sum if counts else b"".join
        self.words, self.chunks = Cache(room), Cache(room)
        self.frequent: dict[str, object] = {}
        self.pieces = regex.compile(_pieces().pattern + "|\n").findall
        self.tok = library(path)
        # special strings are found in the raw text, longest first
        special = self.tok.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or t.content.split() != [t.content] for t in special.values()):
            raise ValueError(f"{path}: unsupported special tokens")
        self.special = {t.content: 1 if counts else np.array([i], "<u4").tobytes() for i, t in special.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = {x: b for b, x in enumerate(byte_letters())}

    def hard(self, chunk: str) -> list[str | tuple[str]]:
        """Pre-tokens of a chunk that the library must normalise and split; special strings as tuples of one."""
        out: list[str | tuple[str]] = []
        for i, part in enumerate(self.marks.split(chunk)):
            if i % 2:
                out.append((part,))
            elif part:
                pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))
                out += [bytes(map(self.letters.__getitem__, w)).decode() for w, _ in pieces if w]
        return out

    def of_words(self, words: Iterable[str]) -> dict[str, object]:
        """The values of distinct pre-tokens: of the frequent table, of the cache, else made in one batch."""
        table = self.frequent
        out, new = self.words.look([w for w in words if w not in table])
        out.update((w, table[w]) for w in words if w in table)
        if new:
            for w, v in zip(new, self.values([w.encode() for w in new]), strict=True):
                out[w] = v
                self.words.put(w, v)
        return out

    def of_chunks(self, chunks: list[str]) -> list:
        """The values of distinct chunks without white space."""
        known, new = self.chunks.look(chunks)
        if new:
            plain, mark, easy, rest = PLAIN.fullmatch, self.marks.search, [], []
            for c in new:
                (easy if plain(c) and not mark(c) else rest).append(c)
            parts = self.pieces("\n".join(easy).lower())
            split = [self.hard(c) for c in rest]
            words = self.of_words({*parts, *(w for p in split for w in p if type(w) is str)} - {"\n"})
            at, join = 0, self.join
            ends = [i for i, w in enumerate(parts) if w == "\n"] + [len(parts)]
            for c, end in zip(easy, ends, strict=False):
                known[c] = words[parts[at]] if end == at + 1 else join([words[w] for w in parts[at:end]])
                at = end + 1
            for c, p in zip(rest, split, strict=True):
                known[c] = join([words[w] if type(w) is str else self.special[w[0]] for w in p])
            for c in new:
                self.chunks.put(c, known[c])
        return [known[c] for c in chunks]

    def _spread(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """Values of the distinct chunks, the chunk of each place, the text ends in places."""
        chunks, place, ends = spread(texts)
        return self.of_chunks(chunks), place, ends

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        values, place, ends = self._spread(texts)
        each = np.array(values if self.counts else [len(v) >> 2 for v in values], np.int64)
        total = np.concatenate([[0], np.cumsum(each[place])])
        return total[ends[1:]] - total[ends[:-1]]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and each text's number of ids."""
        values, place, ends = self._spread(texts)
        each = np.array([len(v) >> 2 for v in values], np.int64)
        blob = np.frombuffer(b"".join(values), "<u4")
        first = np.cumsum(each) - each
        ids, total = gather(blob, first[place], each[place])
        total = np.concatenate([[0], total])
        return ids, total[ends[1:]] - total[ends[:-1]]


def gather(blob: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs blob[first : first + n] one after another, and where each ends."""
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return blob[:0], ends
    at = np.repeat((first - (ends - n)).astype(np.int32 if len(blob) + ends[-1] < 1 << 30 else np.int64), n)
    at += np.arange(ends[-1], dtype=at.dtype)
    return blob[at], ends


def groups(column, most: int = 1 << 22) -> Iterable[tuple[int, list[str]]]:
    """Runs of texts of an Arrow column of about `most` bytes, with where they begin; null is the empty text. Only a run
    at a time is made into strings."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most)))
        yield first, [t or "" for t in column.slice(first, last - first).to_pylist()]
        first = last


def library_ids(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Ids of pre-tokens by the library's model, as little-endian unsigned 32-bit integers."""
    model = library(path).model
    table = {b: x for b, x in enumerate(byte_letters())}

    def run(words: list[bytes]) -> list[bytes]:
        return [np.array([t.id for t in model.tokenize(w.decode("latin-1").translate(table))], "<u4").tobytes() for w in words]

    return run


@functools.cache
def id_coder(path: str) -> Coder:
    """Texts to ids, by the library."""
    return Coder(path, library_ids(path))


@functools.cache
def merge_coder(path: str) -> Coder:
    """Texts to ids, by batched numpy merges."""
    v = vocabulary(path)

    def run(words: list[bytes]) -> list[bytes]:
        ids, n = v.encode(words)
        data, ends = ids.astype("<u4").tobytes(), np.cumsum(n) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    return Coder(path, run, room=NARROW)


#: What makes a worker's coders, each with caches that live as long as the worker.
CODERS = [id_coder, merge_coder]


def forget() -> None:
    """Lets go of a worker's coders and caches. For operators that hold caches of their own: the same workers may have encoded before them,
    in an earlier stage or query, and the memory is bounded for both together."""
    for made in CODERS:
        made.cache_clear()
