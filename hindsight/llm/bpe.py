"""BPE encoding and decoding with a minimal acyclic transducer of the frequent words.

Chunks are counted over the whole corpus; the pieces (pre-tokens) of the `lexicon` most frequent are
compiled, sorted, into a minimal acyclic automaton: states with the same right language are shared, and
edge outputs add up to a word's number, which leads to its ids. The file is sent to the executors by
Spark (SparkContext.addFile) and memory-mapped; pieces of a batch walk through it all at once, one byte
a step. Pieces that it doesn't hold are merged by rank, exactly.

Text is normalised as the tokenizer file says: NFC, lower case by character, white space separates;
special tokens written in a text become their ids. Decoding joins the tokens by spaces, as the library
does for a file without decoder.

Defined cases: null and empty texts have no ids and decode to the empty text; rows that repeat are
encoded each; a null doc_id is kept; chosen columns are kept, others ignored; an empty table gives no
rows; very long pieces are merged with a heap, in n log n steps. A tokenizer file of another kind
(other normaliser, splitter or model) raises.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import frugal, new_dir, release, shipped
from .words import ChunkCoder, ragged

#: How the tokenizer file splits (its white-space class spelt out).
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"


def byte_chars() -> list[str]:
    """The visible character that stands for each byte: itself if it's a printable one of Latin-1, else the next free one from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Pieces, merges and tokens of a word-level byte BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        model = spec["model"]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or pre[0]["pattern"] != {"Regex": SPLIT} or model["end_of_word_suffix"] != END or spec["decoder"] or spec["post_processor"]:
            raise ValueError("not a word-level byte BPE file of the kind known here")
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.split = regex.compile(SPLIT.replace(r"\s", SPACES))
        self.chars = byte_chars()
        names = {i: t for t, i in (self.ids | self.special).items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]

    def parts(self, chunk: str) -> list[str | int]:
        """Normalised pieces of a chunk, and ids of special tokens written in it."""
        if "<|" in chunk:
            return [p for x in self.cut.split(chunk) for p in ((self.special[x],) if x in self.special else self._pieces(x))]
        return self._pieces(chunk)

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii():
            chunk = chunk.lower()
        else:
            chunk = unicodedata.normalize("NFC", chunk)
            chunk = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
        return [chunk] if chunk.isascii() and chunk.isalpha() else self.split.findall(chunk)

    def merged(self, piece: str) -> list[int]:
        """The piece's ids: the pair of lowest rank is merged, leftmost first, until none is left."""
        chars = self.chars
        s = [chars[b] for b in piece.encode()]
        s[-1] += END
        if len(s) > 48:
            return self._merged_long(s)
        rank, last = self.rank.get, 1 << 30
        r = [rank(p, last) for p in zip(s, s[1:], strict=False)]
        while r:
            best = min(r)
            if best == last:
                break
            i = r.index(best)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del r[i]
            if i:
                r[i - 1] = rank((s[i - 1], s[i]), last)
            if i < len(r):
                r[i] = rank((s[i], s[i + 1]), last)
        return [self.ids[x] for x in s]

    def _merged_long(self, s: list[str]) -> list[int]:
        n = len(s)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := self.rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if s[i] == a else -1
            if j < 0 or s[j] != b:
                continue
            s[i], s[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return [self.ids[x] for x in s if x]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal automaton of the words, built from their sorted list: a state is frozen and shared once no later word can change it."""
    register: dict[tuple, int] = {}
    counts: list[int] = []
    frozen: list[tuple] = []  # per state: (final, ((byte, target), ...))

    def freeze(final: bool, edges: dict[int, int]) -> int:
        key = (final, tuple(edges.items()))
        at = register.get(key)
        if at is None:
            at = register[key] = len(frozen)
            frozen.append(key)
            counts.append(final + sum(counts[t] for t in edges.values()))
        return at

    path: list[list] = [[False, {}]]
    last = b""
    order = sorted(words)
    for w in order:
        k = next((i for i, (x, y) in enumerate(zip(w, last, strict=False)) if x != y), min(len(w), len(last)))
        while len(path) > k + 1:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = freeze(*node)
        path += [[False, {}] for _ in w[k:]]
        path[-1][0] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1][last[len(path) - 1]] = freeze(*node)
    root = freeze(*path[0])
    key, target, add = [], [], []
    for state, (final, edges) in enumerate(frozen):
        seen = int(final)
        for byte, to in sorted(edges):
            key.append(state << 8 | byte)
            target.append(to)
            add.append(seen)
            seen += counts[to]
    ids = [words[w] for w in order]
    off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    arrays = [np.array(key, np.int64), np.array(target, np.int64), np.array(add, np.int64), np.array([f for f, _ in frozen], np.int64), off.astype(np.int64), np.array([i for x in ids for i in x], np.int64)]
    head = struct.pack("<9q", 0x31545344, root, max(map(len, order), default=0), *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        m = np.memmap(path, np.int64, "r")
        if m[0] != 0x31545344:
            raise ValueError("not a lexicon")
        self.root, self.longest = int(m[1]), int(m[2])
        ends = 9 + np.cumsum(m[3:9])
        self.key, self.target, self.add, self.final, self.off, self.ids = (m[e - n : e] for e, n in zip(ends, m[3:9], strict=True))

    def find(self, pieces: list[bytes]) -> list[list[int] | None]:
        """The ids of each piece, None for those it doesn't hold."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.cumsum(size) - size
        state, number = np.full(len(pieces), self.root), np.zeros(len(pieces), np.int64)
        alive = (size <= self.longest) & (size > 0) if len(self.key) else np.zeros(len(pieces), bool)
        for at in range(int(size[alive].max(initial=0))):
            go = np.flatnonzero(alive & (size > at))
            want = state[go] << 8 | flat[start[go] + at]
            k = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[k] == want
            alive[go[~hit]] = False
            state[go[hit]] = self.target[k[hit]]
            number[go[hit]] += self.add[k[hit]]
        alive &= self.final[state] == 1
        return [self.ids[self.off[n] : self.off[n + 1]].tolist() if ok else None for ok, n in zip(alive.tolist(), number.tolist(), strict=True)]


class WordCoder:
    """encode(chunks) for ChunkCoder: pieces by the lexicon, unseen ones by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.v, self.lexicon = vocabulary, lexicon

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        split = [self.v.parts(c) for c in chunks]
        pieces = list({p: None for x in split for p in x if isinstance(p, str)})
        found = self.lexicon.find([p.encode() for p in pieces])
        known = {p: self.v.merged(p) if f is None else f for p, f in zip(pieces, found, strict=True)}
        return [known[x[0]] if len(x) == 1 and isinstance(x[0], str) else [i for p in x for i in (known[p] if isinstance(p, str) else (p,))] for x in split]


class Decoder:
    """Texts of id runs, by gathering the tokens' bytes."""

    def __init__(self, vocabulary: Vocabulary):
        raw = [t.encode() + b" " for t in vocabulary.tokens]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        data = self.flat[ragged(self.start[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def _worker(tokenizer: str, lexicon: str) -> tuple[ChunkCoder, Decoder]:
    """This Python worker's coder and decoder: later tasks of the worker find its chunks. Its ids take 16 MB at most, as workers hold them on through stages of other work."""
    v = Vocabulary(tokenizer)
    return ChunkCoder(WordCoder(v, Lexicon(lexicon)), most=3 << 20), Decoder(v)


def frequent_chunks(docs: DataFrame, most: int, window: int = 2_000_000, least: int = 4) -> list[str]:
    """The most frequent chunks by counts over all texts; a task passes on what occurs `least` times in a window of its words."""

    @frugal
    def task(batches):
        held, size, text = [], 0, {}

        def counted():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            h, n = h[n >= least], n[n >= least]
            return pa.RecordBatch.from_arrays([pa.array([text[x] for x in h.tolist()], pa.string()), pa.array(n.astype(np.int64))], names=["chunk", "n"])

        for b in batches:
            for _, _, data, off in shingles.text_slices(b.column("text")):
                h, _, x, y = shingles.words(data, off, shingles.EXACT)
                u, first = np.unique(h, return_index=True)
                raw = data.tobytes()
                for k, i, j in zip(u.tolist(), x[first].tolist(), y[first].tolist(), strict=True):
                    if k not in text and j - i <= 64:
                        text[k] = raw[i:j].decode()
                held.append(h[y - x <= 64])
                size += len(h)
                if size >= window:
                    yield counted()
                    held, size, text = [], 0, {}
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(task, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "chunk").limit(most).toArrow().column("chunk").to_pylist()


def build_lexicon(docs: DataFrame, tokenizer: str, most: int = 50_000) -> str:
    """Compiles the lexicon of docs' frequent words and sends it to the executors; gives the file's name there."""
    v = Vocabulary(tokenizer)
    words = Counter(p for c in frequent_chunks(docs, most) for p in v.parts(c) if isinstance(p, str))
    data = compile_lexicon({w.encode(): v.merged(w) for w in words})
    spark = docs.sparkSession
    out, name = new_dir(spark, "lexicon"), f"{uuid.uuid4().hex}.dst"
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(data)
    spark.sparkContext.addFile(f"{out}/{name}")
    del v, words, data
    release()
    return name


def encoded(docs: DataFrame, tokenizer: str, *keep: str, lexicon: str | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """The columns in keep, n_tokens, and the ids of each whole text; with digests those of the ids and of the text decoded from them."""
    name, file = lexicon or build_lexicon(docs, tokenizer), shipped(docs.sparkSession, tokenizer)
    schema = docs.select(*keep).schema.add("n_tokens", "long")
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if digests:
        schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")

    @frugal
    def task(batches):
        coder, decoder = _worker(SparkFiles.get(file), SparkFiles.get(name))
        for b in batches:
            for first, rows, flat, sizes in coder.slices(b.column("text")):
                ends = np.cumsum(sizes)
                cols = [*(b.column(c).slice(first, rows) for c in keep), pa.array(sizes)]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                if digests:
                    raw = memoryview(flat.astype("<u4").tobytes())
                    cols.append(pa.array([hashlib.sha256(raw[4 * (e - n) : 4 * e]).hexdigest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.string()))
                    cols.append(pa.array([hashlib.sha256(t).hexdigest() for t in decoder.texts(flat, sizes)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(task, schema)


def decoded(rows: DataFrame, tokenizer: str, *keep: str) -> DataFrame:
    """The columns in keep and the text of each row's ids; null ids decode to the empty text."""
    file = shipped(rows.sparkSession, tokenizer)

    @frugal
    def task(batches):
        decoder = Decoder(Vocabulary(SparkFiles.get(file)))
        for b in batches:
            lists = b.column("ids")
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            texts = decoder.texts(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([t.decode() for t in texts], pa.string())], names=[*keep, "text"])

    return rows.select(*dict.fromkeys((*keep, "ids"))).mapInArrow(task, rows.select(*keep).schema.add("text", "string"))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents' whole texts, as digests, and those of the texts decoded from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, public_tokenizers.path("word_bpe_49k.json"), "doc_id", ids=False, digests=True)
