"""Byte-level BPE encoding and decoding (operator 5).

Pre-tokenisation uses no regular expression. Each code point gets a class from one array; class, next class and the
contraction letters after an apostrophe give it a symbol; a symbol is a transition function over eight states. Function
composition is associative, so the text is dealt into blocks: the composed function of every block is computed for all
states at once, a short scan over the blocks gives each block's entry state, and a second sweep gives the state before
every character, and with it the boundaries. The slices feed pair merging, which is vectorised over all words that the
worker has not met yet and cached. Offsets (first byte of each token) are kept, and decoding uses them to place bytes.

Defined cases: null text is empty and has no ids; white space, very long words and any code point work; repeated rows
are encoded one by one; an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import table

ENCODED_SCHEMA = "doc_id long, ids binary, offsets binary"
#: Characters that are pre-tokenised together; a longer text goes alone.
CHUNK_CHARS = 1 << 20
CACHE_WORDS = 300_000
#: Words of more bytes are merged with a heap instead of in the vectorised rounds.
LONG_WORD = 256

LETTER, NUMBER, OTHER, WHITE, SPACE, STOP = range(6)
# symbols 0-2: letter, number, other; the rest:
SHORT, LONG, ATTACH, ALONE, INNER, BREAK = range(3, 9)
# states
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)


def class_table() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[32] = SPACE
    return out


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by symbol and state."""
    to, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    to[LETTER], to[NUMBER], to[OTHER] = IN_LETTERS, IN_NUMBERS, IN_OTHER
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        cut[symbol, [state, AFTER_SPACE]] = False
    to[LETTER, [ONE_MORE, TWO_MORE]] = FRESH, ONE_MORE
    cut[LETTER, [ONE_MORE, TWO_MORE]] = False
    to[SHORT], to[LONG] = ONE_MORE, TWO_MORE
    for symbol in (SHORT, LONG):  # inside a run of others, or after its space, an apostrophe is one of the run
        to[symbol, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        cut[symbol, [IN_OTHER, AFTER_SPACE]] = False
    to[ATTACH], to[ALONE], to[INNER], to[BREAK] = AFTER_SPACE, FRESH, IN_WHITE, FRESH
    cut[INNER, IN_WHITE] = False
    return to, cut


NEXT_STATE, CUTS = _machine()


def symbols(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbol of each character; ``classes`` holds STOP where a text ends."""
    out = classes.copy()
    after = np.append(classes[1:], STOP).astype(np.uint8)
    white = (classes == WHITE) | (classes == SPACE)
    inner = white & ((after == WHITE) | (after == SPACE) | (after == STOP))
    out[white] = np.where(classes[white] == SPACE, ATTACH, ALONE)
    out[inner] = INNER
    out[classes == STOP] = BREAK
    for i in np.flatnonzero((points == 39) & (after == LETTER)).tolist():
        a, b = int(points[i + 1]), int(points[i + 2]) if i + 2 < len(points) and classes[i + 2] != STOP else 0
        if chr(a) in "stmd":
            out[i] = SHORT
        elif (chr(a), chr(b)) in (("r", "e"), ("v", "e"), ("l", "l")):
            out[i] = LONG
    return out


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """Whether a token starts at each character, by a scan of composed transition functions."""
    n = len(symbol)
    width = max(1, int(n**0.5))
    blocks = -(-n // width)
    padded = np.full(blocks * width, BREAK, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    flat = NEXT_STATE.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in columns:
        whole = flat[(column.astype(np.intp) * 8)[:, None] + whole]
    entry, state = np.empty(blocks, np.uint8), FRESH
    for b in range(blocks):
        entry[b] = state
        state = whole[b, state]
    before = np.empty((width, blocks), np.uint8)
    for t, column in enumerate(columns):
        before[t] = entry
        entry = flat[column.astype(np.intp) * 8 + entry]
    return CUTS[symbol, before.T.ravel()[:n]]


class Codec:
    """Ranks of a vocabulary file, its pair table and the words met so far."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in keys.tolist()] + [0], np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.classes = class_table()
        self.cache: dict[bytes, bytes] = {}

    NONE = 1 << 40

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], self.NONE)

    def _merge_long(self, word: bytes) -> bytes:
        """One long word: a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = rank, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := self.pairs.get(ids[p] << 20 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _merge(self, words: list[bytes]) -> None:
        """Merge new words into the cache: each round applies, in every word, its lowest-ranked pair."""
        plain = []
        for w in words:
            if (r := self.ranks.get(w)) is not None:
                self.cache[w] = r.to_bytes(4, "little")
            elif len(w) > LONG_WORD:
                self.cache[w] = self._merge_long(w)
            else:
                plain.append(w)
        if not plain:
            return
        token = self.single[np.frombuffer(b"".join(plain), np.uint8)]
        word = np.repeat(np.arange(len(plain)), [len(w) for w in plain])
        done_words, done_tokens = [], []
        rank = np.full(len(token), self.NONE)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same] = self._rank(token[same], token[same + 1])
        while len(token):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            going = least < self.NONE
            stay = np.repeat(going, size)
            done_words.append(word[~stay])
            done_tokens.append(token[~stay])
            if not going.any():
                break
            token, word, rank = token[stay], word[stay], rank[stay]
            hit = np.flatnonzero(rank == np.repeat(least[going], size[going]))
            hit = hit[np.diff(word[hit], prepend=-1) != 0]  # the leftmost of each word
            token[hit] = rank[hit]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            token, word, rank = token[keep], word[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                inside = (left + 1 < len(token)) & (word[np.minimum(left + 1, len(token) - 1)] == word[left])
                rank[left] = self.NONE
                ok = left[inside]
                rank[ok] = self._rank(token[ok], token[ok + 1])
        word, token = np.concatenate(done_words), np.concatenate(done_tokens)
        order = np.argsort(word, kind="stable")
        data = token[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(plain)))).tolist()
        for w, a, b in zip(plain, [0, *ends], ends, strict=False):
            self.cache[w] = data[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        if not texts:
            return []
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = self.classes[points]
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes[stops] = STOP
        at = np.flatnonzero(token_starts(symbols(points, classes)))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        edge = (np.cumsum(width) - width)[at].tolist()
        data = joined.encode("utf-8", "surrogatepass")
        words = [data[a:b] for a, b in zip(edge, edge[1:] + [len(data)], strict=True)]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        # the stops are tokens of their own: the texts lie between them
        ends = np.searchsorted(at, stops).tolist()
        begins = [0, *(e + 1 for e in ends[:-1])]
        new = set(words).difference(self.cache)
        if new:
            self._merge(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, words[a:b])) for a, b in zip(begins, ends, strict=True)]

    def offsets(self, ids: bytes) -> bytes:
        """First byte of each token, and the length of all: one number more than ids."""
        n = self.lengths[np.frombuffer(ids, "<u4")]
        return np.append(0, np.cumsum(n)).astype("<u4").tobytes()

    def decode(self, ids: bytes, offsets: bytes) -> bytes:
        """The tokens' bytes, each placed at its offset."""
        token, at = np.frombuffer(ids, "<u4"), np.frombuffer(offsets, "<u4").astype(np.int64)
        source = np.repeat(self.starts[token] - at[:-1], np.diff(at)) + np.arange(at[-1])
        return self.bytes[source].tobytes()


_codecs: dict[int, Codec] = {}


def codec(rank_file: bytes) -> Codec:
    """One codec a worker and vocabulary."""
    key = hash(rank_file)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file)
    return _codecs[key]


def rank_file(path: str | None = None) -> bytes:
    """The rank file's bytes, read where the job starts and sent to the tasks (0.8 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def chunks(sizes: list[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ``most`` at most; a larger row goes alone."""
    a = held = 0
    for i, n in enumerate(sizes):
        if i > a and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and offsets (binary, little-endian unsigned 32-bit) of each row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(rank_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks([len(t) for t in texts]):
                ids = own.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary()), pa.array([own.offsets(x) for x in ids], pa.binary())], names=["doc_id", "ids", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED_SCHEMA)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded bytes (column ``decoded``) of what :func:`encode` returns."""
    sent = encoded.sparkSession.sparkContext.broadcast(rank_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                out = [own.decode(i, o) for i, o in zip(some.column("ids").to_pylist(), some.column("offsets").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


SQL: dict[str, str] = {}
QUERIES = {"op5_byte_bpe": op5_byte_bpe}
