"""Packing by concatenating and cutting (operator 6).

Pass one tokenises every document and writes its ids with the running token count inside its partition. The totals of
the partitions (one row a partition) give each partition's first global position by a prefix sum. Pass two adds the
two, cuts the one endless sequence into windows of ``length`` tokens and emits one record a piece; a document that
crosses a window's boundary gives one record on either side. Nothing is shuffled but the partition totals, every
sequence but the last is full, and each id lies in exactly one piece.

Defined cases: null text is empty and gives the end token alone; repeated rows and ids are packed one by one; an empty
table gives no pieces; very long texts are cut over as many windows as they need; other columns are ignored. Strings of
the vocabulary's added tokens in a text are those tokens, as in the library's own call.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.llm.common import materialize, slices, table

LENGTH, END_ID = 4096, 2
#: Chunks of a generation of a worker's memory, which holds two.
GENERATION = 200_000
TOKEN_SCHEMA = "part int, local_start long, doc_id long, n long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_workers: dict = {}


#: A full stop or comma that does not follow a letter or number, and so may belong to a longer piece.
_JOINED_STOP = re.compile(r"[.,](?<![^\W_].) ")


class _Memory(dict):
    """Ids of chunks in two generations: what was not asked for during a whole generation is forgotten.

    A full stop or comma after a letter or number is a piece of its own, so such a chunk is read as the one without it.
    A chunk that is in neither generation is noted in ``pending`` and read as None.
    """

    def __init__(self, stops: dict[str, bytes]):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.pending: list[str] = []
        self.stops = stops

    def __missing__(self, chunk: str) -> bytes | None:
        stop = self.stops.get(chunk[-1]) if chunk[-2:-1].isalnum() else None
        word = chunk[:-1] if stop else chunk
        ids = self.get(word) if stop else None
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                self.pending.append(chunk)
                return None
            self[word] = ids
        return ids + stop if stop else ids

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Ids of texts (little-endian unsigned 32-bit bytes), each white-space-delimited chunk encoded once.

    The vocabulary's pattern never crosses white space, so the ids of a text are those of its chunks in turn. A text is
    brought into the vocabulary's form first, as its normaliser does it: NFC, then lower case letter by letter. New
    chunks of letters alone are one piece each and are merged many at a time, as each ends with its only end-of-word
    token; the others are cut by the library. Texts that hold an added token's string, a control character on which Python
    and the library disagree about white space, or a code point that Python does not know are encoded whole by the library.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        kind = json.loads(vocabulary)
        steps = [x["type"] for x in kind["normalizer"]["normalizers"]] + [x["type"] for x in kind["pre_tokenizer"]["pretokenizers"]]
        if steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError("a vocabulary of words in lower case is needed")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.cutter = Tokenizer(self.tokenizer.model)  # shares the vocabulary, without normaliser and added tokens
        self.cutter.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.exact = [t.content for t in added if not t.normalized]
        self.lowered = [t.content.lower() for t in added if t.normalized]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.memory = _Memory(dict(zip(".,", self._one_by_one([".", ","]), strict=True)))

    def _one_by_one(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.cutter.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        """Ids of new chunks; those with a code point that Python does not know stay unknown."""
        words, others = [], []
        for c in {c[:-1] if c[-1] in self.memory.stops and c[-2:-1].isalnum() else c for c in chunks}:
            if c.isalpha():
                words.append(c)
            elif c.isascii() or all(unicodedata.category(x) != "Cn" for x in c):
                others.append(c)
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            self.memory.update(zip(some, self._one_by_one(some), strict=True))
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.merger.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(last) != len(some):
                self.memory.update(zip(some, self._one_by_one(some), strict=True))
                continue
            data = ids.tobytes()
            self.memory.update(zip(some, map(data.__getitem__, map(slice, [0, *last[:-1]], last)), strict=True))

    def _is_whole(self, text: str) -> bool:
        if any(t in text for t in self.exact) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return True
        return bool(self.lowered) and any(t in unicodedata.normalize("NFC", text).lower() for t in self.lowered)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower().replace("\n", " ")
        if not _JOINED_STOP.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split()

    def encode(self, texts: list[str | None], remembered: int | None = None) -> list[bytes]:
        memory, out, open_ = self.memory, [], []
        memory.turn(GENERATION if remembered is None else remembered)
        for text in texts:
            if not text:
                out.append(b"")
            elif self._is_whole(text):
                out.append(self._whole(text))
            else:
                before = len(memory.pending)
                ids = list(map(memory.__getitem__, self._chunks(text)))
                if len(memory.pending) > before:
                    open_.append((len(out), ids, memory.pending[before:]))
                out.append(b"" if len(memory.pending) > before else b"".join(ids))
        self._learn(set(memory.pending))
        memory.pending = []
        for i, ids, missing in open_:
            late = [memory[c] for c in missing]
            rest = iter(late)
            out[i] = self._whole(texts[i]) if None in late else b"".join([next(rest) if x is None else x for x in ids])
        memory.pending = []
        return out


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file's text, read where the job starts and sent to the tasks (1.7 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _tokenise(vocabulary, end_id: int, remembered: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        text = vocabulary.value
        if _workers.get("word") is None or _workers["word"][0] != hash(text):
            _workers["word"] = (hash(text), WordEncoder(text))
        encoder, part, at = _workers["word"][1], TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for some in slices(batches, 512):
            ids = [x + end for x in encoder.encode(some.column("text").to_pylist(), remembered)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(starts), some.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], names=["part", "local_start", "doc_id", "n", "ids"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _workers.clear()  # the vocabulary and the words of the first pass, in workers that live on
        for batch in slices(batches):
            first, n = batch.column("first").to_numpy(), batch.column("n").to_numpy()
            begin, last = first // length, (first + n - 1) // length
            count = last - begin + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            low = np.maximum(sequence * length, first[row])
            high = np.minimum((sequence + 1) * length, first[row] + n[row])
            start, ids = low - first[row], batch.column("ids")
            pieces = [ids[int(r)].as_buffer()[4 * a : 4 * b].to_pybytes() for r, a, b in zip(row, start.tolist(), (start + high - low).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), start, high - low, n[row], sequence, low - sequence * length]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns] + [pa.array(pieces, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, remembered: int | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their ids (binary, little-endian unsigned 32-bit).

    ``remembered``: chunks of a generation of a worker's memory; fewer take less memory and more time.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary_text(vocabulary))
    tokens = materialize(docs.select("doc_id", "text").mapInArrow(_tokenise(sent, end_id, remembered), TOKEN_SCHEMA), "pack-tokens")
    # one row per partition of pass one: bounded by the number of tasks, not by the data
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").collect()
    firsts, at = [], 0
    for r in totals:
        firsts.append((r["part"], at))
        at += r["total"]
    offsets = spark.createDataFrame(firsts, "part int, base long")
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("local_start")).alias("first"))
    return placed.mapInArrow(_cut(length), PIECE_SCHEMA)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL: dict[str, str] = {}
QUERIES = {"op6_pack": op6_pack}
