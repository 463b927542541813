"""Byte-pair encoding and decoding with a given vocabulary file, in batched numpy rounds.

Every distinct word of a batch is encoded once. The symbols of all new words stand in one
flat array; a round looks up all neighbouring pairs by binary search over the sorted pair
keys, takes each word's lowest rank, merges all its places of that pair (leftmost first
where they overlap) and closes the gaps. Words without a mergeable pair leave the rounds.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common, flat

#: Bytes of words, ids and strings remembered by a task, at most; then it starts afresh.
REMEMBER = 24 << 20
_NONE = np.int64(1 << 62)


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where it prints, else the next code point from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Coder:
    """Reads a BPE file of the tokenizers library whose words end in a suffix symbol. ``strings``: words' ids and names are also remembered as text, for ``digests``."""

    def __init__(self, path: str, strings: bool = False):
        self.strings = strings
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.name = [names.get(i, "") for i in range(max(names) + 1)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank = pairs[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace("^\\s", "^\\p{White_Space}")).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.gaps = regex.compile(r"\p{White_Space}+")
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.count, self.start = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.written: list[str] = []
        self.spoken: list[str] = []
        self.held = 0

    def split(self, text: str) -> list[str]:
        """Words of a text after normalisation, special tokens as they stand."""
        if "<|" in text and len(pieces := self.cut(text)) > 1:
            return [w for p in pieces for w in ([p] if p in self.special else self.split(p))]
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return self.words(text)

    def learn(self, words: set[str]) -> None:
        """Encodes words not met before."""
        new = [w for w in words if w not in self.at]
        if not new:
            return
        ids, count = self.merge(new)
        start = len(self.ids) + np.cumsum(count) - count
        self.at.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
        self.ids, self.count, self.start = np.append(self.ids, ids), np.append(self.count, count), np.append(self.start, start)
        self.held += 4 * len(ids) + sum(map(len, new)) + 150 * len(new)
        if self.strings:
            ends = np.cumsum(count).tolist()
            for lo, hi in zip([0, *ends], ends, strict=False):
                part = ids[lo:hi].tolist()
                self.written.append(" ".join(map(str, part)))
                self.spoken.append(" ".join(map(self.name.__getitem__, part)))
                self.held += len(self.written[-1]) + len(self.spoken[-1]) + 100

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        raw = [w.encode("utf-8") for w in words]
        size = np.array([len(x) for x in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(size) - 1
        ids = self.first[data]
        ids[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(words)), size)
        marked = np.array([i for i, w in enumerate(words) if w in self.special], dtype=np.int64)
        done = [(marked, np.array([self.special[words[i]] for i in marked], dtype=np.int64))]
        if len(marked):
            keep = ~np.isin(word, marked)
            ids, word = ids[keep], word[keep]
        while len(ids):
            rank = np.full(len(ids), _NONE)  # of the pair that begins at each place
            pair = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = (self.pairs[at] == pair) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.rank[at[hit]]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            ended = best == _NONE
            size = np.diff(np.append(starts, len(ids)))
            over = np.repeat(ended, size)
            done.append((word[over], ids[over]))
            chosen = (rank == np.repeat(best, size)) & ~over
            where = np.flatnonzero(chosen)
            if len(where):  # of a run of overlapping places every second one stays, from the left
                run = np.concatenate([[True], np.diff(where) != 1])
                begin = where[np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))]
                where = where[(where - begin) % 2 == 0]
                ids[where] = self.made[rank[where]]
            stay = ~over
            stay[where + 1] = False
            ids, word = ids[stay], word[stay]
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))

    def known(self, texts: list[str]) -> list[list[int]]:
        """Place of every word of every text in the memory, after learning new ones."""
        if self.held > REMEMBER:
            self.forget()
        split = [self.split(t) for t in texts]
        self.learn({w for ws in split for w in ws})
        at = self.at
        return [[at[w] for w in ws] for ws in split]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the place where each text's begin, with the end."""
        known = self.known(texts)
        words = np.concatenate([np.zeros(0, dtype=np.int64), *(np.array(ws, dtype=np.int64) for ws in known)])
        count = self.count[words]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[words] - ends[:-1], count)]
        return ids, ends[np.concatenate([[0], np.cumsum([len(ws) for ws in known], dtype=np.int64)])]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        return [ids[lo:hi].tolist() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: names of the tokens, a space between."""
        return " ".join(map(self.name.__getitem__, ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Token count, digest of the ids and digest of the decoded text.

        Ids and names join with single spaces, so a text's strings are those of its words joined.
        """
        out = []
        for ws in self.known(texts):
            ids = hashlib.sha256(" ".join(map(self.written.__getitem__, ws)).encode())
            back = hashlib.sha256(" ".join(map(self.spoken.__getitem__, ws)).encode("utf-8"))
            out.append((int(self.count[ws].sum()) if ws else 0, ids.hexdigest(), back.hexdigest()))
        return out


def vocabulary() -> str:
    """Place of the public word-level vocabulary; other files are given by their path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _each_chunk(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    texts = [t or "" for t in batch.column(text_at).to_pylist()]
    for lo, hi in flat.chunks(texts):
        yield batch.slice(lo, hi - lo), texts[lo:hi]


def encode_documents(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with n_tokens and ids (array of int).

    Null and empty texts, and texts of white space alone, have no tokens. Texts of any
    length are encoded whole; repeated rows give repeated results, an empty table an empty
    one. ``path`` is a vocabulary file that every executor can open.
    """
    source = common.pick(docs, *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path or vocabulary())

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, texts in _each_chunk(batch, len(keep)):
                ids, ends = coder.encode_flat(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(ends), pa.int64()), lists], names=[*keep, "n_tokens", "ids"])

        return common.by_batch(work)(batches)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{shape}, n_tokens long, ids array<int>")


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded text of rows with doc_id and ids. Null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path or vocabulary())
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return common.pick(coded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of ids and decoded texts of all ``documents``.

    Null texts count as empty; empty texts and texts of white space have no tokens and the
    digest of the empty string. Texts of any length are encoded whole; repeated rows and null
    doc_ids are rows like any other; an empty table gives an empty one; other columns are not read.
    """
    path = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, strings=True)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, texts in _each_chunk(batch, 1):
                n, ids, back = zip(*coder.digests(texts), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return common.by_batch(work)(batches)

    docs = common.pick(common.read(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
