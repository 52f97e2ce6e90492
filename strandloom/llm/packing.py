"""Packing: bounded-space online best fit of token runs into windows of fixed size.

Each partition keeps at most OPEN windows. A document first fills whole windows of
its own; what remains goes into the open window where it leaves least room. When it
fits nowhere and all windows are taken, the fullest is topped up with the head of
the document, so that it closes without padding, and the rest is placed again. At
the end of a partition its open windows are merged; at most one unfinished window a
partition is left, and these are merged in groups of GROUP partitions. The last
window of a group is cut into lengths that are powers of two, which need no padding.

Tokens are made once for each distinct word where the tokenizer's pattern never crosses
white space, so that a text's ids are those of its words in a row.

Defined results: a null text counts as empty and gives the end id only; a null
doc_id stays null; repeated rows are packed once each; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, raw_texts, slices

WINDOW, OPEN, GROUP = 2048, 64, 256
END_ID = 1
_FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The file of a public tokenizer on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Fixed by the public format of byte-level vocabularies: the bytes that stand for themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> dict[int, str]:
    """Byte to character: printable bytes stand for themselves, the others are numbered from 256."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_pattern(file: dict) -> str | None:
    """The pattern by which a tokenizer file splits text, if a text's ids are those of its words in a row; else None.

    That holds for a lower-casing normaliser, a pattern whose matches hold no white space and all else is removed, byte-level
    pieces, and added tokens that are matched as they stand."""
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    normal = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or normal != ["NFC", "Replace", "Lowercase"] or file["model"]["type"] != "BPE":
        return None
    split, level = steps
    pattern = split["pattern"].get("Regex")
    if not pattern or split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] or t["content"].isalpha() for t in file["added_tokens"]):
        return None
    return pattern if r"[^\s" in pattern else None


class WordTokens(dict):
    """Token ids (little-endian 32-bit) by word; words are looked up many at a time.

    Words of Latin-1 characters are in normal form and split by the pattern alone, so their
    parts go straight to the tokenizer's merges; other words, and those that hold an added
    token, go through all of it. Where a tokenizer doesn't split by words, whole texts do."""

    def __init__(self, path: str, most: int = 600_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pattern = word_pattern(file)
        self.most, self.split = most, pattern and regex.compile(pattern).findall
        self.added = [t["content"] for t in file["added_tokens"]]
        self.chars = byte_characters()

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 20_000):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        hard, split, chars, added = [], self.split, self.chars, self.added
        merge, pack, forms = self.tokenizer.model.tokenize, struct.pack, [f"<{n}I" for n in range(64)]
        for w in new:
            s = w.decode()
            if s.isascii() and s.isalpha():
                ids = [t.id for t in merge(s.lower())]
            elif s.isprintable() and (s.isascii() or max(s) < "\u0100") and not any(x in s for x in added):
                ids = [t.id for p in split(s.lower()) for t in merge(p if p.isascii() else "".join([chars[b] for b in p.encode()]))]
            else:
                hard.append(w)
                continue
            n = len(ids)
            self[w] = pack(forms[n] if n < 64 else f"<{n}I", *ids)
        self.update(zip(hard, self.encoded([w.decode() for w in hard]), strict=True))

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text and the end id, as bytes."""
        end = np.array([END_ID], dtype="<u4").tobytes()
        if not self.split:
            yield from (ids + end for ids in self.encoded([t.decode() for t in texts]))
            return
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.__getitem__, words)) + end


#: The words that this Python worker has met, for all tasks that it runs.
_KNOWN: dict[str, WordTokens] = {}


class Packer:
    """Open windows of one partition. A piece is [doc, start, ids, doc_tokens]."""

    def __init__(self, emit: Callable[[list, int], None], size: int = WINDOW, most: int = OPEN):
        self.emit, self.size, self.most = emit, size, most
        self.open: list[list] = []  # [room left, pieces]

    def add(self, doc, ids: bytes, start: int = 0, total: int | None = None) -> None:
        total = len(ids) // 4 if total is None else total
        end, at = start + len(ids) // 4, start
        piece = lambda a, b: [doc, a, ids[4 * (a - start) : 4 * (b - start)], total]
        while end - at >= self.size:
            self.emit([piece(at, at + self.size)], self.size)
            at += self.size
        while at < end:
            fits = [w for w in self.open if w[0] >= end - at]
            if not fits and len(self.open) < self.most:
                self.open.append([self.size, []])
                fits = self.open[-1:]
            w = min(fits or self.open, key=lambda w: w[0])
            cut = min(end, at + w[0])
            w[0] -= cut - at
            w[1].append(piece(at, cut))
            at = cut
            if not w[0]:
                self.open.remove(w)
                self.emit(w[1], self.size)

    def close(self) -> list:
        """Merges the open windows, the fullest first; returns the pieces that don't fill one."""
        left = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open, self.most = [], 1
        for doc, start, ids, total in left:
            self.add(doc, ids, start, total)
        left = self.open[0][1] if self.open else []
        self.open = []
        return left


def _rows(pieces: list, sequence: int, keep_ids: bool, rows: list) -> None:
    at = 0
    for doc, start, ids, total in pieces:
        rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at, ids if keep_ids else None, None))
        at += len(ids) // 4


def pack(docs: DataFrame, tokenizer: Callable[[], str] = public_tokenizer, keep_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document; with keep_ids, ids holds its tokens (binary, 32-bit little-endian)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, {_FIELDS}, ids binary, part long"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, rows = TaskContext.get().partitionId(), 0, []
        schema = None

        def emit(pieces: list, _: int) -> None:
            nonlocal count
            _rows(pieces, (part << 33) | count, keep_ids, rows)
            count += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return out

        path = tokenizer()
        if path not in _KNOWN:
            _KNOWN[path] = WordTokens(path)
        words, packer = _KNOWN[path], Packer(emit, window)
        for batch in slices(batches):
            schema = schema or pa.schema([("doc_id", batch.schema.field("doc_id").type), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary()), ("part", pa.int64())])
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.texts(raw_texts(batch)), strict=True):
                packer.add(doc, ids)
            if rows:
                yield flush()
        for doc, start, ids, total in packer.close():
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, None, None, ids, part))
        if rows:
            yield flush()

    def merge(key: tuple, left: pa.Table) -> pa.Table:
        """At most GROUP unfinished windows meet here."""
        rows, count = [], 0

        def emit(pieces: list, _: int) -> None:
            nonlocal count
            _rows(pieces, (1 << 62) | (key[0].as_py() << 20) | count, keep_ids, rows)
            count += 1

        packer = Packer(emit, window, 1)
        left = left.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        for doc, start, ids, total in zip(*(left[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.add(doc, ids, start, total)
        rest = packer.close()
        n = sum(len(p[2]) // 4 for p in rest)
        while rest:  # powers of two, the largest first
            room, now = 1 << (n.bit_length() - 1), []
            n -= room
            while room:
                doc, start, ids, total = rest.pop(0)
                cut = min(room, len(ids) // 4)
                now.append([doc, start, ids[: 4 * cut], total])
                if cut < len(ids) // 4:
                    rest.insert(0, [doc, start + cut, ids[4 * cut :], total])
                room -= cut
            emit(now, 0)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]
        types = [left.schema.field("doc_id").type, *[pa.int64()] * 6, pa.binary(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # Tokens are made once: the unfinished windows are read from the stored rows.
    pieces = durable(docs.mapInArrow(fill, fields))
    left = pieces.where(F.col("part").isNotNull()).groupBy((F.col("part") / GROUP).cast("long").alias("g")).applyInArrow(merge, fields)
    out = pieces.where(F.col("part").isNull()).unionByName(left).drop("part")
    return out if keep_ids else out.drop("ids")
