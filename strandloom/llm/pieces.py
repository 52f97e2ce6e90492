"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text's words (with the spaces before them) are segmented apart from one another: no
piece goes across a word's start or a line end. Words of equal length form a matrix
of code points and advance together: at each position the hashes of all substrings
that end there probe the sorted keys of the pieces, and the row maxima are stored as
back-pointers, longest piece first among equals. The segmentation has the highest sum
of piece scores. A character that no piece has becomes its UTF-8 bytes.

As in the public format, a space is put before a text and spaces become U+2581; a
U+2581 of the text itself is written as bytes, so that decoding gives every text back.

Defined results: a null text counts as empty and has no ids; ids that are null decode
to an empty text; repeated rows are encoded alike; an empty table gives no rows; other
columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, slices

_P = np.uint64(0x100000001B3 * 2 + 1)
_SPACE, _LITERAL = 0x2581, 0x110000
#: Code points that are worked on at once.
CELLS = 1 << 19
#: Words that a Python worker remembers; they are forgotten together.
MOST = 400_000


def public_pieces(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Pieces:
    keys: np.ndarray  # sorted
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    byte_score: float
    unknown: int
    values: list[bytes]  # text of each id
    powers: np.ndarray
    of_id: np.ndarray  # score of each id, of bytes too

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        normal, byte_ids, values = [], np.full(256, -1, dtype=np.int64), []
        for i in range(s.get_piece_size()):
            p = s.id_to_piece(i)
            if s.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                values.append(bytes([int(p[3:5], 16)]))
            elif s.is_control(i) or s.is_unknown(i) or s.is_unused(i):
                values.append(b"")
            else:
                normal.append((p, i, s.get_score(i)))
                values.append(p.replace("▁", " ").encode())
        if any("\n" in p or "▁" in p.lstrip("▁") for p, _, _ in normal):
            raise ValueError("a piece goes across words: words can't be segmented apart")
        longest = max(len(p) for p, _, _ in normal)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _P, dtype=np.uint64)]), dtype=np.uint64)
        keys, size = np.zeros(len(normal), dtype=np.uint64), np.array([len(p) for p, _, _ in normal])
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            codes = np.frombuffer("".join(normal[i][0] for i in at).encode("utf-32-le"), dtype="<u4").reshape(len(at), n)
            keys[at] = Pieces.hashes(codes)[:, -1]
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], np.array([i for _, i, _ in normal])[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        scores = np.array([x for _, _, x in normal])[order]
        # Pieces that the vocabulary's author set apart have scores near -1e9; here they rank below all others.
        scores = np.maximum(scores, scores[scores > -1e8].min(initial=0) - 1)
        byte_score = float(scores.min()) - 10
        of_id = np.full(len(values), byte_score)
        of_id[ids] = scores
        return Pieces(keys, ids, scores, longest, byte_ids, byte_score, s.unk_id(), values, powers, of_id)

    @staticmethod
    def hashes(codes: np.ndarray) -> np.ndarray:
        """Rolling hash of each row's prefixes, the empty one first."""
        f = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        for e in range(codes.shape[1]):
            f[:, e + 1] = f[:, e] * _P + (codes[:, e].astype(np.uint64) + np.uint64(1))
        return f

    def segment(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, back, piece) of the best segmentation of each row: back and piece by end position; piece -1 is bytes."""
        b, n = codes.shape
        f = self.hashes(codes)
        size = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where((codes < 0x10000) | (codes == _LITERAL), 3, 4)))
        best = np.full((b, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((b, n + 1), dtype=np.int32), np.full((b, n + 1), -1, dtype=np.int32)
        rows = np.arange(b)
        for e in range(1, n + 1):
            m = min(e, self.longest)
            key = f[:, e : e + 1] - f[:, e - m : e] * self.powers[m:0:-1]
            at = np.minimum(np.searchsorted(self.keys, key.ravel()), len(self.keys) - 1).reshape(b, m)
            hit = self.keys[at] == key
            total = np.where(hit, best[:, e - m : e] + self.scores[at], -np.inf)
            raw = best[:, e - 1] + self.byte_score * size[:, e - 1]
            total[:, -1] = np.maximum(total[:, -1], raw)
            pick = np.argmax(total, axis=1)
            best[:, e] = total[rows, pick]
            back[:, e] = m - pick
            took = np.where(hit[rows, pick], self.ids[at[rows, pick]], -1)
            bytes_won = (pick == m - 1) & ~(hit[:, -1] & (best[:, e - 1] + self.scores[at[:, -1]] >= raw))
            piece[:, e] = np.where(bytes_won, -1, took)
        return best[:, n], back, piece

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes, float]]:
        """Each word with its ids (32-bit little-endian) and score; words of one length go together."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            step = max(1, CELLS // (n * min(n, self.longest)))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), dtype="<u4").reshape(len(part), n).astype(np.int64)
                codes = np.where(codes == _SPACE, _LITERAL, np.where(codes == 32, _SPACE, codes))
                score, back, piece = self.segment(codes)
                rows, at = np.arange(len(part)), np.full(len(part), n)
                out = np.full((len(part), n), -2, dtype=np.int64)  # from the end; -2 is nothing, -1 - c the bytes of a character c
                k = 0
                while at.any():
                    live = at > 0
                    p = piece[rows, at]
                    c = codes[rows, np.maximum(at - 1, 0)]
                    out[:, n - 1 - k] = np.where(live, np.where(p >= 0, p, -3 - c), -2)
                    at = np.where(live, at - back[rows, at], 0)
                    k += 1
                for w, row, s in zip(part, out, score.tolist(), strict=True):
                    ids = row[row != -2]
                    if (ids < 0).any():
                        ids = np.concatenate([[x] if x >= 0 else self.bytes_of(int(-3 - x)) for x in ids])
                    yield w, ids.astype("<u4").tobytes(), s

    def bytes_of(self, code: int) -> list[int]:
        raw = chr(_SPACE if code == _LITERAL else code).encode()
        return [int(i) if (i := self.byte_ids[x]) >= 0 else self.unknown for x in raw]


_WORDS = re.compile(r" *[^ \n]+| +|\n")


class Known(dict):
    """The ids of the words that this Python worker has met, for all tasks that it runs."""

    def __init__(self, pieces: Pieces, most: int):
        super().__init__()
        self.pieces, self.most = pieces, most

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(words)
        for w, ids, _ in self.pieces.encode_words(new):
            self[w] = ids


_KNOWN: dict[str, Known] = {}


def _known(path: str) -> Known:
    if path not in _KNOWN:
        _KNOWN[path] = Known(Pieces.load(path), MOST)
    return _KNOWN[path]


def encode(docs: DataFrame, model: Callable[[], str] = public_pieces) -> DataFrame:
    """Adds ids (binary, 32-bit little-endian) and log_score to docs, which needs text."""
    keep = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("text"))
    schema = ", ".join(f"c{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(model())
        score, ids_of = known.pieces.of_id, known.__getitem__
        for batch in slices(batches):
            split = [_WORDS.findall(f" {t.decode()}") if t else [] for t in raw_texts(batch)]
            known.learn(set().union(*split))
            out = [b"".join(map(ids_of, s)) for s in split]
            total = [float(score[np.frombuffer(x, dtype="<u4")].sum()) for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary()), pa.array(total)], [*batch.schema.names[:-1], "ids", "log_score"])

    out = inner.mapInArrow(run, f"{schema}, ids binary, log_score double")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "ids", "log_score")


def decode(coded: DataFrame, model: Callable[[], str] = public_pieces) -> DataFrame:
    """Adds decoded, the text of ids."""
    keep = coded.columns
    inner = coded.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("ids").alias("ids"))
    schema = ", ".join(f"c{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = _known(model()).pieces.values.__getitem__
        for batch in slices(batches, "ids"):
            raw = (b"".join(map(value, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in batch.column("ids").to_pylist())
            text = [r.decode("utf-8", "replace")[1:] for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], [*batch.schema.names[:-1], "decoded"])

    return inner.mapInArrow(run, f"{schema}, decoded string").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "decoded")
