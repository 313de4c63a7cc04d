"""SentencePiece BPE, encoded by backtracking.

A sequence of pieces is what BPE makes of a text if and only if every two adjacent pieces are what it makes of
their own two strings. So a text is walked from its start with the longest piece that fits there (an Aho-Corasick pass
over the reversed text finds the longest piece at every place); a piece is taken if it goes with the one before, which
merging the two strings again decides; otherwise the next shorter one is tried; where none is left, the place is marked
in a bitfield as failed and the last piece is taken back. A failed place is never tried again, so the steps stay
in proportion to the text's length.

Texts are cut where no piece can span, as the model's pieces show: before a space mark, between a Latin letter and
another character, around characters that no piece holds. What lies between cuts is encoded by itself, short runs are remembered.

Defined results: NULL and empty text have no pieces, only the begin and end ids; characters outside the model
become the ids of their bytes; repeated rows give equal rows; a NULL id is kept. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import read

SPACE, LETTERS = "▁", "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ"
#: Runs that a worker remembers at most, twice, and the length of a run that is remembered.
RUNS, SHORT = 200_000, 48
NONE = float("-inf")


class Pieces:
    """A BPE model with byte fallback, no user-defined and no unused pieces."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        bytes_ = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}
        if len(bytes_) < 256 or any(map(m.is_unused, range(n))):
            raise ValueError("a BPE model with byte fallback and without unused pieces is needed")
        ids = {m.id_to_piece(i): i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        self.score = {p: m.get_score(i) for p, i in ids.items()}
        self.byte_ids = [np.uint32(bytes_[b]).tobytes() for b in range(256)]
        # a character that only longer pieces hold is a piece of its own here, written as bytes
        self.alphabet = {c for p in ids for c in p}
        self.text = [*ids, *sorted(self.alphabet - ids.keys())]
        self.packed = [np.uint32(ids[p]).tobytes() if p in ids else self.fallback(p) for p in self.text]
        self.size = list(map(len, self.text))
        at = {p: k for k, p in enumerate(self.text)}
        self.shorter = [next((at[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in at), None) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for p, k in at.items():
            self.automaton.add_word(p[::-1], k)
        self.automaton.make_automaton()
        apart = re.escape("".join(c for c in "\n\t" if c not in self.alphabet))
        other = f"[^{SPACE}{apart}]"
        tail = f"{other}*"
        if not any(re.search(f"[{LETTERS}][^{LETTERS}]", p) for p in ids):
            other = f"[^{LETTERS}{SPACE}{apart}]"
            tail = f"{other}*[{LETTERS}]*"
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            self.cut = re.compile(f"[^{apart}]+|[{apart}]" if apart else "(?s:.+)").findall
        else:
            self.cut = re.compile(f"{SPACE}+{tail}|{other}{tail}|[{LETTERS}]+" + f"|[{apart}]" * bool(apart)).findall
        self.known = re.compile(f"[{re.escape(''.join(sorted(self.alphabet)))}]+")
        self.begin, self.end = (np.uint32(i).tobytes() for i in (m.bos_id(), m.eos_id()))
        self.steps, self.after, self.runs = {}, After(self), Runs(self)

    def fallback(self, char: str) -> bytes:
        return b"".join(self.byte_ids[b] for b in char.encode())

    def merge(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """BPE by its rule: of all two neighbours that make a piece, the best score is merged, the first of equals.
        Gives the symbols at the end, the score of each step, and the first and last symbol before and after each."""
        symbols, scores, firsts, lasts = list(text), [], [text[0]], [text[-1]]
        while True:
            joined = [self.score.get(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
            best = max(joined, default=NONE)
            if best == NONE:
                return symbols, scores, firsts, lasts
            k = joined.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            scores.append(best)
            firsts.append(symbols[0])
            lasts.append(symbols[-1])

    def merged(self, piece: int) -> tuple:
        """Is merging the string of a piece that piece again, and the steps of it."""
        if piece not in self.steps:
            symbols, *steps = self.merge(self.text[piece])
            self.steps[piece] = (symbols == [self.text[piece]], *steps)
        return self.steps[piece]

    def longest(self, run: str) -> dict[int, int]:
        """The longest piece at each place, counted from the end: an Aho-Corasick pass over the reversed run, which names
        the longest of the pieces that end at a place first."""
        if len(run) <= SHORT:
            return dict([*self.automaton.iter(run[::-1])][::-1])
        out: dict[int, int] = {}
        for end, k in self.automaton.iter(run[::-1]):
            out.setdefault(end, k)
        return out

    def backtrack(self, run: str) -> list[int]:
        """The pieces of a run of characters of the alphabet."""
        top = len(run) - 1
        longest, failed = self.longest(run), bytearray(len(run) // 8 + 1)
        out: list[int] = []
        size, shorter, after = self.size, self.shorter, self.after
        pos, piece, fits = 0, longest[top], after[-1]
        while True:
            while piece is not None:
                end = pos + size[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and fits[piece]:
                    break
                piece = shorter[piece]
            else:  # nothing follows here: never again
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= size[piece]
                piece, fits = shorter[piece], after[out[-1] if out else -1]
                continue
            out.append(piece)
            if end > top:
                return out
            pos, fits, piece = end, after[piece], longest[top - end]

    def encode_run(self, run: str) -> bytes:
        if self.alphabet.issuperset(run):
            return b"".join([self.packed[k] for k in self.backtrack(run)])
        out, at = [], 0
        for m in self.known.finditer(run):
            out += map(self.fallback, run[at : m.start()])
            out.append(self.encode_run(m.group()))
            at = m.end()
        return b"".join([*out, *map(self.fallback, run[at:])])

    def encode(self, text: str) -> bytes:
        """32-bit little-endian ids of a text, the begin and end ids among them."""
        runs = self.cut(self.model.normalize(text))
        return b"".join([self.begin, *map(self.runs.__getitem__, runs), self.end])

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


class Fits(dict):
    """next piece -> does merging the strings of a piece and the next, side by side, give these two? The steps inside each
    are known; only whether one across their border comes before the next of them has to be seen."""

    def __init__(self, pieces: Pieces, left: int):
        self.pieces, self.left = pieces, left

    def __missing__(self, right: int) -> bool:
        self[right] = fit = self.fit(right)
        return fit

    def fit(self, right: int) -> bool:
        sound, right_scores, firsts, _ = self.pieces.merged(right)
        if self.left < 0 or not sound:
            return sound
        _, left_scores, _, lasts = self.pieces.merged(self.left)
        score, i, j = self.pieces.score, 0, 0
        while True:
            across = score.get(lasts[i] + firsts[j], NONE)
            a = left_scores[i] if i < len(left_scores) else NONE
            b = right_scores[j] if j < len(right_scores) else NONE
            if across > a and across >= b:  # of equals, the first place goes first
                return False
            if a == b == NONE:
                return True
            if a >= b:
                i += 1
            else:
                j += 1


class After(dict):
    """piece -> what may follow it; -1: the start of a run. A vocabulary bounds it."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, left: int) -> Fits:
        self[left] = fits = Fits(self.pieces, left)
        return fits


class Runs(dict):
    """run -> its ids. Long runs are not remembered; when it is full, what was asked for since it was last full stays."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.old = pieces, {}

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run) or self.pieces.encode_run(run)
        if len(run) <= SHORT:
            if len(self) > RUNS:
                self.old = dict(self)
                self.clear()
            self[run] = ids
        return ids


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One model a worker process."""
    return Pieces(path)


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, ids: 32-bit little-endian ids with begin and end."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path)
        for b in batches:
            ids = [p.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_pieces(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) -> doc_id, ids, text."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            texts = [m.decode(np.frombuffer(i.as_py(), "<u4").tolist()) for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode_pieces(encode_pieces(read(spark, sf_dir, "documents")))
    return done.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
