"""Encoding and decoding with a SentencePiece model, as a streaming Viterbi search.

The search keeps, for each boundary of the last ``longest`` characters, the
piece by which the best path arrives there. No later piece starts further back, so these
are all paths that can survive; where they have run together, the ids
up to that boundary are final and leave the window. Memory is bounded by
the longest piece, whatever the length of the text.

For unigram models the best path has the largest sum of scores. For BPE models
a path is best when merging would give it: a piece may follow the path to its
start only if merging the last two pieces' characters gives these two pieces.
Exactly one piece does at every boundary.

Between characters that stand side by side in no piece lies a boundary that
every path passes. Texts are cut there, first into words, and the words
a worker has met lately are not searched again.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_slices

SPACE = "▁"
#: Cut pieces, and pairs of pieces, that a Python worker remembers.
KEPT, KEPT_PAIRS = 400_000, 1_000_000
c = F.col


class Pieces:
    """A vocabulary: pieces by text with their scores, byte pieces, and the search over them."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int, bpe: bool, surfaces: dict[int, bytes] | None = None):
        self.scores, self.byte_ids, self.unknown, self.bpe = scores, byte_ids, unknown, bpe
        self.ids = {p: i for p, (i, _) in scores.items()}
        self.longest = max(map(len, scores), default=1)
        self.surfaces = {i: p.replace(SPACE, " ").encode() for p, (i, _) in scores.items()} | {b: bytes([k]) for k, b in enumerate(byte_ids or [])} | (surfaces or {})
        self.surfaces.setdefault(unknown, " ⁇ ".encode())
        self.least = min((s for _, s in scores.values()), default=0.0) - 10.0
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.joints = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.older: dict[str, bytes] = {}
        # Finds the pieces that end at each character, the longest first.
        self.ends = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.ends.add_word(p, (i, len(p)))
        self.ends.make_automaton()
        # Unless pieces join words, no piece crosses the end of a word.
        self.cuts = None if any(b[0] != SPACE == b[1] for b in self.joints) else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def merged(self, chars: str) -> list[str]:
        """Merges the neighbours whose piece has the highest score, leftmost first, until none is left."""
        parts, scores = list(chars), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = scores.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        key = self.ids[left] << 32 | self.ids[right]
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def search(self, text) -> "list[int]":
        """Ids of a text, given as any iterable of characters, in bounded memory."""
        out: list[int] = []
        window = ""  # characters behind the last committed boundary
        arrive: list[str] = [""]  # piece that arrives at each boundary of the window
        value = [0.0]
        before = ""  # last committed piece
        ids, scores, longest = self.ids, self.scores, self.longest
        for ch in text:
            window += ch
            n = len(window)
            best, how = None, ch
            for k in range(min(longest, n), 0, -1):
                piece = window[n - k :]
                if piece not in ids:
                    continue
                if self.bpe:
                    last = arrive[n - k] or before
                    if not last or last not in ids or self.may_follow(last, piece):
                        how = piece
                        break
                else:
                    total = value[n - k] + scores[piece][1]
                    if best is None or total > best:
                        best, how = total, piece
            arrive.append(how)
            if not self.bpe:
                value.append(value[n - 1] + self.least if best is None else best)
            if n >= 4 * longest:
                cut = self._converged(arrive, longest)
                if cut:
                    done = self._path(arrive, cut)
                    out += self._ids(done)
                    before, window, arrive = done[-1], window[cut:], ["", *arrive[cut + 1 :]]
                    if not self.bpe:
                        value = value[cut:]
        return out + self._ids(self._path(arrive, len(arrive) - 1))

    @staticmethod
    def _converged(arrive: list[str], longest: int) -> int:
        """The last boundary through which the paths to all boundaries of the window's end lead."""
        alive = set(range(max(0, len(arrive) - longest), len(arrive)))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(last - len(arrive[last]))
        return alive.pop()

    @staticmethod
    def _path(arrive: list[str], end: int) -> list[str]:
        path = []
        while end > 0:
            path.append(arrive[end])
            end -= len(arrive[end])
        return path[::-1]

    def _ids(self, path: list[str]) -> list[int]:
        out: list[int] = []
        for p in path:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _within(self, text: str) -> list[int]:
        """As ``search``, for a text that fits the window and a BPE model."""
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        pairs, n, done = self.pairs, len(text), 0
        arrive, start = [-1] * (n + 1), list(range(-1, n))
        for end, (piece, size) in self.ends.iter(text) if self.ids else ():
            i = end + 1
            if i == done:
                continue
            s = i - size
            last = arrive[s]
            if last >= 0:
                ok = pairs.get(last << 32 | piece)
                if not (self.may_follow(text[start[s] : s], text[s:i]) if ok is None else ok):
                    continue
            arrive[i], start[i], done = piece, s, i
        path, i = [], n
        while i:
            path.append(text[start[i] : i])
            i = start[i]
        return self._ids(path[::-1])

    def _of_cut(self, piece: str) -> bytes:
        """Ids of a cut piece, cut further where no piece joins two characters."""
        found = self.older.get(piece)
        if found is None:
            joints, ids, lo = self.joints, [], 0
            for hi in [*(i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in joints), len(piece)]:
                part = piece[lo:hi]
                ids += self._within(part) if self.bpe and hi - lo < 4 * self.longest else self.search(part)
                lo = hi
            found = np.array(ids, np.int32).tobytes()
        if len(self.known) >= KEPT:
            self.older, self.known = self.known, {}
        self.known[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a normalised text."""
        if self.cuts is None:
            return np.array(self.search(text), np.int32)
        known, of_cut = self.known, self._of_cut
        return np.frombuffer(b"".join([known.get(p) or of_cut(p) for p in self.cuts.findall(text)]), np.int32)

    def decode(self, ids) -> str:
        """The text of ids; bytes that make no character are replaced."""
        return b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "replace")


class Model:
    """A model file: the library gives the vocabulary and the normaliser, ``Pieces`` does the rest."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}
        byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(sp.is_byte, range(n))) else None
        blank = {i: b"" for i in range(n) if sp.is_control(i)}
        # Merge scores are minus the merge's rank, log probabilities are not whole numbers.
        ranked = all(float(s).is_integer() for _, s in scores.values())
        self.pieces = Pieces(scores, byte, sp.unk_id(), ranked, blank)
        self.prefix = sp.normalize("a").startswith(SPACE)

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """(ids, normalised text)."""
        normal = self.sp.normalize(text) if text else ""
        return self.pieces.encode(normal), normal

    def decode(self, ids) -> str:
        text = self.pieces.decode(ids)
        return text.removeprefix(" ") if self.prefix else text


_models: dict[str, Model] = {}


def _worker_model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _encoded(path: str):
    def run(batches):
        model = _worker_model(path)
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                ids, good, sha = [], [], []
                for text in part.column("text").to_pylist():
                    found, normal = model.encode(text or "")
                    ids.append(found)
                    good.append(model.pieces.decode(found.tolist()) == normal.replace(SPACE, " "))
                    sha.append(hashlib.sha256(found.astype("<i4").tobytes()).hexdigest())
                size = np.array([len(x) for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(size), pa.array(sha), pa.array(good)], ["doc_id", "ids", "n_tokens", "ids_sha256", "round_trip"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of every row of ``docs`` (doc_id, text): doc_id, ids, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip.

    ``round_trip`` says that decoding gives the normalised text. Null and
    empty texts have no ids; null doc_ids and repeated rows pass like any other.
    ``path``: the model file, at the same place on every machine.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoded(path), f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean")


def _decoded(path: str):
    def run(batches):
        model = _worker_model(path)
        for batch in batches:
            lists = batch.column("ids")
            texts = [None if x is None else model.decode(x) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """Texts of rows (doc_id, ids); null ids give a null text."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(_decoded(path), f"doc_id {kind}, text string")
