"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``Transducer`` compiles a model file: its normaliser (character map, dummy prefix,
white space marks), its pieces and its byte fallback. Composing it with an input
gives a lattice of arcs (from, to, pieces), a character that no piece covers being
one arc that emits its byte pieces; the shortest path in the tropical semiring
(minimum over paths, sum along a path) is the encoding.

* In a unigram model an arc weighs minus its piece's score, in single precision as
  the library has it.
  Sums begin anew in each part (see below); the library's, over a whole text, lose
  digits as they grow, so that paths that are nearly equal can come out otherwise there.
* In a BPE model an arc weighs nothing if merging the previous piece and this
  one by rank gives back just these two, and is infinite otherwise. Merges on
  both sides of a border that none crosses do not depend on each other, so a
  sequence is the model's encoding if and only if every pair of neighbours is
  its own encoding: one path of finite weight exists, and it is that encoding.

Composition is done part by part where no piece spans a border (before white
space marks, around line ends, before stops that follow a letter), and the paths of parts are
remembered, so that repeated words cost one look-up. The result is that of the
whole input, of any length.

A model's character map replaces the longest key at each place; user-defined
pieces are left as they are by it, and are pieces wherever they stand. Unused pieces
of a unigram model make no arcs; in a BPE model they are merged, then split again as
they were merged. Refused are user-defined pieces of unigram models (the library's
bonus for them is not documented), white space as a suffix, and denormalisers.

Defined cases: a null text has null tokens; an empty text has none. Characters
that no piece covers become byte pieces, or in models without them one unknown
piece for each run of such characters. Decoding follows the library: invalid bytes
become U+FFFD and the dummy prefix is removed. Repeated rows are encoded each, texts
of any length whole; an empty table stays empty. All columns are kept; one named like
the added one is replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.common import pieces as sliced

MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of parts and their paths that are remembered in a worker, and as many before them; pairs of pieces likewise.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 32_000_000, 500_000
#: Penalty of an unknown character below the least score of a unigram model.
UNKNOWN_PENALTY = 10.0
INFINITE = float("inf")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """A normaliser's replacements, read from its double array (a trie over UTF-8 bytes)."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        units, texts = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
        below = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        places, keys = np.array([below(units[0])], np.int64), [b""]
        self.keys: dict[str, str] = {}
        while keys:
            children, names = [], []
            for byte in range(1, 256):
                child = places ^ byte
                fine = np.flatnonzero(child < len(units))
                fine = fine[(units[child[fine]] & 0x800000FF) == byte]
                for i in fine.tolist():
                    unit = int(units[child[i]])
                    place, key = int(child[i]) ^ int(below(unit)), keys[i] + bytes([byte])
                    if unit >> 8 & 1:
                        start = int(units[place]) & 0x7FFFFFFF
                        self.keys[key.decode()] = texts[start : texts.index(0, start)].decode()
                    children.append(place)
                    names.append(key)
            places, keys = np.array(children, np.int64), names
        self.single = {ord(k): v for k, v in self.keys.items() if len(k) == 1}
        longer = [k for k in self.keys if len(k) > 1]
        self.longest = max(map(len, longer), default=1)
        group = lambda at: "".join(sorted({re.escape(k[at]) for k in longer}))
        self.several = re.compile(f"[{group(0)}](?=[{group(1)}])") if longer else None

    def __call__(self, text: str) -> str:
        if self.several is None or not (m := self.several.search(text)):
            return text.translate(self.single)
        out, done = [], 0
        while m:
            at = m.start()
            key = next((k for n in range(self.longest, 1, -1) if (k := text[at : at + n]) in self.keys), None)
            if key is not None:
                out += [text[done:at].translate(self.single), self.keys[key]]
                done = at + len(key)
            m = self.several.search(text, max(done, at + 1))
        return "".join([*out, text[done:].translate(self.single)])


def single(x: float) -> float:
    """Rounded to single precision."""
    return struct.unpack("<f", struct.pack("<f", x))[0]


class Transducer:
    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix, self.squeeze, self.escape = UNIGRAM, True, True, True
        self.map: CharacterMap | None = None
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
                self.kind = trainer.get(3, UNIGRAM)
                if trainer.get(24):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                spec = dict(fields(value))
                self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
                self.map = CharacterMap(spec[2]) if spec.get(2) else None
            elif number == 5 and dict(fields(value)).get(2):
                raise ValueError("denormalisers are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is not supported")
        if self.kind == UNIGRAM and USER in self.types:
            raise ValueError("user-defined pieces of unigram models are not supported")
        numbered = list(enumerate(zip(self.pieces, self.types, strict=True)))
        # user-defined pieces are cut out beforehand; in a BPE model unused ones merge
        arcs = {NORMAL} if self.kind == UNIGRAM else {NORMAL, UNUSED}
        self.ids = {p: i for i, (p, t) in numbered if t in arcs}
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in numbered if t == BYTE}
        normal = [self.scores[i] for i, t in enumerate(self.types) if t == NORMAL]
        self.penalty = UNKNOWN_PENALTY - min(normal, default=0.0)
        user = sorted((p for p, t in zip(self.pieces, self.types, strict=True) if t == USER and p), key=len, reverse=True)
        self.user = re.compile("(" + "|".join(map(re.escape, user)) + ")") if user else None
        self.user_ids = {p: i for i, (p, t) in numbered if t == USER}
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(sorted(re.escape(c) for c in "\n\t\r" if c not in inner))
        split_marks = not any(MARK in p.lstrip(MARK) for p in self.ids)
        word = f"[^{MARK}{alone}]" if split_marks else f"[^{alone}]" if alone else r"[\s\S]"
        odd = {c for p in self.ids for c in re.findall(r"([^\W\d_])[.,;:!?]", p) if not c.isalpha()}
        letter = rf"[^\W\d_{''.join(sorted(odd))}]"
        after = {c for p in self.ids for c in re.findall(f"{letter}([.,;:!?])", p)}
        stops = "".join(re.escape(c) for c in ".,;:!?" if c not in after)
        marks = f"{MARK}+{word}*|" if split_marks else ""
        stopped = f"{MARK}*{letter}+(?=[{stops}])|" if stops and split_marks else ""
        self.parts = re.compile(f"{stopped}{marks}{word}+" + (f"|[{alone}]" if alone else ""))
        self.index()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.split: dict[int, tuple[int, ...]] = {}
        self.splits = {i for i, t in enumerate(self.types) if t == UNUSED} if self.kind == BPE else set()
        self.surface = [self._surface(i) for i in range(len(self.pieces))]

    def mapped(self, text: str) -> str:
        """The character map's image; user-defined pieces stay."""
        if self.map is None:
            return text
        if self.user is None:
            return self.map(text)
        return "".join(part if i % 2 else self.map(part) for i, part in enumerate(self.user.split(text)))

    def normalise(self, text: str) -> str:
        text = self.mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        text = text.replace(" ", MARK) if self.escape else text
        return text.rstrip(MARK) if self.squeeze and self.escape else text

    def plain(self, text: str) -> str:
        """What decoding an encoded text gives back, but for leading spaces in models that squeeze them."""
        if self.map is None and not self.squeeze:
            return text.replace(MARK, " ") if self.escape else text
        text = self.normalise(text)
        text = text.replace(MARK, " ") if self.escape else text
        return text[1:] if self.prefix and text.startswith(" ") else text

    def gives_back(self, ids: np.ndarray, text: str) -> bool:
        found, plain = self.decode(ids), self.plain(text)
        return found == plain or self.squeeze and found.lstrip(" ") == plain.lstrip(" ")

    def merged(self, symbols: list[str], least: int = 1) -> list[str]:
        """Merge neighbours, the best-ranked first, the leftmost on ties, down to ``least`` symbols."""
        while len(symbols) > least:
            best, at = -INFINITE, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def index(self) -> None:
        """Pieces as a trie: a text that begins a piece maps to the piece it is, or to -1,
        and whether a longer one begins with it."""
        begins = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.trie = {x: (self.ids.get(x, -1), x in begins) for x in begins | set(self.ids)}
        self.follows: dict[int, bool] = {}

    def symbol(self, code: int) -> str:
        """Text of an arc: a piece's, or a character that is none (below zero)."""
        return self.pieces[code] if code >= 0 else chr(-1 - code)

    def weight(self, before: int | None, code: int) -> float:
        """Of the arc ``code`` after the arc ``before`` (None at the start)."""
        if self.kind == UNIGRAM:
            return -self.scores[code] if code >= 0 else self.penalty
        key = (code << 32) + (-(1 << 24) if before is None else before)
        fits = self.follows.get(key)
        if fits is None:
            parts = [self.symbol(code)] if before is None else [self.symbol(before), self.symbol(code)]
            if len(self.follows) > REMEMBERED_PAIRS:
                self.follows.clear()
            fits = self.follows[key] = self.merged(list("".join(parts))) == parts
        return 0.0 if fits else INFINITE

    def arcs(self, text: str, start: int) -> list[tuple[int, int]]:
        """(code, end) of the arcs that begin at a position, the longest last."""
        trie, char = self.trie, text[start]
        piece, longer = trie.get(char, (-1, False))
        found = [(piece if piece >= 0 else -1 - ord(char), start + 1)]
        end, n = start + 2, len(text)
        while longer and end <= n:
            piece, longer = trie.get(text[start:end], (-1, False))
            if piece >= 0:
                found.append((piece, end))
            end += 1
        return found

    def shortest_path(self, text: str) -> list[int]:
        """Codes of the best path through the lattice of ``text``."""
        if not text:
            return []
        return self._only_path(text) if self.kind == BPE else self._least_path(text)

    def _least_path(self, text: str) -> list[int]:
        cost, came = [0.0] + [INFINITE] * len(text), [(0, 0)] * (len(text) + 1)
        for start in range(len(text)):
            for code, end in self.arcs(text, start):
                total = single(cost[start] + self.weight(None, code))
                if total < cost[end]:
                    cost[end], came[end] = total, (code, start)
        path, at = [], len(text)
        while at:
            code, at = came[at]
            path.append(code)
        return path[::-1]

    def _only_path(self, text: str) -> list[int]:
        """Where weights are zero or infinite, the first whole path that is found
        is a shortest. A prefix has one encoding, so a position left without
        success need not be entered again."""
        n, follows, arcs = len(text), self.follows, self.arcs
        path: list[int] = []
        places, waiting, dead = [0], [], set()
        before, options = -(1 << 24), arcs(text, 0)
        while True:
            if options:
                code, end = options.pop()
                fits = follows.get((code << 32) + before)
                if fits is None:
                    fits = self.weight(path[-1] if path else None, code) == 0.0
                if fits and end not in dead:
                    path.append(code)
                    if end == n:
                        return path
                    waiting.append(options)
                    places.append(end)
                    before, options = code, arcs(text, end)
            else:
                dead.add(places.pop())
                path.pop()
                options = waiting.pop()
                before = path[-1] if path else -(1 << 24)

    def emits(self, code: int) -> tuple[int, ...]:
        """Pieces that an arc puts out."""
        if code < 0:
            return tuple(self.bytes[b] for b in chr(-1 - code).encode("utf-8", "replace")) if self.bytes else (self.unknown,)
        if self.types[code] != UNUSED:
            return (code,)
        if code not in self.split:
            # the two that its last merge joined
            halves = self.merged(list(self.pieces[code]), least=2)
            whole = len(halves) == 2 and "".join(halves) in self.ids
            codes = [self.ids.get(x, -1 - ord(x[0])) for x in halves] if whole else []
            self.split[code] = tuple(i for c in codes for i in self.emits(c)) or (code,)
        return self.split[code]

    def _part(self, text: str) -> bytes:
        path = self.shortest_path(text)
        if min(path) < 0 or self.splits and not self.splits.isdisjoint(path):
            path = [i for code in path for i in self.emits(code)]
        return struct.pack(f"<{len(path)}I", *path)

    def encode(self, text: str) -> np.ndarray:
        text = self.normalise(text)
        if self.user is None:
            found = self._encoded(text)
        else:
            cut = self.user.split(text)
            found = b"".join(struct.pack("<I", self.user_ids[x]) if i % 2 else self._encoded(x) for i, x in enumerate(cut))
        ids = np.frombuffer(found, "<u4")
        if not self.bytes and len(ids):
            ids = ids[np.concatenate(([True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)))]
        return ids

    def _encoded(self, text: str) -> bytes:
        parts = self.parts.findall(text)
        if self.held > REMEMBERED_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, size = self.young, self.old, 0
        for part in set(parts).difference(young):
            young[part] = path = old.get(part) or self._part(part)
            size += 200 + 4 * len(part) + len(path)
        self.held += size
        return b"".join([young[p] for p in parts])

    def _surface(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        if self.types[i] == UNKNOWN:
            return " ⁇ ".encode()
        return self.pieces[i].replace(MARK, " ").encode() if self.escape else self.pieces[i].encode()

    def decode(self, ids: np.ndarray) -> str:
        parts = [self.surface[i] for i in ids.tolist()]
        if self.squeeze:
            # each piece before the first text loses a space
            for at, i in enumerate(ids.tolist()):
                if self.types[i] != BYTE:
                    parts[at] = parts[at].removeprefix(b" ") if self.types[i] != UNKNOWN else parts[at]
                if parts[at]:
                    break
            return b"".join(parts).decode("utf-8", "replace")
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


TOKENS = "spm__tokens"


def compiled(model: bytes) -> Transducer:
    """The model's transducer, kept for the later tasks of a worker process."""
    kept = sys.modules.setdefault("_factloom_transducers", types.ModuleType("_factloom_transducers")).__dict__
    name = hashlib.sha256(model).hexdigest()
    if name not in kept:
        kept[name] = Transducer(model)
    return kept[name]


def encoder(model: bytes, text_column: str, with_ids: bool):
    """For mapInArrow: adds TOKENS to every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in sliced(batches):
            rows = []
            for value in batch.column(text_column):
                text = value.as_py()
                if text is None:
                    rows.append(None)
                    continue
                ids = transducer.encode(text)
                rows.append(
                    {
                        "n_tokens": len(ids),
                        "ids": ids.tobytes() if with_ids else None,
                        "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(),
                        "decodes": transducer.gives_back(ids, text),
                    }
                )
            struct_type = pa.struct([("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decodes", pa.bool_())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, struct_type)], names=[*batch.schema.names, TOKENS])

    return encode


def with_tokens(docs: DataFrame, model: bytes, text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """All rows and columns, and TOKENS: n_tokens, ids (little-endian uint32), their
    SHA-256, and whether decoding them gives the normalised text."""
    docs = docs.drop(TOKENS)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    parts = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "ids_sha256": T.StringType(), "decodes": T.BooleanType()}
    schema.add(TOKENS, T.StructType([T.StructField(k, v) for k, v in parts.items()]))
    return docs.mapInArrow(encoder(model, text_column, with_ids), schema)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
