"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A merge-type model joins the best-scored neighbours first. The result is the
only sequence of pieces in which every two neighbours would also come out when
just their two texts were merged. So the text need not be merged: pieces are
taken from left to right, the longest that fits its left neighbour first, and
taken back where the rest of the text cannot be reached.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the model format: field numbers and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, MERGE_TYPE = 3, 35, 2
CHARS_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
# Stands for a blank inside pieces.
BLANK = "▁"
# Rows whose results a worker holds at a time.
ROWS = 256
# Units and pairs of pieces in a generation of a worker's memory.
KNOWN_UNITS, KNOWN_PAIRS = 200_000, 500_000
# Longer units are not remembered.
UNIT_CHARS = 48


class UnsupportedModel(ValueError):
    """The model is no merge-type model that keeps texts as they are."""


def _number(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def message_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a serialised message, in order."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _number(data, at)
        elif kind == 2:
            size, at = _number(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield number, value


class Model:
    """Pieces of a model file and the few settings that matter here."""

    def __init__(self, data: bytes):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in message_fields(data):
            if number == PIECES:
                piece = dict(message_fields(value))
                self.texts.append(piece.get(PIECE_TEXT, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece.get(PIECE_SCORE, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(PIECE_KIND, NORMAL))
            elif number == TRAINER:
                trainer = dict(message_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(message_fields(value))
        if trainer.get(MODEL_TYPE, 1) != MERGE_TYPE or not trainer.get(BYTE_FALLBACK, 0):
            raise UnsupportedModel("only merge-type models with byte pieces")
        if normalizer.get(CHARS_MAP) or normalizer.get(REMOVE_EXTRA, 1) or not normalizer.get(ESCAPE, 1):
            raise UnsupportedModel("only models that keep characters and blanks")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise UnsupportedModel("only models without pieces of the user's")
        self.dummy_prefix = bool(normalizer.get(DUMMY_PREFIX, 1))


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Pieces by joining neighbours: the best score first, then the leftmost."""
    parts, none = list(text), float("-inf")
    score = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while score and (best := max(score)) > none:
        i = score.index(best)
        parts[i] += parts.pop(i + 1)
        del score[i]
        if i:
            score[i - 1] = scores.get(parts[i - 1] + parts[i], none)
        if i < len(score):
            score[i] = scores.get(parts[i] + parts[i + 1], none)
    return parts


def unit_pattern(pieces) -> re.Pattern:
    """Cuts a text where no piece, and so no merge, crosses the border.

    These are the borders between a character and a blank after it, and those
    between word characters and others; characters that some piece joins
    across the latter are never cut from their neighbours.
    """
    if any(BLANK in t.lstrip(BLANK) for t in pieces):
        return re.compile(r"(?s).+")
    joined = set()
    for text in pieces:
        for a, b in zip(text, text[1:]):
            if a != BLANK and is_word(a) != is_word(b):
                word, other = (a, b) if is_word(a) else (b, a)
                joined.add(other if word.isalpha() else word)
    some = "".join(map(re.escape, sorted(joined)))
    after = f"(?![{some}])" if some else ""
    word, other = f"[^\\W{some}]++{after}", f"[^\\w{BLANK}{some}]++{after}"
    return re.compile(f"{BLANK}*+(?:{word}|{other}|[^{BLANK}]+)|{BLANK}+")


def is_word(char: str) -> bool:
    return re.match(r"\w", char) is not None


class Remembered(dict):
    """Results by key in two generations: when the younger is full, the older goes."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.limit, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one model.

    Inside, a piece is its index in ``texts``: first the model's pieces, then
    characters that occur in pieces without being one. What the model has no
    piece for becomes the pieces of its UTF-8 bytes.
    """

    def __init__(self, data: bytes):
        model = Model(data)
        self.model = model
        self.scores = {t: s for t, s, k in zip(model.texts, model.scores, model.kinds) if k == NORMAL}
        self.byte_ids = [0] * 256
        for i, (text, kind) in enumerate(zip(model.texts, model.kinds)):
            if kind == BYTE:
                self.byte_ids[int(text[1:-1], 16)] = i
        self.byte_set = set(self.byte_ids)
        ids = {t: i for i, (t, k) in enumerate(zip(model.texts, model.kinds)) if k == NORMAL}
        self.known_chars = {c for t in ids for c in t}
        self.texts = [*model.texts, *sorted(self.known_chars - ids.keys())]
        index = {t: i for i, t in enumerate(self.texts) if i >= len(model.texts)} | ids
        # Pieces that merging their own text does not give never come out.
        reachable = {t: i for t, i in index.items() if len(t) == 1 or merged(t, self.scores) == [t]}
        self.sizes = [len(t) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for text, i in reachable.items():
            # Turned round, a search reports all pieces that begin at a place.
            self.automaton.add_word(text[::-1], i)
        self.automaton.make_automaton()
        # The next shorter piece that begins a piece.
        self.shorter: list[int | None] = [None] * len(self.texts)
        for text, i in reachable.items():
            prefixes = (reachable.get(text[:n]) for n in range(len(text) - 1, 0, -1))
            self.shorter[i] = next((p for p in prefixes if p is not None), None)
        self.reachable = reachable
        self.fit = Remembered(self._fits, KNOWN_PAIRS)
        self.unit = unit_pattern(ids)
        self.units = Remembered(self._made, KNOWN_UNITS)
        # What an id shows and decodes to.
        self.shown = list(map(str, range(len(model.texts))))
        self.plain = [t.replace(BLANK, " ").encode("utf-8") for t in model.texts]

    def _fits(self, pair: int) -> bool:
        """Whether two pieces come out as they are when their texts are merged."""
        a, b = map(self.texts.__getitem__, divmod(pair, len(self.texts)))
        return merged(a + b, self.scores) == [a, b]

    def _longest(self, text: str) -> dict[int, int]:
        """The longest piece for each place, counted from the end of the text.

        Of the pieces found at a place the automaton tells the longest first,
        so it has to be the last that is put into the table.
        """
        found = list(self.automaton.iter(text[::-1]))
        found.reverse()
        return dict(found)

    def _pieces(self, text: str) -> list[int]:
        """Pieces of a text of known characters, by backtracking."""
        whole = self.reachable.get(text)
        if whole is not None:
            return [whole]
        longest, sizes, shorter, size, fit = self._longest(text), self.sizes, self.shorter, len(text), self.fit
        failed = bytearray(size + 1)
        out: list[int] = []
        at, piece, row, pieces, last = 0, longest[size - 1], None, len(self.texts), size - 1
        while at < size:
            while piece is not None:
                end = at + sizes[piece]
                if not failed[end] and (row is None or fit[row + piece]):
                    break
                piece = shorter[piece]
            if piece is None:
                # Whatever comes before, nothing leads on from here.
                failed[at] = 1
                piece = out.pop()
                at -= sizes[piece]
                row = out[-1] * pieces if out else None
            else:
                out.append(piece)
                row, at = piece * pieces, end
                piece = longest[last - at] if at < size else None
        return out

    def _unit_ids(self, unit: str) -> list[int]:
        if self.known_chars.issuperset(unit):
            pieces = self._pieces(unit)
            if max(pieces) < len(self.model.texts):
                return pieces
            runs = [unit]
        else:
            runs = []
            for char in unit:
                if char in self.known_chars and runs and runs[-1][-1] in self.known_chars:
                    runs[-1] += char
                else:
                    runs.append(char)
        ids: list[int] = []
        for run in runs:
            if run[0] not in self.known_chars:
                ids += map(self.byte_ids.__getitem__, run.encode("utf-8"))
                continue
            pieces = self._pieces(run)
            if max(pieces) < len(self.model.texts):
                ids += pieces
                continue
            for piece in pieces:
                if piece < len(self.model.texts):
                    ids.append(piece)
                else:
                    ids += map(self.byte_ids.__getitem__, self.texts[piece].encode("utf-8"))
        return ids

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", BLANK)
        return self.unit.findall(BLANK + text if self.model.dummy_prefix else text)

    def encode(self, text: str | None) -> list[int]:
        return [i for unit in self._cut(text or "") for i in self._unit_ids(unit)]

    def decode(self, ids) -> str:
        """Text of ids; the blank of the first piece is the one put in front."""
        text, kinds = self._plain(ids).decode("utf-8"), self.model.kinds
        first = next((i for i in ids if kinds[i] != CONTROL), None)
        added = self.model.dummy_prefix and first is not None and kinds[first] == NORMAL
        return text[1:] if added and self.model.texts[first].startswith(BLANK) else text

    def _plain(self, ids) -> bytes:
        """Text of ids with its first blank; stray bytes become U+FFFD each."""
        out, raw = [], bytearray()
        for i in [*ids, None]:
            kind = None if i is None else self.model.kinds[i]
            if kind == BYTE:
                raw.append(int(self.model.texts[i][1:-1], 16))
                continue
            if raw:
                out.append(_whole_chars(bytes(raw)))
                raw.clear()
            if kind == NORMAL:
                out.append(self.model.texts[i].replace(BLANK, " ").encode("utf-8"))
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode("utf-8"))
        return b"".join(out)

    def _made(self, unit: str) -> tuple[int, str, bytes]:
        """Number of ids of a unit, the ids as text, and their decoded text."""
        ids = self._unit_ids(unit)
        if self.byte_set.isdisjoint(ids):
            plain = b"".join(map(self.plain.__getitem__, ids))
        else:
            plain = self._plain(ids)
        return len(ids), ",".join(map(self.shown.__getitem__, ids)), plain

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text.

        Units are decoded one by one: only whole characters become bytes, so
        no byte sequence goes on in the next unit.
        """
        units = self._cut(text or "")
        if max(map(len, units), default=0) <= UNIT_CHARS:
            told = list(map(self.units.__getitem__, units))
        else:
            told = [self.units[unit] if len(unit) <= UNIT_CHARS else self._made(unit) for unit in units]
        counts, ids, plain = zip(*told) if told else ((), (), ())
        whole = b"".join(plain)
        if self.model.dummy_prefix and whole.startswith(b" "):
            whole = whole[1:]
        return sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(whole).hexdigest()


def _whole_chars(raw: bytes) -> bytes:
    """UTF-8 with every byte that belongs to no character replaced."""
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError as stray:
        good, rest = raw[: stray.start], raw[stray.start + 1 :]
        return good + "�".encode("utf-8") + (_whole_chars(rest) if rest else b"")


def shared(spark: SparkSession, model: bytes) -> Broadcast:
    """The model file for all tasks; its size is that of the file."""
    return spark.sparkContext.broadcast({"model": model})


def codec_of(model: Broadcast) -> Codec:
    """A worker's codec, built once and kept with the broadcast value."""
    value = model.value
    if "codec" not in value:
        value["codec"] = Codec(value["model"])
    return value["codec"]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _with(batch: pa.RecordBatch, keep: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added.values()], [*keep, *added])


def _encode(model: Broadcast, keep: list[str], digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in _slices(batches):
            texts = (t.as_py() for t in batch.column("text"))
            if digests:
                rows = [codec.digests(t) for t in texts]
                names = ("n_tokens", "ids_sha256", "decoded_sha256")
                kinds = (pa.int64(), pa.string(), pa.string())
                columns = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))}
            else:
                columns = {"ids": pa.array([np.array(codec.encode(t), dtype="<u4").tobytes() for t in texts], pa.binary())}
            yield _with(batch, keep, columns)

    return run


def encode(docs: DataFrame, model: bytes, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Rows (``keep`` columns, ids) of all documents; ids are 32-bit integers.

    ``model`` is a model file's bytes. With ``digests`` the ids are decoded
    again in the same task, and instead of them come n_tokens, the digest of
    the ids and that of the decoded text.

    One pass without a shuffle. A null text has no ids, like an empty one;
    repeated rows stay, and other columns are not read. No begin and end ids
    are added. A kept column named like one of the results is not possible.
    """
    keep = ["doc_id"] if keep is None else keep
    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*keep).dtypes)
    told = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(_encode(shared(docs.sparkSession, model), keep, digests), f"{fields}{told}")


def _decode(model: Broadcast, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in _slices(batches):
            ids = (np.frombuffer(raw.as_py() or b"", dtype="<u4").tolist() for raw in batch.column("ids"))
            yield _with(batch, keep, {"decoded": pa.array(list(map(codec.decode, ids)), pa.string())})

    return run


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Replace ids by ``decoded``, their text; null ids give an empty one."""
    keep = [c for c in encoded.columns if c != "ids"]
    fields = "".join(f"`{c}` {t}, " for c, t in encoded.select(*keep).dtypes)
    return encoded.select(*keep, F.col("ids")).mapInArrow(
        _decode(shared(encoded.sparkSession, model), keep), f"{fields}decoded string"
    )
