"""SentencePiece BPE with offsets: texts to ids and the byte spans that each piece stands for, and ids back to texts."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
#: Kinds of pieces in a model file (fixed values of the format).
_UNKNOWN, _CONTROL, _USER_DEFINED, _BYTE = 2, 3, 4, 6
#: Bytes of remembered units and their ids in a worker, about; characters of the longest; what an entry takes besides.
MEMORY, LONGEST, _ENTRY = 64 << 20, 64, 200
#: Characters that are cut into units at a time, and bytes of texts that are encoded together.
_STRETCH, _BATCH_BYTES = 1 << 20, 1 << 20


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 bytes whose values are places in a pool of strings.

    The blob is the trie's size in bytes, the trie (32-bit units), and the pool; a string ends at a zero byte.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.pool = blob[4 + size :]
        ends = np.flatnonzero(np.frombuffer(self.pool, np.uint8) == 0)
        self.ends = np.append(ends, len(self.pool))

    @staticmethod
    def _child(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in `at`, the length of the longest key of the map that b has there (0: none), and its value.

        All places go down the trie together, a byte at a time.
        """
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, node = np.arange(len(at)), np.full(len(at), self._child(self.units[0]))
        for k in range(len(b)):
            inside = at[live] + k < len(b)
            live, node = live[inside], node[inside]
            if not len(live):
                break
            byte = b[at[live] + k].astype(np.int64)
            node = np.minimum(node ^ byte, len(self.units) - 1)
            unit = self.units[node]
            go = (unit & 0x800000FF) == byte
            live, node, unit = live[go], node[go] ^ self._child(unit[go]), unit[go]
            leaf = (unit >> 8) & 1 == 1
            length[live[leaf]] = k + 1
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def span(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings of these values start and end in the pool."""
        return value, self.ends[np.searchsorted(self.ends, value)]


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... (length[i] of them) of all i, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


class Normalizer:
    """Text to the form that pieces are looked for in, with the place in the source of every byte of it."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = _SPACE_BYTES if spec.escape_whitespaces else b" "

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normal form, and for each byte of it, and its end, the byte of text where its source begins.

        At each character not yet read, the longest key of the map that stands there is replaced by its string; a
        character that starts none stays. Then spaces: runs and ends go if the model says so, one is put in front,
        and each is written as the model's space sign.
        """
        if not text:
            return b"", np.zeros(1, np.int32)
        b = np.frombuffer(text, np.uint8)
        try:
            text.decode()
            starts = None
        except UnicodeDecodeError:  # every byte that is in no character counts as U+FFFD
            text.decode(errors="one_each")
            b, starts = self._mended(text)
        head = self.space if self.prefix else b""
        if self.map is None and not self.squeeze and starts is None:
            out = head + (text if self.space == b" " else text.replace(b" ", self.space))
            place = np.arange(len(b), dtype=np.int32)
            if self.space != b" ":
                place = np.repeat(place, np.where(b == 32, len(self.space), 1))
            return out, np.concatenate([np.zeros(len(head), np.int32), place, [np.int32(len(b))]])
        source, begin, length, place = self._chunks(b)
        if starts is not None:
            place = np.append(starts, len(text))[place]
        first = 0
        if self.squeeze:
            other = np.flatnonzero((length != 1) | (source[np.where(length == 1, begin, 0)] != 32))
            if not len(other):
                return b"", np.zeros(1, np.int32)
            first = int(place[other[0]])
            # a chunk loses the spaces it begins with if what was kept before it ends with one
            some = length > 0
            last = np.zeros(len(begin), bool)
            last[some] = source[begin[some] + length[some] - 1] == 32
            at = np.maximum.accumulate(np.where(some, np.arange(len(begin)), -1))
            before = np.concatenate([[-1], at[:-1]])
            after_space = np.where(before < 0, True, last[before])
            for i in np.flatnonzero(after_space & some & (source[np.where(some, begin, 0)] == 32)):
                while length[i] and source[begin[i]] == 32:
                    begin[i], length[i] = begin[i] + 1, length[i] - 1
        flat = source[_ragged(begin, length)]
        place_of = np.repeat(place, length)
        if self.space != b" ":
            wide = np.where(flat == 32, len(self.space), 1)
            out = flat.tobytes().replace(b" ", self.space)
            place_of = np.repeat(place_of, wide)
        else:
            out = flat.tobytes()
        out, place_of, end = head + out, np.concatenate([np.full(len(head), first, np.int64), place_of]), len(text)
        if self.squeeze:
            while out.endswith(self.space):
                out, end, place_of = out[: -len(self.space)], int(place_of[-len(self.space)]), place_of[: -len(self.space)]
        return out, np.append(place_of, end).astype(np.int32)

    @staticmethod
    def _mended(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """text with U+FFFD for each byte that is in no character, and the byte of text that each byte of it came from."""
        out, place, at = bytearray(), [], 0
        while at < len(text):
            size = next((n for n in (1, 2, 3, 4) if _is_character(text[at : at + n])), 0)
            new = text[at : at + size] if size else "�".encode()
            out += new
            place += [at] * len(new)
            at += size or 1
        return np.frombuffer(bytes(out), np.uint8), np.array(place)

    def _chunks(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """bytes; and for each stretch of b that is replaced or stays: where its new text begins in bytes, its length, where the stretch begins in b."""
        at = np.flatnonzero((b & 0xC0) != 0x80)
        own = np.diff(np.append(at, len(b)))
        if self.map is None:
            return b, at.copy(), own, at
        length, value = self.map.longest(b, at)
        reach, gone = 0, np.zeros(len(at), bool)
        for i in np.flatnonzero(length > own):  # keys of several characters hide those that begin inside them
            if at[i] >= reach:
                reach = int(at[i] + length[i])
                gone[i + 1 : np.searchsorted(at, reach)] = True
        at, own, length, value = (x[~gone] for x in (at, own, length, value))
        begin, end = self.map.span(value)
        source = np.concatenate([b, np.frombuffer(self.map.pool, np.uint8)])
        return source, np.where(length > 0, len(b) + begin, at), np.where(length > 0, end - begin, own), at


def _is_character(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


class Pieces:
    """A SentencePiece BPE model: normal form, merges, byte fallback and decoding, as the library has them."""

    _known: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trainer, kinds = model.trainer_spec, [p.type for p in model.pieces]
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix or _USER_DEFINED in kinds or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models without user-defined symbols, suffix spaces and denormalisation are read")
        self.normalizer = Normalizer(model.normalizer_spec)
        # texts come to the library in normal form, and in units
        bare = sentencepiece_model_pb2.ModelProto()
        bare.CopyFrom(model)
        bare.normalizer_spec.precompiled_charsmap = b""
        bare.normalizer_spec.add_dummy_prefix = bare.normalizer_spec.remove_extra_whitespaces = False
        self.library = SentencePieceProcessor(model_proto=bare.SerializeToString())
        names = [p.piece for p in model.pieces]
        self.ids = {n: i for i, n in enumerate(names) if kinds[i] not in (_UNKNOWN, _CONTROL, _BYTE)}
        self.scores = {n: model.pieces[i].score for n, i in self.ids.items()}
        self.unknown = kinds.index(_UNKNOWN)
        value = {i: int(names[i][3:-1], 16) for i, k in enumerate(kinds) if k == _BYTE}  # <0x41>
        self.bytes = {b: i for i, b in value.items()} if trainer.byte_fallback else {}
        self.byte_value = np.full(len(names), -1)
        self.byte_value[list(value)] = list(value.values())
        self.length = np.array([1 if k == _BYTE else len(n.encode()) for n, k in zip(names, kinds, strict=True)])
        surface = {_UNKNOWN: lambda n: trainer.unk_surface.encode(), _CONTROL: lambda n: b""}
        self.surfaces = [surface.get(k, lambda n: n.encode().replace(_SPACE_BYTES, b" "))(n) for n, k in zip(names, kinds, strict=True)]
        self.silent = {i for i, k in enumerate(kinds) if k == _CONTROL}
        #: Pieces whose first space sign is not shown at the beginning of a text.
        self.led = {i for n, i in self.ids.items() if n.startswith(SPACE)}
        self.strip = self.normalizer.prefix or self.normalizer.squeeze
        # no merge reaches over a space sign that follows something else, unless a piece does
        self.by_unit = not any(SPACE in n.lstrip(SPACE) for n in self.ids)
        self.memory: dict[str, bytes] = {}
        self.size = 0

    @classmethod
    def of(cls, path: str) -> "Pieces":
        """One for each worker process and file."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    _unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    _cut = re.compile(f"(?<=[^{SPACE}]){SPACE}")

    def merged(self, unit: str) -> list[str]:
        """The pieces of a unit: again and again the neighbours that make the piece of the best score are joined, the first such pair where several do."""
        parts: list[str | None] = list(unit)
        ids, scores, n = self.ids, self.scores, len(unit)
        heap = [(-scores[two], i, i + 1, two) for i in range(n - 1) if (two := unit[i : i + 2]) in ids]
        if not heap:
            return parts
        heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, i, j, both = heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or len(parts[i]) + len(parts[j]) != len(both):
                continue  # one of the two has changed since
            parts[i], parts[j] = both, None
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (both := parts[i] + parts[after]) in ids:
                    heappush(heap, (-scores[both], i, after, both))
            if (before := left[i]) >= 0 and (both := parts[before] + parts[i]) in ids:
                heappush(heap, (-scores[both], before, i, both))
        return [p for p in parts if p is not None]

    def new_ids(self, units: list[str]) -> dict[str, bytes]:
        """The ids of units, as little-endian bytes, from the library's merges; short units are remembered."""
        out = {u: array("i", ids).tobytes() for u, ids in zip(units, self.library.encode(units, num_threads=1), strict=True)}
        if self.size > MEMORY:
            self.memory.clear()
            self.size = 0
        short = {u: b for u, b in out.items() if len(u) <= LONGEST}
        self.memory.update(short)
        self.size += sum(map(len, short)) + sum(map(len, short.values())) + _ENTRY * len(short)
        return out

    def ids_of(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of units; the library is asked once for all that aren't remembered."""
        found = [list(map(self.memory.get, units)) for units in lists]
        missing = {u for units, ids in zip(lists, found, strict=True) if None in ids for u, b in zip(units, ids, strict=True) if b is None}
        if missing:
            new = self.new_ids(list(missing))
            found = [[new[u] if b is None else b for u, b in zip(units, ids, strict=True)] for units, ids in zip(lists, found, strict=True)]
        return [b"".join(ids) for ids in found]

    def units(self, form: str) -> Iterator[list[str]]:
        """The parts of a normal form that no piece reaches out of, a stretch of them at a time."""
        if not self.by_unit or not self.bytes:  # without byte fallback unknown neighbours are one piece
            yield [form] if form else []
            return
        at = 0
        while at < len(form):
            cut = self._cut.search(form, at + _STRETCH) if len(form) - at > _STRETCH else None
            end = cut.start() if cut else len(form)
            yield self._unit.findall(form, at, end)
            at = end

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of each text, and where in it the bytes that each of them stands for begin and end.

        Of the byte pieces of one character the last has its whole span, the others an empty one at its beginning.
        Texts of one stretch are looked up together; longer ones a stretch at a time.
        """
        normal = [(form, form.decode(), place) for form, place in map(self.normalizer.normalize, texts)]
        short = [form for _, form, _ in normal if len(form) <= _STRETCH]
        ids = iter(self.ids_of([units for form in short for units in (list(self.units(form)) or [[]])]))
        return [self._spans(raw, form, place, next(ids) if len(form) <= _STRETCH else b"".join(self.ids_of([u])[0] for u in self.units(form))) for raw, form, place in normal]

    def _spans(self, raw: bytes, form: str, place: np.ndarray, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.frombuffer(ids, "<i4")
        if self.bytes:
            end = np.cumsum(self.length[out])
            begin = end - self.length[out]
            small = self.byte_value[out] >= 0
            if small.any():
                inside = np.append((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80, False)
                begin[small] = np.maximum.accumulate(np.where(inside, 0, np.arange(len(inside))))[begin[small]]
                end = np.where(small & inside[end], begin, end)
        else:
            begin, end = self._without_bytes(form, out)
        return out, place[begin], place[end]

    def _without_bytes(self, form: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans in the normal form where the model has no byte pieces, so that an unknown piece is as long as its characters."""
        size, last = [], None
        for p in self.merged(form) if form else []:
            known = p in self.ids
            if known or last is not False:
                size.append(0)
            size[-1] += len(p.encode())
            last = known
        end = np.cumsum(np.array(size, np.int64))
        return end - np.array(size, np.int64), end

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces side by side, space signs as spaces, a leading one left out where the model puts one in front.

        Byte pieces in a row are read as UTF-8, and each byte that is in no character becomes U+FFFD. Ids that the
        model doesn't have count as unknown.
        """
        ids = np.where((ids < 0) | (ids >= len(self.length)), self.unknown, ids)
        listed = ids.tolist()
        out = list(map(self.surfaces.__getitem__, listed))
        if self.strip:
            for k, i in enumerate(listed):
                if i in self.led:
                    out[k] = out[k][1:]
                if i not in self.silent and (out[k] or not self.normalizer.squeeze or i not in self.led):
                    break
        if not (small := self.byte_value[ids] >= 0).any():
            return b"".join(out).decode()
        text = []
        for run in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(small)) + 1):
            if small[run[0]]:
                text.append(bytes(self.byte_value[ids[run]].tolist()).decode(errors="one_each"))
            else:
                text.append(b"".join(out[run[0] : run[-1] + 1]).decode())
        return "".join(text)


def _one_each(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


def _register() -> None:
    import codecs

    codecs.register_error("one_each", _one_each)


_register()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.array([0, *map(len, parts)], np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), kind))


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends: every text as ids of the model file, and the bytes of its UTF-8 that each id stands for.

    The ids are those of the sentencepiece library without begin and end signs. A null text is an empty one, which
    has no ids; null and repeated ids and repeated rows stay as they are; other columns are not read, whatever they
    are called. A text is encoded whole, cut into units (space signs and what follows) a stretch of a million
    characters at a time, so that a very long one needs memory for itself and its ids; units are remembered up to a
    bound of bytes. No shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            texts, at, held, size = batch["text"], 0, [], 0
            for i in range(batch.num_rows):
                held.append(texts[i].as_py())
                size += len(held[-1])
                if size >= _BATCH_BYTES or i + 1 == batch.num_rows:
                    lists = [_lists(list(x), pa.int32()) for x in zip(*pieces.encode(held), strict=True)]
                    yield pa.record_batch([batch["doc_id"].slice(at, len(held)), *lists], names=["doc_id", "ids", "begins", "ends"])
                    at, held, size = i + 1, [], 0

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """The columns of rows but `text`, and text: what the library's decode() gives for the column ids (array of int).

    Null ids are an empty list; nulls in a list, and ids that the model doesn't have, are unknown pieces.
    """
    rows = rows.drop("text")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            ids = batch["ids"]
            texts = [pieces.decode(np.array(x.values.fill_null(-1)) if (x := ids[i]).is_valid else np.zeros(0, int)) for i in range(batch.num_rows)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["text string"])
    return rows.mapInArrow(run, schema)
