"""SentencePiece encoding and decoding with byte spans (operator 12).

A text is normalised first: at each place the longest key of the model's compiled character map (a double array
of the keys' bytes) is replaced, other characters stay; spaces become U+2581 and one is put before the text. For every
normalised byte the place in the source is kept, so each piece is projected to the bytes it stands for. A model whose
map is empty changes spaces only; then places follow from lengths and no array is needed.

The library merges the normalised text, with its own normalisation turned off; spans are computed for many texts at
once, as arrays.

encode: doc_id, ids, starts, ends (byte offsets in the source, as the library's offsets: of a character
written as single bytes the last one has the span, the others are empty at its start).
decode: the text of ids, as the library's decode(ids).

Bounds: a worker works on `BATCH` characters at a time (at least one text). No shuffle; nothing is collected or broadcast.

Defined cases: null and empty texts have no ids and decode to the empty text; U+2581 in a text counts as a
space; repeated rows and equal or null doc_ids give a row each; very long texts are one row; an empty table gives an empty result; other columns are not
carried, whatever their names. Models must have pieces for single bytes and no user-defined pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.common import table
from twinsift.llm.segments import gathered
from twinsift.llm.tokens import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
BATCH = 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a serialized message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        kind = tag & 7
        if kind == 0:
            value, i = number(i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = number(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def _message(field: int, body: bytes) -> bytes:
    size, n = bytearray(), len(body)
    while n > 127:
        size.append(n & 127 | 128)
        n >>= 7
    return bytes([field << 3 | 2, *size, n]) + body


class Normaliser:
    """The model's normalisation. Fields of its specification: 2 map, 3 space before, 4 spaces squeezed, 5 spaces escaped."""

    def __init__(self, spec: bytes) -> None:
        import numpy as np

        found = dict(_fields(spec))
        self.before, self.squeeze, self.escape = (bool(found.get(k, 1)) for k in (3, 4, 5))
        blob = found.get(2, b"")
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        self.plain = not self.units and self.before and not self.squeeze and self.escape

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the longest key that data holds from `at` on, and the key's length; else one character."""
        if self.units:
            offset = lambda u: (u >> 10) << ((u & 512) >> 6)
            units, best = self.units, None
            node = offset(units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                if node >= len(units):
                    break
                unit = units[node]
                if unit & (1 << 31 | 255) != data[i]:
                    break
                node ^= offset(unit)
                if unit >> 8 & 1:
                    best = units[node] & 0x7FFFFFFF, i + 1 - at
            if best:
                return self.strings[best[0] : self.strings.index(0, best[0])], best[1]
        lead = data[at]
        n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
        return data[at : at + n], n

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its bytes (and its end) the place in the bytes of the source."""
        data, out, places, at = text.encode(), bytearray(), [], 0
        mark = SPACE.encode() if self.escape else b" "
        if self.squeeze:
            while at < len(data):
                found, n = self.longest(data, at)
                if found != b" ":
                    break
                at += n
        if at == len(data):
            return "", [at]

        def put(part: bytes) -> None:
            out.extend(part)
            places.extend([at] * len(part))

        if self.before:
            put(mark)
        spaced = self.squeeze
        while at < len(data):
            found, n = self.longest(data, at)
            while spaced and found.startswith(b" "):
                found = found[1:]
            if found:
                put(found.replace(b" ", mark))
                spaced = found.endswith(b" ")
            at += n
            spaced = spaced and self.squeeze
        if self.squeeze:
            while out.endswith(mark):
                at = places[len(out) - len(mark)]
                del out[-len(mark) :], places[-len(mark) :]
        return out.decode(), [*places, at]


class Model:
    """A model's pieces, its normalisation, and the library without one."""

    def __init__(self, data: bytes) -> None:
        import numpy as np
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=data)
        own = [v for k, v in _fields(data) if k == 3]
        self.normalise = Normaliser(b"".join(own))
        # Later fields count: the same model, but for its normalisation, which is done here.
        none = _message(3, bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0]) + _message(2, b""))
        self.merging = SentencePieceProcessor(model_proto=data + none)
        size, lib = self.library.get_piece_size(), self.library
        self.names = [lib.id_to_piece(i) for i in range(size)]
        self.single = np.array([lib.is_byte(i) for i in range(size)])
        if self.single.sum() != 256:
            raise ValueError("the model has no pieces for single bytes")
        if any(dict(_fields(v)).get(3, 1) == 4 for k, v in _fields(data) if k == 1):
            raise ValueError("the model has pieces of its user's own")
        self.special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}
        #: What a piece stands for, U+2581 as a space.
        self.bytes = [bytes([int(p[3:5], 16)]) if b else p.replace(SPACE, " ").encode() for p, b in zip(self.names, self.single, strict=True)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        #: Single bytes that go on a character.
        self.inner = np.array([bool(s) and b[0] & 0xC0 == 0x80 for b, s in zip(self.bytes, self.single, strict=True)])
        #: Sizes with U+2581 as its three bytes.
        self.wide = np.array([1 if b else len(p.encode()) for p, b in zip(self.names, self.single, strict=True)], np.int64)
        self.unusual = np.array([i in self.special for i in range(size)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def spans(self, ids, sizes):
        """Starts and ends of pieces laid end to end; single bytes of one character end at its last."""
        import numpy as np

        n = sizes[ids]
        ends = np.cumsum(n)
        starts = ends - n
        single = self.single[ids]
        if single.any():
            lead = self.inner[ids]
            first = np.maximum.accumulate(np.where(lead, 0, np.arange(len(ids))))
            last = np.append(~lead[1:], True)
            starts = starts[first]
            ends = np.where(single & ~last, starts, ends)
        return starts, ends

    def plain(self, texts: list[str]):
        """ids, starts, ends and counts of texts that hold no U+2581, by a model whose map is empty: a space is one byte of the source."""
        import numpy as np

        found = self.merging.encode([SPACE + t.replace(" ", SPACE) if t else "" for t in texts], return_type="numpy", num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate([np.zeros(0, np.int32), *found])
        if not len(ids):
            return ids, ids, ids, counts
        starts, ends = self.spans(ids, self.sizes)
        # The space before the text is not there.
        first = np.minimum(np.cumsum(counts) - counts, len(ids) - 1)
        shift = np.repeat(starts[first] + 1, counts)
        return ids, np.maximum(starts - shift, 0).astype(np.int32), np.maximum(ends - shift, 0).astype(np.int32), counts

    def aligned(self, text: str):
        """ids, starts and ends of any text, through the places of its normalised bytes."""
        import numpy as np

        normal, places = self.normalise(text)
        ids = np.array(self.merging.encode(normal, num_threads=1), np.int32)
        starts, ends = self.spans(ids, self.wide)
        places = np.array(places, np.int64)
        first, last = places[starts], places[ends]
        return ids, first.astype(np.int32), np.where(ends > starts, last, first).astype(np.int32)

    def encode(self, texts: list[str]):
        """ids, starts and ends of all texts, and the number of ids of each."""
        import numpy as np

        if self.normalise.plain and not any(SPACE in t for t in texts):
            return self.plain(texts)
        parts = [self.plain([t])[:3] if self.normalise.plain and SPACE not in t else self.aligned(t) for t in texts]
        empty = [np.zeros(0, np.int32)]
        return (*(np.concatenate([*empty, *(p[k] for p in parts)]) for k in range(3)), np.array([len(p[0]) for p in parts], np.int64))

    def decode(self, ids, counts) -> list[str]:
        """Texts of ids laid end to end, as the library's decode: by bytes where they are ordinary pieces that make whole characters."""
        import numpy as np

        ends = np.append(0, np.cumsum(counts))
        upto = np.append(0, np.cumsum(self.sizes[ids]))[ends].tolist()
        data = self.flat[gathered(self.begins, self.sizes, ids)].tobytes()
        odd = np.append(0, np.cumsum(self.unusual[ids]))[ends]
        byte, out = np.append(self.single[ids], False)[ends].tolist(), []
        for k, a in enumerate(ends[:-1].tolist()):
            text = None
            if odd[k] == odd[k + 1] and self.normalise.plain:
                try:
                    text = data[upto[k] : upto[k + 1]].decode()
                except UnicodeDecodeError:
                    pass
            if text is None:
                text = self.library.decode(ids[a : int(ends[k + 1])].tolist())
            elif text.startswith(" ") and not byte[k]:
                text = text[1:]
            out.append(text)
        return out


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """One for each Python worker, kept between tasks."""
    if path not in _models:
        with open(path, "rb") as file:
            _models[path] = Model(file.read())
    return _models[path]


def parts(texts: list[str], size: int = BATCH) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about `size` characters."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, starts, ends) of every row of docs (doc_id, text)."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own, kind = model(path), pa.list_(pa.int32())
        schema = pa.schema([("doc_id", pa.int64()), ("ids", kind), ("starts", kind), ("ends", kind)])
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in parts(texts):
                *columns, counts = own.encode(texts[a:b])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c, pa.int32())) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), *lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded (doc_id, ids) with the text of the ids."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = model(path)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.append(0, np.cumsum(counts))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + BATCH, side="right")) - 1)
                ids = batch.column(1)[a:b]
                texts = own.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
                a = b

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(table(spark, sf_dir, "documents")))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
