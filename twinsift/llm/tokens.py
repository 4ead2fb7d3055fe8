"""Token ids of whole texts by a public tokenizer, inside Spark tasks.

Words repeat, so each worker keeps the ids of the pieces between spaces and newlines. That is exact for
vocabularies that drop white space: normalisation, word splitting and special strings never reach
across a space or newline. At most `KEPT` pieces that came again and `YOUNG` that came once are kept, of at
most `LONGEST` characters each: about 200 MB.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers

#: The vocabulary file; another one can be given by path if it drops white space, lower-cases and splits words from marks.
VOCABULARY = "word_bpe_49k.json"
KEPT, YOUNG, LONGEST = 700_000, 300_000, 48
ROWS = 2000  # texts of which each different piece is looked up once
MARKS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"

#: Byte-level vocabularies write a byte as a character: printable ones stand for themselves, the others follow from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


class Pieces(dict):
    """Little-endian 32-bit ids of a piece of text without space or newline."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        # What parts() takes for granted.
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.splits = ids("Ab, (cd)\nef") == [i for x in ("ab", ",", "(", "cd", ")", "ef") for i in ids(x)] and self.encoded("\u00e9t\u00e9") == np.array(ids("\u00e9t\u00e9"), "<u4").tobytes()
        if ids("a  b\n c") != [i for x in "abc" for i in ids(x)]:
            raise ValueError("the vocabulary keeps white space")

    def encoded(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or max(piece) < "\u0130") and piece == piece.lower() and getattr(self, "splits", True):
            # One word, which normalising and splitting leave as it is: only the merges are left to do.
            found = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES))]
        else:
            found = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, piece: str) -> bytes:
        ids = self.young.pop(piece, None)
        if ids is not None:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
            return ids
        ids = self.parts(piece)
        if len(piece) <= LONGEST:
            if len(self.young) >= YOUNG:
                self.young.clear()
            self.young[piece] = ids
        return ids

    def parts(self, piece: str) -> bytes:
        """Marks before and after letters are words of their own, and case does not count: pieces share their cores.

        Only where that is certain: Latin letters without combining marks, no special strings, no apostrophe before letters.
        """
        if self.splits and "<" not in piece and (piece.isascii() or max(piece) < "\u0130"):
            low = piece.lower()
            core = low.rstrip(MARKS)
            if core and core != low and core[-1].isalnum():
                return self[core] + self[low[len(core) :]]
            core = low.lstrip(MARKS)
            if core and core != low and core[0].isalnum() and "'" not in low[: len(low) - len(core)]:
                return self[low[: len(low) - len(core)]] + self[core]
            if low != piece:
                return self[low]
        return self.encoded(piece)

    def of(self, text: str | None) -> bytes:
        """The ids of a text, as bytes; null and empty texts have none."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


    def of_all(self, texts):
        """The ids of an Arrow array of texts, laid end to end. Each different piece is looked up once.

        Returns ids, ends (of each piece, in ids), codes (which of `pieces` each piece is), pieces, and where each text's pieces begin (and the last ones end).
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        first = cut.offsets.to_numpy()
        found = cut.flatten().dictionary_encode()
        codes, names = found.indices.to_numpy(), found.dictionary.to_pylist()
        held = list(map(self.__getitem__, names))
        laid = pa.array(held, pa.large_binary()).take(found.indices)
        bounds, bits = (np.frombuffer(x, kind) if x else np.zeros(0, kind) for x, kind in zip(laid.buffers()[1:], (np.int64, "<u4"), strict=True))
        ends = bounds[1 : len(laid) + 1] >> 2
        ids = bits[: ends[-1] if len(ends) else 0]
        return ids, ends, codes, names, first - first[0]


def parts(batch) -> Iterator:
    """A batch's rows, at most `ROWS` at a time."""
    return (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each Python worker, kept between tasks."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]
