"""WordPiece tokens and embeddings: deterministic hashes by default, ONNX models where a model and runtime are there."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import functions as F

PUNCTUATION = set(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_MARKS = re.escape("".join(sorted(PUNCTUATION)))
_WORDS, _BLANK = re.compile(f"[^ \\t\\n\\r{_MARKS}]+|[{_MARKS}]"), re.compile("[ \\t\\n\\r]")
#: Ids of [CLS], [SEP], [PAD], [UNK] where a vocabulary does not name them.
SPECIAL = {"[CLS]": 101, "[SEP]": 102, "[PAD]": 0, "[UNK]": 100}
#: Base letter and the Latin-1 code points (upper case, lower case 0x20 above) that fold to it.
_FOLDS = {"a": range(0xC0, 0xC6), "e": range(0xC8, 0xCC), "i": range(0xCC, 0xD0), "o": range(0xD2, 0xD7), "u": range(0xD9, 0xDD), "c": range(0xC7, 0xC8), "n": range(0xD1, 0xD2)}
FOLD = {cp + shift: base for base, cps in _FOLDS.items() for cp in cps for shift in (0, 0x20)} | {cp: chr(cp + 32) for cp in range(65, 91)}


# Fixed values of the hash embedding: factors of a token's id, of an axis, of a byte's place, and of the mixing step.
_STEP, _AXIS, _PLACE, _MIX = 2654435761, 40503, 1000003, 0x45D9F3B
#: Words whose pieces a worker remembers, and the characters of each, at most.
_CACHE_WORDS, _CACHE_CHARACTERS = 200_000, 64
#: Tokens or bytes that are hashed at once.
_BLOCK = 4096
#: Characters of a text whose words are held at once, about.
_BLOCK_CHARACTERS = 1 << 20
#: Ids that leave a worker at once, about: 8 MB a field; a longer text goes alone.
BLOCK_IDS = 1 << 20
_ENCODING = {"input_ids": "array<bigint>", "attention_mask": "array<bigint>", "token_type_ids": "array<bigint>", "actual_length": "int"}


def load_vocabulary(lines) -> dict[str, int]:
    """Token of each line by its number; blank lines keep their number, blanks at the end go, the last of equal tokens counts."""
    tokens = ((i, line.rstrip(" \t\r\n")) for i, line in enumerate(lines))
    return {t: i for i, t in tokens if t}


class _Pieces(dict):
    """The ids of a word's pieces, in the bytes of 64-bit numbers, by the word as it stands; short words are remembered."""

    def __init__(self, coder: WordPiece):
        self.coder = coder

    def __missing__(self, word: str) -> bytes:
        found = self.coder.pieces(self.coder.fold(word))
        ids = struct.pack(f"={len(found)}q", *found)
        if len(word) <= _CACHE_CHARACTERS:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordPiece:
    """Greedy longest-match sub-words of accent-folded lower-case words.

    An encoding has max_length ids; with None, as many as the whole text has, without padding.
    """

    def __init__(self, vocabulary: dict[str, int], max_length: int | None = 128):
        self.vocabulary, self.max_length = vocabulary, max_length
        # lengths that a piece may have, at a word's begin and after it, longest first
        self.heads = sorted({len(t) for t in vocabulary}, reverse=True)
        self.tails = sorted({len(t) - 2 for t in vocabulary if t.startswith("##") and len(t) > 2}, reverse=True)
        # where all pieces after a word's begin are single characters: their ids
        self.letters = {t[2:]: i for t, i in vocabulary.items() if t.startswith("##") and len(t) == 3} if self.tails == [1] else None
        self.cache = _Pieces(self)
        self.cls, self.sep, self.pad, self.unk = (vocabulary.get(k, v) for k, v in SPECIAL.items())

    def raw(self, text: str) -> Iterator[str]:
        """Words and single punctuation marks as they stand, one after the other, so that a reader may stop early."""
        return (m[0] for m in _WORDS.finditer(text))

    def blocks(self, text: str) -> Iterator[list[str]]:
        """What `raw` gives, in lists of the words of some _BLOCK_CHARACTERS."""
        start = 0
        while start < len(text):
            cut = _BLANK.search(text, start + _BLOCK_CHARACTERS)
            stop = cut.start() if cut else len(text)
            yield _WORDS.findall(text, start, stop)
            start = stop

    def fold(self, word: str) -> str:
        return word.translate(FOLD) if not word.islower() or not word.isascii() else word

    def basic(self, text: str) -> Iterator[str]:
        """Folded words and single punctuation marks."""
        return map(self.fold, self.raw(text))

    def pieces(self, word: str) -> list[int]:
        if word in self.vocabulary:
            return [self.vocabulary[word]]
        out, start = [], 0
        while start < len(word):
            if start and self.letters is not None:
                rest = list(map(self.letters.get, word[start:]))
                return [self.unk] if None in rest else out + rest
            for size in self.tails if start else self.heads:
                piece = "##" + word[start : start + size] if start else word[:size]
                if start + size <= len(word) and piece in self.vocabulary:
                    out.append(self.vocabulary[piece])
                    start += size
                    break
            else:
                return [self.unk]
        return out

    def ids(self, text: str | None):
        """The ids that count, as an array; each word has a piece at least, so a limit of ids is one of words too."""
        import numpy as np

        most = None if self.max_length is None else self.max_length - 2
        raw = self.raw(text or "") if most is not None else chain.from_iterable(self.blocks(text or ""))
        inner = np.frombuffer(b"".join(map(self.cache.__getitem__, islice(raw, most))), np.int64)[:most]
        return np.concatenate([[self.cls], inner, [self.sep]])

    def encode(self, text: str | None) -> tuple[list[int], int]:
        """(ids padded to max_length, how many of them count)."""
        real = self.ids(text).tolist()
        return real + [self.pad] * ((self.max_length or 0) - len(real)), len(real)

    def column(self, text, *fields: str):
        """struct(input_ids, attention_mask, token_type_ids, actual_length) of a text column, or of some of these fields.

        Encodings leave a worker in parts of some BLOCK_IDS ids, however many rows and letters a batch has.
        """
        import numpy as np

        fields = fields or tuple(_ENCODING)

        def part(real: list, sizes) -> pa.StructArray:
            most = np.maximum(sizes, self.max_length or 0)
            offsets = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
            lists = lambda flat: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            counts = np.arange(offsets[-1]) - np.repeat(offsets[:-1], most) < np.repeat(sizes, most) if self.max_length else np.ones(offsets[-1], bool)
            out = []
            for f in fields:
                if f == "actual_length":
                    out.append(pa.array(sizes, pa.int32()))
                    continue
                flat = np.full(offsets[-1], self.pad if f == "input_ids" else 0, np.int64)
                if f != "token_type_ids":
                    flat[counts] = np.concatenate(real) if f == "input_ids" else 1
                out.append(lists(flat))
            return pa.StructArray.from_arrays(out, list(fields))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                real, n = [], 0
                for t in texts:
                    real.append(self.ids(t.as_py()))
                    n += max(real[-1].size, self.max_length or 0)
                    if n >= BLOCK_IDS:
                        yield part(real, np.array([r.size for r in real]))
                        real, n = [], 0
                if real:
                    yield part(real, np.array([r.size for r in real]))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, ", ".join(f"{f} {_ENCODING[f]}" for f in fields))(text)


class UnicodeWordPiece(WordPiece):
    """The variant of one binding: Unicode lower case, no folding of accents, every mark a word, long words unknown."""

    #: Characters of a word, at most; a longer one is unknown as a whole.
    MOST_CHARACTERS = 100

    def __init__(self, vocabulary: dict[str, int], max_length: int | None = 512):
        super().__init__(vocabulary, max_length)

    def raw(self, text: str) -> Iterator[str]:
        return (m[0] for m in regex.finditer(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", text.lower()))

    def blocks(self, text: str) -> Iterator[list[str]]:
        return iter([self.raw(text)])

    def fold(self, word: str) -> str:
        return word

    def pieces(self, word: str) -> list[int]:
        return [self.unk] if len(word) > self.MOST_CHARACTERS else super().pieces(word)


class HashEmbedder:
    """Unit vectors from hashes of token ids, or of bytes where there is no vocabulary. An empty text is the first axis."""

    is_semantic = False

    def __init__(self, vocabulary: dict[str, int] | None = None, dim: int = 384, max_length: int | None = 128):
        self.tokenizer, self.dim = WordPiece(vocabulary, max_length) if vocabulary else None, dim

    def embed(self, text: str | None):
        import numpy as np

        out = np.zeros(self.dim, "f8")
        if not text:
            out[0] = 1
            return out
        if self.tokenizer:
            ids = self.tokenizer.ids(text)
            codes, often = np.unique(ids[ids != self.tokenizer.pad], return_counts=True)
            n, codes = ids.size, codes.astype(np.uint64) * np.uint64(_STEP)
        else:
            codes = np.frombuffer(text.encode(), np.int8).astype(np.int64).view(np.uint64)
            codes = codes * np.uint64(_STEP) + np.arange(codes.size, dtype=np.uint64) * np.uint64(_PLACE)
            n, often = codes.size, np.ones(codes.size)
        for start in range(0, codes.size, _BLOCK):
            out += often[start : start + _BLOCK] @ self._values(codes[start : start + _BLOCK])
        out /= n
        length = np.sqrt((out * out).sum())
        return out / length if length > 1e-8 else out

    def _values(self, codes):
        """A row of numbers in [-1, 1) for each code."""
        import numpy as np

        h = codes[:, None] + np.arange(self.dim, dtype=np.uint64) * np.uint64(_AXIS)
        h = (h ^ (h >> np.uint64(16))) * np.uint64(_MIX)
        if self.tokenizer:
            h ^= h >> np.uint64(16)
        return ((h & np.uint64(0xFFFF)).astype("f8") - 32768) / 32768

    def column(self, text):
        """array<float> of a text column."""

        import numpy as np

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                found = np.concatenate([np.zeros(0, "f4"), *(self.embed(t.as_py()).astype("f4") for t in texts)])
                yield pa.ListArray.from_arrays(pa.array(np.linspace(0, found.size, len(texts) + 1).astype(np.int32)), pa.array(found))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "array<float>")(text)


class SeededEmbedder(HashEmbedder):
    """The variant of one binding: a linear step on the text's 32-bit string hash gives all axes, so one letter changes all."""

    # Factor and addend of the step, factor of the string hash.
    FACTOR, ADDEND, STRING = 6364136223846793005, 1442695040888963407, 31

    def __init__(self, dim: int = 384):
        super().__init__(None, dim)

    def embed(self, text: str | None):
        import numpy as np

        units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
        powers = np.concatenate([np.ones(1, np.uint32), np.cumprod(np.full(max(0, units.size - 1), self.STRING, np.uint32), dtype=np.uint32)])[: units.size]
        seed = int((units * powers[::-1]).sum(dtype=np.uint32))
        seed -= (seed >> 31) << 32
        low = ((seed * self.FACTOR + self.ADDEND) & 0xFFFFF) ^ np.arange(self.dim)
        out = (low & 0xFFFFF) / 0xFFFFF * 2 - 1
        length = np.sqrt((out * out).sum())
        return out / length if length > 1e-9 else out


class WordHashEmbedder(HashEmbedder):
    """The variant of the demonstrations: each word's SHA-256, an axis and the word's place give a number; the mean counts.

    A text without words is the zero vector.
    """

    def __init__(self, dim: int = 384):
        super().__init__(None, dim)

    def embed(self, text: str | None):
        import hashlib

        import numpy as np

        words, out = (text or "").lower().split(), np.zeros(self.dim)
        ends = {w: int.from_bytes(hashlib.sha256(w.encode()).digest()[-2:], "big") for w in set(words)}
        axes = (np.arange(self.dim) * _STEP) & 0xFFFF
        for start in range(0, len(words), _BLOCK):
            block = words[start : start + _BLOCK]
            places = (np.arange(start, start + len(block)) * _AXIS) & 0xFFFF
            mixed = (np.array([ends[w] for w in block]) ^ places)[:, None] ^ axes
            out += ((mixed - 32768) / 32768).sum(0) / len(words)
        length = np.sqrt((out * out).sum())
        return out / length if length > 1e-8 else out


class OnnxEmbedder(HashEmbedder):
    """Masked mean of a model's token vectors; a text whose run fails takes the hash embedding. One session a worker."""

    is_semantic = True

    def __init__(self, model_path: str, vocabulary: dict[str, int], dim: int = 384, max_length: int = 128, threads: int = 2):
        super().__init__(vocabulary, dim, max_length)
        self.model_path, self.threads, self._session = model_path, threads, None

    def __getstate__(self):
        return self.__dict__ | {"_session": None}

    def session(self):
        if self._session is None:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            self._session = onnxruntime.InferenceSession(self.model_path, options)
        return self._session

    def embed(self, text: str | None):
        import numpy as np

        session = self.session()
        ids, n = self.tokenizer.encode(text)
        mask = np.array([[1] * n + [0] * (len(ids) - n)], np.int64)
        feeds = {"input_ids": np.array([ids], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        try:
            out = session.run(None, {i.name: feeds[i.name] for i in session.get_inputs()})[0]
        except Exception:  # the runtime's own errors share no base class
            return super().embed(text)
        v = (out[0] * mask[0][:, None]).sum(0) / mask.sum() if out.ndim == 3 else out[0]
        length = np.sqrt((v * v).sum())
        return v / length if length > 1e-8 else v
