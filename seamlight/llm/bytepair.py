"""Byte-level BPE (operator 6): a sentencepiece model serialised from the vocabulary, and fast encoding of whole texts.

Ids travel as little-endian 32-bit bytes inside a worker; caches are bounded, and texts are taken in blocks of some MB.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import plain_strings, small_batches, tokenizer_path

#: The pre-tokeniser of the vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of one cache generation; a worker holds two at most (some 100 MB).
CACHE_ENTRIES = 250_000
#: Stretches of more characters are encoded anew each time: they hardly come twice and would fill the cache.
CACHE_CHARS = 64


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in same else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# --- a sentencepiece model, field by field -------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised BPE model: piece i is the byte-mapped token of rank i with score -i; unknown comes last; no normalisation.

    Ranks must be 0..n-1, each once.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1 without gaps")
    to_char = byte_alphabet()
    pieces = [""] * len(ranks)
    for token, rank in ranks.items():
        pieces[rank] = "".join(to_char[b] for b in token)
    body = b"".join(_field(1, _field(1, p) + _field(2, float(-i)) + _field(3, 1)) for i, p in enumerate(pieces))
    body += _field(1, _field(1, "<unk>") + _field(2, float(-len(pieces))) + _field(3, 2))
    off = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(n, off) for n in (41, 42, 43))
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normalizer)


def piece_coder(ranks: dict[bytes, int], model=None) -> Callable[[list[bytes]], list[bytes]]:
    """Ids of pre-tokens by the sentencepiece model; a whole pre-token in the vocabulary is one id."""
    import sentencepiece

    model = model or sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
    alphabet = dict(enumerate(byte_alphabet()))

    def encode(raws: list[bytes]) -> list[bytes]:
        out = [b""] * len(raws)
        rest = [i for i, raw in enumerate(raws) if raw not in ranks]
        for i, ids in zip(rest, model.encode([raws[i].decode("latin-1").translate(alphabet) for i in rest], num_threads=1)):
            out[i] = _pack(ids)
        for i, raw in enumerate(raws):
            out[i] = out[i] or _pack([ranks[raw]])
        return out

    return encode


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def spec_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(ranks, ids of added tokens) of a `tokenizers` file, where merging by rank provably gives what its library gives.

    That is so for plain byte-level BPE whose merges stand in the order of their tokens' ids; None for other files.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    pre = spec.get("pre_tokenizer") or {}
    plain = (
        model["type"] == "BPE" and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
        and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and merged == sorted(set(merged))
        and all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    )
    if not plain:
        return None
    to_byte = {c: b for b, c in enumerate(byte_alphabet())}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(to_byte[c] for c in token): rank for token, rank in vocab.items() if token not in added}, added


class Generations(dict):
    """A bounded cache: when full, what was not used since the last time is forgotten."""

    old: dict = {}

    def find(self, key):
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self[key] = value
        return value

    def keep(self, key, value) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value


#: A space between white space, or at the end after some: only then may a match run on over a space. For RE2 and for re.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)"
_EDGE = re.compile(r"(?<!\s) (?=\S)")
#: A word with some marks after it: two matches. Other stretches go through the pre-tokeniser's own pattern.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,!?;:]*)").fullmatch


class TextEncoder:
    """Encodes whole texts, many at a time.

    A match of the pre-tokeniser never runs on over a space that follows a non-blank, nor over one before a non-blank.
    So a text is cut before such spaces without changing any match; equal stretches of a block of texts are encoded once
    (Arrow dictionary), those met before come from a bounded cache, and numpy puts the ids of each text together.
    """

    def __init__(self, encode_pieces: Callable[[list[bytes]], list[bytes]]):
        import regex

        self.encode_pieces = encode_pieces
        self.matches = regex.compile(PATTERN).findall
        self.stretches, self.pretokens = Generations(), Generations()

    def _split(self, stretch: str) -> list[str]:
        if m := _WORD(stretch[1:] if stretch[:1] == " " else stretch):
            word = stretch[: len(stretch) - len(m[2])] if m[2] else stretch
            return [word, m[2]] if m[2] else [word]
        return self.matches(stretch)

    def many(self, stretches: list[str]) -> list[bytes]:
        """Id bytes of each stretch, which must begin and end where matches do."""
        out = list(map(self.stretches.find, stretches))
        missing = [i for i, value in enumerate(out) if value is None]
        split = [self._split(stretches[i]) for i in missing]
        need = {p for parts in split for p in parts}
        ids = {p: self.pretokens.find(p) for p in need}
        fresh = [p for p, value in ids.items() if value is None]
        for p, value in zip(fresh, self.encode_pieces([p.encode() for p in fresh])):
            ids[p] = value
            self.pretokens.keep(p, value)
        for i, parts in zip(missing, split):
            out[i] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts])
            self.stretches.keep(stretches[i], out[i])
        return out

    def one(self, text: str) -> bytes:
        """Id bytes of a text."""
        first, *rest = _EDGE.split(text)
        return b"".join(self.many([first, *(" " + x for x in rest)]))

    def batch(self, texts: pa.Array):
        """(all ids as uint32, where each text's begin and end); a null text is the empty one."""
        import numpy as np

        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        odd = np.asarray(odd.to_pylist(), bool) if len(odd) else np.zeros(0, bool)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, " ")
        begin = np.asarray(split.offsets)
        coded = split.values.dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)[begin[0] : begin[-1]]
        begin = begin - begin[0]
        known = coded.dictionary.to_pylist()
        heads = [known[c] for c in code[begin[:-1]].tolist()]
        whole = [self.one(texts[i].as_py()) if odd[i] else None for i in range(len(odd))] if odd.any() else None
        values = self.many([" " + x for x in known])
        values += self.many(heads) if whole is None else [h if w is None else w for h, w in zip(self.many(heads), whole)]
        code[begin[:-1]] = len(known) + np.arange(len(heads))
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")
        at = (np.cumsum(size) - size)[code]
        size = size[code]
        ends = np.cumsum(size)
        out = ids[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if ends.size else 0)]
        return out, np.concatenate([[0], ends])[begin]

    def batches(self, texts: pa.Array, most: int = 1 << 22):
        """(from row, to row, ids, bounds) of slices of at most so many bytes, or one text."""
        import gc

        import numpy as np

        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)) if len(texts) else np.zeros(0)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
            gc.disable()  # its passes over the caches' many small objects cost more than the encoding, and free nothing
            try:
                found = self.batch(texts.slice(start, stop - start))
            finally:
                gc.enable()
            yield start, stop, *found
            start = stop


def encode_decode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_column: str = "doc_id", text_column: str = "text", ids: bool = True) -> DataFrame:
    """Operator 6: encodes each whole text and decodes the ids again.

    Returns the id column, `n_tokens`, `ids_sha256`, `decoded_sha256`, and with ids=True `ids` (array<int>) and
    `decoded` (binary) themselves. A null text is the empty one. Rows stay as they come: repeated and null ids too;
    other columns are dropped, so none can clash. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    more = [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = codec(vocabulary)
        kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *more]
        for batch in batches:
            for start, stop, flat, bounds in encoder.batches(plain_strings(batch.column(1))):
                rows = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = flat[a:b]
                    back = b"".join(map(tokens.__getitem__, own.tolist()))
                    rows.append((b - a, hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), *((own.astype("i4"), back) if ids else ())))
                made = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *made], names=[id_column, *(k for k, _ in kinds)])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if ids else "")
    return docs.select(id_column, text_column).mapInArrow(run, schema)


_CODECS: dict[str, tuple[TextEncoder, list[bytes]]] = {}


def codec(vocabulary: str) -> tuple[TextEncoder, list[bytes]]:
    """(encoder by the sentencepiece model, bytes of each id), made once in a worker process.

    An id's bytes are its piece in the model, each character mapped back to the byte that it stands for.
    """
    if vocabulary not in _CODECS:
        import sentencepiece

        ranks = load_ranks(tokenizer_path(vocabulary))
        model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        back = {c: b for b, c in enumerate(byte_alphabet())}
        tokens = [bytes(map(back.__getitem__, model.id_to_piece(i))) for i in range(len(ranks))]
        _CODECS[vocabulary] = TextEncoder(piece_coder(ranks, model)), tokens
    return _CODECS[vocabulary]


#: A text in which so many bytes in a row may be one pre-token is encoded in stretches: the library's regular expression
#: stops on very long runs of blanks, and its merging takes time by the square of a pre-token.
LONG_RUN = 1 << 14


def has_long_run(raw: bytes) -> bool:
    """Whether a pre-token of LONG_RUN bytes can be in a text: blanks in a row, or others, bytes beyond ASCII being either."""
    import numpy as np

    if len(raw) < LONG_RUN:
        return False
    x = np.frombuffer(raw, np.uint8)
    blank, wide = (x <= 32) & ((x == 32) | ((x >= 9) & (x <= 13)) | (x >= 28)), x >= 128
    longest = lambda ends: int(np.diff(np.flatnonzero(np.concatenate([[True], ends, [True]]))).max())
    return max(longest(blank), longest(~(blank | wide))) > LONG_RUN


class RankEncoder(TextEncoder):
    """Merging by rank of whole texts, and added tokens wherever they stand in a text."""

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int] | None = None):
        import tiktoken

        self.coding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added or {})
        self.ranks, self.added, self.allowed = ranks, added or {}, {*(added or {})}
        self.slow: TextEncoder | None = None

    def _stretches(self, text: str) -> bytes:
        """Id bytes of a text with long runs, by the stretches of `TextEncoder`."""
        if self.slow is None:
            self.slow = TextEncoder(piece_coder(self.ranks))
        if not self.added:
            return self.slow.one(text)
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text)
        return b"".join(_pack([self.added[p]]) if i % 2 else self.slow.one(p) for i, p in enumerate(parts) if p)

    def batch(self, texts: pa.Array):
        import numpy as np

        encode, allowed = self.coding._core_bpe.encode_to_tiktoken_buffer, self.allowed
        found = []
        for x in texts.to_pylist():
            if not x:
                found.append(np.zeros(0, "<u4"))
            else:
                long = len(x) * 4 >= LONG_RUN and has_long_run(x.encode())
                found.append(np.frombuffer(self._stretches(x) if long else encode(x, allowed), "<u4"))
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([0, *map(len, found)])


class LibraryEncoder(TextEncoder):
    """For files of `tokenizers` that are not plain byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)

    def batch(self, texts: pa.Array):
        import numpy as np

        found = [np.asarray(e.ids, "<u4") for e in self.own.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([0, *map(len, found)])


_RANKED: dict[str, TextEncoder] = {}


def ranked(name: str) -> TextEncoder:
    """The encoder of a public vocabulary file (.json or .tiktoken), made once in a worker process."""
    if name not in _RANKED:
        path = tokenizer_path(name)
        if path.endswith(".tiktoken"):
            _RANKED[name] = RankEncoder(load_ranks(path))
        else:
            plain = spec_ranks(path)
            _RANKED[name] = RankEncoder(*plain) if plain else LibraryEncoder(path)
    return _RANKED[name]
