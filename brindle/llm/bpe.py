"""Exact BPE front ends for the two `tokenizers` files, built around distinct text chunks.

Texts repeat words, so both front ends cut a text at places that are always token boundaries and
keep the encoding of each distinct chunk in a bounded per-worker cache.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

import regex

#: Distinct chunks that a Python worker remembers, and how long they may be; beyond CACHE_CHUNKS the cache starts anew, and
#: longer chunks (text without spaces) are forgotten with their text, so that a cache has a bound in bytes too.
CACHE_CHUNKS, CACHE_LENGTH = 700_000, 64

#: The byte-level alphabet (bytes that stand for themselves; the rest follow from U+0100 on).
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Pre-token patterns of the two files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character, usable with str.translate on latin-1 text."""
    table, spare = {b: chr(b) for b in PRINTABLE}, 0x100
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return table


def forget_long(known: dict, chunks: set) -> None:
    """Drops those of the new chunks that are too long to be kept."""
    for c in chunks:
        if len(c) > CACHE_LENGTH:
            known.pop(c, None)


ALPHABET = byte_alphabet()
#: Marks that are a pre-token of their own right after a word.
MARKS = frozenset(".,;:!?")


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian uint32."""
    return struct.pack(f"<{len(ids)}I", *ids)


def as_alphabet(piece: str) -> str:
    return piece.encode("utf-8").decode("latin-1").translate(ALPHABET)


class Front:
    """What both files share: the library's tokenizer, its vocabulary and its special strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None


class ByteFront(Front):
    """Byte-level BPE with the leading-space pre-tokenizer."""

    _between = re.compile(r"(?<=\S) (?=\S)")
    _beside = re.compile(r" \s|\s ")
    _pieces = regex.compile(BYTE_PATTERN)

    def segments(self, text: str) -> list[str]:
        """The text cut around special strings (odd places hold those strings)."""
        return self.special_cut.split(text) if self.special_cut and any(s in text for s in self.special) else [text]

    _mixed = re.compile(r"[ \n]\s|\s[ \n]")
    #: White space but for the space and the line end, and how these two may stand together.
    _others = tuple(chr(k) for k in range(0x3001) if chr(k).isspace() and k not in (0x20, 0x0A))
    _pairs = ("  ", " \n", "\n ", "\n\n")

    def lines(self, segment: str) -> list[tuple[str, list[str]]]:
        """Chunks of each line, or of the whole segment where white space stands together.

        A lone line end is a pre-token of its own, so lines encode apart; where no white space is beside another, spaces cut plainly.
        """
        if any(x in segment for x in self._pairs) or (any(x in segment for x in self._others) and self._mixed.search(segment)):
            return [self.chunks(segment)]
        cut = [line.split(" ") for line in segment.split("\n")]
        return [(parts[0], parts[1:]) for parts in cut]

    def chunks(self, segment: str) -> tuple[str, list[str]]:
        """First chunk, and the others without the single space before each.

        A lone space between two non-space characters always begins a pre-token, so chunks encode apart.
        """
        parts = self._between.split(segment) if self._beside.search(segment) else segment.split(" ")
        return parts[0], parts[1:]

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk in the byte alphabet."""
        if not chunk:
            return []
        if max(chunk) < "ɐ":
            return [as_alphabet(p) for p in self._pieces.findall(chunk)]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]


class WordFront(Front):
    """BPE with word ends: NFC, lower case, white space dropped."""

    #: str.split() also cuts at these, which the file's \s does not.
    _odd = re.compile("[\x1c-\x1f]")
    _spaces = regex.compile(r"[^\S\x1c-\x1f]+")
    _pieces = regex.compile(WORD_PATTERN)

    def chunks(self, text: str) -> list[str]:
        """White space parts pre-tokens and neither NFC nor lower case reach across it."""
        if self._odd.search(text):
            return [c for c in self._spaces.split(text) if c]
        return text.split()

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk (without special strings) in the byte alphabet; plain words, and words with one mark behind, need no pattern."""
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if low[-1] in MARKS and (word := low[:-1]).isalpha():
                return [word, low[-1]]
        elif max(chunk) < "ɐ" and "İ" not in chunk:
            low = unicodedata.normalize("NFC", chunk).lower()
            if low.isalpha():
                return [as_alphabet(low)]
            if low[-1] in MARKS and (word := low[:-1]).isalpha():
                return [as_alphabet(word), low[-1]]
        else:
            low = self.library.normalizer.normalize_str(chunk)
            return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]
        return [p if p.isascii() and p.isprintable() else as_alphabet(p) for p in self._pieces.findall(low)]


def fast_ids(front: ByteFront):
    """Byte string of a pre-token -> ids, by merge ranks (a Rust core; same merges as the file's)."""
    import tiktoken

    back = {c: b for b, c in ALPHABET.items()}
    ranks = {bytes(back[c] for c in t): i for t, i in front.vocab.items()}
    core = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece


class ByteEncoder:
    """ids of whole texts for the byte-level file, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        self.front = ByteFront(path)
        self.whole, _ = whole_tokens(self.front)
        self.merge = fast_ids(self.front)
        self.back = {ord(c): b for b, c in ALPHABET.items()}
        self.newline = as_bytes(self.piece_ids("\n"))
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def piece_ids(self, piece: str) -> list[int]:
        """ids of one pre-token (real characters)."""
        if (one := self.whole.get(as_alphabet(piece))) is not None:
            return [one]
        return self.merge(piece.encode("utf-8"))

    def ids_of(self, chunk: str, space: str = "") -> bytes:
        """ids of a chunk that follows `space`; plain words, and words with one mark behind, need no pattern."""
        if chunk and max(chunk) < "\u0250":
            if chunk.isalpha():
                return as_bytes(self.merge((space + chunk).encode("utf-8")))
            if chunk[-1] in MARKS and (word := chunk[:-1]).isalpha():
                return as_bytes(self.merge((space + word).encode("utf-8")) + self.piece_ids(chunk[-1]))
        out: list[int] = []
        for p in self.front.pieces(space + chunk):
            out += [self.whole[p]] if p in self.whole else self.merge(p.translate(self.back).encode("latin-1"))
        return as_bytes(out)

    def encode(self, text: str) -> bytes:
        got: list[bytes] = []
        first, later, newline = self.first, self.later, self.newline
        for k, segment in enumerate(self.front.segments(text)):
            if k % 2:
                got.append(as_bytes([self.front.special[segment]]))
            elif segment:
                lines = self.front.lines(segment)
                new = set().union(*[rest for _, rest in lines]).difference(later)
                for c in new:
                    later[c] = self.ids_of(c, " ")
                for head, rest in lines:
                    if (x := first.get(head)) is None:
                        x = self.ids_of(head)
                        if len(head) <= CACHE_LENGTH:
                            first[head] = x
                    got.append(x)
                    got += map(later.__getitem__, rest)
                    got.append(newline)
                got.pop()  # line ends stand between lines
                forget_long(later, new)
        if len(self.later) > CACHE_CHUNKS:
            self.later.clear()
        if len(self.first) > CACHE_CHUNKS // 4:
            self.first.clear()
        return b"".join(got)


def whole_tokens(front: Front) -> tuple[dict[str, int], set[str]]:
    """Vocabulary strings proved to encode alone as one token (run before any text is seen), and the others."""
    model, whole, rest = front.library.model, {}, set()
    for token, number in front.vocab.items():
        try:
            got = model.tokenize(token)
        except Exception:
            got = []
        if len(got) == 1 and got[0].id == number:
            whole[token] = number
        else:
            rest.add(token)
    return whole, rest


class WordEncoder:
    """ids of whole texts for the word-end file, as little-endian uint32 bytes; merges by the library's model."""

    def __init__(self, path: str):
        self.front = WordFront(path)
        self.front.vocab, self.front.merges = {}, []  # the library's model has its own
        self.tokenize = self.front.library.model.tokenize
        self.known: dict[str, bytes] = {}

    def ids_of(self, chunk: str) -> bytes:
        if "<|" in chunk and any(s in chunk for s in self.front.special):
            ids = self.front.library.encode(chunk, add_special_tokens=False).ids
        else:
            tokenize = self.tokenize
            ids = [t.id for p in self.front.pieces(chunk) for t in tokenize(p)]
        return as_bytes(ids)

    def encode(self, text: str) -> bytes:
        chunks, known = self.front.chunks(text), self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        new = {*chunks}.difference(known)
        for c in new:
            known[c] = self.ids_of(c)
        out = b"".join(map(known.__getitem__, chunks))
        forget_long(known, new)
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
