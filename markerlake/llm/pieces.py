"""Exact byte-pair encoding of whole texts, by tree concatenation.

A byte-level text longer than TEXT_LEAF characters is cut wherever that falls. The pieces of text are encoded apart and
joined in pairs: around each join a growing window of the text is encoded again, until it begins with a part that the
left side has there and ends with one that the right side has. Parts begin where the tokenizer's pattern always splits,
so that what lies beyond the window stays as it is. A part is encoded once and kept in a bounded dictionary.

Text without such places is one part. Its pieces (by the file's own pattern) of more than LEAF bytes are trees of their
own: leaves are encoded side by side, and around each join a window of tokens grows until its first token is one that
the left side has there and its last token is one that the right side has. Short parts of other than plain Latin
characters, and strings of special tokens, go through the tokenizers library.

By a word file, the words of many texts are encoded together (Words): each different one once, all in one call.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

#: Longest piece, in bytes, that is encoded in one call.
LEAF = 2048
#: Characters of text that are encoded in one call.
TEXT_LEAF = 2048
#: Parts that the dictionary of one Python worker may hold before it is emptied.
KEPT_PARTS = 250_000
#: Different words of a word file that are encoded in one call.
KEPT_WORDS = 600_000

assert sys.byteorder == "little" and array("I").itemsize == 4

LATIN = "À-ÖØ-öø-ſ"
#: The split patterns of the two files, over the characters that the fast way takes. Fixed values.
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^\sA-Za-z{LATIN}0-9]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z{LATIN}]+|[0-9]|[^\sA-Za-z{LATIN}0-9]+")
BYTE_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LATIN}]*")
WORD_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ſ]*")
#: Letters only: one piece. The word file drops the space.
BYTE_LETTERS = re.compile(rf" ?[A-Za-z{LATIN}]+")
WORD_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ]+")
#: Nothing, or any of the characters that the fast way takes but letters.
NO_LETTER = r"^$|[\x21-\x40\x5b-\x60\x7b-\x7e]"
#: The byte-level file's pattern over all characters, and white space on which libraries differ. Fixed values.
ANY_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNSURE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: A single space between two visible characters always begins a piece.
BYTE_CUT = re.compile(r" (?=\S)(?<=\S )")

END = b" "  # never a byte of a word: marks its end


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Parts(dict):
    """Parts and their ids; what is missing is made."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        self[part] = found = self.make(part)
        return found


class Codec:
    """encode() and decode() for one tokenizer file of the tokenizers library, equal to the library's results."""

    def __init__(self, path: str, special: bool = True) -> None:
        """special: whether the strings of special tokens in a text become those tokens, as the library's default is."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.library.no_truncation()
        self.library.no_padding()
        self.special = special
        suffix = model.get("end_of_word_suffix") or ""
        self.word = bool(suffix)
        letters, vocab = byte_letters(), model["vocab"]

        def as_bytes(token: str) -> bytes:
            ended = self.word and token.endswith(suffix)
            return bytes(letters[c] for c in (token[: -len(suffix)] if ended else token)) + END * ended

        named = {b: c for c, b in letters.items()}
        order = [(bytes([b]), named[b]) for b in range(256)]
        if self.word:
            order += [(bytes([b]) + END, named[b] + suffix) for b in range(256) if b != END[0]]
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            order.append((as_bytes(a + b), a + b))
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        for key, token in order:
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab.get(token, -1))
        self.id_of_rank = ids
        self.rank_bytes = list(ranks)
        self.ranks = tiktoken.Encoding("parts", pat_str=r"[^ ]+ " if self.word else r"\S+|\s+", mergeable_ranks=ranks, special_tokens={"<|none|>": len(ids)})
        self.merge = self.ranks._core_bpe.encode_single_piece
        self.bytes_of: list[bytes] = []
        top = self.library.get_vocab_size(with_added_tokens=True)
        for i in range(top):
            token = self.library.id_to_token(i)
            self.bytes_of.append(b"" if token is None else self._shown(token, letters, suffix))
        added = [x.content for x in self.library.get_added_tokens_decoder().values() if x.content]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if special and added else None
        self.joins = 0  # of texts, since the codec was made
        self.parts = Parts(self.part)
        self.pieces: dict[str, bytes] = {}
        self.pool: ThreadPoolExecutor | None = None
        self.words = Words(self) if self.word else None

    def _shown(self, token: str, letters: dict[str, int], suffix: str) -> bytes:
        body, end = (token[: -len(suffix)], b" ") if self.word and token.endswith(suffix) else (token, b"")
        return (bytes(letters[c] for c in body) if all(c in letters for c in body) else body.encode()) + end

    # -- trees ------------------------------------------------------------------------------------------------------
    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two texts' concatenation from the tokens of both."""
        width = 4
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(b"".join(self.rank_bytes[x] for x in left[i:] + right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            width *= 2

    def tree(self, piece: bytes, leaf: int = LEAF) -> list[int]:
        """Ranks of one piece that no pattern splits."""
        if len(piece) <= leaf:
            return self.merge(piece)
        if self.pool is None:
            self.pool = ThreadPoolExecutor(2)
        level = list(self.pool.map(self.merge, (piece[i : i + leaf] for i in range(0, len(piece), leaf))))
        while len(level) > 1:
            paired = list(self.pool.map(self.join, level[:-1:2], level[1::2]))
            level = paired + level[len(paired) * 2 :]
        return level[0]

    # -- parts ------------------------------------------------------------------------------------------------------
    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.merged(piece)
            if len(piece) <= 64:
                self.pieces[piece] = found
        return found

    def merged(self, piece: str) -> bytes:
        raw = piece.encode() + END if self.word else piece.encode()
        ranks = self.merge(raw) if len(raw) <= LEAF else self.tree(raw)
        of = self.id_of_rank
        return array("I", [of[x] for x in ranks]).tobytes()

    def part(self, part: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a part between two cuts."""
        plain, pieces = (WORD_PLAIN, WORD_PIECES) if self.word else (BYTE_PLAIN, BYTE_PIECES)
        if self.word and WORD_LETTERS.fullmatch(part):
            return self.merged(part.lower())
        if not self.word and BYTE_LETTERS.fullmatch(part):
            return self.merged(part)
        if not plain.fullmatch(part) or (self.special and "<|" in part):
            if not self.word and len(part) > LEAF and not UNSURE.search(part):
                return self.unsplit(part)
            return np.array(self.library.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join([self.piece(x) for x in pieces.findall(part.lower() if self.word else part)])

    def unsplit(self, part: str) -> bytes:
        """A long part of any characters: special tokens by the library, the rest by its pieces."""
        out = []
        for i, x in enumerate(self.specials.split(part) if self.specials else [part]):
            if i % 2:
                out.append(np.array(self.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out += [self.piece(y) for y in ANY_PIECES.findall(x)]
        return b"".join(out)

    def joined(self, left: list[str], right: list[str]) -> list[str]:
        """The parts of two texts' concatenation from the parts of both."""
        self.joins += 1
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.encoded("".join(left[i:] + right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            width *= 2

    def encoded(self, text: str) -> list[str]:
        """The parts of a text, encoded; those that are so long that they may be cut short here are left for later."""
        parts = self.split(text)
        for x in parts:
            if len(x) <= LEAF:
                self.parts[x]
        return parts

    def halves(self, text: str) -> list[str]:
        """Parts of a long text, as a tree over pieces of the text that are cut wherever it falls."""
        level = [self.encoded(text[i : i + TEXT_LEAF]) for i in range(0, len(text), TEXT_LEAF)]
        while len(level) > 1:
            paired = list(map(self.joined, level[:-1:2], level[1::2]))
            level = paired + level[len(paired) * 2 :]
        return level[0]

    def split(self, text: str) -> list[str]:
        if self.word:
            return re.split(r"[\x20\x09-\x0D]+", text) if "\x0b" in text or "\x0c" in text else text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = BYTE_CUT.split(text)
        return [found[0], *[" " + x for x in found[1:]]]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers."""
        known = self.parts
        whole = self.word or len(text) <= TEXT_LEAF
        out = b"".join(map(known.__getitem__, self.split(text) if whole else self.halves(text)))
        if len(known) > KEPT_PARTS or len(self.pieces) > KEPT_PARTS:
            known.clear()
            self.pieces.clear()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False) of a byte-level file."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


class Words:
    """Texts by a word file, many at once: each different word is encoded once, and all plain ones in one call."""

    def __init__(self, own: Codec) -> None:
        self.own = own
        self.ids = np.array(own.id_of_rank, np.int64).astype("<u4")  # of ranks
        self.last = np.array([x.endswith(END) for x in own.rank_bytes])  # whether a rank ends a piece

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one after the other, and how many each has."""
        plain = pc.and_(pc.match_substring_regex(words, f"^(?:{WORD_PLAIN.pattern})$"), pc.less_equal(pc.binary_length(words), LEAF // 2))
        if self.own.special:
            plain = pc.and_not(plain, pc.match_substring(words, "<|"))
        some = pc.utf8_lower(words.filter(plain))
        mixed = pc.match_substring_regex(some, NO_LETTER)
        cut = pc.replace_substring_regex(some.filter(mixed), f"({WORD_PIECES.pattern})", r"\1 ")
        pieces = np.ones(len(some), np.int64)
        pieces[flags(mixed)] = pc.count_substring(cut, " ").to_numpy()
        ended = pc.replace_with_mask(pc.binary_join_element_wise(some, "", " "), mixed, cut)
        ranks = self.own.ranks.encode_to_numpy(pc.binary_join(pa.ListArray.from_arrays([0, len(ended)], ended), "")[0].as_py(), disallowed_special=()) if len(some) else np.empty(0, np.int64)
        ends = np.append(0, np.flatnonzero(self.last[ranks]) + 1)[np.cumsum(pieces)]
        sizes = np.zeros(len(words), np.int64)
        sizes[flags(plain)] = np.diff(ends, prepend=0)
        ids, begins, parts = self.ids[ranks], np.cumsum(sizes), []
        others, done = np.flatnonzero(~flags(plain)), 0
        for i, word in zip(others.tolist(), words.take(pa.array(others)).to_pylist(), strict=True):
            parts += [ids[done : begins[i]], np.frombuffer(self.own.parts[word] if len(word) <= LEAF else self.own.part(word), "<u4")]
            sizes[i], done = len(parts[-1]), begins[i]
        if len(self.own.parts) > KEPT_PARTS:
            self.own.parts.clear()
        return np.concatenate([*parts, ids[done:]]), sizes

    def encode(self, some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. Null texts have none."""
        split = pc.ascii_split_whitespace(pc.fill_null(some, ""))
        found = split.flatten().dictionary_encode()
        different, word = found.dictionary, found.indices.to_numpy()
        known = [self.encoded(different[i : i + KEPT_WORDS]) for i in range(0, max(1, len(different)), KEPT_WORDS)]
        flat, lengths = (np.concatenate(x) for x in zip(*known, strict=True))
        sizes = lengths[word]
        ends = np.append(0, np.cumsum(sizes))
        ids = flat[np.repeat((np.cumsum(lengths) - lengths)[word] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[split.offsets.to_numpy() - split.offsets[0].as_py()])


def flags(some: pa.Array) -> np.ndarray:
    return some.to_numpy(zero_copy_only=False)


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, special: bool = True) -> Codec:
    """One codec for each file and worker process."""
    if (path, special) not in _codecs:
        _codecs[path, special] = Codec(path, special)
    return _codecs[path, special]
