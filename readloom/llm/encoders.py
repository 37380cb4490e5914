"""Token encoders for executors: one library encoder for each worker, with a bounded piece cache.

``Encoder.encode`` gives, for every whole text, what the library's own call gives: without begin,
end or added special tokens, special strings inside texts as the library handles them by default,
no truncation, no padding. Where the tokenizer's definition proves that white space separates the
text into pieces that are encoded independently, distinct pieces are encoded once by the library
and their ids are joined; all other texts are encoded whole.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by a worker, about 150 MB, in two halves: when one is full, the one before it is forgotten.
CACHE_PIECES = 600_000
#: Characters of texts that are cut and joined at once; a larger text is a group of its own.
GROUP_CHARS = 1 << 20

#: Fixed value: a split pattern that never matches white space.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# For the space-prefixing kind: anything but single spaces and line feeds between other characters.
_ODD = re.compile("\\s\\s|[^\\S \\n]|[\u180e\u200b\ufeff]|\\A\\s|\\s\\Z")

#: UTF-8 of letters that are one pre-token of their own, in any normalisation: a model's own call gives their ids.
_LETTERS = re.compile(b" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

# What a byte of UTF-8 is, as bits: a space or line feed, a line feed, punctuation, a letter or digit, the lead of a
# Latin letter, the end of one after such a lead, and the lead of what may be other white space.
_BLANK, _FEED, _MARK, _WORD, _LEAD, _TAIL, _RARE = (1 << i for i in range(7))


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = _BLANK * (c in " \n") | _FEED * (c == "\n") | _WORD * c.isalnum() | _MARK * (33 <= b <= 126 and not c.isalnum()) | _RARE * (b < 32 and c != "\n" or b == 127)
    out[0xC3] |= _LEAD
    out[0x80:0xC0] |= _TAIL
    out[[0x97, 0xB7]] = 0  # the signs of multiplication and division
    out[[0xC2, *range(0xE1, 0xF0)]] |= _RARE
    return out


_CLASS = _classes()


def _byte_chars() -> str:
    """What byte-level tokenizers write for each byte; but a line feed stays, which tells words apart."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return "".join("\n" if b == 10 else chars[b] for b in range(256))


def _is_odd(t: str) -> bool:
    if "  " not in t and "\n\n" not in t and " \n" not in t and "\n " not in t and t[:1] not in " \n" and t[-1:] not in " \n" and t.replace("\n", "").isprintable():
        return False  # the usual text, without a regular expression
    return bool(_ODD.search(t)) or "\x1f" in t


def _kind(config: dict) -> str:
    if config.get("truncation") or config.get("padding"):
        return "whole"
    for t in config.get("added_tokens") or ():
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]):
            return "whole"
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    steps = [(s.get("type"), (s.get("pattern") or {}).get("Regex"), s.get("content")) for s in (norm or {}).get("normalizers", ())]
    parts = (pre.get("pretokenizers") or [{}]) if pre.get("type") == "Sequence" else [{}]
    split = parts[0]
    known = [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
    if steps == known and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and (split.get("pattern") or {}).get("Regex") == _WORD_SPLIT and all(p.get("type") == "ByteLevel" and not p.get("use_regex") and not p.get("add_prefix_space") for p in parts[1:]):
        return "plain"
    return "whole"


class Encoder:
    """Texts to little-endian ids of ``width`` bytes (2 where the vocabulary allows it, else 4)."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.most, self.known, self.older, self.specials = path, cache_pieces, {}, {}, ()
        self._model = None
        self._shown = _byte_chars()
        self.mark, self.mark_id = None, -1
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.kind, size = "whole", lib.get_piece_size()
            self._library = lambda texts: lib.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import CharDelimiterSplit

            lib = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                config = json.load(f)
            self.kind, size = _kind(config), lib.get_vocab_size()
            self.specials = tuple(t["content"] for t in config.get("added_tokens") or ())
            marks = [t for t in config.get("added_tokens") or () if t.get("special") and not t.get("normalized")]
            if self.kind != "whole" and marks:
                self.mark, self.mark_id = marks[0]["content"], marks[0]["id"]
            levels = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
            if (self.kind == "spaced" or levels[-1].get("type") == "ByteLevel") and not any(_LETTERS.fullmatch(s.strip().encode()) for s in self.specials):
                self._model = Tokenizer(lib.model)  # the same model, without the search for pre-tokens
                self._model.pre_tokenizer = CharDelimiterSplit("\n")
            self.bytes_of = np.zeros(max(lib.get_vocab().values()) + 1, np.int64)
            for token, i in lib.get_vocab().items():
                self.bytes_of[i] = len(token.removesuffix("</w>"))  # a byte-level token has a character for each byte
            lib.no_truncation()
            lib.no_padding()
            self._library = lambda texts: [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")

    def _learn(self, words: list[bytes]) -> None:
        """Put distinct pieces, in UTF-8, into the cache."""
        if self.older:
            found = list(map(self.older.get, words))
            self.known.update((w, ids) for w, ids in zip(words, found) if ids is not None)
            words = [w for w, ids in zip(words, found) if ids is None]
        words = self._learn_letters(words)
        if words:
            pieces = [w.decode() for w in words]
            if self.kind == "plain":
                pieces = [p.removeprefix(" ") for p in pieces]
            distinct = list(dict.fromkeys(pieces))
            ids = dict(zip(distinct, self._whole(distinct)))
            self.known.update(zip(words, map(ids.__getitem__, pieces)))

    def _whole(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, many in one library call.

        Pieces that white space keeps apart are joined and their ids are told apart by the bytes that
        each token stands for; if these don't add up, or a piece isn't ASCII where the tokenizer
        changes letters, the pieces are joined by a special token, which the library splits at first.
        """
        plain, out = self.kind == "plain", {}
        apart = [bool(p) and p.isascii() for p in pieces] if plain else [p[:1] == " " for p in pieces]
        joined = [p for p, a in zip(pieces, apart) if a]
        marked = [p for p, a in zip(pieces, apart) if not a]
        for at in range(0, len(joined), 4096):
            part = joined[at : at + 4096]
            text = (" " if plain else "").join(part)
            ids = np.asarray(self._library([text])[0], self.dtype)
            split = None if any(s in text for s in self.specials) else self._split(ids, list(map(len, part)) if text.isascii() else [len(t.encode()) for t in part])
            if split is None:
                marked += part
            else:
                out.update(zip(part, split))
        out.update(zip(marked, self._marked(marked)))
        return [out[p] for p in pieces]

    def _learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Encode pieces of letters alone, with a space before them or none, by the library's model; the others."""
        if self._model is None:
            return words
        plain, letters, rest = self.kind == "plain", [], []
        for w in words:
            (letters if _LETTERS.fullmatch(w) else rest).append(w)
        for at in range(0, len(letters), 8192):
            part = letters[at : at + 8192]
            raw = b"\n".join(part)
            if plain:
                raw = raw.replace(b" ", b"")
                raw = raw.lower() if raw.isascii() else raw.decode().lower().encode()
            text = codecs.charmap_decode(raw, "strict", self._shown)[0]
            ids = np.asarray(self._model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            split = self._split(ids, [len(w) for w in raw.split(b"\n")])
            if split is None:
                rest += part
            else:
                self.known.update(zip(part, split))
        return rest

    def _split(self, ids: np.ndarray, sizes: list[int]) -> list[bytes] | None:
        """The ids of each piece, told apart by the bytes that tokens stand for; none if these don't add up."""
        ends, reach = np.cumsum(sizes), np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(reach, ends) + 1
        if not len(ids) or cut[-1] != len(ids) or (reach[cut - 1] != ends).any():
            return None
        raw, cut = ids.tobytes(), (cut * self.width).tolist()
        return [raw[x:y] for x, y in zip([0, *cut], cut)]

    def _marked(self, pieces: list[str]) -> list[bytes]:
        if self.mark is None:
            return self._encode(pieces)
        out = []
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            ids = np.asarray(self._library([self.mark.join(part)])[0], self.dtype)
            cut = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(cut) != len(part) + 1:  # a piece holds the mark itself
                out += self._encode(part)
                continue
            raw, w = ids.tobytes(), self.width
            out += [raw[w * (a + 1) : w * b] for a, b in zip(cut, cut[1:])]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x, self.dtype).tobytes() for x in self._library(texts)] if texts else []

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= GROUP_CHARS):
                chars += len(texts[to])
                to += 1
            out[at:to] = self._group(texts[at:to])
            at = to
        return out

    def _odd(self, texts: list[str], raw: bytes, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts must be encoded whole: those with special strings or, for the space-prefixing kind, unusual white space."""
        odd = np.zeros(len(texts), bool)
        if self.kind == "spaced" and len(raw):
            blank = kinds & _BLANK
            full = bounds[1:] > bounds[:-1]
            odd[full] = (blank[bounds[:-1][full]] | blank[bounds[1:][full] - 1]) > 0
            twice = np.flatnonzero(blank[1:] & blank[:-1]) + 1
            odd[np.searchsorted(bounds, twice, "right") - 1] = True
            rare = np.searchsorted(bounds, np.flatnonzero(kinds & _RARE), "right") - 1
            for i in np.unique(rare).tolist():
                odd[i] |= _is_odd(texts[i])
        if any(s.encode() in raw for s in self.specials):
            odd |= np.asarray([any(s in t for s in self.specials) for t in texts])
        return odd

    def _cuts(self, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin: at texts, at white space, after a line feed, and at punctuation after a letter or digit.

        Both tokenizers end a token where punctuation follows a letter or digit.
        """
        cut = (kinds & _BLANK).view(bool)
        cut[1:] |= (kinds[:-1] & _FEED) > 0
        mark = (kinds & _MARK) > 0
        cut[1:] |= mark[1:] & ((kinds[:-1] & _WORD) > 0)
        cut[2:] |= mark[2:] & ((kinds[1:-1] & _TAIL) > 0) & ((kinds[:-2] & _LEAD) > 0)
        cut[bounds[:-1][bounds[:-1] < len(kinds)]] = True
        return np.append(np.flatnonzero(cut), len(kinds))

    def _group(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self._encode(texts)
        parts = [t.encode() for t in texts]
        raw = b"".join(parts)
        if self.kind == "plain":
            raw = raw.replace(b"\n", b" ")
        bounds = np.cumsum([0, *map(len, parts)])
        kinds = _CLASS[np.frombuffer(raw, np.uint8)]
        odd = self._odd(texts, raw, kinds, bounds)
        if odd.any():
            out = np.empty(len(texts), object)
            out[odd] = self._encode([t for t, o in zip(texts, odd) if o])
            out[~odd] = self._group([t for t, o in zip(texts, odd) if not o])
            return out.tolist()
        if not raw:
            return [b""] * len(texts)
        cuts = self._cuts(kinds, bounds)
        del kinds, parts
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        at, words = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        if 2 * len(self.known) > self.most:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            self._learn([words[i] for i in new])
            for i in new:
                found[i] = self.known[words[i]]
        table = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        first, n = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(n)
        ids = np.repeat(first[at] - (ends - n), n)
        ids += np.arange(len(ids))
        held = table[ids].tobytes()
        to = (self.width * np.append(0, ends)[np.searchsorted(cuts, bounds)]).tolist()
        return [held[x:y] for x, y in zip(to, to[1:])]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """Place of an installed public tokenizer file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{lib.__name__} {lib.__version__}".encode()).hexdigest()


def text_lists(batches: Iterator[pa.RecordBatch], most: int = GROUP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches in slices of about ``most`` bytes of texts with their texts; null is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for at, to in zip(cut, cut[1:]):
            if at < to:
                yield batch.slice(at, to - at), [t or "" for t in texts.slice(at, to - at).to_pylist()]
    pa.default_memory_pool().release_unused()  # workers stay while other stages run
