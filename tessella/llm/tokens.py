"""Token ids of whole texts, from a tokenizer file whose pre-tokens never cross white space."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import blocks

#: Distinct words that a worker keeps before only those that recur stay.
CACHE_WORDS = 300_000
#: Bytes of text that are split at once; a longer text goes alone.
CHUNK_BYTES = 4 << 20
END_ID = 1
#: A word that new words are told apart by.
BETWEEN = "throughout"
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_encoders: dict[str, Encoder] = {}


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: ASCII letters, marks that end a word, white space."""
    tables = []
    for chars in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b".,!?;:", b" \n\t\r"):
        table = np.zeros(256, bool)
        table[list(chars)] = True
        tables.append(table)
    return tuple(tables)


_LETTER, _MARK, _SPACE = _kinds()


def spaced(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text ends with a blank before a single mark that follows a Latin letter and ends a word.

    Such a mark is a pre-token of its own, so the ids stay, and words come without it.
    """
    if len(raw) < 2:
        return raw, ends
    stops = np.r_[_SPACE[raw[1:]], True]
    stops[ends[ends > 0] - 1] = True
    at = np.flatnonzero(_MARK[raw] & stops)
    at = at[at > 0]
    before, second = raw[at - 1], raw[np.maximum(at - 2, 0)]
    # a letter of ASCII, or of Latin-1 in two bytes
    letter = _LETTER[before] | ((second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (at > 1))
    starts = np.r_[0, ends[:-1]]
    first = np.zeros(len(raw) + 1, bool)
    first[starts] = True
    at = at[letter & ~first[at]]
    return np.insert(raw, at, 0x20), ends + np.searchsorted(at, ends)


class Encoder:
    """ids of texts as little-endian 32-bit bytes.

    White space parts pre-tokens in these vocabularies, so the ids of a text are those of its words in
    turn. Arrow splits the texts, numbers their distinct words and finds the known ones; the tokenizers
    library encodes each new word once, and numpy lays the ids of words in the order of the text. When
    CACHE_WORDS is passed, the words that the present chunk shares with earlier ones stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # the same merges without regex and normaliser, for Latin words that are normal as they are
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        # a byte's character as byte-level vocabularies write it: printable Latin-1 as it is, the others from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte = np.zeros(256, "<u4")
        self.byte[shown] = shown
        hidden = np.flatnonzero(self.byte == 0)
        self.byte[hidden] = 0x100 + np.arange(len(hidden))
        self.byte[0x20] = 0x20
        letters = [chr(c) for c in range(0x100) if chr(c).isalpha() and chr(c) not in "ªµº"]
        probe = " ".join([*letters, "".join(letters), "".join(reversed(letters)), "I", "The", "QUE"])
        marks = "the. café, x! y? z; w: é."
        encode = lambda t: self.library.encode(t, add_special_tokens=False).ids
        self.alike = self._plain(probe) == encode(probe)
        self.marked = encode(marks) == encode(marks[:-1].replace(". ", " . ").replace(", ", " , ").replace("! ", " ! ").replace("? ", " ? ").replace("; ", " ; ").replace(": ", " : ") + " .")
        own = encode(BETWEEN)
        told = len(own) == 1 and encode(f"é-1 {BETWEEN} {BETWEEN} 2x.") == [*encode("é-1"), *own, *own, *encode("2x.")]
        self.between = own[0] if told else None
        self._reset()

    def _plain(self, joined: str) -> list[int]:
        """The ids of words of Latin letters, joined by spaces."""
        joined = self.byte[np.frombuffer(joined.lower().encode(), "u1")].tobytes().decode("utf-32-le")
        return self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids

    def _reset(self) -> None:
        self.words = pa.array([""], pa.string())
        self.ids = np.empty(0, "<u4")  # ids of word i: ids[start[i] : start[i + 1]]
        self.start = np.zeros(2, np.int64)

    def _add(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Numbers words, whose ids follow each other in ids."""
        self.words = pa.concat_arrays([self.words, words])
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(lengths)]
        self.ids = np.r_[self.ids, ids]

    def _laid(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words in turn, and how many each has."""
        first, n = self.start[at], self.start[at + 1] - self.start[at]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.ids[np.repeat(first - end + n, n) + np.arange(total)], n

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Numbers new distinct words."""
        latin = pc.match_substring_regex(fresh, LATIN).to_numpy(zero_copy_only=False) & self.alike
        number = np.empty(len(fresh), np.int64)
        own = fresh.filter(pa.array(latin))
        if len(own):
            # one call for all: each word gives one pre-token, whose last id alone ends a word
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), " ")[0].as_py()
            ids = np.array(self._plain(joined), "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(own):
                latin[:] = False
            else:
                number[latin] = len(self.words) + np.arange(len(own))
                self._add(own, ids, np.diff(stops, prepend=0))
        if not latin.all():
            own = fresh.filter(pa.array(~latin))
            number[~latin] = len(self.words) + np.arange(len(own))
            self._add(own, *self._apart(own.to_pylist()))
        return number

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in turn, and how many each has: by one call with BETWEEN, which has an id of its own, between every two of them."""
        if self.between is not None:
            ids = np.array(self.library.encode_batch_fast([f" {BETWEEN} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(ids == self.between)
            if len(stops) == len(words) - 1:
                return np.delete(ids, stops), np.diff(np.r_[-1, stops, len(ids)]) - 1
            # a word holds it
            has = [BETWEEN in w.lower() for w in words]
            if 0 < sum(has) < len(words):
                parts: list = [None] * len(words)
                for flag in (False, True):
                    at = [i for i, h in enumerate(has) if h == flag]
                    own, n = self._apart([words[i] for i in at])
                    for i, part in zip(at, np.split(own, np.cumsum(n)[:-1])):
                        parts[i] = part
                return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        got = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.array(i, "<u4") for i in got]), np.array([len(i) for i in got], np.int64)

    def _numbered(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words, after learning those that are new."""
        found = pc.index_in(words, value_set=self.words)
        new = found.is_null()
        fresh = words.filter(new)
        if len(self.words) + len(fresh) > CACHE_WORDS:
            ids, n = self._laid(found.drop_null().to_numpy())
            kept = words.filter(pc.invert(new))
            self._reset()
            self._add(kept, ids, n)
            found = pc.index_in(words, value_set=self.words)
            new = found.is_null()
            fresh = words.filter(new)
        out = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if len(fresh):
            out[new.to_numpy(zero_copy_only=False)] = self._learn(fresh)
        return out

    def _chunk(self, texts: pa.Array, separators: bool) -> tuple[np.ndarray, np.ndarray]:
        # Arrow also parts at four separators that are characters to the tokenizer
        odd = np.flatnonzero(pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)) if separators else np.empty(0, int)
        whole = [texts[int(i)].as_py() for i in odd]
        if len(odd):
            ordinary = np.ones(len(texts), bool)
            ordinary[odd] = False
            texts = pc.if_else(pa.array(ordinary), texts, "")
        if self.marked:
            texts = pa.concat_arrays([texts])  # without a slice's offset
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
            raw = np.frombuffer(texts.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
            raw, ends = spaced(raw, offsets[1:] - offsets[0])
            texts = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
        split = pc.utf8_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, n = self._laid(self._numbered(words.dictionary)[words.indices.to_numpy()])
        ends = np.r_[0, np.cumsum(n)][np.cumsum(pc.list_value_length(split).to_numpy())]
        lengths = np.diff(ends, prepend=0)
        if len(odd):
            parts = np.split(ids, ends[:-1])
            for i, e in zip(odd.tolist(), self.library.encode_batch_fast(whole, add_special_tokens=False)):
                parts[i] = np.array(e.ids, "<u4")
                lengths[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, lengths

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """The ids of texts, some texts at a time, with the place of the first; null texts are empty."""
        texts = pc.fill_null(texts, "")
        separators = bool((np.frombuffer(texts.buffers()[2] or b"", "u1") - np.uint8(0x1C) < 4).any())
        for lo, hi in blocks(pc.binary_length(texts).to_pylist(), CHUNK_BYTES):
            ids, lengths = self._chunk(texts.slice(lo, hi - lo), separators)
            raw, ends = ids.tobytes(), (4 * np.cumsum(lengths)).tolist()
            yield lo, [raw[a:b] for a, b in zip([0, *ends], ends)]

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        return [b for _, part in self.chunks(pa.array(texts, pa.string())) for b in part]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
