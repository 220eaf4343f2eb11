"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

The tokenizer drops white space and never joins characters across it, so a
text's ids are its words' ids in a row. Strings of its special tokens are cut
out of the text before anything else, as the library does by default. A word
of letters followed by ASCII punctuation is cut once more between the two,
where the tokenizer's own splitter always cuts, and letters that its normaliser
only lower-cases go straight to its model. Everything else goes through the
whole library as it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of each of the two generations that one Python worker keeps from batch to batch.
#: A worker outlives its stage, so this memory counts in later stages too.
MAX_CACHED_WORDS = 200_000
#: Longer words aren't kept.
MAX_CACHED_BYTES = 64
#: Bytes of text that are looked up together.
BATCH_BYTES = 1_500_000
DEFAULT_VOCABULARY = "word_bpe_49k.json"

_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII's without the apostrophe
_PUNCTUATION_BYTES = _PUNCTUATION.encode()
#: Below this, letters are in composed form; all but the dotted capital I lower-case one to one.
_PLAIN_LETTERS = "ɐ"
#: Stands before a special token's string among the words; it is no byte of UTF-8.
_SPECIAL = b"\xff"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on; line ends stay."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256)).replace("Ċ", "\n")


def values(binary: pa.Array) -> list[bytes]:
    """An array's values without nulls; far faster than through one scalar a value."""
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, np.int32)[binary.offset : binary.offset + len(binary) + 1]
    raw = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data is not None and len(binary) else b""
    at = (at - at[:1]).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class WordEncoder:
    """Encodes bytes of UTF-8 to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, max_words: int = MAX_CACHED_WORDS, batch_bytes: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings are cut out before, case and all
        self._tokenizer.model._resize_cache(0)  # words are kept here
        self._max, self._bytes = max_words, batch_bytes
        self._ids = [i.to_bytes(4, "little") for i in range(max(self._tokenizer.get_vocab().values()) + 1)]
        #: Whether every id fits 16 bits.
        self.short = len(self._ids) <= 1 << 16
        self._letters = _byte_letters()
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._tails: dict[str, bytes] = {"": b""}
        added = {t.content.encode(): self._ids[i] for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self._added = {_SPECIAL + s: i for s, i in added.items()}
        self._cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        self._hint = os.path.commonprefix(list(added))

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole text; null counts as empty."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """Ids of each of many texts, in order."""
        for ids, counts in self.encode_column(pa.array(texts, pa.binary())):
            ends = np.cumsum(counts).tolist()
            yield from (ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False))

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts after others: their ids in a row, and how many each has.

        ``end_id``, if given, follows each text and counts as one of its ids.
        """
        texts = texts.cast(pa.binary()).fill_null(b"")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + (self._bytes or BATCH_BYTES), side="right")))
            yield self._encode(texts.slice(lo, hi - lo), end_id)
            lo = hi

    def _encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = texts.view(pa.string())
        if self._cut is not None and pc.any(pc.match_substring(text, self._hint.decode())).as_py():
            held = [self._split(t) for t in texts.to_pylist()]
            counts = np.fromiter(map(len, held), np.int64, len(held))
            words = pa.array([w for h in held for w in h], pa.binary())
        else:
            held = pc.ascii_split_whitespace(pc.ascii_lower(text))
            counts = pc.list_value_length(held).to_numpy().astype(np.int64)
            words = held.flatten().view(pa.binary())
        coded = words.dictionary_encode()
        found = self._look_up(values(coded.dictionary))
        if end_id is not None:
            found.append(self._ids[end_id])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(found), "<u4")
        at = coded.indices.to_numpy()
        last = np.cumsum(counts)
        if end_id is not None:
            at = np.insert(at, last, len(found) - 1)
            counts = counts + 1
            last = np.cumsum(counts)
        many = sizes[at]
        stops = np.cumsum(many)
        ids = flat[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts[at] - (stops - many), many)]
        upto = np.concatenate([np.zeros(1, np.int64), stops])[last]
        return ids, np.diff(upto, prepend=0)

    def _split(self, text: bytes) -> list[bytes]:
        """A text's words; special tokens' strings are words of their own."""
        words: list[bytes] = []
        for k, part in enumerate(self._cut.split(text)):
            if k % 2:
                words.append(_SPECIAL + part)
            else:
                words += part.lower().split()
        return words

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct words."""
        if len(self._new) > self._max:
            self._old, self._new = self._new, {}
        new, old = self._new, self._old
        missing = set(words).difference(new)
        again = missing.intersection(old)
        for w in again:
            new[w] = old[w]
        missing -= again
        self._learn(missing)
        found = list(map(new.__getitem__, words))
        for w in missing:
            if len(w) > MAX_CACHED_BYTES:
                del new[w]
        return found

    def _learn(self, words: set[bytes]) -> None:
        ids, tails = self._ids, self._tails
        plain: list[tuple[bytes, str, str]] = []  # words of ASCII letters and punctuation
        other: list[tuple[bytes, str, str]] = []  # of other letters that only need lower-casing
        later: list[tuple[bytes, str]] = []
        for w in words:
            if w.isascii():
                whole = w.decode()
                head = whole if whole.isalpha() else whole.rstrip(_PUNCTUATION)
                if head.isalpha():
                    plain.append((w, head, whole[len(head) :]))
                else:
                    later.append((w, whole))
            elif w in self._added:
                self._new[w] = self._added[w]
            else:
                whole = w.decode("utf-8", "replace")
                head = whole.rstrip(_PUNCTUATION)
                if head.isalpha() and max(head) < _PLAIN_LETTERS and "İ" not in head:
                    other.append((w, head, whole[len(head) :]))
                else:
                    later.append((w, whole))
        if len(tails) > 10_000:
            tails.clear()
            tails[""] = b""
        fresh = list({t for _, _, t in plain}.union(t for _, _, t in other).difference(tails))
        ask = fresh + [t for _, t in later]
        if ask:
            got = [b"".join([ids[i] for i in e.ids]) for e in self._tokenizer.encode_batch_fast(ask, add_special_tokens=False)]
            tails.update(zip(fresh, got, strict=False))
            self._new.update(zip([w for w, _ in later], got[len(fresh) :], strict=True))
        # letters in one string are mapped at once
        mapped = "\n".join([h for _, h, _ in other]).lower().encode().decode("latin-1").translate(self._letters).split("\n")
        self._tokenize(plain, [h for _, h, _ in plain])
        self._tokenize(other, mapped)

    def _tokenize(self, words: list[tuple[bytes, str, str]], letters: list[str]) -> None:
        tokenize, ids, tails, put = self._tokenizer.model.tokenize, self._ids, self._tails, self._new
        for (w, _, tail), head in zip(words, letters, strict=False):
            found = [ids[t.id] for t in tokenize(head)]
            if tail:
                found.append(tails[tail])
            put[w] = b"".join(found)
