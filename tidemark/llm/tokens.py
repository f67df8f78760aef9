"""Exact and quick token ids for the word-level BPE vocabulary.

The vocabulary's pre-tokenizer cuts a text at white space and where letters,
digits and other characters meet, so the ids of a text are the ids of its words
in order.  numpy finds the cuts on the bytes of a whole batch, Arrow numbers the
distinct words, each new word is encoded once per worker and remembered, and
numpy gathers the ids: a text costs little more than its *new* words.  The memory
is arrays: a word of up to 31 bytes is four 64-bit lanes, found by a hash of these
and compared whole, so it takes about 60 bytes and no object of Python's.  Chunks
between white space that hold anything but ASCII and the letters of U+00C0 to
U+00FF, an apostrophe or the start of a special token stay whole and go through
the complete tokenizer.  A vocabulary file with other rules of cutting is used
through the library alone, text by text.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Words that a worker remembers, their ids, and characters of words too long for lanes; when there are more, it begins anew, so memory is bounded.
WORDS, IDS, LONG_CHARS = 600_000, 6_000_000, 8_000_000
#: Bytes of text taken together.
STEP = 1 << 20
#: Bytes of a word that lie in lanes, one less than there are; the last holds the length.
LANES, LONGEST = 4, 31
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


#: The rules that the quick way follows: texts are composed and lower-cased, words are what this pattern finds, spelled byte by byte.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """The class of each byte; in a plain chunk, bytes of 0x80 and above belong to letters."""
    cls = np.full(256, OTHER, np.uint8)
    cls[[9, 10, 11, 12, 13, 32]] = SPACE
    cls[48:58] = DIGIT
    for a, b in ((65, 91), (97, 123), (128, 256)):
        cls[a:b] = LETTER
    return cls


CLASS = _classes()


def _byte_table() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)} | {32: 32}


def _cuts_words(spec: dict) -> bool:
    """Whether a vocabulary file has the rules of the quick way."""
    try:
        cut, spell = spec["pre_tokenizer"]["pretokenizers"]
        known = cut["type"] == "Split" and cut["pattern"] == {"Regex": PATTERN} and cut["behavior"] == "Removed" and cut["invert"]
        known = known and spell["type"] == "ByteLevel" and not spell["add_prefix_space"] and not spell["use_regex"]
        return known and [n["type"] for n in spec["normalizer"]["normalizers"]] == NORMALIZERS and spec["post_processor"] is None
    except (KeyError, TypeError, ValueError):
        return False


class ChunkTokenizer:
    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.raw = raw
        spec = json.loads(raw)
        self.quick = _cuts_words(spec)
        if not self.quick:
            return
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.table = _byte_table()
        self._forget_words()

    @functools.cached_property
    def whole(self):
        """The complete tokenizer, made when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.raw.decode())

    def _forget_words(self) -> None:
        self.n = 1  # a place that no word has
        self.hash, self.at = np.array([(1 << 64) - 1], np.uint64), np.zeros(1, np.int32)  # in the order of hash, where each word is
        self.lanes = np.full((1024, LANES), (1 << 64) - 1, np.uint64)
        self.start, self.size = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids, self.n_ids = np.zeros(4096, "<u4"), 0
        self.long: dict[str, int] = {}
        self.n_long = 0

    def _learn(self, new: list[str], whole: np.ndarray) -> int:
        """Encodes new words, those in whole chunks by the complete tokenizer, and gives them the next places; returns the first."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects, none in a cycle
        counts, parts = np.zeros(len(new), np.int32), []
        plain = np.flatnonzero(~whole)
        for i in range(0, len(plain), 4096):
            which = plain[i : i + 4096].tolist()
            spelled = " ".join(new[k] for k in which).encode().decode("latin-1").translate(self.table)
            got = self.model.encode(spelled, add_special_tokens=False)
            parts.append(np.array(got.ids, "<u4"))
            counts[which] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(which))
        rest = np.flatnonzero(whole).tolist()
        if rest:
            for k, got in zip(rest, self.whole.encode_batch([new[k] for k in rest], add_special_tokens=False), strict=True):
                parts.append(np.array(got.ids, "<u4"))
                counts[k] = len(got.ids)
        if collecting:
            gc.enable()
        flat = np.concatenate(parts)
        first, n, m = self.n, self.n + len(new), self.n_ids + len(flat)
        if n > len(self.start):
            room = max(n, 2 * len(self.start))
            self.lanes, self.start, self.size = np.resize(self.lanes, (room, LANES)), np.resize(self.start, room), np.resize(self.size, room)
        if m > len(self.ids):
            self.ids = np.resize(self.ids, max(m, 2 * len(self.ids)))
        self.ids[self.n_ids : m] = flat
        order = np.concatenate([plain, np.array(rest, np.int64)])  # as they lie in flat
        self.start[first + order] = self.n_ids + np.cumsum(counts[order]) - counts[order]
        self.size[first:n] = counts
        self.n, self.n_ids = n, m
        return first

    def _places(self, words: pa.Array, odd: np.ndarray) -> np.ndarray:
        """Where the memory has each of these distinct words; new ones are learned."""
        offsets = np.frombuffer(words.buffers()[1], "<i4")[words.offset : words.offset + len(words) + 1]
        size = np.diff(offsets)
        raw = np.zeros(int(offsets[-1]) + 8 * LANES + 8, np.uint8)
        raw[: offsets[-1]] = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        lanes = np.empty((len(words), LANES), np.uint64)
        for k in range(LANES):
            lanes[:, k] = eight[offsets[:-1] + 8 * k] & _KEEP[np.clip(size - 8 * k, 0, 8)]
        lanes[:, -1] |= size.astype(np.uint64) << np.uint64(56)
        mixed = (lanes * _ODD).sum(1, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[0]
        short = size <= LONGEST
        found = np.minimum(np.searchsorted(self.hash, mixed), len(self.hash) - 1)
        place = self.at[found]
        known = short & (self.hash[found] == mixed) & (self.lanes[place] == lanes).all(1)
        place = np.where(known, place, -1)
        for i in np.flatnonzero(~short).tolist():
            place[i] = self.long.get(words[i].as_py(), -1)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place
        if self.n > 1 and self.n + len(new) > WORDS:
            self._forget_words()
            return self._places(words, odd)
        texts = words.take(pa.array(new)).to_pylist()
        first = self._learn(texts, odd[new])
        place[new] = first + np.arange(len(new))
        self.lanes[first : self.n] = lanes[new]
        kept = new[short[new]]
        hashes, at = np.concatenate([self.hash, mixed[kept]]), np.concatenate([self.at, place[kept].astype(np.int32)])
        order = np.argsort(hashes, kind="stable")
        self.hash, self.at = hashes[order], at[order]
        for k in place[new[~short[new]]].tolist():
            self.long[texts[k - first]] = k
            self.n_long += len(texts[k - first])
        return place

    def _cut(self, raw: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of texts that begin at the given places of raw: the words, whether each is a whole chunk, and the number in each text."""
        cls = CLASS[raw]
        before = np.empty_like(raw)
        before[0], before[1:] = 0, raw[:-1]
        after = np.zeros_like(raw)
        after[:-1] = raw[1:]
        low = raw + ((raw >= 65) & (raw <= 90) | (before == 0xC3) & (raw >= 0x80) & (raw <= 0x9E)).astype(np.uint8) * np.uint8(32)
        odd = (raw >= 0xC4) | (raw == 0xC2) | (raw == 39) | (before == 0xC3) & ((raw == 0x97) | (raw == 0xB7)) | (raw == 60) & (after == 124)
        first = np.zeros(len(raw) + 1, bool)
        first[starts] = True
        first = first[:-1]
        inside = cls != SPACE
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:]
        cut = inside.copy()
        cut[1:] &= (cls[1:] != cls[:-1]) | (cls[1:] == DIGIT) | first[1:]
        if odd.any():
            chunk = np.cumsum(opens, dtype=np.int32) - 1
            strange = np.zeros(int(opens.sum()), bool)
            strange[chunk[odd]] = True
            kept = inside & strange[np.maximum(chunk, 0)]
            cut &= ~kept | opens
            low = np.where(kept, raw, low)
        else:
            kept = np.zeros(len(raw), bool)
        at = np.flatnonzero(cut)
        letters = low[inside]
        place = np.cumsum(inside, dtype=np.int32) - inside
        offsets = np.append(place[at], len(letters)).astype("<i4")
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes()))
        return words, kept[at], np.diff(np.append(np.searchsorted(at, starts), len(at)))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.quick:
            found = [np.array(x.ids, "<u4") for x in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)
        offsets = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        words, whole, n_words = self._cut(raw, offsets[:-1] - offsets[0])
        if not len(words):
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        odd = np.zeros(len(coded.dictionary), bool)
        odd[which[whole]] = True
        place = self._places(coded.dictionary, odd)[which]
        sizes = self.size[place]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.arange(ends[-1], dtype=np.int32) + np.repeat(self.start[place] - (ends - sizes).astype(np.int32), sizes)
        before = np.concatenate(([0], ends))
        out = self.ids[at], np.diff(before[np.concatenate(([0], np.cumsum(n_words)))])
        if self.n_ids > IDS or self.n_long > LONG_CHARS:
            self._forget_words()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each.  A null text is an empty one."""
        if len(texts) == 0:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        size = pc.binary_length(texts).to_numpy()
        step = np.cumsum(size) // STEP
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        got = [self._encode(texts.slice(a, b - a).cast(pa.string())) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


_tokenizers: dict[str, ChunkTokenizer] = {}


class Shipped:
    """A vocabulary file's bytes, read once on the driver and sent to every executor (they are of a fixed size)."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.digest = hashlib.sha256(raw).hexdigest()
        self.sent = spark.sparkContext.broadcast(raw)

    def tokenizer(self) -> ChunkTokenizer:
        """The worker's tokenizer."""
        if self.digest not in _tokenizers:
            _tokenizers[self.digest] = ChunkTokenizer(self.sent.value)
        return _tokenizers[self.digest]


def forget() -> None:
    """Gives the tokenizers' memory back, in a worker that goes on to other work."""
    _tokenizers.clear()


def vocabulary() -> str:
    """The path of the word-level vocabulary on the driver's machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
