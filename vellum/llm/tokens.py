"""Token ids of whole texts by the tokenizers library, with the ids of words remembered.

A byte-level BPE cuts a text into pieces by a pattern before it merges. Some piece borders show in the bytes: before the last
space of a run that something visible follows, before a line end between visible characters, before a full stop or comma behind
a letter or digit. Texts that hold an added token's string (``<|endoftext|>``) go to the library whole, as it cuts there first. Between two such borders a chunk's ids don't depend on its surroundings, and chunks repeat; so a worker
finds chunks and their hashes with array operations, has the library encode those it hasn't seen, and looks up
the rest. Where a border is uncertain (beside characters that may be white space beyond ASCII) none is assumed. The memory is bounded by
``CACHE_CHUNKS`` chunks; when it is full, it starts anew from what the present texts need.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Chunks remembered (a bound of memory and speed only) and slots of their table, which a part more must fit in; chunks encoded by one call.
CACHE_CHUNKS, SLOTS, CALL_CHUNKS = 1_400_000, 1 << 22, 2048
#: Bytes of text handled at once.
PART_BYTES = 512 << 10

_U = np.uint64
_SPACE = re.compile(r"\s")
_encoders: dict[tuple[str, bool], "Encoder"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def id_type(path: str) -> str:
    """numpy's name of the smallest type for the vocabulary's ids. No encoder stays in memory for it: the driver needs no more."""
    from tokenizers import Tokenizer

    return "<u4" if Tokenizer.from_file(path).get_vocab_size() > 1 << 16 else "<u2"


def encoder(path: str, special_as_text: bool = False) -> "Encoder":
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]


def _is(*parts: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b"".join(parts))] = True
    return out


#: What a byte is, as bits: a letter or digit; visible ASCII; the beginning of a character that is no white space; a mark; a space; a line end; first of two bytes of a Latin letter, and second.
_ALNUM, _SEEN, _NEXT, _MARK, _BLANK, _END, _LATIN, _SECOND = (np.uint8(1 << i) for i in range(8))
_BITS = np.zeros(256, np.uint8)
for _bit, _of in (
    (_ALNUM, _is(bytes(range(48, 58)), bytes(range(65, 91)), bytes(range(97, 123)))),
    (_SEEN, _is(bytes(range(33, 127)))),
    (_NEXT, _is(bytes(range(33, 127)), bytes(x for x in range(0xC3, 256) if x not in (0xE1, 0xE2, 0xE3)))),
    (_MARK, _is(b".,")),
    (_BLANK, _is(b" ")),
    (_END, _is(b"\n")),
    (_LATIN, _is(b"\xc3")),
    (_SECOND, _is(bytes(x for x in range(0x80, 256) if x not in (0x97, 0xB7)))),
):
    _BITS[_of] |= _bit
_CLASS = _BITS.tobytes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _random(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = _random(256, 1), _random(256, 2)
#: Masks of a number's first bytes; bytes of a chunk that are hashed eight at a time.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
EIGHTS = 64


def chunk_starts(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """First bytes of chunks; docs: first bytes of documents that aren't empty."""
    cut = np.zeros(len(data), bool)
    kind = np.frombuffer(data.tobytes().translate(_CLASS), np.uint8)
    before, here, after = kind[:-2], kind[1:-1], kind[2:]
    cut[1:-1] = ((here & _BLANK != 0) | (here & _END != 0) & (before & _SEEN != 0)) & (after & _NEXT != 0)
    letter = kind & _ALNUM != 0
    letter[1:] |= (kind[:-1] & _LATIN != 0) & (kind[1:] & _SECOND != 0)
    mark = kind & _MARK != 0
    cut[1:] |= mark[1:] & letter[:-1]
    # Nothing is known of what is beside a document's ends.
    first = docs[docs + 1 < len(data)]
    cut[first[1:] - 1] &= mark[first[1:] - 1]
    cut[docs] = True
    return np.flatnonzero(cut)


class Encoder:
    """encode_batch(texts) -> ids as numpy uint32, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    special_as_text: strings of special tokens in a text are ordinary text and don't get the special tokens' ids.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.uint32 if self.wide else np.uint16
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.power = [_random(64, 3) | _U(1), _random(64, 4) | _U(1)]
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(SLOTS, -1, np.int32)
        # Room for all that may come; pages that aren't used take no memory. The first place stands for none.
        self.n, self.used = 1, 0
        self.keys, self.checks = np.zeros(SLOTS // 2 + 1, _U), np.zeros(SLOTS // 2 + 1, _U)
        self.at, self.size = np.zeros(SLOTS // 2 + 1, np.int64), np.zeros(SLOTS // 2 + 1, np.int32)
        self.pool = np.zeros(1 << 20, self.kind)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each chunk: by eight bytes at a time, and what is beyond ``EIGHTS`` bytes by each byte and its place."""
        eights = np.frombuffer(data.tobytes() + bytes(16 - len(data) % 8), "<u8")
        keys = sizes.astype(_U) * _U(0x9E3779B97F4A7C15)
        checks = ~keys
        some, at, left = slice(None), starts, sizes
        for _ in range(EIGHTS // 8):
            i, shift = at >> 3, ((at & 7) << 3).astype(_U)
            word = (eights[i] >> shift | eights[i + 1] << _U(1) << _U(63) - shift) & _FIRST[np.minimum(left, 8)]
            key, check = (keys[some] ^ word) * _U(0xBF58476D1CE4E5B9), (checks[some] + word) * _U(0x94D049BB133111EB)
            keys[some], checks[some] = key ^ (key >> _U(32)), check ^ (check >> _U(29))
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            some, at, left = more if isinstance(some, slice) else some[more], at[more] + 8, left[more] - 8
        else:
            if (longest := int(left.max())) > len(self.power[0]):
                self.power = [_random(2 * longest, 3) | _U(1), _random(2 * longest, 4) | _U(1)]
            first = np.cumsum(left) - left
            place = np.arange(int(left.sum())) - np.repeat(first, left)
            rest = data[np.repeat(at, left) + place]
            keys[some] ^= np.add.reduceat(_BYTE[0][rest] * self.power[0][place], first)
            checks[some] ^= np.add.reduceat(_BYTE[1][rest] * self.power[1][place], first)
        return _mix(keys), checks

    def _raw(self, chunks: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(chunks), CALL_CHUNKS):
            out += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(chunks[at : at + CALL_CHUNKS], add_special_tokens=False)]
        return out

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, joined, and how many each has. Words behind a space are encoded as lines of one text: a line end between a visible character and a space is a piece of its own."""
        lone = np.array([not (c[0] == " " and len(c) > 1 and not _SPACE.search(c, 1)) for c in chunks])
        sizes = np.zeros(len(chunks), np.int64)
        parts: list[np.ndarray] = []
        plain = np.flatnonzero(~lone)
        order: list[np.ndarray] = []
        for i in range(0, len(plain), CALL_CHUNKS):
            some = plain[i : i + CALL_CHUNKS]
            # The batch call leaves out where tokens stand in the text, which the plain call works out.
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([chunks[j] for j in some.tolist()])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) != len(some) - 1:
                lone[some] = True
                continue
            sizes[some] = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
            parts.append(ids[ids != self.line_end])
            order.append(some)
        rest = np.flatnonzero(lone)
        made = self._raw([chunks[j] for j in rest])
        sizes[rest] = [len(m) for m in made]
        flat = np.concatenate([*parts, *made]) if parts or made else np.zeros(0, self.kind)
        order = np.concatenate([*order, rest])
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return self._gather(flat, starts, sizes), sizes

    @staticmethod
    def _gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return pool[np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)]

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the chunks, and which are known: open addressing, a step at a time for those still looking."""
        out = np.full(len(keys), -1, np.int64)
        looking, slot = np.arange(len(keys)), keys & _U(SLOTS - 1)
        while len(looking):
            i = self.slots[slot]
            hit = (i >= 0) & (self.keys[i] == keys[looking])
            out[looking[hit]] = i[hit]
            on = (i >= 0) & ~hit
            looking, slot = looking[on], (slot[on] + _U(1)) & _U(SLOTS - 1)
        found = out >= 0
        out[~found] = 0
        found &= self.checks[out] == checks
        return out, found

    def _learn(self, blob: bytes, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        ids, n = self._encode([blob[a : a + b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), sizes.tolist(), strict=True)])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        new = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        for room, values in ((self.keys, keys), (self.checks, checks), (self.at, self.used + np.cumsum(n) - n), (self.size, n)):
            room[self.n : self.n + len(keys)] = values
        self.n, self.used = self.n + len(keys), self.used + len(ids)
        slot = keys & _U(SLOTS - 1)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]  # of several that want a slot, one gets it
            out = self.slots[slot] != new
            new, slot = new[out], (slot[out] + _U(1)) & _U(SLOTS - 1)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not cut:
            return self._encode_plain(texts)
        out = self._encode_plain(["" if any(a in t for a in self.added) else t for t in texts])
        for i in cut:
            out[i] = np.array(self.tokenizer.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids, np.uint32)
        return out

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(text.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= PART_BYTES:
                out += self._encode_part(held)
                held, size = [], 0
        return out + self._encode_part(held)

    def _encode_part(self, texts: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        blob = b"".join(texts)
        if not blob:
            return [np.zeros(0, np.uint32) for _ in texts]
        data = np.frombuffer(blob, np.uint8)
        docs = (np.cumsum(lengths) - lengths)[lengths > 0]
        starts = chunk_starts(data, docs)
        sizes = np.diff(np.append(starts, len(data)))
        keys, checks = self._hashes(data, starts, sizes)
        i, found = self._find(keys, checks)
        if not found.all():
            if self.n > CACHE_CHUNKS or self.n + len(keys) > SLOTS // 2:
                self._forget()
                found[:] = False
            new, first = np.unique(keys[~found], return_index=True)
            first = np.flatnonzero(~found)[first]
            self._learn(blob, starts[first], sizes[first], new, checks[first])
            late = np.flatnonzero(~found)
            i[late], found[late] = self._find(keys[late], checks[late])
        at, n = self.at[i], self.size[i]
        if not found.all():  # equal keys of different chunks
            odd = np.flatnonzero(~found)
            ids, m = self._encode([blob[starts[j] : starts[j] + sizes[j]].decode("utf-8", "surrogatepass") for j in odd])
            at[odd], n[odd] = self.used + np.cumsum(m) - m, m
            ids = self._gather(np.concatenate([self.pool[: self.used], ids]), at, n)
        else:
            ids = self._gather(self.pool, at, n)
        ends = np.cumsum(n)
        cuts = np.searchsorted(starts, np.cumsum(lengths))
        marks = np.where(cuts > 0, ends[np.maximum(cuts, 1) - 1], 0)
        return np.split(ids.astype(np.uint32), marks[:-1]) if len(marks) else []
