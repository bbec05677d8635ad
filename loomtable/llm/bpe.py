"""Encoding of whole texts by the tokenizers library, each distinct segment once."""

from __future__ import annotations

import numpy as np

from loomtable.llm.words import span_hashes

_LIVE: dict[str, SegmentEncoder] = {}


def _table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_BLANK = _table([0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
_ALNUM = _table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Bytes that begin a visible character for sure: ASCII but no control and no space, and first bytes of blocks without white space.
_VISIBLE = _table([*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)])


def segment_starts(data: np.ndarray) -> np.ndarray:
    """Where segments begin in texts that are joined, begun and ended by a zero byte.

    Byte-level BPE never merges across a pre-token's end, so a text may be cut
    wherever a pre-token is sure to begin: at a space that stands behind a
    visible ASCII character or before a visible one; before and behind a
    full stop or comma between a letter or digit and a letter, digit or white
    space; and around a line end between visible characters.  Each zero byte
    is a segment of its own.
    """
    before, after = np.concatenate([data[:1], data[:-1]]), np.concatenate([data[1:], data[-1:]])
    # C3 xx are letters, but for the signs of multiplication and division
    second = np.concatenate([data[:2], data[:-2]])
    latin = (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    word_before = _ALNUM[before] | latin
    ascii_before = (before < 0x80) & _VISIBLE[before]
    next_latin = after == 0xC3
    if next_latin.any():  # the sign of multiplication or division may follow
        third = np.concatenate([data[2:], data[-1:], data[-1:]])
        next_latin &= (third != 0x97) & (third != 0xB7)
    word_after = _ALNUM[after] | next_latin
    seen_after = _VISIBLE[after]
    space = (data == 0x20) & (ascii_before | seen_after)
    mark = ((data == 0x2E) | (data == 0x2C)) & word_before & (word_after | (after == 0x20) | (after == 0x0A) | (after == 0))
    line = (data == 0x0A) & (ascii_before | latin) & seen_after
    alone = mark | line | (data == 0)
    starts = space | alone
    starts[1:] |= alone[:-1]
    starts[0] = True
    return np.flatnonzero(starts)


class SegmentEncoder:
    """Ids of whole texts.

    Texts are cut by ``segment_starts``; segments are told apart by 64-bit
    hashes, and each distinct one is encoded by the library once a call, or
    taken from the cache.  The cache holds at most ``limit`` segments that were
    seen in two calls, besides half as many seen in one, and is renewed when
    too many look-ups miss it.
    Strings of added tokens inside a text give these tokens, as the library
    has it.  Texts with such a string or a zero byte are encoded whole.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.cache, self.once = limit, {}, {}
        self.asked = self.missed = 0
        self.begins = np.array([x.startswith("Ġ") for x, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda v: v[1])])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each behind a space: they are encoded many at once and cut where a token begins with the space."""
        out: list[bytes] = []
        groups = [words[k : k + 200] for k in range(0, len(words), 200)]
        for group, ids in zip(groups, self._ids(["".join(g) for g in groups]), strict=True):
            cut = np.flatnonzero(self.begins[ids]).tolist()
            if len(cut) != len(group):
                out += [x.tobytes() for x in self._ids(group)]
                continue
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(cut, [*cut[1:], len(ids)], strict=True)]
        return out

    def _look_up(self, hashes: list[int], where: list[tuple[int, int]], data: bytes) -> list[bytes]:
        """Ids of distinct segments, given by hash and place."""
        if self.asked > 2_000_000:
            if self.missed > 0.5 * self.asked:
                self.cache.clear()
            self.asked = self.missed = 0
        cache, once = self.cache, self.once
        out = list(map(cache.get, hashes))
        miss = [k for k, x in enumerate(out) if x is None]
        self.asked += len(out)
        self.missed += len(miss)
        new = []
        for k in miss:
            if (x := once.pop(hashes[k], None)) is None:
                new.append(k)
            else:  # seen for the second time
                out[k] = x
                if len(cache) < self.limit:
                    cache[hashes[k]] = x
        texts = [data[where[k][0] : where[k][1]].decode("utf-8", "replace") for k in new]
        plain = [k for k, x in enumerate(texts) if x[0] == " " and x[1:].isalpha()]
        odd = [k for k, x in enumerate(texts) if not (x[0] == " " and x[1:].isalpha())]
        got: list = [None] * len(new)
        for k, x in zip(plain, self._words([texts[k] for k in plain]), strict=True):
            got[k] = x
        for k, x in zip(odd, self._ids([texts[k] for k in odd]), strict=True):
            got[k] = x.tobytes()
        if len(once) + len(new) > self.limit // 2:
            once.clear()
        for k, x in zip(new, got, strict=True):
            out[k] = x
            once[hashes[k]] = x
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        apart = [b"\0", *self.added]
        whole = [k for k, x in enumerate(texts) if any(a in x for a in apart)]
        for k, ids in zip(whole, self._ids([texts[k].decode("utf-8", "replace") for k in whole]), strict=True):
            out[k] = ids.tobytes()
        rest = sorted({k for k, x in enumerate(texts) if x}.difference(whole))
        if not rest:
            return out
        joined = b"\0".join([b"", *(texts[k] for k in rest), b""])
        data = np.frombuffer(joined, np.uint8)
        starts = segment_starts(data)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        limits = data[starts] == 0  # the zero bytes between texts have no ids
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        first = first.tolist()
        ids = self._look_up(unique.tolist(), list(zip(starts[first].tolist(), ends[first].tolist(), strict=True)), joined)
        zero = which[0]
        ids[zero] = b""
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = np.array([len(x) // 4 for x in ids])
        place = np.cumsum(length) - length
        n = length[which]
        end = np.cumsum(n)
        result = flat[np.repeat(place[which] - (end - n), n) + np.arange(int(end[-1]))].tobytes()
        bound = (4 * end[limits]).tolist()
        for k, a, b in zip(rest, bound[:-1], bound[1:], strict=True):
            out[k] = result[a:b]
        return out


def encoder(path: str) -> SegmentEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _LIVE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LIVE[path] = SegmentEncoder(path)
    return _LIVE[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
