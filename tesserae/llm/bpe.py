"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can stand last in the word's BPE encoding. ``PrefixBpe`` finds it from left to right:
a suffix automaton of the whole vocabulary lists the tokens that end at a position, and a pair-compatibility test tells which of
them may follow the last token stored for the shorter prefix. Following the stored tokens back from the end of the word gives the
ids, in time linear in the word's length whatever the merges do.

Normalisation and word splitting are the tokenizer file's own (its ``normalizer`` and ``pre_tokenizer`` sections); both work on
stretches between ASCII white space alone, so a text is cut there and each stretch's ids are remembered in a bounded memo.

Edge cases: a null text is the empty text; the empty text has no ids and decodes to the empty string; control strings of the
vocabulary's special tokens inside a text become those tokens, as the library has it; a null document id is kept; repeated rows
give a row each.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches a worker remembers, and the longest of them in bytes; texts are worked on in groups of so many bytes.
MEMO_ENTRIES = 250_000
MEMO_BYTES = 64
GROUP_BYTES = 1_200_000
#: Longer words go through the scalar program: the columnar one takes a step for each place of its longest word.
COLUMN_BYTES = 192
#: The end-of-word form of byte b is written chr(END + b) inside this module.
END = 0xE000


def _byte_chars() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, with the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class SuffixAutomaton:
    """Of a set of strings. State 0 is the root; ``size[s]`` is the longest string that leads to s, ``link[s]`` its suffix link."""

    def __init__(self) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _clone(self, p: int, q: int, c: str) -> int:
        new = len(self.go)
        self.go.append(dict(self.go[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = new
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: str) -> int:
        q = self.go[last].get(c, -1)
        if q >= 0:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, c)
        new = len(self.go)
        self.go.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        p = last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, c)
        return new

    def add(self, string: str) -> int:
        last = 0
        for c in string:
            last = self._extend(last, c)
        return last


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Masks for the first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class HashTable:
    """Fixed map from unsigned 64-bit keys to 32-bit values, looked up by column; -1 where a key is absent."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self._values = np.full(1 << bits, -1, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self._values[at[todo]] == -1]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self._keys[at[won]], self._values[at[won]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.MIX) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self._values[at]
        open_ = np.flatnonzero((self._keys[at] != keys) & (out >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self._mask
            out[open_] = self._values[at[open_]]
            open_ = open_[(self._keys[at[open_]] != keys[open_]) & (out[open_] >= 0)]
        return out


def _simple_words() -> tuple[re.Pattern, re.Pattern]:
    """For characters below U+0180, which no normal form changes: which stretches are of them alone, and their words once lowered."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(0x180)):
        kinds.setdefault(unicodedata.category(c)[0], []).append(re.escape(c))
    letters, numbers, spaces = "".join(kinds["L"]), "".join(kinds["N"]), "\\t-\\r \x85\xa0"
    return re.compile(f"(?!.*<\\|)[\x00-\u012f\u0131-\u017f]*", re.S), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


#: The splitting that ``_simple_words`` stands for; a file with another goes through the library's own throughout.
SIMPLE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class PrefixBpe:
    """Encoder and decoder of a ``tokenizers`` file whose model is byte-level BPE with word ends and no decoder."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, tool = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("needs a BPE file without post-processor and decoder")
        self._normal, self._split = tool.normalizer, tool.pre_tokenizer
        suffix, vocab, chars = model.get("end_of_word_suffix") or "", model["vocab"], _byte_chars()
        self._end = {c: chr(END + b) for c, b in chars.items()} if suffix else {c: c for c in chars}
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        own = lambda t: t[: -len(suffix) - 1] + self._end[t[-len(suffix) - 1]] if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
        #: Rank order: the single symbols first, then what each merge makes. ids[r] is the vocabulary's id of rank r.
        symbols = [t for t in vocab if len(own(t)) == 1]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        texts = symbols + [a + b for a, b in merges]
        rank = {t: r for r, t in reversed([*enumerate(texts)])}
        self.ids = [vocab[t] for t in texts]
        self._pair = {(rank[a], rank[b]): r + len(symbols) for r, (a, b) in reversed([*enumerate(merges)])}
        self._left, self._right = [*range(len(symbols))], [*range(len(symbols))]
        for a, b in merges:
            self._left.append(rank[a])
            self._right.append(rank[b])
        self._fits: dict[tuple[int, int], bool] = {}
        self.names = {i: t.encode() for t, i in [*vocab.items(), *self._special.items()]}
        auto, at = SuffixAutomaton(), {}
        for t in sorted(rank):
            at[t] = auto.add(own(t))
        self._go, self._link, self._size = auto.go, auto.link, auto.size
        here = {self._state(own(t)): r for t, r in rank.items()}
        #: For each state its own token or that of the nearest suffix link which has one: (rank, length, next state to look at).
        self._out: list[tuple[int, int, int] | None] = [None] * len(self._go)
        for s in sorted(range(len(self._go)), key=self._size.__getitem__):
            up = self._link[s]
            self._out[s] = (here[s], self._size[s], up) if s in here else self._out[up] if up > 0 else None
        self._memo: dict[bytes, bytes] = {}
        self._chars = {**{c: b for c, b in chars.items()}, **({e: 256 + chars[c] for c, e in self._end.items()} if suffix else {})}
        self._bytes, self._final = {b: c for c, b in chars.items()}, 256 if suffix else 0
        moves = [(s * 512 + self._chars[c], t) for s, go in enumerate(self._go) for c, t in go.items()]
        self._moves = HashTable(np.array([m[0] for m in moves], np.uint64), np.array([m[1] for m in moves], np.int32))
        self._pairs = HashTable(np.array([a << 32 | b for a, b in self._pair], np.uint64), np.array([*self._pair.values()], np.int32))
        self._np_link, self._np_size = np.array(self._link, np.int32), np.array(self._size, np.int32)
        self._np_out = np.array([x or (-1, 0, 0) for x in self._out], np.int32)
        self._np_left, self._np_right, self._np_ids = np.array(self._left, np.int64), np.array(self._right, np.int64), np.array(self.ids, "<u4")
        self._near_keys, self._near = np.full(1 << 20, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << 20, bool)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self._simple = _simple_words() if (spec.get("normalizer") or {}).get("normalizers") == SIMPLE_NORMAL and (steps[0].get("pattern") or {}).get("Regex") == SIMPLE_SPLIT else None

    def _state(self, string: str) -> int:
        s = 0
        for c in string:
            s = self._go[s][c]
        return s

    def fits(self, a: int, b: int) -> bool:
        """Whether ranks a and b side by side stay apart: no merge that runs before they are whole crosses their border."""
        known = self._fits.get((a, b))
        if known is not None:
            return known
        key, bound, good = (a, b), len(self.ids), True
        while True:
            over = self._pair.get((a, b))
            if over is not None and over < bound:
                good = False
                break
            # Undo the later of the two merges at the border; the left one runs first if both have one rank.
            for side in ("left", "right") if a > b else ("right", "left"):
                if side == "left" and self._right[a] != a:
                    a, bound = self._right[a], a
                    break
                if side == "right" and self._left[b] != b:
                    b, bound = self._left[b], b + 1
                    break
            else:
                break
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        self._fits[key] = good
        return good

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given in byte-level characters."""
        if not symbols:
            return []
        string = symbols[:-1] + self._end[symbols[-1]]
        go, link, size, out, fits = self._go, self._link, self._size, self._out, self.fits
        last: list[int] = []
        back: list[int] = []
        state = length = 0
        for i, c in enumerate(string):
            while state and c not in go[state]:
                state = link[state]
                length = size[state]
            state = go[state].get(c, 0)
            length = length + 1 if state else 0
            found = out[state] if length == size[state] else out[link[state]] if state else None
            while found is not None:
                token, long, up = found
                start = i + 1 - long
                if start == 0 or fits(last[start - 1], token):
                    last.append(token)
                    back.append(start)
                    break
                found = out[up] if up > 0 else None
            else:
                raise ValueError(f"no token ends at {i} in {symbols!r}")
        ids, i = [], len(string)
        while i:
            ids.append(self.ids[last[i - 1]])
            i = back[i - 1]
        return ids[::-1]

    def fit_columns(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs of ranks at once, through a direct-mapped cache of pairs."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = ((keys * HashTable.MIX) >> np.uint64(44)).astype(np.int64)
        out = self._near[slot]
        miss = np.flatnonzero(self._near_keys[slot] != keys)
        if len(miss):
            fresh, back = np.unique(keys[miss], return_inverse=True)
            x, y = (fresh >> np.uint64(32)).astype(np.int64), (fresh & np.uint64(0xFFFFFFFF)).astype(np.int64)
            good, bound, live = np.ones(len(fresh), bool), np.full(len(fresh), len(self.ids), np.int64), np.arange(len(fresh))
            while len(live):
                p, q, r = x[live], y[live], bound[live]
                over = self._pairs.get(p.astype(np.uint64) << np.uint64(32) | q.astype(np.uint64))
                bad = (over >= 0) & (over < r)
                good[live[bad]] = False
                can_left, can_right = self._np_right[p] != p, self._np_left[q] != q
                left = can_left & ((p > q) | ~can_right) & ~bad
                right = can_right & ((p <= q) | ~can_left) & ~bad
                i, j = live[left], live[right]
                bound[i], x[i] = x[i], self._np_right[x[i]]
                bound[j], y[j] = y[j] + 1, self._np_left[y[j]]
                live = live[left | right]
            out[miss] = good[back]
            self._near_keys[slot[miss]], self._near[slot[miss]] = keys[miss], good[back]
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words at once, each given in UTF-8: the program of ``word``, one column per place."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        long = size[order]
        width = int(long[0])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        start = (np.cumsum(size) - size)[order]
        # Row p is place p of every word that has it; words are in order of falling length.
        last = np.full((width, len(words)), -1, np.int32)
        back = np.zeros((width, len(words)), np.int32)
        state, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        for p in range(width):
            n = int(np.searchsorted(-long, -p, side="left"))
            c = flat[start[:n] + p] + np.where(long[:n] == p + 1, self._final, 0)
            s, m = state[:n], length[:n]
            to = self._moves.get((s * 512 + c).astype(np.uint64))
            todo = np.flatnonzero((to < 0) & (s > 0))
            while len(todo):
                s[todo] = self._np_link[s[todo]]
                m[todo] = self._np_size[s[todo]]
                to[todo] = self._moves.get((s[todo] * 512 + c[todo]).astype(np.uint64))
                todo = todo[(to[todo] < 0) & (s[todo] > 0)]
            m[:] = np.where(to > 0, m + 1, 0)
            s[:] = np.maximum(to, 0)
            at = np.where(m == self._np_size[s], s, np.maximum(self._np_link[s], 0))
            live = np.arange(n)
            while len(live):
                token, span, up = self._np_out[at[live]].T
                if (token < 0).any():
                    raise ValueError("a byte has no token of its own")
                begin = p + 1 - span
                ok = begin == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.fit_columns(last[begin[inner] - 1, live[inner]], token[inner])
                took = live[ok]
                last[p, took], back[p, took] = token[ok], begin[ok]
                at[live[~ok]] = up[~ok]
                live = live[~ok]
        ends = np.zeros((len(words), width), bool)
        row, i = np.arange(len(words)), long.copy()
        row, i = row[i > 0], i[i > 0]
        while len(row):
            ends[row, i - 1] = True
            i = back[i - 1, row].astype(np.int64)
            row, i = row[i > 0], i[i > 0]
        ids = self._np_ids[last.T[ends]].tobytes()
        to = np.cumsum(ends.sum(1)) * 4
        out: list[bytes] = [b""] * len(words)
        for k, a, b in zip(order.tolist(), [0, *to[:-1].tolist()], to.tolist()):
            out[k] = ids[a:b]
        return out

    def _pieces(self, text: str) -> list[bytes]:
        """Words of a text by the library, as the bytes they stand for."""
        return [bytes(map(self._chars.__getitem__, w)) for w, _ in self._split.pre_tokenize_str(self._normal.normalize_str(text))]

    def stretches(self, data: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of stretches without ASCII white space."""
        plain, parts = [], {}
        for x in data:
            if self._simple and (x.isascii() and b"<|" not in x or self._simple[0].fullmatch(x.decode("utf-8", "replace"))):
                plain.append(x)
            else:
                text = x.decode("utf-8", "replace")
                cut = self._special_re.split(text) if self._special_re else [text]
                parts[x] = [w for t in cut if t for w in ([self._special[t]] if t in self._special else self._pieces(t))]
        find = self._simple[1].findall if self._simple else None
        for x, t in zip(plain, b"\n".join(plain).decode().lower().split("\n")):
            parts[x] = [t.encode()] if t.isalpha() else [t[:-1].encode(), x[-1:]] if t[-1] in ".,!?:;" and t[:-1].isalpha() else [w.encode() for w in find(t)]
        words = set()
        for got in parts.values():
            words.update(got)
        words = {w for w in words if not isinstance(w, int)}
        short = [w for w in words if 0 < len(w) <= COLUMN_BYTES]
        ids: dict[bytes | int, bytes] = dict(zip(short, self.words(short)))
        for w in words:
            if len(w) > COLUMN_BYTES:
                ids[w] = struct.pack(f"<{len(got := self.word(''.join(map(self._bytes.__getitem__, w))))}I", *got)
        ids |= {i: struct.pack("<I", i) for i in self._special.values()}
        return {x: ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p)) for x, p in parts.items()}

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each whole text in UTF-8, in order. Texts are held in groups of about GROUP_BYTES."""
        group: list[bytes] = []
        held = 0
        for x in texts:
            group.append(x)
            held += len(x)
            if held >= GROUP_BYTES:
                yield from self._encode_group(group)
                group, held = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[bytes]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects, none of them in a cycle
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        joined = b"\n".join([*texts, b""]) + bytes(32)
        raw = np.frombuffer(joined, np.uint8)
        inside = ~_SPACE[raw[:-32]]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        size = stop - start
        # Equal stretches by their bytes: up to 24 of them are three words, longer ones go to a dictionary.
        keys = np.empty((3, len(start)), np.uint64)
        eight = np.ndarray((len(raw) - 8,), "<u8", joined, strides=(1,))
        for k in range(3):
            left = np.clip(size - 8 * k, 0, 8).astype(np.int64)
            keys[k] = eight[np.minimum(start + 8 * k, len(raw) - 9)] & _FIRST[left]
        mixed = size.astype(np.uint64)
        for k in range(3):
            mixed = (mixed ^ keys[k]) * HashTable.MIX
            mixed ^= mixed >> np.uint64(29)
        long = np.flatnonzero(size > 24)
        names: dict[bytes, int] = {}
        mixed[long] = [names.setdefault(joined[start[i] : stop[i]], len(names)) for i in long]
        _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
        if (size[first][which] != size).any() or any((keys[k][first][which] != keys[k]).any() for k in range(3)) or len(long) and (size[first] > 24).sum() != len(names):
            which = np.fromiter((names.setdefault(joined[i:j], len(names)) for i, j in zip(start, stop)), np.int64, len(start))  # two stretches with one hash
            _, first = np.unique(which, return_index=True)
        unique = [joined[i:j] for i, j in zip(start[first].tolist(), stop[first].tolist())]
        memo = self._memo
        fresh = [x for x in dict.fromkeys(unique) if x not in memo]
        if len(memo) + len(fresh) > MEMO_ENTRIES and memo:
            memo.clear()
            fresh = unique
        memo |= self.stretches(fresh)
        found = [memo[x] for x in unique]
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        else:
            for x in fresh:
                if len(x) > MEMO_BYTES:
                    memo.pop(x, None)
        ids, counts = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, many = (np.cumsum(counts) - counts)[which], counts[which]
        ends = np.cumsum(many)
        out = ids[np.repeat(begins - (ends - many), many) + np.arange(int(many.sum()))].tobytes()
        to = np.concatenate([[0], ends])[np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts]))] * 4 if texts else []
        return [out[i:j] for i, j in zip([0, *to[:-1]], to)] if texts else []

    def encode(self, data: bytes) -> bytes:
        return next(self.encode_all([data]))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: without a decoder, a space stands between the tokens' own strings."""
        return b" ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


def _trim() -> None:
    """Freed memory back to the machine, where the C library can do that."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@lru_cache(maxsize=1)
def encoder(path: str) -> PrefixBpe:
    """One per worker process."""
    made = PrefixBpe(path)
    _trim()
    return made


@contextlib.contextmanager
def in_task(path: str) -> Iterator[PrefixBpe]:
    """The worker's encoder; what it remembers ends with the task, as the worker may go on to other work."""
    bpe = encoder(path)
    try:
        yield bpe
    finally:
        bpe._memo.clear()
        _trim()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _each(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The texts of a batch, one at a time."""
    return (x.as_py() for x in batch.column(1))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text as bytes, null texts empty; no other column goes to Python."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(path) as bpe:
            for b in batches:
                ids = [np.frombuffer(x, "<u4").astype("i4") for x in bpe.encode_all(_each(b))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.empty(0, "i4")]))], ["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the string of each id list; null lists decode as empty ones."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(path) as bpe:
            for b in batches:
                out = [bpe.decode(np.asarray(x, "<u4").tobytes()).decode() for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of its ids, and SHA-256 of the ids and of the text decoded from them."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(path) as bpe:
            for b in batches:
                n, a, c = [], [], []
                for ids in bpe.encode_all(_each(b)):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    c.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens: the encoded length of each whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(path) as bpe:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in bpe.encode_all(_each(b))], pa.int64())], ["doc_id", "n_tokens"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def pieces(docs: DataFrame, capacity: int, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids and then ``end_id``, cut every ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    path, tail = path or default_path(), struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(path) as bpe:
            for b in batches:
                rows = []
                for d, x in zip(b.column(0).to_pylist(), bpe.encode_all(_each(b))):
                    ids = x + tail
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        rows.append((d, k, s // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
