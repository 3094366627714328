"""BPE encoding and decoding by dynamic programming over prefixes.

A generalised suffix automaton of all vocabulary strings is walked along a word; its state gives the tokens that
end at each place. For every prefix exactly one token can be the last of its encoding: the longest that is
compatible with the last token of the prefix before it. Two tokens are compatible if encoding their joined
strings gives them back. Following the back-pointers from the end gives the ids.

The driver builds the automaton and the tables of merges once, as flat arrays. A worker takes the new words of a
batch together, and walks all of them one symbol a step.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import add_columns

#: Words that a worker keeps from one batch to the next; it steers only speed.
CACHE = 200_000
#: Longer pieces are walked alone.
LONG_PIECE = 96
#: Characters of texts that are split at a time, and words whose prefixes are walked together.
CHUNK, TOGETHER = 1_000_000, 16_384
#: Pairs of tokens whose compatibility is kept.
PAIRS = 1 << 17
#: Below this code point, where Unicode versions agree, words are split with Python's expressions.
PLAIN = 0x0240
PLAIN_END = chr(PLAIN)
_BYTES_AS_IS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_NEVER = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to the byte."""
    rest = [b for b in range(256) if b not in set(_BYTES_AS_IS)]
    return {chr(b): b for b in _BYTES_AS_IS} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """All substrings of the given strings; ``whole`` gives by state the strings that are its substrings."""

    def __init__(self, strings: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in strings:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for s, i in strings.items():
            v = 0
            for c in s:
                v = self.next[v][c]
            self.whole.setdefault(v, []).append((len(s), i))

    def _new(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur


class Table:
    """Non-negative numbers by non-negative 64-bit key, with open addressing in flat arrays; -1 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._spot(keys)
        while len(left):
            free = self.keys[at[left]] < 0
            first = np.unique(at[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._spot(keys)
        there = self.keys[at]
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            left = left[(there != keys[left]) & (there >= 0)]
        return np.where(self.keys[at] == keys, self.values[at], -1)


@dataclass
class Tables:
    """What encoding needs of a vocabulary; made once at the driver and broadcast, a few MB."""

    spec: str
    #: Automaton: next state by state * 512 + symbol; suffix link and length by state; first end by state.
    go: Table
    link: np.ndarray
    length: np.ndarray
    head: np.ndarray
    #: Ends, longest first: size and token of each, and the next shorter one or -1.
    size: np.ndarray
    token: np.ndarray
    shorter: np.ndarray
    #: Merges: rank by left * 65536 + right; rank and parts of the merge that made a token (-1 for symbols).
    rank: Table
    made: np.ndarray
    left: np.ndarray
    right: np.ndarray
    #: Whether a token's own string is encoded as that token.
    whole: np.ndarray
    #: Strings by id for decoding, special tokens, the splitting pattern.
    strings: list[str]
    special: dict[str, int]
    pattern: str
    plain_pattern: str = field(default="")


def _merged(s: str, vocab: dict[str, int], rank: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Encode by applying merges, lowest rank and leftmost first; for short strings."""
    ids = [vocab[c] for c in s]
    while len(ids) > 1:
        best, i = min((rank.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
        if best[0] == 1 << 60:
            break
        ids[i : i + 2] = [best[1]]
    return ids


def build(path: str) -> Tables:
    """The tables of a byte-level BPE vocabulary whose words end in a suffix symbol, from a tokenizer's JSON file.

    Symbols are characters 0 to 255 for bytes, 256 more for a word's last byte.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    of = byte_symbols()

    def symbols(s: str) -> str:
        closed = s.endswith(end) and len(s) > len(end)
        b = [of[c] for c in (s[: -len(end)] if closed else s)]
        return "".join(map(chr, b[:-1])) + chr(b[-1] + 256 * closed)

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = [""] * (max([*model["vocab"].values(), *special.values()]) + 1)
    for s, i in [*model["vocab"].items(), *special.items()]:
        strings[i] = s
    ids = {s: i for s, i in model["vocab"].items() if s not in special}
    vocab = {symbols(s): i for s, i in ids.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)}
    made, left, right = (np.full(len(strings), -1, np.int32) for _ in range(3))
    for (a, b), (r, out) in rank.items():
        made[out], left[out], right[out] = r, a, b
    sa = SuffixAutomaton(vocab)
    moves = np.array([(v << 9 | ord(c), to) for v, m in enumerate(sa.next) for c, to in m.items()], np.int64)
    size, token, shorter = np.zeros(len(vocab), np.int32), np.zeros(len(vocab), np.int32), np.full(len(vocab), -1, np.int32)
    head, n = np.full(len(sa.next), -1, np.int32), 0
    for v in sorted(range(len(sa.next)), key=sa.length.__getitem__):  # a link leads to a state of less length
        below = head[sa.link[v]] if v else -1
        for k, i in sorted(sa.whole.get(v, ())):
            size[n], token[n], shorter[n] = k, i, below
            below, n = n, n + 1
        head[v] = below
    whole = np.zeros(len(strings), bool)
    for s, i in vocab.items():
        whole[i] = made[i] < 0 or _merged(s, vocab, rank) == [i]
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    letters, numbers = ("".join(re.escape(chr(i)) for i in range(PLAIN) if unicodedata.category(chr(i))[0] == k) for k in "LN")
    plain = pattern.replace("[\\p{L}]", f"[{letters}]").replace("\\p{L}", letters).replace("[\\p{N}]", f"[{numbers}]").replace("\\p{N}", numbers)
    pairs = np.array([a << 16 | b for a, b in rank], np.int64)
    return Tables(text, Table(moves[:, 0], moves[:, 1]), np.array(sa.link, np.int32), np.array(sa.length, np.int32), head, size, token, shorter, Table(pairs, np.array([r for r, _ in rank.values()], np.int32)), made, left, right, whole, strings, special, pattern, plain)


class WordBpe:
    """Encoding and decoding with the tables of a vocabulary."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.plain_split = re.compile(tables.plain_pattern).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, tables.special)) + ")").split if tables.special else None
        self.table = np.array(tables.strings, object)
        self._library: Tokenizer | None = None
        self.words: dict[str, bytes] = {}
        #: Words of chunks since words were last dropped, and those of more than one.
        self.once: set = set()
        self.twice: set = set()
        self.moves: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    @property
    def library(self) -> Tokenizer:
        if self._library is None:
            self._library = Tokenizer.from_str(self.t.spec)
        return self._library

    def _undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings of ``a`` and ``b``, joined, are encoded as these two tokens, by pair.

        They are unless some merge across the boundary would have come first. Undo the merges that made the
        two tokens, latest first: at each moment the tokens x and y meet at the boundary, until x joins its
        left neighbour (in merge ``x_until``) and y its right one (``y_until``). Of equal merges the left goes first.
        """
        t, out = self.t, np.ones(len(a), bool)
        x, y, at = a.copy(), b.copy(), np.arange(len(a))
        x_until, y_until = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(at):
            r = t.rank(x.astype(np.int64) << 16 | y)
            clash = (r >= 0) & (r < x_until) & (r <= y_until)
            out[at[clash]] = False
            made_x, made_y = t.made[x], t.made[y]
            turn_x = (made_x >= 0) & (made_x > made_y)
            turn_y = ~turn_x & (made_y >= 0)
            x_until, y_until = np.where(turn_x, made_x, x_until), np.where(turn_y, made_y, y_until)
            x, y = np.where(turn_x, t.right[x], x), np.where(turn_y, t.left[y], y)
            go = ~clash & (turn_x | turn_y)
            at, x, y, x_until, y_until = at[go], x[go], y[go], x_until[go], y_until[go]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_undone`` by pair, with a table of pairs that came before; a new pair takes an old one's place."""
        keys = a.astype(np.int64) << 16 | b
        spot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (PAIRS - 1)
        out = self.pair_fits[spot]
        new = np.flatnonzero(self.pair_keys[spot] != keys)
        if len(new):
            different, back = np.unique(keys[new], return_inverse=True)
            fits = self._undone((different >> 16).astype(np.int32), (different & 65535).astype(np.int32))
            out[new] = fits[back]
            self.pair_keys[spot[new]], self.pair_fits[spot[new]] = keys[new], out[new]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian) of words without their suffix, by the unique last token of every prefix."""
        out = self._in_step([p if len(p) <= LONG_PIECE else b"" for p in pieces])
        for i, p in enumerate(pieces):
            if len(p) > LONG_PIECE:
                out[i] = self._alone(p)
        return out

    def _alone(self, piece: bytes) -> bytes:
        """As ``_in_step``, for one long piece."""
        t, moves, pairs, v, long = self.t, self.moves, self.pairs, 0, 0
        last, back = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        if len(moves) + len(pairs) > CACHE:
            moves.clear()
            pairs.clear()

        def step(v: int, c: int) -> int:
            to = moves.get(v << 9 | c)
            if to is None:
                to = moves[v << 9 | c] = int(t.go(np.array([v << 9 | c]))[0])
            return to

        def fits(a: int, b: int) -> bool:
            out = pairs.get(a << 16 | b)
            if out is None:
                out = pairs[a << 16 | b] = bool(self._undone(np.array([a], np.int32), np.array([b], np.int32))[0])
            return out

        for i, c in enumerate(piece, 1):
            c += 256 * (i == len(piece))
            while (to := step(v, c)) < 0:
                v = int(t.link[v])
                long = int(t.length[v])
            v, long = to, long + 1
            end = t.head[v]
            while True:
                size, token = int(t.size[end]), int(t.token[end])
                if size <= long and (fits(last[i - size], token) if size < i else t.whole[token]):
                    break
                end = t.shorter[end]
            last[i], back[i] = token, i - size
        ids, i = [], len(piece)
        while i:
            ids.append(last[i])
            i = back[i]
        return np.array(ids[::-1], "<u4").tobytes()

    def _in_step(self, pieces: list[bytes]) -> list[bytes]:
        """All words together, one symbol a step."""
        t, n = self.t, np.array([len(p) for p in pieces])
        order = np.argsort(-n, kind="stable")
        sizes, longest = n[order], int(n.max(initial=0))
        data = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8)
        begin = np.cumsum(sizes) - sizes
        busy = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest + 1), "left")  # words of at least so many symbols
        # Prefixes of all words in a row, word by word: its symbols, last token and where that begins.
        last, back = np.full(len(data), -1, np.int32), np.zeros(len(data), np.int32)
        state, long = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32)
        for i in range(1, longest + 1):
            m = busy[i]
            at = begin[:m] + i - 1
            c = data[at].astype(np.int64) + 256 * (sizes[:m] == i)
            v, k = state[:m], long[:m]
            to = t.go(v << 9 | c)
            lost = np.flatnonzero(to < 0)
            while len(lost):
                v[lost] = t.link[v[lost]]
                k[lost] = t.length[v[lost]]
                to[lost] = t.go(v[lost] << 9 | c[lost])
                lost = lost[to[lost] < 0]
            state[:m], long[:m] = to, k + 1
            some, end = np.arange(m), t.head[to]
            while len(some):
                size = t.size[end]
                fits = size <= long[some]
                inner = np.flatnonzero(fits & (size < i))
                outer = np.flatnonzero(fits & (size == i))
                fits[inner] = self.compatible(last[at[some[inner]] - size[inner]], t.token[end[inner]])
                fits[outer] = t.whole[t.token[end[outer]]]
                hit = some[fits]
                last[at[hit]], back[at[hit]] = t.token[end[fits]], i - size[fits]
                some, end = some[~fits], t.shorter[end[~fits]]
        # From the ends back; the ids of a word stand at its end, in order.
        ids, count = np.zeros(len(data), "<u4"), np.zeros(len(sizes), np.int64)
        place, some = sizes.copy(), np.flatnonzero(sizes > 0)
        while len(some):
            at = begin[some] + place[some] - 1
            count[some] += 1
            ids[begin[some] + sizes[some] - count[some]] = last[at]
            place[some] = back[at]
            some = some[place[some] > 0]
        raw, out = ids.tobytes(), [b""] * len(pieces)
        for i, stop, k in zip(order.tolist(), (begin + sizes).tolist(), count.tolist(), strict=True):
            out[i] = raw[4 * (stop - k) : 4 * stop]
        return out

    def _pieces(self, word: str) -> list[str]:
        lowered = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
        if max(lowered) < PLAIN_END and "Σ" not in word and not _ODD(word):
            return [lowered] if lowered.isalpha() else self.plain_split(lowered)
        # Which characters are letters differs between Unicode versions: the library's own normalising and splitting.
        lowered = self.library.normalizer.normalize_str(word)
        return [lowered[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(lowered)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words, ``TOGETHER`` at a time."""
        got: dict[str, bytes] = {}
        for i in range(0, len(words), TOGETHER):
            split = [self._pieces(w) for w in words[i : i + TOGETHER]]
            spots = {p: k for k, p in enumerate(dict.fromkeys(p for x in split for p in x))}
            ids = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in spots])
            for w, x in zip(words[i : i + TOGETHER], split, strict=True):
                got[w] = ids[spots[x[0]]] if len(x) == 1 else b"".join([ids[spots[p]] for p in x])
        return got

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, i, size = [], 0, 0
        for j, t in enumerate(texts):
            size += len(t or "")
            if size >= CHUNK or j == len(texts) - 1:
                out += self._encode(texts[i : j + 1])
                i, size = j + 1, 0
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        special = [self._has_special(t) for t in texts]
        parts = [self._parts(t) if x else split_spaces(t) if t else [] for t, x in zip(texts, special, strict=True)]
        words = set().union(*parts)
        here = words.difference(self.words)
        known = self.words
        known.update(self._learn([w for w in here if isinstance(w, str)]))
        known.update((w, w) for w in here if not isinstance(w, str))  # ids of special tokens
        out = [b"".join(map(known.__getitem__, x)) for x in parts]
        self.twice |= self.once & words
        self.once |= words
        if len(known) > CACHE:
            stay = self.twice if len(self.twice) < CACHE // 2 else words
            self.words = {w: known[w] for w in stay if w in known}
            self.once, self.twice = set(self.words), set()
        return out

    def _has_special(self, text: str | None) -> bool:
        return bool(text and self.at_special and any(s in text for s in self.t.special))

    def _parts(self, text: str) -> list:
        """Words of a text with special tokens, and the ids of these."""
        return [y for x in self.at_special(text) for y in ([self.t.special[x].to_bytes(4, "little")] if x in self.t.special else split_spaces(x))]

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids, special tokens included: the vocabulary's strings between spaces."""
        return " ".join(self.table[np.frombuffer(ids, "<u4")])


_SEPARATORS = regex.compile(r"[\t-\r \x85\xa0  -     　]+").split
_ODD = regex.compile(r"[\x1c-\x1f]").search


def split_spaces(text: str) -> list[str]:
    """Words between Unicode white space; unlike str.split, U+001C to U+001F are not white space."""
    return [w for w in _SEPARATORS(text) if w] if _ODD(text) else text.split()


def bpe(df: DataFrame, tokenizer: str, text: str = "text", ids: bool = True, decoded: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Every row with ``n_tokens``, ``ids_le`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    A null text counts as empty: no ids and an empty decoded text. Special tokens in a text are recognised.
    Very long words take linear time. Repeated rows are encoded each; an empty table gives no rows. Other columns
    stay, or only those of ``keep``; one that has the name of an added column is replaced. ``tokenizer`` is a path that
    the driver can read. With ``ids`` or ``decoded`` false, that column is left out.
    """
    adds = "n_tokens bigint" + ", ids_le binary" * ids + ", decoded string" * decoded
    tables = df.sparkSession.sparkContext.broadcast(build(tokenizer))

    def make():
        model = WordBpe(tables.value)

        def f(texts):
            got = model.encode(texts)
            out = [[len(x) // 4 for x in got]]
            return out + ([got] if ids else []) + ([[model.decode(x) for x in got]] if decoded else [])

        return f

    return add_columns(df, [text], adds, make, keep)
