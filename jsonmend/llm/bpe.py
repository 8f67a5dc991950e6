"""Operator 8, BPE encoding and decoding by a tokenization automaton.

The merge list is compiled, merge by merge, into a deterministic automaton over
tokens that accepts exactly the token sequences BPE produces.  It starts as one
state with a loop per base symbol.  The gadget of merge number ``r``, (u, v) ->
w, splits the state that u's arcs enter: from now on u enters a copy without the
arc v (and without the arcs that merges build from that v later on), while w
enters the state that v's arcs enter.  All arcs with one label enter one state.

Arcs are held as ranges.  Tokens are numbered in preorder of the tree in which w
hangs below u, later merges first: then what a gadget takes away is one range,
v and the tokens that begin with it and are made no earlier than ``r``.  After the
last gadget the missing ranges of every state that is still entered cut the
tokens into symbol classes, and the automaton becomes a table: one bit for a
state and a symbol class, one next state for a token.  For 48,894 merges that
are 11,612 states and some 16,400 classes, 24 MB a worker process.

Words are read a batch at a time, all words of a batch position by position.  For
each prefix exactly one accepting path spells it, so the reader keeps that
path's last arc; the arc for the next position is the one that ends there and
that the table allows after the path it extends.  Arcs that end at a position
are found by walking a reversed trie of their labels.  Decoding emits the labels
of the arcs.

Runs between spaces are remembered in a bounded table, so a frequent one costs a
lookup; of the others each distinct word of a batch is read once.  The vocabulary
file is a parameter; the driver reads and compiles it once and ships the
automaton, so executors need no copy of the file.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonmend.llm.common import read_table, release, small_batches, text_slices

#: Runs remembered before the table is emptied (a memory bound only).
TABLE_ENTRIES = 100_000
#: Characters of text in a batch, and cells (words times the longest word's letters) read at once.
BATCH_CHARS, CELLS = 2_000_000, 500_000
#: Longer words are read one by one.
LONG_WORD = 64


# What the tokenizers library knows of Unicode 16 and 17 and Python's tables may not.
#: First and last code point of letters and of numbers new in Unicode 16.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Lower case of capitals new in Unicode 16 and 17.
NEW_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def _kind(c: str) -> str:
    """A stand-in of the same class for a code point that Python's tables do not know: letter, number or neither."""
    within = lambda ranges: any(a <= ord(c) <= b for a, b in ranges)
    return "a" if within(NEW_LETTERS) else "0" if within(NEW_NUMBERS) else "!"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class TokenizationAutomaton:
    """The token automaton of a merge list, and its reader; see the module's text.

    A word's last letter carries ``end``.  Letters that the vocabulary lacks are
    left out.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.labels = {i: t for t, i in vocab.items()}
        cut = len(end)
        letters = sorted({t for t in vocab if len(t) == 1} | {t[:1] for t in vocab if cut and len(t) == 1 + cut and t.endswith(end)})
        self.letters = {c: k for k, c in enumerate(letters)}
        #: Symbol of a letter inside a word and at its end; -1 where the vocabulary has none.
        self.inside = np.array([2 * k if c in vocab else -1 for c, k in self.letters.items()], dtype=np.int32)
        self.final = np.array([2 * k + (cut > 0) if c + end in vocab else -1 for c, k in self.letters.items()], dtype=np.int32)
        triples = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        base = {vocab[t]: [s] for c, k in self.letters.items() for t, s in ((c, 2 * k), (c + end, 2 * k + (cut > 0))) if t in vocab}
        self._compile(base, triples)

    def _compile(self, base: dict[int, list[int]], triples: list[tuple[int, int, int]]) -> None:
        """Run the gadgets over ``base`` (symbols of the base tokens), then lay out table and trie."""
        spelled, made, banned, gadgets = dict(base), {}, {}, []
        for rank, (u, v, w) in enumerate(triples):
            if u not in spelled or v not in spelled:
                continue  # built from a token that no text reaches
            live = self._follows(made, banned, u, v)
            banned.setdefault((u, v), rank)
            gadgets.append((rank, u, v, w if live and w not in spelled else None))
            if live and w not in spelled:
                made[w] = (u, v, rank)
                spelled[w] = spelled[u] + spelled[v]
        place, end, kids = self._preorder(spelled, made)
        # the gadgets: states are versions, each its parent less one range of arcs
        entered, above, low, high = dict.fromkeys(spelled, 0), [-1], [0], [0]
        for rank, u, v, w in gadgets:
            if w is not None:
                entered[w] = entered[v]
            own = kids.get(v, ())
            k = bisect_left(own, (rank, -1))
            above.append(entered[u])
            low.append(place[v])
            high.append(end[own[k][1]] if k < len(own) else place[v] + 1)
            entered[u] = len(above) - 1
        self._lay_out(spelled, place, entered, above, low, high)
        self._trie(spelled)

    @staticmethod
    def _follows(made: dict, banned: dict, x: int, y: int) -> bool:
        """Whether y may follow x after the gadgets so far: none acted while its two tokens touched, both whole."""
        a, whole_a = x, 1 << 62
        while True:
            b, whole_b = y, 1 << 62
            while True:
                rank = banned.get((a, b))
                if rank is not None and rank < whole_a and rank <= whole_b:
                    return False
                if b not in made:
                    break
                b, _, whole_b = made[b]
            if a not in made:
                return True
            _, a, whole_a = made[a]

    @staticmethod
    def _preorder(spelled: dict, made: dict) -> tuple[dict, dict, dict]:
        """Place and end of each token in preorder, and its (rank, token) children by rank; later children come first."""
        kids: dict[int, list] = {}
        for w, (u, _, rank) in made.items():
            kids.setdefault(u, []).append((rank, w))
        place, end, at = {}, {}, 0
        for root in spelled:
            stack = [(root, False)] if root not in made else []
            while stack:
                t, done = stack.pop()
                if done:
                    end[t] = at
                    continue
                place[t] = at
                at += 1
                stack.append((t, True))
                stack += [(w, False) for _, w in kids.get(t, ())]
        return place, end, kids

    def _lay_out(self, spelled: dict, place: dict, entered: dict, above: list, low: list, high: list) -> None:
        """``table``: a bit for each state and symbol class; ``state`` and ``klass`` of each token."""
        versions = sorted(set(entered.values()))
        rows, starts, ends = [], [], []
        for row, version in enumerate(versions):
            while version > 0:
                rows.append(row)
                starts.append(low[version])
                ends.append(high[version])
                version = above[version]
        rows, starts, ends = (np.array(x, dtype=np.int64) for x in (rows, starts, ends))
        edges = np.unique(np.concatenate([[0], starts, ends]))
        self.width = -(-len(edges) // 8)
        size = max(self.labels, default=-1) + 1
        self.state, self.klass = np.zeros(size, np.int32), np.zeros(size, np.int32)
        number = {v: k for k, v in enumerate(versions)}
        tokens = list(spelled)
        self.state[tokens] = [number[entered[t]] for t in tokens]
        self.klass[tokens] = np.searchsorted(edges, [place[t] for t in tokens], side="right") - 1
        starts, ends = np.searchsorted(edges, starts), np.searchsorted(edges, ends)
        self.table = np.empty((len(versions), self.width), np.uint8)
        for a in range(0, len(versions), 512):
            b = min(a + 512, len(versions))
            own = slice(*np.searchsorted(rows, [a, b]))
            steps = np.zeros((b - a, 8 * self.width + 1), np.int16)
            np.add.at(steps, (rows[own] - a, starts[own]), 1)
            np.add.at(steps, (rows[own] - a, ends[own]), -1)
            self.table[a:b] = np.packbits(np.cumsum(steps, axis=1)[:, :-1] == 0, axis=1, bitorder="little")
        self.table = self.table.reshape(-1)

    def _trie(self, spelled: dict) -> None:
        """The reversed trie of the tokens' symbols: sorted (node, symbol) keys and the child of each."""
        symbols = self.span = 2 * len(self.letters) + 2
        ends = sorted({spelling[-1] for spelling in spelled.values()})
        arcs = {c: k for k, c in enumerate(ends, 1)}  # children of the root, node 0, come first
        token = [-1] * (1 + len(ends))
        for t, spelling in spelled.items():
            node = 0
            for c in reversed(spelling):
                node = arcs.setdefault(node * symbols + c, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = t
        self.token, keys = np.array(token, dtype=np.int32), np.array([*arcs, 1 << 62], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array([*arcs.values(), 0], dtype=np.int32)[order]
        close = (1 + len(ends)) * symbols
        self.close = np.zeros(close, dtype=np.int32)  # the first two steps as a plain table; 0: no arc
        first = slice(0, np.searchsorted(self.keys, close))
        self.close[self.keys[first]] = self.child[first]

    def allowed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the states after the tokens x have arcs y."""
        k = self.klass[y]
        return (self.table[self.state[x].astype(np.int64) * self.width + (k >> 3)] >> (k & 7).astype(np.uint8)) & 1 > 0

    def symbols(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and sizes of words given as letter numbers, -1 for unknown letters; these are left out."""
        last = np.cumsum(sizes)[sizes > 0] - 1
        found = np.where(codes >= 0, self.inside[codes], -1)
        found[last] = np.where(codes[last] >= 0, self.final[codes[last]], -1)
        keep = found >= 0
        if not keep.all():
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
            found = found[keep]
        return found, sizes

    def encode(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words given as letter numbers and sizes."""
        found, sizes = self.symbols(codes, sizes)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        a, stop = 0, int((sizes > 0).sum())
        while a < stop:
            longest = int(sizes[order[a]])
            if longest > LONG_WORD:
                ids = self._read_long(found[begin[order[a]] : begin[order[a]] + longest])
                parts.append((np.full(len(ids), order[a]), np.array(ids, dtype=np.int32)))
                a += 1
                continue
            b = min(stop, a + max(1, CELLS // longest))
            rows, ids = self._read(found, begin[order[a:b]], sizes[order[a:b]])
            parts.append((order[a:b][rows], ids))
            a = b
        word, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts = np.bincount(word, minlength=len(sizes))
        return ids[np.argsort(word, kind="stable")], counts

    def _read(self, found: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) pairs, in order within a word, of words of descending sizes."""
        most = int(sizes[0])
        live = np.searchsorted(-sizes, -np.arange(most), side="left")  # words with a letter at each position
        grid = np.zeros((most, len(sizes)), np.int32)
        arc, source = np.zeros_like(grid), np.zeros_like(grid)
        for at in range(most):
            grid[at, : live[at]] = found[begin[: live[at]] + at]
            words, node = np.arange(live[at]), np.zeros(live[at], np.int32)
            for start in range(at, -1, -1):
                key = node.astype(np.int64) * self.span + grid[start, words]
                if start >= at - 1:
                    node = self.close[key]
                    goes = node > 0
                    words, node = words[goes], node[goes]
                else:
                    slot = np.searchsorted(self.keys, key)
                    goes = self.keys[slot] == key
                    words, node = words[goes], self.child[slot[goes]]
                if not len(words):
                    break
                token = self.token[node]
                ends = np.flatnonzero(token >= 0)
                if start:
                    ends = ends[self.allowed(arc[start - 1, words[ends]], token[ends])]
                arc[at, words[ends]], source[at, words[ends]] = token[ends], start
        words, ids = [], []
        own, at = np.arange(len(sizes)), sizes - 1
        while len(own):
            words.append(own)
            ids.append(arc[at, own])
            at = source[at, own] - 1
            own, at = own[at >= 0], at[at >= 0]
        words, ids = np.concatenate(words)[::-1], np.concatenate(ids)[::-1]
        by_word = np.argsort(words, kind="stable")
        return words[by_word], ids[by_word]

    def _read_long(self, symbols: np.ndarray) -> list[int]:
        """The ids of one word, read letter by letter over the same table."""
        keys, child, tokens, state, klass, table = (memoryview(x) for x in (self.keys, self.child, self.token, self.state, self.klass, self.table))
        letters = symbols.tolist()
        arc, source = [0] * len(letters), [0] * len(letters)
        for at in range(len(letters)):
            node = 0
            for start in range(at, -1, -1):
                key = node * self.span + letters[start]
                slot = bisect_left(keys, key)
                if keys[slot] != key:
                    break
                node = child[slot]
                token = tokens[node]
                if token >= 0 and (not start or table[state[arc[start - 1]] * self.width + (klass[token] >> 3)] >> (klass[token] & 7) & 1):
                    arc[at], source[at] = token, start
        ids, at = [], len(letters) - 1
        while at >= 0:
            ids.append(arc[at])
            at = source[at] - 1
        return ids[::-1]

    def encode_word(self, letters: str) -> list[int]:
        """Ids of one pre-split word given in vocabulary letters."""
        codes = np.array([self.letters.get(c, -1) for c in letters], dtype=np.int64)
        return self.encode(codes, np.array([len(codes)]))[0].tolist()

    def emit(self, ids: list[int]) -> list[str]:
        """The labels of the arcs."""
        return list(map(self.labels.__getitem__, ids))


def _pick(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``values`` at ``starts``, one after another, and their sizes."""
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return values[shift + np.arange(len(shift))], sizes


class Codec:
    """A tokenizer file's text rules around the automaton: specials, NFC, lower case, split, byte letters.

    Only what those rules cover is supported; any other file raises ValueError.
    """

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, steps, cuts = data["model"], (data["normalizer"] or {}).get("normalizers", []), (data["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("byte_fallback", "dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "ignore_merges"))
        if not plain or data.get("post_processor") or data.get("decoder"):
            raise ValueError("only plain BPE files without post-processor and decoder are supported")
        kinds = [s["type"] for s in steps]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"} or steps[1]["content"] != " ":
            raise ValueError("only the normalisers NFC, white space to one space and lower case, in this order, are supported")
        if [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            raise ValueError("only a split that keeps its matches, then byte letters, is supported")
        if any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip, normalise or ask for word limits are not supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = TokenizationAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.automaton.labels |= {i: t for t, i in self.specials.items()}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.opens = "".join({t[0] for t in self.specials})
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
        letters = self.automaton.letters
        self.byte_codes = np.array([letters.get(c, -1) for c in byte_letters()], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        """Empty the table of runs: where each stands in ``ids``."""
        self.place: dict[str | int, int] = {i: k for k, i in enumerate(self.specials.values())}
        self.ids, self.ends = np.array([*self.specials.values()], dtype=np.int32), np.arange(len(self.specials) + 1)

    def __getstate__(self):
        return self.__dict__ | {"special": self.special and self.special.pattern, "pattern": self.pattern.pattern, "place": None, "ids": None, "ends": None}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.pattern = regex.compile(self.pattern)
        self.special = self.special and regex.compile(self.special)
        self._forget()

    #: Spaces for str.split, not for the file's pattern.
    ODD_SPACES = "\x1c\x1d\x1e\x1f"

    def _runs(self, text: str) -> list[str]:
        """A text's runs between white space.

        White space only separates here, so the file's white-space replacement
        changes nothing, and a word never spans it.
        """
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if len(text.encode("latin-1", "ignore")) < len(text):
                text = text.translate(NEW_LOWER)
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        else:
            text = text.lower()
        return text.split() if not any(c in text for c in self.ODD_SPACES) else [text]

    def _words(self, runs: list[str]) -> list[list[str]]:
        """The words of each run."""
        find = self.pattern.findall
        letters = set().union(*runs)
        odd = {c for c in letters if not c.isascii() and unicodedata.category(c) == "Cn"}
        if not odd:
            return [[r] if r.isascii() and r.isalpha() else find(r) for r in runs]
        # the pattern library may class code points otherwise that its Unicode tables do not share
        shadow = str.maketrans({c: _kind(c) for c in odd})
        return [[r[m.start() : m.end()] for m in self.pattern.finditer(r.translate(shadow))] for r in runs]

    def _read(self, runs: list[str]) -> None:
        """Add runs to the table; each distinct word among them is read once."""
        split = self._words(runs)
        flat = list(chain.from_iterable(split))
        words = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        ids, counts = self.automaton.encode(self.byte_codes[np.frombuffer(b"".join(data), np.uint8)], np.fromiter(map(len, data), np.int64, len(data)))
        which = np.fromiter(map(words.__getitem__, flat), np.int64, len(flat))
        ends = np.append(0, np.cumsum(counts))
        more, sizes = _pick(ids, ends[which], counts[which])
        through = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split))))]
        self.place.update(zip(runs, range(len(self.ends) - 1, len(self.ends) - 1 + len(runs)), strict=True))
        self.ids, self.ends = np.concatenate([self.ids, more]), np.concatenate([self.ends, len(self.ids) + through[1:]])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, int32."""
        pieces: list[list[str | int]] = []
        for text in texts:
            if self.special is None or not any(c in text for c in self.opens):
                pieces.append(self._runs(text))
                continue
            start, own = 0, []
            for m in self.special.finditer(text):
                own += [*self._runs(text[start : m.start()]), self.specials[m.group()]]
                start = m.end()
            pieces.append(own + self._runs(text[start:]))
        if len(self.place) > TABLE_ENTRIES:
            self._forget()
        runs = list(chain.from_iterable(pieces))
        self._read(list(set(runs).difference(self.place)))
        at = np.fromiter(map(self.place.__getitem__, runs), np.int64, len(runs))
        ids, sizes = _pick(self.ids, self.ends[at], self.ends[at + 1] - self.ends[at])
        through = np.append(0, np.cumsum(sizes))[np.cumsum([len(own) for own in pieces])]
        return np.split(ids, through[:-1])

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.automaton.emit(ids))


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The compiled codec of a tokenizer file's contents."""
    return _once(hashlib.sha256(spec.encode()).hexdigest(), lambda: Codec(spec))


def _once(key: str, make) -> Codec:
    """One codec a process: that of ``key``, kept until another is asked for."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = make()
    return _CODECS[key]


#: What ``encode_documents`` can return beside the id.
OUTPUTS = {
    "token_ids": (pa.list_(pa.int32()), "array<int>", lambda ids, text: ids),
    "decoded": (pa.string(), "string", lambda ids, text: text),
    "n_tokens": (pa.int64(), "bigint", lambda ids, text: len(ids)),
    "ids_sha256": (pa.string(), "string", lambda ids, text: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()),
    "decoded_sha256": (pa.string(), "string", lambda ids, text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()),
}


def encode_documents(
    docs: DataFrame, tokenizer_file: str, outputs=("token_ids", "decoded"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: the id and the chosen ``OUTPUTS``.

    The ids are those of the tokenizer file without added special tokens; a
    special token's own string inside a text gives its id.  ``decoded`` joins
    the arc labels with spaces.  Null and empty texts have no ids and decode to
    the empty string; null ids and repeated rows pass through.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    key, packed = hashlib.sha256(spec.encode()).hexdigest(), pickle.dumps(codec(spec))
    shipped = docs.sparkSession.sparkContext.broadcast(zlib.compress(packed, 1))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    decode = any(o.startswith("decoded") for o in outputs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _once(key, lambda: pickle.loads(zlib.decompress(shipped.value)))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_slices(texts, BATCH_CHARS):
                rows = own.encode_batch(texts[a:b])
                spelled = [own.decode(ids.tolist()) if decode else None for ids in rows]
                columns = [pa.array([OUTPUTS[o][2](i, t) for i, t in zip(rows, spelled, strict=True)], OUTPUTS[o][0]) for o in outputs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["id", *outputs])
        release()

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(encode, ", ".join([f"id {kind}", *(f"{o} {OUTPUTS[o][1]}" for o in outputs)])).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    """The file of the lower-casing word-end vocabulary among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), default_tokenizer(), ("n_tokens", "ids_sha256", "decoded_sha256"))
