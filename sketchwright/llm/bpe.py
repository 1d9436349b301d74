"""BPE encoding and decoding by a deterministic automaton compiled from the merge list."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, plain_text

#: The public pre-split pattern of byte-level BPE, with Unicode's white space spelt out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: What SPLIT comes to on ASCII texts.
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Words kept in a worker's memory, and the longest one kept; states of the transducer kept (about 0.7 KB each).
CACHED_WORDS, CACHED_CHARS, KEPT_STATES = 200_000, 48, 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else the next free code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Automaton:
    """Accepts exactly the BPE tokenisations of byte strings, over the alphabet of tokens.

    It starts as one state with a loop for each byte. Each merge (u, v) -> w in turn adds a gadget: the
    state reached by u loses its arc v, and wherever u v could be read, an arc w leads to where v led,
    in the state of that moment. A state is named by the token that led to it, since an arc's target
    depends on its label only. States and arcs are kept as derivations, each naming the moment it was
    made and what it was copied from (after w: a copy of after v; arc w: made where arc u stood); the
    transition table holds each entry once it has been derived. Of all ways to spell a prefix exactly
    one is accepted.
    """

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: t for t, i in tokens.items()}
        self.made: dict[int, int] = {i: -1 for i in self.label}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for t, i in tokens.items():
            if len(t) > 1:
                self.made.pop(i)  # until a gadget makes its arcs
        for moment, (u, v) in enumerate(merges):
            self._gadget(moment, tokens[u], tokens[v], tokens[u + v])
        self.table: dict[int, bool] = {}  # by state << 32 | token

    def _gadget(self, moment: int, u: int, v: int, w: int) -> None:
        if u not in self.made or v not in self.made or not self._derive(u, v, moment):
            return  # nowhere can u v be read: earlier merges have taken its bytes
        self.cut[u, v] = moment
        if w not in self.left:  # a token that two merges make has been made by the first
            self.made[w], self.left[w], self.right[w] = moment, u, v

    def arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton reads token in the state after `state`."""
        known = self.table.get(state << 32 | token)
        if known is None:
            known = self.table[state << 32 | token] = self._derive(state, token, 1 << 60)
        return known

    def _derive(self, state: int, token: int, end: int) -> bool:
        """Whether the state after `state` has the arc `token` once the gadgets before moment `end` are in place."""
        made, cut = self.made, self.cut
        while True:
            if cut.get((state, token), end) < end:
                return False
            a, b = made[state], made[token]
            if a < 0 and b < 0:
                return True
            if a > b:  # the state was copied when its arc was there already
                state, end = self.right[state], a
            elif a == b:  # the same token twice: state and arc come from one gadget
                state, token, end = self.right[state], self.left[token], a
            else:  # the arc was made at moment b, where the arc of its left part stood, cut included
                token, end = self.left[token], b
                if cut.get((state, token), end + 1) == end:
                    return False


class Transducer:
    """Reads bytes, emits tokens: the automaton composed with the spelling of its tokens, made deterministic.

    An open piece is a state of the automaton and a node of the trie of its tokens: what was read since that
    state, and may yet become a token. A state of the transducer is the set of pieces open after a prefix, and a
    transition on a byte moves each piece along the trie. Where a piece spells a token that its automaton
    state has an arc for, that is the last token of the prefix: the transition's label. Such sets are numbered
    and transitions tabled when they first occur; past KEPT_STATES the table starts anew. So a byte costs one
    look-up, or at first sight a step for each open piece; and reading a word of any length is linear.

    A state's pieces are kept as one bytes object.
    """

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.next_node: dict[int, int] = {}
        self.spelt = [-1]
        for token, name in automaton.label.items():
            if token not in automaton.made:
                continue
            node = 0
            for byte in name:
                after = self.next_node.get(node << 8 | byte)
                if after is None:
                    after = self.next_node[node << 8 | byte] = len(self.spelt)
                    self.spelt.append(-1)
                node = after
            self.spelt[node] = token
        self.inner = {key >> 8 for key in self.next_node}
        self.length = {token: len(name) for token, name in automaton.label.items()}
        self.clear()

    def clear(self) -> None:
        self.table: dict[int, tuple[int, int]] = {}
        self.pieces: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.automaton.table.clear()
        self._numbered([0])  # nothing read: state 0, at the trie's root

    def _numbered(self, pieces: list[int]) -> int:
        packed = array("q", pieces).tobytes()
        n = self.number.get(packed)
        if n is None:
            n = self.number[packed] = len(self.pieces)
            self.pieces.append(packed)
        return n

    def _transition(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the last token of the prefix read. A piece is (token + 1) << 32 | node."""
        pieces, label = [], -1
        arc = self.automaton.arc
        for piece in array("q", self.pieces[state]):
            node = self.next_node.get((piece & 0xFFFFFFFF) << 8 | byte)
            if node is None:
                continue
            before, token = (piece >> 32) - 1, self.spelt[node]
            if token >= 0 and label < 0 and (before < 0 or arc(before, token)):
                label = token
            if node in self.inner:
                pieces.append(piece >> 32 << 32 | node)
        if label >= 0:
            pieces.append(label + 1 << 32)
        if len(self.pieces) >= KEPT_STATES:
            self.clear()
            return self._numbered(pieces), label  # not tabled: `state` has lost its number
        found = self.table[state << 8 | byte] = self._numbered(pieces), label
        return found

    def encode(self, word: bytes) -> list[int]:
        """The accepted path that spells word, from the labels of its prefixes."""
        state, labels = 0, []
        for byte in word:
            found = self.table.get(state << 8 | byte)
            state, label = found or self._transition(state, byte)
            labels.append(label)
        out, i, length = [], len(word), self.length
        while i:
            token = labels[i - 1]
            out.append(token)
            i -= length[token]
        return out[::-1]


class _Words(dict):
    """The ids of words seen, encoded when first asked for. When half full it is put aside, and what is asked for again comes back; so its size is bounded."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.aside: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.aside.get(word)
        if ids is None:
            ids = tuple(self.transducer.encode(word.encode("utf-8")))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS // 2:
                self.aside = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Whole texts to ids and back, as a byte-level tokenizer file says; it takes the file's content."""

    def __init__(self, content: str):
        import regex

        spec = json.loads(content)
        alphabet = byte_alphabet()

        def raw(t: str) -> bytes:
            return bytes(alphabet[c] for c in t)

        model = spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.automaton = Automaton(tokens, [(raw(a), raw(b)) for a, b in pairs])
        labels = dict(self.automaton.label) | {i: t.encode() for t, i in self.special.items()}
        self.label = [labels.get(i, b"") for i in range(max(labels) + 1)]
        self.split, self.ascii_split = regex.compile(SPLIT).findall, re.compile(ASCII_SPLIT).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split
        self.known = _Words(Transducer(self.automaton))

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            out: list[int] = []
            for piece in self.cut(text):
                out += [self.special[piece]] if piece in self.special else self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        words = (self.ascii_split if text.isascii() else self.split)(text)
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def forget(self) -> None:
        """Drops the words and the transducer's states, which come again as they occur. The compiled automaton stays."""
        self.known.clear()
        self.known.aside = {}
        self.known.transducer.clear()

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec_of(content: str) -> Codec:
    """One codec for each worker process and file content."""
    name = hashlib.md5(content.encode()).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(content)
    return _codecs[name]


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, forget: bool = False) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids array<int>; a row per row of docs.

    path: a byte-level BPE file on the driver; its content (a fixed file of a few MB) is broadcast.
    Null text counts as empty: no ids. Each text is encoded whole, and decoded again from its ids. Repeated
    rows stay rows, empty docs give none; columns outside `keep` are not read. forget: each task drops its words and
    states when it ends, so workers that go on to serve other stages don't hold them; without it the next task finds them.
    """
    (held_text,) = fresh(docs, "text")
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    slim = docs.select(*keep, plain_text(F.col(text)).alias(held_text))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    fields = (kept + ", " if keep else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(content.value)
        try:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    counts, digests, decoded, held = [], [], [], []
                    for t in part.column(part.num_columns - 1):
                        ids = codec.encode(t.as_py())
                        words = np.array(ids, dtype="<u4")
                        counts.append(len(ids))
                        digests.append(hashlib.sha256(words.tobytes()).hexdigest())
                        decoded.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
                        if with_ids:
                            held.append(words.astype(np.int32))
                    columns = [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                    if with_ids:
                        columns.append(pa.array(held, pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        finally:
            if forget:
                codec.forget()

    return slim.mapInArrow(run, fields)
