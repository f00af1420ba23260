"""Byte-pair encoding by a dynamic program over prefixes, and decoding.

In the byte-pair encoding of a string every prefix has exactly one last token:
the token ending there that is compatible with the last token of what precedes
it. So a left-to-right pass that stores that token for every prefix, and a walk
along the back-pointers, give the same ids as applying merges in rank order,
in time linear in the text.

* Which tokens end at a position comes from one suffix automaton of the whole
  vocabulary: its state is the longest substring of any token that ends here,
  and its suffix links lead through all shorter ones, those that are whole
  tokens marked.
* Two tokens are compatible if no merge across their boundary would have come
  before the merges that built them.

Words repeat, so a worker keeps the result of the words it has met, in a store
of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.common import rows_of, worker_memo

# Words kept per worker in each of two stores; a full one becomes the older, which is then dropped.
WORDS_KEPT = 150_000
PAIRS_KEPT = 500_000
LONGEST_KEPT = 64


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class SuffixAutomaton:
    """A generalized suffix automaton over symbol tuples, its edges in one flat dictionary."""

    def __init__(self, alphabet: int) -> None:
        self.alphabet = alphabet
        self.edges: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self._out: list[list[int]] = [[]]

    def _state(self, length: int, link: int, copied: int = -1) -> int:
        s = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self._out.append([])
        if copied >= 0:
            for c in self._out[copied]:
                self.edges[s * self.alphabet + c] = self.edges[copied * self.alphabet + c]
            self._out[s] = list(self._out[copied])
        return s

    def _clone(self, p: int, q: int, c: int) -> int:
        a, edges = self.alphabet, self.edges
        twin = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = twin
        while p >= 0 and edges.get(p * a + c) == q:
            edges[p * a + c] = twin
            p = self.link[p]
        return twin

    def add(self, symbols: list[int]) -> int:
        """Adds a string; returns the state of the whole string."""
        a, edges, last = self.alphabet, self.edges, 0
        for c in symbols:
            q = edges.get(last * a + c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
                continue
            new, p = self._state(self.length[last] + 1, 0), last
            while p >= 0 and (p * a + c) not in edges:
                edges[p * a + c] = new
                self._out[p].append(c)
                p = self.link[p]
            if p >= 0:
                q = edges[p * a + c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
            last = new
        return last

    def find(self, symbols: list[int]) -> int:
        s = 0
        for c in symbols:
            s = self.edges[s * self.alphabet + c]
        return s

    def close(self) -> SuffixAutomaton:
        self._out = []
        return self


class PrefixEncoder:
    """Encodes one word at a time with a word-end vocabulary in the tokenizers library's JSON format."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.bytes = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left id, right id) -> rank, and per made token its parts and its rank; single symbols have rank -1.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (x, y) in enumerate(merges):
            left, right, whole = self.vocab[x], self.vocab[y], self.vocab[x + y]
            self.rank[left, right] = r
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (left, right), r
        self.symbol = {s: i for i, s in enumerate(self.bytes)} | {s + self.end: 256 + i for i, s in enumerate(self.bytes)}
        self.automaton, sizes = SuffixAutomaton(512), {}
        strings = {t: self._symbols(s) for s, t in self.vocab.items() if t in self.parts or s in self.symbol}
        for t, symbols in strings.items():
            self.automaton.add(symbols)
            sizes[t] = len(symbols)
        self.sizes = sizes
        #: Words that are one token.
        self.whole = {bytes(x % 256 for x in symbols): t for t, symbols in strings.items() if symbols[-1] >= 256 or not self.end}
        #: Per state the token that it is, or -1; and the nearest state along the links, itself included, that is one.
        states = len(self.automaton.length)
        self.token = array("i", [-1]) * states
        for t, symbols in strings.items():
            self.token[self.automaton.find(symbols)] = t
        self.nearest = array("i", [0]) * states
        for s in sorted(range(1, states), key=self.automaton.length.__getitem__):
            self.nearest[s] = s if self._whole(s) else self.nearest[self.automaton.link[s]]
        self.automaton.close()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _whole(self, state: int) -> bool:
        t = self.token[state]
        return t >= 0 and self.sizes[t] == self.automaton.length[state]

    def _symbols(self, token: str) -> list[int]:
        body = token[: -len(self.end)] if self.end and token.endswith(self.end) and token != self.end else token
        out = [self.symbol[c] for c in body]
        if body is not token:
            out[-1] += 256
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' joined text gives just these two tokens.

        The right edge of ``left`` and the left edge of ``right`` each grew
        step by step. Walk back through the pairs that stood next to each
        other: one of them merging before either was built further would have
        destroyed the boundary. Of equal ranks the merge further left is first.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, before_a, before_b, fits = left, right, len(self.rank) + 1, len(self.rank) + 1, True
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < before_a and r <= before_b:
                fits = False
                break
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                break
            if made_a > made_b:
                before_a, a = made_a, self.parts[a][1]
            else:
                before_b, b = made_b, self.parts[b][0]
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[left, right] = fits
        return fits

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-tokenized word."""
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        symbols = list(word)
        symbols[-1] += 256 if self.end else 0
        n, a = len(symbols), self.automaton
        edges, link, nearest, token, length = a.edges, a.link, self.nearest, self.token, a.length
        last, back = [-1] * (n + 1), [0] * (n + 1)
        state = matched = 0
        for i, c in enumerate(symbols, 1):
            while state > 0 and (state * 512 + c) not in edges:
                state = link[state]
                matched = length[state]
            state = edges.get(state * 512 + c, 0)
            matched = matched + 1 if state else 0
            # A state also holds suffixes of its longest string; what matched may be such a suffix.
            s = nearest[state if length[state] == matched else link[state]] if state else 0
            while s > 0:
                t, start = token[s], i - length[s]
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], t)):
                    last[i], back[i] = t, start
                    break
                s = nearest[link[s]]
        ids, i = [], n
        while i > 0:
            ids.append(last[i])
            i = back[i]
        ids.reverse()
        return ids


# The vocabulary's library sorts characters by Unicode 16, Python here by an earlier version. Letters and
# digits that came between, and capitals whose small letters Python does not know.
LATER_LETTERS = ("\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
                 "\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa"
                 "\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0")
LATER_DIGITS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
LATER_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
               **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}


def _numbers(stop: int) -> str:
    """Numbers that are no decimal digits, below ``stop``."""
    return "".join(chr(i) for i in range(stop) if unicodedata.category(chr(i)) in ("Nl", "No"))


def word_pattern() -> str:
    """The vocabulary's pre-tokenizer, 's|'t|'re|'ve|'m|'ll|'d|letters|number|others, in the terms of ``re``."""
    numbers = rf"\d{_numbers(0x110000)}{LATER_DIGITS}"
    later = f"{LATER_LETTERS}{LATER_DIGITS}"
    return (rf"'s|'t|'re|'ve|'m|'ll|'d|(?:[^\W_{numbers}]|[{LATER_LETTERS}])+|[{numbers}]"
            rf"|(?:[_\x1c-\x1f]|(?![{later}])[^\w\s])+")


def odd_characters() -> str:
    """Characters for which the short pattern does not do: separators, numbers that are no digits, later ones, and all beyond the basic plane."""
    small = "".join(map(chr, (c for c in LATER_SMALL if c < 0x10000)))
    return f"\x1c-\x1f{_numbers(0x10000)}{LATER_LETTERS[:LATER_LETTERS.index(chr(0x105C0))]}{small}\U00010000-\U0010ffff"


class TextCoder:
    """Whole texts: normalisation, special tokens, words, ids and decoded text."""

    #: The pre-tokenizer for texts without odd characters.
    PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+"

    def __init__(self, content: str) -> None:
        self.encoder = PrefixEncoder(content)
        self.word, self.plain = re.compile(word_pattern()), re.compile(self.PLAIN)
        self.odd = re.compile(f"[{odd_characters()}]")
        special = sorted(self.encoder.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in special) + ")") if special else None
        #: Results of the words met of late, and of those before them.
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def _word(self, word: str) -> tuple[bytes, str]:
        found = self.known.get(word) or self.older.get(word)
        if found is None:
            ids = self.encoder.encode_word(word.encode())
            found = array("I", ids).tobytes(), " ".join([self.encoder.text_of[i] for i in ids])
        if len(word) <= LONGEST_KEPT:
            if len(self.known) >= WORDS_KEPT:
                self.older, self.known = self.known, {}
            self.known[word] = found
        return found

    def pieces(self, text: str) -> Iterator[tuple[bytes, str]]:
        """(ids, decoded tokens) of the text's words and special tokens, in order."""
        known, make = self.known, self._word
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield array("I", [self.encoder.special[part]]).tobytes(), part
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            words = self.plain
            if self.odd.search(part):
                words, part = self.word, part.translate(LATER_SMALL)
            for w in words.findall(part.lower()):
                yield known.get(w) or make(w)
            known = self.known

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        found = list(self.pieces(text))
        ids, decoded = b"".join([x for x, _ in found]), " ".join([y for _, y in found if y])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def ids(self, text: str) -> list[int]:
        return array("I", b"".join([x for x, _ in self.pieces(text)])).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts joined by a space, as a vocabulary without a decoder is decoded."""
        return " ".join([self.encoder.text_of[i] for i in ids])


def _coder(content: str) -> TextCoder:
    return worker_memo("bpe:" + hashlib.sha256(content.encode()).hexdigest(), lambda: TextCoder(content))


def read_vocabulary(path: str) -> str:
    """The vocabulary file's content; it goes to the executors once, as a broadcast of a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """Adds each text's token ids to the columns named in ``keep``.

    Returns ``keep`` and ``ids`` (array of int), or with ``digests`` the
    columns n_tokens, ids_sha256, decoded_sha256 in its place. A null text is
    encoded as the empty text, which has no ids. Rows are independent, so
    repeated rows stay repeated and an empty table gives an empty one. A word
    of any length takes time linear in its length.
    """
    content = df.sparkSession.sparkContext.broadcast(vocabulary)
    if set(keep) & {"ids", "n_tokens", "ids_sha256", "decoded_sha256"}:
        raise ValueError("a kept column has the name of a result column")
    fields = [df.schema[c] for c in keep]
    out = "ids array<int>" if not digests else "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(content.value)
        for batch in rows_of(batches):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            if digests:
                n, ids, decoded = zip(*map(coder.digest, texts), strict=True)
                made = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            else:
                made = {"ids": pa.array([coder.ids(t) for t in texts], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict({c: batch.column(k) for k, c in enumerate(keep)} | made)

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [out])
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """The inverse for id arrays: the columns in ``keep`` and ``decoded``; null ids decode to the empty text."""
    content = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(content.value)
        for batch in rows_of(batches):
            made = [coder.decode(i or []) for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(k) for k, c in enumerate(keep)} | {"decoded": pa.array(made, pa.string())})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in (df.schema[c] for c in keep)] + ["decoded string"])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)
