"""BPE encoding and decoding by prefix-sharing traversal of a trie.

The distinct words of a batch that aren't known yet go into one trie. A depth-first walk gives each node, that is
each prefix of a word, the last token of that prefix's encoding: the token t that ends the prefix, for which the last
token of what stands before t and t are neighbours that byte-pair merging leaves alone. An encoding is the only
sequence of tokens whose neighbours are all of that kind, so the state of a node follows from the states above it and
prefixes that many words share are encoded once. The last sign of a word carries the end-of-word suffix and is a sign
of its own, so words end on edges of their own. A word's ids are read off backwards along its path. Words of more than
LONG signs are chains of their own: they are walked like a branch, but no nodes are built for them. Work and memory
go with the length of a word.

Text is treated as a tokenizer file of this kind says: special tokens are cut out of the raw text, the rest is
NFC-normalised, white space parts chunks, letters are lower-cased one by one, and the pattern cuts chunks into words.
Texts with nothing but white space, empty texts and null texts have no ids and decode to "". Texts of any length are
encoded whole. Decoding looks up the ids' strings and joins them by single spaces, as a file without a decoder asks for.
The Unicode tables of Python and of the tokenizers library are not of the same version; the driver asks the library once
which signs it takes for letters, numbers and marks and how it normalises each, and texts with a sign on which the two differ are
normalised by the library's normaliser and cut by a pattern that holds the differences. Without that library nothing is
encoded: the call fails. The tokenizer file is read by the driver and sent to the workers.
Repeated rows are encoded like others; an empty table gives an empty result; columns of the input that are named like
a result column are replaced.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import itertools
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: white space as the pattern's \s has it.
SPACES = "\t\n\x0b\f\r \x85\xa0  -     　"
CHUNK = regex.compile(f"[^{SPACES}]+")
#: Signs that str.split() takes for white space and the pattern does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Signs of the longest word that goes into the trie.
LONG = 400
#: Chunks that a worker remembers; as many older ones give way when it is full, but for those seen since.
CACHE = 400_000
#: Chunks that a worker keeps between tasks, those it met first: a worker outlives a stage, and others need the memory.
KEPT = 150_000
#: Pairs of tokens of which a worker remembers whether merging leaves them alone; all give way when it is full.
PAIRS = 500_000

OUTPUTS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}
_ARROW = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "decoded": pa.string(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _runs(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, k = [], 0
    while k < len(points):
        end = k
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[k]:08x}-\\U{points[end]:08x}" if end > k else f"\\U{points[k]:08x}")
        k = end + 1
    return "".join(out)


def lower(text: str) -> str:
    """Lower case sign by sign; lower() alone would give a final sigma."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


@functools.lru_cache(maxsize=4)
def unicode_differences(spec: str) -> tuple[str, dict[str, tuple[str, str]]]:
    """The signs that the library of a tokenizer file and Python treat differently, and for each class of a pattern what to add and what to leave out."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers  # without it this fails: Python's tables alone would give other ids

    classes = {k: f"\\p{{{k}}}" for k in "LNM"}
    splits = {k: pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True) for k, name in classes.items()}
    normal = Tokenizer.from_str(spec).normalizer
    odd: set[int] = set()
    more: dict[str, list[int]] = {k: [] for k in classes}
    less: dict[str, list[int]] = {k: [] for k in classes}
    for first in range(0, 0x110000, 0x2000):  # in blocks, to spare the driver's memory
        points = [n for n in range(first, first + 0x2000) if not 0xD800 <= n < 0xE000]
        every = "".join(map(chr, points))
        kinds = [unicodedata.category(c)[0] for c in every]
        for k, name in classes.items():
            theirs = {points[i] for _, (a, b) in splits[k].pre_tokenize_str(every) for i in range(a, b)} if points else set()
            ours = {points[i] for m in regex.finditer(f"{name}+", every) for i in range(*m.span())}
            odd |= theirs ^ {n for n, x in zip(points, kinds) if x == k}
            more[k] += sorted(theirs - ours)
            less[k] += sorted(ours - theirs)
        if normal is not None:
            plain = [c for c in every if not c.isspace() and c != "\x01"]
            got = normal.normalize_str("\x01".join(plain)).split("\x01") if plain else []
            odd |= {ord(c) for c, x in zip(plain, got, strict=True) if lower(unicodedata.normalize("NFC", c)) != x}
    changes = {name: (_runs(more[k]), _runs(less[k])) for k, name in classes.items() if more[k] or less[k]}
    return "".join(map(chr, sorted(odd))), changes


class Bpe:
    """A byte-level vocabulary with word ends, from the text of a tokenizer file; odd, changes: of unicode_differences."""

    def __init__(self, text: str, odd: str = "", changes: dict[str, tuple[str, str]] | None = None):
        spec = json.loads(text)
        self.odd = frozenset(odd)
        self.normal = None
        if odd:
            from tokenizers import Tokenizer

            bare = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "pre_tokenizer": None, "post_processor": None, "decoder": None}
            self.normal = Tokenizer.from_str(json.dumps(spec | bare)).normalizer
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p]
        pattern = patterns[0]
        for name, (more, less) in (changes or {}).items():
            pattern = pattern.replace(name, f"[[{name}{more}]--[{less}]]" if less else f"[{name}{more}]")
        self.pattern = regex.compile(f"(?V1){pattern}")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.inner = self._backwards(t for t in self.vocab if not (self.end and t.endswith(self.end)))
        self.final = self._backwards(t for t in self.vocab if self.end and t.endswith(self.end) and t != self.end)
        self.length = {i: len(self.pieces(t)) for t, i in self.vocab.items()}
        self.table = dict(enumerate(byte_signs()))
        self.apart: dict[int, bool] = {}
        self.known: dict[str | int, bytes] = {}
        self.older: dict[str | int, bytes] = {}

    def _backwards(self, tokens: Iterable[str]) -> dict:
        """A trie of tokens read from their ends; the empty key holds the id."""
        root: dict = {}
        for token in tokens:
            node = root
            for sign in reversed(self.pieces(token)):
                node = node.setdefault(sign[0], {})
            node[""] = self.vocab[token]
        return root

    def merge(self, parts: list[str]) -> list[str]:
        """Plain byte-pair merging: the first of the lowest rank, again and again."""
        parts = list(parts)
        while len(parts) > 1:
            ranks = [self.ranks.get(p, len(self.ranks)) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == len(self.ranks):
                break
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def pieces(self, token: str) -> list[str]:
        """The signs of a token; the end-of-word suffix belongs to the last one."""
        if self.end and token.endswith(self.end) and token != self.end:
            head = token[: -len(self.end)]
            return [*head[:-1], head[-1] + self.end]
        return list(token)

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging leaves token a followed by token b as they are."""
        k = a * len(self.strings) + b
        if (known := self.apart.get(k)) is None:
            x, y = self.strings[a], self.strings[b]
            known = self.apart[k] = self.merge(self.pieces(x) + self.pieces(y)) == [x, y]
        return known

    def last_token(self, signs: list[str] | str, size: int, ends: bool, states: list[int]) -> int:
        """Of the encoding of the first size signs, as a whole word if ends; states: the last token of each shorter prefix."""
        node, at, found = self.final if ends else self.inner, size, []
        while at > 0 and (node := node.get(signs[at - 1])) is not None:
            at -= 1
            if "" in node:
                found.append((at, node[""]))
        for start, token in reversed(found):
            if start == 0 or self.neighbours(states[start], token):
                return token
        raise ValueError(f"the vocabulary can't encode {''.join(signs[:size])[-100:]!r}")

    def read_off(self, signs: list[str] | str, size: int, states: list[int]) -> list[int]:
        """The ids of a word, backwards from its end."""
        ids, at, token = [], size, self.last_token(signs, size, True, states)
        while True:
            ids.append(token)
            at -= self.length[token]
            if not at:
                return ids[::-1]
            token = states[at]

    def encode_chain(self, word: str) -> list[int]:
        """Ids of a word that shares no prefix with others."""
        states = [-1]
        for size in range(1, len(word)):
            states.append(self.last_token(word, size, False, states))
        return self.read_off(word, len(word), states)

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, given in the vocabulary's signs."""
        root: dict = {}
        done: dict[str, list[int]] = {}
        for word in words:
            if len(word) > LONG:
                done[word] = self.encode_chain(word)
                continue
            node = root
            for sign in word:
                if (below := node.get(sign)) is None:
                    below = node[sign] = {}
                node = below
            node[""] = word
        signs, states = [""] * LONG, [-1] * (LONG + 1)  # of the way to the node; states: the last token of each prefix
        stack = [(0, "", root)]
        while stack:
            size, sign, node = stack.pop()
            if size:
                signs[size - 1] = sign
            if (word := node.pop("", None)) is not None:
                done[word] = self.read_off(signs, size, states)
            if node:  # longer words follow
                if size:
                    states[size] = self.last_token(signs, size, False, states)
                stack += [(size + 1, sign, child) for sign, child in node.items()]
        return done

    def spelt(self, word: str) -> str:
        """A word in the vocabulary's signs."""
        return word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.table)

    def words(self, chunk: str) -> list[str]:
        if not (chunk.isascii() or self.odd.isdisjoint(chunk)):
            return self.pattern.findall(chunk)
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ",.!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def missing(self, chunks: Iterable[str]) -> list[str]:
        """Those that aren't known; what the older half of the memory has is taken over."""
        young, old, out = self.known, self.older, []
        for c in chunks:
            if c not in young:
                if (x := old.get(c)) is not None:
                    young[c] = x
                else:
                    out.append(c)
        return out

    def learn(self, chunks: Iterable[str]) -> None:
        """Encodes chunks that aren't known yet; a chunk of one word is that word."""
        compound: dict[str, list[str]] = {}
        words: dict[str, None] = {}
        for c in chunks:
            ws = self.words(c)
            if len(ws) == 1:
                words[c] = None
            else:
                compound[c] = ws
        words |= dict.fromkeys(self.missing({w for ws in compound.values() for w in ws}))
        spelt = {self.spelt(w): w for w in words}
        known = self.known
        for s, ids in self.encode_words(spelt).items():
            known[spelt[s]] = struct.pack(f"<{len(ids)}I", *ids)
        for c, ws in compound.items():
            known[c] = b"".join([known[w] for w in ws])

    def rest(self) -> None:
        """Keeps KEPT chunks and gives the memory of all others back to the system."""
        self.older = {}
        if len(self.known) > KEPT:
            self.known = dict(itertools.islice(self.known.items(), KEPT))
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    def decode(self, ids: bytes) -> str:
        """The text of ids, given as little-endian 32-bit integers."""
        return " ".join(map(self.strings.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))

    def chunks(self, text: str) -> list[str]:
        """Normalised chunks."""
        if text.isascii() or self.odd.isdisjoint(text):
            text = lower(unicodedata.normalize("NFC", text))
        else:
            text = self.normal.normalize_str(text)
        if any(s in text for s in SEPARATORS):
            return CHUNK.findall(text)
        return text.split()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        if len(self.apart) > PAIRS:
            self.apart.clear()
        cut: list[list[str | int]] = []
        for text in texts:
            parts: list[str | int] = []
            if text and any(x in text for x in self.special):
                for k, piece in enumerate(self.cut.split(text)):
                    parts += [self.special[piece]] if k % 2 else self.chunks(piece)
            elif text:
                parts = self.chunks(text)
            cut.append(parts)
        for i in self.special.values():
            self.known[i] = i.to_bytes(4, "little")
        self.learn(self.missing(set().union(*cut)))
        known = self.known
        for parts in cut:
            yield b"".join([known[c] for c in parts])


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The vocabulary of a file, with what the library's tables differ in."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return Bpe(text, *unicode_differences(text))


def _columns(bpe: Bpe, encoded: Iterable[bytes], outputs: list[str]) -> list[pa.Array]:
    values: dict[str, list] = {c: [] for c in outputs}
    decodes = "decoded" in outputs or "decoded_sha256" in outputs
    for raw in encoded:
        decoded = bpe.decode(raw) if decodes else ""
        for c, v in values.items():
            if c == "n_tokens":
                v.append(len(raw) // 4)
            elif c == "ids":
                v.append(memoryview(raw).cast("i").tolist())
            elif c == "decoded":
                v.append(decoded)
            elif c == "ids_sha256":
                v.append(hashlib.sha256(raw).hexdigest())
            else:
                v.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
    return [pa.array(values[c], _ARROW[c]) for c in outputs]


def encode_decode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    outputs: Iterable[str] = ("n_tokens", "ids", "decoded"),
    keep: Iterable[str] | None = None,
    batch: int = 256,
) -> DataFrame:
    """docs (or its columns keep) with what was asked for of OUTPUTS. path: a tokenizer file that the driver has."""
    outputs = list(outputs)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    name = hashlib.sha256(spec.encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((spec, *unicode_differences(spec)))  # a file of a few MB
    names = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    source = docs.select(*names, docs[text].alias("text in full"))
    schema = ", ".join([f"`{c}` {dict(docs.dtypes)[c]}" for c in names] + [f"{c} {OUTPUTS[c]}" for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LOADED:
            _LOADED[name] = Bpe(*sent.value)
        bpe = _LOADED[name]
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                made = _columns(bpe, bpe.encode(part.column(len(names)).to_pylist()), outputs)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*names, *outputs])
        bpe.rest()

    return source.mapInArrow(run, schema)
