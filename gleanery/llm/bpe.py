"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as a state machine.

From the merge list follows how far a change at the right end of a text can reach back. Merges run in order
of rank; the place left of which two texts still agree moves left only when a merge (u, v) joins the
token u that ends there with a token v behind it, and it moves by the length of u. The next merge that moves it
has a higher rank and its right part begins with u. So the longest chain of merges of rising rank,
(u1, v1), (u2, v2), ... with u(k) a prefix of v(k+1), weighted by the lengths of the u's, bounds the
lookahead. Token borders further left than that are final and their tokens are emitted; the rest waits for
more input. What is held is a constant, however long a word is. Usual words are shorter than the
lookahead: the new ones of a batch are merged together in numpy, and remembered in a bounded table.

Defined results: a null text is empty: no tokens, empty decoded text. Very long texts and words are encoded
whole. The strings of special tokens in a text become their ids, as in the library. Rows that repeat an id
are encoded each; tables may be empty and have more columns.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.shared import fresh, quoted

#: Words that a worker remembers at a time.
REMEMBERED = 150_000
#: Bytes of words that are merged together; longer ones pass through the transducer. Characters encoded at once.
SHORT, AT_ONCE = 64, 1 << 20
TABLE_BITS = 19
STEP = 1 << 16
WORD_END = "</w>"
# The tokenizer file's split pattern (\s there is Unicode's White_Space).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Texts whose characters all lie below this one are split by the standard library's faster engine.
COMMON = 0x180


def common_pattern() -> re.Pattern[str]:
    """SPLIT for texts of characters below COMMON, with its classes written out."""
    kinds: dict[str, str] = {"L": "", "N": ""}
    for c in map(chr, range(COMMON)):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += c
    letters, numbers = kinds["L"], kinds["N"]
    blanks = "".join(c for c in map(chr, range(COMMON)) if regex.match(r"\p{White_Space}", c))
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    spare = {b: 0x100 + i for i, b in enumerate(others)}
    return [chr(spare.get(b, b)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file, and the lookahead its merges need."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[u], self.ids[v]): (rank, self.ids[u + v]) for rank, (u, v) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: name for name, i in self.ids.items()} | {i: name for name, i in self.special.items()}
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.final = [self.ids[c + WORD_END] for c in letters]
        back = {c: b for b, c in enumerate(letters)}
        self.bytes = {i: self._bytes(name, back) for i, name in self.names.items()}
        self.length = {i: max(1, len(name.removesuffix(WORD_END))) for i, name in self.names.items()}
        self.lookahead = self._lookahead(merges)
        self._width = max(self.names) + 1
        pairs = np.array([u * self._width + v for u, v in self.ranks], np.int64)
        # An open-addressed table of the pairs' ranks (merges are listed by rank), for lookups in bulk.
        self._slots = np.full(1 << TABLE_BITS, -1, np.int64)
        self._slot_ranks = np.zeros(1 << TABLE_BITS, np.int64)
        left, at, self._probes = np.arange(len(pairs)), self._slot(pairs), 0
        while len(left):
            free = self._slots[at] < 0
            self._slots[at[free]] = pairs[left[free]]
            self._slot_ranks[at[free]] = left[free]
            waiting = self._slots[at] != pairs[left]
            self._slot_ranks[at[~waiting]] = left[~waiting]
            left, at = left[waiting], (at[waiting] + 1) % len(self._slots)
            self._probes += 1
        self._made = np.array([token for _, token in self.ranks.values()], np.int64)

    def _bytes(self, name: str, back: dict[str, int]) -> bytes:
        """What a token adds to the decoded text; the end of a word is a space."""
        if name in self.special:
            return name.encode()
        body = bytes(back[c] for c in name.removesuffix(WORD_END))
        return body + b" " if name.endswith(WORD_END) else body

    @staticmethod
    def _lookahead(merges: list[tuple[str, str]]) -> int:
        made: dict[str, int] = {}
        reach: dict[str, int] = {}  # per token u, the longest chain so far that ends in a merge with u on the left
        for rank, (u, v) in enumerate(merges):
            if made.get(u, -1) > rank or made.get(v, -1) > rank:
                raise ValueError("a merge uses a token that only a later merge makes")
            made.setdefault(u + v, rank)
            chain = len(u) + max((reach.get(v[:i], 0) for i in range(1, len(v) + 1)), default=0)
            reach[u] = max(reach.get(u, 0), chain)
        return max(reach.values(), default=0)

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges, lowest rank first, equal ranks from the left."""
        ranks = self.ranks
        while len(symbols) > 1:
            best = min((ranks[p] for p in zip(symbols, symbols[1:]) if p in ranks), default=None)
            if best is None:
                break
            rank, token = best
            out, i, last = [], 0, len(symbols) - 1
            while i <= last:
                if i < last and ranks.get((symbols[i], symbols[i + 1]), (None,))[0] == rank:
                    out.append(token)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _ranks_of(self, keys: np.ndarray, none: int) -> np.ndarray:
        """The rank of each pair, ``none`` where it is no merge."""
        out, at = np.full(len(keys), none, np.int64), self._slot(keys)
        index = np.arange(len(keys))
        for _ in range(self._probes):
            held = self._slots[at]
            hit = held == keys
            out[index[hit]] = self._slot_ranks[at[hit]]
            more = ~hit & (held >= 0)
            if not more.any():
                break
            index, keys, at = index[more], keys[more], (at[more] + 1) % len(self._slots)
        return out

    def merged_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many non-empty words, one behind the other, and where each word's begin (and the last one's end)."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = np.array(self.inner, np.int64)[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = np.array(self.final, np.int64)[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        none = len(self._made)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks = np.full(len(symbols), none, np.int64)  # of the pair that begins at each symbol
            keys = symbols[:-1] * self._width + symbols[1:]
            ranks[:-1] = np.where(owner[:-1] == owner[1:], self._ranks_of(keys, none), none)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(symbols)]]))
            least = np.repeat(np.minimum.reduceat(ranks, starts), counts)
            if (least == none).any():
                done.append((owner[least == none], symbols[least == none]))
            chosen = (ranks == least) & (least < none)
            # Of overlapping equal pairs (as in aaa) every second one goes, from the left.
            places = np.flatnonzero(chosen)
            first = np.concatenate([[True], np.diff(places) > 1])[:len(places)]
            run = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            symbols[places] = self._made[ranks[places]]
            stays = least < none
            stays[places + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        owners = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        tokens = np.concatenate([t for _, t in done])[order] if done else np.zeros(0, np.int64)
        return tokens, np.searchsorted(owners[order], np.arange(len(words) + 1))

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one word, from its bytes in pieces; holds a bounded number of symbols."""
        room = 2 * self.lookahead + 256
        waiting: list[int] = []
        last: int | None = None  # the newest byte, kept back as it may end the word
        for piece in data:
            for byte in piece:
                if last is not None:
                    waiting.append(self.inner[last])
                last = byte
                if len(waiting) >= room:
                    end, taken = len(waiting) - self.lookahead, 0
                    for token in self.merged(waiting):
                        if taken + self.length[token] > end:
                            break
                        taken += self.length[token]
                        yield token
                    waiting = waiting[taken:]
        if last is not None:
            yield from self.merged([*waiting, self.final[last]])


class Encoder:
    """Text to ids: specials, normal form, words, transducer."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words, self.common_words = regex.compile(SPLIT), common_pattern()
        self.rare = re.compile(f"[^\0-{chr(COMMON - 1)}]")
        specials = sorted(vocabulary.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.known: dict[str, bytes] = {}

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [self._words(t) for t in texts]
        self._learn({w for words in split for w in words})
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]

    def _words(self, text: str) -> list[str]:
        if self.specials is None or "<|" not in text:
            return self._plain(text)
        parts = self.specials.split(text)
        return [w for i, p in enumerate(parts) for w in ([f" {p}"] if i % 2 else self._plain(p))]

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        text = text.lower()
        words = self.words if self.rare.search(text) else self.common_words
        return words.findall(text)

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of ``words``; a special token is written behind a blank, which no word holds."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, words
        short: dict[str, bytes] = {}
        for word in new:
            data = word.encode()
            if word[0] == " ":
                self.known[word] = struct.pack("<I", self.vocabulary.special[word[1:]])
            elif len(data) <= SHORT:
                short[word] = data
            else:
                tokens = list(self.vocabulary.stream(data[i:i + STEP] for i in range(0, len(data), STEP)))
                self.known[word] = struct.pack(f"<{len(tokens)}I", *tokens)
        if short:
            tokens, bounds = self.vocabulary.merged_words(list(short.values()))
            flat, places = tokens.astype("<u4").tobytes(), (bounds * 4).tolist()
            for word, begin, end in zip(short, places, places[1:]):
                self.known[word] = flat[begin:end]


class Decoder:
    """Ids to text, one at a time. ``named`` gives the tokens' names parted by spaces, as the library does without a decoder."""

    def __init__(self, vocabulary: Vocabulary, named: bool = False):
        self.vocabulary, self.named, self.begun = vocabulary, named, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: Iterable[int]) -> str:
        """The text that is certain after ``tokens``; an unfinished character waits in the state."""
        if not self.named:
            return self.state.decode(b"".join(self.vocabulary.bytes.get(t, b"") for t in tokens))
        out = " ".join(map(self.vocabulary.names.__getitem__, tokens))
        begun, self.begun = self.begun, self.begun or bool(out)
        return f" {out}" if begun and out else out

    def close(self) -> str:
        return "" if self.named else self.state.decode(b"", True)


def decoded(vocabulary: Vocabulary, packed: bytes, named: bool = False) -> Iterator[str]:
    """The text of packed ids, in pieces."""
    machine, step = Decoder(vocabulary, named), 4 * 4096
    for i in range(0, len(packed), step):
        part = packed[i:i + step]
        yield machine.feed(struct.unpack(f"<{len(part) // 4}I", part))
    yield machine.close()


_loaded: dict[int, Encoder] = {}


def _encoder(content: str) -> Encoder:
    """One per worker process and vocabulary."""
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(Vocabulary(content))
    return _loaded[key]


def _digests(docs: DataFrame, content: str, text: str, out: T.StructType, build) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(content)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            column = batch.column(at)
            begin = 0
            while begin < batch.num_rows:  # so that long texts leave memory soon
                texts, size = [], 0
                while begin + len(texts) < batch.num_rows and size < AT_ONCE:
                    texts.append(column[begin + len(texts)].as_py() or "")
                    size += len(texts[-1])
                yield build(batch.slice(begin, len(texts)), encoder.packed(texts), encoder.vocabulary)
                begin += len(texts)

    return docs.mapInArrow(run, out)


def encoded(docs: DataFrame, content: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the text in the array column ``ids``. ``content`` is the tokenizer file."""
    (name,) = fresh(docs, ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def build(part: pa.RecordBatch, packed: list[bytes], _: Vocabulary) -> pa.RecordBatch:
        rows = [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in packed]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.int32()))], names=schema.names)

    return _digests(docs, content, text, schema, build)


def round_trip(docs: DataFrame, content: str, doc_id: str = "doc_id", text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and the columns ``carried`` as they are."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), *[quoted(c) for c in carried])
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        *[rows.schema[c] for c in carried]])

    def build(part: pa.RecordBatch, packed: list[bytes], vocabulary: Vocabulary) -> pa.RecordBatch:
        texts = []
        for p in packed:
            digest = hashlib.sha256()
            for chunk in decoded(vocabulary, p, named=True):
                digest.update(chunk.encode())
            texts.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays([
            part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array(texts, pa.string()),
            *part.columns[2:],
        ], names=schema.names)

    return _digests(rows, content, "text", schema, build)
