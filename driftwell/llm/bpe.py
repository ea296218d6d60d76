"""BPE encoding and decoding with merges taken from a segment tree over adjacent pair ranks.

Leaf i of a word's tree holds the rank of the pair (symbol i, next symbol) with its place, inner nodes the
smaller of their children.  The root yields the leftmost pair of the lowest rank; a merge updates
three leaves, each in logarithmic time, until no pair has a rank.  Trees of many words go in step.

The vocabulary file is read as data: its normaliser (NFC, white space, lower case), its split pattern,
its byte alphabet and its merges.  Words of ASCII and Latin-1 are found in the texts' bytes, many texts at once; a chunk between
white space that holds anything else is taken whole and split character by character.  Words and such chunks repeat, so every
Python worker keeps those it has met, the last CACHED to 2 * CACHED of them.

Rows: null text is empty; an empty text has no ids.  Repeated rows are encoded alike; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED = 300_000
CELLS = 1 << 20
NONE = 1 << 60
#: The split pattern by which KINDS tells words apart: runs of letters, single digits, runs of marks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
LATIN = 0xC3  # the first byte of the letters from À to ÿ, and of × and ÷
KINDS, LOWER = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
for _kind, _chars in ((SPACE, " \t\n\v\f\r"), (LETTER, string.ascii_letters), (DIGIT, string.digits), (MARK, string.punctuation)):
    KINDS[list(_chars.encode())] = _kind
KINDS[ord("'")] = OTHER
KINDS[LATIN] = LETTER
LOWER[65:91] += 32


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_words(symbols: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], merged: np.ndarray) -> np.ndarray:
    """symbols (words x places, -1 after a word's end) with all ranked pairs merged; freed places hold -1.

    One segment tree a row, all rows in step: each step takes every root's leftmost lowest-rank pair and
    puts three leaves.  pairs: sorted keys a * 2**20 + b and their ranks; merged: the new symbol by rank.
    """
    words, places = symbols.shape
    keys, ranks = pairs
    size = 1 << max(0, (places - 2).bit_length())  # leaves: places - 1 pairs at most
    rows = np.arange(words)
    sym = np.full((words, size + 2), -1, np.int64)
    sym[:, :places] = symbols
    after = np.tile(np.arange(1, size + 3), (words, 1))
    before = np.tile(np.arange(-1, size + 1), (words, 1))
    after[:, -1] = size + 1

    def rank(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = (a << 20) + b
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (keys[found] == key), ranks[found] * size + at, NONE)

    tree = np.full((words, 2 * size), NONE, np.int64)
    for i in range(size):
        tree[:, size + i] = rank(sym[:, i], sym[:, i + 1], i)
    for k in range(size - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

    def put(r: np.ndarray, leaf: np.ndarray, value) -> None:
        k = size + leaf
        tree[r, k] = value
        while (k := k >> 1)[0]:
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    root = min(1, 2 * size - 1)
    r = rows[tree[:, root] < NONE]
    while len(r):
        low = tree[r, root]
        i = low % size
        j = after[r, i]
        k = after[r, j]
        sym[r, i] = merged[low // size]
        sym[r, j] = -1
        after[r, i] = k
        before[r, k] = i
        gone = j < size
        if gone.any():
            put(r[gone], j[gone], NONE)
        put(r, i, rank(sym[r, i], sym[r, k], i))
        left = before[r, i]
        has = left >= 0
        if has.any():
            put(r[has], left[has], rank(sym[r[has], left[has]], sym[r[has], i[has]], left[has]))
        r = r[tree[r, root] < NONE]
    return sym[:, :places]


class Vocabulary:
    """A word-level BPE vocabulary file and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        model = d["model"]
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        merges = [tuple(m) for m in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = np.array([(ids[a] << 20) + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs = keys[order], order
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int64)
        self.last = np.array([ids[c + end] for c in alphabet], np.int64)
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.space = regex.compile(r"\s+")
        self.odd_space = re.compile("[\x1c-\x1f]")  # white space to str.split() alone
        self.kinds = KINDS.copy()
        self.kinds[[t.encode("utf-8")[0] for t in self.added]] = OTHER
        if self.split.pattern != PATTERN:
            self.kinds[KINDS != SPACE] = OTHER
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes], known: dict[bytes, bytes]) -> None:
        """Encode the words and put their packed ids into known."""
        by_size: dict[int, list[bytes]] = {}
        for w in words:
            by_size.setdefault(max(1, len(w) - 1).bit_length(), []).append(w)
        for size, group in by_size.items():
            step = max(1, CELLS >> size)
            for at in range(0, len(group), step):
                raw = group[at : at + step]
                n = np.fromiter(map(len, raw), np.int64, len(raw))
                ends = np.cumsum(n)
                flat = self.inner[flat_bytes := np.frombuffer(b"".join(raw), np.uint8)]
                flat[ends - 1] = self.last[flat_bytes[ends - 1]]
                symbols = np.full((len(raw), max(2, int(n.max()))), -1, np.int64)
                symbols[np.repeat(np.arange(len(raw)), n), np.arange(len(flat)) - np.repeat(ends - n, n)] = flat
                out = merge_words(symbols, self.pairs, self.merged)
                kept = out >= 0
                packed, cuts = out[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
                known.update(zip(raw, (packed[a:b] for a, b in zip([0, *cuts], cuts))))

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space, which no word or added token spans."""
        return self.space.split(text) if self.odd_space.search(text) else text.split()

    def split_chunk(self, chunk: str) -> list[str]:
        """The chunk's words; an added token is a word of its own, marked by a leading blank."""
        if self.specials and (parts := self.specials.split(chunk))[1:]:
            out = self.plain(parts[0])
            for token, part in zip(parts[1::2], parts[2::2]):
                out += [" " + token, *self.plain(part)]
            return out
        return self.plain(chunk)

    def plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # each character's lower case by itself: no final sigma
        return self.split.findall(text.lower() if "Σ" not in text else "".join(c.lower() for c in text))

    def units(self, data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The units of UTF-8 bytes that end with white space, which of them are chunks, and which bytes they hold.

        A unit is a word in lower case, or a chunk between white space as it stands, where that holds an OTHER byte.
        """
        kind, low = self.kinds[data], LOWER[data]
        second = np.flatnonzero(data == LATIN) + 1
        byte = data[second]
        kind[second] = np.where((byte == 0x97) | (byte == 0xB7), OTHER, self.kinds[LATIN])  # × and ÷ are no letters
        low[second] = np.where(byte < 0x9F, byte + 32, byte)
        held = kind != SPACE
        if (kind == OTHER).any():
            space = np.flatnonzero(~held)
            begin = np.append(0, space[:-1] + 1)
            whole = held & np.repeat(np.maximum.reduceat(kind, begin) == OTHER, space + 1 - begin)  # OTHER is the largest kind
            kind[whole], low[whole] = OTHER, data[whole]
        kind, before = kind[held], np.append(np.uint8(SPACE), kind[:-1])[held]
        first = np.flatnonzero((kind != before) | (kind == DIGIT))
        ends = pa.py_buffer(np.append(first, len(kind)).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(low[held])]), kind[first] == OTHER, held

    def packed(self, units: list[bytes], chunk: list[bool]) -> list[bytes]:
        """The packed ids of distinct units."""
        young, old = self.young, self.old
        out = list(map(young.get, units))
        fresh = [i for i, ids in enumerate(out) if ids is None]
        known = {u: old[u] for u in (units[i] for i in fresh) if u in old}
        cut = {u: [w for c in self.chunks(u.decode("utf-8")) for w in self.split_chunk(c)] for u in (units[i] for i in fresh if chunk[i]) if u not in known}
        self.learn([u for u in (units[i] for i in fresh if not chunk[i]) if u not in known], known)
        if cut:
            words = {" " + t: np.array([i], "<u4").tobytes() for t, i in self.added.items()}
            new, learnt = {w: w.encode("utf-8") for w in set().union(*cut.values()).difference(words)}, {}
            self.learn(list(new.values()), learnt)
            words.update((w, learnt[raw]) for w, raw in new.items())
            known.update((u, b"".join(map(words.__getitem__, w))) for u, w in cut.items())
        for i in fresh:
            out[i] = known[units[i]]
        young.update(known)
        if len(young) > CACHED:
            self.old, self.young = young, {}
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text."""
        raw = [(t or "").encode("utf-8") for t in texts]
        values, whole, held = self.units(np.frombuffer(b"\n".join([*raw, b""]), np.uint8))
        if not len(values):
            return [b""] * len(raw)
        coded = values.dictionary_encode()
        chunk = np.zeros(len(coded.dictionary), bool)
        chunk[coded.indices.to_numpy()[whole]] = True
        known = self.packed(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), chunk.tolist())
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        _, ends, packed = ids.buffers()
        text_ends = np.cumsum(np.add.reduceat(held, np.cumsum([0, *(len(r) + 1 for r in raw[:-1])]), dtype=np.int64))
        firsts = np.frombuffer(values.buffers()[1], np.int32)
        cuts = np.frombuffer(ends, np.int64, len(ids) + 1)[np.searchsorted(firsts, text_ends)].tolist()
        return [packed[a:b].to_pybytes() for a, b in pairwise([0, *cuts])]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        """The tokens one after the other, joined by spaces, as the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def portions(texts: list[str | None], chars: int = 1 << 21):
    """Consecutive slices of the list with about so many characters, or one long text."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded: every whole text encoded, and decoded from its ids."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in portions(texts):
                ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in v.encode_all(texts[part])]
                text = [v.decode(i.tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 (UTF-8)."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in portions(texts):
                packed = v.encode_all(texts[part])
                decoded = (v.decode(np.frombuffer(p, "<u4").tolist()).encode("utf-8") for p in packed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop],
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
