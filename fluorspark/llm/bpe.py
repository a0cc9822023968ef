"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's longest token at each position comes from one pass of an Aho-Corasick automaton
over the word read backwards. The encoder takes the longest token, shortens it while it
cannot stand beside the token before it (pair-compatibility table), and steps back when no
shorter one is left; positions found dead are marked, so the work is linear in the word's
length and the result equals that of the merges. All words of a batch advance together as
numpy arrays. Arrow splits a batch into words and numbers the distinct ones; each of those is
looked up once in a bounded cache of two generations, and Arrow lays their ids out for all texts.
The tables have the size of the vocabulary; they are made once and broadcast, so that tasks
neither build nor keep them: a worker lets go of tables and cache when its next task has no use for them.

Defined results: a null or empty text has no ids; special tokens written in a text give
their id, as the tokenizers library does by default; other columns are ignored; repeated
rows and ids are encoded row by row; an empty table gives an empty result. A text is always
encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import operator
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, slices, texts_of, with_new

#: Words of a generation of the cache (about 150 bytes each), and the longest one.
MAX_CACHED = 200_000
MAX_CACHED_CHARS = 100
GROUP_CHARS = 1 << 21
WORD_END = "</w>"
_WIDE_SPACE = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LATIN = regex.compile(r"[\x00-ɏ]*")
_LATIN1 = regex.compile(r"[\x00-\xff]*")
_MARKS = string.punctuation.replace("<", "")
_U64 = np.uint64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class IntTable:
    """A fixed map from non-negative 64-bit keys to 32-bit values, looked up an array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            placed = left[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            rest = np.ones(len(left), dtype=bool)
            rest[np.flatnonzero(free)[first]] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U64) * _U64(0x9E3779B97F4A7C15)) >> _U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1 where a key is absent."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Merges:
    """The tables of one vocabulary. Tokens are numbered by rank: 256 bytes, 256 word-ending bytes, then the merges in order."""

    def __init__(self, spec: dict) -> None:
        model, symbols = spec["model"], byte_symbols()
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        names = [*symbols, *(s + WORD_END for s in symbols), *(a + b for a, b in merges)]
        if len(set(names)) != len(names):
            raise ValueError("two merges make the same token; the backtracking encoder needs one merge for each token")
        rank = {name: k for k, name in enumerate(names)}
        n = len(names)
        self.ids = np.array([vocab[x] for x in names], dtype=np.uint32)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        parts: list[tuple[int, ...]] = [(k,) for k in range(512)]
        for k, (a, b) in enumerate(merges, 512):
            self.left[k], self.right[k] = rank[a], rank[b]
            parts.append(parts[rank[a]] + parts[rank[b]])
        self.length = np.array([len(p) for p in parts], dtype=np.int32)
        whole = {p: k for k, p in enumerate(parts)}
        self.shorter = np.array([next((whole[p[:m]] for m in range(len(p) - 1, 0, -1) if p[:m] in whole), -1) for p in parts], dtype=np.int32)
        made = np.arange(512, n)
        self.pairs = IntTable(self.left[512:].astype(np.int64) * n + self.right[512:], made.astype(np.int32))
        self._automaton(parts)
        self.seen_pair = np.full(1 << 18, -1, dtype=np.int64)
        self.seen_good = np.zeros(1 << 18, dtype=bool)

    def _automaton(self, parts: list[tuple[int, ...]]) -> None:
        """Trie of the reversed tokens with failure links; ``longest``: the longest token that ends in a state."""
        child: dict[int, int] = {}
        token, depth = [-1], [0]
        for k, part in enumerate(parts):
            at = 0
            for symbol in reversed(part):
                at_next = child.setdefault(at * 512 + symbol, len(token))
                if at_next == len(token):
                    token.append(-1)
                    depth.append(depth[at] + 1)
                at = at_next
            token[at] = k
        fail, longest = [0] * len(token), list(token)
        for key, node in sorted(child.items(), key=lambda x: depth[x[1]]):
            parent, symbol = divmod(key, 512)
            if parent:
                back = fail[parent]
                while back and back * 512 + symbol not in child:
                    back = fail[back]
                fail[node] = child.get(back * 512 + symbol, 0)
            if longest[node] < 0:
                longest[node] = longest[fail[node]]
        self.child = IntTable(np.array(list(child), dtype=np.int64), np.array(list(child.values()), dtype=np.int32))
        self.fail, self.longest = np.array(fail, dtype=np.int64), np.array(longest, dtype=np.int32)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the merges would leave each pair of neighbours apart; answers stay in a table."""
        key = first.astype(np.int64) * len(self.ids) + second
        slot = ((key.astype(_U64) * _U64(0xD6E8FEB86659FD93)) >> _U64(46)).astype(np.int64)
        good = self.seen_good[slot]
        new = np.flatnonzero(self.seen_pair[slot] != key)
        if len(new):
            good[new] = self._apart(first[new].astype(np.int64), second[new].astype(np.int64))
            self.seen_pair[slot[new]], self.seen_good[slot[new]] = key[new], good[new]
            # two new pairs may share a slot: keep one of them whole
            clash = self.seen_pair[slot[new]] != key[new]
            back = new[~clash]
            self.seen_good[slot[back]] = good[back]
        return good

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo merges at the border, latest first; the pair holds unless an earlier merge crosses it."""
        n, good = len(self.ids), np.ones(len(a), dtype=bool)
        limit = np.full(len(a), n, dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            made = self.pairs.get(x * n + y)
            bad = (made >= 0) & (made < limit[live])
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            undo_left = x > y
            # the later of both is undone; a merge across the border before it would have come first
            limit[live] = np.where(undo_left, x, y + 1)
            nx, ny = self.right[x].astype(np.int64), self.left[y].astype(np.int64)
            whole_x, whole_y = nx == x, ny == y
            take_left = (undo_left & ~whole_x) | (~undo_left & whole_y & ~whole_x)
            take_right = (~undo_left & ~whole_y) | (undo_left & whole_x & ~whole_y)
            limit[live] = np.where(take_left, x, np.where(take_right, y + 1, limit[live]))
            a[live] = np.where(take_left, nx, x)
            b[live] = np.where(take_right, ny, y)
            live = live[take_left | take_right]
        return good

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and each word's number of tokens."""
        counts = np.zeros(len(words), dtype=np.int64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        begin = 0
        while begin < len(order):
            width = int(sizes[order[begin]])
            most = max(1, min(1 << 15, (1 << 21) // width))
            group = order[begin : begin + most]
            group = group[: max(1, int(np.searchsorted(-sizes[group], -(width // 2), side="left")))]
            found.append((group, self._group([words[k] for k in group], sizes[group], counts, group)))
            begin += len(group)
        starts = np.r_[0, np.cumsum(counts)]
        out = np.empty(starts[-1], dtype=np.uint32)
        for group, flat in found:
            n = counts[group]
            into = np.repeat(starts[group] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(flat))
            out[into] = self.ids[flat]
        return out, counts

    def _group(self, words: list[bytes], sizes: np.ndarray, counts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Words in order of falling length; returns their tokens one after another and fills ``counts``."""
        rows, width = len(words), int(sizes[0])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        flat[starts + sizes - 1] += 256
        best = np.zeros((rows, width + 1), dtype=np.int32)
        state = np.zeros(rows, dtype=np.int64)
        for k in range(width):
            live = int(np.searchsorted(-sizes, -k, side="left"))
            at = sizes[:live] - 1 - k
            symbol = flat[starts[:live] + at]
            now = state[:live]
            step = self.child.get(now * 512 + symbol)
            lost = np.flatnonzero((step < 0) & (now > 0))
            while len(lost):
                now[lost] = self.fail[now[lost]]
                step[lost] = self.child.get(now[lost] * 512 + symbol[lost])
                lost = lost[(step[lost] < 0) & (now[lost] > 0)]
            state[:live] = np.maximum(step, 0)
            best[np.arange(live), at] = self.longest[state[:live]]
        alive = np.ones((rows, width + 1), dtype=bool)
        stack = np.zeros((rows, width + 1), dtype=np.int32)
        depth, place, token = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64), best[:, 0].copy()
        live = np.arange(rows)
        while len(live):
            d, p, t = depth[live], place[live], token[live]
            end = p + self.length[t]
            ok = alive[live, end]
            ask = np.flatnonzero(ok & (d > 0))
            ok[ask] = self.compatible(stack[live[ask], d[ask] - 1], t[ask])
            go = live[ok]
            stack[go, d[ok]] = t[ok]
            depth[go], place[go] = d[ok] + 1, end[ok]
            token[go] = best[go, end[ok]]
            stay = live[~ok]
            less = self.shorter[t[~ok]]
            token[stay] = less
            back = stay[less < 0]
            alive[back, place[back]] = False
            depth[back] -= 1
            token[back] = stack[back, depth[back]]
            place[back] -= self.length[token[back]]
            live = live[place[live] < sizes[live]]
        counts[group] = depth
        return stack[np.arange(width + 1)[None, :] < depth[:, None]]


def _prepared(text: str) -> str:
    """The text with plain blanks for wide ones, in lower case where that is the same for its words one by one."""
    if not _LATIN1.fullmatch(text):
        return _WIDE_SPACE.sub(" ", text)
    if not text.isascii():
        text = text.replace("\x85", " ").replace("\xa0", " ")
    return text if "<" in text else text.lower()


class Encoder:
    """Texts to ids and back for one tokenizer file with the word-ending kind of byte pairs."""

    def __init__(self, raw: bytes, special: bool = True) -> None:
        """``special``: whether special tokens that are spelled in a text get their id, or are ordinary text."""
        spec = json.loads(raw)
        self.merges = Merges(spec)
        named = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = named if special else {}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        kinds = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(kinds[0]["pattern"]["Regex"])
        from tokenizers import Tokenizer

        self.normalizer = Tokenizer.from_str(raw.decode()).normalizer
        names = {**{v: k for k, v in spec["model"]["vocab"].items()}, **{v: k for k, v in named.items()}}
        spelled = [(names.get(k, "") + " ").encode() for k in range(max(names) + 1)]
        self.bytes_at = np.r_[0, np.cumsum([len(x) for x in spelled])]
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        """The tables travel, the cache does not."""
        return vars(self) | {"known": {}, "older": {}}

    def _parts(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a piece of text without white space; special tokens as ids."""
        out: list[str | int] = []
        for part in self.cut.split(chunk) if self.cut and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # other scripts' tables differ between Unicode versions: the library's own normalizer decides there
                plain = unicodedata.normalize("NFC", part).lower() if _LATIN.fullmatch(part) else self.normalizer.normalize_str(part)
                out += self.pieces.findall(plain)
        return out

    def _learn(self, chunks: list[str]) -> Iterator[bytes]:
        """The ids of new chunks as bytes; pre-tokens that chunks share are encoded once."""
        odd: dict[str, list[str | int]] = {}
        if "<" in (joined := "\n".join(chunks)) or not _LATIN.fullmatch(joined):
            odd = dict.fromkeys(c for c in chunks if "<" in c or not _LATIN.fullmatch(c))
            joined = "\n".join("" if c in odd else c for c in chunks)
        low = unicodedata.normalize("NFC", joined).lower().split("\n")
        body = [x.rstrip(_MARKS) for x in low]
        tail = [x[len(y) :] for x, y in zip(low, body, strict=True)]
        for k, x in enumerate(body):
            if not x.isalpha() and x:
                odd[chunks[k]], body[k], tail[k] = None, "", ""
        odd = {c: self._parts(c) for c in odd}
        texts = dict.fromkeys(body)
        texts.update(dict.fromkeys(tail))
        spelled = {x: ids for x in texts if (ids := self.known.get(x) or self.older.get(x)) is not None}
        texts.update(dict.fromkeys(x for row in odd.values() for x in row if isinstance(x, str)))
        fresh = [x for x in texts if x and x not in spelled]
        flat, counts = self.merges.encode_words("\n".join(fresh).encode("utf-8", "surrogatepass").split(b"\n") if fresh else [])
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        spelled.update(zip(fresh, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        spelled[""] = b""
        whole = {c: b"".join(spelled[x] if isinstance(x, str) else x.to_bytes(4, "little") for x in row) for c, row in odd.items()}
        plain = map(operator.add, map(spelled.__getitem__, body), map(spelled.__getitem__, tail))
        return (whole.get(c, ids) for c, ids in zip(chunks, plain, strict=True)) if whole else plain

    def _spelled(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks as bytes. The cache has two generations: when the younger one is full it becomes the
        older one, from which chunks that are met again move on, and what was the older one is dropped. Very long chunks and those beyond a generation's bound are not kept."""
        found = list(map(self.known.get, chunks))
        at = [k for k, ids in enumerate(found) if ids is None]
        if not at:
            return found
        new = [chunks[k] for k in at]
        got = list(map(self.older.get, new))
        if len(self.known) + len(new) > MAX_CACHED:
            self.known, self.older = {c: ids for c, ids in zip(chunks, found, strict=True) if ids is not None}, self.known
        fresh = [k for k, ids in enumerate(got) if ids is None]
        for k, ids in zip(fresh, self._learn([new[k] for k in fresh]), strict=False):
            got[k] = ids
        for k, ids in zip(at, got, strict=True):
            found[k] = ids
        short = max(map(len, new)) <= MAX_CACHED_CHARS
        kept = zip(new, got, strict=True) if short else ((c, ids) for c, ids in zip(new, got, strict=True) if len(c) <= MAX_CACHED_CHARS)
        self.known.update(itertools.islice(kept, MAX_CACHED - len(self.known)))
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' borders in them."""
        words = pc.ascii_split_whitespace(pa.array(map(_prepared, texts), pa.string()))
        coded = words.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        # one long string becomes Python words faster than single Arrow values do
        spelled = self._spelled(pc.binary_join(distinct, "\n")[0].as_py().split("\n"))
        edges = np.r_[0, np.cumsum(np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled)))]
        ids = pa.Array.from_buffers(pa.large_binary(), len(spelled), [None, pa.py_buffer(edges), pa.py_buffer(b"".join(spelled))]).take(coded.indices)
        borders = np.r_[0, np.cumsum(words.value_lengths().to_numpy())]
        _, ends, data = ids.buffers()
        if data is None:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(borders), dtype=np.int64)
        return np.frombuffer(data, dtype="<u4"), np.frombuffer(ends, dtype=np.int64)[borders] // 4

    def encode_groups(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, for a bounded run of texts at a time; a text stays whole."""
        begin = 0
        while begin < len(texts):
            end, chars = begin, 0
            while end < len(texts) and (end == begin or chars + len(texts[end]) <= GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            ids, edges = self.encode(texts[begin:end])
            for a, b in itertools.pairwise(edges.tolist()):
                yield ids[a:b]
            begin = end

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' spelling joined by blanks, in UTF-8, gathered through the offset table."""
        out = []
        for k in range(0, len(ids), 1 << 18):
            part = ids[k : k + (1 << 18)].astype(np.int64)
            begin = self.bytes_at[part]
            sizes = self.bytes_at[part + 1] - begin
            ends = np.cumsum(sizes)
            out.append(self.spelled[np.repeat(begin - (ends - sizes), sizes) + np.arange(int(ends[-1]))].tobytes())
        return b"".join(out)[:-1]


@functools.lru_cache(maxsize=2)
def _encoder(raw: bytes, special: bool) -> Encoder:
    return Encoder(raw, special)


class SharedEncoder:
    """A tokenizer file's encoder, made on the driver and broadcast: a worker holds its tables and cache as long as its tasks use this broadcast."""

    def __init__(self, spark: SparkSession, path: str | None = None, special: bool = True) -> None:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        with open(path, "rb") as file:
            self.encoder = spark.sparkContext.broadcast(_encoder(file.read(), special))

    def get(self) -> Encoder:
        return self.encoder.value


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, for every document."""
    shared = SharedEncoder(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for batch in slices(batches):
            n, digest, decoded = [], [], []
            for ids in encoder.encode_groups(texts_of(batch)):
                n.append(len(ids))
                digest.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield with_new(batch, ("doc_id",), {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(run, fields(rows, "doc_id") + ", n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``, an array of token ids, for every row."""
    shared = SharedEncoder(docs.sparkSession, path)
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for batch in slices(batches):
            ids = [x.astype(np.int32) for x in encoder.encode_groups(texts_of(batch))]
            yield with_new(batch, keep, {"ids": pa.array(ids, pa.list_(pa.int32()))})

    return rows.mapInArrow(run, f"{fields(rows, *keep)}, ids array<int>")


def decode(rows: DataFrame, path: str | None = None, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``decoded``, the text of each array of ids (null: empty)."""
    shared = SharedEncoder(rows.sparkSession, path)
    picked = rows.select(*keep, F.coalesce(ids, F.array().cast("array<int>")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get()
        for batch in slices(batches):
            yield with_new(batch, keep, {"decoded": pa.array([encoder.decode(np.array(x, dtype=np.int64)).decode() for x in texts_of(batch, "_ids")], pa.string())})

    return picked.mapInArrow(run, f"{fields(picked, *keep)}, decoded string")
