"""Byte-pair encoding by speculation and verification, and decoding.

A text is cut into the tokenizer's pre-tokens. For each pre-token that is new
to the worker, greedy longest match proposes tokens; a proposal is right
exactly if each token encodes to itself and each adjacent pair is compatible
(merging never crosses the border of the two). All pairs of a batch are tested
at once with numpy; only pre-tokens with a failing pair are merged exactly.

Cases: null text counts as the empty text (no ids, decoded ""); the special
tokens' strings become their ids, as in the tokenizers library; equal rows give
equal results; an empty table gives an empty table; input columns named like
an output are replaced by it.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from semaspark.llm.common import map_rows

# The byte-level pre-tokenisation pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes, about, of pre-tokens that a task remembers before it starts anew, and
#: the longest pre-token, in characters, that is remembered at all.
MEMO, LONGEST = 32 << 20, 64

#: Ends a word in the text that is searched for longest matches; no byte has it.
BREAK = "\u0100"

_WHITE = re.compile(r"[\s\x1c-\x1f]")
_JOINED = re.compile(r" (?:[\s\x1c-\x1f]|$)")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


def _refuse_others(spec: dict) -> None:
    """Raise unless the file says what this class does."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    said = {
        "a normalizer": spec.get("normalizer"),
        "another pre-tokenizer than ByteLevel": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True),
        "another decoder than ByteLevel": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "another model than plain BPE": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added tokens that aren't special, or strip or normalise": any(not x.get("special") or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])),
    }
    if found := [k for k, v in said.items() if v]:
        raise ValueError(f"this tokenizer file has {', '.join(found)}")


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_others(spec)
        of = _byte_alphabet()
        raw = lambda s: bytes(of[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", []) if x.get("special")}
        # Ranks number the bytes first, then the merges in their order.
        rank = {t: i for i, t in enumerate(sorted((t for t in vocab if len(t) == 1)))}
        base = len(rank)
        self.left, self.right = list(range(base)), list(range(base))
        self.pairs: dict[int, int] = {}  # by left << 32 | right
        for a, b in merges:
            x, y = rank[raw(a)], rank[raw(b)]
            new = rank.setdefault(raw(a) + raw(b), len(rank))
            if new == len(self.left):
                self.left.append(x)
                self.right.append(y)
            self.pairs.setdefault(x << 32 | y, new)
        self.rank, self.n = rank, len(rank)
        self.byte_rank = [rank[bytes([b])] for b in range(256)]
        self.id_of = np.array([vocab[t] for t in rank], dtype=np.int32)
        self._left, self._right = np.array(self.left), np.array(self.right)
        keys = np.array(list(self.pairs), dtype=np.int64)
        order = np.argsort(keys)
        self._keys, self._made = keys[order], np.array(list(self.pairs.values()), dtype=np.int64)[order]
        self._own = np.array([self._merge(t) == [r] for t, r in rank.items()])
        self._trie = ahocorasick.Automaton()
        for t, r in rank.items():
            self._trie.add_word(t.decode("latin-1"), r)
        self._trie.add_word(BREAK, -1)
        self._trie.make_automaton()
        named = {vocab[t]: t for t in rank} | {i: s.encode() for s, i in self.special.items()}
        sizes = np.zeros(max(named) + 1, dtype=np.int64)
        sizes[list(named)] = [len(t) for t in named.values()]
        self._size, self._start = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self._blob = np.frombuffer(b"".join(named.get(i, b"") for i in range(len(sizes))), dtype=np.uint8)
        self.pre = regex.compile(PATTERN)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._memo: dict[str, bytes] = {}  # ids of pre-tokens
        self._held = 0  # bytes of the memo, about

    def _merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest-ranked pair first, leftmost on ties."""
        at = [self.byte_rank[c] for c in word]
        if len(at) > 200:
            return self._merge_long(at)
        get, none = self.pairs.get, 1 << 60
        made = [get(a << 32 | b, none) for a, b in zip(at, at[1:], strict=False)]
        while made and (best := min(made)) < none:
            i = made.index(best)
            at[i : i + 2] = [best]
            del made[i]
            if i:
                made[i - 1] = get(at[i - 1] << 32 | best, none)
            if i < len(made):
                made[i] = get(best << 32 | at[i + 1], none)
        return at

    def _merge_long(self, at: list[int]) -> list[int]:
        """The same with a heap and links, for very long pre-tokens."""
        import heapq

        n, get = len(at), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, at[i], at[i + 1]) for i in range(n - 1) if (r := get(at[i] << 32 | at[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or at[i] != a or at[j] != b:
                continue
            at[i], alive[j], after[i] = r, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (new := get(at[x] << 32 | at[y])) is not None:
                    heapq.heappush(heap, (new, x, at[x], at[y]))
        return [t for t, ok in zip(at, alive, strict=True) if ok]

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each pair of tokens.

        Both tokens are unmerged step by step, latest merge first, and at each
        step the pair at the border must not merge before the merge undone.
        """
        ok = np.ones(len(first), dtype=bool)
        at = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            key = a << 32 | b
            k = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            crossed = (self._keys[k] == key) & (self._made[k] < limit)
            ok[at[crossed]] = False
            # The later of the two merges is undone: the left token on a greater rank.
            undo_a = a > b
            undone = np.where(undo_a, a, b)
            limit_new = np.where(undo_a, a, b + 1)
            na = np.where(undo_a, self._right[a], a)
            nb = np.where(undo_a, b, self._left[b])
            whole = np.where(undo_a, na == a, nb == b)
            # A byte can't be unmerged; then the other side is, or the pair stands.
            other_a = whole & ~undo_a
            other_b = whole & undo_a
            na2 = np.where(other_a, self._right[a], na)
            nb2 = np.where(other_b, self._left[b], nb)
            limit_new = np.where(other_a, a, np.where(other_b, b + 1, limit_new))
            done = (other_a & (na2 == a)) | (other_b & (nb2 == b))
            more = ~crossed & ~done
            at, a, b, limit = at[more], na2[more], nb2[more], limit_new[more]
            del undone
        return ok

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit numbers."""
        if not words:
            return []
        raws = [w.encode("utf-8") for w in words]
        # Greedy longest matches of all words; BREAK ends each word.
        text = BREAK.join([r.decode("latin-1") for r in raws]) + BREAK
        found = np.fromiter((r for _, r in self._trie.iter_long(text)), dtype=np.int64)
        ends = np.flatnonzero(found < 0)
        sizes = np.diff(ends, prepend=-1) - 1
        flat = found[found >= 0]
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), dtype=bool)
        bad[owner[~self._own[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        key, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        fits = self.compatible(key >> 32, key & 0xFFFFFFFF)[back]
        bad[owner[inner[~fits]]] = True
        ids = self.id_of[flat].tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)]) * 4
        out = [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        wrong = np.flatnonzero(bad).tolist()
        exact = [self._merge(raws[i]) for i in wrong]
        ids = self.id_of[np.fromiter((t for x in exact for t in x), dtype=np.int64)].tobytes()
        at = 0
        for i, x in zip(wrong, exact, strict=True):
            out[i] = ids[at : at + 4 * len(x)]
            at += 4 * len(x)
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of texts without special tokens, through the memo."""
        cut = list(map(self.pre.findall, pieces))
        if self._held > MEMO:
            self.forget()
        memo = self._memo
        new = list(set().union(*cut).difference(memo))
        ids = dict(zip(new, self.encode_words(new), strict=True))
        out = [b"".join([memo.get(w) or ids[w] for w in ws]) for ws in cut]
        memo.update((k, v) for k, v in ids.items() if len(k) <= LONGEST)
        self._held += 200 * len(new) + sum(map(len, ids.values()))
        return out

    def forget(self) -> None:
        """Give the memo's memory back."""
        self._memo, self._held = {}, 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizers library gives them.

        A text is cut at its special tokens, then before each space that stands
        between two characters of which the second is no white space: pre-tokens
        never cross these cuts.
        """
        plan: list[list[tuple[str, list[str]] | int]] = []
        for text in texts:
            text, at, row = text or "", 0, []
            for m in self.cut.finditer(text) if self.cut else ():
                row += [self._parts(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            row.append(self._parts(text[at:] if at else text))
            plan.append(row)
        cut = [x for row in plan for x in row if not isinstance(x, int)]
        heads = list(dict.fromkeys(x[0] for x in cut))
        tails = list(set().union(*[x[1] for x in cut]))
        ids = self._encode_pieces([*heads, *[" " + x for x in tails]])
        first, after = dict(zip(heads, ids, strict=False)), dict(zip(tails, ids[len(heads) :], strict=True))
        out = []
        for row in plan:
            got = []
            for x in row:
                if isinstance(x, int):
                    got.append(np.int32(x).tobytes())
                else:
                    got.append(first[x[0]])
                    got += map(after.__getitem__, x[1])
            out.append(np.frombuffer(b"".join(got), dtype=np.int32))
        return out

    def _parts(self, text: str) -> tuple[str, list[str]]:
        """The piece at the start, and those after a space, without it."""
        parts = text.split(" ")
        if not _JOINED.search(text):
            return parts[0], parts[1:]
        out = [parts[0]]
        for p in parts[1:]:
            if p and not _WHITE.match(p):
                out.append(p)
            else:
                out[-1] += " " + p
        return out[0], out[1:]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, special tokens included; bytes that are no
        UTF-8 become U+FFFD."""
        sizes = self._size[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self._start[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ids) else 0)
        return self._blob[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _list(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.StringType())


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and ``ids`` array<int>. The file at
    ``path`` must be readable by every executor under that path."""
    keep = [c for c in keep or df.columns if c != "ids"]

    def work():
        bpe = load(path)
        return lambda b: [_list(bpe.encode(b.column(text).to_pylist()))]

    return map_rows(df, list(dict.fromkeys([*keep, text])), [IDS], work, 512, lambda: load(path).forget())


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and ``decoded`` string; null ids
    decode to the empty text."""
    keep = [c for c in keep or df.columns if c != "decoded"]

    def work():
        bpe = load(path)
        return lambda b: [pa.array([bpe.decode(np.array(x or [], dtype=np.int64)) for x in b.column(ids).to_pylist()], pa.string())]

    return map_rows(df, list(dict.fromkeys([*keep, ids])), [DECODED], work, 512)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), ``ids`` and the text ``decoded`` from
    them, in one pass over the rows."""
    keep = [c for c in keep or df.columns if c not in ("ids", "decoded")]

    def work():
        bpe = load(path)

        def step(b: pa.RecordBatch) -> list[pa.Array]:
            ids = bpe.encode(b.column(text).to_pylist())
            return [_list(ids), pa.array([bpe.decode(x) for x in ids], pa.string())]

        return step

    return map_rows(df, list(dict.fromkeys([*keep, text])), [IDS, DECODED], work, 512, lambda: load(path).forget())
