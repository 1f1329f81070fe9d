"""SentencePiece BPE encoding and decoding (operator 1).

Words are encoded in vectorised merge rounds. All words that a chunk of documents
adds lie in one flat numpy array of symbols. In a round each word finds the least
rank among its neighbouring pairs (a segmented minimum), merges every leftmost
occurrence of it at once, and the array is compacted; a word leaves when no pair of
it is in the vocabulary. The result equals the library's priority queue, which merges
one pair at a time: a word in which a simultaneous merge could have opened an equal or
better pair between two merges of the same round is done again, one merge a round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, text_slices, texts_of

SPACE = "▁"
NONE = np.int32(2**31 - 1)
_CHUNK = re.compile(f"{SPACE}[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
_CHUNK_BYTES = 1 << 19


class PieceModel:
    """A SentencePiece BPE model with byte fallback, read once in each Python worker.

    The vocabulary must hold no piece with a space mark behind another character, runs of
    space marks must rank alike and behind all other pieces, and texts must not be normalised; this is checked. Words
    can then be encoded one by one, and runs of spaces apart from them.
    """

    def __init__(self, path: str, cache_size: int = 200_000):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.vocab_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        ids = {names[i]: i for i in plain}
        runs = {len(names[i]): i for i in plain if len(names[i]) > 1 and not names[i].strip(SPACE)}
        scores = {i: lib.get_score(i) for i in plain}
        ordinary = [i for i in plain if i not in set(runs.values())]
        probe = "ﬁ Å  ①\u3000x\tＡ e\u0301"
        if lib.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("a normaliser that changes texts is not supported")
        if any(re.search(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}|\n", names[i]) for i in ordinary) or SPACE not in ids:
            raise ValueError("pieces that span words are not supported")
        if runs and (len({scores[i] for i in runs.values()}) > 1 or max(scores[i] for i in runs.values()) >= min(scores[i] for i in ordinary if names[i] != SPACE)):
            raise ValueError("runs of spaces must rank alike and last")
        self.eos = lib.eos_id()
        self.runs, self.longest = {1: ids[SPACE], **runs}, max([1, *runs])
        self.cuts = [self._cut(n) for n in range(2 * self.longest + 1)]
        if any(self.cuts[n][0] != self.longest for n in range(self.longest, 2 * self.longest + 1)):
            raise ValueError("long runs of spaces must begin with the longest piece")
        self.space = ids[SPACE]
        self.bytes_ = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = np.full(0x110000, -1, np.int64)
        for i in ordinary:
            if len(names[i]) == 1:
                self.chars[ord(names[i])] = i
        rank = {s: r for r, s in enumerate(sorted({scores[i] for i in ordinary}, reverse=True))}
        pairs = sorted((ids[names[i][:k]] << 32 | ids[names[i][k:]], rank[scores[i]], i) for i in ordinary for k in range(1, len(names[i])) if names[i][:k] in ids and names[i][k:] in ids)
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int32)
        self.merged = np.array([p[2] for p in pairs], np.int64)
        control = {i for i in range(size) if lib.is_control(i)}
        self.digits = [str(i) for i in range(size)]
        self.surface = [b"" if i in control else names[i].replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.bytes_):
            self.surface[i] = bytes([b])
        self.control, self.leading = control, {i for i in plain if names[i].startswith(SPACE)}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_size = cache_size

    def _cut(self, n: int) -> list[int]:
        """Lengths of the pieces of n spaces: all pairs rank alike, so the leftmost that is a piece merges first."""
        parts, at = [1] * n, 0
        while at < len(parts) - 1:
            if parts[at] + parts[at + 1] in self.runs:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                at = max(at - 1, 0)
            else:
                at += 1
        return parts

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; NONE where the vocabulary has no such piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (left >= 0) & (right >= 0) & (self.keys[at] == key)
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def merge(self, words: list[str], one_by_one: bool = False) -> list[tuple[int, ...]]:
        """The ids of each word; characters without a piece become their bytes."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.chars[code]
        sym = np.where(sym < 0, -1 - code, sym)
        owner = np.repeat(np.arange(n), sizes)
        rank, joint = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner], joint[inner] = self._look_up(sym[inner], sym[inner + 1])
        done_owner, done_sym, again = [], [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            spans = np.diff(np.r_[first, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, first), spans)
            ended = least == NONE
            if ended.any():
                done_owner.append(owner[ended])
                done_sym.append(sym[ended])
                left = ~ended
                owner, sym, rank, joint = owner[left], sym[left], rank[left], joint[left]
                continue
            hit = np.flatnonzero(rank == least)
            if one_by_one:
                hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            else:
                fresh_run = np.r_[True, (hit[1:] != hit[:-1] + 1)]
                start = hit[np.maximum.accumulate(np.where(fresh_run, np.arange(len(hit)), 0))]
                hit = hit[(hit - start) % 2 == 0]
            new, top = joint[hit], least[hit]
            if not one_by_one:
                same = owner[hit[1:]] == owner[hit[:-1]]
                several = np.r_[False, same] | np.r_[same, False]
                bad = self._opens_better(sym, owner, hit[several], new[several], top[several])
            old = sym.copy() if not one_by_one and several.any() else None
            sym[hit] = new
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            where = np.cumsum(keep) - 1
            spot = where[hit]
            sym, owner, rank, joint = sym[keep], owner[keep], rank[keep], joint[keep]
            touched = np.unique(np.r_[spot, np.maximum(spot - 1, 0)])
            last = len(sym) - 1
            inside = touched[(touched < last)]
            inside = inside[owner[inside] == owner[inside + 1]]
            rank[touched] = NONE
            rank[inside], joint[inside] = self._look_up(sym[inside], sym[inside + 1])
            if old is not None:
                for side in (spot[several], np.maximum(spot[several] - 1, 0)):
                    worse = rank[side] <= top[several]
                    bad = np.r_[bad, owner[side][worse & (owner[side] == owner[spot[several]])]]
                if len(bad):
                    bad = np.unique(bad)
                    again.append(bad)
                    left = ~np.isin(owner, bad)
                    owner, sym, rank, joint = owner[left], sym[left], rank[left], joint[left]
        owner, sym = np.concatenate([*done_owner, np.zeros(0, np.int64)]), np.concatenate([*done_sym, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        owner, sym = owner[order], sym[order]
        ends = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        flat, odd = sym.tolist(), set(owner[sym < 0].tolist())
        out, begin = [], 0
        for k, end in enumerate(ends):
            ids = flat[begin:end]
            if k in odd:
                ids = chain.from_iterable((i,) if i >= 0 else (self.bytes_[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")) for i in ids)
            out.append(tuple(ids))
            begin = end
        if again:
            again = np.concatenate(again).tolist()
            for k, ids in zip(again, self.merge([words[k] for k in again], True), strict=True):
                out[k] = ids
        return out

    def _opens_better(self, sym, owner, hit, new, top) -> np.ndarray:
        """Words in which a merge makes a pair with a neighbour, as it stands before this round, that ranks no worse."""
        if not len(hit):
            return np.zeros(0, np.int64)
        bad = np.zeros(len(hit), bool)
        for beside, before in ((hit - 1, True), (hit + 2, False)):
            there = (beside >= 0) & (beside < len(sym))
            at = np.clip(beside, 0, len(sym) - 1)
            there &= owner[at] == owner[hit]
            rank, _ = self._look_up(*((sym[at], new) if before else (new, sym[at])))
            bad |= there & (rank <= top)
        return owner[hit[bad]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, without begin or end marks."""
        split = [_CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > self.cache_size:
            cache.clear()
        if missing := [w for w in set(chain.from_iterable(split)) if w not in cache]:
            cache.update(zip(missing, self.merge(missing), strict=True))
        return [self._spaced(words) if SPACE in words else list(chain.from_iterable(map(cache.__getitem__, words))) for words in split]

    def _spaced(self, words: list[str]) -> list[int]:
        """Ids of the words of a text that has runs of spaces: greedy pieces of a run, from the left."""
        out: list[int] = []
        run = 0
        for w in chain(words, [""]):
            if w == SPACE:
                run += 1
                continue
            ids = self.cache[w] if w else ()
            if run and ids and ids[0] == self.space:
                run, ids = run + 1, ids[1:]
            whole = max(run // self.longest - 1, 0)
            out.extend([self.runs[self.longest]] * whole)
            out.extend(self.runs[n] for n in self.cuts[run - whole * self.longest])
            run = 0
            out.extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, as the library's decode: control ids vanish, one leading space mark too; broken bytes become U+FFFD."""
        ids = list(ids)
        raw = b"".join(map(self.surface.__getitem__, ids))
        if next((i for i in ids if i not in self.control), None) in self.leading:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "piece_bytes")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


import codecs  # noqa: E402

codecs.register_error("piece_bytes", _each_byte)


@lru_cache(maxsize=2)
def load_model(path: str, cache_size: int = 200_000) -> PieceModel:
    return PieceModel(path, cache_size)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = (), cache_size: int = 200_000) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, if asked for ``ids``, and the columns of ``keep``.

    A missing text counts as empty: its only id is the end mark and it decodes to "".
    Rows that repeat give equal rows, an empty table an empty one; other columns are
    not read, whatever their names. No shuffle; memory is bounded by a batch of texts and
    ``cache_size`` words, about a kilobyte each, whose ids a worker keeps.
    """
    rows = docs.select(*map(column, (id_col, text_col, *keep)))
    digests = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([rows.schema.fields[0], *(T.StructField(*d) for d in digests), *rows.schema.fields[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path, cache_size)
        digits, eos = model.digits, model.eos
        for batch in text_slices(batches, 1, _CHUNK_BYTES):
            n, digest, back, kept = [], [], [], []
            for ids in model.encode(texts_of(batch.column(1))):
                ids.append(eos)
                n.append(len(ids))
                digest.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(model.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
