"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 11).

A text is cut in halves down to leaves, leaves are encoded by themselves and neighbours are
joined up the tree. Both levels of an encoding, the split into pieces and the tokens of a
piece, are joined by encoding a window around the cut again and widening it until what lies
outside is known to stay:

* pieces: a match of ``PATTERN`` depends on the text from its start to at most two characters
  behind its end. Pieces of the left part that have seen so much stay; from the first start of a
  piece that both the right part and the new window have, the right part stays. A space before another
  character than white space always starts a piece, so a leaf encodes what stands between such spaces by itself.
* tokens: merging by rank, leftmost first, leaves a sequence of tokens as it is just if it leaves each
  neighbouring pair as it is (the first merge over a border would happen in the pair alone, too). So
  a window whose outer tokens come out as they were fits between its neighbours.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, text_slices, texts_of

#: Characters of a leaf of a text, bytes of a leaf of a piece, longest piece or word that is remembered.
LEAF, PIECE_LEAF, REMEMBERED = 1 << 15, 48, 48
#: A piece stays when so many characters behind its end were there to see.
BEHIND = 2
NO_RANK = 1 << 62
_CHUNK_BYTES = 1 << 20


class ByteModel:
    """The ranks of a byte-level BPE and the pattern that splits texts, read once in each Python worker.

    The margins of a join hold for ``public_tokenizers.PATTERN`` alone, so another pattern is refused;
    so are ranks in which a single byte is lacking.
    """

    def __init__(self, path: str, pattern: str | None = None, cache_size: int = 600_000):
        import public_tokenizers
        import regex

        if pattern not in (None, public_tokenizers.PATTERN):
            raise ValueError("joins are proven for public_tokenizers.PATTERN only")
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("each single byte needs a rank")
        self.rank_of = self.ranks.get
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        joints = sorted((self.ranks[t[:k]] << 32 | self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        self.joint_keys, self.joint_ranks = np.array([j[0] for j in joints], np.int64), np.array([j[1] for j in joints], np.int64)
        self.surface = {rank: token for token, rank in self.ranks.items()}
        self.digits = {rank: str(rank) for rank in self.surface}
        self.same_int = {rank: rank for rank in self.surface}  # remembered ids share their objects
        self.split = regex.compile(public_tokenizers.PATTERN, regex.V1).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.cache_size = cache_size

    # --- tokens of a piece -----------------------------------------------------------------------

    def merge(self, raw: bytes) -> list[int]:
        """The tokens of ``raw`` when pairs merge by rank, leftmost first: a leaf or a window."""
        if len(raw) <= 2 * PIECE_LEAF:
            rank_of, starts = self.rank_of, list(range(len(raw) + 1))
            pairs = [rank_of(raw[k : k + 2], NO_RANK) for k in range(len(raw) - 1)]
            while pairs and (least := min(pairs)) != NO_RANK:
                k = pairs.index(least)
                del starts[k + 1], pairs[k]
                if k < len(pairs):
                    pairs[k] = rank_of(raw[starts[k] : starts[k + 2]], NO_RANK)
                if k:
                    pairs[k - 1] = rank_of(raw[starts[k - 1] : starts[k + 1]], NO_RANK)
            return [rank_of(raw[a:b]) for a, b in pairwise(starts)]
        ranks = self.ranks
        parts = [raw[k : k + 1] for k in range(len(raw))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(r, k) for k in range(len(parts) - 1) if (r := ranks.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            nxt = after[k]
            if not parts[k] or nxt >= len(parts) or ranks.get(parts[k] + parts[nxt]) != rank:
                continue
            parts[k], parts[nxt] = parts[k] + parts[nxt], b""
            after[k] = end = after[nxt]
            if end < len(parts):
                before[end] = k
                if (r := ranks.get(parts[k] + parts[end])) is not None:
                    heapq.heappush(queue, (r, k))
            if (start := before[k]) >= 0 and (r := ranks.get(parts[start] + parts[k])) is not None:
                heapq.heappush(queue, (r, start))
        return [ranks[p] for p in parts if p]

    def merge_all(self, raws: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` for many leaves at once: in a round the leftmost least pair of each leaf merges."""
        symbols = self.single[np.frombuffer(b"".join(raws), np.uint8)]
        owner = np.repeat(np.arange(len(raws)), np.fromiter(map(len, raws), np.int64, len(raws)))
        pair = np.full(len(symbols), NO_RANK)  # rank of a symbol and its right neighbour

        def look_up(at: np.ndarray) -> None:
            at = at[at >= 0]
            last = at + 1 >= len(symbols)
            inner = at[~last]
            inner_own = owner[inner] == owner[inner + 1]
            pair[at] = NO_RANK
            inner = inner[inner_own]
            key = symbols[inner] << 32 | symbols[inner + 1]
            place = np.minimum(np.searchsorted(self.joint_keys, key), len(self.joint_keys) - 1)
            pair[inner] = np.where(self.joint_keys[place] == key, self.joint_ranks[place], NO_RANK)

        look_up(np.arange(len(symbols)))
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.repeat(np.minimum.reduceat(pair, first), np.diff(np.r_[first, len(symbols)]))
            done = least == NO_RANK
            if done.any():
                ended.append((owner[done], symbols[done]))
                owner, symbols, pair = owner[~done], symbols[~done], pair[~done]
                continue
            hit = np.flatnonzero(pair == least)
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            symbols[hit] = pair[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            spot = hit - np.arange(len(hit))
            owner, symbols, pair = owner[keep], symbols[keep], pair[keep]
            look_up(np.r_[spot, spot - 1])
        if not raws:
            return []
        owners, found = np.concatenate([e[0] for e in ended]), np.concatenate([e[1] for e in ended])
        order = np.argsort(owners, kind="stable")
        flat = list(map(self.same_int.__getitem__, found[order].tolist()))
        ends = np.cumsum(np.bincount(owners, minlength=len(raws))).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def join_tokens(self, left: Sequence[int], right: Sequence[int]) -> list[int]:
        """The tokens of two neighbours together: the window grows on a side until the side's outer token is as it was."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(map(self.surface.__getitem__, (*left[len(left) - i :], *right[:j]))))
            left_stays, right_stays = i == len(left) or window[0] == left[-i], j == len(right) or window[-1] == right[j - 1]
            if left_stays and right_stays:
                return [*left[: len(left) - i], *window, *right[j:]]
            i, j = i if left_stays else 4 * i, j if right_stays else 4 * j

    def tokens(self, raw: bytes) -> list[int]:
        if len(raw) <= PIECE_LEAF:
            return self.merge(raw)
        return self.join_tokens(self.tokens(raw[: len(raw) // 2]), self.tokens(raw[len(raw) // 2 :]))

    def piece(self, text: str) -> Sequence[int]:
        """The ids of one piece: a piece that is a token itself is that token, whatever merges would give."""
        if (known := self.cache.get(text)) is not None:
            return known
        raw = text.encode()
        whole = self.ranks.get(raw)
        found = (whole,) if whole is not None else tuple(self.tokens(raw))
        if len(text) <= REMEMBERED:
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            self.cache[text] = found
        return found

    def _over_cut(self, left: str, left_ids: Sequence[int], right: str, right_ids: Sequence[int]) -> Sequence[int]:
        """The ids of a piece that a cut went through, from the ids of its two parts."""
        if len(left) + len(right) <= REMEMBERED:
            return self.piece(left + right)
        merged = lambda text, ids: ids if len(ids) > 1 else self.merge(text.encode())
        joined = self.join_tokens(merged(left, left_ids), merged(right, right_ids))
        whole = self.ranks.get((left + right).encode())
        return joined if whole is None else (whole,)

    # --- pieces of a text ------------------------------------------------------------------------

    def _leaf(self, text: str) -> tuple[list[str], list[Sequence[int]], int]:
        """The text in parts that start where pieces start, their ids, and how many spaces stand between two parts."""
        words = text.split(" ")
        ids = list(map(self.words.get, words))
        ids[0] = self._word(words[0]) if words[0] else ()
        if None in ids:
            missing = {w for w, found in zip(words, ids, strict=True) if found is None}
            if any(not w or w[0].isspace() for w in missing):  # a space there may belong to a longer run
                pieces = self.split(text)
                return pieces, list(map(self.piece, pieces)), 0
            new = {w: self._word(" " + w) for w in missing}
            ids = [new[w] if found is None and w in new else found for w, found in zip(words, ids, strict=True)]
        return words, ids, 1

    def _word(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece, self.split(text))))

    def learn(self, texts: list[str]) -> None:
        """Encodes the words of texts that are not remembered yet, all at once."""
        if len(self.words) > self.cache_size or len(self.cache) > self.cache_size:
            self.words.clear()
            self.cache.clear()
        blocks = (t[k : k + _CHUNK_BYTES] for t in texts for k in range(0, len(t), _CHUNK_BYTES))
        for block in [" ".join(texts)] if sum(map(len, texts)) <= 2 * _CHUNK_BYTES else blocks:
            words = [w for w in set(block.split(" ")) if w not in self.words and w and len(w) <= REMEMBERED and not w[0].isspace()]
            split = [self.split(" " + w) for w in words]
            pieces = [p for p in set(chain.from_iterable(split)) if p not in self.cache]
            raws = [p.encode() for p in pieces]
            short = [k for k, raw in enumerate(raws) if len(raw) <= PIECE_LEAF]
            for k, ids in zip(short, self.merge_all([raws[k] for k in short]), strict=True):
                whole = self.ranks.get(raws[k])
                self.cache[pieces[k]] = ids if whole is None else (whole,)
            for w, parts in zip(words, split, strict=True):
                self.words[w] = tuple(chain.from_iterable(map(self.piece, parts)))

    def _tree(self, text: str, begin: int, end: int) -> tuple[array, array, array]:
        """Lengths of the parts of ``text[begin:end]``, their numbers of tokens, and all tokens."""
        if end - begin <= max(LEAF, 1):
            parts, ids, space = self._leaf(text[begin:end])
            sizes = np.fromiter(map(len, parts), np.int32, len(parts)) + np.int32(space)
            sizes[0] -= space
            return array("i", sizes.tobytes()), array("i", map(len, ids)), array("i", chain.from_iterable(ids))
        middle = (begin + end) // 2
        return self._join(text, begin, middle, self._tree(text, begin, middle), self._tree(text, middle, end))

    def _join(self, text: str, begin: int, middle: int, left: tuple[array, array, array], right: tuple[array, array, array]) -> tuple[array, array, array]:
        sizes, counts, ids = left
        kept, tail = len(sizes), 0  # parts of the left from ``kept`` on have not seen enough
        while kept and tail < BEHIND:
            kept -= 1
            tail += sizes[kept]
        taken = 4
        while True:
            taken = min(taken, len(right[0]))
            starts = list(accumulate(right[0][:taken], initial=0))
            width = tail + starts[-1]
            pieces = self.split(text[middle - tail : middle + starts[-1]])
            place = {s: k for k, s in enumerate(starts)}
            at = used = 0
            meets = place.get(0) if not tail else None
            for used, piece in enumerate(pieces, 1):  # noqa: B007
                if meets is not None:
                    used -= 1
                    break
                if taken < len(right[0]) and at + len(piece) + BEHIND > width:
                    break
                at += len(piece)
                meets = place.get(at - tail)
            if meets is not None:
                break
            taken *= 2
        window = pieces[:used]
        new = [self.piece(p) if len(p) <= REMEMBERED else None for p in window]
        if None in new:
            last, first = text[middle - tail : middle - tail + sizes[kept]] if kept < len(sizes) else "", text[middle : middle + starts[1]] if taken else ""
            for k, p in enumerate(window):
                if new[k] is None:
                    own = k == 0 and kept == len(sizes) - 1 and p == last + first
                    new[k] = self._over_cut(last, ids[len(ids) - counts[kept] :], first, right[2][: right[1][0]]) if own else self.piece(p)
        stay, gone = len(ids) - sum(counts[kept:]), sum(right[1][:meets])
        return (
            sizes[:kept] + array("i", map(len, window)) + right[0][meets:],
            counts[:kept] + array("i", map(len, new)) + right[1][meets:],
            ids[:stay] + array("i", chain.from_iterable(new)) + right[2][gone:],
        )

    def encode(self, text: str) -> Sequence[int]:
        """The ids of a text, as the library's ``encode_ordinary`` gives them."""
        if len(text) <= LEAF:
            return list(chain.from_iterable(self._leaf(text)[1]))
        return self._tree(text, 0, len(text))[2]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids: leaves are concatenated, then neighbours up the tree."""
        parts = [b"".join(map(self.surface.__getitem__, ids[k : k + LEAF])) for k in range(0, len(ids), LEAF)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""

    def digest(self, ids: Sequence[int]) -> str:
        found = hashlib.sha256()
        for k in range(0, len(ids), LEAF):
            found.update(("," if k else "").encode() + ",".join(map(self.digits.__getitem__, ids[k : k + LEAF])).encode())
        return found.hexdigest()


@lru_cache(maxsize=2)
def load_model(path: str) -> ByteModel:
    return ByteModel(path)


def encode_documents(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, if asked for ``ids`` and ``decoded`` (bytes), and the columns of ``keep``.

    A missing text counts as empty: no id, decoded to nothing. Rows that repeat give equal rows,
    an empty table an empty one; a missing id stays missing; other columns are not read, whatever their names. No
    shuffle: a tree is reduced in its text's task, whose memory is bounded by a batch of texts and some 20 bytes a piece of the longest text.
    """
    rows = docs.select(*map(column, (id_col, text_col, *keep)))
    made = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    made += [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())] * with_ids
    schema = T.StructType([rows.schema.fields[0], *(T.StructField(*m) for m in made), *rows.schema.fields[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(rank_path)
        for batch in text_slices(batches, 1, _CHUNK_BYTES):
            n, digests, back, all_ids, decoded = [], [], [], [], []
            texts = texts_of(batch.column(1))
            model.learn(texts)
            for text in texts:
                ids = model.encode(text)
                raw = model.decode(ids)
                n.append(len(ids))
                digests.append(model.digest(ids))
                back.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    all_ids.append(list(ids))
                    decoded.append(raw)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], names=schema.names)

    return rows.mapInArrow(run, schema)
