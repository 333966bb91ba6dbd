"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut where no piece can reach across (before a run of U+2581, the mark for a space); the distinct
chunks that aren't known yet are joined into one byte string, which is indexed by a suffix array. Every piece is looked
up in it by binary search, which gives the range of all its occurrences; the occurrences, as edges (position, piece), are
sorted by position. Then the edges are relaxed: all chunks at once, each round joins in every chunk the neighbouring pair
of symbols whose joined edge scores best (leftmost among equals), until no pair has an edge. Symbols that are no piece
fall back to bytes. That gives exactly the ids of the model, which is of the BPE kind with byte fallback.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Memo, held, texts

SPACE = "▁".encode()
CHUNK = re.compile(rb"(?:\xe2\x96\x81)*(?:(?!\xe2\x96\x81).)*", re.S)
#: A chunk of more symbols is relaxed on its own with a heap.
LONG = 256
#: Bits of an edge: its piece's id, and its bytes.
START, WIDE = 20, 10


class Model:
    """Pieces and scores of a SentencePiece BPE model with byte fallback and no normalisation but the space mark."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i).encode() for i in range(sp.vocab_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(sp.vocab_size())]
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else p for i, p in enumerate(self.pieces)]
        self.ids = np.array([i for i, s in enumerate(special) if not s])
        self.width = max(len(self.pieces[i]) for i in self.ids.tolist())
        self.sorted = np.array([self.pieces[i] for i in self.ids.tolist()], f"S{self.width}")
        self.lengths = np.array([len(self.pieces[i]) for i in self.ids.tolist()])
        padded = self.sorted.astype(f"S{max(8, self.width)}")
        head = np.frombuffer(padded.tobytes(), np.uint8).reshape(len(padded), -1)[:, :8].copy()
        self.least = head.copy().view(">u8").ravel().astype(np.uint64)
        head[np.arange(8)[None, :] >= self.lengths[:, None]] = 0xFF  # no byte of UTF-8 is as high
        self.most = head.view(">u8").ravel().astype(np.uint64)
        scores = np.array([sp.get_score(i) for i in self.ids.tolist()])
        self.rank = np.empty(len(self.pieces), np.int64)
        self.rank[self.ids] = np.unique(-scores, return_inverse=True)[1]  # equal scores tie; lower is better

    # ------------------------------------------------------------------------------------------------------- encoding

    def occurrences(self, text: bytes) -> np.ndarray:
        """Every occurrence of every piece in ``text`` as (start, bytes, id) packed in START, WIDE and the lowest bits; sorted."""
        data = np.frombuffer(text + b"\0" * (self.width + 8), np.uint8)
        heads = np.lib.stride_tricks.sliding_window_view(data, 8)
        suffixes = np.arange(len(text))
        value = heads[: len(text)].copy().view(">u8").ravel().astype(np.uint64)
        suffixes = np.argsort(value, kind="stable")
        first = value[suffixes]
        # Suffixes that share eight bytes are sorted by the next eight, and so on up to the longest piece.
        group = np.concatenate([[0], np.cumsum(first[1:] != first[:-1])])
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        for at in range(8, self.width, 8):
            if not len(tied):
                break
            own = suffixes[tied]
            nxt = heads[np.minimum(own + at, len(heads) - 1)].copy().view(">u8").ravel().astype(np.uint64)
            by = np.lexsort((nxt, group[tied]))
            suffixes[tied] = own[by]
            nxt, g = nxt[by], group[tied][by]
            new = np.concatenate([[0], np.cumsum((nxt[1:] != nxt[:-1]) | (g[1:] != g[:-1]))])
            tied, group_of = tied[keep := np.bincount(new)[new] > 1], new[keep]
            group[tied] = group_of
        # Every piece's range: binary searches by eight bytes, then, within it, of longer pieces byte for byte.
        low, high = np.searchsorted(first, self.least, "left"), np.searchsorted(first, self.most, "right")
        for k in np.flatnonzero((self.lengths > 8) & (high > low)).tolist():
            piece = self.pieces[self.ids[k]]
            lo, hi, n = int(low[k]), int(high[k]), len(piece)
            for after in (False, True):
                x, y = lo, hi
                while x < y:
                    mid = (x + y) // 2
                    seen = text[suffixes[mid] : suffixes[mid] + n]
                    x, y = (mid + 1, y) if (seen <= piece if after else seen < piece) else (x, mid)
                if after:
                    high[k] = x
                else:
                    low[k] = x
        n = high - low
        start = suffixes[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.sort((start << (WIDE + START)) | np.repeat((self.lengths << START) | self.ids, n))

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, as little-endian unsigned 32-bit integers."""
        # U+0000 is in no piece: it separates the chunks.
        text = b"\0".join(chunks) + b"\0"
        packed = self.occurrences(text)
        edge, ids = packed >> START, packed & ((1 << START) - 1)  # (start, bytes) and the piece
        data = np.frombuffer(text, np.uint8)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes + 1) - 1
        chars = (data & 0xC0) != 0x80  # the first byte of each character
        chars[ends] = False
        pos = np.flatnonzero(chars)
        chunk = np.searchsorted(ends, pos, "right")
        nxt = np.concatenate([pos[1:], [len(text)]])
        end = np.minimum(nxt, ends[chunk])
        count = np.bincount(chunk, minlength=len(chunks))
        long = count > LONG
        done_pos, done_end, done_chunk = [], [], []
        for c in np.flatnonzero(long).tolist():
            p = self._relax_long(pos[chunk == c], int(ends[c]), edge, ids)
            done_pos.append(p)
            done_end.append(np.append(p[1:], ends[c]))
            done_chunk.append(np.full(len(p), c))
        keep = ~long[chunk] if len(chunk) else np.zeros(0, bool)
        pos, end, chunk = pos[keep], end[keep], chunk[keep]
        while len(pos) > 1:
            length = end[1:] - pos[:-1]
            pair = np.flatnonzero((chunk[1:] == chunk[:-1]) & (length <= self.width))
            at, fits = _find(edge, (pos[pair] << WIDE) | length[pair])
            pair, at = pair[fits], at[fits]
            if not len(pair):
                break
            # The best pair of each chunk, the leftmost among equals: a minimum over the chunk's run of pairs.
            value = (self.rank[ids[at]] << 40) | pair
            runs = np.flatnonzero(np.concatenate([[True], chunk[pair][1:] != chunk[pair][:-1]]))
            best = np.minimum.reduceat(value, runs) & ((1 << 40) - 1)
            # Chunks without a pair are settled.
            active = np.zeros(len(chunks), bool)
            active[chunk[best]] = True
            end[best] = end[best + 1]
            alive = np.ones(len(pos), bool)
            alive[best + 1] = False
            settled = alive & ~active[chunk]
            if settled.any():
                done_pos.append(pos[settled])
                done_end.append(end[settled])
                done_chunk.append(chunk[settled])
                alive &= ~settled
            pos, end, chunk = pos[alive], end[alive], chunk[alive]
        pos, end, chunk = (np.concatenate([*d, x]) for d, x in ((done_pos, pos), (done_end, end), (done_chunk, chunk)))
        by = np.argsort(pos, kind="stable")
        pos, end, chunk = pos[by], end[by], chunk[by]
        at, known = _find(edge, (pos << WIDE) | np.minimum(end - pos, self.width + 1))
        size = np.where(known, 1, end - pos)
        out = np.zeros(int(size.sum()), "<u4")
        slot = np.cumsum(size) - size
        out[slot[known]] = ids[at[known]]
        for i in np.flatnonzero(~known).tolist():
            out[slot[i] : slot[i] + size[i]] = [self.bytes_at[b] for b in data[pos[i] : end[i]].tolist()]
        total = np.bincount(chunk, size, len(chunks)).astype(np.int64)
        stop = np.cumsum(total)
        return [out[a:b].tobytes() for a, b in zip((stop - total).tolist(), stop.tolist(), strict=True)]

    def _relax_long(self, pos: np.ndarray, stop: int, edge: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The same relaxation for one long chunk: a heap of joinable pairs instead of rounds."""
        n = len(pos)
        start, nxt, prv, alive = pos.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        after = [*start[1:], stop]  # end of each symbol
        heap: list[tuple[int, int, int]] = []

        def offer(keys: list[tuple[int, int]]) -> None:
            at, fits = _find(edge, np.array([(start[a] << WIDE) | min(after[b] - start[a], self.width + 1) for a, b in keys]))
            for (a, b), x, fit in zip(keys, at.tolist(), fits.tolist(), strict=True):
                if fit:
                    heapq.heappush(heap, (int(self.rank[ids[x]]), start[a], a, after[b]))

        if n > 1:
            offer([(i, i + 1) for i in range(n - 1)])
        while heap:
            _, _, a, end = heapq.heappop(heap)
            b = nxt[a]
            if not alive[a] or b >= n or after[b] != end:
                continue
            after[a], alive[b], nxt[a] = end, False, nxt[b]
            if nxt[b] < n:
                prv[nxt[b]] = a
            near = [(x, y) for x, y in ((prv[a], a), (a, nxt[a])) if x >= 0 and y < n]
            if near:
                offer(near)
        return np.array([s for s, k in zip(start, alive, strict=True) if k], np.int64)

    # ------------------------------------------------------------------------------------------------------- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that aren't UTF-8 become U+FFFD, and the first space mark goes."""
        text = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace("▁", " ")
        return text[1:] if text.startswith(" ") else text


def _find(edge: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would be in the sorted edges, and whether it is there."""
    if not len(edge):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(edge, keys), len(edge) - 1)
    return at, edge[at] == keys


def chunks_of(text: bytes) -> list[bytes]:
    """The chunks of a text. Each begins with the space mark, which is left out, or with a line break, which is a byte of
    its own in any encoding."""
    if not text:
        return []
    if b"  " in text or SPACE in text or text.startswith(b" ") or text.endswith(b" "):
        found = [c[3:] for c in CHUNK.findall(SPACE + text.replace(b" ", SPACE)) if c]
        return [k for c in found for k in ((b"", c) if c.startswith(b"\n") else (c,))]
    return text.replace(b"\n", b" \n").split(b" ")


def encode_all(model: Model, memo: Memo, batch: list[bytes]) -> Iterator[bytes]:
    chunked = [chunks_of(t) for t in batch]
    memo.learn([c for cs in chunked for c in cs])
    for cs in chunked:
        yield b"".join(map(memo.__getitem__, cs))


def loaded(path: str) -> tuple[Model, Memo]:
    """The model of a file and what this worker learned under it, kept from task to task."""

    def load() -> tuple[Model, Memo]:
        model = Model(path)
        return model, memo_of(model)

    return held(("pieces", path), load)


def memo_of(model: Model) -> Memo:
    return Memo(lambda chunks: model.encode_chunks([c if c.startswith(b"\n") else SPACE + c for c in chunks]), slice_=32_000)


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, ``ids`` (array of int, without begin and end marks) and ``decodes`` (whether they give the text back).

    Null and empty texts have no ids. U+2581 in a text comes back as a space, so such a text doesn't decode to itself.
    Repeated rows and null keys stay, other columns are ignored, no rows give no rows.
    """

    def run(batches):
        m, memo = loaded(model)
        for part, chunk in texts(batches, keep=True):
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in encode_all(m, memo, chunk)]
            back = [m.decode(i) == t.decode("utf-8", "replace") for i, t in zip(ids, chunk, strict=True)]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(back, pa.bool_())], names=["k", "ids", "decodes"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>, decodes boolean").withColumnRenamed("k", key)


def decode(df: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Each row's key and ``text``, decoded from an array of ids; null ids give a null text, ids beyond the model fail."""

    def run(batches):
        m, _ = loaded(model)
        for b in batches:
            out = [None if x is None else m.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["k", "text"])

    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, text string").withColumnRenamed("k", key)
