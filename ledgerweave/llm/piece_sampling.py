"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding (operator 10).

Every way to cut a text into vocabulary pieces is a path of its lattice; a path weighs the product of its pieces'
weights ``(2 + rank) ** -alpha``, rank being the piece's place in the vocabulary's score order. A forward pass sums
the weights of all prefixes; a backward pass then draws pieces from the end with exactly the path probabilities. The
draws are hashes of (seed, row key, byte position), so a row's segmentation does not depend on partitions, batches
or other rows.

The text is read as UTF-8 after one leading blank. In pieces the blank mark stands for a blank; a character without a
piece of its own falls back to byte pieces (so does a literal U+2581). Decoding joins the pieces' bytes and drops the
leading blank: it gives back every text exactly. Pieces never reach over a blank or a line end, so the lattice of a text
is a chain of word lattices, and each distinct word of a batch gets its lattice once. A word of more than ``LONG`` bytes
(a text without blanks) is worked off on its own, ``RUN`` bytes at a time: the forward pass keeps one sum for each byte,
and the edges of a run are found again, with those that reach into it, when the backward pass comes to it.

Defined results: null text gives null pieces; an empty text gives the pieces of the leading blank; rows with the same
key and text get the same pieces; a null key is a key of its own; other columns are not read; an empty table gives
no rows. Batches are worked off in parts of at most ``PART`` bytes; a longer text is cut at the starts of words, which
changes no piece of it, so memory is bounded by the part and the text itself.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART, LONG, RUN, SLICE = 1_000_000, 512, 1 << 16, 4_000_000
BLANK, LINE = 32, 10
ONE_WORD = re.compile(rb" *[^ \n]*")


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: byte strings, ids and log weights of its pieces, and the ids of the 256 byte pieces."""

    texts: tuple[bytes, ...]
    ids: tuple[int, ...]
    logs: tuple[float, ...]
    bytes_ids: tuple[int, ...]


def load_pieces(model_file: str | None = None, alpha: float = 1.0) -> Pieces:
    """Reads a SentencePiece model with byte fallback; the default is the installed public one."""
    import sentencepiece

    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    every = range(sp.get_piece_size())
    plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    texts = [sp.id_to_piece(i).replace("▁", " ").encode() for i in plain]
    logs = [-alpha * float(np.log(2 + r)) for r in range(len(plain))]
    # pieces that hold a blank after another character, or a line end beside another, never match
    ok = [k for k, t in enumerate(texts) if b" " not in t.lstrip(b" ") and (b"\n" not in t or t == b"\n")]
    of_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
    return Pieces(tuple(texts[k] for k in ok), tuple(plain[k] for k in ok), tuple(logs[k] for k in ok), tuple(of_byte[b] for b in range(256)))


@lru_cache(maxsize=2)
def _trie(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(next state by state and byte, piece by state); states without children have no row and point to -1."""
    children: list[dict[int, int]] = [{}]
    piece = [-1]
    for k, text in enumerate(pieces.texts):
        s = 0
        for b in text:
            if b not in children[s]:
                children[s][b] = len(children)
                children.append({})
                piece.append(-1)
            s = children[s][b]
        piece[s] = k
    inner = [s for s, c in enumerate(children) if c]
    row = np.full(len(children), -1, dtype=np.int32)
    row[inner] = np.arange(len(inner), dtype=np.int32)
    table = np.full((len(inner), 256), -1, dtype=np.int32)
    for s in inner:
        for b, to in children[s].items():
            table[row[s], b] = to
    return table, np.stack([row, np.array(piece, dtype=np.int32)])


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Lattice:
    """Edges of many words, sorted by end node. Node of word w at byte p: base[w] + p."""

    base: np.ndarray
    size: np.ndarray
    start: np.ndarray  # node where an edge begins
    token: np.ndarray
    reach: np.ndarray  # end node + cumulative probability among the edges that end there


def edges(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, token, weight) of all edges of the words buf[begin : begin + size], sorted by end node."""
    table, (row, piece) = _trie(pieces)
    ids, logs = np.array(pieces.ids, dtype=np.int32), np.array(pieces.logs)
    base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    word = np.repeat(np.arange(len(size)), size)
    local = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at = begin[word] + local
    head = (buf[at] & 0xC0) != 0x80
    node, left, pos = (base[word] + local)[head], (size[word] - local)[head], at[head]
    lead = buf[pos]
    chars = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    covered = np.zeros(len(node), dtype=bool)
    starts, ends, tokens, weights = [], [], [], []
    state, live = np.zeros(len(node), dtype=np.int32), np.arange(len(node))
    depth = 0
    while len(live):
        state = table[state, buf[pos[live] + depth]]
        on = state >= 0
        live, state = live[on], state[on]
        depth += 1
        k = piece[state]
        hit = k >= 0
        n = live[hit]
        starts.append(node[n])
        ends.append(node[n] + depth)
        tokens.append(ids[k[hit]])
        weights.append(logs[k[hit]])
        covered[n[chars[n] == depth]] = True
        go = (row[state] >= 0) & (left[live] > depth)
        live, state = live[go], row[state[go]]
    bare = np.flatnonzero(~covered)
    for k in range(4):
        n = bare[chars[bare] > k]
        starts.append(node[n] + k)
        ends.append(node[n] + k + 1)
        tokens.append(np.array(pieces.bytes_ids, dtype=np.int32)[buf[pos[n] + k]])
        weights.append(np.zeros(len(n)))
    start, end, token, weight = (np.concatenate(x) for x in (starts, ends, tokens, weights))
    order = np.argsort(end, kind="stable")
    return start[order], end[order], token[order], weight[order]


def reach_of(start: np.ndarray, end: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """End node + cumulative probability among the edges that end there, of edges sorted by end."""
    p = np.exp(total[start] + weight - total[end])
    run = np.cumsum(p)
    first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, int)
    span = np.diff(np.concatenate([first, [len(end)]]))
    run = np.minimum(run - np.repeat(run[first] - p[first], span), 1.0)
    run[first + span - 1] = 1.0
    return end + run


def build(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, pieces: Pieces) -> Lattice:
    """Forward filtering of the words buf[begin : begin + size]."""
    base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    start, end, token, weight = edges(buf, begin, size, pieces)
    # sums over the edges of one end node, place by place along the words
    place = (end - np.repeat(base, size + 1)[end]) if len(end) else end
    by_place = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[by_place], np.arange(1, int(size.max(initial=0)) + 2))
    total = np.zeros(int((size + 1).sum()))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        e = by_place[i:j]
        if len(e):
            value, to = total[start[e]] + weight[e], end[e]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(value, first)
            span = np.diff(np.concatenate([first, [len(e)]]))
            total[to[first]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, span)), first))
    return Lattice(base, size, start, token, reach_of(start, end, weight, total))


def _runs(word: np.ndarray) -> list[int]:
    """Ends of the runs of a long word, each at the start of a character."""
    cuts = [0]
    while len(word) - cuts[-1] > RUN:
        at = cuts[-1] + RUN
        while word[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
    return [*cuts, len(word)]


def _upto(word: np.ndarray, at: int) -> int:
    """The end of the character that reaches over ``at``."""
    while at < len(word) and word[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(word))


def _forward(word: np.ndarray, pieces: Pieces, reach: int) -> np.ndarray:
    """Log of the summed weight of all ways to cut each prefix of a long word."""
    total = np.full(len(word) + 1, -np.inf)
    total[0] = 0.0
    cuts = _runs(word)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        piece = word[lo : _upto(word, hi + reach)]
        start, end, _, weight = edges(piece, np.array([0]), np.array([len(piece)]), pieces)
        mine = start < hi - lo
        order = np.argsort(start[mine], kind="stable")
        sums = total[lo : lo + len(piece) + 1].tolist()
        # an edge is added when all that end at its start have been
        for a, b, w in zip(start[mine][order].tolist(), end[mine][order].tolist(), weight[mine][order].tolist(), strict=True):
            x, y = sums[a] + w, sums[b]
            if x < y:
                x, y = y, x
            sums[b] = x + math.log1p(math.exp(y - x)) if y > -math.inf else x
        total[lo : lo + len(sums)] = sums
    return total


def sample_long(raw: bytes, stream: np.ndarray, at: int, pieces: Pieces) -> np.ndarray:
    """Token ids of one word, drawn from its whole lattice with memory for a sum a byte and the edges of one run."""
    word, reach = np.frombuffer(raw, dtype=np.uint8), max(4, *map(len, pieces.texts))
    total = _forward(word, pieces, reach)
    out, here, cuts = [], len(word), _runs(word)
    with np.errstate(over="ignore"):
        for lo, hi in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            if here <= lo:
                continue
            first = max(0, lo - reach)
            while word[first] & 0xC0 == 0x80:
                first -= 1
            piece = word[first : _upto(word, hi + reach)]
            start, end, token, weight = edges(piece, np.array([0]), np.array([len(piece)]), pieces)
            mine = (end > lo - first) & (end <= hi - first)
            start, end, token, weight = start[mine], end[mine], token[mine], weight[mine]
            ends = reach_of(start, end, weight, total[first : first + len(piece) + 1]).tolist()
            start, token = start.tolist(), token.tolist()
            node = np.arange(hi - first + 1)
            u = mix64(stream + (node + (at + first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            draw = np.minimum(node + (u >> np.uint64(11)) * 2.0**-53, np.nextafter(node + 1.0, 0.0)).tolist()
            here -= first
            while here > lo - first:
                edge = bisect.bisect_right(ends, draw[here])
                out.append(token[edge])
                here = start[edge]
            here += first
    return np.array(out[::-1], dtype=np.int32)


def words_of(buf: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Starts of words: at a text's start, around line ends, and at the first of a run of blanks."""
    start = np.zeros(len(buf), dtype=bool)
    start[docs] = True
    line = buf == LINE
    start |= line
    start[1:] |= line[:-1] | ((buf[1:] == BLANK) & (buf[:-1] != BLANK))
    return np.flatnonzero(start)


def apart(raw: bytes) -> list[tuple[int, bytes]]:
    """A text in its words of more than ``LONG`` bytes, each on its own, and what lies between, each with its place."""
    if len(raw) <= LONG:
        return [(0, raw)]
    begin = words_of(np.frombuffer(raw, dtype=np.uint8), np.array([0]))
    size = np.diff(np.concatenate([begin, [len(raw)]]))
    more = size > LONG
    cuts = np.unique(np.concatenate([[0], begin[more], begin[more] + size[more], [len(raw)]])).tolist()
    return [(i, raw[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def distinct_words(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a word of each kind, kind of each word), by a polynomial hash that is then checked byte by byte."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max(initial=1)), step, dtype=np.uint64))
        local = np.arange(len(buf)) - np.repeat(begin, size)
        terms = mix64(buf.astype(np.uint64) + np.uint64(1)) * powers[local]
        h = mix64(np.add.reduceat(terms, begin) + size.astype(np.uint64))
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    other = first[kind]
    wrong = size != size[other]
    same = buf == buf[np.minimum(np.repeat(begin[other], size) + local, len(buf) - 1)]
    wrong |= np.add.reduceat((~same).astype(np.int64), begin) > 0
    odd = np.flatnonzero(wrong)  # a hash collision: such words are kinds of their own
    kind[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), kind


def streams(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys.astype(np.uint64) ^ mix64(np.array([seed], dtype=np.uint64)))


def sample(raw: list[bytes], keys: np.ndarray, at: np.ndarray, pieces: Pieces, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all segments end to end, number of tokens of each). A segment of a text with its leading blank
    starts at byte ``at`` of it, where a word starts."""
    parts = [(i, int(at[i]) + a, r) for i, t in enumerate(raw) for a, r in apart(t)]
    if len(parts) == len(raw) and not any(_is_long(r) for _, _, r in parts):
        return sample_short(raw, keys, at, pieces, seed)
    long = [_is_long(r) for _, _, r in parts]
    short = [p for p, is_long in zip(parts, long, strict=True) if not is_long]
    rows = np.array([i for i, _, _ in short], dtype=np.int64)
    ids, n = sample_short([r for _, _, r in short], keys[rows], np.array([a for _, a, _ in short]), pieces, seed) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    found = iter(np.split(ids, np.cumsum(n)[:-1])) if short else iter(())
    stream = streams(keys, seed)
    each = [sample_long(r, stream[i : i + 1], a, pieces) if is_long else next(found) for (i, a, r), is_long in zip(parts, long, strict=True)]
    counts = np.zeros(len(raw), dtype=np.int64)
    np.add.at(counts, [i for i, _, _ in parts], [len(x) for x in each])
    return np.concatenate(each), counts


def _is_long(raw: bytes) -> bool:
    """Whether a part is one long word: other parts that long hold a second word."""
    return len(raw) > LONG and ONE_WORD.fullmatch(raw) is not None


def sample_short(raw: list[bytes], keys: np.ndarray, at: np.ndarray, pieces: Pieces, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``sample`` of segments without long words."""
    lengths = np.array([len(t) for t in raw], dtype=np.int64)
    docs = np.cumsum(lengths) - lengths
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    begin = words_of(buf, docs)
    size = np.diff(np.concatenate([begin, [len(buf)]]))
    kinds, kind = distinct_words(buf, begin, size)
    lattice = build(buf, begin[kinds], size[kinds], pieces)
    order = np.argsort(kind, kind="stable")  # words of a kind together: their edges stay in cache
    doc = np.searchsorted(docs, begin[order], side="right") - 1
    origin, base = begin[order], lattice.base[kind[order]]
    node = base + size[order]
    with np.errstate(over="ignore"):
        stream = streams(keys, seed)[doc]
        offset = (origin - docs[doc] + at[doc] - base).astype(np.uint64)
        out = np.full(len(buf), -1, dtype=np.int32)
        live = np.arange(len(node))
        while len(live):
            here = node[live]
            u = mix64(stream[live] + (offset[live] + here.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
            # below here + 1 even after rounding, so the edge found ends at this node
            draw = np.minimum(here + (u >> np.uint64(11)) * 2.0**-53, np.nextafter(here + 1.0, 0.0))
            edge = np.searchsorted(lattice.reach, draw, side="right")
            back = lattice.start[edge]
            out[origin[live] + back - base[live]] = lattice.token[edge]
            node[live] = back
            live = live[back > base[live]]
    used = out >= 0
    return out[used], np.add.reduceat(used.astype(np.int64), docs)


def decode(ids, pieces: Pieces) -> str:
    table = _byte_table(pieces)
    return b"".join(map(table.__getitem__, ids))[1:].decode()


@lru_cache(maxsize=2)
def _byte_table(pieces: Pieces) -> dict[int, bytes]:
    return dict(zip(pieces.ids, pieces.texts, strict=True)) | {i: bytes([b]) for b, i in enumerate(pieces.bytes_ids)}


def segments(raw: bytes) -> list[tuple[int, bytes]]:
    """A text in pieces of at most ``PART`` bytes that start with words, each with its place; a longer word makes a longer
    piece."""
    if len(raw) <= PART:
        return [(0, raw)]
    begin = words_of(np.frombuffer(raw, dtype=np.uint8), np.array([0]))
    cuts = [0]
    while len(raw) - cuts[-1] > PART:
        k = np.searchsorted(begin, cuts[-1] + PART, side="right")
        k = k if begin[k - 1] <= cuts[-1] else k - 1
        if k == len(begin):
            break
        cuts.append(int(begin[k]))
    return [(i, raw[i:j]) for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def _parts(texts: list[bytes | None]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, place, segment) of at most ``PART`` bytes together, in order."""
    part, n = [], 0
    for i, t in enumerate(texts):
        for at, raw in segments(b" " + t) if t is not None else []:
            if part and n + len(raw) > PART:
                yield part
                part, n = [], 0
            part.append((i, at, raw))
            n += len(raw)
    if part:
        yield part


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``SLICE`` bytes of text, so that texts and pieces of few rows are held."""
    size = pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False)
    turn = np.cumsum(size, dtype=np.int64) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(i, j - i)


def _encoder(pieces: Pieces, seed: int, names: list[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_table(pieces)
        for batch in (s for b in batches for s in _slices(b)):
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            keys = batch.column("__key").to_numpy()
            ids: list[np.ndarray] = []
            counts = np.zeros(len(texts), dtype=np.int64)
            whole = np.ones(len(texts), dtype=bool)
            for part in _parts(texts):
                row = np.array([i for i, _, _ in part])
                got, n = sample([raw for _, _, raw in part], keys[row], np.array([at for _, at, _ in part]), pieces, seed)
                ids.append(got)
                np.add.at(counts, row, n)
                for (i, _, raw), one in zip(part, np.split(got, np.cumsum(n)[:-1]), strict=True):
                    whole[i] &= b"".join(map(table.__getitem__, one.tolist())) == raw
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            none = np.array([t is None for t in texts], dtype=bool)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.concatenate([none, [False]]))
            pieces_col = pa.ListArray.from_arrays(offsets, flat)
            rest = [batch.column(n) for n in names]
            yield pa.record_batch([*rest, pieces_col, pa.array(counts.astype(np.int32)), pa.array(whole)], names=[*names, "__pieces", "__n", "__whole"])

    return encode


def encode_sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, pieces: Pieces | None = None, seed: int = 29) -> DataFrame:
    """``keep`` (the key by default) with ``pieces`` (array of ids), ``n_pieces`` and ``lossless`` (decoding gave the
    text back). A kept column of one of those three names is replaced."""
    pieces = pieces or load_pieces()
    names = [c for c in (keep if keep is not None else [key]) if c not in ("pieces", "n_pieces", "lossless")]
    inner = [f"__c{i}" for i in range(len(names))]
    read = docs.select(*[docs[f"`{c}`"].alias(i) for c, i in zip(names, inner, strict=True)], docs[f"`{text}`"].alias("__text"), F.xxhash64(docs[f"`{key}`"]).alias("__key"))
    kept = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(names, inner, strict=True))
    out = read.mapInArrow(_encoder(pieces, seed, inner), f"{kept + ', ' if kept else ''}__pieces array<int>, __n int, __whole boolean")
    return out.toDF(*names, "pieces", "n_pieces", "lossless")


def op10_piece_sampling(spark, sf_dir: str) -> DataFrame:
    return encode_sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sampled_pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its sampled pieces."""
    return encode_sampled(docs, keep=docs.columns)
