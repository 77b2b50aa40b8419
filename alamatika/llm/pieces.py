"""SentencePiece encoding and decoding of request texts by suffix-array matching.

A batch of texts is normalised and cut where no piece of the vocabulary can cross: between
two characters that no piece has in a row. The distinct stretches are concatenated and their suffixes
sorted; every piece of the vocabulary finds its range of occurrences by binary search. The
occurrences are the edges of the batch; sorted by position they are relaxed:

* unigram models take the best sum of scores that reaches each position,
* BPE models take, for each position, the one edge that merges into the best encoding: a
  sequence is what BPE returns exactly if every two neighbours stay apart when their joint
  text is merged, so each position has one valid last piece, found from the positions
  before it.

A character no piece has becomes its UTF-8 byte pieces (or the unknown piece). Equal
stretches are encoded once a batch; texts are whole, however long.

Cases: a null text has null ids and decodes to null; an empty one has none; repeated rows
and ids are rows of their own; an empty table stays empty; further columns are ignored.
Models with a normalisation table of their own are not taken (ValueError): the vocabulary
files here have none.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from alamatika.llm.batches import tidy

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
BROKEN = re.compile("[\udc80-\udcff]")
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KNOWN_STRETCHES = 300_000  # stretches remembered from batch to batch
INDEX_CHARS = 200_000  # characters indexed at once (or one longer stretch)
BATCH_CHARS = 1_000_000  # characters of a batch beyond which it is cut between texts


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message in the model file."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + size]
        at += size


class Model:
    """Pieces, scores and text rules of a vocabulary file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = b"", b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own.get(2, bytes(4)))[0])
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = value
            elif number == 3:
                normalizer = value
        train, norm = dict(_fields(trainer)), dict(_fields(normalizer))
        if norm.get(2):
            raise ValueError("the vocabulary has a normalisation table")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.trim = bool(norm.get(4, 1))
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = np.isin(self.kinds, (UNKNOWN, CONTROL, BYTE))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.kind = train.get(3, UNIGRAM)
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop what was remembered from batch to batch."""
        self.known.clear()


class Encoder(Model):
    """A vocabulary with the tables that encoding needs."""

    def __init__(self, data: bytes):
        super().__init__(data)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE vocabularies are encoded")
        self.bpe = self.kind == BPE
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        # A text is cut between two characters that no piece has in a row.
        letters = sorted({ord(c) for p in self.ids for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int16)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        # One bit for each pair of letters that some piece has in a row.
        self.n_letters = len(letters) + 1
        in_a_row = np.zeros(self.n_letters**2, dtype=bool)
        for p in self.ids:
            row = self.letter[list(map(ord, p))].astype(np.int64)
            in_a_row[row[:-1] * self.n_letters + row[1:]] = True
        self.in_a_row = np.packbits(in_a_row, bitorder="little")
        usable = self._index_merges() if self.bpe else list(self.ids)
        self.longest = max(map(len, usable), default=1)
        codes = np.zeros((len(usable), self.longest), dtype=np.uint32)
        for row, p in enumerate(usable):
            codes[row, : len(p)] = list(map(ord, p))
        self.codes = codes
        self.widths = np.array([len(p) for p in usable], dtype=np.int64)
        self.edge_ids = np.array([self.ids[p] for p in usable], dtype=np.int64)
        self.score_of = np.array(self.scores)

    def normal(self, text: str) -> str:
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)

    def merge(self, text: str, until: int = 1) -> list[str]:
        """Plain merging of a short text, down to ``until`` parts if it comes so far: the best
        pair first, leftmost of equals.
        """
        parts = list(text)
        rank = self.rank
        while len(parts) > until:
            best, at = min(
                ((rank.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))),
                default=(np.inf, 0),
            )
            if best == np.inf:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _index_merges(self) -> list[str]:
        """Pieces that merging makes, with the two parts each is made of last, and the rank at
        which any two pieces would merge.
        """
        ranks = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        n = len(self.pieces)
        self.place = np.full(n, -1, dtype=np.int64)  # when a piece is formed; letters are there
        self.parts = np.full((n, 2), -1, dtype=np.int64)
        usable, pairs = [], {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = self.ids.get(p[:k]), self.ids.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * n + right] = ranks[self.rank[p]]
            if len(p) == 1:
                usable.append(p)
                continue
            parts = self.merge(p, 2)
            if len(parts) == 2:
                usable.append(p)
                self.place[i] = ranks[self.rank[p]]
                self.parts[i] = [self.ids.get(x, -1) for x in parts]
        self.pair_codes = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[c] for c in self.pair_codes.tolist()], dtype=np.int64)
        return usable

    def stays_apart(self, pairs: np.ndarray) -> np.ndarray:
        """Whether pieces stay apart when merged, for pairs coded left * size + right.

        Their merging is followed back in time: the two parts that meet at the border must
        not merge before either becomes part of its piece. Of equal ranks the left one is
        first. Then the part formed last is undone, until letters meet. A letter that is no
        piece merges with nothing.
        """
        size, forever = len(self.pieces), np.iinfo(np.int64).max
        codes, back = np.unique(pairs, return_inverse=True)
        left, right = codes // size, codes % size
        limit = np.full(len(codes), forever)
        apart = np.ones(len(codes), dtype=bool)
        live = np.arange(len(codes))
        while len(live):
            a, b = left[live], right[live]
            code = a * size + b
            at = np.minimum(np.searchsorted(self.pair_codes, code), max(0, len(self.pair_codes) - 1))
            merged = np.zeros(len(live), dtype=bool)
            if len(self.pair_codes):
                merged = (self.pair_codes[at] == code) & (self.pair_ranks[at] < limit[live])
            apart[live[merged]] = False
            formed_a, formed_b = self.place[a], self.place[b]
            undo_a = formed_a > formed_b
            left[live] = np.where(undo_a, self.parts[a, 1], a)
            right[live] = np.where(undo_a, b, self.parts[b, 0])
            limit[live] = np.where(undo_a, formed_a, formed_b + 1)
            letters = (formed_a < 0) & (formed_b < 0)
            live = live[~merged & ~letters & (left[live] >= 0) & (right[live] >= 0)]
        return apart[back]


@lru_cache(maxsize=2)
def _loaded(kind: type[Model], data: bytes) -> Model:
    return kind(data)


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` codes (ties in any order).

    As many codes as fit one word are packed into the first key; then the sorted width is
    doubled by joining the ranks of neighbours.
    """
    n = len(codes)
    letters, dense = np.unique(codes, return_inverse=True)
    bits = int(len(letters)).bit_length()
    width = max(1, min(62 // bits, depth))
    padded = np.concatenate([dense.astype(np.int64) + 1, np.zeros(width, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    while True:
        order = np.argsort(key)
        value = key[order]
        if width >= depth:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
        later = np.zeros(n, dtype=np.int64)
        later[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + later
        width *= 2


def match_edges(codes: np.ndarray, model: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, id) of every occurrence of every piece."""
    n = len(codes)
    order = suffix_order(codes, model.longest)
    padded = np.concatenate([codes, np.zeros(model.longest, dtype=codes.dtype)])

    def bisect(low: np.ndarray, high: np.ndarray, want: np.ndarray, k: int, after: bool) -> np.ndarray:
        """First suffix of each range whose code k is not below (``after``: is above)."""
        low, high = low.copy(), high.copy()
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) // 2
            value = padded[order[middle] + k]
            right = value <= want[todo] if after else value < want[todo]
            low[todo] = np.where(right, middle + 1, low[todo])
            high[todo] = np.where(right, high[todo], middle)
        return low

    begins = np.zeros(len(model.widths), dtype=np.int64)
    ends = np.full(len(model.widths), n, dtype=np.int64)
    for k in range(model.longest):  # each piece's range narrows by its next code
        live = np.flatnonzero((model.widths > k) & (begins < ends))
        if not len(live):
            break
        want, low, high = model.codes[live, k], begins[live], ends[live]
        begins[live] = bisect(low, high, want, k, False)
        ends[live] = bisect(low, high, want, k, True)
    count = np.maximum(ends - begins, 0)
    piece = np.repeat(np.arange(len(count)), count)
    flat = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + begins[piece]
    start = order[flat]
    end = start + model.widths[piece]
    return start, end, model.edge_ids[piece]


def encode_stretches(stretches: list[str], model: Encoder) -> list[bytes]:
    """Piece ids of each stretch, as 32-bit words. Edges are sorted by the position where
    they end in their stretch, and all stretches are relaxed side by side.
    """
    if not stretches:
        return []
    joined = "\0".join(stretches) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(s) for s in stretches], dtype=np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    start, end, ids = match_edges(codes, model)
    # One-character edges of an unknown kind where no piece covers the character itself.
    single = np.zeros(len(codes) + 1, dtype=bool)
    single[start[end - start == 1]] = True
    inside = np.ones(len(codes), dtype=bool)
    inside[first + lengths] = False
    alone = np.flatnonzero(inside & ~single[:-1])
    start = np.concatenate([start, alone])
    end = np.concatenate([end, alone + 1])
    ids = np.concatenate([ids, np.full(len(alone), -1)])
    origin = np.repeat(first, lengths + 1)
    step = end - origin[start]  # positions of all stretches with one distance are relaxed at once
    by = np.argsort(step.astype(np.int16), kind="stable") if lengths.max() < 1 << 15 else np.argsort(step)
    start, end, ids, step = start[by], end[by], ids[by], step[by]
    last = np.full(len(codes) + 1, -2, dtype=np.int64)  # id that reaches a position
    came = np.zeros(len(codes) + 1, dtype=np.int64)
    best = np.full(len(codes) + 1, -np.inf)
    last[first] = -3
    best[first] = 0
    bounds = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]]))
    worst = model.score_of.min() - 10
    size = len(model.pieces)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s, e, piece = start[a:b], end[a:b], ids[a:b]
        if model.bpe:
            before = last[s]
            good = before != -2
            both = good & (before >= 0) & (piece >= 0)
            if both.any():
                good[both] = model.stays_apart(before[both] * size + piece[both])
            last[e[good]] = piece[good]
            came[e[good]] = s[good]
        else:
            total = best[s] + np.where(piece >= 0, model.score_of[piece], worst)
            order = np.lexsort((-s, total))  # the greatest sum of each end is written last
            e, s, piece, total = e[order], s[order], piece[order], total[order]
            last[e], came[e], best[e] = piece, s, total
    # Back from the ends, again side by side; a step of every open stretch at a time.
    owner, picked, at, live = [], [], first + lengths, np.flatnonzero(lengths)
    while len(live):
        owner.append(live)
        picked.append(last[at[live]])
        at[live] = came[at[live]]
        live = live[at[live] > first[live]]
    if not owner:
        return [b""] * len(stretches)
    owner, picked = np.concatenate(owner)[::-1], np.concatenate(picked)[::-1].astype(np.int32)
    by = np.argsort(owner, kind="stable")
    packed = picked[by].tobytes()
    sizes = np.bincount(owner, minlength=len(stretches))
    ends = (4 * np.cumsum(sizes)).tolist()
    out = [packed[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    for k in np.unique(owner[picked < 0]).tolist():
        out[k] = _with_unknowns(stretches[k], np.frombuffer(out[k], dtype=np.int32).tolist(), model)
    return out


def _with_unknowns(text: str, ids: list[int], model: Model) -> bytes:
    """Ids with byte pieces (or one unknown piece per run) for characters without a piece."""
    out, at = [], 0
    for i in ids:
        if i >= 0:
            out.append(i)
            at += len(model.pieces[i])
            continue
        if model.bytes:
            out += [model.bytes[x] for x in text[at].encode("utf-8", "surrogatepass")]
        elif not out or out[-1] != model.unknown:
            out.append(model.unknown)
        at += 1
    return np.array(out, dtype=np.int32).tobytes()


def _stretches(text: str, model: Encoder) -> list[str]:
    """A normalised text, cut where no piece can cross."""
    letter = model.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    pair = letter[:-1].astype(np.int64) * model.n_letters + letter[1:]
    joined = (model.in_a_row[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1
    cuts = (np.flatnonzero(joined == 0) + 1).tolist()
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if text else []


def encode_texts(texts: list[str | None], model: Encoder) -> list[np.ndarray | None]:
    """Ids of each text. Stretches of earlier batches are remembered, up to a bound."""
    known = model.known
    if len(known) > KNOWN_STRETCHES:
        known.clear()
    own = [None if t is None else _stretches(model.normal(t), model) for t in texts]
    new = list(set().union(*(x for x in own if x)) - known.keys())
    ends = np.cumsum([len(x) + 1 for x in new])
    begin = 0
    while begin < len(new):
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + INDEX_CHARS, side="right"))
        end = max(begin + 1, end)
        known.update(zip(new[begin:end], encode_stretches(new[begin:end], model)))
        begin = end
    return [
        None if x is None else np.frombuffer(b"".join(map(known.__getitem__, x)), dtype=np.int32)
        for x in own
    ]


def decode_ids(ids: np.ndarray | None, model: Model) -> str | None:
    """Text of ids: runs of byte pieces are read as UTF-8, blank marks become spaces."""
    if ids is None:
        return None
    out, at = [], 0
    special = np.flatnonzero(model.special[ids])
    if len(special):  # runs of special pieces among the others
        first = np.flatnonzero(np.diff(special, prepend=-2) != 1)
        for begin, end in zip(special[first].tolist(), special[[*(first[1:] - 1), -1]].tolist()):
            out += map(model.pieces.__getitem__, ids[at:begin].tolist())
            out += _special_text(ids[begin : end + 1].tolist(), model)
            at = end + 1
    out += map(model.pieces.__getitem__, ids[at:].tolist())
    text = "".join(out).replace(BLANK, " ")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def _special_text(ids: list[int], model: Model) -> list[str]:
    """Text of a run of byte, unknown and control pieces."""
    out, run = [], bytearray()
    for i in [*ids, None]:
        if i in model.byte_of:
            run.append(model.byte_of[i])
            continue
        if run:
            # Every byte of what is no character shows as one replacement character.
            out.append(BROKEN.sub("\ufffd", run.decode("utf-8", "surrogateescape")))
            run = bytearray()
        if i is not None and model.kinds[i] == UNKNOWN:
            out.append(" \u2047 ")
    return out


def _batches(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum([0] + [len(t.as_py() or "") for t in part.column("raw_input")])
    begin = 0
    while begin < part.num_rows:
        end = int(np.searchsorted(size, size[begin] + BATCH_CHARS, side="right")) - 1
        end = min(part.num_rows, max(begin + 1, end))
        yield part.slice(begin, end - begin)
        begin = end


def _mapped(df: DataFrame, vocabulary: str, kind: type[Model], schema: str, change) -> DataFrame:
    """``change(batch, model)`` over all record batches; the vocabulary file is broadcast."""
    with open(vocabulary, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(kind, data.value)
        try:
            for part in parts:
                yield from change(part, model)
        finally:
            model.forget()  # workers outlive their task and may wait beside others

    id_type = df.schema["address_id"].dataType.simpleString()
    return df.mapInArrow(tidy(run), f"address_id {id_type}, {schema}")


def encode_requests(requests: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(address_id, ids): the piece ids of each whole text."""

    def change(part: pa.RecordBatch, model: Encoder) -> Iterator[pa.RecordBatch]:
        for batch in _batches(part):
            ids = encode_texts(batch.column("raw_input").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("address_id"), pa.array(ids, pa.list_(pa.int32()))],
                ["address_id", "ids"],
            )

    return _mapped(requests.select("address_id", "raw_input"), vocabulary, Encoder, "ids array<int>", change)


def decode_requests(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(address_id, ids, raw_input): ids with the texts that they stand for."""

    def change(part: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
        ids = part.column("ids")
        texts = [decode_ids(None if x.values is None else x.values.to_numpy(), model) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [part.column("address_id"), ids, pa.array(texts, pa.string())],
            ["address_id", "ids", "raw_input"],
        )

    return _mapped(
        encoded.select("address_id", "ids"), vocabulary, Model, "ids array<int>, raw_input string", change
    )
