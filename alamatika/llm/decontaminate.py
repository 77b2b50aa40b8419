"""Benchmark decontamination: an FM-index per shard of requests, searched for test phrases.

Labelled addresses (label_id, address_raw) that measure accuracy must not occur in request
texts. A phrase is ten consecutive words of a labelled text (all of them, if fewer). Spark
deals requests into shards (the record batches of its partitions, split at ``SHARD_WORDS``); each shard

1. writes its words as symbols, 0 for any word that no phrase has,
2. cuts out stretches of phrase words shorter than the shortest phrase (nothing can occur
   in them), keeps each distinct stretch once and joins them by separators,
3. sorts the suffixes, keeps the last column as a wavelet matrix and every eighth suffix
   position,
4. searches all phrases backward at once through the matrix's ranks, walks each row found
   to the next sampled position, and merges the words hit into removal spans.

Phrases are broadcast in blocks of about ``BLOCK_BYTES`` of labelled text at most (a longer
label is a block of its own), as arrays of some four times that size; larger label sets are
searched block after block and their hits merged per request.

Cases: a null or blank text has no words and is clean; labelled texts without words are no
phrases; labels with equal texts are all reported, repeated label rows once; a null label id
is reported as an empty string; requests with null or repeated ids are treated row by row;
empty tables are fine (without labels everything is clean); further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alamatika.llm.batches import tidy
from alamatika.plans.gazetteer import written

PHRASE_WORDS = 10
SAMPLE_EVERY = 8
SHARD_WORDS = 1_000_000  # words of a shard beyond which the next one begins
BLOCK_BYTES = 4 << 20  # labelled text searched in one pass over the requests

# Words are runs of digits, letters and everything beyond ASCII; A-Z are lowered.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()

_RUN = re.compile(b"[^ ]+")


def _names(words: np.ndarray, width: int) -> np.ndarray:
    """A number for the ``width`` words from each position, equal for equal words: names of
    runs are paired to runs of twice the length, the last two may overlap.
    """
    name, span = words.astype(np.int64), 1
    while span < width:
        step = min(span, width - span)
        pairs = name[:-step] * (int(name.max(initial=0)) + 1) + name[step:]
        name = np.unique(pairs, return_inverse=True)[1]
        span += step
    return name


class Phrases:
    """Phrases of a block of labels, in arrays: symbols of the block's words, the texts as
    symbols, where in them a copy of each phrase begins (by length), and which labels have it.

    ``by_width`` holds (begins, numbers) of the distinct phrases of a length; the labels of
    phrase k are ``owners[owned[k] : owned[k + 1]]``.
    """

    def __init__(self, labels: list[tuple[str, str | None]]):
        self.symbols: dict[bytes, int] = {}
        self.labels = sorted({str(label) for label, _ in labels})
        number = {label: k for k, label in enumerate(self.labels)}
        symbol = self.symbols
        texts = [
            np.array([symbol.setdefault(w, len(symbol) + 1) for w in words_of(text)], dtype=np.int32)
            for _, text in labels
        ]
        whose = np.array([number[str(label)] for label, _ in labels], dtype=np.int64)
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        begins = np.cumsum(lengths) - lengths
        self.words = np.concatenate([*texts, np.empty(0, np.int32)])
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.n, counts, owners = 0, [], []
        widths = np.minimum(lengths, PHRASE_WORDS)
        for width in np.unique(widths[widths > 0]).tolist():
            of = np.flatnonzero(widths == width)
            count = lengths[of] - width + 1
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[of], count)
            _, first, phrase = np.unique(_names(self.words, width)[at], return_index=True, return_inverse=True)
            pairs = np.unique(phrase * len(self.labels) + np.repeat(whose[of], count))
            counts.append(np.bincount(pairs // len(self.labels), minlength=len(first)))
            owners.append((pairs % len(self.labels)).astype(np.int32))
            self.by_width[width] = at[first].astype(np.int32), np.arange(self.n, self.n + len(first), dtype=np.int32)
            self.n += len(first)
        self.owned = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.empty(0, np.int64)]))]).astype(np.int32)
        self.owners = np.concatenate([*owners, np.empty(0, np.int32)])
        self.shortest = min(self.by_width, default=0)

    def within(self, width: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, number) of the phrases of a length all of whose words are ``known``."""
        begins, numbers = self.by_width[width]
        for k in range(width):
            kept = known[self.words[begins + k]]
            begins, numbers = begins[kept], numbers[kept]
        return self.words[begins[:, None] + np.arange(width)].astype(np.int64), numbers


class WaveletMatrix:
    """Symbols in bit planes, high to low; ``rank`` and ``access`` for arrays of positions."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Times each symbol occurs before each position."""
        begin = np.zeros_like(upto)
        for k, level in enumerate(reversed(range(self.levels))):
            high = (symbol >> level) & 1 == 1
            a, b = self.ones[k][begin], self.ones[k][upto]
            begin = np.where(high, self.zeros[k] + a, begin - a)
            upto = np.where(high, self.zeros[k] + b, upto - b)
        return upto - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, begin = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.levels):
            a, b = self.ones[k][begin], self.ones[k][at]
            bit = self.ones[k][at + 1] - b
            symbol = symbol * 2 + bit
            begin = np.where(bit == 1, self.zeros[k] + a, begin - a)
            at = np.where(bit == 1, self.zeros[k] + b, at - b)
        return symbol, at - begin


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    value = symbols[order]
    starts = np.concatenate([[True], value[1:] != value[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    step = 1
    while True:
        alone = starts & np.concatenate([starts[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        held = order[slots]
        later = held + step
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[held]))
        held, first, second = held[by], rank[held][by], second[by]
        order[slots] = held
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        starts[slots] = new
        rank[held] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        step *= 2


class FMIndex:
    """Counts and positions of phrases in one shard's symbols (0 between stretches and at the end)."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.matrix = WaveletMatrix(last)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        # Positions after a separator are kept too: no walk then crosses one.
        self.sampled = (order % SAMPLE_EVERY == 0) | (last == 0)
        self.kept = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase (rows of ``phrases``), searched from its last word."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        known = len(self.before) - 1  # greater symbols are not in this shard
        for k in reversed(range(phrases.shape[1])):
            live = np.flatnonzero(high > low)
            if not len(live):
                break
            word = phrases[live, k]
            inside = np.minimum(word, known - 1)
            base = self.before[inside]
            absent = word >= known
            low[live] = base + self.matrix.rank(inside, low[live])
            high[live] = np.where(absent, low[live], base + self.matrix.rank(inside, high[live]))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled one, then add the steps."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.positions[self.kept[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                symbol, rank = self.matrix.access(at)
                at = self.before[symbol] + rank
            steps += 1
        return out


def occurrences(words: np.ndarray, ends: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(phrase numbers, word positions, width) of all occurrences in a shard.

    ``words`` holds the symbols of all texts, ``ends`` where each text ends.
    """
    n = len(words)
    cut = words == 0
    inner = np.ones(n + 1, dtype=bool)  # no stretch crosses the end of a text
    inner[ends] = False
    begins = np.flatnonzero(~cut & (np.concatenate([[True], cut[:-1]]) | ~inner[:n]))
    stops = np.flatnonzero(~cut & np.concatenate([cut[1:] | ~inner[1:n], [True]])) + 1
    long = stops - begins >= phrases.shortest
    begins, stops = begins[long], stops[long]
    # Equal stretches are indexed once; ``where`` lists the places of each.
    distinct: dict[bytes, int] = {}
    group = np.array(
        [distinct.setdefault(words[a:b].tobytes(), len(distinct)) for a, b in zip(begins, stops)],
        dtype=np.int64,
    )
    if not len(group):
        return
    by_group = np.argsort(group, kind="stable")
    firsts = np.searchsorted(group[by_group], np.arange(len(distinct)))
    sizes = np.diff(np.append(firsts, len(group)))
    pieces, offsets, at = [], [], 0
    for key in distinct:
        stretch = np.frombuffer(key, dtype=words.dtype)
        pieces += [stretch, np.zeros(1, dtype=words.dtype)]
        offsets.append(at)
        at += len(stretch) + 1
    offsets = np.array(offsets)
    joined = np.concatenate(pieces).astype(np.int64)
    index = FMIndex(joined)
    known = np.zeros(len(phrases.symbols) + 1, dtype=bool)
    known[joined] = True
    for width in phrases.by_width:
        rows, numbers = phrases.within(width, known)
        low, high = index.search(rows)
        count = high - low
        which = np.repeat(np.arange(len(rows)), count)
        if not len(which):
            continue
        flat = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        place = index.locate(flat)
        stretch = np.searchsorted(offsets, place, side="right") - 1
        copies = sizes[stretch]
        which, inside, stretch = (np.repeat(x, copies) for x in (which, place - offsets[stretch], stretch))
        nth = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
        yield numbers[which], begins[by_group[firsts[stretch] + nth]] + inside, width


def search_texts(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: number of words, merged removal spans in words, labels that occur."""
    get = phrases.symbols.get
    found = [np.fromiter((get(w, 0) for w in words_of(t)), dtype=np.int32) for t in texts]
    lengths = np.array([len(x) for x in found], dtype=np.int64)
    ends = np.cumsum(lengths)
    words = np.concatenate([*found, np.empty(0, np.int32)])
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    labels: dict[int, set[int]] = {}
    if phrases.shortest and len(words):
        for numbers, at, width in occurrences(words, ends, phrases):
            np.add.at(steps, at, 1)
            np.add.at(steps, at + width, -1)
            texts_hit = np.searchsorted(ends, at, side="right")
            for pair in np.unique(texts_hit * phrases.n + numbers).tolist():
                text, number = divmod(pair, phrases.n)
                of = slice(phrases.owned[number], phrases.owned[number + 1])
                labels.setdefault(text, set()).update(phrases.owners[of].tolist())
    hit = np.cumsum(steps)[:-1] > 0
    out = []
    for k, (end, length) in enumerate(zip(ends.tolist(), lengths.tolist())):
        spans = []
        if k in labels:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[end - length : end], [0]])))
            spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((length, spans, [phrases.labels[x] for x in sorted(labels.get(k, ()))]))
    return out


def _label_blocks(labels: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """Labels in blocks of at most ``BLOCK_BYTES``; one small set is one block.

    Sizes are added up per hash bucket, so a large set is cut without sorting it.
    """
    rows = labels.select(
        F.coalesce(F.col("label_id").cast("string"), F.lit("")).alias("label_id"), "address_raw"
    ).where("address_raw IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("address_raw") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    if blocks > 1:
        rows = written(rows, "labels")
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("label_id", "address_raw"), F.lit(blocks)) == k)
        yield [(r["label_id"], r["address_raw"]) for r in part.collect()]


def _shards(parts: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the texts of column ``text`` exceed about ``SHARD_WORDS`` words."""
    for part in parts:
        size = np.cumsum([0] + [len(t.as_py() or "") // 6 for t in part.column(text)])
        begin = 0
        while begin < part.num_rows:
            end = int(np.searchsorted(size, size[begin] + SHARD_WORDS, side="right")) - 1
            end = min(part.num_rows, max(begin + 1, end))
            yield part.slice(begin, end - begin)
            begin = end


def _search(requests: DataFrame, phrases: Phrases) -> DataFrame:
    id_type = requests.schema["address_id"].dataType.simpleString()
    sent = requests.sparkSession.sparkContext.broadcast(phrases)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for shard in _shards(parts, 1):
            rows = search_texts(shard.column("raw_input").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays(
                [
                    shard.column("address_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"begin": a, "end": b} for a, b in r[1]] for r in rows], kept),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                ],
                ["address_id", "n_words", "spans", "label_ids"],
            )

    return requests.select("address_id", "raw_input").mapInArrow(
        tidy(run),
        f"address_id {id_type}, n_words bigint, "
        "spans array<struct<begin:int,end:int>>, label_ids array<string>",
    )


def find_leaks(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """Per request: ``n_words``, merged removal ``spans`` (words, end exclusive), ``n_hit``
    words inside them and the ``label_ids`` that occur, sorted as strings.
    """
    blocks = _label_blocks(labels)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        found = _search(requests, Phrases(first))
    else:
        found = _search_blocks(requests, itertools.chain([first, second], blocks))
    return found.select(
        "*", F.aggregate(
            "spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"])
        ).alias("n_hit"),
    )


def _search_blocks(requests: DataFrame, blocks: Iterator[list[tuple[str, str | None]]]) -> DataFrame:
    """Hits of several blocks of labels, merged per request by a row number of its own."""
    numbered = written(
        requests.select("address_id", "raw_input")
        .withColumn("row", F.monotonically_increasing_id()), "requests"
    )
    keyed = numbered.select(F.col("row").alias("address_id"), "raw_input")
    return numbered.select("row", "address_id").join(_merged(keyed, blocks), "row").drop("row")


def _merged(keyed: DataFrame, blocks: Iterator[list[tuple[str, str | None]]], least: int = 0) -> DataFrame:
    """(row, n_words, spans, label_ids) over all blocks, for requests with a row number as
    id; only hits of ``least`` spans count.
    """
    parts = [
        written(_search(keyed, Phrases(block)).where(F.size("spans") >= least), "hits") for block in blocks
    ]
    hits = functools.reduce(DataFrame.unionByName, parts)
    merged = hits.groupBy(F.col("address_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("label_ids")))).alias("label_ids"),
    )
    last = lambda done: F.try_element_at(done, F.lit(-1))
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<begin:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (last(done)["end"] >= s["begin"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(
                    last(done)["begin"].alias("begin"),
                    F.greatest(last(done)["end"], s["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return merged.select("row", "n_words", joined.alias("spans"), "label_ids")



def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of each span and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _RUN.finditer(data.translate(_FOLD))]
    out, at = [], 0
    for begin, end in spans:
        out.append(data[at : words[begin][0]])
        at = words[end - 1][1]
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def clean_texts(texts: list[str | None], phrases: Phrases) -> list[str | None]:
    """Texts without test phrases, searched again until none is left, as a cut may join
    words to a new phrase.
    """
    out = list(texts)
    open_ = list(range(len(out)))
    while open_:
        found = search_texts([out[k] for k in open_], phrases)
        hit = [(k, spans) for k, (_, spans, _) in zip(open_, found) if spans]
        for k, spans in hit:
            out[k] = without_spans(out[k], spans)
        open_ = [k for k, _ in hit]
    return out


def remove_leaks(rows: DataFrame, labels: DataFrame, text_column: str = "raw_input") -> DataFrame:
    """The rows, with all their columns, without the removal spans of their texts. A text
    that was nothing but test phrases goes with its row.
    """
    schema, at = rows.schema, rows.columns.index(text_column)

    def remover(phrases: Phrases):
        sent = rows.sparkSession.sparkContext.broadcast(phrases)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in _shards(parts, at):
                texts = shard.column(at).to_pylist()
                clean = clean_texts(texts, sent.value)
                kept = [a == b or bool(words_of(b)) for a, b in zip(texts, clean)]
                columns = list(shard.columns)
                columns[at] = pa.array(clean, columns[at].type)
                whole = pa.RecordBatch.from_arrays(columns, shard.schema.names)
                yield whole.filter(pa.array(kept, pa.bool_()))

        return run

    blocks = _label_blocks(labels)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return rows.mapInArrow(tidy(remover(Phrases(first))), schema)
    return _remove_blocks(rows, labels, text_column, itertools.chain([first, second], blocks))


def _cut(hit: DataFrame) -> DataFrame:
    """(row, raw_input) of hit rows without their spans."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spans = [[(s["begin"], s["end"]) for s in x] for x in part.column("spans").to_pylist()]
            texts = [without_spans(t.as_py(), x) for t, x in zip(part.column("raw_input"), spans)]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(texts, pa.string())], ["row", "raw_input"]
            )

    return hit.select("row", "raw_input", "spans").mapInArrow(tidy(run), "row bigint, raw_input string")


def _remove_blocks(
    rows: DataFrame, labels: DataFrame, text_column: str, blocks: Iterator[list[tuple[str, str | None]]]
) -> DataFrame:
    """As for one block: spans of all blocks are merged before the cut, and the rows that
    changed are searched for all blocks again until none is left.
    """
    numbered = written(rows.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("whole")
    ), "rows")
    open_ = numbered.select("row", F.col("whole")[text_column].alias("raw_input"))
    settled = None  # changed rows in which nothing is found any more
    while True:
        hits = _merged(open_.select(F.col("row").alias("address_id"), "raw_input"), blocks, 1)
        cut = written(_cut(open_.join(hits, "row")), "cut")
        if settled is None:
            settled = cut.limit(0)
        else:
            settled = settled.unionByName(open_.join(cut.select("row"), "row", "left_anti"))
        if cut.isEmpty():
            break
        open_, blocks = cut, _label_blocks(labels)
    changed = written(
        settled.select("row", "raw_input", F.lit(True).alias("changed")), "changed"
    )
    has_word = F.col("raw_input").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    kept = numbered.join(changed, "row", "left").where(F.col("changed").isNull() | has_word)
    return kept.select(*[
        (F.when(F.col("changed"), F.col("raw_input")).otherwise(F.col("whole")[c]) if c == text_column
         else F.col("whole")[c]).alias(c)
        for c in rows.columns
    ])
