"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages of words. Hashed TF-IDF vectors of passages
are projected on the leading right singular vectors of a passage matrix, found by a
distributed randomised SVD; passages whose cosine with a benchmark item is high are
candidates. A candidate is confirmed by the longest common subsequence of words and,
where only part of the item is there, by the item's answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.grams import runs
from tamarack.llm.words import word_hashes
from tamarack.session import stage, unstage

BITS = 14
RANK = 128
OVERSAMPLE = 8
# Passes over the fitting passages; each multiplies by the matrix and its transpose.
POWER_PASSES = 2
# Rows of the basis that the driver makes orthonormal at once.
QR_ROWS = 2048
# A task multiplies so many passages at most, and at least so many where there are more tasks than cores need:
# its product is as large as the basis.
MOST_PASSAGES = 500_000
LEAST_PASSAGES = 20_000
# Passages that are multiplied at once, rows that are gathered at once, and passages in one stored row.
PASSAGES_AT_ONCE = 8192
GATHERED = 4096
STORED = 1024
# Passages are made of whole blocks of words; an item is sought in passages of the first size that holds it.
BLOCK = 8
SIZES = (16, 24, 32, 48, 64)
FIT_SIZE = 64
# Share of the cosine that the least confirmed part of an item has in a passage if all words weigh the same.
# The rest allows for words that weigh less, passages that cut the part, and the latent space.
COSINE_SHARE = 0.6
# Share of an item's words, in order, that confirms it alone, and with at least half of its answer.
WHOLE_SHARE = 0.8
PART_SHARE = 0.5
ANSWER_WORDS = 6
ANSWER_SHARE = 0.5
# Items with fewer words must be there whole.
SHORT_ITEM = 8
# Kinds of words that are told apart when those common to an item and a passage are counted at first.
KINDS = 1024
# Rows without words between two texts, and rows that are searched together.
TAIL = SIZES[-1] // BLOCK - 1
ROWS_AT_ONCE = 2048
# Items that are held by a task at once; more are sought in several passes.
ITEMS_AT_ONCE = 20_000
RUN_CHARS = 1 << 17
SEED = 7


def _rows(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in rows of a block each, the text of every row and its first word.

    Every text begins a row of its own. ``TAIL`` rows without words follow it, so that
    no passage goes on into the next text. A place without a word is -1, and so is the
    text of a row without words.
    """
    sizes = np.diff(first)
    n = -(-sizes // BLOCK)
    begin = np.concatenate([[0], np.cumsum(n + TAIL)])
    places = np.full((int(begin[-1]), BLOCK), -1)
    of_word = np.repeat(np.arange(len(sizes)), sizes)
    places.reshape(-1)[np.arange(len(words)) - first[of_word] + begin[of_word] * BLOCK] = np.arange(len(words))
    owner = np.repeat(np.arange(len(sizes)), n + TAIL)
    owner[places[:, 0] < 0] = -1
    return places, owner, begin


def _passages(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Passage, bucket and count of every word of the disjoint passages that counts and fits are made on."""
    sizes = np.diff(first)
    n = -(-sizes // FIT_SIZE)
    begin = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    passage = begin[owner] + (np.arange(len(words)) - first[owner]) // FIT_SIZE
    keys = (passage << BITS) | (words >> np.uint64(64 - BITS)).astype(np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    return keys >> BITS, keys & ((1 << BITS) - 1), counts, int(begin[-1])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    for start, end in runs(texts, RUN_CHARS):
        yield start, end, texts[start:end]


def passage_rows(docs: DataFrame) -> DataFrame:
    """``n, sizes, buckets, counts``: all passages of all documents, some in each row, as a sparse matrix.

    ``n`` is the number of passages, ``sizes`` has the number of buckets of each (a byte each), ``buckets``
    (two bytes) and ``counts`` (one) are those of one passage after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _texts(batch):
                words, first, *_ = word_hashes(texts)
                passage, buckets, counts, n = _passages(words, first)
                sizes = np.bincount(passage, minlength=n)
                starts = np.searchsorted(passage, np.arange(0, n + STORED, STORED))
                rows = []
                for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    own = sizes[k * STORED : (k + 1) * STORED].astype(np.uint8)
                    stored = buckets[a:b].astype(np.uint16), counts[a:b].astype(np.uint8)
                    if len(own):
                        rows.append((len(own), own.tobytes(), *(c.tobytes() for c in stored)))
                columns = [*zip(*rows, strict=True)] or [[]] * 4
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["n", "sizes", "buckets", "counts"]
                )

    return docs.select("text").mapInArrow(run, "n long, sizes binary, buckets binary, counts binary")


def inverse_frequencies(docs: DataFrame, passages: DataFrame | None = None) -> np.ndarray:
    """Of every bucket, over all passages of all documents. Buckets that never occur weigh most.

    ``passages`` are the ``passage_rows`` of the documents, if they are stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for n, buckets in zip(batch.column("n").to_pylist(), batch.column("buckets"), strict=True):
                held[: 1 << BITS] += np.bincount(np.frombuffer(buckets.as_buffer(), np.uint16), minlength=1 << BITS)
                held[-1] += n  # the number of passages comes as one more bucket
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], ["bucket", "n"])

    if passages is None:
        passages = passage_rows(docs)
    counts = passages.select("n", "buckets").mapInArrow(run, "bucket long, n long")
    held = np.zeros((1 << BITS) + 1)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        held[row["bucket"]] = row["n"]
    return np.log((held[-1] + 1) / (held[:-1] + 1)) + 1


def _sums(table: np.ndarray, index: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of rows of the table, each times its value; so many neighbouring ones make a sum as ``sizes`` says.

    Sums of about as many rows are made at once, as one product of stacked matrices.
    """
    out = np.zeros((len(sizes), table.shape[1]), np.float32)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes.astype(np.min_scalar_type(int(sizes.max(initial=0)))), kind="stable")
    order = order[np.searchsorted(sizes[order], 1) :]
    ends = len(order)
    spare = np.empty((max(GATHERED, int(sizes.max(initial=0))), table.shape[1]), np.float32)
    while ends:
        most = int(sizes[order[ends - 1]])
        own = order[max(ends - max(GATHERED // most, 1), 0) : ends]
        ends -= len(own)
        places = starts[own][:, None] + np.arange(most)
        short = places >= (starts + sizes)[own][:, None]
        if short.any():
            places[short] = 0
        weight = value[places]
        weight[short] = 0
        rows = table.take(index[places.ravel()], axis=0, out=spare[: places.size], mode="clip")
        out[own] = np.matmul(weight[:, None, :], rows.reshape(len(own), most, -1))[:, 0]
    return out


def _orthonormal(rows: np.ndarray) -> np.ndarray:
    """The rows, made an orthonormal basis of their columns in place: blocks of them first, then what these leave."""
    width = rows.shape[1]
    parts = [rows[k : k + QR_ROWS] for k in range(0, len(rows), QR_ROWS)]
    left = []
    for part in parts:
        part[:], rest = np.linalg.qr(part)
        left.append(rest)
    turn = np.linalg.qr(np.concatenate(left))[0]
    for k, part in enumerate(parts):
        part[:] = part @ turn[k * width : (k + 1) * width]
    return rows


def _product(basis: np.ndarray, weights: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The transpose of some passages times these times the basis."""
    value = counts * weights[buckets]
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    value /= np.sqrt(np.bincount(of, value**2, minlength=len(sizes)).astype(np.float32))[of]
    rows = _sums(basis, buckets, value, sizes)
    # By bucket; the sort of two-byte numbers takes time in proportion.
    order = np.argsort(buckets, kind="stable")
    return _sums(rows, of[order], value[order], np.bincount(buckets, minlength=len(basis)))


def singular_vectors(
    docs: DataFrame, weights: np.ndarray, passages: DataFrame | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of the TF-IDF matrix of passages, one row for each bucket, and their values.

    All passages of all documents are rows of the matrix. Every task multiplies its
    passages with the current basis and the transpose of its passages with the result;
    the products are added up by ranges of buckets. ``passages`` are the
    ``passage_rows`` of the documents, if they are stored.
    """
    held = stage(passage_rows(docs), "passages") if passages is None else passages
    context = docs.sparkSession.sparkContext
    n = held.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-n // MOST_PASSAGES), min(context.defaultParallelism, -(-n // LEAST_PASSAGES)))
    width = RANK + OVERSAMPLE
    basis = _orthonormal(np.random.default_rng(SEED).standard_normal((1 << BITS, width)))
    chunk = 256
    for step in range(POWER_PASSES + 1):
        shared = context.broadcast((basis.astype(np.float32), weights.astype(np.float32)))

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, idf = shared.value
            product = np.zeros((1 << BITS, width))
            names, kinds = ["sizes", "buckets", "counts"], [np.uint8, np.uint16, np.uint8]
            held, n = [], 0

            def joined() -> np.ndarray:
                columns = zip(*held, strict=True)
                sizes, buckets, counts = (np.frombuffer(b"".join(c), k) for c, k in zip(columns, kinds, strict=True))
                return _product(own, idf, sizes.astype(int), buckets, counts)

            for batch in batches:
                for rows, *row in zip(*(batch.column(c).to_pylist() for c in ["n", *names]), strict=True):
                    held.append(row)
                    n += rows
                    if n >= PASSAGES_AT_ONCE:
                        product += joined()
                        held, n = [], 0
            if held:
                product += joined()
            parts = [product[k : k + chunk].astype(np.float32).tobytes() for k in range(0, 1 << BITS, chunk)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array(parts, pa.binary())],
                                             ["part", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, np.float32) for b in table.column("sums").to_pylist())
            return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        dealt = held.coalesce(tasks).mapInArrow(multiply, "part long, sums binary")
        parts = dealt.groupBy("part").applyInArrow(add, "part long, sums binary").orderBy("part").collect()
        shared.destroy()
        # The basis is needed beside the last product only.
        product = basis if step < POWER_PASSES else np.empty((1 << BITS, width))
        product[:] = 0
        for r in parts:
            product[r["part"] * chunk : (r["part"] + 1) * chunk] = np.frombuffer(r["sums"], np.float32).reshape(-1, width)
        del parts
        if step < POWER_PASSES:
            basis = _orthonormal(product)
    if passages is None:
        unstage(held)
    values, turn = np.linalg.eigh(basis.T @ product)
    del product
    best = np.argsort(-values)[:RANK]
    for k in range(0, len(basis), QR_ROWS):
        basis[k : k + QR_ROWS, :RANK] = basis[k : k + QR_ROWS] @ turn[:, best]
    return basis[:, :RANK], np.sqrt(np.maximum(values[best], 0))


def projection(docs: DataFrame) -> np.ndarray:
    """What a word of each bucket adds to the latent vector of its passage.

    Words weigh by their squared inverse frequency, and directions by the inverse of
    their singular value, or the few that all texts of a language share would decide.
    Directions that the corpus does not have are left out.
    """
    passages = stage(passage_rows(docs), "passages")
    weights = inverse_frequencies(docs, passages) ** 2
    vectors, values = singular_vectors(docs, weights, passages)
    unstage(passages)
    scale = np.where(values > 1e-3 * max(values.max(), 1e-9), 1 / np.maximum(values, 1e-9), 0)
    vectors *= scale
    vectors *= weights[:, None]
    return vectors.astype(np.float32)


@dataclass
class Items:
    """Benchmark passages of at most 64 words, by the size of the passages they are sought in.

    ``words`` and ``tails`` (the last words) are filled up with 0, which is no word.
    ``kinds`` has a bit for each kind of word, ``again`` counts the words whose kind
    stands earlier in the item.
    """

    ids: np.ndarray
    words: np.ndarray
    tails: np.ndarray
    lengths: np.ndarray
    kinds: np.ndarray
    again: np.ndarray
    vectors: np.ndarray
    size: np.ndarray
    least: np.ndarray
    part: np.ndarray


def _kinds(words: np.ndarray) -> np.ndarray:
    """A bit for each kind of word in every row; 0 is no word."""
    out = np.zeros((len(words), KINDS // 64), np.uint64)
    every = np.arange(len(words))
    for k in range(words.shape[1]):
        own = words[:, k]
        kind = own % np.uint64(KINDS)
        bit = np.where(own != 0, np.uint64(1) << (kind & np.uint64(63)), np.uint64(0))
        out[every, (kind >> np.uint64(6)).astype(np.intp)] |= bit
    return out


def _items(rows: list[tuple[int, str]], table: np.ndarray) -> Items:
    """Pieces of the items; a longer one is sought in overlapping pieces, each as a passage of its own."""
    ids, pieces = [], []
    words, first, *_ = word_hashes([text for _, text in rows])
    for (item, _), a, b in zip(rows, first[:-1], first[1:], strict=True):
        step = SIZES[-1] // 2
        for start in range(a, max(b - step, a + 1), step):
            ids.append(item)
            pieces.append(words[start : min(start + SIZES[-1], b)])
    kept = [k for k, p in enumerate(pieces) if len(p)]
    ids, pieces = [ids[k] for k in kept], [pieces[k] for k in kept]
    full, tails = np.zeros((len(pieces), SIZES[-1]), np.uint64), np.zeros((len(pieces), ANSWER_WORDS), np.uint64)
    for k, p in enumerate(pieces):
        full[k, : len(p)] = p
        tails[k, : min(len(p), ANSWER_WORDS)] = p[-ANSWER_WORDS:]
    sums = [table[(p >> np.uint64(64 - BITS)).astype(np.int64)].sum(axis=0) for p in pieces]
    vectors = _unit(np.array(sums, np.float32).reshape(len(pieces), table.shape[1]))
    size = np.array([next(s for s in SIZES if len(p) <= s) for p in pieces], int)
    lengths = np.array([len(p) for p in pieces], int)
    part = np.where(lengths < SHORT_ITEM, 1.0, PART_SHARE)
    least = (COSINE_SHARE * part * np.sqrt(lengths / np.maximum(size, 1))).astype(np.float32)
    kinds = _kinds(full)
    again = lengths - np.bitwise_count(kinds).sum(axis=1, dtype=int)
    return Items(np.array(ids, np.int64), full, tails, lengths, kinds, again, vectors, size, least, part)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]


def common_subsequence(items: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows; 0 is no word."""
    length = np.zeros((len(items), spans.shape[1] + 1), np.int16)
    for k in range(items.shape[1]):
        same = (items[:, k : k + 1] == spans) & (items[:, k : k + 1] != 0)
        length[:, 1:] = np.maximum.accumulate(np.maximum(length[:, 1:], length[:, :-1] + same), axis=1)
    return length[:, -1]


def _confirmed(words, first, texts, starts, which, items: Items, size: int) -> Iterator[tuple]:
    """Text, item and shares of the candidates (text, first word, item) that are confirmed."""
    for at in range(0, len(texts), 4096):
        part = slice(at, at + 4096)
        owner, begin, item = texts[part], starts[part], which[part]
        low = np.maximum(begin - size // 2, first[owner])
        place = low[:, None] + np.arange(2 * size)[None, :]
        spans = np.where(place < first[owner + 1][:, None], words[np.minimum(place, len(words) - 1)], np.uint64(0))
        lengths = items.lengths[item]
        share = common_subsequence(items.words[item, :size], spans) / lengths
        enough = np.flatnonzero(share >= PART_SHARE)
        owner, item, spans, lengths, share = owner[enough], item[enough], spans[enough], lengths[enough], share[enough]
        answer = common_subsequence(items.tails[item], spans) / np.minimum(lengths, ANSWER_WORDS)
        good = (share >= WHOLE_SHARE) | ((share >= PART_SHARE) & (answer >= ANSWER_SHARE))
        good = np.where(lengths < SHORT_ITEM, share == 1, good)
        for k in np.flatnonzero(good):
            yield int(owner[k]), int(items.ids[item[k]]), float(share[k]), float(answer[k])


def _neighbours(rows: np.ndarray, sizes: list[int], join: np.ufunc) -> dict[int, np.ndarray]:
    """For each size, ascending from 1, the join of so many rows from every row on; the last rows have none."""
    found = {1: rows}
    for size in sizes:
        if size not in found:
            head = max(k for k in found if k < size and size - k in found)
            rest = found[size - head][head:]
            found[size] = join(found[head][: len(rest)], rest)
    return found


def search(texts: list[str], table: np.ndarray, items: Items) -> dict[tuple[int, int], tuple[float, float]]:
    """The best shares of each confirmed pair of text and item.

    Rows of blocks are searched some at a time, each time with the rows around them
    that their passages reach; memory does not grow with a text but for its words.
    """
    best: dict[tuple[int, int], tuple[float, float]] = {}
    words, first, *_ = word_hashes(texts)
    if not len(words) or not len(items.ids):
        return best
    places, owner, begin = _rows(words, first)
    chosen = {size: np.flatnonzero(items.size == size) for size in SIZES if (items.size == size).any()}
    # Products of unit vectors with these reach 1 where the cosine reaches its bound.
    sought = {size: (items.vectors[own] / items.least[own, None]).T for size, own in chosen.items()}
    widest = SIZES[-1] // BLOCK
    spare = np.empty((ROWS_AT_ONCE + 3 * widest, table.shape[1]), np.float32)
    for at in range(0, len(places), ROWS_AT_ONCE):
        # Rows that passages begin in, after those that they are confirmed with and before those they end in.
        lead = min(at, widest)
        own = places[at - lead : at + ROWS_AT_ONCE + 2 * widest]
        held = words[own]
        held[own < 0] = 0
        buckets = (held >> np.uint64(64 - BITS)).astype(np.intp)
        sums = table.take(buckets[:, 0], axis=0)
        for k in range(1, BLOCK):
            sums += table.take(buckets[:, k], axis=0, out=spare[: len(own)], mode="clip")
        short = np.flatnonzero(own[:, -1] < 0)
        sums[short] = (table[buckets[short]] * (own[short] >= 0)[:, :, None]).sum(axis=1)
        passages = _neighbours(np.concatenate([sums, np.zeros((widest, table.shape[1]), np.float32)]),
                               [size // BLOCK for size in SIZES], np.add)
        kinds = None
        for size, which in chosen.items():
            n = size // BLOCK
            # Passages begin at every quarter of their size, or block; a text's last ones are shorter.
            heads = lead + np.flatnonzero(owner[at : at + ROWS_AT_ONCE] >= 0)
            text = owner[heads + at - lead]
            heads = heads[(heads + at - lead - begin[text]) % max(n // 4, 1) == 0]
            close = _unit(passages[n][heads]) @ sought[size] >= 1
            passage, item = np.divmod(np.flatnonzero(close), len(which))
            if not len(passage):
                continue
            if kinds is None:
                empty = np.zeros((2 * widest, KINDS // 64), np.uint64)
                kinds = _neighbours(np.concatenate([_kinds(held), empty]), [2, 4, 8, 16], np.bitwise_or)
            passage, item = heads[passage], which[item]
            text = owner[passage + at - lead]
            # All rows that the words around the passage lie in; no more words can be there in order than at all.
            wide = 2 * n + n % 2
            step = max(k for k in kinds if k <= wide)
            low = np.maximum(passage - (n + 1) // 2, begin[text] - at + lead)
            there = (kinds[step][low] | kinds[step][low + wide - step]) & items.kinds[item]
            there = np.bitwise_count(there).sum(axis=1, dtype=int) + items.again[item]
            likely = there >= items.part[item] * items.lengths[item]
            passage, item, text = passage[likely], item[likely], text[likely]
            found = _confirmed(words, first, text, places[passage + at - lead, 0], item, items, size)
            for owned, name, share, answer in found:
                best[owned, name] = max(best.get((owned, name), (0.0, 0.0)), (share, answer))
    return best


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, shared_words, answer_words``: the documents that hold a benchmark item, one row a pair.

    ``shared_words`` is the share of the item's words that occur in order in one
    passage, ``answer_words`` that of its last words. Words are
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. An item longer than 64 words is
    sought in pieces. Null, blank or repeated items are no items of their own; a null
    or blank document holds none. A row that is repeated gives its pairs again. Ids
    are integers; without documents or items there are no pairs. Other columns are
    not read.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = items.dropna().distinct()
    context = docs.sparkSession.sparkContext
    table = projection(texts)
    shared_table = context.broadcast(table)
    n_parts = max(1, -(-items.count() // ITEMS_AT_ONCE))
    result = None
    for part in range(n_parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == part).collect()
        shared_items = context.broadcast(_items([(r["item_id"], r["text"]) for r in rows], table))

        def run(batches: Iterator[pa.RecordBatch], shared_items=shared_items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                out = []
                for start, _, own in _texts(batch):
                    for (k, item), shares in search(own, shared_table.value, shared_items.value).items():
                        out.append((ids[start + k], item, *shares))
                names = ["doc_id", "item_id", "shared_words", "answer_words"]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names
                )

        found = texts.mapInArrow(run, "doc_id long, item_id long, shared_words double, answer_words double")
        result = found if result is None else result.unionByName(found)
    return result
