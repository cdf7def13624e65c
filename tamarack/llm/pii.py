"""Personal data: fixed patterns, and a character BiLSTM with a CRF that adds spans to theirs.

The network is trained in numpy on labelled spans: windows of a bounded sample of
documents with the spans of the patterns, and rewritten forms of them that the
patterns miss. Texts are cut into overlapping windows that are tagged in large
batches; every character takes its tag from the window in which it lies farthest
from an edge, and spans are read from the tags of the whole text.
"""

from __future__ import annotations


import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.labelled import sampled_documents

# Kinds and patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = list(PATTERNS)
# A character that every match of the kind holds.
SIGNS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

# Tags: outside, then first and later characters of each kind.
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 8
# Documents whose windows a fit uses at most, and windows in all.
FIT_DOCUMENTS = 6000
FIT_WINDOWS = 2400
FIT_CHARS = 96
FIT_BATCH = 128
EPOCHS = 22
# With few windows there are more epochs, for so many steps at least.
LEAST_STEPS = 400
SEED = 11
# Windows of a text, what neighbours share, and windows that are tagged together.
WINDOW = 768
OVERLAP = 64
TOGETHER = 768
# Added spans with fewer digits and letters than this are dropped: four for an address of four numbers.
LEAST_CHARS = {"email": 7, "ip": 4, "card": 7, "phone": 7}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _holds(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns that pass their kind's test, by kind and start."""
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        if SIGNS[kind] in text
        for m in pattern.finditer(text)
        if _holds(kind, m[0])
    ]


# Characters are told apart as small letters, some marks, and classes for the rest.
_MARKS = "@._%+-()[]{}<>\"'=:;,/\\|!?#$&* \n\t"
N_SYMBOLS = 26 + len(_MARKS) + 5


def symbols(text: str) -> np.ndarray:
    """A small number for each code point; 0 stands for the space beyond a text's ends."""
    table = _symbol_table()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.minimum(codes, len(table) - 1)]


_tables: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    if not _tables:
        table = np.full(0x250 + 1, 3, np.uint8)  # the last entry stands for all beyond
        for code in range(0x250):
            c = chr(code)
            if "a" <= c <= "z":
                table[code] = 5 + ord(c) - ord("a")
            elif c in _MARKS:
                table[code] = 31 + _MARKS.index(c)
            elif "0" <= c <= "9":
                table[code] = 1
            elif "A" <= c <= "Z":
                table[code] = 2
            elif not c.isalpha():
                table[code] = 4
        _tables.append(table)
    return _tables[0]


@dataclass
class Network:
    """Weights of both directions (input table, recurrence), of the emissions and of the transitions.

    The gates stand in the order input, forget, output, candidate.
    """

    table: list[np.ndarray]
    recur: list[np.ndarray]
    emit: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, self.emit, self.bias, self.moves]

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """Scores of the tags: steps, tags, windows. ``windows`` has a window in each row.

        Gates, cells and outputs are held at twice their value, which the weights make up for.
        """
        n, steps = windows.shape
        places = np.ascontiguousarray(windows.T).astype(np.intp)
        shown = np.empty((steps, 2 * HIDDEN, n), np.float32)
        looked, z, spare = (np.empty((4 * HIDDEN, n), np.float32) for _ in range(3))
        gates, fresh, keep, show = (z[: 3 * HIDDEN], z[:HIDDEN], z[HIDDEN : 2 * HIDDEN], z[2 * HIDDEN : 3 * HIDDEN])
        candidate, below = z[3 * HIDDEN :], spare[:HIDDEN]
        for way in (0, 1):
            table = np.ascontiguousarray(self.table[way].T.astype(np.float32))
            recur = np.ascontiguousarray(self.recur[way].T.astype(np.float32) / 2)
            h, c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            for step in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.dot(recur, h, out=z)
                table.take(places[step], axis=1, out=looked, mode="clip")
                z += looked
                np.abs(z, out=spare)
                spare += 1
                z /= spare
                gates += 1
                c *= keep
                c *= 0.5
                candidate *= fresh
                c += candidate
                np.abs(c, out=below)
                below += 2
                h = shown[step, way * HIDDEN : (way + 1) * HIDDEN]
                np.divide(c, below, out=h)
                h *= show
        out = np.matmul(self.emit.T.astype(np.float32) / 2, shown)
        out += self.bias.astype(np.float32)[None, :, None]
        return out

    def _maybe_inside(self, scores: np.ndarray) -> np.ndarray:
        """Steps and windows whose best tag may be other than "outside".

        ``lead`` is how far "outside" leads all tags, ``gain`` what a move can add at
        most over staying outside. A run of other tags pays only if the lead at one of
        its steps, an open one, is at most twice the gain: outside throughout were
        better. What the run has beyond its open steps, or between two of them, pays
        only while its leads less the gain add up to at most ``reach``, what the moves
        that cut it out can cost.
        """
        moves = self.moves
        most, stay = float(moves.max()), float(moves[0, 0])
        gain, out, back = most - stay, float(moves[1:, 0].min()), float(moves[0, 1:].min())
        reach = max(most - out, most - back, most + stay - out - back) + 1e-3
        lead = scores[:, 0] - scores[:, 1:].max(axis=1)
        maybe = lead <= 2 * gain + 1e-3
        near = np.flatnonzero(maybe.any(axis=0))
        lead, is_open = lead[:, near] - gain, maybe[:, near]
        inside = is_open.copy()
        for way in (1, -1):
            total = np.full(len(near), np.inf)
            for step in range(len(lead))[::way]:
                total = np.where(is_open[step], 0, total + lead[step])
                inside[step] |= total <= reach
        maybe[:, near] = inside
        return maybe

    def tags(self, windows: np.ndarray) -> np.ndarray:
        """The best sequence of tags of each window.

        Only stretches of steps that may be other than "outside" are searched; there
        is "outside" before and after each, or the window's end.
        """
        scores = self.emissions(windows)
        best = np.zeros(windows.shape, np.int8)
        maybe = np.zeros((windows.shape[0], windows.shape[1] + 2), np.int8)
        maybe[:, 1:-1] = self._maybe_inside(scores).T
        turns = np.diff(maybe, axis=1)
        window, start = np.nonzero(turns == 1)
        length = np.nonzero(turns == -1)[1] - start
        order = np.argsort(-length, kind="stable")
        window, start, length = window[order], start[order], length[order]
        total, back = np.zeros((0, TAGS)), []
        for step in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -step))  # stretches that are longer than this
            own = scores[start[:n] + step, :, window[:n]]
            if step == 0:
                total = own + np.where(start > 0, 1, 0)[:, None] * self.moves[0]
            else:
                ways = total[:n, :, None] + self.moves
                back.append(ways.argmax(axis=1))
                total[:n] = ways.max(axis=1) + own
        if len(length):
            ends = start + length < windows.shape[1]
            tag = (total + np.where(ends, 1, 0)[:, None] * self.moves[:, 0]).argmax(axis=1)
            for step in range(int(length[0]) - 1, -1, -1):
                n = int(np.searchsorted(-length, -step))
                best[window[:n], start[:n] + step] = tag[:n]
                if step:
                    tag[:n] = back[step - 1][np.arange(n), tag[:n]]
        return best


def _bent(x: np.ndarray) -> np.ndarray:
    """The cells' bend, x / (1 + |x|), far cheaper than tanh; gates are 1/2 + bend / 2."""
    return x / (1 + np.abs(x))


def _steep(bent: np.ndarray) -> np.ndarray:
    """Slope of the bend, from its value."""
    return (1 - np.abs(bent)) ** 2


def _forward(net: Network, windows: np.ndarray) -> tuple[np.ndarray, list]:
    """Emissions (steps, windows, tags) and what the backward pass needs."""
    n, steps = windows.shape
    out = np.tile(net.bias, (steps, n, 1))
    kept = []
    for way in (0, 1):
        h, c, trace = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), []
        for step in range(steps) if way == 0 else range(steps - 1, -1, -1):
            z = net.table[way][windows[:, step]] + h @ net.recur[way]
            gates = 0.5 + 0.5 * _bent(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = _bent(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            t = _bent(c)
            h = o * t
            trace.append((step, i, f, o, g, before, t, h_before, h))
            out[step] += h @ net.emit[way * HIDDEN : (way + 1) * HIDDEN]
        kept.append(trace)
    return out, kept


def _crf_slopes(net: Network, scores: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the mean negative log-likelihood in the emissions and the transitions."""
    steps, n, _ = scores.shape

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        most = x.max(axis=axis, keepdims=True)
        return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))

    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for step in range(1, steps):
        ahead[step] = total(ahead[step - 1][:, :, None] + net.moves[None], 1) + scores[step]
    for step in range(steps - 2, -1, -1):
        behind[step] = total(net.moves[None] + (behind[step + 1] + scores[step + 1])[:, None, :], 2)
    norm = total(ahead[-1], 1)
    by_score = np.exp(ahead + behind - norm[None, :, None])
    everyone = np.arange(n)
    by_moves = np.zeros_like(net.moves)
    for step in range(steps):
        by_score[step, everyone, tags[:, step]] -= 1
        if step:
            both = ahead[step - 1][:, :, None] + net.moves[None] + (scores[step] + behind[step])[:, None, :]
            by_moves += np.exp(both - norm[:, None, None]).sum(axis=0)
            np.add.at(by_moves, (tags[:, step - 1], tags[:, step]), -1)
    return by_score / n, by_moves / n


def _slopes(net: Network, windows: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    scores, kept = _forward(net, windows)
    by_score, by_moves = _crf_slopes(net, scores, tags)
    by_table, by_recur = [np.zeros_like(t) for t in net.table], [np.zeros_like(r) for r in net.recur]
    by_emit = np.zeros_like(net.emit)
    for way in (0, 1):
        own = slice(way * HIDDEN, (way + 1) * HIDDEN)
        dh, dc = np.zeros((len(windows), HIDDEN)), np.zeros((len(windows), HIDDEN))
        for step, i, f, o, g, before, t, h_before, h in reversed(kept[way]):
            by_emit[own] += h.T @ by_score[step]
            dh = dh + by_score[step] @ net.emit[own].T
            dc = dc + dh * o * _steep(t)
            through = [dc * g * _steep(2 * i - 1), dc * before * _steep(2 * f - 1), dh * t * _steep(2 * o - 1)]
            dz = np.concatenate([0.5 * x for x in through] + [dc * i * _steep(g)], axis=1)
            np.add.at(by_table[way], windows[:, step], dz)
            by_recur[way] += h_before.T @ dz
            dh, dc = dz @ net.recur[way].T, dc * f
    return [*by_table, *by_recur, by_emit, by_score.sum(axis=(0, 1)), by_moves]


def untrained() -> Network:
    rng = np.random.default_rng(SEED)
    table = [rng.normal(0, 0.3, (N_SYMBOLS, 4 * HIDDEN)) for _ in range(2)]
    for t in table:
        t[:, HIDDEN : 2 * HIDDEN] += 1  # gates that keep, at first
    recur = [rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)) for _ in range(2)]
    bias = np.zeros(TAGS)
    bias[0] = 2.0
    return Network(table, recur, rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), bias, np.zeros((TAGS, TAGS)))


def fit(windows: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Train on windows of symbols and their tags; without windows, everything is outside."""
    net = untrained()
    if not len(windows):
        net.bias[0] = 1e3
        return net
    rng = np.random.default_rng(SEED)
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(windows) // FIT_BATCH)))
    parts = net.parameters()
    m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        order = rng.permutation(len(windows))
        for start in range(0, len(order), FIT_BATCH):
            own = order[start : start + FIT_BATCH]
            step += 1
            for k, g in enumerate(_slopes(net, windows[own], tags[own])):
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                parts[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def rewritten(kind: str, match: str) -> str:
    """A form of a match that the patterns miss."""
    if kind == "email":
        return match.replace("@", " (at) ").replace(".", " dot ")
    if kind == "ip":
        return match.replace(".", "[.]")
    if kind == "card":
        return ".".join(match[k : k + 4] for k in range(0, len(match), 4))
    return match.replace("+", "00 ").replace(")", ") ")


def labelled_windows(text: str) -> list[tuple[str, list[Span]]]:
    """Windows of a text with its labelled spans: around each span, the same rewritten, and one without."""
    spans = base_spans(text)
    out = []
    for kind, start, end in spans:
        lead = (start * 31) % 40
        for match in (text[start:end], rewritten(kind, text[start:end])):
            low = max(0, start - lead)
            if start - low + len(match) > FIT_CHARS:
                continue
            window = (text[low:start] + match + text[end : end + FIT_CHARS])[:FIT_CHARS]
            others = [
                (k, s - low, e - low) for k, s, e in spans if s >= low and e <= start
            ] + [
                (k, s - end + start - low + len(match), e - end + start - low + len(match)) for k, s, e in spans
                if s >= end and e - end + start - low + len(match) <= FIT_CHARS
            ]
            out.append((window, [(kind, start - low, start - low + len(match)), *others]))
    # A number or a mark is the best place for a window without spans.
    for m in re.finditer(r"[0-9@+]", text):
        low = max(0, m.start() - 40)
        if not any(s < low + FIT_CHARS and e > low for _, s, e in spans):
            out.append((text[low : low + FIT_CHARS], []))
            break
    low = (len(text) * 7919) % max(1, len(text) - FIT_CHARS)
    if not any(s < low + FIT_CHARS and e > low for _, s, e in spans):
        out.append((text[low : low + FIT_CHARS], []))
    return out


def train(docs: DataFrame) -> Network:
    """Train on windows of at most ``FIT_DOCUMENTS`` documents; at most ``FIT_WINDOWS`` are used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text in batch.column("text").to_pylist():
                for window, own in labelled_windows(text or ""):
                    texts.append(window)
                    spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in own))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.string())],
                                             ["text", "spans"])

    rows = sampled_documents(docs.select("doc_id", "text"), FIT_DOCUMENTS).mapInArrow(run, "text string, spans string")
    quarter = FIT_WINDOWS // 4
    order = [F.xxhash64("text"), "text", "spans"]
    # A quarter of the windows have spans.
    held = rows.where("spans <> ''").orderBy(*order).limit(quarter).collect()
    held += rows.where("spans = ''").orderBy(*order).limit(3 * quarter).collect()
    windows, tags = np.zeros((len(held), FIT_CHARS), np.uint8), np.zeros((len(held), FIT_CHARS), np.int64)
    for k, row in enumerate(held):
        windows[k, : len(row["text"])] = symbols(row["text"])
        for part in filter(None, row["spans"].split(",")):
            kind, start, end = part.split(":")
            tag = 1 + 2 * KINDS.index(kind)
            tags[k, int(start)] = tag
            tags[k, int(start) + 1 : int(end)] = tag + 1
    return fit(windows, tags)


def _read_spans(text: str, tags: np.ndarray) -> Iterator[Span]:
    """Spans of a text's tags: a first character begins one, and so does a later one with nothing before it."""
    held = np.flatnonzero(tags)
    if not len(held):
        return
    kind, begins = (tags[held] - 1) // 2, tags[held] % 2 == 1
    new = np.ones(len(held), bool)
    new[1:] = (held[1:] != held[:-1] + 1) | (kind[1:] != kind[:-1]) | begins[1:]
    cuts = [*np.flatnonzero(new).tolist(), len(held)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        start, end = int(held[a]), int(held[b - 1]) + 1
        inside = text[start:end]
        start, end = start + len(inside) - len(inside.lstrip()), end - len(inside) + len(inside.rstrip())
        found, name = text[start:end], KINDS[kind[a]]
        if sum(c.isalnum() for c in found) < LEAST_CHARS[name]:
            continue
        # What no form of its kind lacks: an address its sign or word, a number its digits.
        if re.search("@|at", found) if name == "email" else sum("0" <= c <= "9" for c in found) >= 4:
            yield name, start, end


def added_spans(texts: list[str], net: Network) -> list[list[Span]]:
    """Spans that the network finds in each text."""
    stride = WINDOW - OVERLAP
    pieces = []
    for k, text in enumerate(texts):
        n = max(1, -(-(len(text) - OVERLAP) // stride)) if text else 0
        pieces.extend((k, j * stride, j == 0, j == n - 1) for j in range(n))
    tags = [np.zeros(len(t), np.int8) for t in texts]
    codes = [symbols(t) for t in texts]
    # Windows of like length go together, so that short texts are not padded to whole windows.
    pieces.sort(key=lambda p: min(len(texts[p[0]]) - p[1], WINDOW))
    for at in range(0, len(pieces), TOGETHER):
        part = pieces[at : at + TOGETHER]
        width = max(min(len(texts[k]) - low, WINDOW) for k, low, _, _ in part)
        windows = np.zeros((len(part), width), np.uint8)
        for row, (k, low, _, _) in enumerate(part):
            own = codes[k][low : low + width]
            windows[row, : len(own)] = own
        for (k, low, is_first, is_last), found in zip(part, net.tags(windows), strict=True):
            a = 0 if is_first else OVERLAP // 2
            b = min(len(texts[k]) - low, WINDOW) if is_last else WINDOW - OVERLAP // 2
            tags[k][low + a : low + b] = found[a:b]
    return [list(_read_spans(text, own)) if own.any() else [] for text, own in zip(texts, tags, strict=True)]


def joined_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


RUN_CHARS = 1 << 20


def find_personal_data(docs: DataFrame, net: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind and start,
    joined by commas. ``base_spans`` and the counts are those of the patterns;
    ``spans`` adds those of the network that overlap none of them. A null text counts
    as empty and has none. Texts of any length are read whole, repeated rows alike.
    Other columns are not read.
    """
    from tamarack.llm.grams import runs

    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in runs(texts, RUN_CHARS):
                own = texts[start:end]
                base = [base_spans(t) for t in own]
                every = []
                for fixed, more in zip(base, added_spans(own, shared.value), strict=True):
                    every.append(fixed + [x for x in more if not any(x[1] < e and s < x[2] for _, s, e in fixed)])
                counts = [[sum(k == kind for k, _, _ in spans) for spans in base] for kind in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        *[pa.array(c, pa.int64()) for c in counts],
                        pa.array(map(joined_spans, base), pa.string()),
                        pa.array(map(joined_spans, every), pa.string()),
                    ],
                    ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_spans", "spans"],
                )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_spans string, spans string")
