"""Language-model scores: a causal self-attention model over subword ids, trained and run in numpy.

Tokens are words (A-Z lower-cased) and one end for each text; ids are the words' subword ids in a public
vocabulary, and an end id.  The model is one head of causal attention over windows of ``WINDOW`` ids:

    x = E[id] + P[place];  h = x + softmax(mask(x Wq (x Wk)' / sqrt(d))) x Wv Wo;  class logits = h U + b

and p(next id) = p(class) p(id | class), the latter from smoothed counts over all training texts.  E and the
start of U come from all training bigrams (id, next class): the leading directions of their log ratios.
Classes are ids that are followed alike (k-means over those directions), apart for ids that end a word.
Wq, Wk, Wv, Wo, P, U and b are then trained on every window of all training texts (end to end), in ``ROUNDS`` rounds that
each take their share of the windows by hash: each task runs Adam steps over its windows from common parameters,
and Spark averages what tasks end with.  Windows overlap: the first scores all its ids, the next ones those after their
first ``WINDOW - STRIDE``, so each id is scored once, with that much context at least.

The score of a text is that of its tokens: a word's probability is ``1 - WORD_SHARE`` of the product of its ids'
probabilities and ``WORD_SHARE`` of its share of the training tokens, so words that were seen whole keep what
counts say of them and others are spelled by attention.  ``attention_score`` is the spelling alone.

Texts are read once into blocks of about ``BLOCK_BYTES``, each with a dictionary of its distinct words, their
subword ids and the stream of word codes, written in buckets.  For the base score Spark shuffles the words of blocks by part
of their hashes, a task sums those of its parts, and counts go back to the blocks that hold the word where other blocks have it
too, while blocks stay where they are; no task or driver holds the vocabulary.  A text longer than a block is a block.

Nulls: a null text is empty (only the end).  A null id is held out.  Repeated rows get equal results.
Empty input gives empty output; without training texts all counts are 0 and the model is uniform.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder, tokenizer_definition
from .common import documents, materialise, workspace
from .piece_table import TABLE_BITS, PieceTable, Values
from .textbatch import LOWER, U64, mix64, span_hashes, texts_of, words_of
from .word_merges import WordMerges

BLOCK_BYTES = 4 << 20
WINDOW, STRIDE = 32, 24
DIM, CLASSES = 16, 64
ROUNDS, BATCH = 2, 64
WORD_SHARE = 0.5
START, END = 49_406, 49_407
IDS = 49_408
SHAPES = {"Wq": (DIM, DIM), "Wk": (DIM, DIM), "Wv": (DIM, DIM), "Wo": (DIM, DIM), "P": (WINDOW, DIM), "U": (DIM, CLASSES), "b": (CLASSES,)}
BLOCK_SCHEMA = (
    "block long, doc_ids array<bigint>, held array<boolean>, n_words array<int>,"
    " codes binary, sub_ids binary, sub_counts binary, hashes binary, train_counts binary"
)
_MASK = np.ascontiguousarray(np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32).T)  # (key, query)
_LEAST = 2.0**-40


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(True))


# ---- blocks


class SubwordIds:
    """Ids of words as the tokenizers library gives them, each once while a table of fixed size holds it; special tokens' strings are text."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.merges = WordMerges(definition)
        self.table, self.values = PieceTable(), Values(np.uint16)

    def of(self, hashes: np.ndarray, word=None, spell=None) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of distinct words has, and all ids in a row.

        ``word(i)`` gives the bytes of the i-th, or ``spell(at)`` the bytes of some in a row and their lengths.
        """
        spell = spell or (lambda at: _joined([word(i) for i in at.tolist()]))
        numbers = self.table.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if self.table.n + len(missing) > self.table.room:
            missing = np.arange(len(hashes))
            self.table = PieceTable(max(TABLE_BITS, int(np.ceil(np.log2(2 * len(missing))))))
            self.values = Values(np.uint16)
        for lo in range(0, len(missing), 8192):
            part = missing[lo : lo + 8192]
            self.values.add(*self.encode(*spell(part)))
            self.table.add(hashes[part])
        counts, at = self.values.of(self.table.find(hashes))
        return counts, self.values.flat[0][at]

    def encode(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some words has, and all ids in a row: merged in arrays where that can be done, else by the library."""
        first = np.concatenate([[0], np.cumsum(length)])
        known = self.merges.known(data, first)
        counts, parts = np.zeros(len(length), np.int64), [np.zeros(0, np.int64)] * 2
        if known.any():
            own = data[np.repeat(known, length)]
            counts[known], parts[0] = self.merges.encode(own, np.concatenate([[0], np.cumsum(length[known])]))
        if not known.all():
            rest = np.flatnonzero(~known)
            words = [data[first[i] : first[i + 1]].tobytes().decode("utf-8", "replace") for i in rest.tolist()]
            got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            counts[rest], parts[1] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(rest)), np.array(got.ids, np.int64)
        ids, own = np.empty(counts.sum(), np.uint16), np.repeat(known, counts)
        ids[own], ids[~own] = parts
        return counts, ids


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


_subwords: dict[str, SubwordIds] = {}


def subword_ids(definition: str) -> SubwordIds:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _subwords:
        _subwords.clear()
        _subwords[key] = SubwordIds(definition)
    return _subwords[key]


def _make_blocks(definition):
    def run(batches):
        subwords, seen = subword_ids(definition.value), 0

        def block(parts):
            nonlocal seen
            hashes = np.concatenate([p[3] for p in parts])
            own, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
            doc_words = np.concatenate([p[2] for p in parts])
            held = [h for p in parts for h in p[1]]
            training = ~np.repeat(np.array(held, bool), doc_words)
            data = np.concatenate([p[4] for p in parts])
            data_start = np.cumsum([0, *(len(p[4]) for p in parts)]).tolist()
            start = np.concatenate([p[5] + lo for p, lo in zip(parts, data_start, strict=False)])[first]
            length = np.concatenate([p[6] - p[5] for p in parts])[first]

            def spell(at):
                n = length[at]
                return data[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

            counts, ids = subwords.of(own, spell=spell)
            seen += 1
            row = [
                TaskContext.get().partitionId() << 32 | seen,
                [d for p in parts for d in p[0]],
                held,
                doc_words.astype(np.int32),
                codes.astype("<u4").tobytes(),
                ids.astype("<u2").tobytes(),
                counts.astype("<u4").tobytes(),
                own.tobytes(),
                np.bincount(codes[training], minlength=len(own)).astype("<u4").tobytes(),
            ]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 5]
            names = ["block", "doc_ids", "held", "n_words", "codes", "sub_ids", "sub_counts", "hashes", "train_counts"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        parts, size = [], 0
        for batch in batches:
            doc_ids, held = batch.column(0), batch.column(1)
            for t in texts_of(batch.column(2)):
                w, data = words_of(t), LOWER[t.data]
                n = len(t)
                parts.append((doc_ids.slice(t.lo, n).to_pylist(), held.slice(t.lo, n).to_pylist(), np.diff(w.first), span_hashes(data, w.start, w.end), data, w.start, w.end))
                size += len(data) + 16 * n
                if size >= BLOCK_BYTES:
                    yield block(parts)
                    parts, size = [], 0
        if parts:
            yield block(parts)

    return run


def encode_blocks(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    definition = docs.sparkSession.sparkContext.broadcast(tokenizer_definition(tokenizer_path, "word_bpe_49k.json"))
    chosen = docs.select(F.col("doc_id").cast("long"), held_out().alias("held"), "text")
    return chosen.mapInArrow(_make_blocks(definition), BLOCK_SCHEMA)


class Stream:
    """The ids of a block's texts in a row: of each place the id before it and the id to score."""

    def __init__(self, n_words, codes, sub_ids, sub_counts):
        codes = np.frombuffer(codes, "<u4")
        sub_ids, counts = np.frombuffer(sub_ids, "<u2").astype(np.int32), np.frombuffer(sub_counts, "<u4").astype(np.int64)
        n_words = np.asarray(n_words, np.int64)
        first_of_word = np.cumsum(counts) - counts
        per_word = counts[codes]
        at = np.repeat(first_of_word[codes] - (np.cumsum(per_word) - per_word), per_word) + np.arange(per_word.sum())
        flat = sub_ids[at]
        word_ends = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(n_words)])]
        # ends of tokens in the stream, where each text's end is a token of one id
        self.first_token = np.concatenate([[0], np.cumsum(n_words + 1)])
        ids_of_token = np.ones(self.first_token[-1], np.int64)
        is_word = np.ones(len(ids_of_token), bool)
        is_word[self.first_token[1:] - 1] = False
        ids_of_token[is_word] = per_word
        self.token_ends, self.is_word = np.cumsum(ids_of_token), is_word
        self.lengths = np.diff(word_ends) + 1
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.target = np.full(self.first[-1], END, np.int32)
        inner = np.ones(len(self.target), bool)
        inner[self.first[1:] - 1] = False
        self.target[inner] = flat
        self.before = np.empty_like(self.target)
        self.before[1:] = self.target[:-1]
        self.before[self.first[:-1]] = START

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and text of each window."""
        more = np.maximum(0, -(-(self.lengths - WINDOW) // STRIDE))
        text = np.repeat(np.arange(len(self.lengths)), more + 1)
        k = np.arange(len(text)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        return self.first[text] + k * STRIDE, self.first[text + 1], k


# ---- model


def classes_of(counts: np.ndarray, ends_word: np.ndarray) -> np.ndarray:
    """A class of each id: half the classes for ids that end a word, half for the rest, cut by equal shares of counts."""
    out = np.zeros(len(counts), np.int64)
    for side in (0, 1):
        ids = np.flatnonzero(ends_word == side)
        ids = ids[np.lexsort((ids, -counts[ids]))]
        weight = counts[ids] + 1e-3
        middle = np.cumsum(weight) - weight / 2
        out[ids] = side * (CLASSES // 2) + np.minimum(middle / weight.sum() * (CLASSES // 2), CLASSES // 2 - 1).astype(int)
    return out


def leading(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of ids, directions and log shares of classes: ``log share + E @ U`` is about log p(class | id)."""
    p = (pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES)
    ratio = np.log((pairs + 20 * p) / (pairs.sum(axis=1, keepdims=True) + 20)) - np.log(p)
    _, vectors = np.linalg.eigh(ratio.T @ (ratio * pairs.sum(axis=1, keepdims=True)) + 1e-9 * np.eye(CLASSES))
    top = vectors[:, ::-1][:, :DIM]
    return ratio @ top, top.T, np.log(p)


def regroup(counts: np.ndarray, ends_word: np.ndarray, pairs: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Classes of ids that are followed alike: weighted k-means over their coordinates, on each side of ``ends_word``."""
    at, _, _ = leading(pairs)
    out, per_side = np.zeros(len(counts), np.int64), CLASSES // 2
    for side in (0, 1):
        ids = np.flatnonzero(ends_word == side)
        x, w = at[ids], counts[ids] + 1e-3
        order = np.lexsort((ids, -w))
        middle = (np.cumsum(w[order]) - w[order] / 2) / w.sum()
        own = np.empty(len(ids), np.int64)
        own[order] = np.minimum(middle * per_side, per_side - 1).astype(int)  # starts from equal shares
        for _ in range(rounds):
            share = np.bincount(own, w, per_side)
            center = np.stack([np.bincount(own, w * x[:, j], per_side) for j in range(DIM)], axis=1) / np.maximum(share, 1e-9)[:, None]
            own = ((center**2).sum(axis=1) - 2 * x @ center.T + 1e12 * (share == 0)).argmin(axis=1)
        out[ids] = side * per_side + own
    return out


def fit_start(counts: np.ndarray, classes: np.ndarray, pairs: np.ndarray) -> dict[str, np.ndarray]:
    """Fixed tables and starting parameters from counts; ``pairs[id, class]`` counts what follows an id."""
    per_class, size = np.bincount(classes, counts, CLASSES), np.bincount(classes, minlength=CLASSES)
    inner = np.log((counts + 0.5) / np.maximum(per_class + 0.5 * size, 0.5)[classes])
    at, directions, share = leading(pairs)
    rng, scale = np.random.default_rng(5), 1 / (np.abs(at).mean() + 1) / np.sqrt(DIM)
    model = {"inner": inner.astype(np.float32), "classes": classes, "E": at.astype(np.float32)}
    for name in ("Wq", "Wk", "Wv", "Wo"):
        model[name] = rng.normal(0, scale if name != "Wo" else 0.01, SHAPES[name]).astype(np.float32)
    return model | {"P": np.zeros(SHAPES["P"], np.float32), "U": directions.astype(np.float32), "b": share.astype(np.float32)}


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product of matrices."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of long matrices, in pieces of rows that stay in the cache."""
    rows = 64 if len(a) % 64 == 0 else WINDOW
    return (a.reshape(-1, rows, a.shape[1]).transpose(0, 2, 1) @ b.reshape(-1, rows, b.shape[1])).sum(axis=0)


def summed_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of wide ``a`` and long ``b``, in pieces as ``summed``."""
    rows = 64 if len(b) % 64 == 0 else WINDOW
    return (a.reshape(len(a), -1, rows).transpose(1, 0, 2) @ b.reshape(-1, rows, b.shape[1])).sum(axis=0)


def exp_rows(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials of ``z`` less a shift, their sums by row, and the shift: the rows' maxima if a sum would leave the range, else 0."""
    ones, shift = np.ones(z.shape[-1], z.dtype), 0.0
    with np.errstate(over="ignore"):
        e = np.exp(z)
        sums = e @ ones
    if not (sums.min(initial=1) > 1e-20 and sums.max(initial=1) < 1e20):
        shift = z.max(axis=-1)
        e = np.exp(z - shift[..., None])
        sums = e @ ones
    return e, sums, shift


def with_one(h: np.ndarray) -> np.ndarray:
    """``h`` and a column of ones, so that one product gives h U + b, and another the gradients of both."""
    out = np.empty((*h.shape[:-1], DIM + 1), h.dtype)
    out[..., :DIM], out[..., DIM] = h, 1
    return out


def logits(model: dict, h1: np.ndarray) -> np.ndarray:
    return times(h1, np.vstack([model["U"], model["b"]]))


def inputs(model: dict, ids: np.ndarray) -> np.ndarray:
    return model["E"].take(ids, axis=0) + model["P"]


def joined(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Wq Wk' / sqrt(d) and Wv Wo: queries then meet inputs themselves, and so do weights."""
    return (model["Wq"] @ model["Wk"].T) * model["Wq"].dtype.type(DIM**-0.5), model["Wv"] @ model["Wo"]


def turned(x: np.ndarray) -> np.ndarray:
    """Each matrix transposed, in a row: products with it are about three times as fast as with a view."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


@functools.lru_cache(4)
def _whole(n: int, tail: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The mask, and the least exponent, at each place of weights: three times as fast as a row or a number."""
    return np.repeat(_MASK[:, None, WINDOW - tail :], n, axis=1).astype(dtype), np.full((WINDOW, n, tail), -80, dtype)


def attention(x: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (key, window, query) before they are divided by their sums, the sums, and the mean inputs that queries see.

    ``queries`` are of the last places.  Weights are relative to the largest of their query; those under 1e-19 of it
    become 0, which changes no sum of floats, as numbers near the least float take processors a hundred times as long.
    """
    n, tail = queries.shape[:2]
    e = np.empty((WINDOW, n, tail), x.dtype)
    np.matmul(x, turned(queries), out=e.transpose(1, 0, 2))
    mask, floor = _whole(n, tail, x.dtype)
    e += mask
    e -= e.max(axis=0)
    np.maximum(e, floor, out=e)
    np.exp(e, out=e)
    e += e.dtype.type(_LEAST)
    e -= e.dtype.type(_LEAST)
    sums = e.sum(axis=0)
    seen = e.transpose(1, 2, 0) @ x
    seen *= (1 / sums)[..., None]
    return e, sums, seen


def forward(model: dict, ids: np.ndarray) -> dict[str, np.ndarray]:
    """All inner values for windows of ids (rows)."""
    x, (ask, give) = inputs(model, ids), joined(model)
    y = times(x, ask)
    e, sums, seen = attention(x, y)
    h1 = with_one(x + times(seen, give))
    return {"x": x, "y": y, "e": e, "sums": sums, "seen": seen, "h1": h1, "z": logits(model, h1), "ask": ask, "give": give}


def gradients(model: dict, ids: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradients and value of the mean class loss over scored places."""
    f = forward(model, ids)
    flat = lambda m: m.reshape(-1, m.shape[-1])
    x, y, e, seen, ask, give = (f[n] for n in ("x", "y", "e", "seen", "ask", "give"))
    at = np.arange(targets.size) * CLASSES + model["classes"].take(targets.ravel())
    weight = scored.ravel() * np.float32(1 / max(1, np.count_nonzero(scored)))
    p, sums, _ = exp_rows(flat(f["z"]))
    hit = p.ravel()[at]
    loss = float(-(np.log(np.maximum(hit / sums, 1e-30)) * weight).sum())
    # p is the gradient of z but for a factor of each row, which its narrower products take
    p.ravel()[at] = hit - sums
    factor = (weight / sums)[:, None]
    last = summed(flat(f["h1"]) * factor, p)
    dh = p @ model["U"].T
    dh *= factor
    d_seen = dh @ give.T
    d_seen /= f["sums"].reshape(-1, 1)
    ds = np.empty_like(e)
    np.matmul(x, turned(d_seen.reshape(x.shape)), out=ds.transpose(1, 0, 2))
    ds -= ((d_seen * flat(seen)) @ np.ones(DIM, x.dtype)).reshape(e.shape[1:])
    ds *= e
    dy = ds.transpose(1, 2, 0) @ x
    d_ask, d_give = summed(flat(x), flat(dy)), summed(flat(seen), dh)
    scale = x.dtype.type(DIM**-0.5)
    out = {"U": last[:DIM], "b": last[DIM], "Wv": d_give @ model["Wo"].T, "Wo": model["Wv"].T @ d_give}
    out["Wq"], out["Wk"] = d_ask @ model["Wk"] * scale, d_ask.T @ model["Wq"] * scale
    keys = summed_rows(ds.reshape(WINDOW, -1), flat(y)) + summed_rows(e.reshape(WINDOW, -1), d_seen)
    out["P"] = dh.reshape(x.shape).sum(axis=0) + dy.sum(axis=0) @ ask.T + keys
    return out, loss


def class_scores(model: dict, ids: np.ndarray, tail: int) -> np.ndarray:
    """Class logits at the last ``tail`` places of windows, as ``forward`` gives them."""
    x, (ask, give) = inputs(model, ids), joined(model)
    last = x[:, WINDOW - tail :]
    seen = attention(x, times(last, ask))[2]
    return logits(model, with_one(last + times(seen, give)))


def score_stream(model: dict, stream: Stream, chunk: int = 256) -> np.ndarray:
    """Natural log of the attention model's probability of each id."""
    logp = np.zeros(len(stream.target))
    start, stop, k = stream.windows()
    rows = np.arange(chunk * WINDOW) * CLASSES
    for tail, chosen in ((WINDOW, k == 0), (STRIDE, k > 0)):
        at, end = start[chosen], stop[chosen]
        for lo in range(0, len(at), chunk):
            place = at[lo : lo + chunk, None] + np.arange(WINDOW)
            held = np.minimum(place, end[lo : lo + chunk, None] - 1)
            z = class_scores(model, stream.before[held], tail)
            target = stream.target[held[:, WINDOW - tail :]]
            value = z.ravel().take(rows[: target.size].reshape(target.shape) + model["classes"].take(target))
            _, sums, shift = exp_rows(z)
            value -= np.log(sums) + shift
            value += model["inner"].take(target)
            scored = (place < end[lo : lo + chunk, None])[:, WINDOW - tail :]
            logp[place[:, WINDOW - tail :][scored]] = value[scored]
    return logp


def token_scores(logp: np.ndarray, stream: Stream, count: np.ndarray, n_all: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each text by the model, and by its attention part alone.

    Each word is spelled by attention or is one of the words seen in training, in shares ``1 - WORD_SHARE`` and
    ``WORD_SHARE``.  ``count`` has the training count of each token (words of a text, then its end).
    """
    sums = np.concatenate([[0.0], np.cumsum(logp)])[stream.token_ends]
    spelled = np.diff(sums, prepend=0.0)
    own = spelled
    if n_all:
        with np.errstate(divide="ignore"):
            own = np.logaddexp(np.log(1 - WORD_SHARE) + own, np.log(WORD_SHARE * count / n_all))
    return tuple(np.diff(np.concatenate([[0.0], np.cumsum(x)])[stream.first_token]) / np.log(10) for x in (own, spelled))


def flatten(values: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([values[n].ravel() for n in SHAPES])


def unflatten(flat: np.ndarray) -> dict[str, np.ndarray]:
    cuts = np.cumsum([np.prod(s) for s in SHAPES.values()])[:-1]
    return {n: v.reshape(s) for (n, s), v in zip(SHAPES.items(), np.split(flat, cuts), strict=True)}


def train_windows(model: dict, windows, rate: float = 2e-3) -> tuple[dict, int]:
    """Adam steps over batches of (ids, targets, scored); the parameters it ends with and the number of places."""
    own = flatten(model).astype(np.float32)
    model = model | unflatten(own)  # parts of ``own``, which changes in place
    first, second = np.zeros(len(own)), np.zeros(len(own))
    step = places = 0
    for ids, targets, scored in windows:
        g = flatten(gradients(model, ids, targets, scored)[0]).astype(float)
        step, places = step + 1, places + int(np.count_nonzero(scored))
        first += 0.1 * (g - first)
        second += 0.01 * (g**2 - second)
        own -= (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model, places


# ---- over all documents


def _streams(batch, names=("n_words", "codes", "sub_ids", "sub_counts")):
    at = [batch.schema.get_field_index(n) for n in names]
    for i in range(batch.num_rows):
        yield i, Stream(batch.column(at[0])[i].values.to_numpy(zero_copy_only=False), *(batch.column(j)[i].as_buffer() for j in at[1:]))


class TrainingWords:
    """The distinct words of a block, how often training texts hold each, and where words of training texts meet."""

    def __init__(self, batch, i: int):
        column = lambda n: batch.column(batch.schema.get_field_index(n))[i]
        read = lambda n, kind: np.frombuffer(column(n).as_buffer(), kind)
        self.train = ~column("held").values.to_numpy(zero_copy_only=False).astype(bool)
        self.n_words, self.n_texts = column("n_words").values.to_numpy(zero_copy_only=False).astype(np.int64), int(self.train.sum())
        self.codes, self.ids, self.counts, self.train_counts = read("codes", "<u4"), read("sub_ids", "<u2"), read("sub_counts", "<u4").astype(np.int64), read("train_counts", "<u4").astype(float)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the ids that follow them in training texts, and how often."""
        ends = np.cumsum(self.counts)
        some = self.counts > 0
        # within words: all but the last id of each
        inside = np.ones(len(self.ids), bool)
        inside[ends[some] - 1] = False
        inside = np.flatnonzero(inside)
        # between words and at the ends of texts: words without ids don't count
        codes, of_text = self.codes[np.repeat(self.train, self.n_words)], np.repeat(np.arange(self.n_texts), self.n_words[self.train])
        has = some[codes]
        codes, of_text = codes[has], of_text[has]
        at = np.cumsum(np.bincount(of_text, minlength=self.n_texts)) + np.arange(self.n_texts)  # of each text's end
        place = np.arange(len(codes)) + of_text
        last, first = np.full(len(codes) + self.n_texts, END, np.int64), np.full(len(codes) + self.n_texts, END, np.int64)
        first[place], last[place] = self.ids[(ends - self.counts)[codes]], self.ids[ends[codes] - 1]
        before = np.concatenate([[START], last[:-1]])[: len(last)]
        before[at[:-1] + 1] = START
        n = np.concatenate([np.repeat(self.train_counts, self.counts)[inside], np.ones(len(first))])
        return np.concatenate([self.ids[inside].astype(np.int64), before]), np.concatenate([self.ids[inside + 1].astype(np.int64), first]), n


def training_windows(batches, r: int):
    """Batches of (ids, targets, scored) of the windows of training texts that are in round ``r``; each is in one round.

    Training windows stand end to end, so that each id of each training text is learned from once.
    """
    for batch in batches:
        held, block = (batch.column(batch.schema.get_field_index(n)) for n in ("held", "block"))
        for i, s in _streams(batch):
            mine = np.flatnonzero(~held[i].values.to_numpy(zero_copy_only=False).astype(bool))
            n_windows = -(-s.lengths[mine] // WINDOW)
            text = np.repeat(mine, n_windows)
            start = s.first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * WINDOW
            at_round = mix64(mix64(np.array([block[i].as_py()], np.uint64)) + np.arange(len(start), dtype=np.uint64)) % U64(ROUNDS)
            chosen = np.flatnonzero(at_round == r)
            for lo in range(0, len(chosen), BATCH):
                at = chosen[lo : lo + BATCH]
                place, stop = start[at, None] + np.arange(WINDOW), s.first[text[at] + 1, None]
                held_in = np.minimum(place, stop - 1)
                yield s.before[held_in], s.target[held_in], place < stop


def fit_model(blocks: DataFrame, ends_word: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Counts, classes, bigrams and rounds of training over all training texts; tables are bounded by the vocabulary."""
    sc, used = blocks.sparkSession.sparkContext, ["held", "n_words", "codes", "sub_ids", "sub_counts"]
    counted = blocks.select("held", "n_words", "codes", "sub_ids", "sub_counts", "train_counts")

    def count(batches):
        total = np.zeros(IDS)
        for batch in batches:
            for i in range(batch.num_rows):
                w = TrainingWords(batch, i)
                total += np.bincount(w.ids, np.repeat(w.train_counts, w.counts), IDS)
                total[END] += w.n_texts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["id", "n"])

    found = counted.mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(IDS)
    counts[found["id"].to_numpy(int)] = found["n"].to_numpy(float)

    def follow(classes):
        def run(batches):
            total = np.zeros(IDS * CLASSES)
            for batch in batches:
                for i in range(batch.num_rows):
                    before, target, n = TrainingWords(batch, i).pairs()
                    np.add.at(total, before * CLASSES + classes[target], n)
            at = np.flatnonzero(total)
            for lo in range(0, len(at), 1 << 18):
                part = at[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], ["cell", "n"])

        found = counted.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        pairs = np.zeros(IDS * CLASSES)
        pairs[found["cell"].to_numpy(int)] = found["n"].to_numpy(float)
        return pairs.reshape(IDS, CLASSES)

    classes = classes_of(counts, ends_word)
    classes = regroup(counts, ends_word, follow(classes))
    model = fit_start(counts, classes, follow(classes))

    for r in range(rounds):
        shared = sc.broadcast(model)

        def train(batches, r=r, shared=shared):
            got, places = train_windows(shared.value, training_windows(batches, r))
            flat = flatten(got).astype(float)
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * places), pa.array(np.full(len(flat), places, float))], ["i", "v", "w"])

        mean = blocks.select(*used, "block").mapInArrow(train, "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).toPandas()
        if len(mean):
            model |= unflatten(mean.sort_values("i")["v"].to_numpy().astype(np.float32))
        shared.unpersist()
    return model


def word_ends(definition: str) -> np.ndarray:
    bpe, out = coder(definition), np.zeros(IDS, np.int64)
    for i, s in bpe.strings.items():
        out[i] = s.endswith(bpe.suffix)
    out[END] = 1
    return out


def _slices(n: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary values of ``n[i]`` elements each."""
    offsets = np.concatenate([[0], np.cumsum(n)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _elements(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _requests(n_parts: int, room: int = 1 << 19):
    """The distinct words of blocks in rows by part of their hashes, of about ``room`` words together."""

    def rows(held):
        hashes, n, block, at = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (hashes % U64(n_parts)).astype(np.uint16 if n_parts < 1 << 16 else np.int64)
        order, size = np.argsort(part, kind="stable"), np.bincount(part, minlength=n_parts)
        some = np.flatnonzero(size)
        columns = [pa.array(some.astype(np.int32)), *(_slices(size[some], x[order]) for x in (hashes, n, block, at))]
        return pa.RecordBatch.from_arrays(columns, ["part", "hashes", "n", "blocks", "at"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, n = np.frombuffer(batch.column(1)[i].as_buffer(), "<u8"), np.frombuffer(batch.column(2)[i].as_buffer(), "<u4")
                for lo in range(0, len(hashes), room):
                    m = len(hashes[lo : lo + room])
                    held.append((hashes[lo : lo + m], n[lo : lo + m], np.full(m, batch.column(0)[i].as_py(), "<i8"), np.arange(lo, lo + m, dtype="<u4")))
                    size += m
                    if size >= room:
                        yield rows(held)
                        held, size = [], 0
        if held:
            yield rows(held)

    return run


def _replies(batches):
    """Of all words of a partition, a row for each block that is to learn of counts in others, and a row with the totals."""
    held = [[_elements(batch.column(k), kind) for k, kind in enumerate(("<u8", "<u4", "<i8", "<u4"), 1)] for batch in batches]
    if not held:
        return
    hashes, n, block, at = (np.concatenate(x) for x in zip(*held, strict=True))
    own, word = np.unique(hashes, return_inverse=True)
    total = np.bincount(word, n, len(own)).astype(np.int64)
    more = np.flatnonzero(total[word] > n)
    more = more[np.argsort(block[more], kind="stable")]
    blocks, size = np.unique(block[more], return_counts=True)
    columns = [pa.array(blocks), _slices(size, at[more]), _slices(size, total[word[more]])]
    nothing = [pa.nulls(len(blocks), pa.int64())] * 2
    yield pa.RecordBatch.from_arrays([*columns, *nothing], ["block", "at", "c", "n_words", "n_distinct"])
    sums = [pa.array([int(total.sum())]), pa.array([int(np.count_nonzero(total))])]
    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in columns), *sums], ["block", "at", "c", "n_words", "n_distinct"])


def bucketed(df: DataFrame, path: str, key: str) -> DataFrame:
    """``df`` written in buckets of ``key``: what is joined to it by the key later moves to it, and it doesn't move itself."""
    spark, name = df.sparkSession, f"lm_score_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files and what ``written`` knows of them stay
    return written


def score_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score."""
    spark = docs.sparkSession
    path = workspace(spark, "lm-score")
    blocks = bucketed(encode_blocks(docs, tokenizer_path), f"{path}/blocks", "block")

    # words meet by parts of their hashes, many in a row; a block hears of a word only if others have it too
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks.select("block", "hashes", "train_counts").mapInArrow(_requests(parts), "part int, hashes binary, n binary, blocks binary, at binary")
    told = asked.repartition(parts, "part").mapInArrow(_replies, "block long, at binary, c binary, n_words long, n_distinct long")
    told = materialise(told, f"{path}/told")
    n_words, n_distinct = told.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    ends = blocks.select(F.explode("held").alias("held")).where("not held").count()
    n_all, n_kinds = n_words + ends, n_distinct + (ends > 0)
    answers = told.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("answers"))

    definition = tokenizer_definition(tokenizer_path, "word_bpe_49k.json")
    model = spark.sparkContext.broadcast(fit_model(blocks, word_ends(definition)))
    unit = np.log10(n_all + n_kinds + 1)

    def score(batches):
        for batch in batches:
            for i, s in _streams(batch):
                n_words = batch.column(3)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                codes = np.frombuffer(batch.column(4)[i].as_buffer(), "<u4")
                count = np.frombuffer(batch.column(7)[i].as_buffer(), "<u4").astype(np.int64)  # of this block, unless others have more
                if batch.column(8)[i].is_valid:
                    pairs = batch.column(8)[i].values
                    count[_elements(pairs.field("at"), "<u4")] = _elements(pairs.field("c"), "<i8")
                c = np.full(len(s.is_word), ends)
                c[s.is_word] = count[codes]
                base = np.concatenate([[0.0], np.cumsum(np.log10(c + 1) - unit)])[s.first_token]
                known = np.concatenate([[0], np.cumsum(c > 0)])[s.first_token]
                columns = [
                    batch.column(1)[i].values,
                    batch.column(2)[i].values,
                    pa.array(n_words + 1),
                    pa.array(np.diff(known)),
                    pa.array(np.full(len(n_words), n_all, np.int64)),
                    pa.array(np.diff(base)),
                    *map(pa.array, token_scores(score_stream(model.value, s), s, c, n_all)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "attention_score"])

    return (
        blocks.select("block", "doc_ids", "held", "n_words", "codes", "sub_ids", "sub_counts", "train_counts")
        .join(answers, "block", "left")
        .mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, attention_score double")
    )


def op10_lm_score(spark, sf_dir):
    return score_documents(documents(spark, sf_dir))
