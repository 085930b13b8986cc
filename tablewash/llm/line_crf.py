"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

Lines are described by a few yes/no features. The weights come from labelled
documents: lines of good ones are content, and in bad ones those are boilerplate
that are of a kind bad documents have more often, half of the lines at least. The
chain's transitions smooth what single lines leave open. Viterbi decoding
gives the best label sequence; the share of words in content lines decides
whether a document stays. Counts over the whole text can reject it first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import BLANKS, hash_sample, map_texts

_CONTINUATION = bytes(range(0x80, 0xC0))
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"

#: The features of a line, in the order of their bits.
FEATURES = (
    "few_words",
    "many_words",
    "some_symbols",
    "many_symbols",
    "pipes",
    "capitals",
    "exclamations",
    "digits",
    "repeats_words",
    "repeats_neighbours",
    "ends_sentence",
    "seen_before",
)


@dataclass(frozen=True)
class LineModel:
    """Scores of content against boilerplate: by feature, and between neighbouring lines."""

    bias: float
    weights: tuple[float, ...]
    start: tuple[float, float]
    moves: tuple[tuple[float, float], tuple[float, float]]

    def emission(self, mask: int) -> float:
        return self.bias + sum(w for i, w in enumerate(self.weights) if mask >> i & 1)


#: Without labelled documents of both kinds every line is content.
ALL_CONTENT = LineModel(1.0, (0.0,) * len(FEATURES), (0.0, 0.0), ((0.0, 0.0), (0.0, 0.0)))


def line_features(line: bytes, words: list[bytes], seen: bool) -> int:
    """Bit i is feature i; `words` are the line's words (at least one)."""
    n = len(words)
    size = len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    mask = 0
    if n < 4:
        mask |= 1
    elif n > 20:
        mask |= 2
    if symbols:
        if 100 * symbols > 2 * size:
            mask |= 4
        if 100 * symbols > 8 * size:
            mask |= 8
        if 5 * line.count(b"|") >= n:
            mask |= 16
    if 2 * (size - len(line.translate(None, _UPPER))) > size:
        mask |= 32
    if 3 * line.count(b"!") >= n:
        mask |= 64
    if 10 * (size - len(line.translate(None, _DIGITS))) > size:
        mask |= 128
    if n >= 4:
        distinct = set(words)
        if 2 * len(distinct) < n:
            mask |= 256
        if len(distinct) < n and 4 * sum(map(bytes.__eq__, words, words[1:])) > n:
            mask |= 512
    if line.rstrip()[-1:] in b".!?":
        mask |= 1024
    if seen:
        mask |= 2048
    return mask


def split_lines(text: bytes) -> tuple[list[list[bytes]], list[int], int]:
    """Words and features of each line with a word, and how many such lines equal an earlier one."""
    seen: set[bytes] = set()
    words, masks, repeated = [], [], 0
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            again = line in seen
            repeated += again
            seen.add(line)
            words.append(own)
            masks.append(line_features(line, own, again))
    return words, masks, repeated


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur at least twice in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pairs = codes[:-1] * len(ids) + codes[1:]
    if len(ids) < 1 << 20:
        windows = pairs[:-1] * len(ids) + codes[2:]
    else:
        named = np.unique(pairs, return_inverse=True)[1]
        windows = named[:-1] * len(ids) + codes[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def viterbi(scores: list[float], model: LineModel) -> list[bool]:
    """The best labels (True: content) of a line sequence; of equal paths the one with content later."""
    if not scores:
        return []
    (bb, bc), (cb, cc) = model.moves
    boiler, content = model.start[0], model.start[1] + scores[0]
    back: list[tuple[bool, bool]] = []
    for score in scores[1:]:
        to_boiler, to_content = content + cb >= boiler + bb, content + cc >= boiler + bc
        back.append((to_boiler, to_content))
        boiler, content = (
            content + cb if to_boiler else boiler + bb,
            (content + cc if to_content else boiler + bc) + score,
        )
    label = content >= boiler
    labels = [label]
    for to_boiler, to_content in reversed(back):
        label = to_content if label else to_boiler
        labels.append(label)
    return labels[::-1]


def line_labels(sequences: list[tuple[list[int], bool]], odds: float = 2.0) -> list[np.ndarray]:
    """Which lines of labelled documents are content (True), by how much more often their kind occurs in bad ones.

    Lines of good documents are content. In a bad one those lines are boilerplate whose
    feature mask is `odds` times as frequent in bad documents as in good ones,
    and if these are under half of its lines, the next likely ones up to half: the label of the
    document is a bound on the share, not the label of each line.
    """
    counts: tuple[dict[int, float], dict[int, float]] = ({}, {})
    for masks, good in sequences:
        for m in masks:
            counts[good][m] = counts[good].get(m, 0.0) + 1 / len(masks)
    total = [max(1.0, sum(c.values())) for c in counts]
    ratio = {
        m: (counts[0].get(m, 0.0) + 0.5) / (total[0] + 1) / ((counts[1].get(m, 0.0) + 0.5) / (total[1] + 1))
        for m in counts[0].keys() | counts[1].keys()
    }
    found = []
    for masks, good in sequences:
        content = np.ones(len(masks), bool)
        if not good:
            likely = np.array([ratio[m] for m in masks])
            content = likely < odds
            content[np.argsort(-likely, kind="stable")[: (len(masks) + 1) // 2]] = False
        found.append(content)
    return found


def _chunks(sequences: list[tuple[list[int], bool]], gold: list[np.ndarray], cells: int = 1 << 16):
    """Documents of about equal length side by side: (masks, there, gold, which), padded to the longest of each chunk."""
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][0]))
    while order:
        long = len(sequences[order[-1]][0])
        take, order = order[-max(1, cells // long) :], order[: -max(1, cells // long)]
        masks, there = np.zeros((len(take), long), np.int64), np.zeros((len(take), long), bool)
        want = np.zeros((len(take), long), bool)
        for row, i in enumerate(take):
            n = len(sequences[i][0])
            masks[row, :n], there[row, :n], want[row, :n] = sequences[i][0], True, gold[i]
        yield masks, there, want, np.array(take)


def fit(sequences: list[tuple[list[int], bool]], steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> LineModel:
    """Maximum likelihood by forward-backward and Adam over (feature masks, is good) sequences, lines labelled by `line_labels`."""
    sequences = [s for s in sequences if s[0]]
    if len({y for _, y in sequences}) < 2:
        return ALL_CONTENT
    chunks = list(_chunks(sequences, line_labels(sequences)))
    y = np.array([s[1] for s in sequences])
    # Both kinds weigh the same, and a long document no more than a short one.
    weights = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    size = len(FEATURES) + 1
    theta = np.zeros(size + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gradient = sum(_gradient(theta, *chunk[:3], weights[chunk[3]]) for chunk in chunks) - penalty * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    w, start, moves = theta[:size], theta[-6:-4], theta[-4:].reshape(2, 2)
    return LineModel(float(w[0]), tuple(map(float, w[1:])), tuple(map(float, start)), tuple(tuple(map(float, m)) for m in moves))


def _gradient(theta: np.ndarray, masks: np.ndarray, there: np.ndarray, gold: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the documents' weighted mean log-likelihood a line."""
    size, long = theta.size - 6, masks.shape[1]
    lines = there.sum(1)
    per_line = (weight / lines)[:, None] * there
    x = np.concatenate([np.ones((*masks.shape, 1)), masks[..., None] >> np.arange(len(FEATURES)) & 1], 2)
    w, start, moves = theta[:size], theta[-6:-4], theta[-4:].reshape(2, 2)
    emit = np.stack([np.zeros(masks.shape), x @ w], 2)
    fore, back = np.zeros_like(emit), np.zeros_like(emit)
    fore[:, 0] = start + emit[:, 0]
    for t in range(1, long):
        new = np.logaddexp.reduce(fore[:, t - 1, :, None] + moves, 1) + emit[:, t]
        fore[:, t] = np.where(there[:, t, None], new, fore[:, t - 1])
    for t in range(long - 2, -1, -1):
        new = np.logaddexp.reduce(moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(there[:, t + 1, None], new, 0)
    norm = np.logaddexp.reduce(fore[:, -1], 1)[:, None]
    is_content = np.exp(np.clip(fore[:, :, 1] + back[:, :, 1] - norm, -50, 0))
    gradient = np.zeros_like(theta)
    gradient[:size] = np.einsum("nt,ntf->f", (gold - is_content) * per_line, x)
    first = (weight / lines * (gold[:, 0] - is_content[:, 0])).sum()
    gradient[-6], gradient[-5] = -first, first
    if long > 1:
        pair = per_line[:, 1:] * there[:, 1:]
        joint = fore[:, :-1, :, None] + moves + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - norm[..., None, None]
        joint = np.exp(np.clip(joint, -50, 0)) * pair[..., None, None]
        was, now = gold[:, :-1], gold[:, 1:]
        seen = np.array([[(pair * (a & b)).sum() for b in (~now, now)] for a in (~was, was)])
        gradient[-4:] = (seen - joint.sum((0, 1))).ravel()
    return gradient


def train(docs: DataFrame, labels: DataFrame, per_kind: int = 1000) -> LineModel:
    """Fit on a bounded sample of labelled documents.

    At most `per_kind` documents of each quality, those with the smallest
    seeded hash of their id, go into the training set with all their lines; only
    feature masks come to the driver. A label without a document, a null or
    another value than 0 and 1 takes no part. Ids may be of any type.
    """
    chosen = [
        hash_sample(labels.filter(F.col("quality") == q), "doc_id", per_kind).select("doc_id", F.lit(q).alias("_q"))
        for q in (0, 1)
    ]
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame(
        [(r["doc_id"], r["_q"]) for c in chosen for r in c.collect()], f"_id {kind}, _q int"
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))

    def masks(kind: pa.Array, found: list[bytes]) -> pa.RecordBatch:
        own = [split_lines(t)[1] for t in found]
        return pa.RecordBatch.from_arrays([kind, pa.array(own, pa.list_(pa.int32()))], ["q", "masks"])

    rows = map_texts(texts, masks, "q int, masks array<int>", id_col="_q").collect()
    return fit([(list(r["masks"]), r["q"] == 1) for r in sorted(rows, key=lambda r: (r["q"], r["masks"]))])


def label_lines(docs: DataFrame, model: LineModel, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, content share and verdict of every document.

    Lines are split at line feeds and count if they hold a word; words are runs
    of anything but space and the five ASCII controls from tab to carriage
    return. `base_failed`: under 50 words, or over half of the words in windows
    of three that repeat. `kept`: not base_failed, and the content lines hold at
    least `share` of the words. Null and empty texts have no words and fail.
    Ids may be null or repeat: one row out per row in. Other columns of the
    input are neither read nor returned; an empty table gives an empty result.
    """
    emission: dict[int, float] = {}

    def judged(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        rows = []
        for text in texts:
            lines, masks, repeated = split_lines(text)
            words = [w for line in lines for w in line]
            scores = []
            for mask in masks:
                if mask not in emission:
                    emission[mask] = model.emission(mask)
                scores.append(emission[mask])
            content = sum(len(line) for line, good in zip(lines, viterbi(scores, model), strict=True) if good)
            n, again = len(words), repeated_words(words)
            failed = n < 50 or 100 * again > 50 * n
            rows.append((
                n,
                len(text.translate(None, _CONTINUATION + BLANKS)),
                len(text) - len(text.translate(None, SYMBOLS)),
                repeated,
                again,
                failed,
                not failed and content >= share * n,
                content / n if n else 0.0,
                len(lines),
            ))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *_COLUMNS]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())
    return map_texts(docs, judged, schema, id_col, text_col)


_COLUMNS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "base_failed": "boolean",
    "kept": "boolean",
    "content_share": "double",
    "n_lines": "bigint",
}
