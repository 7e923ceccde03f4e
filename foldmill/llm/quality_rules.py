"""Quality rules with line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or
boilerplate by Viterbi decoding; the share of words in content lines decides
retention, after fixed base rules. The field is trained here, on lines of a
bounded sample of labelled documents: lines of documents labelled bad count as
boilerplate, the others as content; no feature of a line makes its label.

Results by case: null and empty texts have no words and fail the base rules;
repeated rows give repeated results; without labels of both kinds the field
keeps fixed start weights that call every line content; texts are read whole;
ties between paths go to content; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.llm._shared import as_bytes, table
from foldmill.llm.quality_classifier import labelled

FEATURES = ["bias", "log_words", "symbols", "upper", "digits", "pipes", "bangs", "high", "ends", "short", "repeat", "word_len"]
#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_CLASS = np.zeros(256, np.int64)  # 0: other
for _k, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), SYMBOLS, b"!", b" \t\n\r\x0b\x0c", range(128, 256), b"|"], 1):
    for _b in _bytes:
        _CLASS[_b] = _k
_N = 9


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and number of words of each line with a word."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    raw = np.frombuffer(b"".join(lines), np.uint8)
    kinds = _CLASS[raw]
    line = np.repeat(np.arange(len(lines)), sizes)
    n = np.bincount(line * _N + kinds, minlength=len(lines) * _N).reshape(-1, _N).astype(float)
    space = kinds == 6
    begins = ~space
    begins[1:] &= space[:-1] | (line[1:] != line[:-1])
    words = np.bincount(line[begins], minlength=len(lines)).astype(float)
    solid = np.maximum(1, sizes - n[:, 6])
    seen: set[bytes] = set()
    again = [x in seen or bool(seen.add(x)) for x in lines]
    ends = [x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines]
    f = np.stack([np.ones(len(lines)), np.log1p(words) / 4, (n[:, 4] + n[:, 8]) / solid, n[:, 2] / np.maximum(1, n[:, 1] + n[:, 2]), n[:, 3] / solid, n[:, 8] / np.maximum(1, words), n[:, 5] / np.maximum(1, words), n[:, 7] / solid, ends, words < 4, again, solid / np.maximum(1, words) / 10], 1)
    return f, words


@dataclass
class LineField:
    """Weights of a chain with two states, 1 for content. ``emit`` favours content; ``step`` goes from row to column."""

    emit: np.ndarray = field(default_factory=lambda: np.r_[2.0, np.zeros(len(FEATURES) - 1)])
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def viterbi(self, f: np.ndarray) -> list[int]:
        if not len(f):
            return []
        (aa, ab), (ba, bb) = self.step.tolist()
        e = (f @ self.emit).tolist()
        a, b = float(self.start[0]), float(self.start[1]) + e[0]
        back = []
        for x in e[1:]:
            from_a, from_b = a + ab >= b + bb, a + aa >= b + ba
            a, b, way = (a + aa if from_b else b + ba), (a + ab if from_a else b + bb) + x, (0 if from_b else 1, 0 if from_a else 1)
            back.append(way)
        out = [int(b >= a)]
        for way in reversed(back):
            out.append(way[out[-1]])
        return out[::-1]


def fit_field(seqs: list[np.ndarray], marks: list[np.ndarray], steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> LineField:
    """Maximum likelihood by forward and backward sums over all sequences at once, with Adam."""
    model = LineField()
    if not seqs or len({int(v) for m in marks for v in set(m.tolist())}) < 2:
        return model
    n, t, k = len(seqs), max(map(len, seqs)), len(FEATURES)
    x, y, on = np.zeros((n, t, k)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (s, m) in enumerate(zip(seqs, marks)):
        x[i, : len(s)], y[i, : len(s)], on[i, : len(s)] = s, m, True
    total = on.sum()
    theta = np.r_[model.emit, np.zeros(6)]
    theta[0] = 0
    own = np.zeros_like(theta)
    own[:k] = x[on].T @ y[on]
    for a in (0, 1):
        for b in (0, 1):
            own[k + 2 * a + b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & on[:, 1:]).sum()
        own[k + 4 + a] = (y[:, 0] == a).sum()
    m1 = m2 = np.zeros_like(theta)
    for i in range(1, steps + 1):
        step, start = theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
        e = np.stack([np.zeros((n, t)), x @ theta[:k]], 2)
        fwd, bwd = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fwd[:, 0] = start + e[:, 0]
        for j in range(1, t):
            new = np.logaddexp(fwd[:, j - 1, :1] + step[0], fwd[:, j - 1, 1:] + step[1]) + e[:, j]
            fwd[:, j] = np.where(on[:, j, None], new, fwd[:, j - 1])
        for j in range(t - 2, -1, -1):
            nxt = bwd[:, j + 1] + e[:, j + 1]
            new = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
            bwd[:, j] = np.where(on[:, j + 1, None], new, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        one = np.exp(fwd[..., 1] + bwd[..., 1] - z[:, None]) * on
        got = np.zeros_like(theta)
        got[:k] = np.einsum("ntk,nt->k", x, one)
        for a in (0, 1):
            for b in (0, 1):
                p = fwd[:, :-1, a] + step[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - z[:, None]
                got[k + 2 * a + b] = np.exp(np.where(on[:, 1:], p, -np.inf)).sum()
        got[k + 5] = one[:, 0].sum()
        got[k + 4] = n - got[k + 5]
        g = (own - got) / total - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-9)
    return LineField(theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :])


def train_field(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 1500, max_lines: int = 60) -> LineField:
    """Trains on at most ``max_rows`` labelled documents of at most ``max_lines`` lines; longer ones are left out of training only. Of rows with the same id one is taken, chosen before anything is collected."""

    def run(batches):
        for batch in batches:
            for doc_id, text, mark in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                f, _ = line_features(text or b"")
                if 0 < len(f) <= max_lines:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], batch.column(0).type), pa.array([f.ravel().tolist()], pa.list_(pa.float64())), pa.array([mark], pa.int32())], names=["doc_id", "f", "label"])

    rows = labelled(docs, labels, label, max_rows)
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.selectExpr("doc_id", "text", "cast(label as int) as label").mapInArrow(run, f"doc_id {kind}, f array<double>, label int")
    got = got.groupBy("doc_id").agg(F.min(F.struct("f", "label")).alias("x")).select("x.*").collect()
    got = sorted((list(r["f"]), r["label"]) for r in got)
    seqs = [np.array(f).reshape(-1, len(FEATURES)) for f, _ in got]
    return fit_field(seqs, [np.full(len(s), int(mark > 0)) for s, (_, mark) in zip(seqs, got)])


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words as the contract words them."""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(hist.sum() - hist[0x80:0xC0].sum())
    chars = points - int(hist[[9, 10, 11, 12, 13, 32]].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n, repeat = len(words), 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
        _, back, count = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[back] > 1)
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[at + k] = True
        repeat = int(hit.sum())
    return chars, int(hist[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeat


def apply_rules(docs: DataFrame, model: LineField, least_words: int = 50, most_repeat: int = 50, least_content: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, n_lines, kept for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words", "n_lines"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                text = text or b""
                words = text.split()
                base = base_counts(text, words)
                failed = len(words) < least_words or 100 * base[3] > most_repeat * len(words)
                f, per_line = line_features(text)
                content = int(sum(w for w, s in zip(per_line.tolist(), model.viterbi(f)) if s))
                rows.append((len(words), *base, failed, not failed and content >= least_content * len(words), content, len(f)))
            cols = list(zip(*rows)) or [()] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    own = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long, n_lines long")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train_field(docs, table(spark, sf_dir, "labels")))
