"""Quality classifier: a sparse rule ensemble compiled into Spark columns (operator 10).

1. Every whole text becomes a row of statistics (shares of letter cases, digits, marks,
   repeats and so on).  Labels, lang, source and doc_id are never among them.
2. Boosted shallow trees over the statistics of labelled rows are taken apart: each path
   from a root to a node is a rule, a conjunction of comparisons.
3. Lasso logistic regression over the rules keeps few of them.
4. The kept rules are one column expression; scoring is whole-stage code over statistics.

Fitting uses at most ``MAX_ROWS`` labelled rows (those of the smallest hashes of doc_id),
never a row whose crc32(doc_id as text) mod 5 is 0.  Scoring covers every row.

Null texts count as empty and get a score like any.  Rows whose label is null take no part;
of repeated labels of a doc_id the smallest counts.  Without labels of both kinds all
documents get the same score: the labels' mean, or 0.5 without any.  Repeated rows stay;
an empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import keyed_texts, pieces_of, small_batches

MAX_ROWS, FOLDS, THRESHOLD = 20_000, 5, 0.3
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "capital_words", "digits", "marks", "stops", "doubled_marks", "bars",
    "shouts", "brackets", "space", "lines", "high", "distinct_words", "commonest_word", "repeated_word", "mark_ended", "bytes_a_line",
)
_CLASS = np.zeros(256, np.int64)  # 0 other, then as below
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+-/:;<=>@\\^_`~\"'()[]{}", b".,", b"|", b"!?", b" \t\r\x0b\x0c", b"\n"), 1):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 9
_MARKS = frozenset(b"#$%&*+-/:;<=>@\\^_`~|!?")


def statistics(text: bytes) -> tuple[float, ...]:
    n = len(text)
    words = text.split()
    if not words:
        return (float(np.log1p(n)),) + (0.0,) * (len(STATISTICS) - 1)
    raw = np.frombuffer(text, np.uint8)
    seen = np.bincount(raw, minlength=256)
    _, upper, digit, mark, stop, bar, shout, space, line, high = np.bincount(_CLASS, weights=seen, minlength=10)
    brackets = seen[list(b"()[]{}<>")].sum()
    doubled = ((raw[1:] == raw[:-1]) & (_CLASS[raw[1:]] >= 3) & (_CLASS[raw[1:]] <= 6)).sum()
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    k = len(words)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    ended = sum(w[-1] in _MARKS for w in words)
    capital = sum(w.isupper() for w in words)
    return (
        float(np.log1p(n)), float(np.log1p(k)), (n - space - line) / k, upper / n, capital / k, digit / n, mark / n, stop / n, doubled / n, bar / n,
        shout / n, brackets / n, space / n, line / n, high / n, len(count) / k, max(count.values()) / k, repeated / k, ended / k, float(np.log1p(n / (line + 1))),
    )


def prefix_for(docs: DataFrame) -> str:
    """What the statistics' columns begin with: ``_stat_``, with more underscores where docs has such columns."""
    prefix = "_stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def own_columns(docs: DataFrame, *but: str) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in but]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one double column for each statistic, named ``prefix_for(docs)`` and the statistic."""
    prefix = prefix_for(docs)
    small_batches(docs.sparkSession)
    schema = StructType(list(docs.schema.fields))
    for name in STATISTICS:
        schema = schema.add(prefix + name, "double")

    at = docs.columns.index(text)

    def run(batches):
        for b in pieces_of(batches, size=4 << 20, column=text):
            rows = np.array([statistics((t or "").encode()) for t in b.column(at).to_pylist()], np.float64)
            rows = rows.reshape(-1, len(STATISTICS))
            arrays = list(b.columns) + [pa.array(rows[:, i].copy()) for i in range(rows.shape[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    # Plain names on the way in: Python stages take no names with dots.
    return docs.toDF(*[text if i == at else f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int):
    """A second-order regression tree.  Returns its rules and each row's step."""
    rules: list[tuple] = []
    step = np.zeros(len(x))

    def node(rows: np.ndarray, path: tuple) -> None:
        if path:
            rules.append(path)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 2 * least:
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, weights=g[rows], minlength=len(edges) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, weights=h[rows], minlength=len(edges) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(edges) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            step[rows] = -gs / (hs + 1)
            return
        f, k = best[1]
        low = binned[rows, f] <= k
        node(rows[low], (*path, (f, "<=", float(cuts[f][k]))))
        node(rows[~low], (*path, (f, ">", float(cuts[f][k]))))

    node(np.arange(len(x)), ())
    return rules, step


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, value in rule:
        out &= x[:, f] <= value if op == "<=" else x[:, f] > value
    return out


@dataclass
class RuleEnsemble:
    """bias + sum of the weights of the rules that hold, through the logistic function."""

    bias: float
    rules: list[tuple] = field(default_factory=list)  # ((statistic, "<=" or ">", value), ...)
    weights: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 48, penalty: float = 2e-3, rounds: int = 400):
        y = np.asarray(y, float)
        mean = float(y.mean()) if len(y) else 0.5
        if len(y) == 0 or mean in (0.0, 1.0):
            safe = min(max(mean, 1e-3), 1 - 1e-3)
            return cls(float(np.log(safe / (1 - safe))))
        cuts = []
        for f in range(x.shape[1]):
            q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))
            top = x[:, f].max()
            cuts.append(q[q < top])
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        least = max(5, len(y) // 200)
        margin, rules = np.full(len(y), np.log(mean / (1 - mean))), {}
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            found, step = _grow(x, cuts, binned, p - y, np.maximum(p * (1 - p), 1e-6), depth, least)
            margin = margin + 0.3 * step
            rules.update(dict.fromkeys(found))
        kept, columns, known = [], [], set()
        for rule in rules:
            holds = _holds(x, rule)
            key = holds.tobytes()
            if 0 < holds.sum() < len(y) and key not in known:
                known.add(key)
                kept.append(rule)
                columns.append(holds)
        if not kept:
            return cls(float(np.log(mean / (1 - mean))))
        a = np.stack(columns, axis=1).astype(float)
        scale = np.maximum(a.std(axis=0), 0.05)
        a = a / scale
        w, bias = cls._lasso(a, y, penalty, rounds)
        w = w / scale
        used = np.flatnonzero(w)
        return cls(float(bias), [kept[i] for i in used], [float(w[i]) for i in used])

    @staticmethod
    def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int):
        """Accelerated proximal gradient; the bias is not penalised."""
        n, m = a.shape
        centre = a.mean(axis=0)
        a = a - centre
        v = np.ones(m)
        for _ in range(30):
            v = a.T @ (a @ v)
            v /= np.linalg.norm(v) or 1
        rate = 1 / (0.25 * max(np.linalg.norm(a @ v) ** 2 / n, 1.0))
        w, bias = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
        wz, bz, t = w, bias, 1.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(a @ wz + bz)))
            new = wz - rate * (a.T @ (p - y)) / n
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
            new_bias = bz - rate * float((p - y).mean())
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            wz, bz = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
            w, bias, t = new, new_bias, t_new
        return w, bias - float(centre @ w)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights):
            z += w * _holds(x, rule)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "_stat_") -> Column:
        """The ensemble as one Spark expression over the statistics columns."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            holds = None
            for f, op, value in rule:
                c = F.col(prefix + STATISTICS[f])
                c = c <= F.lit(value) if op == "<=" else c > F.lit(value)
                holds = c if holds is None else holds & c
            z = z + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Fits on at most max_rows labelled rows of docs outside the held-out fold."""
    marked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # Bounded by max_rows, so it can be broadcast; one row for each doc_id, should rows repeat.
    found = keyed_texts(docs).join(F.broadcast(marked), "doc_id")
    rows = with_statistics(found).drop("text").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(max_rows).collect()
    x = np.array([r[2:] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return RuleEnsemble.fit(x, np.array([r["_label"] for r in rows], float))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted; columns of these names give way to them."""
    value = model.column(prefix_for(docs))
    return with_statistics(docs).select(
        *own_columns(docs, "held_out", "score", "predicted"),
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        value.alias("score"),
        F.when(value >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(keyed_texts(docs), fit(docs, labels)).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns."""
    model = fit(docs, labels)
    return with_statistics(docs).where(model.column(prefix_for(docs)) >= threshold).select(*own_columns(docs))
