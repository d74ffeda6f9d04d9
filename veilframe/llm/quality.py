"""Quality classifier by co-training: one view of the text, one of the page's metadata.

Each view has its own logistic regression. Both start from the labelled rows.
In every round each view is fitted on the labelled rows and on all other rows
of the whole table of which the other view is sure; in the end each view is
calibrated on labelled rows that were held back, and so is the combination of
both, which scores all documents.

Only the labelled rows come to the driver, at most ``LABELLED`` of them. What
the other rows add to a fit are sums over the table (gradients and Hessians by
class), made where the rows are. Features, weights of rows and residuals are
whole numbers there, so the sums are exact and do not depend on how the rows
are spread. What is sent to the tasks are the weights.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.memory import lean, release_memory
from veilframe.llm.tokens import text_slices
from veilframe.session import discard, free_shuffles, materialize, spread

# Bound of the labelled rows that are fitted on.
LABELLED = 16_000
ROUNDS = 3
STEPS = 6  # of Newton's method in a round; each one is a pass over the table
SURE = 0.97
HELD_BACK = 4  # every fourth labelled row calibrates
BUCKETS = 64  # for hashed metadata
ROWS = 1024  # that are standardized at a time on the driver
WORDS, GRAMS = 64, 64  # buckets for hashed words and for runs of three bytes
# A feature is a whole number of 1/256 of its spread, a row's weight and its residual of 1/1024.
UNIT, PART, REACH = 256, 1024, 6
# Hashed features of the text count this much of their spread, so that a few hundred labels don't fit words by chance.
HASHED = 0.25

SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\/=+_`", np.uint8)


def text_features(text: str) -> list[float]:
    """Shares and averages over the whole text, and which words and runs of three bytes it has, hashed; all 0 for an empty one."""
    data = text.encode()
    n = len(data)
    words = data.split()
    m = len(words)
    if not m:
        return [0.0] * TEXT_FEATURES
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = hist / n
    counts = Counter(words)
    many = sorted(counts.values(), reverse=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    sizes = list(map(len, words))
    mean = sum(sizes) / m
    letters = share[65:91].sum() + share[97:123].sum()
    high = share[128:].sum()
    ends = share[46] + share[33] + share[63]
    used = share[share > 0]
    said = np.zeros(WORDS)
    np.add.at(said, [crc32(w.lower()) % WORDS for w in counts], list(counts.values()))
    wide = np.frombuffer(data, np.uint8).astype(np.uint32)
    grams = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 6)
    runs = np.bincount(grams, minlength=GRAMS)[:GRAMS]
    return [
        np.log1p(m), mean, max(sizes) / (mean + 1), len(counts) / m, np.log1p(m) * len(counts) / m, many[0] / m, sum(many[:5]) / m,
        sum(map(operator.eq, words, words[1:])) / m, letters, high, share[65:91].sum(), share[48:58].sum(), share[SYMBOLS].sum(), share[124],
        share[44], ends, ends * mean, share[10], len(set(lines)) / len(lines), np.log1p(n / len(lines)), float(-(used * np.log(used)).sum()),
        share[32], share[58] + share[59], share[34] + share[39], 1.0 / m, share[45],
        *np.sqrt(said / m).tolist(), *np.sqrt(runs / n).tolist(),
    ]


SHARES = 26
TEXT_FEATURES = SHARES + WORDS + GRAMS
PAGE_FEATURES = BUCKETS + 10


def page_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What is known without the text: source and language, hashed, and the length given for the page."""
    out = [0.0] * PAGE_FEATURES
    for name in (f"lang {lang}", f"source {source}", f"{lang} {source}"):
        out[xxhash.xxh32_intdigest(name) % BUCKETS] += 1.0
    out[BUCKETS] = float(n_chars is None)
    if n_chars is not None:
        size = np.log1p(max(0, n_chars))
        out[BUCKETS + 1:BUCKETS + 3] = [size, size * size / 10]
        out[BUCKETS + 3 + min(6, int(size / 2))] = 1.0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class View:
    """A logistic regression on standardized features, the first ones also squared, and its calibration."""

    squares: int
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    spread: np.ndarray = field(default_factory=lambda: np.ones(1))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: float = 1.0
    shift: float = 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Features in whole parts of their spread over the labelled rows."""
        z = np.clip((x - self.mean) / self.spread, -REACH, REACH)
        if self.squares:
            z[:, self.squares:] *= HASHED
        return np.rint(z * UNIT).astype(np.int16)

    def laid(self, x: np.ndarray) -> np.ndarray:
        """:meth:`columns` of raw features, made from a few rows at a time."""
        out = np.empty((len(x), x.shape[1] + min(self.squares, x.shape[1]) + 1))
        for low in range(0, len(x), ROWS):
            out[low:low + ROWS] = self.columns(self.standard(x[low:low + ROWS]))
        return out

    def columns(self, q: np.ndarray) -> np.ndarray:
        """What the weights belong to, times ``UNIT``: the features, squares, and a constant."""
        q = q.astype(np.float64)
        first = q[:, :self.squares]
        return np.column_stack([q, np.rint(first * first / (REACH * UNIT)), np.full(len(q), float(UNIT))])

    def fit(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 12, ridge: float = 1.0) -> None:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0)
        self.spread[self.spread < 1e-9] = 1.0
        z = self.laid(x)
        z /= UNIT
        self.weights = newton(z, y, steps, ridge, n)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.laid(x) @ self.weights / UNIT

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        return self.scale * self.raw(x) + self.shift


def newton(z: np.ndarray, y: np.ndarray, steps: int, ridge: float, n: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression with a small ridge; row i counts ``n[i]`` times."""
    n = np.ones(len(z)) if n is None else n
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        pull = n * np.maximum(p * (1 - p), 1e-4)
        w = w + np.linalg.solve((z * pull[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (n * (y - p)) - ridge * w)
    return w


@dataclass
class Model:
    text: View
    page: View
    combine: np.ndarray  # of the two views' log-odds, and a constant
    rounds: list[tuple[int, int]] = field(default_factory=list)  # rows that the text and that the page was sure of

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.odds(text), self.page.odds(page)
        return sigmoid(a), sigmoid(b), sigmoid(np.column_stack((a, b, np.ones(len(a)))) @ self.combine)


def sums(pupils: list[View], teachers: list[View], known: list[np.ndarray], sure: float = SURE) -> np.ndarray:
    """What rows that the teachers are sure of add to the fit of the pupils, as whole numbers that may be added up.

    ``known`` holds the standardized features of both views. For each pupil and
    each class: number of rows, gradient, and upper half of the Hessian, of the
    rows that the *other* view is sure to be of the class.
    """
    out = []
    spoken = [sigmoid(t.scale * (t.columns(q) @ t.weights / UNIT) + t.shift) for t, q in zip(teachers, known)]
    for pupil, q, told in zip(pupils, known, spoken[::-1]):
        for kind in (0, 1):
            z = pupil.columns(q[told >= sure if kind else told <= 1 - sure])
            p = sigmoid(z @ pupil.weights / UNIT)
            pull = np.rint(PART * np.maximum(p * (1 - p), 1 / PART))
            half = (z * pull[:, None]).T @ z
            out += [[len(z)], np.rint(PART * (kind - p)) @ z, half[np.triu_indices(len(half))]]
    return np.concatenate(out).astype(np.int64)


def parts(added: np.ndarray, widths: list[int]) -> list[list[tuple[float, np.ndarray, np.ndarray]]]:
    """The sums by view and class: number of rows, gradient, Hessian."""
    out, at = [], 0
    for d in widths:
        kinds = []
        for _ in range(2):
            n, pull = float(added[at]), np.array(added[at + 1:at + 1 + d], float) / (PART * UNIT)
            full = np.zeros((d, d))
            full[np.triu_indices(d)] = np.array(added[at + 1 + d:at + 1 + d + d * (d + 1) // 2], float) / (PART * UNIT * UNIT)
            kinds.append((n, pull, full + np.triu(full, 1).T))
            at += 1 + d + d * (d + 1) // 2
        out.append(kinds)
    return out


def share_only(model: Model, widths: tuple[int, int], share: float) -> Model:
    odds = float(np.log(share / (1 - share)))
    for view, width in zip((model.text, model.page), widths):
        view.mean, view.spread = np.zeros(width), np.ones(width)
        view.weights = np.zeros(width + min(width, view.squares) + 1)
        view.shift = odds
    return model


def teach(text: np.ndarray, page: np.ndarray, label: np.ndarray, n: np.ndarray, others: Callable[[Model], Callable[[list[View], list[View]], np.ndarray]],
          rounds: int = ROUNDS, ridge: float = 1.0) -> Model:
    """Fit both views on labelled rows, of which row i counts ``n[i]`` times, and on all others.

    ``others(model)`` is asked once, when the features' means and spreads are
    known, for a function that gives the :func:`sums` over all other rows. Per
    class, these weigh at most as much as the labelled rows, however many they
    are. With labels of one kind or none, every score is their share (0.5
    without).
    """
    model = Model(View(SHARES), View(0), np.array([1.0, 0.0, 0.0]))
    held = np.arange(len(label)) % HELD_BACK == HELD_BACK - 1
    if len(set(label[~held].tolist())) < 2:
        return share_only(model, (text.shape[1], page.shape[1]), ((n * label).sum() + 1) / (n.sum() + 2))
    views, data = [model.text, model.page], [text, page]
    for view, x in zip(views, data):
        view.fit(x[~held], label[~held], n[~held], ridge=ridge)
        calibrate(view, x[held], label[held], n[held])
    ask = others(model)
    laid = [view.laid(x[~held]) for view, x in zip(views, data)]
    for z in laid:
        z /= UNIT
    most = [(n * (label == kind))[~held].sum() for kind in (0, 1)]
    for _ in range(rounds):
        teachers = [replace(view) for view in views]
        for view in views:
            # From the start again: Newton's steps overshoot from weights that are sure of rows which are now told otherwise.
            view.weights = np.zeros(len(view.weights))
        for _ in range(STEPS):
            found = parts(ask(views, teachers), [z.shape[1] for z in laid])
            for view, z, kinds in zip(views, laid, found):
                p = sigmoid(z @ view.weights)
                full = (z * (n[~held] * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + ridge * np.eye(z.shape[1])
                pull = z.T @ (n[~held] * (label[~held] - p)) - ridge * view.weights
                for (count, g, h), limit in zip(kinds, most):
                    weigh = min(1.0, limit / count) if count else 0.0
                    full, pull = full + weigh * h, pull + weigh * g
                view.weights = view.weights + np.linalg.solve(full, pull)
        for view, x in zip(views, data):
            calibrate(view, x[held], label[held], n[held])
        # The text was told what the page was sure of, and the other way round.
        model.rounds.append((int(found[1][0][0] + found[1][1][0]), int(found[0][0][0] + found[0][1][0])))
    if held.any() and len(set(label[held].tolist())) == 2:
        both = np.column_stack((model.text.odds(text[held]), model.page.odds(page[held]), np.ones(held.sum())))
        model.combine = newton(both, label[held], 15, 1.0, n[held])
    return model


def co_train(text: np.ndarray, page: np.ndarray, label: np.ndarray, pool_text: np.ndarray, pool_page: np.ndarray, rounds: int = ROUNDS,
             sure: float = SURE) -> Model:
    """The same for rows at hand, and a pool of others."""

    def others(model: Model) -> Callable[[list[View], list[View]], np.ndarray]:
        known = [model.text.standard(pool_text), model.page.standard(pool_page)]
        return lambda pupils, teachers: sums(pupils, teachers, known, sure)

    return teach(text, page, label, np.ones(len(label)), others, rounds)


def calibrate(view: View, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """Platt scaling on rows that were held back."""
    view.scale, view.shift = 1.0, 0.0
    if len(set(y.tolist())) == 2:
        view.scale, view.shift = newton(np.column_stack((view.raw(x), np.ones(len(x)))), y, 15, 1e-3, n).tolist()


def features(docs: DataFrame) -> DataFrame:
    """``doc_id``, and both views' features as bytes of doubles, of ``docs(doc_id, text, lang, source, n_chars)``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text, page in _views(batches):
            yield pa.RecordBatch.from_arrays([rows["doc_id"], _packed(text), _packed(page)], names=["doc_id", "text_view", "page_view"])

    return _own(docs).mapInArrow(lean(made), "doc_id long, text_view binary, page_view binary")


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"),
                       F.col("n_chars").cast("long"))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for rows in text_slices(batch, "text"):
            text = np.array([text_features(t or "") for t in rows["text"].to_pylist()], float)
            known = zip(rows["lang"].to_pylist(), rows["source"].to_pylist(), rows["n_chars"].to_pylist())
            yield rows, text, np.array([page_features(*k) for k in known], float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED) -> Model:
    """Fit on at most ``labelled`` rows with a label of ``labels(doc_id, <label>)``, and on all documents without one of these labels.

    Rows with a null id or label are left out, and so are labels other than 0 and
    1. A document that is labelled twice counts twice. Rows that are equal and
    have equal labels are one row with a weight, so that neither a label nor a
    document that is repeated often fills the sample, which is drawn by hashes.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    sample = known.groupBy("doc_id", "_label").agg(F.count(F.lit(1)).alias("_times")).orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(labelled)
    sample = materialize(sample, "labelled")
    ids = F.broadcast(sample.select("doc_id").distinct())
    seen = features(_own(docs).join(ids, "doc_id", "left_semi")).groupBy("doc_id", "text_view", "page_view").agg(F.count(F.lit(1)).alias("_rows"))
    order = [F.xxhash64("doc_id", "_label", "text_view", "page_view"), F.col("doc_id"), F.col("_label"), F.col("text_view"), F.col("page_view")]
    rows = seen.join(F.broadcast(sample), "doc_id").orderBy(*order).limit(labelled).select(
        "doc_id", "_label", "text_view", "page_view", (F.col("_rows") * F.col("_times")).alias("_n"))
    # The driver has little memory beside these rows: what earlier jobs left there goes first.
    free_shuffles(docs.sparkSession)
    rows = rows.toArrow().sort_by([(c, "ascending") for c in ("doc_id", "_label", "text_view", "page_view")])
    release_memory()
    tables = []

    def others(model: Model) -> Callable[[list[View], list[View]], np.ndarray]:
        rest = spread(_own(docs)).join(ids, "doc_id", "left_anti")
        tables.append(materialize(standardized(rest, model), "standardized"))
        return lambda pupils, teachers: table_sums(tables[0], pupils, teachers)

    model = teach(unpacked(rows["text_view"], TEXT_FEATURES), unpacked(rows["page_view"], PAGE_FEATURES),
                  *(rows[c].to_numpy().astype(float) for c in ("_label", "_n")), others)
    del rows
    release_memory()
    discard(sample, *tables)
    return model


def unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Bytes of ``width`` doubles as rows; the column's own memory where it lies in one piece."""
    data = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    if not len(data):
        return np.empty((0, width))
    return np.frombuffer(data.buffers()[2], np.float64, len(data) * width, data.offset * width * 8).reshape(-1, width)


def standardized(docs: DataFrame, model: Model) -> DataFrame:
    """Both views' standardized features, as bytes of 16-bit whole numbers."""
    text_model, page_model = model.text, model.page

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text, page in _views(batches):
            yield pa.RecordBatch.from_arrays([_packed(text_model.standard(text)), _packed(page_model.standard(page))], names=["text_view", "page_view"])

    return docs.mapInArrow(lean(made), "text_view binary, page_view binary")


def table_sums(table: DataFrame, pupils: list[View], teachers: list[View], sure: float = SURE) -> np.ndarray:
    """:func:`sums` over a table of standardized features: one vector for each task, added up by Spark."""
    pupils, teachers = [replace(v) for v in pupils], [replace(v) for v in teachers]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            known = [np.frombuffer(b"".join(batch[c].to_pylist()), np.int16).reshape(batch.num_rows, -1) for c in ("text_view", "page_view")]
            total = total + sums(pupils, teachers, known, sure)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "part"])

    found = table.mapInArrow(lean(made), "at int, part long").groupBy("at").agg(F.sum(F.col("part").cast("decimal(20,0)")).cast("double").alias("part")).toPandas()
    out = np.zeros(sum(2 * (1 + d + d * (d + 1) // 2) for d in (len(v.weights) for v in pupils)))
    out[found["at"].to_numpy(int)] = found["part"].to_numpy(float)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``p_text``, ``p_page`` and ``score`` to every row of ``docs(doc_id, text, lang, source, n_chars, ...)``.

    The probability of good quality by the text, by the metadata and by both.
    Nulls in any column count as unknown metadata or as an empty text; repeated
    rows are all scored; columns of the new names are replaced; an empty table
    gives an empty one.
    """
    carry = docs.drop("p_text", "p_page", "score")
    names = carry.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text, page in _views(batches):
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in names), *(pa.array(x) for x in model.score(text, page))], names=[*names, "p_text", "p_page", "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in carry.dtypes)
    return carry.mapInArrow(lean(run), f"{kinds}, p_text double, p_page double, score double")
