"""Quality classifier by Bradley-Terry pairwise ranking.

Each pair of a preferred and a rejected labelled document says that the first has the higher score. Scores are linear
in the document's features, so the chance that a beats b is the logistic function of the weighted feature difference;
the weights minimise the mean logistic loss over all such pairs of all labelled documents (Newton's method with a small
ridge). A pair's loss depends on two scores only, so a step needs, for each label and each narrow range of scores, the
number of documents and the sums of their features and products; these are added up in tasks, and pairs are pairs of ranges.
The score at the quantile that the rejected documents fill among all training scores is the threshold; the reported score
is the logistic function of the distance to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.shared import WORD, cut, text_or_empty

NAMES = ("words", "word_chars", "long_word", "upper", "digits", "signs", "bangs", "bars", "stops", "distinct", "next_same", "dup_lines", "dup_windows", "top_word", "letters", "line_words")


def features(text: str) -> list[float]:
    """Numbers about the form of one whole text; an empty text gives zeros."""
    import re

    words = re.findall(WORD, text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "replace")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = sum(map(len, words))
    codes: dict[str, int] = {}
    at = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    counts = np.bincount(at)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    windows = at[:-2] * len(codes) ** 2 + at[1:-1] * len(codes) + at[2:] if n > 2 else np.empty(0)
    letters = by[97:123].sum() + by[192:].sum()
    upper = by[65:91].sum()
    stops = by[44] + by[46]
    return [
        float(np.log1p(n)), chars / n, float(np.log1p(max(map(len, words)))), float(upper / (upper + letters + 1)), float(by[48:58].sum() / chars),
        float(sum(by[ord(c)] for c in "#*$%&<>") / chars), float(by[33] / n), float(by[124] / n), float(stops / n), len(codes) / n,
        float((at[1:] == at[:-1]).mean()) if n > 1 else 0.0, 1 - len(set(lines)) / max(1, len(lines)),
        1 - len(np.unique(windows)) / max(1, len(windows)), float(counts.max() / n), float(letters / chars), float(np.log1p(n / max(1, len(lines)))),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
        cols = [*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "features"])


def _standard(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features from -6 to 6, in steps that let sums of products be exact in any order."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    return np.rint(np.clip((x - mean) / scale, -6, 6) * 4096) / 4096


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's rows: labels 0, labels 1, features, their squares."""
    total = np.zeros(2 + 2 * len(NAMES))
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
        ones = int(pc.sum(batch.column(0)).as_py() or 0)
        total += [len(x) - ones, ones, *x.sum(axis=0), *(x * x).sum(axis=0)]
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])


_HALF = np.triu_indices(len(NAMES))


def _added(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of sums that belong to one range, added."""
    total: dict[int, np.ndarray] = {}
    for ranges, sums in parts:
        order = np.argsort(ranges, kind="stable")
        keys, begins = np.unique(ranges[order], return_index=True)
        for k, row in zip(keys.tolist(), np.add.reduceat(sums[order], begins) if len(keys) else (), strict=True):
            total[k] = total[k] + row if k in total else row
    flat = pa.array([x.tobytes() for x in total.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), flat], ["range", "sums"])


def _ranges(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, width: float) -> Iterator[pa.RecordBatch]:
    """For each label and range of scores of a task: rows, sums of features, and of their products (half the matrix)."""

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            z, y = _standard(batch, mean, scale), batch.column(0).to_numpy(zero_copy_only=False)
            ranges = 2 * np.floor((z * weights).sum(axis=1) / width).astype(np.int64) + y
            yield ranges, np.hstack([np.ones((len(z), 1)), z, z[:, _HALF[0]] * z[:, _HALF[1]]])

    yield _added(parts())


def _add_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    each = 1 + len(NAMES) + len(_HALF[0])
    yield _added((b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(-1, each)) for b in batches)


def _pair_sums(learnt: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs, its downhill gradient and its curvature."""
    k = len(NAMES)
    width = max(1 / 8, 12 * float(np.abs(w).sum()) / 1024)  # 1,024 ranges a label at most, or an eighth wide
    schema = "range long, sums binary"
    own = learnt.mapInArrow(lambda it: _ranges(it, mean, scale, w, width), schema)
    found = own.repartition("range").mapInArrow(_add_ranges, schema).toPandas().sort_values("range")
    sums = np.array([np.frombuffer(b) for b in found["sums"]])
    full = np.empty((k, k), np.int64)
    full[_HALF] = full[_HALF[::-1]] = np.arange(len(_HALF[0]))
    good, bad = (sums[(found["range"] % 2 == y).to_numpy()] for y in (1, 0))
    (n1, x1, xx1), (n0, x0, xx0) = ((t[:, 0], t[:, 1 : k + 1], t[:, k + 1 :][:, full]) for t in (good, bad))
    # scores of a range are its mean and the terms of second order around it, for which the products are there
    (m1, v1, c1), (m0, v0, c0) = (((m := x @ w / n), (xx @ w) @ w - n * m * m, xx @ w - m[:, None] * x) for n, x, xx in ((n1, x1, xx1), (n0, x0, xx0)))
    gap = m0[None, :] - m1[:, None]
    wrong = 1 / (1 + np.exp(-np.clip(gap, -500, 500)))
    bend = wrong * (1 - wrong)
    turn = bend * (1 - 2 * wrong) / 2
    pairs = n1.sum() * n0.sum()
    cross = x1.T @ bend @ x0
    loss = float(n1 @ np.logaddexp(0, gap) @ n0 + (v1 @ bend @ n0 + n1 @ bend @ v0) / 2)
    down = x1.T @ (wrong @ n0 + turn @ v0 + v1 / n1 * (turn @ n0)) - c1.T @ (bend @ n0)
    down -= x0.T @ (wrong.T @ n1 + turn.T @ v1 + v0 / n0 * (turn.T @ n1)) + c0.T @ (bend.T @ n1)
    curve = np.tensordot(bend @ n0, xx1, 1) + np.tensordot(bend.T @ n1, xx0, 1) - cross - cross.T
    return loss / pairs, down / pairs, curve / pairs


def fit_weights(learnt: DataFrame, mean: np.ndarray, scale: np.ndarray, ridge: float = 2.5e-5) -> np.ndarray:
    """Weights of the least mean loss over all pairs of a row with label 1 and one with label 0."""
    w, step, best = np.zeros(len(NAMES)), np.zeros(len(NAMES)), np.inf
    for _ in range(25):
        loss, down, curve = _pair_sums(learnt, mean, scale, w)
        loss += ridge / 2 * float(w @ w)
        if loss > best + 1e-6:  # too far
            step = step / 2
            w = w - step
            continue
        best = loss
        step = np.linalg.solve(curve + ridge * np.eye(len(w)), down - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    return w


def nth(values: DataFrame, rank: int, buckets: int = 4096, small: int = 20_000) -> float:
    """The value of column ``s`` with ``rank`` smaller ones (or equal ones before it): counts in ever narrower buckets."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        here = values.where(F.col("s").between(low, high))
        at = F.least(F.lit(buckets - 1), F.floor((F.col("s") - low) / ((high - low) / buckets)))
        for b in sorted(here.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()):
            if rank < b["n"]:
                break
            rank -= b["n"]
        low, high = b["low"], b["high"]
        if low < high and b["n"] <= small:
            return sorted(r["s"] for r in values.where(F.col("s").between(low, high)).collect())[rank]
    return low


def fit_pairs(learnt: DataFrame) -> dict:
    """Weights and the threshold among the scores of ``learnt`` (y, features), from all its rows."""
    k = len(NAMES)
    # one row for each task
    sums = np.array(learnt.mapInArrow(_moments, "sums array<double>").toPandas()["sums"].tolist(), float).reshape(-1, 2 + 2 * k).sum(axis=0)
    (bad, good), n = sums[:2], max(1.0, sums[:2].sum())
    mean = sums[2 : 2 + k] / n
    scale = np.sqrt(np.maximum(0, sums[2 + k :] / n - mean * mean)) + 1e-6
    # in nine digits, as sums of fractions differ in their last ones from run to run
    mean, scale = (np.array([float(f"{v:.9g}") for v in x]) for x in (mean, scale))
    if not good or not bad:
        return {"mean": mean, "scale": scale, "weights": np.zeros(k), "threshold": -1.0 if good else 0.0}
    model = {"mean": mean, "scale": scale, "weights": fit_weights(learnt, mean, scale)}
    scores = learnt.select(linear(model).alias("s"))
    share = bad / n
    low, high = (nth(scores, int(q * (n - 1))) for q in (share, min(1.0, share + 0.02)))
    return model | {"threshold": float((low + high) / 2)}


def linear(model: dict) -> Column:
    """The weighted sum of the standardised features."""
    total = F.lit(0.0)
    for i, (m, s, w) in enumerate(zip(model["mean"], model["scale"], model["weights"], strict=True)):
        z = (F.col("features")[i] - F.lit(float(m))) / F.lit(float(s))
        total = total + F.lit(float(w)) * F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z))
    return total


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Learns from all rows with a label of 0 or 1 and ``crc32(id as text) mod 3 != fold``; held_out marks the others.
    Labels, language, source and id are no features. Null and empty texts have zero features and get a score like any
    other. Rows with a null label are not learnt from; of several labels of one id the smallest counts. A null id is never
    learnt from and not held out. Without two classes of labels all scores are equal. Other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == fold, F.lit(False))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    made = cut(plain.mapInArrow(_features, "doc_id long, features array<double>"), "features")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    learnt = cut(made.join(known.where(~held), "doc_id").where("y IN (0, 1)").select("y", "features"), "learnt")
    model = fit_pairs(learnt)
    score = 1 / (1 + F.exp(F.lit(model["threshold"]) - linear(model)))
    return made.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
