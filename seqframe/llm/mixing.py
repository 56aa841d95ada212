"""Mixing to target weights with soft membership of documents in domains.

A classifier trained on the labelled table gives each document a posterior over the domains. Of the
rates r_i >= 0 whose expected domain tokens sum(r_i n_i p_i) are the targets, those with the least
sum(n_i (r_i - 1)^2) are

    r_i = max(0, 1 + p_i . l),

with one number l of each domain for all documents. Newton steps find l: where the rates of a set of
documents are positive, the expected tokens change by sum(n_i p_i p_i') over that set. A step is one
pass over (posterior, tokens) that sums these for a series of step lengths, of which the one with
the least value of the convex dual is taken. A weight of the rates' own distance, lowered from 1 in
RIDGES, makes the steps converge where targets are out of reach, too: then the rates go to those
whose tokens are nearest.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.subword import fit, posteriors
from seqframe.llm.util import map_batches, materialise

#: Shares of the domains q<quality>t<toxic> of the labelled table in the mixture.
WEIGHTS = {"q0t0": 0.08, "q0t1": 0.01, "q1t0": 0.90, "q1t1": 0.01}


#: Weights of the rates' distance against that of the tokens; the last moves met targets by less than the tolerance.
RIDGES = 10.0 ** -np.arange(0, 13, 2)
#: Step lengths tried in a pass.
LENGTHS = 0.5 ** np.arange(12)


def _floor(p: np.ndarray, kept: int, least: float) -> np.ndarray:
    """least for documents likeliest of the domain kept, else 0."""
    return np.where(p.argmax(axis=1) == kept, least, 0.0) if len(p) else np.zeros(0)


def _rates(p: np.ndarray, dual: np.ndarray, floor: np.ndarray, most: float = np.inf) -> np.ndarray:
    return np.clip(1 + p @ dual, floor, most)


def _matrix(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    p = b.column(b.schema.get_field_index("p")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return p, b.column(b.schema.get_field_index("n_words")).to_numpy(zero_copy_only=False).astype(float)


def _total(table: DataFrame, d: int, fn) -> np.ndarray:  # noqa: ANN001
    """Sum over all tasks of the vectors fn(p, n) of their batches; one row for each task and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = fn(*_matrix(b, d))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "x"])

    rows = map_batches(table.select("p", "n_words"), run, "place long, x double", 8192).groupBy("place").agg(F.sum("x").alias("x")).collect()
    return np.array([r.x for r in sorted(rows, key=lambda r: r.place)])


def _solve(table: DataFrame, natural: np.ndarray, target: np.ndarray, kept: int, least: float, steps: int, tolerance: float, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(dual, expected tokens) for the targets; natural are the sums of n p."""
    d, size = len(target), natural.sum()
    dual, far = np.zeros(d), np.inf

    def sums(p: np.ndarray, n: np.ndarray, duals: np.ndarray) -> np.ndarray:
        out = []
        floor = _floor(p, kept, least)
        for x in duals:
            r = _rates(p, x, floor, most)
            out.append(np.concatenate([[n @ (r * (p @ x) - (r - 1) ** 2 / 2)], (n * r) @ p, ((p * (n * ((r > floor) & (r < most)))[:, None]).T @ p).ravel()]))
        return np.array(out).ravel()

    first = _total(table, d, lambda p, n: sums(p, n, dual[None]))  # all rates 1, or their floors
    cost, expected, active = first[0] / size, first[1 : d + 1], first[d + 1 :].reshape(d, d)
    for ridge in RIDGES:
        while steps:
            slope = (expected - target) / size + ridge * dual
            if (np.abs(slope) * size <= tolerance / 10 * target).all():
                break
            steps -= 1
            step = -np.linalg.solve(active / size + ridge * np.eye(d), slope)
            duals = dual + LENGTHS[:, None] * step
            found = _total(table, d, lambda p, n, x=duals: sums(p, n, x)).reshape(len(LENGTHS), -1)
            value = lambda c, x: c - x @ target / size + ridge * x @ x / 2
            costs = [value(c / size, x) for c, x in zip(found[:, 0], duals, strict=True)]
            at = int(np.argmin(costs))
            if not costs[at] < value(cost, dual):
                break
            dual, cost, expected, active = duals[at], found[at, 0] / size, found[at, 1 : d + 1], found[at, d + 1 :].reshape(d, d)
        short = (expected - target) / size
        if not steps or (np.abs(short) * size <= tolerance * target).all() or short @ short > 0.99 * far:
            break
        far = short @ short
    return dual, expected


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, keep: str | None = None, least: float = 0.0, most: float = np.inf, max_train: int = 3000, steps: int = 100, tolerance: float = 1e-6, key: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, dict]:
    """(table, report): key..., n_words, domain, p, rate of every row; targets, expected and natural tokens, and whether they met.

    A domain has met its target within tolerance times the target. If some have not after the last
    step, or no step gets nearer, a warning names them.

    Domains are the pairs q<quality>t<toxic> met among non-null labels (of more than max_train
    labelled rows, a sample by hashed identifier). weights are shares of the domains, scaled to sum
    to one over the domains met; a domain without a weight gets none. The mixture has as many
    tokens as docs, or with keep as many as leave that domain's tokens as they are. Empty and null
    texts have no tokens, hence no influence, and the rate of their posterior. Repeated rows count
    each. Without labels or words all rates are 1.
    """
    usable = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("label"))
    model = fit(docs, usable, max_train)
    names, d = model.classes, len(model.classes)
    rows = docs.select(*(F.col(c).cast("long").alias(c) for c in key), "text")
    table = materialise(posteriors(rows, model, key), "posteriors")
    sums = _total(table, d, lambda p, n: n @ p)
    natural = sums if len(sums) else np.zeros(d)
    size, share = natural.sum(), np.array([(weights or WEIGHTS).get(x, 0.0) for x in names])
    dual, expected, target = np.zeros(d), natural, natural
    k = names.index(keep) if keep in names else -1
    if size > 0 and share.sum() > 0:
        share = share / share.sum()
        target = share * (natural[k] / share[k] if k >= 0 and share[k] > 0 else size)
        dual, expected = _solve(table, natural, target, k, least, steps, tolerance, most)
    met = np.abs(expected - target) <= tolerance * target
    if not met.all():
        short = ", ".join(f"{x}: {e:.0f} of {t:.0f}" for x, e, t, m in zip(names, expected, target, met, strict=True) if not m)
        warnings.warn(f"mixing did not reach its targets (expected tokens of target): {short}", stacklevel=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, _ = _matrix(b, d)
            domain = pa.array([names[x] for x in p.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, domain, pa.array(_rates(p, dual, _floor(p, k, least), most))], [*b.schema.names, "domain", "rate"])

    rated = map_batches(table, run, "".join(f"`{c}` long, " for c in key) + "p array<double>, n_words long, domain string, rate double", 8192)
    report = {n: {"natural": a, "target": t, "expected": e, "met": bool(m)} for n, a, t, e, m in zip(names, natural, target, expected, met, strict=True)}
    return rated.select(*key, "n_words", "domain", "p", "rate"), report


def copies(rate: str = "rate", key: tuple[str, ...] = ("doc_id",), seed: int = 11) -> Column:
    """How often a document enters the mixture: its rate rounded down or up by a hash of its key, right on average."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col(rate) + u)
