"""The gate of a reward mixture: a small network on the prompt embedding, fitted by distributed gradients.

Tasks run the network forwards and backwards over their rows and give one row per
row of a weight matrix. A step on a mini-batch reads the batch and not the table:
the rows are laid out once by the hash of their key, in folders by its upper bits
and in order within their files, and a batch is a range of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from prefops.functions import scores as S
from prefops.functions.rand import HASH_BITS, portable_hash
from prefops.operators.sums import added
from prefops.schema import require
from prefops.sources.io import scratch_path, written

Layers = list[tuple[np.ndarray, np.ndarray]]

SIDES = ["chosen_prompt", "rejected_prompt", "chosen_rewards", "rejected_rewards"]
#: Folders of the layout, as a power of two at most, and the bytes of a row group in them.
SHELF_BITS, ROW_GROUP = 10, 4 << 20
#: Gradients of the tasks of a mini-batch come to the driver up to so many bytes together.
GRADIENT_BYTES = 256 << 20


@dataclass
class Gate:
    """A fitted gate: (weight, bias) per layer, ReLU between them, and the loss before each step."""

    layers: Layers
    temperature: float
    over: str = "objectives"
    losses: list[float] = field(default_factory=list)

    @property
    def weight(self) -> np.ndarray:
        return self.layers[-1][0]

    @property
    def bias(self) -> np.ndarray:
        return self.layers[-1][1]


def _over_objectives(z: dict, r: dict, t: float) -> tuple[np.ndarray, dict]:
    """Score gap of a batch and its slope by the logits of each side, softmax over objectives."""
    gap, slopes = 0.0, {}
    for side, sign in SIGNS.items():
        g = S.softmax_rows(z[side], t)
        score = (g * r[side]).sum(axis=1)
        gap = gap + sign * score
        slopes[side] = sign * g * (r[side] - score[:, None]) / t
    return gap, slopes


def _over_sides(z: dict, r: dict, t: float) -> tuple[np.ndarray, dict]:
    """The same with the softmax over the two sides of a pair."""
    g = 1.0 / (1.0 + np.exp(np.clip((z["rejected"] - z["chosen"]) / t, -700, 700)))
    gap = (g * r["chosen"] - (1.0 - g) * r["rejected"]).sum(axis=1)
    slope = g * (1.0 - g) * (r["chosen"] + r["rejected"]) / t
    return gap, {"chosen": slope, "rejected": -slope}


SIGNS = {"chosen": 1.0, "rejected": -1.0}
GATE_FORMS = {"objectives": _over_objectives, "sides": _over_sides}


def kept_units(hashes: np.ndarray, draw: int, units: int, rate: float) -> np.ndarray:
    """1 / (1 - rate) for the units of each row that dropout keeps, else 0; fixed by the row's hash and the draw."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(draw + 1) * np.uint64(0xD1B54A32D192ED03)
        x = x + np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93), (32, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)) * 2.0**-53 >= rate) / (1.0 - rate)


def forward(layers: Layers, x: np.ndarray, masks: Sequence[np.ndarray | float]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The network's output, and the input of every layer."""
    inputs = []
    for i, (w, b) in enumerate(layers):
        inputs.append(x)
        x = x @ w.T + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0) * masks[i]
    return x, inputs


def backward(layers: Layers, inputs: list[np.ndarray], slope: np.ndarray, masks: Sequence[np.ndarray | float]) -> list[np.ndarray]:
    """Gradient per layer as (weight, bias) side by side, from the slope by the output."""
    out = []
    for i in range(len(layers) - 1, -1, -1):
        out.append(np.column_stack([slope.T @ inputs[i], slope.sum(axis=0)]))
        if i:
            # Where a unit is 0 after ReLU and dropout, nothing passes.
            slope = (slope @ layers[i][0]) * (inputs[i] > 0) * masks[i - 1]
    return out[::-1]


def _partials(layers: Layers, temperature: float, over: str, dropout: float, step: int) -> Callable:
    """Per task: (layer, row, v) of the gradient's sum; row -1 has the sum of losses and the number of rows."""
    form = GATE_FORMS[over]

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((w.shape[0], w.shape[1] + 1)) for w, _ in layers]
        loss, n = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            z, inputs, masks = {}, {}, {}
            for k, side in enumerate(SIGNS):
                masks[side] = [1.0] * (len(layers) - 1)
                if dropout:
                    h = batch.column("h").to_numpy()
                    masks[side] = [kept_units(h, (step * len(layers) + i) * 2 + k, len(w), dropout) for i, (w, _) in enumerate(layers[:-1])]
                z[side], inputs[side] = forward(layers, S.matrix(batch.column(f"{side}_prompt")), masks[side])
            gap, slopes = form(z, {side: S.matrix(batch.column(f"{side}_rewards")) for side in SIGNS}, temperature)
            loss += np.logaddexp(0.0, -gap).sum()
            n += len(gap)
            by_gap = -1.0 / (1.0 + np.exp(np.clip(gap, -700, 700)))
            for side in SIGNS:
                for sums, part in zip(total, backward(layers, inputs[side], by_gap[:, None] * slopes[side], masks[side]), strict=True):
                    sums += part
        yield _block(-1, [-1], np.array([[loss, n]]))
        if n:
            for i, sums in enumerate(total):
                yield _block(i, range(len(sums)), sums)

    return partials


def _block(layer: int, rows: Sequence[int], sums: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]
    v = pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array([layer] * len(sums), pa.int32()), pa.array(list(rows), pa.int32()), v], ["layer", "row", "v"])


def _gradient(rows: DataFrame, layers: Layers, tasks: int | None, *how) -> tuple[float, int, list[np.ndarray]]:
    """Sum of losses, number of rows and gradient over some rows, as one job."""
    parts = rows.mapInArrow(_partials(layers, *how), "layer int, row int, v array<double>")
    # All rows: sums over tasks are made by tasks. A batch: its few tasks are added here.
    table = (added(parts, "layer", "row") if tasks is None else parts.coalesce(tasks)).toArrow()
    total = [np.zeros((w.shape[0], w.shape[1] + 1)) for w, _ in layers]
    both = np.zeros(2)
    for layer, row, v in zip(table["layer"].to_pylist(), table["row"].to_pylist(), table["v"], strict=True):
        target = both if layer < 0 else total[layer][row]
        target += v.values.to_numpy()
    return both[0], int(both[1]), total


class Shelves:
    """Rows laid out by their hash `h`: folders by its upper bits, sorted within, small row groups."""

    def __init__(self, rows: DataFrame, n: int, batch: int):
        self.spark, self.n, self.batch, self.schema = rows.sparkSession, n, batch, rows.schema
        self.bits = min(SHELF_BITS, max(n // batch, 1).bit_length() - 1)
        self.path = scratch_path(self.spark, "shelves")
        dealt = rows.withColumn("shelf", F.shiftright("h", HASH_BITS - self.bits).cast("int"))
        dealt = dealt.repartition(1 << self.bits, "shelf").sortWithinPartitions("shelf", "h")
        dealt.write.option("parquet.block.size", ROW_GROUP).partitionBy("shelf").parquet(self.path)
        self.filled = {r["shelf"] for r in self.spark.read.parquet(self.path).select("shelf").distinct().collect()}

    def draw(self, place: float) -> DataFrame:
        """About `batch` rows: those whose hashes follow the given place (0 to 1), the lowest after the highest."""
        whole = 1 << HASH_BITS
        lo = int(place * whole)
        hi = lo + -(-whole * self.batch // self.n)
        wanted = [s for s in range(lo >> HASH_BITS - self.bits, (hi - 1 >> HASH_BITS - self.bits) + 1)]
        paths = [f"{self.path}/shelf={s}" for s in sorted({s % (1 << self.bits) for s in wanted} & self.filled)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        h = F.col("h")
        inside: Column = (h >= lo) & (h < hi)
        if hi > whole:
            inside = (h >= lo) | (h < hi - whole)
        return self.spark.read.schema(self.schema).parquet(*paths).where(inside)


def start_layers(objectives: int, dim: int, hidden: Sequence[int], rng: np.random.Generator) -> Layers:
    """Uniform within 1 / sqrt(inputs), weights and biases alike."""
    layers, width = [], dim
    for units in (*hidden, objectives):
        bound = 1.0 / math.sqrt(width)
        drawn = rng.uniform(-bound, bound, units * (width + 1))
        layers.append((drawn[: units * width].reshape(units, width), drawn[units * width :]))
        width = units
    return layers


def fit_gate(
    df: DataFrame,
    objectives: int,
    dim: int,
    steps: int = 100,
    lr: float = 1e-3,
    temperature: float = 10.0,
    weight_decay: float = 0.0,
    seed: int = 0,
    over: str = "objectives",
    hidden: Sequence[int] = (),
    batch: int | None = None,
    key: str | None = None,
    dropout: float = 0.0,
) -> Gate:
    """Softmax gate on the prompt embedding under the pairwise logistic loss of the mixture.

    Rows have `chosen_prompt`, `rejected_prompt` (d) and `chosen_rewards`,
    `rejected_rewards` (objectives); those with a null are left out. `hidden` are
    the units of the layers before the last, with ReLU and, if asked for, dropout.
    AdamW with a cosine schedule moves the weights on the driver, which holds
    nothing but the model and its gradients.

    Without `batch` every step takes the gradient over all rows, which are kept in
    memory. With it a step takes about so many rows, a range of the hash of `key`
    that is drawn anew each time. A key that repeats very often makes its range
    long; keys should be unique. Fewer rows than `batch` are all taken. Rows are
    written to the shared folder first.
    """
    require(df, *SIDES)
    if (batch or dropout) and key is None:
        raise ValueError("batches and dropout are drawn by key: name it")
    if over not in GATE_FORMS:
        raise ValueError(over)
    rng = np.random.default_rng(seed)
    layers = start_layers(objectives, dim, hidden, rng)
    if not steps:
        return Gate(layers, temperature, over, [])
    h = F.lit(0).cast("long") if key is None else F.coalesce(portable_hash(seed, key), F.lit(0))
    rows = written(df.select(*SIDES, h.alias("h")).dropna(subset=SIDES), "gate")
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit the gate on")
    shelves = Shelves(rows, n, batch) if batch and batch < n else None
    size = 8 * sum(w.size + b.size for w, b in layers)
    tasks = max(1, GRADIENT_BYTES // size) if batch else None
    # A table that is one batch is one part.
    kept = None if shelves else (rows.coalesce(1) if batch else rows).persist(StorageLevel.MEMORY_AND_DISK)
    first = [np.zeros((w.shape[0], w.shape[1] + 1)) for w, _ in layers]
    second = [np.zeros_like(f) for f in first]
    losses = []
    try:
        for step in range(steps):
            loss, taken, grads = 0.0, 0, []
            while not taken:
                drawn = shelves.draw(rng.random()) if shelves else kept
                loss, taken, grads = _gradient(drawn, layers, tasks, temperature, over, dropout, step)
            losses.append(loss / taken)
            rate = lr * (1 + math.cos(math.pi * step / steps)) / 2
            moved = []
            for k, ((w, b), g) in enumerate(zip(layers, grads, strict=True)):
                g = g / taken
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                move = (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.999 ** (step + 1))) + 1e-8)
                theta = np.column_stack([w, b]) * (1 - rate * weight_decay) - rate * move
                moved.append((theta[:, :-1].copy(), theta[:, -1].copy()))
            layers = moved
    finally:
        if kept is not None:
            kept.unpersist()
    return Gate(layers, temperature, over, losses)


def gate_loss(df: DataFrame, gate: Gate) -> float:
    """The mean loss of a gate over all rows, without dropout."""
    loss, n, _ = _gradient(df.select(*SIDES).dropna(), gate.layers, None, gate.temperature, gate.over, 0.0, 0)
    return loss / n if n else math.nan
