"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text: lengths, ratios of characters and repetitions, and hashed words and byte n-grams. P(a preferred to b) = sigmoid(strength(a) - strength(b)), so the
weights are those of a logistic regression, without intercept, on feature differences of preference pairs (a document
labelled 1 over one labelled 0). The threshold is the quantile of the labelled rows' strengths at the share of label 0; the score is the logistic
function of the strength, shifted so that the threshold has score 0.7.

The fit uses every labelled row and every pair of a row labelled 1 and one labelled 0. Pairs are never listed: what a row gets from all
rows of the other label is a function of its strength alone, and that function follows from a histogram of the others' strengths whose bins
hold moments (sigmoids by Taylor of second order, each within 1e-8 where bins have width BIN). Features are checkpointed once in packs, and
each pass over them returns sums, whose size does not depend on the number of rows. Scoring reads every document. Features use the text alone.

Edge cases: null and empty texts get the score of their features (all zero), like any other; labels that are null, or that contradict each
other for a doc_id, are not used; a null doc_id is never trained on and counts as held out; without a pair to learn from every score is 0.7
(nothing is rejected); an empty table gives an empty result; rows that repeat are scored each.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits
from .exchange import checkpointed, forget

SLICE = 1 << 20
THRESHOLD = 0.7
#: Width of a bin of strengths, and bins at most (wider ones where strengths span more than 4096).
BIN, BINS = 1 / 128, 1 << 19
#: Bins of strengths by which the second derivatives are taken, and their width.
COARSE, COARSE_WIDTH = 128, 1 / 4
#: Partial sums that the driver takes as they are.
DIRECT = 64
LAST = (1 << 63) - 1


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


UPPER = _class(bytes(range(65, 91)))
LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
DIGIT = _class(b"0123456789")
SYMBOL = _class(b"#$%&*+/<=>@[\\]^_`{|}~")
STOP = _class(b".,;:?")
BANG = _class(b"!")
WIDE = _class(bytes(range(128, 256)))
CONTROL = _class(bytes(range(0, 9)) + bytes(range(14, 32)) + b"\x7f")
RATIOS = 18
SURFACE = 3 + 2 * RATIOS
#: Places of hashed words, and of hashed runs of GRAM bytes within words and across one space.
WORDS, GRAMS, GRAM = 128, 64, 4
N_FEATURES = SURFACE + WORDS + GRAMS


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text: lengths and ratios, then the shares of hashed words and byte n-grams, as square roots."""
    data, offsets = bits.buffer(column)
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(data):
        return out
    start, end, count = bits.words(data, offsets)
    size = np.diff(offsets)
    base, one = np.maximum(size, 1), np.maximum(count, 1)

    newline = data == 10
    cut = np.unique(np.concatenate((offsets[:-1][size > 0], np.flatnonzero(newline[:-1]) + 1)))
    line_end = np.append(cut[1:], len(data))
    line_row = np.searchsorted(offsets, cut, "right") - 1
    first_word = np.searchsorted(start, np.append(cut, len(data)))
    line_words = np.diff(first_word)

    def sums(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]], total[line_end] - total[cut]

    def per_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values, n)

    def worst_line(values: np.ndarray) -> np.ndarray:
        worst = np.zeros(n)
        np.maximum.at(worst, line_row, np.where(line_words > 2, values, 0))
        return worst

    upper, line_upper = sums(UPPER)
    letter, line_letter = sums(LETTER)
    symbol, line_symbol = sums(SYMBOL)
    bang, line_bang = sums(BANG)
    lower = bits.LOWER[data]
    word = bits.hashes(lower, start, end)
    row = np.repeat(np.arange(n), count)
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    own = bits.mix(word + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, times = np.unique(own, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, row[at], times)
    line = bits.mix(bits.Roll(lower).spans(cut, line_end) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, line_at = np.unique(line, return_index=True)
    again = np.ones(len(line))
    again[line_at] = 0
    tail = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    shout = np.zeros(n)
    line_shout = (line_upper > 0.7 * line_letter) & (line_letter > 8)
    shout += per_row(np.where(line_shout, line_end - cut, 0), line_row)
    noisy = per_row(np.where((line_symbol + line_bang > 0.3 * line_words) & (line_words > 2), line_end - cut, 0), line_row)

    ratios = np.stack([
        upper / np.maximum(letter, 1), sums(DIGIT)[0] / base, symbol / one, bang / one, sums(STOP)[0] / one, sums(WIDE)[0] / base, per_row(newline[cut[1:] - 1], line_row[1:]) / one if len(cut) > 1 else np.zeros(n),
        np.bincount(row[at], minlength=n) / one, per_row(same, row) / one, top / one, worst_line(line_upper / np.maximum(line_letter, 1)), worst_line(line_symbol / np.maximum(line_words, 1)), worst_line(line_bang / np.maximum(line_words, 1)),
        per_row(again * (line_end - cut), line_row) / base, per_row((SYMBOL | BANG)[tail], row) / one, shout / base, noisy / base, sums(CONTROL)[0] / base,
    ], axis=1)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(count), (end - start).sum() and per_row(end - start, row) / one
    out[:, 3 : 3 + RATIOS], out[:, 3 + RATIOS : SURFACE] = ratios, np.sqrt(np.minimum(ratios, 4))

    def hashed(h: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        counts = np.bincount(rows * size + (h >> np.uint64(40)).astype(np.int64) % size, minlength=n * size).reshape(n, size)
        return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))

    out[:, SURFACE : SURFACE + WORDS] = hashed(word, row, WORDS)
    low, cuts = bits.squeezed(lower, offsets)
    gram = bits.grams(low, GRAM)
    rows = np.repeat(np.arange(n), np.diff(cuts))[: len(gram)]
    inside = rows == np.repeat(np.arange(n), np.diff(cuts))[GRAM - 1 :][: len(gram)]
    out[:, SURFACE + WORDS :] = hashed(gram[inside], rows[inside], GRAMS)
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features; the strength at which the score is 0.7."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * (self.weight / self.scale)).sum(1)  # row by row alike, whatever the batch

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


Sums = dict[str, np.ndarray]
Total = Callable[[Callable[[np.ndarray, np.ndarray], Sums]], Sums]


def summed(parts: Iterable[Sums]) -> Sums:
    """The sums of parts; those with a `bin` are histograms, whose rows of one bin are added."""
    total: Sums = {}
    for part in parts:
        if not total:
            total = part
        elif "bin" in part:
            names, at = np.unique(np.concatenate((total["bin"], part["bin"])), return_inverse=True)
            sums = np.zeros((len(names), part["sums"].shape[1]))
            np.add.at(sums, at, np.concatenate((total["sums"], part["sums"])))
            total = {"bin": names, "sums": sums}
        else:
            total = {k: np.minimum(v, part[k]) if k == "least" else np.maximum(v, part[k]) if k == "most" else v + part[k] for k, v in total.items()}
    return total


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -60, 60)))


def _slope(t: np.ndarray) -> np.ndarray:
    p = _sigmoid(t)
    return p * (1 - p)


def _bend(t: np.ndarray) -> np.ndarray:
    p = _sigmoid(t)
    return p * (1 - p) * (1 - 2 * p)


@dataclass(frozen=True)
class Strengths:
    """Histogram of strengths by label: number, sum of distances from the bin's centre, half the sum of their squares."""

    first: int
    width: float
    sums: np.ndarray  # label, moment, bin

    @staticmethod
    def of(total: Total, strength: Callable[[np.ndarray], np.ndarray], width: float) -> Strengths:
        def histogram(x: np.ndarray, label: np.ndarray) -> Sums:
            s = strength(x)
            at = np.floor(s / width).astype(np.int64)
            far = s - (at + 0.5) * width
            names, code = np.unique(2 * at + label, return_inverse=True)
            return {"bin": names, "sums": np.stack([np.bincount(code, v, len(names)) for v in (np.ones(len(s)), far, far * far / 2)], axis=1)}

        found = total(histogram)
        at = found["bin"] >> 1
        sums = np.zeros((2, 3, int(at[-1] - at[0]) + 1))
        sums[found["bin"] & 1, :, at - at[0]] = found["sums"]
        return Strengths(int(at[0]), width, sums)

    def _over(self, kernel: Callable[[np.ndarray], np.ndarray], values: np.ndarray, sign: int) -> np.ndarray:
        """For each bin k the sum over bins m of values[m] * kernel(sign * (centre m - centre k))."""
        n = len(values)
        size = 1 << (2 * n).bit_length()
        taps = np.roll(np.pad(kernel(-sign * np.arange(1 - n, n) * self.width), (0, size - 2 * n + 1)), 1 - n)
        return np.fft.irfft(np.fft.rfft(taps) * np.fft.rfft(values, size), size)[:n]

    def loss(self) -> float:
        """The sum of -log sigmoid(good - bad) over all pairs."""
        (b0, b1, b2), (g0, g1, g2) = self.sums
        plus = lambda t: np.logaddexp(0, t)
        flat = g0 @ self._over(plus, b0, 1) + g0 @ self._over(_sigmoid, b1, 1) - g1 @ self._over(_sigmoid, b0, 1)
        return float(flat + g0 @ self._over(_slope, b2, 1) + g2 @ self._over(_slope, b0, 1) - g1 @ self._over(_slope, b1, 1))

    def pulls(self) -> np.ndarray:
        """By label, coefficients in the distance from a bin's centre of the sum of sigmoid(bad - good) over the other label's rows."""
        out = np.zeros(self.sums.shape)
        for label, sign in ((0, -1), (1, 1)):
            m0, m1, m2 = self.sums[1 - label]
            out[label, 0] = self._over(_sigmoid, m0, sign) + sign * self._over(_slope, m1, sign) + self._over(_bend, m2, sign)
            out[label, 1] = -sign * self._over(_slope, m0, sign) - self._over(_bend, m1, sign)
            out[label, 2] = self._over(_bend, m0, sign) / 2
        return out

    def coarse(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Where coarse bins begin, the number of rows in them by label, and the slope between any two."""
        centre = (self.first + 0.5 + np.arange(self.sums.shape[2])) * self.width
        count = self.sums[:, 0].sum(0)
        start = float(centre[np.searchsorted(np.cumsum(count), count.sum() / 2)]) - COARSE * COARSE_WIDTH / 2
        at = np.clip(((centre - start) / COARSE_WIDTH).astype(np.int64), 0, COARSE - 1)
        place = np.arange(COARSE) * COARSE_WIDTH
        return start, np.stack([np.bincount(at, n, COARSE) for n in self.sums[:, 0]]), _slope(place[:, None] - place[None, :])


def quantile(total: Total, strength: Callable[[np.ndarray], np.ndarray], share: float, n: int) -> float:
    """The quantile of all rows' strengths as numpy's, by counts of the leading bits of candidates."""

    def ordered(x: np.ndarray) -> np.ndarray:
        key = (strength(x) + 0.0).view(np.int64)
        return key ^ ((key >> 63) & LAST)

    def number(key: int) -> float:
        return float(np.array([key ^ ((key >> 63) & LAST)], np.int64).view(np.float64)[0])

    place = share * (n - 1)
    rank, lead = int(np.floor(place)), 0
    for shift in (48, 32, 16, 0):

        def counts(x: np.ndarray, label: np.ndarray, shift: int = shift, lead: int = lead) -> Sums:
            lead_of = ordered(x) >> shift
            names, times = np.unique(lead_of[(lead_of >> 16 == lead) | (shift == 48)], return_counts=True)
            return {"bin": names, "sums": times[:, None].astype(float)}

        seen = total(counts)
        ends = np.cumsum(seen["sums"][:, 0])
        at = int(np.searchsorted(ends, rank, "right"))
        rank -= int(ends[at - 1]) if at else 0
        lead = int(seen["bin"][at])
    low = high = number(lead)
    if place > np.floor(place) and rank + 1 >= seen["sums"][at, 0]:
        high = number(int(total(lambda x, label: {"least": np.min(ordered(x), initial=LAST, where=ordered(x) > lead)[None]})["least"][0]))
    return low + (high - low) * (place - np.floor(place))


def ranking(total: Total, d: int, pairs: int, ridge: float, hashed_ridge: float) -> Ranking:
    """Newton's method, with steps halved while the loss grows, on the logistic loss of all pairs. total(fn) adds up fn(x, label) over all rows.

    More than `pairs` pairs together weigh against the ridges as much as `pairs`. Gradients are of every pair; second derivatives are taken at
    the coarse bins of strength, which changes the steps and not where they end.
    """
    none = Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0)

    def moments(x: np.ndarray, label: np.ndarray) -> Sums:
        return {"n": np.bincount(label, minlength=2), "x": x.sum(0, dtype=np.float64), "xx": np.square(x, dtype=np.float64).sum(0), "least": x.min(0), "most": x.max(0)}

    found = total(moments)
    if not found or not found["n"].all():
        return none
    bad, good = (int(k) for k in found["n"])
    n = bad + good
    mean = found["x"] / n
    scale = np.sqrt(np.maximum(found["xx"] / n - mean * mean, 0))
    mean, scale = np.round(mean, 9), np.round(np.where(scale < 1e-6, 1, scale), 9)  # sums in another order give the same
    reach = np.maximum(found["most"] - mean, mean - found["least"]) / scale
    weigh = min(1.0, pairs / (good * bad))

    def standard(x: np.ndarray) -> np.ndarray:
        return (x - mean) / scale

    def at(w: np.ndarray) -> tuple[Strengths, float]:
        own = Strengths.of(total, lambda x: standard(x) @ w, max(BIN, 2 * float(reach @ np.abs(w)) / BINS))
        return own, weigh * own.loss() + float(penalty @ (w * w)) / 2

    w, penalty = np.zeros(d), np.where(np.arange(d) < SURFACE, ridge, hashed_ridge)
    own, loss = at(w)
    for _ in range(30):
        first, width, pulls = own.first, own.width, own.pulls()
        start, counts, slope = own.coarse()
        heavy = np.stack([slope @ counts[1], slope @ counts[0]])  # by label, from the other's rows

        def derivatives(x: np.ndarray, label: np.ndarray) -> Sums:
            z = standard(x)
            s = z @ w
            k = np.clip(np.floor(s / width).astype(np.int64), first, first + pulls.shape[2] - 1)
            far = s - (k + 0.5) * width
            a, b, c = (pulls[label, m, k - first] for m in range(3))
            rough = np.clip(((k + 0.5) * width - start) / COARSE_WIDTH, 0, COARSE - 1).astype(np.int64)
            z32, place = z.astype(np.float32), label * COARSE + rough
            order = np.argsort(place, kind="stable")
            names, cuts = np.unique(place[order], return_index=True)
            by_bin = np.zeros((2 * COARSE, d))
            by_bin[names] = np.add.reduceat(z[order], cuts, axis=0)
            weight = heavy[label, rough] / n
            return {"pull": z.T @ (np.where(label == 1, 1, -1) * (a + far * (b + far * c))), "square": ((z32 * weight[:, None].astype(np.float32)).T @ z32).astype(np.float64) * n, "by_bin": by_bin}

        sums = total(derivatives)
        cross = sums["by_bin"][COARSE:].T @ slope @ sums["by_bin"][:COARSE]
        hessian = weigh * (sums["square"] - cross - cross.T) + np.diag(penalty)
        step = np.linalg.solve(hessian, weigh * sums["pull"] - penalty * w)
        before, length = loss, 1.0
        base = w
        while True:
            w = base + length * step
            own, loss = at(w)
            if loss <= before + 1e-9 * abs(before) or length < 1e-3:
                break
            length /= 2
        if np.abs(step).max() < 1e-5:
            break
    w = np.round(w, 9)
    out = Ranking(mean, scale, w, 0.0)
    return Ranking(mean, scale, w, quantile(total, out.strength, bad / n, n))


def bradley_terry(x: np.ndarray, label: np.ndarray, pairs: int = 100_000, ridge: float = 1.0, hashed_ridge: float = 100.0) -> Ranking:
    """The ranking of rows at hand.

    The weights of hashed features are held back more: they speak where lengths and ratios do not tell good from bad.
    """
    return ranking(lambda fn: fn(x, label) if len(x) else {}, x.shape[1], pairs, ridge, hashed_ridge)


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Packs (n, label, x) of every labelled row whose crc32(doc_id as text) mod 4 is not 2, checkpointed: labels as bytes, features as 32-bit floats."""
    learn = "doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2"
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(f"{learn} and label in (0, 1)")
    use = use.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(learn)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits.release()
        for batch in batches:
            for part in bits.slices(batch, "text", SLICE):
                own = part.column("label").to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([features(part.column("text")).tobytes()], pa.binary())], ["n", "label", "x"])

    return checkpointed(text.join(use.hint("shuffle_hash"), "doc_id").select("label", "text").mapInArrow(run, "n int, label binary, x binary"))


def totals(packs: DataFrame, tasks: int, direct: int = DIRECT) -> Total:
    """Sums over packs in `tasks` tasks; more than `direct` partial sums are added up by their square root of tasks before the driver takes them."""
    few = packs.coalesce(tasks)

    def total(fn: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[Sums]:
            for batch in batches:
                for n, label, x in zip(batch.column("n").to_pylist(), batch.column("label"), batch.column("x")):
                    if n:
                        yield fn(np.frombuffer(x.as_buffer(), np.float32).reshape(n, -1), np.frombuffer(label.as_buffer(), np.uint8).astype(np.int64))

        def out(parts: Iterable[Sums]) -> Iterator[pa.RecordBatch]:
            own = summed(parts)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(own)], pa.binary())], ["part", "blob"])

        def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from out(pickle.loads(blob.as_py()) for batch in batches for blob in batch.column("blob"))

        part = few.mapInArrow(lambda batches: out(each(batches)), "part int, blob binary")
        if tasks > direct:
            part = part.repartition(int(np.ceil(tasks**0.5)), "part").sortWithinPartitions("part").mapInArrow(again, "part int, blob binary")
        return summed(pickle.loads(r.blob) for r in sorted(part.collect(), key=lambda r: r.part))

    return total


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", pairs: int = 100_000, ridge: float = 1.0, hashed_ridge: float = 100.0) -> Ranking:
    """The ranking learned from every row of labels whose crc32(doc_id as text) mod 4 is not 2."""
    packs = labelled(docs, labels, label)
    found = ranking(totals(packs, docs.sparkSession.sparkContext.defaultParallelism), N_FEATURES, pairs, ridge, hashed_ridge)
    forget(packs)
    return found


def scored(docs: DataFrame, ranking: Ranking, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; a column of that name is replaced."""
    keep = [c for c in docs.columns if c != column]
    carry = [c for c in keep if c != "text"]
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits.release()
        for batch in batches:
            for part in bits.slices(batch, "text", SLICE):
                score = pa.array(ranking.score(features(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, "score"])

    out = inner.mapInArrow(run, T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.select(*(F.col(f"c{carry.index(c)}").alias(c) if c != "text" else F.col("text").cast(docs.schema["text"].dataType).alias(c) for c in keep), F.col("score").alias(column))


def predicted(docs: DataFrame, labels: DataFrame, pairs: int = 100_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    ranking = fit(docs, labels, pairs=pairs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    return scored(docs.select("doc_id", "text"), ranking).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
