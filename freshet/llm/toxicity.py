"""Toxic passages: maximal scoring segments over token log-odds, judged by extreme values.

Training, from labelled texts: a token's score, a word's or a stem's, is the log-odds of toxic
against clean texts under a Dirichlet prior (Monroe et al. 2008), less its standard error; tokens without a clear surplus
have none. A constant drift is taken from all, so that clean text scores below zero on average.
A linear scan (Ruzzo and Tompa 1999) finds every maximal scoring segment. A segment of score s in
n tokens has E = K n exp(-lambda s) rivals by chance (Karlin and Altschul 1990); lambda and K come from clean
training texts. A text's score is a logistic function of its passages' evidence, -log E.
"""

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import text_slices
from freshet.storage import stage

SAMPLE = 20_000  # Labelled texts to learn from, at most; chosen by a hash of their id.
VOCABULARY = 100_000  # Tokens and stems that may carry a score; those most toxic texts hold.
STEMS = (3, 4, 5, 6)  # Letters; a word that has no score takes that of its longest known stem.
CACHE = 250_000  # Words whose scores a task keeps; it then starts over. Bounds memory only.
PRIOR = 2000.0  # Tokens' worth of the Dirichlet prior, dealt by overall frequency.
LEAST_PRIOR = 0.5  # Of each token besides.
ERRORS = 3.0  # Standard errors from zero that a token's log-odds must lie to count.
LEAST_ODDS = 1.0  # Least log-odds, after that, of a token that counts; a weaker one is no sign.
DRIFT = 0.05  # Taken from each token's score.
LEAST_SCALE = 0.01  # K is not taken below this, however few clean texts were seen.
SIGNIFICANT = 0.05  # Passages with E below this are significant.
_TOKEN = re.compile(r"[^\W\d_]+")

_SPANS = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]
    )
)
PASSAGES = "array<struct<start:int,end:int,score:double,evalue:double>>"


@dataclass(frozen=True)
class ToxicityModel:
    """weights: scores of tokens that differ from ``-drift``; rate and scale: lambda and K."""

    weights: dict
    drift: float
    rate: float
    scale: float
    bias: float = 0.0
    slope: float = 0.0

    def evidence(self, score, n):
        """-log E of a segment."""
        return self.rate * score - np.log(self.scale * max(n, 1))


def token_keys(token):
    """What a token is scored by, most specific first: itself, then its stems."""
    return [token, *(f"{token[:k]}*" for k in reversed(STEMS) if len(token) > k)]


class Scores(dict):
    """Score of each token, None where neither it nor a stem has one; remembered for a while."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, token):
        if len(self) >= CACHE:
            self.clear()
        known = (w for k in token_keys(token) if (w := self.weights.get(k)) is not None)
        score = self[token] = next(known, None)
        return score


def segments(scores):
    """All maximal scoring segments of a list of (start, end, score) runs, as such triples.

    Linear in the number of runs: each candidate remembers the nearest earlier one whose left
    sum is below its own, so that a search never visits a candidate twice for long.
    """
    total = 0.0
    kept = []  # start, end, left sum, right sum, index of the nearest candidate with less to its left
    for start, end, score in scores:
        left, total = total, total + score
        if score <= 0:
            continue
        right = total
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][2] >= left:
                k = kept[k][4]
            if k < 0 or kept[k][3] >= right:
                kept.append((start, end, left, right, k))
                break
            start, left = kept[k][0], kept[k][2]
            del kept[k:]
    return [(s, e, r - l) for s, e, l, r, _ in kept]


def passages(text, model: ToxicityModel, scores: Scores):
    """(start, end, score, evidence) of each maximal segment of a whole text, in characters, and
    its number of tokens. ``scores`` is of the model's weights."""
    tokens = _TOKEN.findall(text.lower()) if text else []
    marked = [(k, w) for k, w in enumerate(map(scores.__getitem__, tokens)) if w is not None]
    if not any(w > 0 for _, w in marked):
        return [], len(tokens)
    runs, last = [], 0
    for k, w in marked:
        if k > last:
            runs.append((last, k, -model.drift * (k - last)))
        runs.append((k, k + 1, w))
        last = k + 1
    found = segments(runs)
    spans = [m.span() for m in _TOKEN.finditer(text.lower())]
    return [
        (spans[s][0], spans[e - 1][1], score, float(model.evidence(score, len(tokens))))
        for s, e, score in found
    ], len(tokens)


def summary(found):
    """Evidence of a text: that of its significant passages together, or of its best one."""
    if not found:
        return 0.0
    strong = [e for _, _, _, e in found if e > -np.log(SIGNIFICANT)]
    return sum(strong) if strong else max(0.0, max(e for _, _, _, e in found))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def toxicity_column(text, model: ToxicityModel):
    """struct<score, passages> of a text column; passages are the significant ones.

    Offsets count the characters of the lower-cased text. A null or empty text has no passage
    and the score of a text without any.
    """

    known = Scores(model.weights)

    @F.arrow_udf(f"score double, passages {PASSAGES}")
    def judged(column: pa.Array) -> pa.Array:
        scores, spans = [], []
        for text in (t for _, texts in text_slices(column) for t in texts):
            found, _ = passages(text, model, known)
            scores.append(float(_sigmoid(model.bias + model.slope * summary(found))))
            spans.append(
                [
                    {"start": s, "end": e, "score": w, "evalue": float(np.exp(-v))}
                    for s, e, w, v in found
                    if v > -np.log(SIGNIFICANT)
                ]
            )
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], ["score", "passages"]
        )

    return judged(text)


def _weights(counts, totals):
    """Scores of the tokens and stems that are surely signs, from rows (token, toxic, both)."""
    toxic = np.array([r["toxic"] for r in counts], float)
    both = np.array([r["both"] for r in counts], float)
    n_toxic, n_both = float(totals["toxic"] or 0), float(totals["both"] or 0)
    if not len(both) or not n_toxic or n_toxic == n_both:
        return {}
    prior = LEAST_PRIOR + PRIOR * both / n_both
    clean, n_clean = both - toxic, n_both - n_toxic
    a, b = toxic + prior, clean + prior
    odds = np.log(a / np.maximum(n_toxic + PRIOR - a, 1e-9)) - np.log(
        b / np.maximum(n_clean + PRIOR - b, 1e-9)
    )
    error = np.sqrt(1 / a + 1 / b)
    drawn = np.sign(odds) * (np.abs(odds) - error)
    return {
        r["token"]: float(w) - DRIFT
        for r, w, sure in zip(counts, drawn, (odds > ERRORS * error) & (drawn > LEAST_ODDS))
        if sure
    }


def _rate(weights, shares, drift):
    """Positive root of sum p exp(rate * score) = 1 over the tokens of clean texts."""
    scores = np.array([*weights, -drift])
    p = np.array([*shares, max(0.0, 1 - sum(shares))])
    if not (scores > 0).any():
        return 1.0
    low, high = 0.0, 50.0 / scores.max()
    excess = lambda x: (p * np.exp(np.minimum(x * scores, 700))).sum() - 1
    if excess(high) <= 0:
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _logistic(x, y):
    """Bias and slope by Newton steps, held by a weak normal prior; slope is not negative."""
    beta = np.array([0.0, 0.1])
    design = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = _sigmoid(design @ beta)
        grad = design.T @ (y - p) - ridge @ beta
        hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def train_toxicity(docs: DataFrame, labels: DataFrame, sample=SAMPLE, vocabulary=VOCABULARY):
    """Learn from ``docs`` (doc_id, text) whose ``labels`` (doc_id, toxic) are 0 or 1.

    Labels that are null or of another value, and rows with a null id, are left out; of repeated
    labels of an id the larger counts. At most ``sample`` labelled texts are used, the ids with
    the least hash; they are whole texts. Token counts are summed by Spark; the driver gets at
    most ``vocabulary`` of them, and the label, length and segment scores of each sampled text.
    """
    chosen = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id")
        .limit(sample)
    )
    texts = stage(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
        .select(
            F.coalesce("text", F.lit("")).alias("text"),
            "label",
            F.pmod(F.xxhash64("labelled_id", F.lit(1)), F.lit(2)).cast("int").alias("half"),
        ),
        "toxicity-sample",
    )

    def count(batches):
        for batch in batches:
            seen = {}
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns)):
                for token in {k for t in set(_TOKEN.findall(text.lower())) for k in token_keys(t)}:
                    sums = seen.setdefault((half, token), [0, 0])
                    sums[0] += label
                    sums[1] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in seen], pa.int32()),
                    pa.array([t for _, t in seen], pa.string()),
                    pa.array([s[0] for s in seen.values()], pa.int64()),
                    pa.array([s[1] for s in seen.values()], pa.int64()),
                ],
                ["half", "token", "toxic", "both"],
            )

    def part(name, half):
        return F.sum(F.when(F.col("half") == half, F.col(name)).otherwise(0)).alias(f"{name}{half}")

    sums = [part(name, half) for name in ("toxic", "both") for half in (0, 1)]
    counts = texts.mapInArrow(count, "half int, token string, toxic long, both long")
    counts = stage(counts.groupBy("token").agg(*sums), "toxicity-tokens")
    totals = counts.agg(*(F.sum(c).alias(c) for c in counts.columns[1:])).first()
    toxic, both = F.col("toxic0") + F.col("toxic1"), F.col("both0") + F.col("both1")
    # Only what toxic texts hold more often than others can be a sign of one.
    shown = (totals["toxic0"] or 0) + (totals["toxic1"] or 0)
    base = shown / max(1, (totals["both0"] or 0) + (totals["both1"] or 0))
    signs = counts.where((toxic > 1) & (toxic > base * both))
    rows = signs.orderBy(toxic.desc(), "token").limit(vocabulary).collect()

    def learned(halves):
        def total(row, name):
            return sum(row[f"{name}{h}"] or 0 for h in halves)

        own = [
            {"token": r["token"], "toxic": total(r, "toxic"), "both": total(r, "both")} for r in rows
        ]
        own = [r for r in own if r["both"]]
        whole = {"toxic": total(totals, "toxic"), "both": total(totals, "both")}
        weights = _weights(own, whole)
        n_clean = max(1.0, float(whole["both"] - whole["toxic"]))
        shares = [(r["both"] - r["toxic"] + 0.5) / n_clean for r in own if r["token"] in weights]
        return ToxicityModel(weights, DRIFT, _rate(list(weights.values()), shares, DRIFT), 1.0)

    plain = learned((0, 1))
    # Each half is judged by the other's weights: what a token shows by chance counts as chance.
    crossed = {0: learned((1,)), 1: learned((0,))}

    def best(batches):
        scores = {half: Scores(made.weights) for half, made in crossed.items()}
        for batch in batches:
            labels, sizes, sums = [], [], []
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns)):
                found, size = passages(text, crossed[half], scores[half])
                labels.append(label)
                sizes.append(size)
                sums.append([score for _, _, score, _ in found])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(labels, pa.int32()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.list_(pa.float64())),
                ],
                ["label", "n", "sums"],
            )

    judged = texts.mapInArrow(best, "label int, n long, sums array<double>").toPandas()
    if not len(judged):
        return plain
    clean = judged[judged["label"] == 0]
    # K from how many segments of clean texts, to their tokens, reach their median score.
    found = np.array([s for sums in clean["sums"] for s in sums])
    middle = float(np.median(found)) if len(found) else 0.0
    hits = (found >= middle).sum() * np.exp(min(plain.rate * middle, 50.0))
    scale = max(LEAST_SCALE, float(hits / max(1.0, clean["n"].sum())))
    model = replace(plain, scale=scale)
    x = np.array(
        [
            summary([(0, 0, s, float(model.evidence(s, n))) for s in sums])
            for n, sums in zip(judged["n"], judged["sums"])
        ]
    )
    bias, slope = _logistic(x, judged["label"].to_numpy(float))
    return replace(model, bias=bias, slope=slope)


def toxicity(docs: DataFrame, model: ToxicityModel, id="doc_id", text="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (score >= 0.5), passages.

    Null, empty and repeated rows are scored like any others; an empty table gives an empty one;
    other columns are ignored, whatever their names.
    """
    judged = docs.select(F.col(id).alias("doc_id"), toxicity_column(F.col(text), model).alias("judged"))
    return judged.select(
        "doc_id",
        F.col("judged.score").alias("score"),
        (F.col("judged.score") >= 0.5).cast("int").alias("predicted"),
        F.col("judged.passages").alias("passages"),
    )
