"""Text-overlap scores, set scores and loss kernels as column expressions over arrays."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def f1(overlap: Column, n_pred: Column, n_ref: Column) -> Column:
    """Both empty: 1; no overlap: 0; else the harmonic mean of precision and recall."""
    p, r = overlap / n_pred, overlap / n_ref
    return F.when((n_pred == 0) & (n_ref == 0), 1.0).when(overlap == 0, 0.0).otherwise(2 * p * r / (p + r))


def ngrams(words: Column, n: int) -> Column:
    k = F.size(words) - (n - 1)
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def clipped_overlap(a: Column, b: Column) -> Column:
    """Elements that both arrays hold, each as often as both do: sorted, copies numbered, and then met as a set."""

    def numbered(xs: Column) -> Column:
        first = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(s, x)).alias("n")))
        return let(F.array_sort(xs), first)

    return F.size(F.array_intersect(numbered(a), numbered(b)))


def ngram_scores(rows: DataFrame, key: str, pred: str, ref: str, n: int) -> DataFrame:
    """(key, score): rouge_n of two columns of words, by counting n-grams as rows; for texts of any length.

    key must tell rows apart. Sums are made before the shuffle.
    """
    sides = [rows.select(key, F.explode(ngrams(F.col(c), n)).alias("gram"), F.lit(i).alias("side")) for i, c in enumerate((pred, ref))]
    both = sides[0].unionByName(sides[1]).groupBy(key, "gram").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    per = both.groupBy(key).agg(F.sum(F.least("a", "b")).alias("o"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(key).join(per, key, "left").select(key, f1(zero("o"), zero("na"), zero("nb")).alias("score"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one whole number."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        same = row & at.get(y, 0)
        row = ((row + same) | (row - same)) & every
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """lcs() of two arrays of strings of any length; a null array is empty."""
    words = lambda x: [] if x is None else list(x)
    return pd.Series([lcs(words(x), words(y)) for x, y in zip(a, b)], dtype="int32")


def rouge_n(pred: Column, ref: Column, n: int) -> Column:
    return let(ngrams(pred, n), lambda a: let(ngrams(ref, n), lambda b: let(clipped_overlap(a, b), lambda o: f1(o, F.size(a), F.size(b)))))


def rouge_l(pred: Column, ref: Column) -> Column:
    return f1(lcs_length(pred, ref), F.size(pred), F.size(ref))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements, 0 where there are none."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Chances from logits; the largest is taken off first."""
    powers = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda y: F.exp((y - top) / F.lit(temperature))))
    return let(let(x, powers), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total)))


def _dot(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda acc, v: acc + v)


def forward_kl(p: Column, q: Column) -> Column:
    """Cross-entropy of student q under teacher p."""
    return -_dot(p, q, lambda x, y: x * F.ln(y))


def reverse_kl(p: Column, q: Column) -> Column:
    return _dot(p, q, lambda x, y: y * (F.ln(y) - F.ln(x)))


def skewed_forward_kl(p: Column, q: Column, alpha: float = 0.1) -> Column:
    return -_dot(p, q, lambda x, y: x * F.ln(alpha * x + (1 - alpha) * y))


def skewed_reverse_kl(p: Column, q: Column, alpha: float = 0.1) -> Column:
    return _dot(p, q, lambda x, y: y * (F.ln(y) - F.ln((1 - alpha) * x + alpha * y)))


def blended_kl(p: Column, q: Column, weight: float = 0.9) -> Column:
    """KL from (1 - weight) p + weight q to weight p + (1 - weight) q."""
    a, b = (lambda x, y: (1 - weight) * x + weight * y), (lambda x, y: weight * x + (1 - weight) * y)
    return _dot(p, q, lambda x, y: a(x, y) * (F.ln(a(x, y)) - F.ln(b(x, y))))


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(_dot(a, a, lambda x, y: x * y)) * F.sqrt(_dot(b, b, lambda x, y: x * y))
    return F.when(n > 0, _dot(a, b, lambda x, y: x * y) / n)


def masked_mean(values: Column, labels: Column, ignored: int = -100) -> Column:
    """Mean of the values whose label is not the ignored one, 0 without any."""
    kept = F.filter(F.zip_with(values, labels, lambda v, l: F.when(l != ignored, v)), lambda v: v.isNotNull())
    return F.when(F.size(kept) == 0, 0.0).otherwise(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept))


def logs(x: Column, temperature: float = 1.0) -> Column:
    """Logarithms of softmax(x), without going through chances that may round to 0."""
    shifted = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda y: (y - top) / F.lit(temperature)))
    return let(let(x, shifted), lambda s: let(F.ln(F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v))), lambda total: F.transform(s, lambda v: v - total)))


def clean_logits(x: Column) -> Column:
    """Logits with NaN and infinite ones as 0."""
    return F.transform(x, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull(), F.lit(0.0)).otherwise(v))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def contrastive_sd(student: Column, teacher: Column, mode: str = "SS") -> Column:
    """The value of the score-difference surrogate: student logits weighted by centred differences of the logits.

    SS: centred and weighted by the student's chances. TS: the mean of weighting the difference centred by
    the teacher with the student's chances, and the one centred by the student with the teacher's.
    """
    if mode not in ("SS", "TS"):
        raise ValueError(f"mode is SS or TS, not {mode!r}")

    def weighted(centre: Column, weight: Column) -> Column:
        delta = F.zip_with(student, teacher, lambda s, t: s - t)
        return let(_dot(centre, delta, lambda c, d: c * d), lambda mean: _sum(F.zip_with(F.zip_with(delta, weight, lambda d, w: (d - mean) * w), student, lambda x, s: x * s)))

    own, other = softmax(student), softmax(teacher)
    if mode == "SS":
        return let(own, lambda q: weighted(q, q))
    return let(own, lambda q: let(other, lambda p: (weighted(p, q) + weighted(q, p)) / 2))


def assistant_logs(log_p: Column, log_q: Column, alpha: float, lam: float) -> Column:
    """Logarithms of the power mean of teacher p (weight lam) and student q, made to sum to 1."""
    if not math.isfinite(alpha) or not 0 <= lam <= 1:
        raise ValueError("alpha is finite, and lam lies between 0 and 1")
    if lam in (0.0, 1.0):
        return log_p if lam else log_q
    if alpha >= 1:
        return logs(F.zip_with(log_p, log_q, lambda p, q: lam * p + (1 - lam) * q))
    half = 0.5 * (1 - alpha)

    def mean(p: Column, q: Column) -> Column:
        x, y = math.log(lam) + half * p, math.log(1 - lam) + half * q
        return (F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))) / half

    return logs(F.zip_with(log_p, log_q, mean))


#: The exponents of the alpha-beta divergence.
AB = (0.2, 0.7)


def assistant_divergence(log_p: Column, log_q: Column, kind: str = "fkl", order: str = "pr", alpha: float = 0.5, lam: float = 0.5) -> Column:
    """A divergence between teacher p or student q and their assistant r, in either order.

    kind: fkl (forward KL) or ab (alpha-beta with AB); order: pr, qr, rp or rq. A divergence that is no number is 0.
    """
    if kind not in ("fkl", "ab") or order not in ("pr", "qr", "rp", "rq"):
        raise ValueError(f"unknown divergence {kind!r} {order!r}")

    def between(r: Column) -> Column:
        named = {"p": log_p, "q": log_q, "r": r}
        x, y = named[order[0]], named[order[1]]
        if kind == "fkl":
            return _dot(x, y, lambda a, b: F.exp(a) * (a - b))
        a, b = AB
        value = _dot(x, y, lambda s, t: (a * F.exp((a + b) * s) + b * F.exp((a + b) * t)) / (a + b) - F.exp(a * s + b * t)) / (a * b)
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)

    return let(assistant_logs(log_p, log_q, alpha, lam), between)


def hybrid_policy(log_p: Column, log_q: Column, label: Column, sampled: Column) -> Column:
    """The loss of one position from the expert's token and a token drawn from the student (places from 0).

    k is (log p - log q) q at a token. The expert's token weighs k, and p more where the student holds it
    too low; again p more where, besides, the drawn token is held too high. A drawn token other than the
    expert's that is held too high weighs its own k.
    """
    at = lambda x, i: F.get(x, i)
    k = lambda i: (at(log_p, i) - at(log_q, i)) * F.exp(at(log_q, i))
    low, high = k(label) > 0, k(sampled) < 0
    expert = k(label) + F.when(low, F.exp(at(log_p, label))).otherwise(0.0) + F.when(low & high, F.exp(at(log_p, label))).otherwise(0.0)
    penalty = F.when(high & (sampled != label), k(sampled)).otherwise(0.0)
    return -at(log_q, label) * expert - penalty * at(log_q, sampled)


def drawn_token(q: Column, u: Column) -> Column:
    """The place (from 0) at which the running sum of the chances q first passes u."""
    upto = F.transform(F.sequence(F.lit(1), F.size(q)), lambda n: _sum(F.slice(q, 1, n)))
    return F.least(F.size(F.filter(upto, lambda s: s <= u)), F.size(q) - 1)


def soft_labels(student: Column, teacher: Column, temperature: float = 2.0) -> Column:
    """KL from the teacher's to the student's chances, both at a temperature."""
    return let(logs(teacher, temperature), lambda p: let(logs(student, temperature), lambda q: _dot(p, q, lambda x, y: F.exp(x) * (x - y))))


def step_loss(student_before: Column, student: Column, teacher_before: Column, teacher: Column) -> Column:
    """1 - cosine between the student's and the teacher's change of log-chances from one layer to the next."""
    change = lambda a, b: F.zip_with(logs(a), logs(b), lambda x, y: y - x)
    norm = lambda x: F.greatest(F.sqrt(_dot(x, x, lambda a, b: a * b)), F.lit(1e-5))
    return let(change(student_before, student), lambda s: let(change(teacher_before, teacher), lambda t: 1 - _dot(s, t, lambda a, b: a * b) / (norm(s) * norm(t))))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log of the chance of a label (a place from 0); null for labels that are ignored."""
    return F.when(label >= 0, -F.get(logs(logits), label))


#: Kernels of chances or logits by name.
KERNELS = {
    "fkl": forward_kl, "rkl": reverse_kl, "sfkl": skewed_forward_kl, "srkl": skewed_reverse_kl, "bdl": blended_kl,
    "csd": contrastive_sd, "amid": assistant_divergence, "hpd": hybrid_policy,
}


def response_mask(labels: Column, valid: Column, ignored: int = -100) -> Column:
    """Whether each position is valid and its next label counts."""
    return F.transform(labels, lambda _, i: F.coalesce((F.get(labels, i + 1) != ignored) & F.get(valid, i), F.lit(False)))


def hidden_mask(valid: Column) -> Column:
    """valid without its last position that holds."""
    last = F.array_max(F.transform(valid, lambda v, i: F.when(v, i)))
    return F.transform(valid, lambda v, i: v & (i != last))


def fresh_share(threshold: Column, progress: Column, schedule: Column) -> Column:
    """The chance of fresh rollouts: half the threshold, or rising or falling with progress."""
    at = F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0))
    return threshold * F.when(schedule == "constant", 0.5).when(schedule == "increasing", at).when(schedule == "decreasing", 1 - at)


def replay_threshold(losses: Column, start: float, slack: float, step: float = 0.1) -> Column:
    """struct<threshold, baseline> after losses in order: a loss that passes the baseline by slack raises the threshold and is the new baseline."""
    zero = F.struct(F.lit(start).alias("threshold"), F.lit(0.0).alias("baseline"))
    risen = lambda s, x: F.struct(F.least(F.lit(1.0), s.threshold + step).alias("threshold"), x.alias("baseline"))
    return F.aggregate(losses, zero, lambda s, x: F.when(x >= s.baseline + slack, risen(s, x)).otherwise(s))
