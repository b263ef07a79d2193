"""Toxicity: noisy-channel restoration of disguised words, then a linear model over the restored text.

A character language model (bigrams of letters within words, counted over every document) is the
source; the channel writes letters as look-alike signs, puts signs or spaces between letters, and
repeats letters. A disguised token is a lattice of what each sign may stand for, and Viterbi decoding
finds its likeliest reading. Between plain letters only repeats are in doubt, and for each letter it is
the same reading that wins everywhere. Accents and look-alike letters of other scripts are undone first.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, wordhash

# What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Cyrillic, Greek and other letters that look like a letter from a to z.
LETTERS = str.maketrans("авеіјкмнорԛѕтухүһԁԝѵαβεικνορτυχɡıłøđ", "abeijkmhopqstuxyhdwvabeikvoptuxgilod")
#: Signs that may stand for any letter.
MASKS = "*?"
_A = 28  # end of a word, a to z, any other letter
_PLAIN = math.log(0.9)
_LOOK = math.log(0.4)
_MASK = math.log(0.03)
_NOISE = math.log(0.25)  # a sign between letters that stands for nothing
_DIGIT = math.log(0.02)  # the same for a digit
_AGAIN = math.log(0.2)  # a repeat of the letter before
_SPACED = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2,}(?!\S)")
_STRIP = ".,;:!?()[]{}<>\"'`´’‘“”«»…–—-_/\\=~^%#&*"


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each letter follows each other in the words of all documents; 28 x 28, whatever the input."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.zeros(256, np.int16)
        kind[97:123] = np.arange(1, 27)
        kind[65:91] = np.arange(1, 27)
        kind[128:] = 27
        total = np.zeros(_A * _A, np.int64)
        for b in batches:
            raw = pa.compute.fill_null(b.column(0).cast(pa.large_string()).cast(pa.large_binary()), b"")
            body, ends = raw.buffers()[2], np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            if not len(raw) or body is None or ends[0] == ends[-1]:
                continue
            data = np.frombuffer(body, np.uint8)
            for at in range(int(ends[0]), int(ends[-1]), 1 << 20):
                x = kind[data[at : min(at + (1 << 20) + 1, int(ends[-1]))]]
                total += np.bincount(x[:-1] * _A + x[1:], minlength=_A * _A)
            # A text begins and ends a word; what follows it in the batch is another text.
            held = np.flatnonzero(ends[1:] > ends[:-1])
            head, tail = kind[data[ends[held]]], kind[data[ends[held + 1] - 1]]
            total += np.bincount(head, minlength=_A * _A) + np.bincount(tail * _A, minlength=_A * _A)
            total -= np.bincount(tail[:-1] * _A + head[1:], minlength=_A * _A)
        pick = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pick.astype(np.int32)), pa.array(total[pick])], names=["pair", "n"])

    out = np.zeros(_A * _A)
    for r in docs.select(F.col(text_col).cast("string")).mapInArrow(scan, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(_A, _A)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Logarithms of smoothed chances of each letter after each other."""
    share = (counts.sum(axis=0) + 1) / (counts.sum() + _A)
    return np.log((counts + 5 * share) / (counts.sum(axis=1, keepdims=True) + 5))


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest word behind a lower-case token, "" if it holds no letter."""
    score = np.full(_A, -np.inf)
    score[0] = 0.0
    back: list[tuple[np.ndarray, np.ndarray]] = []
    before = ""
    for sign in token:
        emit = np.full(_A, -np.inf)
        stay = np.full(_A, -np.inf)  # emitting no letter
        if "a" <= sign <= "z":
            emit[ord(sign) - 96] = _PLAIN
            if sign == before:
                stay[ord(sign) - 96] = _AGAIN
        elif sign.isalpha():
            emit[27] = _PLAIN
        else:
            for x in LOOKALIKES.get(sign, ""):
                emit[ord(x) - 96] = _LOOK
                if sign == before:
                    stay[ord(x) - 96] = _AGAIN
            if sign in MASKS:
                emit[1:27] = _MASK
            stay = np.maximum(stay, _DIGIT if sign.isdigit() else _NOISE)
        before = sign
        move = score[:, None] + model
        source = move.argmax(axis=0)
        moved = move[source, np.arange(_A)] + emit
        stayed = score + stay
        own = stayed > moved
        back.append((np.where(own, -1, source), own))
        score = np.where(own, stayed, moved)
        if np.isneginf(score).all():
            return ""
    state, out = int((score + model[:, 0]).argmax()), []
    for i in range(len(token) - 1, -1, -1):
        source, own = back[i]
        if not own[state]:
            out.append(token[i] if state == 27 else chr(96 + state) if state else "")
            state = int(source[state])
    return "".join(reversed(out))


def folded(token: str) -> str:
    """A token without accents, and with look-alike letters as a to z where that makes all its letters Latin."""
    if token.isascii():
        return token
    bare = "".join(c for c in unicodedata.normalize("NFKD", token).lower() if not unicodedata.combining(c))
    latin = bare.translate(LETTERS)
    return latin if all(c.isascii() for c in latin if c.isalpha()) else bare


class Restorer:
    """Words of texts with disguises undone.

    lexicon: words to look for in runs of letters or short chunks set apart, where no blank tells the words.
    """

    def __init__(self, counts: np.ndarray, lexicon: Iterable[str] = ()):
        self.model = log_model(counts)
        self.known: dict[str, str] = {}
        self.lexicon = frozenset(w for w in lexicon if len(w) > 2)
        self.longest = max(map(len, self.lexicon), default=0)
        # What decode() does with a letter's repeats does not depend on what stands around them.
        once = "".join(chr(96 + i) for i in range(1, 27) if _AGAIN > self.model[i, i] + _PLAIN)
        self.repeats = re.compile(rf"([{once}])\1+" if once else r"(?!)")

    def plain(self, core: str) -> str:
        """decode() of a word of letters."""
        return self.repeats.sub(r"\1", core)

    def word(self, token: str) -> str:
        core = token.strip(_STRIP)
        if core.isascii() and core.isalpha():
            return self.plain(core)
        found = self.known.get(token)
        if found is None:
            if not core or core.isdigit() or not re.search(r"[^\W\d_]", core):
                found = ""
            else:
                # A run of one and the same sign at either end is decoration, not spelling.
                core = folded(re.sub(r"^([^\w])\1+|([^\w])\2+$", "", core))
                found = self.plain(core) if core.isalpha() else decode(core, self.model)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = found
        return found

    def words(self, text: str | None) -> Counter:
        """How often each restored word stands in a text."""
        text = (text or "").lower()
        tokens = Counter(text.split())
        out: Counter = Counter()
        for token, n in tokens.items():
            if w := self.word(token):
                out[w] += n
        if sum(len(t) < 3 for t in tokens) > 1:  # letters set apart
            for m in _SPACED.finditer(text):
                out.update(self.spaced(m[0].split()))
        return out

    def spaced(self, chunks: list[str]) -> list[str]:
        """Words of a run of short chunks: those of the lexicon where they cover most signs, and what single signs stand between."""
        n = len(chunks)
        best, take = [0] * (n + 1), [(1, "")] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i] = best[i + 1]
            size = sum(map(len, chunks[i : i + 2]))
            # Repeats and signs between the letters make a disguise longer than its word.
            for j in range(i + 3, n + 1):
                size += len(chunks[j - 1])
                if size > 2 * self.longest:
                    break
                w = self.word("".join(chunks[i:j]))
                if w in self.lexicon and size + best[j] > best[i]:
                    best[i], take[i] = size + best[j], (j - i, w)
        out, single, i = [], [], 0
        while i <= n:
            step, w = take[i] if i < n else (1, "")
            if i < n and not w and len(chunks[i]) == 1:
                single.append(chunks[i])
            else:
                if len(single) > 2 and (x := decode(folded("".join(single)), self.model)):
                    out.append(x)
                single = []
                out += [w] * bool(w)
            i += step
        return out


@dataclass(frozen=True)
class Model:
    """A fitted scorer: places of the features, their weights (presence, then density), intercept and the letter counts."""

    places: dict[str, int]
    weights: np.ndarray
    intercept: float
    counts: np.ndarray

    def row(self, words: Counter) -> np.ndarray:
        n, x = sum(words.values()), np.zeros(2 * len(self.places))
        held: Counter = Counter()
        places = self.places
        for w, c in words.items():
            if w in places:
                held[w] += c
            if len(w) > 4:
                for k in (4, 5, 6):
                    if len(w) > k and (f := "^" + w[:k]) in places:
                        held[f] += c
        for f, c in held.items():
            x[places[f]] = 1.0
            x[len(places) + places[f]] = math.log1p(200.0 * c / (n + 20))
        return x

    def score(self, words: Counter) -> float:
        z = self.intercept + float(self.row(words) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; x in single precision, the weights in double."""
    n, w, b = len(y), np.zeros(x.shape[1]), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    steepest = float(np.linalg.eigvalsh(x.T @ x)[-1]) if x.size else 1.0
    rate = 1.0 / (0.25 * max(steepest, 0.0) / n + 0.25 + l2 / n)
    vw, vb = w.copy(), b
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ vw.astype(np.float32) + vb, -30, 30)))
        nw, nb = vw - rate * (x.T @ (p - y).astype(np.float32) + l2 * vw) / n, vb - rate * float((p - y).mean())
        step = i / (i + 3)
        vw, vb = nw + step * (nw - w), nb + step * (nb - b)
        w, b = nw, nb
    return w, b


def _features_of(words: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """Features of distinct words: the words themselves, and ^ with the first 4, 5 and 6 letters of longer ones; and of each kind every word's, or -1."""
    size = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False)
    starts = [pa.compute.binary_join_element_wise("^", pa.compute.utf8_slice_codeunits(words, 0, k), "") for k in (4, 5, 6)]
    coded = pa.concat_arrays([s.filter(pa.array(size > k)) for k, s in zip((4, 5, 6), starts)]).dictionary_encode()
    codes, kinds, at = coded.indices.to_numpy(), [np.arange(len(words), dtype=np.int64)], 0
    for k in (4, 5, 6):
        of_word = np.full(len(words), -1, np.int64)
        long = np.flatnonzero(size > k)
        of_word[long] = len(words) + codes[at : at + len(long)]
        kinds.append(of_word)
        at += len(long)
    return pa.concat_arrays([words.cast(pa.string()), coded.dictionary.cast(pa.string())]), kinds


def _held(bags: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of bags of about 200,000 words, their features, and (row, feature, times) with each feature of a row once."""
    end = np.cumsum(pa.compute.list_value_length(bags.column("words")).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(end):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + 200_000, "right")))
        part, at = bags.slice(at, to - at), to
        lists = part.column("words")
        row = np.repeat(np.arange(len(lists), dtype=np.int64), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        word, times = coded.indices.to_numpy(), part.column("times").flatten().to_numpy()
        names, kinds = _features_of(coded.dictionary)
        met = [(of_word, np.flatnonzero(of_word[word] >= 0)) for of_word in kinds]
        key, inverse = np.unique(np.concatenate([row[i] * len(names) + of_word[word[i]] for of_word, i in met]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([times[i] for _, i in met]), minlength=len(key)).astype(np.int64)
        yield part, names, key // len(names), key % len(names), n


def _sampled(docs: DataFrame, labels: DataFrame, counts: np.ndarray, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(toxic, key, n, words, times) of about max_rows labelled rows at most; of near copies with one label, that of the smallest id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    total = usable.count()
    share = min(1.0, max_rows / total) if total else 1.0
    # At most about max_rows ids and labels: a bound that does not depend on the input.
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 53)) / F.lit(float(1 << 53))
    chosen = usable.where(draw < share).select(F.col(id_col).alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    sample = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).join(F.broadcast(chosen), "id").select("text", "id", "toxic")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(counts)
        for b in (p for batch in batches for p in wordhash.portions(batch, 0)):
            hashes, count = wordhash.words_of(b.column(0), lower=True)
            end = np.cumsum(count)
            key = [int(wordhash.runs_of(hashes[e - n : e], min(5, n)).min()) >> 1 if n else 0 for e, n in zip(end, count)]
            bags = [r.words(t.as_py()) for t in b.column(0)]
            lists = [pa.array([[*x.keys()] for x in bags], pa.list_(pa.string())), pa.array([[*x.values()] for x in bags], pa.list_(pa.int32()))]
            n = pa.array([sum(x.values()) for x in bags], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(key, pa.int64()), n, *lists], names=["id", "toxic", "key", "n", "words", "times"])

    bags = sample.mapInArrow(restore, f"id {dict(sample.dtypes)['id']}, toxic int, key long, n long, words array<string>, times array<int>")
    first = F.row_number().over(Window.partitionBy("key", "toxic").orderBy("id", F.xxhash64("words", "times")))
    return scratch.keep(bags.withColumn("at", first).where("at = 1").select("toxic", "key", "n", "words", "times"), "bags")


def _standing_out(bags: DataFrame, rate: float, max_features: int) -> list[str]:
    """Features that stand in at least 3 toxic rows and over 4 standard deviations more often there, the furthest out first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, names, row, code, n in _held(b):
                toxic = part.column("toxic").to_numpy()[row]
                made = [np.bincount(code, weights=w, minlength=len(names)).astype(np.int64) for w in (toxic, n * toxic, n)]
                yield pa.RecordBatch.from_arrays([names, *map(pa.array, made)], names=["feature", "in_bad", "n_bad", "every"])

    counted = bags.mapInArrow(count, "feature string, in_bad long, n_bad long, every long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("in_bad", "n_bad", "every")))
    expected = F.col("every") * F.lit(rate)
    # What stands in few documents must not count by standing there often.
    z = (F.col("n_bad") - expected) / F.sqrt(expected + 1) * F.least(F.lit(1.0), F.col("in_bad") / 10)
    best = counted.where("in_bad >= 3").withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "feature").limit(max_features)
    return [r.feature for r in best.select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_features: int = 400, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled documents outside the held-out fifth (crc32 of the id's digits, mod 5, is 0).

    The letter counts cover all documents. The classifier is fitted on at most about max_rows labelled
    rows, chosen by a hash of the id; their features are counted where they lie, and only how often each row
    holds the kept ones reaches the driver. Near copies count once. Words and beginnings of words that stand in
    at least 3 toxic rows and stand out there (over 4 standard deviations) are candidates; the max_features
    that stand out most are kept. A document that is labelled twice counts with each label. Without rows of
    both labels the model has no feature.
    """
    counts = letter_counts(docs, text_col)
    bags = _sampled(docs, labels, counts, max_rows, id_col, text_col)
    of = {r.toxic: r for r in bags.groupBy("toxic").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    bad, good = (of[k].rows if k in of else 0 for k in (1, 0))
    if not bad or not good:
        scratch.drop(bags)
        return Model({}, np.zeros(0), math.log((bad + 0.5) / (good + 0.5)) if bad + good else -3.0, counts)
    best = _standing_out(bags, of[1].n / max(1, of[1].n + of[0].n), max_features)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(best, pa.string())
        for b in batches:
            for part, names, row, code, n in _held(b):
                at = pa.compute.index_in(names, known).fill_null(-1).to_numpy()[code]
                pick = at >= 0
                ends = pa.array(np.searchsorted(row[pick], np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[pick].astype(np.int32))) for x in (at, n)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("key", "toxic", "n")] + lists, names=["key", "toxic", "n", "at", "held"])

    rows = bags.mapInArrow(place, "key long, toxic int, n long, at array<int>, held array<int>").toArrow().sort_by([("key", "ascending"), ("toxic", "ascending")])
    scratch.drop(bags)
    y, n = rows.column("toxic").to_numpy().astype(float), rows.column("n").to_numpy()
    lists = rows.column("at").combine_chunks()
    row = np.repeat(np.arange(len(y)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    at, held = lists.flatten().to_numpy(), rows.column("held").combine_chunks().flatten().to_numpy()
    x = np.zeros((len(y), 2 * len(best)), np.float32)
    x[row, at] = 1
    x[row, len(best) + at] = np.log1p(200.0 * held / (n[row] + 20))
    w, b = _fit(x, y)
    return Model({f: k for k, f in enumerate(best)}, w, b, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, score, predicted) of every row; keep: all columns of docs instead of the id alone.

    score is between 0 and 1; predicted is 1 from 0.5 on. Null and empty texts get the score of a text
    without words. Rows stay one for one, repeats included; columns named score or predicted are replaced.
    """
    names = [c for c in (docs.columns if keep else [id_col]) if c not in ("score", "predicted")]
    # The columns that stay travel as one, so that none can bear the name of another.
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([base.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model.counts, (w for w in model.places if not w.startswith("^")))
        for b in (p for batch in batches for p in wordhash.portions(batch, 1)):
            p = [model.score(r.words(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32())], names=["row", "score", "predicted"])

    return base.mapInArrow(run, kind).select(*[F.col(f"row.`{c}`").alias(c) for c in names], "score", "predicted")
