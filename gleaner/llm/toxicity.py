"""Toxicity: a support vector machine over a subsequence string kernel, made linear by Nyström landmarks.

The kernel of two words sums decay ** (span + span) over the subsequences of three letters they share, gaps allowed
within a window, so a word with letters put in or left out stays close to the word it hides. A sentence is as toxic
as its worst word, a text as its worst sentence. Only texts carry labels, so training is multiple-instance: all
sentences of clean texts are negative, of a toxic text the sentence that scores highest is positive, and both are
chosen anew in every round.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 3000  # labelled rows the classifier is fitted on at most, half of each label as far as there are
LANDMARKS = 192  # a third of them words of toxic texts, the rest words of clean ones
DECAY, WINDOW = 0.7, 7  # of a subsequence's span; the longest span counted
PIECE = 36  # longer runs of letters are read in overlapping pieces of this length
ROUNDS = 4
CACHED = 400_000  # tokens whose scores a worker remembers
_LETTERS = 64  # the edge of a word is 0, then come a-z, and other letters share what is left
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){2,}[^\W\d_](?!\S)")
_RUN = re.compile(r"[^\W\d_]+")
_PLACES: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}


def _places(length: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The three-letter subsequences of a word of this length: places, weights, and the norm of the weights."""
    if length not in _PLACES:
        found = [(i, i + j, i + k) for i in range(length) for j, k in combinations(range(1, WINDOW), 2) if i + k < length]
        places = np.array(found, np.int64).reshape(-1, 3)
        weights = DECAY ** (places[:, 2] - places[:, 0] + 1.0)
        _PLACES[length] = places, weights.astype(np.float32), float(np.sqrt((weights**2).sum())) or 1.0
    return _PLACES[length]


def views(token: str) -> list[str]:
    """What a lower-cased token may say: its runs of letters, and its letters without what stands between them."""
    runs = _RUN.findall(token)
    if len(runs) > 1:
        runs.append("".join(runs))
    return [v[k:k + PIECE] for v in runs for k in range(0, max(1, len(v) - PIECE // 2), PIECE // 2)]


def tokens_of(text: str) -> set[str]:
    """The distinct tokens of a whole text, lower-cased, and words written with spaces between their letters."""
    lower = text.lower()
    found = set(lower.split())
    if any(len(t) == 1 for t in found):
        found.update("".join(m.split()) for m in _SPACED.findall(lower))
    return found


@dataclass
class Model:
    """Landmark subsequences, and the line fitted in their space; `slope` and `shift` make scores of distances."""

    rows: np.ndarray  # of each three-letter code: its place in `weights`, 0 for none
    weights: np.ndarray  # one row per code, one column per landmark
    line: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    slope: float = 0.0
    shift: float = -4.0
    summed: np.ndarray | None = None  # of each three-letter code: its weight along the line

    def kernel(self, words: list[str]) -> np.ndarray:
        """The kernel of each word with each landmark, both normalised by their length."""
        out = np.zeros((len(words), self.weights.shape[1]), np.float32)
        for length, at in _by_length(words).items():
            places, weights, norm = _places(length + 2)
            for cut in range(0, len(at), max(1, 20_000 // len(places))):
                part = at[cut:cut + max(1, 20_000 // len(places))]
                codes = _codes([words[k] for k in part], length)
                rows = self.rows[_triples(codes, places)]
                hit_word, hit_place = np.nonzero(rows)  # most subsequences are in no landmark
                values = self.weights[rows[hit_word, hit_place]] * weights[hit_place, None]
                edges = np.searchsorted(hit_word, np.arange(len(part)))
                sums = np.add.reduceat(np.vstack([values, np.zeros((1, values.shape[1]), np.float32)]), edges, axis=0)
                sums[np.diff(np.append(edges, len(values))) == 0] = 0
                out[part] = sums / norm
        return out

    def distances(self, words: list[str]) -> np.ndarray:
        """kernel(words) @ line + bias, with the line multiplied into the landmarks' subsequences once."""
        if self.summed is None:
            self.summed = (self.weights @ self.line).astype(np.float32)[self.rows]
        out = np.full(len(words), self.bias)
        for length, at in _by_length(words).items():
            places, weights, norm = _places(length + 2)
            for cut in range(0, len(at), max(1, 400_000 // len(places))):
                part = at[cut:cut + max(1, 400_000 // len(places))]
                triples = _triples(_codes([words[k] for k in part], length), places)
                out[part] += self.summed[triples] @ weights / norm
        return out

    @property
    def learned(self) -> bool:
        """Whether scores differ between texts at all."""
        return self.line.size > 0

    def slim(self) -> Model:
        """What scoring needs, without the landmarks."""
        self.distances([])
        return replace(self, rows=np.zeros(0, np.int32), weights=np.zeros((0, 0), np.float32))

    def probability(self, distance: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * distance + self.shift, -30, 30)))

    def token_distances(self, tokens: Iterable[str]) -> dict[str, float]:
        tokens = list(tokens)
        seen = [views(t) for t in tokens]
        flat = list(dict.fromkeys(v for vs in seen for v in vs))
        value = dict(zip(flat, self.distances(flat).tolist(), strict=True))
        return {t: max((value[v] for v in vs), default=self.bias) for t, vs in zip(tokens, seen, strict=True)}


def _by_length(words: list[str]) -> dict[int, list[int]]:
    """Places of the words long enough to hold a subsequence."""
    found: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) >= 3:
            found.setdefault(len(w), []).append(k)
    return found


def _codes(words: list[str], length: int) -> np.ndarray:
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.int64)
    letters = np.where((letters > 96) & (letters < 123), letters - 96, 27 + letters % 36)
    return np.pad(letters, ((0, 0), (1, 1)))


def _triples(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (codes[:, places[:, 0]] * _LETTERS + codes[:, places[:, 1]]) * _LETTERS + codes[:, places[:, 2]]


def with_landmarks(words: list[str]) -> Model:
    place: dict[int, int] = {}
    entries: list[tuple[np.ndarray, np.ndarray]] = []
    for w in words:
        places, weights, norm = _places(len(w) + 2)
        codes = _triples(_codes([w], len(w)), places)[0].tolist()
        entries.append((np.array([place.setdefault(c, len(place) + 1) for c in codes], np.int64), weights / norm))
    rows = np.zeros(_LETTERS**3, np.int32)
    rows[list(place)] = list(place.values())
    held = np.zeros((len(place) + 1, len(words)), np.float32)
    for k, (at, weights) in enumerate(entries):
        np.add.at(held[:, k], at, weights)
    return Model(rows, held)


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4.0) -> tuple[np.ndarray, float]:
    """The line of an SVM with squared hinge loss, by Newton steps; the last column of `x` is 1."""
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    line = np.zeros(x.shape[1])

    def loss(at: np.ndarray) -> float:
        return float(at @ ridge @ at + cost * (weight * np.maximum(0, 1 - y * (x @ at)) ** 2).sum())

    now = loss(line)
    for _ in range(100):
        active = np.flatnonzero(y * (x @ line) < 1)
        curve, pull = ridge.copy(), np.zeros(x.shape[1])
        for cut in range(0, len(active), 2048):  # a block of rows at a time, so that `x` is not held again
            part = active[cut:cut + 2048]
            weighted = x[part] * (cost * weight[part])[:, None]
            curve += weighted.T @ x[part]
            pull += weighted.T @ y[part]
        step = np.linalg.solve(curve, pull) - line
        size = 1.0
        while (after := loss(line + size * step)) > now and size > 1e-4:
            size /= 2
        if now - after < 1e-6 * now:
            break
        line, now = line + size * step, after
    return line[:-1], float(line[-1])


def _platt(distance: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through labelled distances, with Platt's softened targets."""
    up, down = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([distance, np.ones_like(distance)], axis=1)
    at = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 1e-6 * at
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return float(max(at[0], 0.0)), float(at[1])


def _apart(texts: list[str], labels: list[int]) -> list[int]:
    """One of each group of copies and near copies of one label, told by the two long tokens of least hash: a word
    that copies of one toxic text share is no sign of toxicity."""
    first: dict[tuple, int] = {}
    for k, (t, y) in enumerate(zip(texts, labels, strict=True)):
        tokens = t.lower().split()
        long = sorted({xxhash.xxh3_64_intdigest(w.encode()) for w in tokens if len(w) > 7})[:2]
        first.setdefault((y, *(long if len(long) == 2 else tokens)), k)
    return sorted(first.values())


def _bags(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """All distinct words of the texts in order, and of each text the places of its own among them."""
    number: dict[str, int] = {}
    bags = []
    for x in texts:  # only numbers of a text are kept
        own = {number.setdefault(v, len(number)) for t in tokens_of(x) for v in views(t) if len(v) > 2}
        bags.append(np.fromiter(own, np.int32, len(own)))
    words = sorted(number)
    place = np.empty(len(words), np.int32)
    place[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
    return words, [np.sort(place[b]) for b in bags]


def fit(texts: list[str], labels: list[int], share: float | None = None, landmarks: int = LANDMARKS) -> Model:
    """Fit on labelled texts; `share` is how many of all texts are toxic, where the sample is not alike.

    With one label only, the model gives every text the same score: the share of toxic ones.
    """
    kept = _apart(texts, labels)
    label = np.array([labels[k] for k in kept], np.int64)
    share = float(label.mean()) if share is None and len(label) else share or 0.0
    if not len(label) or label.min() == label.max():
        model = with_landmarks([])
        model.shift = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
        return model
    words, bag_at = _bags([texts[k] for k in kept])
    a, b = np.zeros(len(words)), np.zeros(len(words))  # how many toxic and clean texts hold each word
    for k, y in zip(bag_at, label.tolist(), strict=True):
        (a if y else b)[k] += 1
    up, down = (label == 1).sum(), (label == 0).sum()
    p = (a + b) / (up + down)
    odds = (a / up - b / down) / np.sqrt(p * (1 - p) * (1 / up + 1 / down) + 1e-9)  # z of the two rates
    order = np.lexsort((np.arange(len(words)), -odds))
    weight = np.where(label == 1, share / max(label.mean(), 1e-9), (1 - share) / max(1 - label.mean(), 1e-9))
    strong = (a >= 3) & (odds > 4) & (a / up > 4 * b / down)  # words that toxic texts alone have
    likely = a / up > 2 * b / down
    clean = np.nonzero(b)[0]
    # of a toxic text with strong words the worst one speaks, of another its worst that clean texts have more seldom
    toxic_bags = [k[strong[k]] if strong[k].any() else k[likely[k]] for k, y in zip(bag_at, label.tolist(), strict=True) if y]
    toxic_bags = [k for k in toxic_bags if len(k)]
    if not len(clean) or not toxic_bags:
        return fit([], [], share)
    toxic_side = _spread([words[k] for k in order[:6000]], landmarks // 3, [])
    chosen = toxic_side + _spread([words[k] for k in clean[np.lexsort((clean, -b[clean]))][:2000]], landmarks // 6, toxic_side)
    score, rng, model = odds, np.random.default_rng(0), with_landmarks([])
    # strong words with a letter put in
    hidden = [w[:k] + chr(97 + int(rng.integers(26))) + w[k:] for w in np.array(words)[strong].tolist() if len(w) > 3 for k in range(1, len(w))]
    for n_round in range(ROUNDS):
        if n_round in (0, 1):
            if n_round:  # the clean words that look most toxic are landmarks too
                chosen = chosen + _spread([words[k] for k in clean[np.argsort(-score[clean], kind="stable")][:6000]], landmarks - len(chosen), chosen)
            model = with_landmarks(chosen)
            kmm = model.kernel(chosen).astype(float)
            value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
            root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T  # Nyström: K_mm ** -1/2
        witness = Counter(int(k[score[k].argmax()]) for k in toxic_bags)
        for k in np.nonzero(strong)[0].tolist():
            witness[k] = max(witness[k], int(a[k]))
        plus = np.array(sorted(witness))
        hard = clean[np.argsort(-score[clean], kind="stable")[:6000]]
        minus = np.unique(np.concatenate([hard, rng.choice(clean, min(4000, len(clean)), replace=False)]))
        at = np.concatenate([plus, minus])
        y = np.concatenate([np.ones(len(plus)), -np.ones(len(minus))])
        n = np.concatenate([[witness[int(k)] for k in plus], b[minus] * up / down])
        x = np.ones((len(at) + len(hidden), len(root) + 1))
        x[:len(at), :-1] = model.kernel([words[k] for k in at]) @ root  # only these rows of the kernel are ever made
        x[len(at):, :-1] = model.kernel(hidden) @ root
        y = np.concatenate([y, np.ones(len(hidden))])
        n = np.concatenate([n, np.full(len(hidden), 4.0)])
        line, bias = _squared_hinge(x, y, np.sqrt(np.maximum(n, 0.1)))
        model.line, model.bias = (root @ line).astype(np.float32), bias
        model.summed = None  # of the line before
        score = model.distances(words)
    worst = np.array([score[k].max() if len(k) else model.bias for k in bag_at])
    model.slope, model.shift = _platt(worst, label, weight)
    return model


def _spread(words: list[str], n: int, taken: list[str]) -> list[str]:
    """The first `n` of at most 800 words that are not too much like an earlier one."""
    words = [w for w in dict.fromkeys(words) if 3 <= len(w) <= 16][:800]
    others = taken + words
    like = np.hstack([with_landmarks(others[k:k + 128]).kernel(words) for k in range(0, len(others), 128)]) if others else np.zeros((0, 0))
    kept: list[int] = []
    for k in range(len(words)):
        if len(kept) < n and like[k, list(range(len(taken))) + [len(taken) + j for j in kept]].max(initial=0) <= 0.6:
            kept.append(k)
    return [words[k] for k in kept]


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, label: str, rows: int = TRAIN_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most `rows` labelled documents, chosen by a hash of the id, half of each label as far as
    there are; and how many labelled rows have each label. `docs` has (id, text)."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows // 2) for y in (0, 1)]
    return docs.join(F.broadcast(picked[0].unionByName(picked[1])), "id").select("text", "label"), counts  # `rows` ids at most


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample of `labels` (id, 0 or 1; others are not read) and the texts of their documents."""
    sample, counts = labelled_sample(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), labels, id, label, rows)
    got = sorted((r["text"] or "", r["label"]) for r in sample.toLocalIterator())  # `rows` at most
    return fit([t for t, _ in got], [y for _, y in got], counts.get(1, 0) / max(1, sum(counts.values())))


def worst_sentence(text: str, token: str) -> str:
    """The sentence of a text in which the token that decides its score stands first."""
    lower = text.lower()
    at = lower.find(token)
    if at < 0:  # written with spaces between its letters
        at = next((m.start() for m in _SPACED.finditer(lower) if "".join(m.group().split()) == token), 0)
    start = max(text.rfind(c, 0, at) for c in ".!?\n") + 1
    ends = [k for k in (text.find(c, at + len(token)) for c in ".!?\n") if k >= 0]
    return text[start:min(ends, default=len(text)) + 1].strip()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with toxic_score (0 to 1) and worst_sentence, the sentence that decides, where the score is 0.5 or more.

    Every word of a whole text counts, however long. Null and empty texts have the score of a text without words.
    Columns of these names are replaced; rows are judged one by one, so repeated rows and ids do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.slim())
    docs = docs.drop(*[c for c in ("toxic_score", "worst_sentence") if c != text])
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for whole in batches:
            for cut in range(0, whole.num_rows, 500):
                batch = whole.slice(cut, 500)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                tokens = [tokens_of(t) for t in texts]
                if len(known) > CACHED:
                    known = {}
                known.update(model.token_distances({t for ts in tokens for t in ts if t not in known}))
                distance = np.array([max(map(known.__getitem__, ts), default=model.bias) for ts in tokens])
                p = model.probability(distance)
                worst = [
                    worst_sentence(t, max(ts, key=known.__getitem__, default="")) if x >= 0.5 else None
                    for t, ts, x in zip(texts, tokens, p, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(p), pa.array(worst, pa.string())],
                    schema=batch.schema.append(pa.field("toxic_score", pa.float64())).append(pa.field("worst_sentence", pa.string())),
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, toxic_score double, worst_sentence string")
