"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vectors of three letters in a row are permuted by their place and
multiplied (bound) into the vector of the trigram; trigrams are added up (bundled) into the vector of a text, and
texts into the prototype of a language. A text has the language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 1024
_SCALE = 1 << 20  # shares of trigrams are added up as whole numbers, so no order of addition changes a prototype
_CHUNK = 2048


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


@cache
def letter_vector(code: int, width: int = WIDTH) -> np.ndarray:
    """The vector of a letter, or of the edge of a word (0)."""
    return np.random.default_rng([code, width]).integers(0, 2, width, dtype=np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One bound vector per trigram code."""
    parts = [(codes >> s) & 0x1FFFFF for s in (42, 21, 0)]
    letters, at = np.unique(np.concatenate(parts), return_inverse=True)
    base = np.stack([letter_vector(int(c), width) for c in letters]) if len(letters) else np.zeros((0, width), np.int8)
    first, second, third = np.split(at, 3)
    return np.roll(base, 2, axis=1)[first] * np.roll(base, 1, axis=1)[second] * base[third]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a whole text and how often each stands; the edges of words count as letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.concatenate([[0], np.where(_is_letter()[points], points, 0), [0]])
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return np.unique(codes[points[1:-1] != 0], return_counts=True)


def bundle(codes: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The sum of the vectors of all trigrams, each as often as it stands; exact."""
    total = np.zeros(width)
    for cut in range(0, len(codes), _CHUNK):
        total += counts[cut:cut + _CHUNK].astype(np.float64) @ trigram_vectors(codes[cut:cut + _CHUNK], width)
    return total


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", width: int = WIDTH) -> dict[str, np.ndarray]:
    """The prototype of every language, over all rows with a text and a language; every text weighs the same."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(which: str, parts: list) -> None:
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            held[which] = codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes))

        for batch in batches:
            new: dict[str, list] = {}
            for t, which in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = trigrams(t)
                if len(codes):
                    new.setdefault(which, []).append((codes, np.rint(n * (_SCALE / n.sum()))))
            for which, parts in new.items():
                add(which, parts + ([held[which]] if which in held else []))
        for which, (codes, n) in held.items():
            total = bundle(codes, n, width).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([which]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["lang", "total"])

    known = docs.select(F.col(text), F.col(lang).cast("string")).dropna()
    parts = known.mapInArrow(count, "lang string, total array<bigint>")
    sums = parts.select("lang", F.posexplode("total").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect()  # `width` numbers a language
    return {r["lang"]: np.array([v["x"] for v in r["v"]], np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, known: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """`docs` with lang_pred and lang_score, the cosine with the prototype (0 to 1).

    Texts that are null or hold no letter are `und` with score 0, as is everything where no language was learned.
    Equal cosines give the language that comes first by name. Columns of these names are replaced.
    """
    docs = docs.drop(*[c for c in ("lang_pred", "lang_score") if c != text])
    names = sorted(known)
    matrix = np.stack([known[n] / (np.linalg.norm(known[n]) or 1.0) for n in names], axis=1) if names else np.zeros((WIDTH, 0))
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for whole in batches:
            for cut in range(0, whole.num_rows, 256):
                batch = whole.slice(cut, 256)
                found, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                grams = [trigrams(t or "") for t in batch.column(at).to_pylist()]
                codes, place = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
                vectors = trigram_vectors(codes, len(matrix)) if len(codes) < 1 << 16 else None
                low = 0
                for k, (own, n) in enumerate(grams):
                    rows, low = place[low:low + len(own)], low + len(own)
                    if not len(own) or not names:
                        continue
                    if vectors is None or len(own) > _CHUNK:
                        total = bundle(own, n, len(matrix))
                    else:
                        total = n.astype(np.float32) @ vectors[rows].astype(np.float32)
                    cosine = (total @ matrix) / (np.linalg.norm(total) or 1.0)
                    best = int(np.argmax(cosine))
                    found[k], score[k] = names[best], min(1.0, max(0.0, float(cosine[best])))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found), pa.array(score)],
                    schema=batch.schema.append(pa.field("lang_pred", pa.string())).append(pa.field("lang_score", pa.float64())),
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, lang_pred string, lang_score double")
