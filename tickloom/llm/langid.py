"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to 3, the blended spectrum) present in
both, over the root of the product of their own numbers. Landmark texts (Nyström) turn the kernel into
features, one-versus-rest kernel ridge regression weighs them, and texts are scored in batches: presence
matrix times landmark matrix times weights.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fold
from tickloom.ship import in_arrow



def _not_letters() -> str:
    """The characters that a regular expression takes for word characters though they are no letters (category L), as ranges."""
    odd = [i for i in range(sys.maxunicode + 1) if chr(i).isalnum() and unicodedata.category(chr(i))[0] != "L"]
    starts = [i for i, before in zip(odd, [-2, *odd], strict=False) if i != before + 1]
    ends = [i for i, after in zip(odd, [*odd[1:], -2], strict=True) if i + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


WORD = re.compile(rf"[^\W_{_not_letters()}]+")
UNKNOWN = "und"
BATCH = 64


def presence(text: str | None) -> np.ndarray:
    """Sorted codes of the distinct n-grams (1 to 3) of the lower-cased letters, words parted by a space."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    # a letter's lower case can be several code points; 21 bits hold any
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    threes = np.unique(points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:])
    twos = np.unique(np.append(threes >> np.uint64(21), points[-2] << np.uint64(21) | points[-1]))
    ones = np.unique(np.append(twos >> np.uint64(21), points[-1]))
    return np.concatenate([ones, twos, threes])


@dataclass(frozen=True)
class LanguageModel:
    """langs, sorted n-gram codes of the landmarks, landmark presence (codes x landmarks), their sizes, weights."""

    langs: tuple[str, ...]
    codes: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(grams), len(self.codes)), dtype=np.float32)
        for row, g in zip(rows, grams, strict=True):
            at = np.searchsorted(self.codes, g)
            at[at == len(self.codes)] = 0
            row[at[self.codes[at] == g]] = 1
        own = np.array([max(1, len(g)) for g in grams], dtype=float)
        return (rows @ self.landmarks).astype(float) / np.sqrt(own[:, None] * self.sizes)

    def predict(self, grams: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Languages and scores; ties go to the language first in order. No letter: und with score 0."""
        langs, scores = [], np.zeros(len(grams))
        for at in range(0, len(grams), BATCH):
            some = grams[at : at + BATCH]
            margin = 6 * (self.kernel(some) @ self.weights + self.bias)
            odds = np.exp(margin - margin.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            best = odds.argmax(axis=1)
            known = np.array([len(g) > 0 for g in some])
            langs += [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            scores[at : at + len(some)] = np.where(known, odds[np.arange(len(some)), best], 0.0)
        return langs, scores


def fit(langs: list[str], grams: list[np.ndarray], landmarks: int = 32, ridge: float = 1e-2, most: int = 1024) -> LanguageModel | None:
    """Kernel ridge regression on Nyström features; `landmarks` of each language, the first with 100 n-grams.

    With many languages each has fewer, so that there are about `most` in all.
    """
    names = tuple(sorted(set(langs)))
    if not names:
        return None
    landmarks = max(4, min(landmarks, most // len(names)))
    chosen = []
    for name in names:
        own = [i for i, x in enumerate(langs) if x == name]
        chosen += sorted(own, key=lambda i: (-min(len(grams[i]), 100), i))[:landmarks]
    codes = np.unique(np.concatenate([grams[i] for i in chosen]))
    matrix = np.zeros((len(codes), len(chosen)), dtype=np.float32)
    for k, i in enumerate(chosen):
        matrix[np.searchsorted(codes, grams[i]), k] = 1
    sizes = np.array([float(len(grams[i])) for i in chosen])
    blank = LanguageModel(names, codes, matrix, sizes, np.zeros((len(chosen), len(names))), np.zeros(len(names)))
    cross = np.concatenate([blank.kernel(grams[at : at + BATCH]) for at in range(0, len(grams), BATCH)])
    values, vectors = np.linalg.eigh(blank.kernel([grams[i] for i in chosen]))
    use = values > 1e-6 * values[-1]
    root = vectors[:, use] / np.sqrt(values[use])
    x = cross @ root
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    share = 1 / np.array([langs.count(lang) for lang in langs], dtype=float)
    share *= len(langs) / share.sum()
    mean_x, mean_y = np.average(x, axis=0, weights=share), np.average(y, axis=0, weights=share)
    a = ((x - mean_x) * share[:, None]).T @ (x - mean_x) + ridge * len(langs) * np.eye(x.shape[1]) * 0.1
    w = np.linalg.solve(a, ((x - mean_x) * share[:, None]).T @ (y - mean_y))
    return LanguageModel(names, codes, matrix, sizes, root @ w, mean_y - mean_x @ w)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [presence(x.as_py()).view(np.int64) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("u"), pa.array(made, pa.list_(pa.int64()))], names=["lang", "u", "grams"])


def train(docs: DataFrame, per_language: int = 400, rows_in_all: int = 80_000) -> LanguageModel | None:
    """Learn from text and lang of rows whose fold (crc32 of doc_id modulo 3) is not 1.

    All languages are learned. About `per_language` rows of each at most, fewer where that would pass `rows_in_all` but 16 at
    least, chosen by a hash of doc_id and text, reach the driver as n-gram codes. Repeated rows teach once; rows without a language, a doc_id or a letter
    teach nothing.
    """
    rows = docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    per_language = min(per_language, max(16, rows_in_all // len(counts)))
    # rank in a hash order, as a share: a language with n rows keeps those below per_language / n
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    picked = rows.select("text", "lang", u.alias("u")).where(F.col("u") < F.try_element_at(share, "lang")).groupBy("lang", "u").agg(F.first("text").alias("text"))
    got = in_arrow(picked.select("text", "lang", "u"), _grams, "lang string, u double, grams array<long>").where("size(grams) > 0").toArrow()
    made = [(lang, u, np.asarray(g.values.to_numpy(zero_copy_only=False)).view(np.uint64)) for lang, u, g in zip(got["lang"].to_pylist(), got["u"].to_pylist(), got["grams"].combine_chunks(), strict=True)] if got.num_rows else []
    made.sort(key=lambda r: (r[1], r[0], len(r[2])))
    return fit([r[0] for r in made], [r[2] for r in made])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from the whole text alone.

    Null, empty and letterless texts: und, 0. No model (nothing to learn from): und, 0. held_out is false
    for a null doc_id. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            grams = [presence(x.as_py()) for x in batch.column("text")]
            langs, scores = model.predict(grams) if model else ([UNKNOWN] * len(grams), np.zeros(len(grams)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
