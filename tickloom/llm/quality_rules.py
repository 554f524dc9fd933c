"""Quality rules: base heuristics and a decision list learned by sequential covering.

The learned part is a list of interpretable threshold conjunctions over text statistics. Rules for bad
documents are grown one at a time on two thirds of the labelled rows (conditions are added by FOIL gain)
and pruned on the other third; what a rule covers is taken out before the next is grown. The list is
emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import labelled
from tickloom.ship import in_arrow

SYMBOLS = b"#*$%&|<>"
UPPER, LETTERS, DIGITS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(48, 58))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_marks", "n_lines")
SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS)
#: Statistics that rules may test, as SQL over the counts.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words": "double(n_words)",
}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in windows of `width` words that occur twice or more, the first time included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    code, size = ids, len(names)
    for k in range(1, width):
        # pair codes are renumbered before they could pass 2^63, so equal codes mean equal windows
        if size > (1 << 62) // len(names):
            code, size = np.unique(code, return_inverse=True)[1].astype(np.int64), len(code)
        code = code[: len(words) - k] * len(names) + ids[k:]
        size *= len(names)
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[back] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of a whole text in UTF-8 (null: none)."""
    text = text or b""
    words = text.split()
    size = lambda kept, drop: len(kept) - len(kept.translate(None, drop))
    joined = b"".join(words)
    lines, seen, dups = text.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            dups += bool(line.split())
        seen.add(line)
    # continuation bytes are not characters of their own
    chars = len(joined) - size(joined, bytes(range(0x80, 0xC0)))
    marks = joined.count(b"!") + joined.count(b"?")
    return len(words), chars, size(text, SYMBOLS), dups, repeated_words(words), size(text, UPPER), size(text, LETTERS), size(text, DIGITS), marks, len(lines) if text else 0


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x.as_py()) for x in batch.column("text").cast(pa.binary())]
        made = np.array(rows, dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, made.T.copy())], names=["doc_id", *COUNTS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS for every row; other columns are ignored, repeated rows are kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, _statistics, SCHEMA)


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best = None
        for name in sorted(x):
            values, flags = x[name][inside], bad[inside]
            order = np.argsort(values, kind="stable")
            v, f = values[order], flags[order]
            cut = np.flatnonzero(v[:-1] < v[1:])
            if not len(cut):
                continue
            p_low, n_low = np.cumsum(f)[cut], np.cumsum(~f)[cut]
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                    best = (gain[k], Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = _covered(r, x, len(bad))
        p, n = (bad & c).sum(), (~bad & c).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = max(range(1, len(rule) + 1), key=lambda k: (worth(rule[:k]), -k), default=0)
    return rule[:best]


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.7) -> list[Rule]:
    """Sequential covering over labelled statistics; the third held for pruning is every third row.

    Stops when no bad row is left, or the next rule is right on less than `precision` of the rows held out.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and (bad & left & ~third).any():
        grow, prune = left & ~third, left & third
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        hit = _covered(rule, x, len(bad)) & left
        if not rule or not (hit & bad).any():
            break
        held = hit & prune
        if (held & bad).sum() < precision * max(1, held.sum()):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_column(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: the text of the first rule that rejects a row, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.expr(" and ".join(c.sql() for c in rule)), F.lit(" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule))).otherwise(out)
    return out


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.expr(v) for k, v in FEATURES.items()})


def fit_rules(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> list[Rule]:
    """Rules learned from about `bound` different labelled texts at most, chosen by a hash of doc_id.

    Documents that the base heuristics reject teach nothing. Without labels of both kinds the list is empty.
    """
    sample = labelled(docs, labels, bound)
    rows = with_features(text_statistics(sample)).where(f"not ({BASE_FAILED})")
    got = rows.select("doc_id", *FEATURES).join(F.broadcast(sample.select("doc_id", "label").distinct()), "doc_id").toPandas()
    got = got.sort_values(["doc_id", *FEATURES], kind="stable")
    order = np.argsort(np.array([hash_order(i) for i in got["doc_id"]], dtype=np.uint64), kind="stable")
    got = got.iloc[order]
    bad = (got["label"] == 0).to_numpy(dtype=bool)
    if not bad.any() or bad.all():
        return []
    return learn_rules({k: got[k].to_numpy(dtype=float) for k in FEATURES}, bad)


def hash_order(i: int) -> int:
    """A fixed shuffle of ids, so that the rows held for pruning are not tied to their order."""
    return (int(i) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 8


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, base counts, base_failed, rule (that rejected the row, else null) and kept."""
    return (
        with_features(stats)
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("rule", F.when(~F.col("base_failed"), rule_column(rules)))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
        .select("doc_id", *COUNTS[:5], "base_failed", "rule", "kept")
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts for every row of `docs`; empty and null texts have no word, so they fail the base rule."""
    return apply_rules(text_statistics(docs), fit_rules(docs, labels))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `docs`, all columns, that the base heuristics and the rules keep; nothing is shuffled.

    Null and empty texts have no word, so they go. Repeated rows and rows without a doc_id are judged like any.
    """
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = row.field(row.type.get_field_index("text")).cast(pa.string()).cast(pa.binary())
            made = np.array([statistics(x.as_py()) for x in texts], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([row, *map(pa.array, made.T.copy())], names=["row", *COUNTS])

    rows = with_features(in_arrow(docs.select(F.struct("*").alias("row")), run, schema))
    return rows.where(~F.expr(BASE_FAILED) & rule_column(rules).isNull()).select("row.*")
