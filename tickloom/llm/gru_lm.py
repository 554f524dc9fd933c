"""Log-likelihood of whole documents under a gated recurrent language model.

Counts come from every training document: words are counted in the tasks and summed by Spark, the most
frequent `head` words are broadcast, and the counts of all others reach the documents through a join, so the
vocabulary is never cut. The network (one GRU layer, trained in numpy by truncated backpropagation) reads and
predicts every token: the known words and the end by ids of their own, every other word by the id that it shares with
the words of like ending (a hash of its last bytes), through a softmax factored into classes; among the words
of one ending a word has the chance of its smoothed count. The known words are the fewest that cover a share
of all training tokens. Every training document trains the network: in each of a few rounds the tasks go
through a part of the documents, each from the same weights, and the weights they reach are averaged in Spark,
weighted by tokens. State is carried across windows, so a document's likelihood conditions on all its earlier
words.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import LOWER_ASCII, checkpointed, fold, shared_dir
from tickloom.ship import in_arrow

#: Stands for the end of a document; no word is empty.
END = b""
SMOOTH = 0.1
#: Bytes at a word's end that tell which id it shares with others.
TAIL = 3
#: Texts that a training task turns into ids at once.
TEXTS = 2048
NAMES = ("inputs", "recur", "classes", "within")


def by_id(ids: np.ndarray) -> np.ndarray:
    """The stable order of ids, which numpy finds fastest for 16 bits."""
    return np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_ASCII).split()


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What `words_of` finds in each of the texts, one after another, and how many words each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    split = pc.ascii_split_whitespace(trimmed)
    filled = pc.fill_null(pc.greater(pc.binary_length(trimmed), 0), False)
    n = np.where(filled.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False), 0)
    words = split.flatten().cast(pa.binary())
    # a text without a word is split into one empty word
    return (words if len(words) == n.sum() else words.filter(pc.greater(pc.binary_length(words), 0))), n.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for teaches in (True, False):
            texts = batch.column("text").filter(pc.equal(batch.column("teaches"), teaches))
            found = words_in(texts)[0].value_counts()
            m = pa.concat_arrays([found.field("counts"), pa.array([len(texts)], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())]), m if teaches else pa.array(np.zeros(len(m), np.int64)), m], names=["word", "n", "m"])


def word_counts(docs: DataFrame, teaches: Column) -> DataFrame:
    """word (bytes, lower-cased; empty: the end), n and m: how often each occurs in the texts that teach, and in all."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(teaches, F.lit(False)).alias("teaches"))
    return in_arrow(rows, _count, "word binary, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Ids(dict):
    """Word to id: the known words by ids of their own, any other by the id of its ending."""

    def __init__(self, known: dict[bytes, int], endings: list[int]):
        super().__init__(known)
        self.endings = endings

    def __reduce__(self) -> tuple:
        return Ids, (dict(self), self.endings)

    def __missing__(self, word: bytes) -> int:
        return self.endings[zlib.crc32(word[-TAIL:]) % len(self.endings)]

    def by_ending(self, words: pa.Array) -> np.ndarray:
        """The id of each word's ending; each ending is looked up once."""
        tails = pc.binary_slice(words, -TAIL).dictionary_encode()
        return np.array([self.__missing__(w) for w in tails.dictionary.to_pylist()], dtype=np.int64)[tails.indices.to_numpy()]


def places(words: pa.Array, head: pa.Array) -> np.ndarray:
    """Where the head has each word; -1: nowhere."""
    return pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy(zero_copy_only=False)


def by_gate(rows: np.ndarray) -> np.ndarray:
    """Rows of `inputs` or `recur` taken apart (3, rows, H), what is for the two gates negative: `Network.turn` wants it so."""
    made = np.array(rows.reshape(len(rows), 3, -1).swapaxes(0, 1), order="C")
    np.negative(made[:2], out=made[:2])
    return made


@dataclass
class Network:
    """A GRU over ids, commonest first, with a class-factored softmax.

    Classes are runs of ids with like sums of the square roots of their counts, which keeps those of common ids
    small: `first[c]` is the first id of class c.
    """

    inputs: np.ndarray  # (ids, 3H): what a word adds to the gates and the candidate
    recur: np.ndarray  # (H, 3H)
    classes: np.ndarray  # (H + 1, C)
    within: np.ndarray  # (H + 1, ids)
    first: np.ndarray  # (C + 1,)

    @property
    def size(self) -> int:
        return self.recur.shape[0]

    @staticmethod
    def blank(counts: np.ndarray, hidden: int, classes: int, seed: int = 7) -> Network:
        """Small random weights; output biases are the log shares of the counts, so it starts as a unigram model."""
        random = np.random.default_rng(seed)
        share = np.cumsum(np.sqrt(counts))
        first = np.unique(np.concatenate([[0], np.searchsorted(share, share[-1] * np.arange(1, classes) / classes) + 1, [len(counts)]]))
        total = np.add.reduceat(counts, first[:-1])
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        draw = lambda *s: random.normal(0, 0.1, s).astype(np.float32)
        classes_w, within = draw(hidden + 1, len(total)), draw(hidden + 1, len(counts))
        classes_w[-1], within[-1] = np.log(total / total.sum()), np.log(counts / total[of])
        inputs = draw(len(counts), 3 * hidden)
        inputs[:, :hidden] -= 1.0  # update gates start nearly closed: state lasts
        return Network(inputs, draw(hidden, 3 * hidden) * 3, classes_w, within, first)

    def copy(self) -> Network:
        return Network(*(getattr(self, k).copy() for k in NAMES), self.first)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in NAMES])

    def with_weights(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([getattr(self, k).size for k in NAMES])[:-1]
        return Network(*(x.astype(np.float32).reshape(getattr(self, k).shape) for k, x in zip(NAMES, np.split(flat, cuts), strict=True)), self.first)

    @staticmethod
    def turn(state: np.ndarray, given: np.ndarray, recur: np.ndarray, own: np.ndarray, gate: np.ndarray, fresh: np.ndarray, after: np.ndarray) -> None:
        """Fill in what the state adds to gates and candidate, the gates, the candidate and the state after a word.

        given: what the word adds, apart `by_gate` like `recur`.
        """
        np.matmul(state, recur, out=own)
        np.add(own[:2], given[:2], out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.multiply(gate[1], own[2], out=fresh)
        fresh += given[2]
        np.tanh(fresh, out=fresh)
        np.subtract(fresh, state, out=after)
        after *= gate[0]
        after += state

    def step(self, state: np.ndarray, given: np.ndarray, recur: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The state after a word (given: its row of `inputs`), the gates, the candidate and what it had from the state.

        With `recur`, that and `given` are apart by gate.
        """
        if recur is None:
            given, recur = by_gate(given), by_gate(self.recur)
        own = np.empty_like(given)
        gate, fresh, after = np.empty_like(given[:2]), np.empty_like(given[2]), np.empty_like(given[2])
        with np.errstate(over="ignore"):  # a gate that is shut
            self.turn(state, given, recur, own, gate, fresh, after)
        return after, gate, fresh, own[2]

    def log_chance(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of each target's chance given the state before it."""
        order = by_id(targets)
        hit = targets[order]
        full = np.ones((len(states), self.size + 1), states.dtype)
        full[:, :-1] = states.take(order, axis=0)
        edges = np.searchsorted(hit, self.first)

        def log_soft(part: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
            score = part @ weights
            # states lie between -1 and 1, so small weights cannot overflow
            if np.abs(weights).sum(axis=0).max() > 80:
                score -= score.max(axis=1, keepdims=True)
            chosen = score[np.arange(len(at)), at]
            np.exp(score, out=score)
            return (chosen - np.log(score @ np.ones(score.shape[1], score.dtype))).astype(float)

        made = log_soft(full, self.classes, np.repeat(np.arange(len(self.first) - 1), np.diff(edges)))
        for c in np.flatnonzero(np.diff(edges)):
            low, high, rows = self.first[c], self.first[c + 1], slice(edges[c], edges[c + 1])
            if high - low > 1:
                made[rows] += log_soft(full[rows], self.within[:, low:high], hit[rows] - low)
        out = np.empty(len(targets))
        out[order] = made
        return out

    def score(self, texts: list[np.ndarray], window: int = 1 << 15) -> np.ndarray:
        """Natural log-likelihood of each id sequence (ending with the end), all in step, longest first.

        Chances are taken for about `window` words at a time, however many steps these are.
        """
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        ordered, out = sizes[order], np.zeros(len(texts))
        flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.int64)
        start = np.cumsum(ordered) - ordered
        state = np.zeros((len(texts), self.size), np.float32)
        states, targets, owners, held = [], [], [], 0
        inputs, recur = by_gate(self.inputs), by_gate(self.recur)
        running = np.searchsorted(-ordered, -np.arange(int(ordered[0]) if len(texts) else 0), side="left").tolist()
        for t, n in enumerate(running):
            state = state[:n]
            ids = flat[start[:n] + t]
            states.append(state)
            targets.append(ids)
            owners.append(n)
            held += n
            last = t + 1 == len(running)
            if not last:
                state = self.step(state, inputs.take(ids, axis=1), recur)[0]
            if held >= window or last:
                made, done = self.log_chance(np.concatenate(states), np.concatenate(targets)), 0
                for n in owners:
                    out[order[:n]] += made[done : done + n]
                    done += n
                states, targets, owners, held = [], [], [], 0
        return out

    def gradient(self, state: np.ndarray, part: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Truncated backpropagation over part (steps + 1 words of each lane): gradients, the ids whose rows of
        `inputs` they cover, and the state after the last step."""
        steps, lanes, h = len(part) - 1, part.shape[1], self.size
        given, recur = by_gate(self.inputs.take(part[:-1].ravel(), axis=0)).reshape(3, steps, lanes, h), by_gate(self.recur)
        states, gates = np.empty((steps + 1, lanes, h), np.float32), np.empty((steps, 2, lanes, h), np.float32)
        fresh, owns = np.empty((steps, lanes, h), np.float32), np.empty((steps, 3, lanes, h), np.float32)
        states[0] = state
        with np.errstate(over="ignore"):
            for t in range(steps):
                self.turn(states[t], given[:, t], recur, owns[t], gates[t], fresh[t], states[t + 1])
        targets = part[1:].ravel()
        n = len(targets)
        order = by_id(targets)
        hit = targets[order]
        full = np.ones((n, h + 1), np.float32)
        full[:, :h] = states[1:].reshape(n, h).take(order, axis=0)
        edges = np.searchsorted(hit, self.first)
        met, width = np.diff(edges), np.diff(self.first)
        one = np.float32(1)

        # chances are kept unscaled and the states are scaled instead, which are fewer
        p = full @ self.classes
        if np.abs(self.classes).sum(axis=0).max() > 60:
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        z = p @ np.ones(p.shape[1], p.dtype)
        p[np.arange(n), np.repeat(np.arange(len(met)), met)] -= z
        z = (one / (n * z))[:, None]
        grads = {"classes": (full * z).T @ p, "within": np.zeros_like(self.within)}
        back = p @ self.classes[:h].T
        back *= z
        # the chances within classes, one class after another in one array
        wide = np.repeat(width, met)
        begin = np.cumsum(wide) - wide
        p = np.empty(int(wide.sum()), np.float32)
        parts, at = [], 0
        for c in np.flatnonzero(met).tolist():
            size = int(met[c] * width[c])
            part_p = p[at : at + size].reshape(met[c], width[c])
            parts.append((slice(edges[c], edges[c + 1]), slice(self.first[c], self.first[c + 1]), part_p))
            at += size
        for rows, ids, made in parts:
            np.matmul(full[rows], self.within[:, ids], out=made)
        if np.abs(self.within).sum(axis=0).max() > 60:
            p -= np.repeat(np.maximum.reduceat(p, begin), wide)
        np.exp(p, out=p)
        z = np.add.reduceat(p, begin)
        p[begin + hit - np.repeat(self.first[:-1], met)] -= z
        z = (one / (n * z))[:, None]
        scaled, inner = full * z, np.empty((n, h), np.float32)
        for rows, ids, made in parts:
            np.matmul(scaled[rows].T, made, out=grads["within"][:, ids])
            np.matmul(made, self.within[:h, ids].T, out=inner[rows])
        inner *= z
        back += inner
        from_words = np.empty((n, h), np.float32)
        from_words[order] = back
        from_words = from_words.reshape(steps, lanes, h)
        # all that does not depend on later steps is worked out for the whole span at once
        update, reset, own = gates[:, 0], gates[:, 1], owns[:, 2]
        to_fresh = update * (1 - fresh * fresh)
        slope = np.empty((steps, lanes, 3, h), np.float32)
        slope[:, :, 0] = (fresh - states[:-1]) * (update * (1 - update))
        slope[:, :, 1] = to_fresh * own * (reset * (1 - reset))
        slope[:, :, 2] = to_fresh * reset
        lasts, laters, back_to = 1 - update, np.empty((steps, lanes, h), np.float32), np.ascontiguousarray(self.recur.T)
        later = np.zeros((lanes, h), np.float32)
        for t in range(steps - 1, -1, -1):
            later += from_words[t]
            laters[t] = later
            slope[t] *= later[:, None]
            later *= lasts[t]
            later += slope[t].reshape(lanes, 3 * h) @ back_to
        to_state = slope.reshape(steps, lanes, 3 * h)
        to_input = to_state.copy()
        np.multiply(laters, to_fresh, out=to_input[:, :, 2 * h :])
        grads["recur"] = states[:-1].reshape(n, h).T @ to_state.reshape(n, 3 * h)
        order = by_id(part[:-1].ravel())
        touched, first = np.unique(part[:-1].ravel()[order], return_index=True)
        # numbers in pairs: half as many sums
        pairs = to_input.reshape(n, 3 * h).take(order, axis=0)
        pairs = pairs.view(np.complex64) if h % 2 == 0 else pairs
        grads["inputs"] = np.add.reduceat(pairs, first, axis=0).view(np.float32)
        return grads, touched, states[-1]


@dataclass
class Learner:
    """Trains a network on a stream of word ids with Adam steps; moments of `inputs` move with the rows that occur."""

    network: Network
    rate: float
    lanes: int = 256
    span: int = 16
    length: int = 128
    done: int = 0
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.moments = {k: (np.zeros_like(getattr(self.network, k)), np.zeros_like(getattr(self.network, k))) for k in NAMES}

    def learn(self, stream: np.ndarray) -> None:
        """Go through the stream once, cut into lanes side by side; the state is carried from span to span."""
        lanes = max(1, min(self.lanes, len(stream) // self.length))
        filled = np.concatenate([stream, np.full(-len(stream) % lanes, stream[-1])])
        rows = np.ascontiguousarray(filled.reshape(lanes, -1).T)
        state = np.zeros((lanes, self.network.size), np.float32)
        for at in range(0, len(rows) - 1, self.span):
            grads, touched, state = self.network.gradient(state, rows[at : at + self.span + 1])
            self.update(grads, touched)

    def update(self, grads: dict[str, np.ndarray], touched: np.ndarray) -> None:
        self.done += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        cut, fix = float(min(1.0, 5.0 / max(norm, 1e-12))), 1 - 0.99**self.done
        pace = self.rate / (1 - 0.9**self.done)
        for k, g in grads.items():
            held = (getattr(self.network, k), *self.moments[k])
            w, m, v = (x.take(touched, axis=0) for x in held) if k == "inputs" else held
            g *= cut
            m *= 0.9
            move = 0.1 * g
            m += move
            v *= 0.99
            g *= g
            g *= 0.01
            v += g
            np.divide(v, fix, out=move)
            np.sqrt(move, out=move)
            move += 1e-6
            np.divide(m, move, out=move)
            move *= pace
            w -= move
            if k == "inputs":
                for x, rows in zip(held, (w, m, v), strict=True):
                    x[touched] = rows


@dataclass
class Model:
    """What scoring needs in every task: the head's words, their training counts and ids, the ids of endings, the network and the totals."""

    words: dict[bytes, int]
    counts: np.ndarray
    ids: np.ndarray
    ending: Ids
    network: Network
    tokens: int
    distinct: int
    shared: np.ndarray  # by id: the smoothed count of the words that share it, 0 for a known word's own

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + SMOOTH) / (self.tokens + SMOOTH * (self.distinct + 1)))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int, int]]:
    """(word, n, m) of about the `most` commonest words by m, commonest first, in the order of words where m is the same.

    The least count comes from a histogram over steps of a 64th of a power of two, some thousand rows however many
    words there are; of the step that is not taken whole a hash of the word takes a part. So no task sends the driver
    its own top list, and words of one count that are more than `most` leave no empty list.
    """
    step = F.floor(F.log2("m") * 64)
    held, taken = 0, F.lit(True)
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        if held + r["count"] > most:
            part = F.pmod(F.xxhash64("word", F.lit("step")), F.lit(1 << 30)) < int((1 << 30) * (most - held) / r["count"])
            taken = (step > r["s"]) | ((step == r["s"]) & part)
            break
        held += r["count"]
    rows = [(bytes(r["word"]), r["n"], r["m"]) for r in counts.where(taken).collect()]
    return sorted(rows, key=lambda r: (-r[2], r[0]))


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = sorted((part, tokens, bytes(w)) for batch in batches for part, tokens, w in zip(*(batch.column(c).to_pylist() for c in ("part", "tokens", "weights")), strict=True))
    if got:
        total = np.sum([np.frombuffer(w, np.float32) for _, _, w in got], axis=0, dtype=np.float64).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([got[0][0]], pa.int32()), pa.array([sum(n for _, n, _ in got)], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "tokens", "weights"])


def one_round(network: Network, docs: DataFrame, head: pa.Array, id_of: np.ndarray, ending: Ids, end: int, rate: float, lanes: int) -> Network:
    """The average, weighted by tokens, of the networks that the tasks reach, each on its documents (text) from `network`.

    Each task goes through its words in `lanes` side by side. The sums of weights are merged sixteen to one until few
    are left for the driver.
    """
    context = docs.sparkSession.sparkContext
    ships = context.broadcast((network, head, id_of, ending))
    schema = "part int, tokens long, weights binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, head, id_of, ending = ships.value
        learner = Learner(network.copy(), rate, lanes)
        # each document starts from what follows an end
        held, tokens, full = np.array([end]), 0, learner.lanes * learner.length
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                words, n = words_in(batch.column("text").slice(first, TEXTS))
                place = places(words, head)
                ids, beyond = id_of[place], place < 0
                ids[beyond] = ending.by_ending(words.filter(pa.array(beyond)))
                held, at = np.concatenate([held, np.insert(ids, np.cumsum(n), end)]), 0
                while len(held) - at > full:
                    learner.learn(held[at : at + full + 1])
                    at += full
                held, tokens = held[at:], tokens + at
        if len(held) > 1:
            learner.learn(held)
            tokens += len(held) - 1
        if tokens:
            made = learner.network.flat() * np.float32(tokens)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([tokens], pa.int64()), pa.array([made.tobytes()], pa.binary())], names=schema.replace(",", "").split()[::2])

    models = in_arrow(docs.select("text"), run, schema)
    many = docs.rdd.getNumPartitions()
    while many > 16:
        many = -(-many // 16)
        models = in_arrow(models.repartition(many, "part"), _sum, schema)
    got = sorted(models.collect(), key=lambda r: r["part"])
    ships.unpersist()
    if not got:
        return network
    return network.with_weights(np.sum([np.frombuffer(r["weights"], np.float32) for r in got], axis=0, dtype=np.float64) / sum(r["tokens"] for r in got))


def train(docs: DataFrame, counts: DataFrame, head: int, coverage: float, hidden: int, classes: int, rounds: int, least: int, endings: int) -> Model:
    """Fit the network on all of `docs` (doc_id, text), those of a round chosen by a hash of doc_id.

    A corpus of fewer than `least` tokens is gone through as often as makes up for it, eight times at most.
    """
    totals = counts.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = int(totals[0]), int(totals[1])
    top = frequent(counts, head)
    if not any(w == END for w, _, _ in top):
        end = counts.where(F.length("word") == 0).first()
        top.append((END, end["n"] if end else 0, end["m"] if end else 0))
    words = {w: k for k, (w, _, _) in enumerate(top)}
    n_of = np.array([n for _, n, _ in top], dtype=np.int64)
    by_count = [k for k in sorted(range(len(top)), key=lambda k: (-n_of[k], top[k][0])) if n_of[k] or top[k][0] == END]
    share = np.cumsum(n_of[by_count]) / max(1, tokens)
    known = by_count[: int(np.searchsorted(share, coverage)) + 1]
    known += [words[END]] if words[END] not in known else []
    # an ending has the counts of its words that are not known, and one share for the unseen
    ending = F.crc32(F.substring("word", -TAIL, TAIL)) % endings
    of_ending = np.full(endings, SMOOTH)
    for r in counts.where("n > 0").groupBy(ending.alias("e")).agg(F.sum(F.col("n") + SMOOTH).alias("n")).collect():
        of_ending[r["e"]] += r["n"]
    for k in known:
        if n_of[k]:
            of_ending[zlib.crc32(top[k][0][-TAIL:]) % endings] -= n_of[k] + SMOOTH
    mass = np.concatenate([n_of[known] + SMOOTH, np.maximum(of_ending, SMOOTH)])
    order = np.argsort(-mass, kind="stable")
    place = np.empty(len(mass), np.int64)
    place[order] = np.arange(len(mass))
    shared = np.where(order < len(known), 0, mass[order])
    ending_ids = Ids({}, place[len(known) :].tolist())
    own = {top[k][0]: int(i) for k, i in zip(known, place)}
    id_of = np.array([own[w] if w in own else ending_ids[w] for w, _, _ in top], dtype=np.int64)
    heads = pa.array([w for w, _, _ in top], pa.binary())
    network = Network.blank(mass[order], hidden, classes)
    passes = max(1, min(8, -(-least // max(1, tokens)))) if tokens else 0
    # a task goes through a few hundred thousand tokens at least, so that what it learns is worth averaging
    text = docs.where("doc_id is not null").select(F.col("doc_id"), F.col("text"))
    tasks = max(1, min(text.rdd.getNumPartitions(), tokens // (rounds * 100_000)))
    text = text.coalesce(tasks)
    # and takes some two hundred steps a round: few lanes where words are few, many where they are many
    lanes = max(32, min(512, tokens // (rounds * tasks * 3200)))
    for k in range(rounds * passes):
        some = text.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k % rounds).select("text")
        network = one_round(network, some, heads, id_of, ending_ids, own[END], 0.02 * (1 - 0.9 * k / max(1, rounds * passes - 1)), lanes)
    return Model(words, n_of, id_of, ending_ids, network, tokens, distinct, shared)


def score(docs: DataFrame, head: int = 200_000, coverage: float = 0.6, hidden: int = 24, classes: int = 48, rounds: int = 3, least: int = 2_000_000, group: int = 2048, endings: int = 512) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    Training documents are those whose crc32(doc_id) modulo 10 is not 0; a null doc_id is scored but teaches
    nothing and is not held out. A null or empty text is the end alone. Repeated rows each have theirs; extra
    columns are ignored. `group` documents run in step.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", 10) == 0).alias("_held"))
    counts = checkpointed(word_counts(rows, ~F.col("_held")))
    model = train(rows.where("not _held"), counts, head, coverage, hidden, classes, rounds, least, endings)
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        head, end = pa.array(list(model.words), pa.binary()), model.words[END]
        logs, met = np.append(model.base(model.counts), 0.0), np.append(model.counts > 0, False)
        task, done = TaskContext.get().partitionId(), 0
        # a known word has the network's chance; another word that of its ending, times that of its count among its words
        own_id = model.shared == 0
        share = np.log10(np.where(own_id, 1, model.shared / (model.tokens + SMOOTH * (model.distinct + 1))))
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                some = batch.slice(at, group)
                words, n = words_in(some.column("text"))
                place = places(words, head)
                beyond = place < 0
                # each text's words that the head has not, and how often it has them
                unknown = words.filter(pa.array(beyond)).dictionary_encode()
                kinds = max(1, len(unknown.dictionary))
                pairs, often = np.unique(np.repeat(np.arange(len(n)), n)[beyond] * kinds + unknown.indices.to_numpy(), return_counts=True)
                rare, ends = unknown.dictionary.take(pa.array(pairs % kinds)), np.searchsorted(pairs, np.arange(len(n) + 1) * kinds)
                own = model.ids[place]
                own[beyond] = model.ending.by_ending(unknown.dictionary)[unknown.indices.to_numpy()]
                stops = np.cumsum(n)
                own, place = np.insert(own, stops, model.ids[end]), np.insert(place, stops, end)
                n_tokens = n + 1
                begin = np.cumsum(n_tokens) - n_tokens
                log = logs[place]
                base = np.add.reduceat(log, begin)
                n_known = np.add.reduceat(met[place].astype(np.int64), begin)
                rest = np.add.reduceat(np.where(own_id[own], 0, log) - share[own], begin)
                made = model.network.score(np.split(own, begin[1:])) / np.log(10) + rest
                number = np.arange(done, done + some.num_rows, dtype=np.int64) + (task << 33)
                done += some.num_rows
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("held_out"), pa.array(number), *(pa.array(x, pa.int64()) for x in (n_tokens, n_known)), pa.array(base, pa.float64()), pa.array(made, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(often, pa.int32())], names=["word", "n"]))],
                    names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "rare"],
                )

    held = F.coalesce("_held", F.lit(False)).alias("held_out")
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    in_arrow(rows.select("doc_id", held, "text"), run, schema).write.parquet(folder)
    return _with_rare(spark.read.parquet(folder), counts, model)


def _with_rare(scored: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """Add what the words beyond the head are worth; each row is met by its number in the stored table.

    The head holds the commonest words of all documents, so no word that is joined here is a large share of them.
    """
    n = F.coalesce(F.col("c"), F.lit(0))
    worth = F.log10((n + SMOOTH) / (model.tokens + SMOOTH * (model.distinct + 1)))
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("k"))
    joined = rare.join(counts.where("n > 0").select("word", F.col("n").alias("c")), "word", "left")
    sums = joined.groupBy("row").agg(F.sum(F.col("k") * worth).alias("more"), F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("met"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )
