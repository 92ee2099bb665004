"""A log-bilinear language model, trained in numpy with noise-contrastive estimation.

Words are symbols: the HEAD most frequent tokens stand for themselves, every other token for one of TAIL
classes by its last two bytes. The model predicts the next symbol from the two before it: the context
vector C1 r(w1) + C2 r(w2) meets the target's vector and bias. Partitions train on their own tokens from
common weights, and their weights are averaged in proportion to their tokens. Scores are normalised
exactly: exp of the two halves of every logit are matrices, and their product holds all normalisers. A
token's probability is its symbol's times its share of the class, so all V known tokens and an unknown
one per class add up to 1.

Counts, base scores and training cover all training documents. Tokens that are at least 1 / FREQUENT of
all tokens (FREQUENT at most) are known to every task; the others are looked up by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contestry.llm.common import as_bytes, query, record, slices, spool, table

HEAD, TAIL, DIM = 768, 256, 24
SYMBOLS = HEAD + TAIL
#: White space cannot occur in a word.
END = "\n"
FREQUENT = 200_000
SMOOTH = 0.1
BATCH, NOISE, RATE, SEED = 4096, 32, 0.05, 7
#: One training document in WARM warms up the common weights, in so many rounds of averaging.
WARM, WARM_ROUNDS = 64, 2
#: Entries a task counts before it passes its sums on.
FLUSH = 300_000
ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("base_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])
DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>, times array<long>"


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text modulo 10 is 0; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(10)) == 0


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts)).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])
        counts.clear()
        return batch

    for batch in slices(batches, 500):
        for text in as_bytes(batch.column(0)):
            counts.update(text.lower().split())
        counts[END.encode()] += batch.num_rows
        if len(counts) > FLUSH:
            yield out()
    if counts:
        yield out()


@dataclass
class Vocabulary:
    """What every task knows: symbols of the frequent tokens, counts, class totals. Bounded by FREQUENT."""

    known: dict[bytes, int]
    symbol: np.ndarray
    count: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def base(self) -> np.ndarray:
        return np.log10((self.count + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    @property
    def share(self) -> np.ndarray:
        """log10 share of a frequent token in its class; 0 in the head."""
        k = np.maximum(self.symbol - HEAD, 0)
        within = np.log10((self.count + SMOOTH) / (self.class_total[k] + SMOOTH * (self.class_distinct[k] + 1)))
        return np.where(self.symbol < HEAD, 0.0, within)

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Symbols of all tokens, document ends included, ids of frequent tokens (-1: rare), words per text."""
        ids, words, known, end = [], [], self.known, self.known[END.encode()]
        for text in texts:
            own = text.lower().split()
            words.append(own)
            ids.extend([known.get(w, -1) for w in own])
            ids.append(end)
        ids = np.array(ids, np.int64)
        symbols = self.symbol[ids]
        rare = np.flatnonzero(ids < 0)
        if len(rare):
            flat = [w for own in words for w in (*own, b"")]
            seen: dict[bytes, int] = {}
            for i in rare.tolist():
                key = flat[i][-2:]
                if key not in seen:
                    seen[key] = HEAD + tail_class(key)
                symbols[i] = seen[key]
        return symbols, ids, words


@dataclass
class Weights:
    """r: symbol vectors of contexts, q and b: vectors and biases of targets, c1 and c2: context matrices."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c1: np.ndarray
    c2: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c1, self.c2)])

    @staticmethod
    def shaped(flat: np.ndarray) -> Weights:
        shapes = ((SYMBOLS, DIM), (SYMBOLS, DIM), (SYMBOLS,), (DIM, DIM), (DIM, DIM))
        cuts = np.cumsum([np.prod(s) for s in shapes])[:-1]
        return Weights(*[x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, cuts), shapes)])

    @staticmethod
    def start(noise: np.ndarray) -> Weights:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return Weights(draw(SYMBOLS, DIM), draw(SYMBOLS, DIM), np.log(noise).astype(np.float32), np.eye(DIM, dtype=np.float32), 0.5 * np.eye(DIM, dtype=np.float32))


def _by_symbol(ids: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[first], np.add.reduceat(grads[order], first, axis=0)


class Trainer:
    """Noise-contrastive steps with adagrad; every batch shares one draw of noise symbols."""

    def __init__(self, weights: Weights, noise: np.ndarray, seed: int):
        self.w, self.noise, self.rng = weights, noise, np.random.default_rng(seed)
        self.squares = {k: np.full_like(v, 1e-2) for k, v in vars(weights).items()}
        self.cumulative = np.cumsum(noise)
        self.seen = 0

    def _move(self, name: str, ids, grad: np.ndarray) -> None:
        value, squares = getattr(self.w, name), self.squares[name]
        squares[ids] += grad * grad
        value[ids] -= RATE * grad / np.sqrt(squares[ids])

    def step(self, w2: np.ndarray, w1: np.ndarray, target: np.ndarray) -> None:
        w, n = self.w, len(target)
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), SYMBOLS - 1)
        r1, r2 = w.r[w1], w.r[w2]
        context = r1 @ w.c1 + r2 @ w.c2
        log_kp = np.log(NOISE * self.noise).astype(np.float32)
        real = 1 / (1 + np.exp(np.clip((context * w.q[target]).sum(1) + w.b[target] - log_kp[target], -30, 30)))
        fake = 1 / (1 + np.exp(-np.clip(context @ w.q[drawn].T + w.b[drawn] - log_kp[drawn], -30, 30)))
        real, fake = -real / n * BATCH / 64, fake / n * BATCH / 64
        d_context = real[:, None] * w.q[target] + fake @ w.q[drawn]
        ids = np.r_[target, drawn]
        at, d_q = _by_symbol(ids, np.vstack([real[:, None] * context, fake.T @ context]))
        _, d_b = _by_symbol(ids, np.r_[real, fake.sum(0)])
        d_c1, d_c2 = r1.T @ d_context, r2.T @ d_context
        at_r, d_r = _by_symbol(np.r_[w1, w2], np.vstack([d_context @ w.c1.T, d_context @ w.c2.T]))
        self._move("q", at, d_q)
        self._move("b", at, d_b)
        self._move("r", at_r, d_r)
        self._move("c1", slice(None), d_c1)
        self._move("c2", slice(None), d_c2)
        self.seen += n

    def text(self, symbols: np.ndarray, end: int) -> None:
        w2, w1, target = _triples(symbols, end)
        order = self.rng.permutation(len(target))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            self.step(w2[own], w1[own], target[own])


def _triples(symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two symbols before each and the symbol; before a document stand ends."""
    w1 = np.r_[end, symbols[:-1]]
    w2 = np.where(w1 == end, end, np.r_[end, end, symbols[:-2]][:len(symbols)])
    return w2, w1, symbols


def _train(vocabulary, start, noise: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        end = int(known.symbol[known.known[END.encode()]])
        trainer = Trainer(Weights.shaped(start.value.copy()), noise, TaskContext.get().partitionId())
        for batch in slices(batches, 300):
            trainer.text(known.symbols(as_bytes(batch.column(0)))[0], end)
        if trainer.seen:
            flat = trainer.w.flat().astype(np.float64) * trainer.seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat))), pa.array(np.r_[float(trainer.seen), flat])], names=["at", "v"])

    return run


def train(texts: DataFrame, vocabulary, noise: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Average of the partitions' weights, one pass from ``flat``; ``flat`` itself where there are no texts."""
    start = texts.sparkSession.sparkContext.broadcast(flat)
    sums = dict(map(tuple, texts.mapInArrow(_train(vocabulary, start, noise), "at long, v double").groupBy("at").agg(F.sum("v")).collect()))
    return np.array([sums[i] for i in range(len(flat))]) / sums[-1] if sums else flat


class Scorer:
    """Normalised log10 probabilities of symbols."""

    def __init__(self, weights: Weights):
        half1, half2 = (weights.r @ weights.c1) @ weights.q.T + weights.b, (weights.r @ weights.c2) @ weights.q.T
        top1, top2 = half1.max(1, keepdims=True), half2.max(1, keepdims=True)
        norm = np.log(np.exp(half1 - top1).astype(np.float64) @ np.exp(half2 - top2).astype(np.float64).T)
        self.half1, self.half2, self.norm = half1, half2, norm + top1 + top2.T

    def __call__(self, w2: np.ndarray, w1: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.half1[w1, target].astype(np.float64) + self.half2[w2, target] - self.norm[w1, w2]) / np.log(10)


def _score(vocabulary, flat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scorer = vocabulary.value, Scorer(Weights.shaped(flat.value))
        end, base, share = int(known.symbol[known.known[END.encode()]]), known.base, known.share
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 300):
            symbols, ids, words = known.symbols(as_bytes(batch.column(2)))
            lengths = np.array([len(w) + 1 for w in words], np.int64)
            first = np.cumsum(lengths) - lengths
            frequent = ids >= 0
            of_model = scorer(*_triples(symbols, end)) + np.where(frequent, share[ids], 0.0)
            of_base = np.where(frequent, base[ids], 0.0)
            n_known = np.add.reduceat((frequent & (known.count[ids] > 0)).astype(np.int64), first)
            rare = [Counter(w for w, f in zip(own, frequent[at:at + len(own)].tolist()) if not f) for own, at in zip(words, first.tolist())]
            tokens, times = [[w.decode() for w in c] for c in rare], [list(c.values()) for c in rare]
            n = batch.num_rows
            yield record(ROWS, [np.arange(row, row + n), batch.column(0), batch.column(1), lengths, n_known, np.add.reduceat(of_base, first), np.add.reduceat(of_model, first), tokens, times])
            row += n

    return run


def warm_up(docs: DataFrame) -> DataFrame:
    """Training texts for the warm-up: a share of the rows, whatever their texts, in as many partitions as it takes."""
    return spool(docs.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(WARM)) == 0)).select("text"), "warm")


def learn(docs: DataFrame):
    """(vocabulary table, bounded Vocabulary and weights as broadcasts) of the training rows of ``docs``."""
    spark = docs.sparkSession
    texts = docs.where(~F.col("held_out")).select("text")
    table_ = spool(texts.mapInArrow(_count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")), "vocabulary")
    total, distinct = table_.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    order = [F.desc("c"), F.col("token")]
    head = [r.token for r in table_.where(F.col("token") != END).orderBy(*order).limit(HEAD - 1).collect()]
    frequent = {r.token: r.c for r in table_.where(F.col("c") * FREQUENT >= total).collect()}
    tops = {r.token: r.c for r in table_.where(F.col("token").isin([*head, END])).collect()} | {}
    counts = {END: 0} | frequent | tops
    symbol_of = {t: i for i, t in enumerate([END, *head])}
    keys = [k.encode() for k in counts]
    symbol = np.array([symbol_of.get(k, HEAD + tail_class(k.encode())) for k in counts], np.int64)
    rest = table_.where(~F.col("token").isin(list(symbol_of))) if symbol_of else table_
    classes = rest.groupBy(_class_of(F.col("token")).alias("k")).agg(F.sum("c"), F.count("*")).collect()
    class_total, class_distinct = np.zeros(TAIL), np.zeros(TAIL)
    for k, c, n in classes:
        class_total[k], class_distinct[k] = c, n
    known = Vocabulary({k: i for i, k in enumerate(keys)}, symbol, np.array(list(counts.values()), np.float64), total, distinct, class_total, class_distinct)
    noise = np.r_[[counts.get(t, 0) for t in (END, *head)], np.zeros(HEAD - 1 - len(head)), class_total] + SMOOTH
    noise = noise / noise.sum()
    vocabulary = spark.sparkContext.broadcast(known)
    flat = Weights.start(noise).flat()
    warm = warm_up(docs)
    for _ in range(WARM_ROUNDS):
        flat = train(warm, vocabulary, noise, flat)
    return table_, known, vocabulary, spark.sparkContext.broadcast(train(texts, vocabulary, noise, flat))


def _class_of(token: Column) -> Column:
    data = token.cast("binary")
    return F.pmod(F.crc32(F.substring(data, F.greatest(F.octet_length(data) - 1, F.lit(1)), F.lit(2))), F.lit(TAIL))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``.

    Null text counts as empty and is its end token alone. Equal or null ids and repeated rows are scored as
    separate documents; equal texts have equal scores. Without training rows no token is known.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    words, known, vocabulary, flat = learn(rows)
    scored = spool(rows.mapInArrow(_score(vocabulary, flat), DDL), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("n"))
    looked = rare.join(words, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # TAIL numbers each
    totals = [F.array(*[F.lit(float(x)) for x in known_]) for known_ in (known.class_total, known.class_distinct)]
    k = _class_of(F.col("token"))
    within = (F.col("c") + SMOOTH) / (F.get(totals[0], k) + SMOOTH * (F.get(totals[1], k) + 1))
    base = (F.col("c") + SMOOTH) / (known.total + SMOOTH * (known.distinct + 1))
    more = looked.groupBy("row").agg(F.sum(F.col("n") * F.log10(base)).alias("b"), F.sum(F.col("n") * F.log10(within)).alias("s"),
                                     F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"))
    out = scored.drop("rare", "times").join(more, "row", "left").na.fill(0, ["k"]).na.fill(0.0, ["b", "s"])
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("k")).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
                      (F.col("base_score") + F.col("b")).alias("base_score"), (F.col("score") + F.col("s")).alias("score"))


@query("op4_lbl")
def op4_lbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
