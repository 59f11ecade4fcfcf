"""Language-model scores by a hierarchical Pitman-Yor model.

Each word (and the end of a text, after which the next text begins) is the
context of a restaurant whose customers are the words that follow it; all of
these restaurants share the root as their parent, whose base is even.  A dish
of a restaurant seats its customers at tables, and each table is a customer of
the same dish in the parent.  Seating is sampled by Gibbs, a dish at a time:
how many tables a dish has given its customers, the restaurant's other tables
and what the parent predicts.  Dishes are drawn side by side, against the state
after the round before.  Several chains run at once; predictive probabilities
are averaged over them.

The model's words are the most frequent ones, at most ``WORDS``, whose tables
and customers are arrays of bounded size that every task holds.  Rarer words
are one dish, shared out among them by their own counts and one.  Pairs of
words are not bounded: they are counted and kept in packed buckets.  Scoring
asks by blocks of texts: a block's distinct pairs go to the buckets, their
probabilities come back in the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import bucket_bits, buckets_of, byte_kinds, count_keys, merged, mixed, pack_sorted, planes, split_words, unpack_sorted, unplaned
from .common import BLANKS, arrow_batches, settle

KINDS = byte_kinds(BLANKS)
#: Words with a dish of their own at most; their arrays take about 60 MB of a task's memory with four chains.
WORDS = 1 << 19
CHAINS, ROUNDS = 4, 3
#: Up to so many customers a dish's tables are drawn from their exact distribution; further ones sit down in blocks.
EXACT = 64
#: Bytes of text in a block that asks for probabilities at once.
BLOCK = 1 << 24
END = mixed(np.array([0x5EED_E17D], np.uint64))[0]
#: A dish takes 21 bits, a pair 42; multiplying by an odd number modulo 2 ** 42 spreads pairs over the buckets.
DISH_BITS = 21
_SHIFT, _PAIR = np.uint64(DISH_BITS), np.uint64((1 << 2 * DISH_BITS) - 1)
_ODD = 0xA0761D6478B
_BACK = np.uint64(pow(_ODD, -1, 1 << 2 * DISH_BITS))
_ODD = np.uint64(_ODD)
#: Log10 probabilities travel as multiples of this.
_STEP = 2.0**-18
#: Bits of a key's head by which words are looked up.
_HEAD = np.uint64(64 - 20)


def table_weights(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers: [c, t] weighs c customers at t tables."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        s[c + 1, 1 : c + 1] = s[c, 1 : c + 1] + np.log(c - discount * t)
        s[c + 1, 2 : c + 2] = np.logaddexp(s[c + 1, 2 : c + 2], s[c, 1 : c + 1])
    return s


def draw_tables(customers: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, a column a chain: ``mass`` is what a new table weighs, strength and parent taken together.

    The tables t of c customers have probability in proportion to S(c, t) *
    mass ** t, with S the generalized Stirling numbers of the discount.  Over
    ``EXACT`` customers they sit down in blocks of growing size; the weight of
    a new table then falls with the customers still to come, which the
    conditional distribution asks for, to first order.
    """
    wide = mass.ndim == 2
    mass = mass if wide else mass[:, None]
    counts = customers if customers.ndim == 2 else np.broadcast_to(customers[:, None], mass.shape)
    c, m = counts.reshape(-1), np.maximum(mass.reshape(-1), 1e-300)
    tables = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    sizes, heads = np.unique(c[order], return_index=True)
    weights = table_weights(discount)
    for size, head, stop in zip(sizes.tolist(), heads.tolist(), [*heads.tolist()[1:], len(order)]):
        if not 2 <= size <= EXACT:
            continue
        for at in range(head, stop, max(1, (1 << 20) // size)):
            own = order[at : min(stop, at + max(1, (1 << 20) // size))]
            if size == 2:
                tables[own] = 1 + (rng.random(len(own)) * (m[own] + 1 - discount) < m[own])
                continue
            logs = weights[size, 1 : size + 1] + np.arange(size) * np.log(m[own])[:, None]
            p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (p < (rng.random(len(own)) * p[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        tables[many] = _seat_blocks(c[many], m[many], discount, rng)
    tables = tables.reshape(mass.shape)
    return tables if wide else tables[:, 0]


def _seat_blocks(c: np.ndarray, m: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    tables, sat = np.ones(len(c), np.int64), 1
    while len(open_ := np.flatnonzero(c > sat)):
        block = np.minimum(max(1, sat >> 3), c[open_] - sat)
        middle = sat + (block - 1) / 2
        new = m[open_] * (middle / c[open_]) ** discount
        old = np.maximum(middle - discount * tables[open_], 1e-9)
        tables[open_] += rng.binomial(block, new / (new + old))
        sat += max(1, sat >> 3)
    return tables


@dataclass(frozen=True)
class Lexicon:
    """Words with a dish of their own (sorted keys and counts), and what the others sum up to.  The last dish is that of the rare."""

    keys: np.ndarray
    counts: np.ndarray
    rare_tokens: int
    rare_words: int

    @property
    def tokens(self) -> int:
        return int(self.counts.sum()) + self.rare_tokens

    @property
    def words(self) -> int:
        return int((self.counts > 0).sum()) + self.rare_words

    @cached_property
    def _heads(self) -> np.ndarray:
        """Where the words begin whose keys have the same highest bits."""
        return np.searchsorted(self.keys, np.arange((1 << 20) + 1, dtype=np.uint64) << _HEAD).astype(np.int32) if len(self.keys) else None

    def dishes(self, keys: np.ndarray) -> np.ndarray:
        heads, many = self._heads, len(self.keys)
        head = (keys >> _HEAD).astype(np.int64)
        at, stop = heads[head], np.where(head + 1 < len(heads) - 1, heads[head + 1], many)
        found = np.full(len(keys), many, np.int64)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            hit = self.keys[at[open_]] == keys[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return found

    def customers(self) -> np.ndarray:
        """How often each dish follows anything, and so how often its own restaurant is asked."""
        return np.append(self.counts, self.rare_tokens)


@dataclass(frozen=True)
class State:
    """Tables of every restaurant by chain, and what the root predicts for each dish."""

    strength: float
    discounts: tuple[float, float]
    by_context: np.ndarray
    root: np.ndarray

    def mass(self, contexts: np.ndarray, dishes: np.ndarray) -> np.ndarray:
        return (self.strength + self.discounts[1] * self.by_context[contexts]).astype(np.float64) * self.root[dishes]


def learn_from(id_col: str = "doc_id") -> Column:
    """Rows that the model learns from: crc32 of the id as text does not leave 2 when divided by 7."""
    return ~F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _streams(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words and ends of each text in order, and the row of each."""
    words = split_words(batch.column(column), KINDS)
    rows = np.arange(batch.num_rows)
    after = np.searchsorted(words.rows, rows, "right")
    return np.insert(words.keys, after, END), np.insert(words.rows, after, rows)


def _before(dishes: np.ndarray, end: int, rows: np.ndarray) -> np.ndarray:
    """The context of each token: the one before it in its text, the end before the first."""
    contexts = np.empty_like(dishes)
    contexts[1:] = dishes[:-1]
    contexts[np.flatnonzero(np.diff(rows, prepend=-1))] = end
    return contexts


def _pair_keys(lexicon: Lexicon, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs as one spread-out number each, dishes of the words)."""
    dishes = lexicon.dishes(keys)
    contexts = _before(dishes, int(lexicon.dishes(np.array([END]))[0]), rows)
    return (contexts.astype(np.uint64) << _SHIFT | dishes.astype(np.uint64)) * _ODD & _PAIR, dishes


def _pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = keys * _BACK & _PAIR
    return (pairs >> _SHIFT).astype(np.int64), (pairs & np.uint64((1 << DISH_BITS) - 1)).astype(np.int64)


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_words(texts: DataFrame, bits: int, most: int = WORDS) -> tuple[Lexicon, DataFrame]:
    """The lexicon of ``texts`` (one column), and all its words by bucket with their counts."""

    def of_batch(batch: pa.RecordBatch):
        yield _streams(batch, 0)[0], None

    counted = settle(count_keys(texts, of_batch, bits))

    def spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n = np.unique(np.concatenate([unplaned(x) for x in batch.column(2).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], ["c", "n"])

    # distinct counts are at most the root of twice the tokens
    steps = counted.mapInArrow(spectrum, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c")).collect()
    own, limit = 0, 0  # words counted more than ``limit`` times have dishes of their own
    for step in steps:
        own += step["n"]
        if own > most:
            limit = step["c"]
            break

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys, counts = unpack_sorted(keys), unplaned(counts)
                good = (counts > limit) | (keys == END)
                yield pa.RecordBatch.from_arrays([pa.array([keys[good].tobytes()], pa.binary()), pa.array([counts[good].tobytes()], pa.binary())], ["keys", "counts"])

    rows = counted.mapInArrow(frequent, "keys binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["keys"], np.uint64) for r in rows]])
    counts = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["counts"], np.uint64) for r in rows]]).astype(np.int64)
    if END not in keys:
        keys, counts = np.append(keys, END), np.append(counts, 0)
    order = np.argsort(keys)
    rare = sum(s["n"] * s["c"] for s in steps if s["c"] <= limit), sum(s["n"] for s in steps if s["c"] <= limit)
    end = int(counts[keys == END][0])
    if 0 < end <= limit:  # the end has a dish of its own all the same
        rare = rare[0] - end, rare[1] - 1
    return Lexicon(keys[order], counts[order], *rare), counted


def _totals(pairs: DataFrame, lexicon, state, seed: int, chains: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of pairs with several customers, summed by context and by dish after a draw, and how many pairs were counted once and twice.

    Without a state there are two columns: pairs with one customer, and those
    with more, each pair at one table.
    """
    stretch, size = 1 << 14, len(lexicon.value.keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size, chains), np.int64)
        seen = np.zeros(3, np.int64)
        for batch in batches:
            for bucket, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")]):
                keys, customers = unpack_sorted(keys), unplaned(counts).astype(np.int64)
                seen += np.bincount(np.minimum(customers, 3), minlength=4)[1:]
                own = np.flatnonzero(customers > (state is not None))
                contexts, dishes = _pairs(keys[own])
                if state is None:
                    tables = np.stack((customers[own] == 1, customers[own] > 1), 1)
                else:
                    tables = _drawn(state.value, contexts, dishes, customers[own], seed, bucket)
                for k in range(chains):
                    for which, ids in enumerate((contexts, dishes)):
                        sums[which, :, k] += np.bincount(ids, tables[:, k], size).astype(np.int64)
        for at in range(0, size, stretch):
            part = sums[:, at : at + stretch].reshape(2 * min(stretch, size - at), chains)
            if len(places := np.flatnonzero(part.any(axis=1))):
                yield _sum_row(at // stretch, places, part[places])
        yield _sum_row(-1, np.zeros(1, np.int64), seen[None])

    def add(table: pa.Table) -> pa.Table:
        rows = [(unpack_sorted(p).astype(np.int64), unplaned(v).astype(np.int64)) for p, v in zip(table.column("places").to_pylist(), table.column("sums").to_pylist())]
        wide = len(rows[0][1]) // len(rows[0][0])
        total = np.zeros((max(int(p[-1]) for p, _ in rows) + 1, wide), np.int64)
        for places, values in rows:
            total[places] += values.reshape(-1, wide)
        places = np.flatnonzero(total.any(axis=1)) if total.any() else np.zeros(1, np.int64)
        return pa.Table.from_batches([_sum_row(table.column("part")[0].as_py(), places, total[places])])

    kind = "part int, places binary, sums binary"
    sums, seen = np.zeros((2, size, chains), np.int64), np.zeros(3, np.int64)
    for row in pairs.mapInArrow(run, kind).groupBy("part").applyInArrow(add, kind).collect():
        places, values = unpack_sorted(row["places"]).astype(np.int64), unplaned(row["sums"]).astype(np.int64)
        if row["part"] < 0:
            seen = values
            continue
        at = row["part"] * stretch
        which, ids = divmod(places, min(stretch, size - at))
        sums[which, at + ids] = values.reshape(-1, chains)
    return sums[0], sums[1], seen


def _sum_row(part: int, places: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([pack_sorted(places.astype(np.uint64))], pa.binary()), pa.array([planes(sums.reshape(-1).astype(np.uint64))], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "places", "sums"])


def _drawn(state: State, contexts, dishes, customers, seed: int, bucket: int) -> np.ndarray:
    """Tables of those pairs of one bucket that have several customers; the same whenever they are drawn again with that seed."""
    return draw_tables(customers, state.mass(contexts, dishes), state.discounts[1], np.random.default_rng((seed, bucket)))


def _discount(once: int, twice: int) -> float:
    """The usual estimate from how many dishes have one and two customers."""
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)


def _seat_root(customers: np.ndarray, strength: float, discount: float, rng: np.random.Generator, rounds: int = 3) -> np.ndarray:
    """What the root predicts for each dish, by chain, after some rounds of its own seating."""
    base = 1 / len(customers)
    tables = np.minimum(customers, 1)
    for _ in range(rounds):
        new = (strength + discount * tables.sum(axis=0)) * base
        tables = draw_tables(customers, np.broadcast_to(new, customers.shape), discount, rng)
    return (customers - discount * tables + (strength + discount * tables.sum(axis=0)) * base) / (strength + customers.sum(axis=0))


@dataclass(frozen=True)
class Model:
    """What scoring needs: the buckets' pairs and rare words with the blocks that ask for them, and the last two states."""

    lexicon: Lexicon
    gathered: DataFrame
    bits: tuple[int, int]
    drawn_from: State
    state: State
    seed: int


def predictive(state: State, asked: np.ndarray, contexts: np.ndarray, dishes: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Probability of each dish after its context, averaged over the chains."""
    over = customers[:, None] - state.discounts[1] * tables + state.mass(contexts, dishes)
    return (over / (state.strength + asked[contexts])[:, None]).mean(axis=1)


#: What a block asks a bucket: its distinct pairs with their counts in texts learned from, or its rare words.
ASKED = "block bigint, bucket int, rare boolean, keys binary, counts binary"
_ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("rare", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Blocks of ``BLOCK`` bytes of text, named by the partition and their place in it, in the order in which a task reads rows."""
    name, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(2))).as_py() or 0
        if size >= BLOCK:
            yield name, held
            name, held, size = name + 1, [], 0
    if held:
        yield name, held


def _tokens_of(lexicon: Lexicon, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(pairs with 1 in the lowest bit where learned from, rare word keys, dishes, keys, rows) of the tokens of (learns, id, text) rows."""
    keys, rows = _streams(batch, 2)
    pairs, dishes = _pair_keys(lexicon, keys, rows)
    learned = batch.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.uint64)
    return pairs << np.uint64(1) | learned, keys[dishes == len(lexicon.keys)], dishes, keys, rows


def _questions(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs, their counts where learned from, distinct rare words) of a block."""
    marked = np.sort(np.concatenate([p[0] for p in parts]))
    pairs = marked >> np.uint64(1)
    heads = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
    counts = np.add.reduceat(marked & np.uint64(1), heads) if len(heads) else np.zeros(0, np.uint64)
    return pairs[heads], counts, np.unique(np.concatenate([p[1] for p in parts]))


def _rows_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(learn_from(id_col).alias("learns"), F.col(id_col).alias("id"), F.col(text).alias("text"))


def ask(rows: DataFrame, lexicon, bits: tuple[int, int]) -> DataFrame:
    """The questions of all blocks, and with them the counts of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches):
            pairs, learned, rare = _questions([_tokens_of(lexicon.value, b)[:2] for b in held])
            found = [(b, False, pack_sorted(pairs[s]), planes(learned[s])) for b, s in buckets_of(pairs, bits[0], 2 * DISH_BITS)]
            found += [(b, True, pack_sorted(rare[s]), b"") for b, s in buckets_of(rare, bits[1])]
            yield pa.RecordBatch.from_pylist([{"block": block, "bucket": b, "rare": r, "keys": k, "counts": c} for b, r, k, c in found], _ASKED)

    return rows.mapInArrow(run, ASKED)


#: Of a bucket: distinct keys (of pairs those learned from, then apart the others), counts, and by block the places of what it asks among all of them.
GATHERED = "rare boolean, bucket int, keys binary, counts binary, others binary, blocks array<bigint>, places array<binary>"


def _gather(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    asking = [r for r in rows if r["block"] is not None]
    own = [unpack_sorted(r["keys"]) for r in asking]
    rare = rows[0]["rare"]
    keys, counts, places = merged(own or [np.zeros(0, np.uint64)], [np.zeros(len(k), np.uint64) if rare else unplaned(r["counts"]) for r, k in zip(asking, own)])
    if rare:  # the words themselves came along, with their counts
        known, n, _ = merged([np.zeros(0, np.uint64), *[unpack_sorted(r["keys"]) for r in rows if r["block"] is None]], [np.zeros(0, np.uint64), *[unplaned(r["counts"]) for r in rows if r["block"] is None]])
        both, at, where = np.intersect1d(keys, known, assume_unique=True, return_indices=True)
        counts[at] = n[where]
    learned = counts > 0 if not rare else np.ones(len(keys), bool)
    packed = [pack_sorted(keys[learned]), planes(counts[learned]), pack_sorted(keys[~learned])]
    return pa.table(
        {
            "rare": table.column("rare").combine_chunks()[:1],
            "bucket": table.column("bucket").combine_chunks()[:1],
            **{name: pa.array([x], pa.binary()) for name, x in zip(("keys", "counts", "others"), packed)},
            "blocks": pa.array([[r["block"] for r in asking]], pa.list_(pa.int64())),
            "places": pa.array([[pack_sorted(x.astype(np.uint64)) for x in places[: len(asking)]]], pa.list_(pa.binary())),
        }
    )


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, chains: int = CHAINS, rounds: int = ROUNDS, strength: float = 1.0, seed: int = 11) -> Model:
    """A model of the rows that ``learn_from`` names, over all of their text; ``gathered`` holds the questions of all rows.

    Discounts come from how many pairs (and at the root, words by the contexts
    they follow) were counted once and twice; the strength is the same for all
    restaurants.  Each round draws all dishes of all chains.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    word_bits = (_parts(spark) - 1).bit_length()
    lexicon, counted = count_words(docs.where(learn_from(id_col)).select(F.col(text).alias("text")), word_bits, words)
    shared = spark.sparkContext.broadcast(lexicon)
    bits = bucket_bits(lexicon.tokens, _parts(spark)), word_bits
    told = counted.select(F.lit(None).cast("bigint").alias("block"), "bucket", F.lit(True).alias("rare"), "keys", "counts")
    asked = ask(_rows_of(docs, id_col, text), shared, bits).unionByName(told)
    gathered = settle(asked.groupBy("bucket", "rare").applyInArrow(_gather, GATHERED))
    pairs = gathered.where(~F.col("rare")).select("bucket", "keys", "counts")
    by_context, by_dish, seen = _totals(pairs, shared, None, seed, 2)
    spread = np.bincount(np.minimum(by_dish.sum(axis=1), 3), minlength=4)
    discounts = _discount(int(spread[1]), int(spread[2])), _discount(int(seen[0]), int(seen[1]))
    alone = by_context[:, :1], by_dish[:, :1]
    tables = [np.repeat(x.sum(axis=1, keepdims=True), chains, 1) for x in (by_context, by_dish)]
    states = []
    for k in range(rounds + 1):
        root = _seat_root(tables[1], strength, discounts[0], np.random.default_rng((seed, k, 1 << 40)))
        states = [*states[-1:], State(strength, discounts, tables[0].astype(np.float32), root.astype(np.float32))]
        if k < rounds:
            sent = spark.sparkContext.broadcast(states[-1])
            *several, _ = _totals(pairs, shared, sent, seed + k, chains)
            sent.destroy()
            tables = [x + y for x, y in zip(alone, several)]
    return Model(lexicon, gathered, bits, states[0], states[-1], seed + rounds - 1)


def answers(model: Model) -> DataFrame:
    """(block, bucket, rare, check, values): for what a block asks of a bucket, in order, its probabilities or the counts of its rare words."""
    spark = model.gathered.sparkSession
    before, after = spark.sparkContext.broadcast(model.drawn_from), spark.sparkContext.broadcast((model.state, model.lexicon.customers()))
    seed = model.seed

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            learned, customers, others = unpack_sorted(row["keys"]), unplaned(row["counts"]).astype(np.int64), unpack_sorted(row["others"])
            keys, values = np.concatenate((learned, others)), customers.astype(np.uint64)
            if not row["rare"]:
                contexts, dishes = _pairs(keys)
                tables = np.zeros((len(keys), after.value[0].root.shape[1]), np.int64)
                tables[: len(learned)] = 1
                several = np.flatnonzero(customers > 1)
                tables[several] = _drawn(before.value, contexts[several], dishes[several], customers[several], seed, row["bucket"])
                customers = np.append(customers, np.zeros(len(others), np.int64))
                logs = np.log10(predictive(*after.value, contexts, dishes, customers, tables))
                values = np.rint(-logs / _STEP).astype(np.uint64)
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
            out = []
            for block, places in zip(row["blocks"], row["places"]):
                own = unpack_sorted(places).astype(np.int64)
                out.append({"block": block, "bucket": row["bucket"], "rare": row["rare"], "check": _check(keys[own]), "values": planes(values[own])})
            if out:
                yield pa.RecordBatch.from_pylist(out, _ANSWERED)

    return model.gathered.mapInArrow(reply, "block bigint, bucket int, rare boolean, check bigint, values binary")


_ANSWERED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("rare", pa.bool_()), ("check", pa.int64()), ("values", pa.binary())])


def _check(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mixed(keys)).astype(np.int64)) if len(keys) else 0


def _pack_texts(rows: DataFrame) -> DataFrame:
    """(block, texts): the blocks of texts again, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in held:
                    out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "texts"])

    return rows.mapInArrow(run, "block bigint, texts binary")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``score`` is the model's log10 probability of the text, of its words and
    its end; ``perplexity`` is that by token.  ``base_score`` adds one to each
    token's count.  Words are runs of characters that show, A-Z lower-cased;
    null and empty texts have an end alone.  Null ids are learned from.
    Repeated rows count and are scored each time.  An empty table gives no
    rows; where nothing is learned from, all words are alike.  Words are
    compared by a 64-bit key.  ``docs`` is read three times, and must give the
    same rows in the same order each time (files and checkpoints do).
    """
    spark = docs.sparkSession
    model = train(docs, id_col, text, **how)
    shared, bits = spark.sparkContext.broadcast(model.lexicon), model.bits
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(block: pa.Table, replies: pa.Table) -> pa.Table:
        lexicon: Lexicon = shared.value
        batches = list(pa.ipc.open_stream(block.column("texts")[0].as_py()))
        parts = [_tokens_of(lexicon, b) for b in batches]
        keys, _, rare = _questions(parts)
        by = {(r["rare"], r["bucket"]): r for r in replies.to_pylist()}
        asked = {False: (keys, np.zeros(len(keys), np.uint64), bits[0], 2 * DISH_BITS), True: (rare, np.zeros(len(rare), np.uint64), bits[1], 64)}
        for is_rare, (own_keys, said, own_bits, wide) in asked.items():
            for bucket, own in buckets_of(own_keys, own_bits, wide):
                reply = by.get((is_rare, bucket))
                if reply is None or reply["check"] != _check(own_keys[own]):
                    raise RuntimeError("documents came in another order when they were read again: settle them first")
                said[own] = unplaned(reply["values"])
        logs, counts = asked[False][1] * -_STEP, asked[True][1].astype(np.int64)
        tokens, words = lexicon.tokens, lexicon.words
        under, rare_under = math.log10(tokens + words + 1), math.log10(lexicon.rare_tokens + lexicon.rare_words + 1)
        found = []
        for batch, (marked, _, dishes, own_keys, rows) in zip(batches, parts):
            is_rare = dishes == len(lexicon.keys)
            c = np.append(lexicon.counts, 0)[dishes]
            c[is_rare] = counts[np.searchsorted(rare, own_keys[is_rare])]
            score = logs[np.searchsorted(keys, marked >> np.uint64(1))]
            score[is_rare] += np.log10(c[is_rare] + 1) - rare_under
            add = lambda x: np.bincount(rows, x, batch.num_rows)
            columns = [batch.column("id"), pc.invert(batch.column("learns")), add(None), add(c > 0).astype(np.int64), np.full(batch.num_rows, tokens), add(np.log10(c + 1.0) - under), add(score)]
            found.append(pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names))
        return pa.Table.from_batches(found)

    blocks = _pack_texts(_rows_of(docs, id_col, text)).groupBy("block")
    scored = blocks.cogroup(answers(model).groupBy("block")).applyInArrow(score, out)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
