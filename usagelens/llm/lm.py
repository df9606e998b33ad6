"""Language-model scoring by a probabilistic suffix tree, beside a unigram base.

A text's tokens are its words and one end. The tree predicts the bytes of the words, each word
followed by a blank, the last by the end mark; its contexts are the up to DEPTH bytes before,
never reaching over the start of the text. Counts of all (context, next) pairs come from every
training text, pre-aggregated in each slice, and are summed level by level. A context stays in the tree if it was seen
LEAST_COUNT times and its next bytes diverge from what its suffix predicts by LEAST_GAIN in all
(count times Kullback-Leibler divergence, in nats: what its own distribution gains over its occurrences);
suffixes and prefixes of kept contexts stay too, so that the state after each byte, the longest kept suffix, follows
from the state before. Distributions are smoothed towards the suffix's. Both bounds are absolute: what is kept
grows with the corpus, and a context once good enough stays so as texts are added.

Divergence tests and closure are Spark joins and groupings of the levels; the tree is a table. Its automaton is sent
to the tasks in shards of about STATES_PER_PASS states: a shard has the contexts that end in some of the bytes (and
their prefixes), predicts what follows these bytes, and the shards' sums add up to a text's score. A corpus whose tree fits one
shard is scored in one pass, a larger tree takes more passes over the texts, never a larger shard.

The base needs each word's count. Words with at least a 1 / HOT_WORDS share of all tokens, of
which there are HOT_WORDS at most, are sent to the tasks; the others are joined.

Odd input: null, empty or wordless text: one token, the end. Null doc_id: scored, held out, never
learned from. Repeated rows: each scored, each counted. No training text: the base is 0 for every
token, the tree uniform. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sent, discard, stored
from .textops import WordHasher, slices

DEPTH = 5
LEAST_COUNT = 300
LEAST_GAIN = 20.0
#: States that are sent to the tasks at once; each has a cell of 8 bytes for each byte that occurs.
STATES_PER_PASS = 120_000
#: Weight of the suffix's distribution in a context's, in observations.
SMOOTHING = 20.0
HOT_WORDS = 1_000_000
END = 10  # newline: no word holds it
#: Hash under which the end is counted among the words.
END_WORD = np.uint64(0x656E64)
BLOCK = 1 << 20
#: Bytes of text that a task works on at once.
SLICE_BYTES = 4 << 20
LANES = 2048


def _stream(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the texts, each closed by END, after one END; n+1 offsets of the texts in them)."""
    parts = [b" ".join(t.as_py().encode().lower().split()) if t.is_valid else b"" for t in texts]
    off = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return np.frombuffer(b"\n" + b"".join(p + b"\n" for p in parts), np.uint8), off


def _codes(x: np.ndarray) -> np.ndarray:
    """For each byte from the DEPTH-th on: itself and the DEPTH bytes before, zero before the text's start."""
    n = len(x) - DEPTH
    code = x[DEPTH:].astype(np.int64)
    inside = np.ones(n, bool)
    for lag in range(1, DEPTH + 1):
        before = x[DEPTH - lag : DEPTH - lag + n]
        code |= np.where(inside, before, 0).astype(np.int64) << (8 * lag)
        inside &= before != END
    return code


def _counts(batches):
    """Training texts to (kind, key, n): kind 0 for words, 1 for (context, next) codes; summed in each batch."""
    hasher = WordHasher()
    for batch in slices(batches, SLICE_BYTES):
        texts = batch.column("text")
        _, words = hasher.words(texts)
        key, n = np.unique(words, return_counts=True)
        kinds, keys, ns = [np.zeros(len(key) + 1, np.int8)], [np.r_[key, END_WORD].view(np.int64)], [np.r_[n, len(texts)]]
        x, _ = _stream(texts)
        x = np.r_[np.zeros(DEPTH - 1, np.uint8), x]
        some, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(x) - DEPTH, BLOCK):
            code, n = np.unique(_codes(x[at : at + BLOCK + DEPTH]), return_counts=True)
            some.append(code)
            times.append(n)
        some, times = np.concatenate(some), np.concatenate(times)
        code, spot = np.unique(some, return_inverse=True)
        kinds.append(np.ones(len(code), np.int8))
        keys.append(code)
        ns.append(np.bincount(spot, times, len(code)).astype(np.int64))
        yield pa.RecordBatch.from_pydict({"kind": np.concatenate(kinds), "key": np.concatenate(keys), "n": np.concatenate(ns)})


@dataclass
class SuffixTree:
    """The automaton of some kept contexts: for state * width + class, the next state (times width) and log10 probability.

    ``levels`` has the contexts of each length in order, as states are numbered; ``after`` says for each byte whether this automaton
    predicts what follows it."""

    classes: np.ndarray
    width: int
    following: np.ndarray
    log10: np.ndarray
    levels: list[np.ndarray]
    after: np.ndarray

    @property
    def contexts(self) -> dict[tuple[int, int], int]:
        """(length, context) to state."""
        first = np.cumsum([0, *map(len, self.levels)])
        return {(d, c): int(first[d]) + i for d, level in enumerate(self.levels) for i, c in enumerate(level.tolist())}


def build_automaton(root: dict[int, int], depth: np.ndarray, key: np.ndarray, n: np.ndarray, after: np.ndarray) -> SuffixTree:
    """From the root's counts of bytes and rows (``depth`` of a kept context, ``key`` = context << 8 | next, n); the contexts
    are closed under suffixes and prefixes."""
    total = sum(root.values())
    seen = np.array(sorted(root), np.int64)
    classes = np.zeros(256, np.int64)  # class 0: bytes that training never saw
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    first = np.full(width, 0.5)
    first[1:] += [root[b] for b in seen.tolist()]
    levels, p, follow, offset = [np.zeros(1, np.int64)], [(first / (total + 128))[None]], [np.zeros((1, width), np.int32)], [0]
    for d in range(1, DEPTH + 1):
        rows = depth == d
        context, next_, times = key[rows] >> 8, key[rows] & 255, n[rows].astype(np.float64)
        level, spot = np.unique(context, return_inverse=True)
        suffix = np.searchsorted(levels[d - 1], level & ((1 << 8 * (d - 1)) - 1))
        own = SMOOTHING * p[d - 1][suffix]
        np.add.at(own, (spot, classes[next_]), times)
        own /= (np.bincount(spot, times, len(level)) + SMOOTHING)[:, None]
        offset.append(offset[-1] + len(levels[-1]))
        # from its prefix a context's last byte leads here
        prefix = np.searchsorted(levels[d - 1], level >> 8)
        follow[d - 1][prefix, classes[level & 255]] = ((offset[d] + np.arange(len(level))) * width).astype(np.int32)
        levels.append(level)
        p.append(own)
        follow.append(follow[d - 1][suffix])
    log10 = np.concatenate([np.log10(x).astype(np.float32) for x in p])
    return SuffixTree(classes, width, np.concatenate(follow).ravel(), log10.ravel(), levels, after)


def score_stream(tree: SuffixTree, x: np.ndarray) -> np.ndarray:
    """log10 probability of each byte but the first, zero after bytes that the tree leaves to others. Blocks are cut into lanes that
    advance together; a lane first reads the DEPTH bytes before it, which determine its state."""
    out = np.zeros(len(x), np.float32)
    symbols = np.r_[np.full(DEPTH, tree.classes[END]), tree.classes[x]].astype(np.int32)
    for at in range(0, len(x), BLOCK):
        n = min(BLOCK, len(x) - at)
        lanes = min(LANES, max(1, n // 64))
        width = -(-n // lanes)
        part = symbols[at : at + n + DEPTH]
        part = np.r_[part, np.zeros(lanes * width - n, np.int32)]
        table = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, width + DEPTH)[::width][:lanes].T)
        gain = np.empty((width, lanes), np.float32)
        state = np.zeros(lanes, np.int32)
        for step in range(width + DEPTH):
            spot = state + table[step]
            if step >= DEPTH:
                gain[step - DEPTH] = tree.log10[spot]
            state = tree.following[spot]
        out[at : at + n] = gain.T.ravel()[:n]
    if not tree.after.all():
        out[1:] *= tree.after[x[:-1]]
    return out


def _parts(tree_sent, batches):
    """(row_key, text) to the score that this shard of the tree gives."""
    tree = tree_sent.value
    for batch in slices(batches, SLICE_BYTES):
        x, at = _stream(batch.column("text"))
        points = np.r_[0.0, np.cumsum(score_stream(tree, x), dtype=np.float64)]
        yield pa.RecordBatch.from_pydict({"row_key": batch.column("row_key"), "part": np.diff(points[at])})


_SCORED = "row long, row_key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail binary"


def _score(tree_sent, hot_sent, batches):
    tree, (hot_words, hot_counts) = tree_sent.value, hot_sent.value
    hasher, row = WordHasher(), TaskContext.get().partitionId() << 33
    hot_log = np.log10(hot_counts + 0.1)
    for batch in slices(batches, SLICE_BYTES // 2):
        texts = batch.column("text")
        n = batch.num_rows
        off, words = hasher.words(texts)
        word, spot = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(hot_words, word), max(0, len(hot_words) - 1))
        hot = hot_words[at] == word if len(hot_words) else np.zeros(len(word), bool)
        gain = np.where(hot, hot_log[at], 0.0) if len(hot_words) else np.zeros(len(word))
        is_hot = hot[spot]
        sums = np.r_[0.0, np.cumsum(gain[spot])]
        hots = np.r_[0, np.cumsum(is_hot)]
        tails, tail_off = words[~is_hot], off - hots[off]
        x, at = _stream(texts)
        points = np.r_[0.0, np.cumsum(score_stream(tree, x), dtype=np.float64)]
        yield pa.RecordBatch.from_pydict(
            {
                "row": np.arange(row, row + n),
                "row_key": batch.column("row_key"),
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "n_tokens": np.diff(off) + 1,
                "n_known": np.diff(hots[off]),
                "base": np.diff(sums[off]),
                "score": np.diff(points[at]),
                "tail": pa.array([tails[a:b].tobytes() for a, b in zip(tail_off[:-1], tail_off[1:], strict=True)], pa.binary()),
            }
        )
        row += n


def _tail_words(batches):
    for batch in batches:
        blobs = batch.column("tail").to_pylist()
        size = np.array([len(b) // 8 for b in blobs], np.int64)
        yield pa.RecordBatch.from_pydict({"row": np.repeat(batch.column("row").to_numpy(), size), "key": np.frombuffer(b"".join(blobs), np.int64)})


def _low(column, n_bytes: int):
    return F.col(column).bitwiseAND(F.lit((1 << 8 * n_bytes) - 1).cast("long"))


def _tree_table(codes: DataFrame, root: dict[int, int]) -> DataFrame:
    """(depth, key, n) of the kept contexts, from the counts (key, n) of the deepest level; key is context << 8 | next."""
    spark = codes.sparkSession
    total = sum(root.values())
    pairs = {DEPTH: codes}
    for d in range(DEPTH - 1, 0, -1):
        summed = pairs[d + 1].groupBy(_low("key", d + 1).alias("key")).agg(F.sum("n").alias("n"))
        pairs[d] = stored(summed, "lm-pairs")
    shares = [(b, (n + 0.5) / (total + 128)) for b, n in root.items()]
    above = spark.createDataFrame([(0, b, p) for b, p in shares], "context long, next long, p double")
    tested, done = {}, [pairs[d] for d in range(1, DEPTH)]
    for d in range(1, DEPTH + 1):
        rows = pairs[d].select(F.shiftright("key", 8).alias("context"), _low("key", 1).alias("next"), "n")
        # bytes of zero stand before a text's start: such a context would reach over it
        often = rows.groupBy("context").agg(F.sum("n").alias("all")).where((F.col("all") >= LEAST_COUNT) & (F.shiftright("context", 8 * (d - 1)) > 0))
        rows = rows.join(often, "context").withColumn("suffix", _low("context", d - 1))
        suffix = above.select(F.col("context").alias("suffix"), "next", F.col("p").alias("q"))
        rows = rows.join(suffix, ["suffix", "next"]).withColumn("p", (F.col("n") + SMOOTHING * F.col("q")) / (F.col("all") + SMOOTHING))
        above = stored(rows.select("context", "next", "n", "all", "q", "p"), "lm-level")
        done.append(above)
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("q")))
        tested[d] = above.groupBy("context").agg(gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN).select("context")
        pairs[d] = above.select("context", "next", "n")
    kept, tree = None, None
    for d in range(DEPTH, 0, -1):
        here = tested[d]
        if kept is not None:  # what the kept longer ones need
            here = here.unionByName(kept.select(_low("context", d).alias("context"))).unionByName(kept.select(F.shiftright("context", 8).alias("context")))
        kept = stored(here.distinct(), "lm-kept")
        done.append(kept)
        part = pairs[d].join(kept, "context").select(F.lit(d).alias("depth"), (F.shiftleft("context", 8) + F.col("next")).alias("key"), "n")
        tree = part if tree is None else tree.unionByName(part)
    tree = stored(tree, "lm-tree")
    discard(*done)
    return tree


def _shards(tree: DataFrame, root: dict[int, int]):
    """The automata of the tree, one after the other; each has the contexts that end in some bytes, and what leads to them."""
    contexts = tree.select("depth", F.shiftright("key", 8).alias("context")).distinct()
    sizes = contexts.groupBy(_low("context", 1).alias("last")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "last").collect()  # 256 rows at most
    groups: list[list[int]] = []
    room: list[int] = []
    for r in sizes:
        k = next((i for i, x in enumerate(room) if x >= r.n), None)
        if k is None:
            k = len(groups)
            groups.append([])
            room.append(STATES_PER_PASS)
        groups[k].append(r["last"])
        room[k] -= r.n
    groups = groups or [[]]
    for k, group in enumerate(groups):
        rows = tree
        if len(groups) > 1:
            mine = contexts.where(_low("context", 1).isin(group))
            # all substrings: prefixes, and suffixes of these
            sub = F.expr(
                f"explode(flatten(transform(sequence(1, depth), l -> transform(sequence(0, depth - l), a -> "
                f"named_struct('depth', l, 'context', shiftright(context, 8 * a) & (shiftleft(1L, 8 * l) - 1))))))"
            )
            need = mine.select(sub.alias("s")).select("s.depth", "s.context").distinct()
            rows = tree.withColumn("context", F.shiftright("key", 8)).join(need, ["depth", "context"]).select("depth", "key", "n")
        found = rows.toArrow()
        after = np.zeros(256, bool)
        after[group] = True
        if k == 0:  # and after bytes that end no context
            after |= ~np.isin(np.arange(256), [b for g in groups for b in g])
        yield build_automaton(root, *(found.column(c).to_numpy().astype(np.int64) for c in ("depth", "key", "n")), after)


def fit(training: DataFrame) -> tuple[DataFrame, dict[int, int], DataFrame]:
    """(tree table, counts of the bytes, word counts (key, n)) of the texts."""
    counts = training.select("text").mapInArrow(_counts, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = stored(counts, "lm-counts")
    words = counts.where("kind = 0").select("key", "n")
    codes = counts.where("kind = 1").select("key", "n")
    root = {r["next"]: r.n for r in codes.groupBy(_low("key", 1).alias("next")).agg(F.sum("n").alias("n")).collect()}  # 256 rows at most
    return _tree_table(codes, root), root, words


def score_documents(docs: DataFrame, held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``held_out`` is a boolean column of rows that aren't learned from; by default those whose
    crc32(doc_id as text) is divisible by 10.
    """
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out")
    ).withColumn("row_key", F.xxhash64("doc_id", "text"))
    tree, root, words = fit(rows.where(~F.col("held_out")))
    n_all, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end_count = words.where(F.col("key") == int(END_WORD)).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    hot = words.where((F.col("n") >= n_all / HOT_WORDS) & (F.col("n") > 1)).toArrow()
    key = hot.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    context = spark.sparkContext
    hot_sent = context.broadcast((key[order], hot.column("n").to_numpy().astype(np.float64)[order]))
    scored = more = None
    for automaton in _shards(tree, root):
        sent = Sent(spark, automaton)
        if scored is None:
            scored = stored(rows.mapInArrow(lambda batches, sent=sent: _score(sent, hot_sent, batches), _SCORED), "lm-scored")
        else:  # rows that repeat id and text have the same score
            part = rows.select("row_key", "text").mapInArrow(lambda batches, sent=sent: _parts(sent, batches), "row_key long, part double")
            part = stored(part.groupBy("row_key").agg(F.max("part").alias("part")), "lm-part")
            more = part if more is None else more.unionByName(part)
        sent.unpersist()
    tails = scored.select("row", "tail").mapInArrow(_tail_words, "row long, key long")
    tails = tails.join(words, "key", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail_base"), F.count("n").alias("tail_known")
    )
    share = F.lit(float(np.log10(n_all + 0.1 * (n_distinct + 1))))
    end = F.lit(float(np.log10(end_count + 0.1)))
    scored = scored.join(tails, "row", "left")
    if more is not None:
        more = more.groupBy("row_key").agg(F.sum("part").alias("part"))
        scored = scored.join(more, "row_key", "left").withColumn("score", F.col("score") + F.coalesce("part", F.lit(0.0)))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(end_count > 0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) + end - F.col("n_tokens") * share).alias("base_score"),
        "score",
    )
