"""Hashed maximum-entropy language model with a class-factored softmax.

``p(word | history) = p(class | history) * p(word | class)``.

* **Counts.** Every training word is counted exactly. Texts become batches
  of word numbers with a local vocabulary; only (batch, distinct word) rows
  are shuffled, to sum the counts and to bring them back to the batches.
* **Classes.** The ``TOP`` commonest words and the end of a text are classes
  of their own. Words seen once share a class with all unseen words. The rest
  go by the documents they live in: each text is marked by its commonest
  word, and words of the same marks share a class.
* **Features** of a history, hashed into ``BUCKETS`` rows each: the previous
  word, the two previous words, and, as a skip feature, the word before the
  previous one. The class softmax adds their weights and a class bias.
* **Training.** ``ROUNDS`` synchronous rounds over disjoint parts of all
  training batches: each task follows AdaGrad steps from the broadcast
  weights, the tasks' changes are averaged, and the mean is the next weights.
  Every training word makes one gradient step.
  Sums of the changes are exact (8-bit mantissas in doubles), so their order
  doesn't matter: runs that read the input in the same parts agree.
* **Scoring** looks the sparse features of a batch up in numpy.

``p(word | class)`` is the word's share of its class; in the class of rare
words, half belongs to unseen words and half to the words seen once. The
probabilities of all training words and of one unseen word add up to 1.

Defined cases: null text is empty and holds only the end; repeated rows are
scored each; a null id is trained on; without training words all
probabilities are uniform over the classes. Long texts are cut into pieces
that carry their history. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, WordHasher, mix64, nullable, rows_at_once, whole, words

BATCH = 1_000_000            # words in a batch
ASKED = 24_000_000           # bytes of text per bucket of words, about 400,000 words of local vocabularies
PART = 32_000_000            # bytes of text per file of batches
MARKS = 64                   # hash buckets of the texts' commonest words
TOP, TOPICS = 12, 10         # classes: commonest words, words by mark
END, RARE = TOP, TOP + 1
CLASSES = TOP + 2 + TOPICS
BUCKETS, KINDS = 1 << 14, 3  # rows of weights per kind of feature
ROUNDS, STEP, RATE = 4, 8192, 0.1
SLICES, SALTS = 8, 8
END_WORD, START = b"\n", np.uint64(0x5851F42D4C957F2D)


@dataclass
class Model:
    weights: np.ndarray   # KINDS*BUCKETS x CLASSES
    bias: np.ndarray
    class_words: np.ndarray   # training words per class
    top: np.ndarray           # keys of the commonest words, sorted, and their classes
    top_class: np.ndarray
    topic: np.ndarray         # class of each mark
    singles: int
    n: int
    v: int


# ---------------------------------------------------------------- blobs

def _pack_ids(ids: np.ndarray) -> bytes:
    """int32 numbers as compressed byte planes: the high bytes are nearly all zero."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_ids(blob: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    return np.frombuffer(ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T.copy().view(np.int32)[:, 0]


def _pack_change(x: np.ndarray) -> bytes:
    """float32 changes cut to their upper 16 bits (8 bits of precision, the full range)."""
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress((x.astype(np.float32).view(np.uint32) >> 16).astype(np.uint16).tobytes())


def _unpack_change(blob: bytes) -> np.ndarray:
    from zstandard import ZstdDecompressor

    half = np.frombuffer(ZstdDecompressor().decompress(blob), np.uint16)
    return (half.astype(np.uint32) << 16).view(np.float32)


# ---------------------------------------------------------------- batches

_BATCH = ("batch long, ids binary, keys binary, counts binary, marks binary, doc_ids binary, "
          "held binary, uids binary, lens binary, before binary")


def encode(docs: DataFrame, held: Column) -> DataFrame:
    """Texts as batches of numbers of a local vocabulary (keys: 64-bit word hashes)."""
    def pack(pieces: list, number: int) -> pd.DataFrame:
        h = np.concatenate([p[0] for p in pieces])
        lens = np.array([len(p[0]) for p in pieces], np.int32)
        keys, ids = np.unique(h, return_inverse=True)
        ids = ids.astype(np.int32)
        is_held = np.array([p[2] for p in pieces])
        ends = np.cumsum(lens)
        marks = np.empty(len(pieces), np.int64)
        for i, e in enumerate(ends):
            u, c = np.unique(ids[e - lens[i] : e], return_counts=True)
            marks[i] = keys[u[c.argmax()]] % np.uint64(MARKS)
        learn = ~np.repeat(is_held, lens)
        pair, many = np.unique(ids[learn].astype(np.int64) * MARKS + np.repeat(marks, lens)[learn],
                               return_counts=True)
        word, mark = pair // MARKS, pair % MARKS
        order = np.argsort(many, kind="stable")
        best = np.zeros(len(keys), np.uint8)
        best[word[order]] = mark[order]  # the commonest mark is written last
        counts = np.bincount(word, many, len(keys)).astype(np.int32)
        return pd.DataFrame([{
            "batch": number, "ids": _pack_ids(ids), "keys": keys.tobytes(),
            "counts": counts.tobytes(), "marks": best.tobytes(),
            "doc_ids": np.array([p[1] for p in pieces], np.int64).tobytes(),
            "held": is_held.astype(np.uint8).tobytes(),
            "uids": np.array([p[3] for p in pieces], np.int64).tobytes(), "lens": lens.tobytes(),
            "before": np.array([p[4] for p in pieces], np.uint64).tobytes()}])

    def run(frames: Iterator[pd.DataFrame]):
        # numbers by place in the input: unique, and the same in every run that reads the input in the same parts
        hasher, pieces, total, first, row = WordHasher(), [], 0, TaskContext.get().partitionId() << 31, 0
        number = first
        for pdf in frames:
            for t, i, out in zip(pdf["text"], pdf["doc_id"], pdf["held"].to_numpy(bool)):
                h = hasher([*words(t), END_WORD])
                row += 1
                for at in range(0, len(h), BATCH):
                    before = (h[at - 1] if at > 0 else START, h[at - 2] if at > 1 else START)
                    pieces.append((h[at : at + BATCH], i, out, first + row, before))
                    total += len(pieces[-1][0])
                    if total >= BATCH:
                        yield pack(pieces, number)
                        pieces, total, number = [], 0, number + 1
        if pieces:
            yield pack(pieces, number)

    return docs.select(whole("doc_id"), "text", held.alias("held")).mapInPandas(run, _BATCH)


def _ask(batches: DataFrame, buckets: int) -> DataFrame:
    """Local vocabularies in slices by key range: sorted keys, so a bucket is a run of them."""
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                key = np.frombuffer(r.keys, np.uint64)
                cut = np.searchsorted(((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32),
                                      np.arange(buckets + 1, dtype=np.uint64))
                yield pd.DataFrame([(i, r.batch, r.keys[8 * x : 8 * y], r.counts[4 * x : 4 * y], r.marks[x:y])
                                    for i, (x, y) in enumerate(zip(cut, cut[1:])) if x < y],
                                   columns=["bucket", "batch", "keys", "counts", "marks"])

    return batches.select("batch", "keys", "counts", "marks").mapInPandas(
        run, "bucket int, batch long, keys binary, counts binary, marks binary")


def _summary(keys, totals, marks) -> np.ndarray:
    """Sums by mark of words seen twice or more, words seen once, all, the end's, and the commonest words."""
    end = keys == WordHasher()([END_WORD])[0]
    often = (totals > 1) & ~end
    top = np.lexsort((keys[often], -totals[often]))[:TOP]
    fill = lambda x: np.r_[x, np.zeros(TOP - len(x), x.dtype)]
    return np.concatenate([
        np.bincount(marks[often], totals[often], MARKS).astype(np.int64),
        np.bincount(marks[often], minlength=MARKS), [((totals == 1) & ~end).sum(), totals.sum(),
                                                      (totals > 0).sum(), totals[end].sum()],
        fill(keys[often][top]).view(np.int64), fill(totals[often][top]), fill(marks[often][top].astype(np.int64))])


def _merge(rows) -> np.ndarray:
    """One summary of several."""
    x = np.stack([np.frombuffer(r, np.int64) for r in rows])
    head = 2 * MARKS + 4
    keys, totals, marks = (x[:, head + i * TOP : head + (i + 1) * TOP].reshape(-1) for i in range(3))
    best = np.lexsort((keys.view(np.uint64), -totals))[:TOP]
    return np.concatenate([x[:, :head].sum(0), keys[best], totals[best], marks[best]])


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: total and mark of every word asked for, in the order asked, and a summary."""
    key, at = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]]), return_inverse=True)
    count = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["counts"]]).astype(np.int64)
    mark = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["marks"]])
    totals = np.bincount(at, count, len(key)).astype(np.int64)
    order = np.lexsort((mark, count))
    best = np.zeros(len(key), np.uint8)
    best[at[order]] = mark[order]
    ends = np.cumsum([len(x) // 8 for x in pdf["keys"]])
    rows = [(int(pdf["bucket"].iloc[0]), totals[at[e - len(k) // 8 : e]].tobytes(), best[at[e - len(k) // 8 : e]].tobytes())
            for k, e in zip(pdf["keys"], ends)]
    rows.append((0, _summary(key, totals, best).tobytes(), b""))
    out = pd.DataFrame(rows, columns=["bucket", "totals", "gmarks"])
    out.insert(0, "batch", pd.array([*pdf["batch"], None], "Int64"))
    return out


def _coded(batches: DataFrame, scratch: Scratch, buckets: int, parts: int = 12):
    """Batches with the total count and the mark of each local word; the summary of all words."""
    kind = "batch long, bucket int, totals binary, gmarks binary"
    answers = scratch.write(_ask(batches, buckets).groupBy("bucket").applyInPandas(_answer, kind), "answers")

    def merge(frames):
        held = [r for pdf in frames for r in pdf["totals"]]
        if held:
            yield pd.DataFrame({"totals": [_merge(held).tobytes()]})

    got = (answers.where("batch is null").select("totals").repartition(8)
           .mapInPandas(merge, "totals binary").collect())
    summary = _merge([r[0] for r in got]) if got else None
    back = answers.where("batch is not null").groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "totals", "gmarks"))).alias("a"))
    # the same rows in the same order in every file of every run: the steps of training follow them
    coded = scratch.write(batches.drop("counts", "marks").repartition(parts, "batch").join(
        back.select("batch", F.col("a.totals").alias("totals"), F.col("a.gmarks").alias("marks"))
        .repartition(parts, "batch"), "batch").sortWithinPartitions("batch"), "coded")
    return coded, summary


# ---------------------------------------------------------------- model

def _features(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of weights for every word of a batch (KINDS x words), its local numbers and piece numbers."""
    ids, lens = _unpack_ids(r.ids), np.frombuffer(r.lens, np.int32)
    keys, before = np.frombuffer(r.keys, np.uint64), np.frombuffer(r.before, np.uint64).reshape(-1, 2)
    h = keys[ids]
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    one = np.r_[START, h[:-1]]
    two = np.r_[START, one[:-1]]
    one[starts] = before[:, 0]
    two[starts] = before[:, 1]
    second = starts[lens > 1] + 1
    two[second] = before[lens > 1, 0]
    b = np.uint64(BUCKETS - 1)
    rows = np.stack([mix64(one) & b, mix64(two + np.uint64(1)) & b,
                     mix64(one * np.uint64(3) + two * np.uint64(0x9E3779B97F4A7C15)) & b]).astype(np.uint16)
    return rows, ids, np.repeat(np.arange(len(lens)), lens)


def _class_probs(weights, bias, rows) -> np.ndarray:
    z = np.take(weights, rows[0], axis=0)
    for k in range(1, KINDS):
        z += np.take(weights, rows[k].astype(np.int32) + k * BUCKETS, axis=0)
    z += bias
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _steps(weights, grads, bias, rows, y) -> None:
    """AdaGrad over one batch, in place."""
    for i in range(0, len(y), STEP):
        r, t = rows[:, i : i + STEP], y[i : i + STEP]
        p = _class_probs(weights, bias, r)
        p[np.arange(len(t)), t] -= 1
        for k in range(KINDS):
            order = np.argsort(r[k], kind="stable")
            s = r[k][order]
            first = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1]
            g = np.add.reduceat(p[order], first, axis=0)
            at = s[first].astype(np.int64) + k * BUCKETS
            a = grads[at] + g * g
            grads[at] = a
            weights[at] -= RATE * g / np.sqrt(a)


def _classes(model: Model, r) -> tuple[np.ndarray, np.ndarray]:
    """Total count and class of each local word of a batch."""
    keys = np.frombuffer(r.keys, np.uint64)
    totals = np.concatenate([np.frombuffer(x, np.int64) for x in r.totals])
    cls = model.topic[np.concatenate([np.frombuffer(x, np.uint8) for x in r.marks])]
    cls[totals < 2] = RARE
    if len(model.top):
        at = np.minimum(np.searchsorted(model.top, keys), len(model.top) - 1)
        known = model.top[at] == keys
        cls[known] = model.top_class[at[known]]
    cls[(keys == WordHasher()([END_WORD])[0]) & (totals > 0)] = END
    return totals, cls


def _plan(summary: np.ndarray | None) -> Model:
    """Classes and their sizes from the summary of all training words."""
    head = 2 * MARKS + 4
    x = np.zeros(head + 3 * TOP, np.int64) if summary is None else summary
    mass, kinds, (singles, n, v, ends) = x[:MARKS].copy(), x[MARKS : 2 * MARKS], x[2 * MARKS : head]
    keys, totals, marks = (x[head + i * TOP : head + (i + 1) * TOP] for i in range(3))
    real = totals > 0
    np.subtract.at(mass, marks[real], totals[real])
    topic = np.full(MARKS, CLASSES - 1)
    order = np.argsort(-mass, kind="stable")[: TOPICS - 1]
    topic[order] = RARE + 1 + np.arange(len(order))
    class_words = np.bincount(topic, mass, CLASSES).astype(np.int64)
    class_words[:TOP], class_words[END], class_words[RARE] = totals, ends, singles
    by_key = np.argsort(keys[real].view(np.uint64))
    return Model(np.zeros((KINDS * BUCKETS, CLASSES), np.float32), np.zeros(CLASSES, np.float32), class_words,
                 keys[real].view(np.uint64)[by_key], np.flatnonzero(real)[by_key], topic, int(singles), int(n), int(v))


def fit(coded: DataFrame, summary: np.ndarray | None) -> Model:
    spark = coded.sparkSession
    model = _plan(summary)
    class_words, n = model.class_words, model.n
    bias = np.log((class_words + 0.5) / (n + 0.5 * CLASSES)).astype(np.float32)
    weights = model.weights
    grads = np.full_like(weights, 0.1)
    part = F.pmod(F.xxhash64("batch"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, grads, bias, model))  # 2 * KINDS*BUCKETS*CLASSES floats: 9 MB

        def learn(frames, shared=shared):
            w0, g0, b, m = shared.value
            w, g, seen = w0.copy(), g0.copy(), 0
            for pdf in frames:
                for r in pdf.itertuples():
                    rows, ids, piece = _features(r)
                    use = np.frombuffer(r.held, np.uint8)[piece] == 0
                    y = _classes(m, r)[1][ids]
                    seen += int(use.sum())
                    _steps(w, g, b, np.ascontiguousarray(rows[:, use]), y[use])
            if seen:
                both = np.stack([w - w0, g - g0]).reshape(2, SLICES, -1)
                yield pd.DataFrame({"slice": np.arange(SLICES), "salt": TaskContext.get().partitionId() % SALTS, "tasks": 1,
                                    "change": [_pack_change(both[:, i]) for i in range(SLICES)]})

        def add(frames):
            which = {}
            for pdf in frames:
                for r in pdf.itertuples():
                    x = _unpack_change(r.change).astype(np.float64)
                    total, tasks = which.get(r.slice, (0, 0))
                    which[r.slice] = (total + x, tasks + r.tasks)
            if which:
                yield pd.DataFrame([(s, 0, t, _pack_change(x)) for s, (x, t) in which.items()],
                                   columns=["slice", "salt", "tasks", "change"])

        kind = "slice int, salt int, tasks long, change binary"
        got = (coded.where(part == k).select("ids", "lens", "keys", "before", "held", "totals", "marks")
               .mapInPandas(learn, kind)
               # sums of sums, so that no task reads what all tasks have learnt
               .repartition(SLICES * SALTS, "slice", "salt").mapInPandas(add, kind)
               .repartition(SLICES, "slice").mapInPandas(add, kind).collect())
        if got:
            got = sorted(got, key=lambda r: r["slice"])
            x = np.stack([_unpack_change(r["change"]).reshape(2, -1) / r["tasks"] for r in got], 1)
            weights = weights + x[0].reshape(weights.shape)
            grads = grads + x[1].reshape(grads.shape)
        shared.unpersist()
    model.weights, model.bias = weights.astype(np.float32), bias
    return model


def _within(model: Model, totals: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 p(word | class) of local words."""
    p = totals / np.maximum(model.class_words[classes], 1)
    rare = classes == RARE
    p[rare] = np.where(totals[rare] > 0, 0.5 / max(model.singles, 1), 0.5 if model.singles else 1.0)
    return np.log10(p)


def score(coded: DataFrame, model: Model) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(model)  # 5 MB, fixed by the model's shape

    def run(frames):
        m = shared.value
        space = np.log10(m.n + m.v + 1)
        for pdf in frames:
            for r in pdf.itertuples():
                rows, ids, piece = _features(r)
                totals, classes = _classes(m, r)
                y = classes[ids]
                logp = _within(m, totals, classes)[ids]
                for i in range(0, len(y), STEP):
                    p = _class_probs(m.weights, m.bias, rows[:, i : i + STEP])
                    logp[i : i + STEP] += np.log10(np.maximum(p[np.arange(len(p)), y[i : i + STEP]], 1e-30))
                k = len(r.held)
                yield pd.DataFrame({
                    "doc_id": np.frombuffer(r.doc_ids, np.int64),
                    "uid": np.frombuffer(r.uids, np.int64), "held_out": np.frombuffer(r.held, np.uint8) > 0,
                    "n_tokens": np.bincount(piece, minlength=k), "n_known": np.bincount(
                        piece, totals[ids] > 0, k).astype(np.int64),
                    "base_score": np.bincount(piece, np.log10(totals + 1.0)[ids] - space, k),
                    "score": np.bincount(piece, logp, k)})

    out = coded.mapInPandas(run, "doc_id long, uid long, held_out boolean, n_tokens long, "
                                 "n_known long, base_score double, score double")
    return (out.groupBy("uid", nullable("doc_id"), "held_out")
            .agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                 F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
            .withColumn("train_tokens", F.lit(model.n).cast("long")).drop("uid"))


def train_and_score(docs: DataFrame, held: Column) -> DataFrame:
    """Learn from the rows where ``held`` is false; score every row of ``docs`` (doc_id, text)."""
    rows_at_once(docs.sparkSession, 32)  # a row of the batches holds a million words
    scratch = Scratch(docs.sparkSession, "maxent")
    batches = scratch.write(encode(docs, held), "batches")
    chars = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    coded, summary = _coded(batches, scratch, max(4, -(-chars // ASKED)), min(20_000, max(12, -(-chars // PART))))
    scratch.drop("batches", "answers")
    return score(coded, fit(coded, summary))
