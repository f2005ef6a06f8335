"""Toxicity by chains of linear classifiers (operator 8).

The label columns form a chain.  Each has a logistic regression over the words and beginnings of
words present in a text (hashed; only those whose share differs clearly between the two classes,
weighted by their naive-Bayes log-count ratio) plus the log-odds that the earlier models gave.  In training these come from out-of-fold predictions, so a later model sees probabilities as
honest as it will see on new documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrytext.llm.base import only, schema_of, written

BITS = 20
SAMPLE = 4_000  # most labelled documents that train the models, by lowest hash of the id
FOLDS = 5
LEAST_Z = 4.0
LEAST_ROWS = 3
CHAIN = ("quality", "toxic")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").translate(_FOLD).split())


def _parts(word: bytes) -> list[int]:
    """Hashes of a word and of its first 3 to 8 characters, which inflected and compound forms share."""
    digest, shift = xxhash.xxh32_intdigest, 32 - BITS
    chars = word.decode("utf-8", "replace")
    starts = {chars[:k] for k in range(3, min(8, len(chars)) + 1)}
    return [digest(word) >> shift, *(digest(b"^" + c.encode()) >> shift for c in starts)]


def features(text: str | None) -> list[int]:
    """The sorted hashed features present in a text."""
    return sorted({x for w in _words(text) for x in _parts(w)})


class Linear:
    """One logistic regression: a weight per hashed word, a weight per earlier category, and a bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.words, self.weights, self.earlier, self.bias = words, weights, earlier, bias

    def table(self) -> dict[int, float]:
        return dict(zip(self.words.tolist(), self.weights.tolist()))

    @staticmethod
    def fit(flat: np.ndarray, sizes: np.ndarray, more: np.ndarray, y: np.ndarray, decay: float = 2e-4, steps: int = 120) -> "Linear":
        """``flat``: all rows' words in turn, ``sizes``: how many each has, ``more``: earlier log-odds."""
        n = len(y)
        rate = float(y.mean()) if n else 0.0
        if n == 0 or rate in (0.0, 1.0):
            bias = -20.0 if rate == 0.0 else 20.0
            return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(more.shape[1]), bias)
        row = np.repeat(np.arange(n, dtype=np.int32), sizes)
        with_y = np.bincount(flat, weights=y[row], minlength=1 << BITS)
        without = np.bincount(flat, minlength=1 << BITS) - with_y
        # Keep features whose share among both classes differs by LEAST_Z standard errors.
        positives, share = y.sum(), (with_y + without) / n
        gap = with_y / positives - without / (n - positives)
        z = np.abs(gap) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positives + 1 / (n - positives)))
        chosen = np.flatnonzero((z >= LEAST_Z) & (with_y + without >= LEAST_ROWS))
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        column = place[flat]
        used = column >= 0
        vocabulary, column, row = chosen, column[used], row[used]
        with_y, without = with_y[chosen], without[chosen]
        ratio = np.abs(np.log((with_y + 1) / (y.sum() + 2)) - np.log((without + 1) / (n - y.sum() + 2)))
        value = ratio[column]
        # Weights of words, of earlier categories and the bias in one vector.
        v, m = len(vocabulary), more.shape[1]

        def scores(w):
            return np.bincount(row, weights=value * w[:v][column], minlength=n) + more @ w[v : v + m] + w[-1]

        def back(r):
            return np.concatenate((np.bincount(column, weights=value * r[row], minlength=v), more.T @ r, [r.sum()]))

        probe = np.random.default_rng(7).standard_normal(v + m + 1)
        for _ in range(8):
            probe /= np.linalg.norm(probe)
            probe = back(scores(probe)) / n
        step = 1.0 / (0.3 * np.linalg.norm(probe) + decay)
        w = np.zeros(v + m + 1)
        w[-1] = np.log(rate / (1 - rate))
        ahead, momentum = w.copy(), 1.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(scores(ahead), -40, 40)))
            slope = back(p - y) / n
            slope[:-1] += decay * ahead[:-1]
            new = ahead - step * slope
            after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
        return Linear(vocabulary, ratio * w[:v], w[v : v + m], float(w[-1]))

    def log_odds(self, flat: np.ndarray, sizes: np.ndarray, more: np.ndarray) -> np.ndarray:
        out = np.full(len(sizes), self.bias) + more @ self.earlier
        if len(self.words) and len(flat):
            at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            hit = np.where(self.words[at] == flat, self.weights[at], 0.0)
            out += np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=hit, minlength=len(sizes))
        return np.clip(out, -20, 20)


def fit_chain(ids: list[str], flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """Train the chain: ``flat`` has all rows' features in turn, ``labels`` a column per category."""
    n_labels, rows = labels.shape[1], len(ids)
    fold = np.array([zlib.crc32(x.encode()) % folds for x in ids], np.int64)
    owner = np.repeat(np.arange(rows, dtype=np.int32), sizes)
    more, chain = np.zeros((rows, 0)), []
    for k in range(n_labels):
        chain.append(Linear.fit(flat, sizes, more, labels[:, k]))
        if k + 1 < n_labels:
            unseen = np.zeros(rows)
            for f in range(folds):
                out, used = fold == f, fold != f
                if out.any():
                    model = Linear.fit(flat[used[owner]], sizes[used], more[used], labels[used, k])
                    unseen[out] = model.log_odds(flat[out[owner]], sizes[out], more[out])
            more = np.column_stack((more, unseen))
    return chain


def _training_rows(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...], limit: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """At most ``limit`` labelled documents: ids, features in turn, their numbers, labels."""
    known = labels.filter(" AND ".join(["doc_id IS NOT NULL", *[f"`{c}` IS NOT NULL" for c in chain]]))
    one = known.groupBy("doc_id").agg(F.max(F.struct(*[(F.col(f"`{c}`") > 0).cast("int").alias(c) for c in chain])).alias("label"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # An id that many rows share trains once, on its greatest text; copies fall together before the shuffle.
    met = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    met = met.select(F.col("doc_id").cast("string").alias("id"), "text", F.array(*[F.col(f"label.`{c}`") for c in chain]).alias("label"))

    def run(batches):
        for batch in batches:
            words = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words, batch.column(2)], ["id", "words", "label"])

    rows = written(met.mapInArrow(run, "id string, words array<int>, label array<int>"), "features")
    # Features that could never be chosen stay behind: rare ones, and those as frequent in both classes
    # (by a bar well under the one that a model sets on its own training rows).
    n = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.get("label", F.lit(k))), F.lit(0)).alias(f"p{k}") for k in range(len(chain))]).first()
    seen = rows.select(F.explode("words").alias("word"), "label").groupBy("word").agg(F.count("*").alias("n"), *[F.sum(F.get("label", F.lit(k))).alias(f"p{k}") for k in range(len(chain))])
    far = F.lit(False)
    for k in range(len(chain)):
        p, q = float(n[f"p{k}"]), float(n["n"] - n[f"p{k}"])
        if p and q:
            share = F.col("n") / F.lit(p + q)
            error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * F.lit(1 / p + 1 / q))
            far = far | (F.abs(F.col(f"p{k}") / F.lit(p) - (F.col("n") - F.col(f"p{k}")) / F.lit(q)) >= LEAST_Z / 2 * error)
    useful = np.sort(seen.filter((F.col("n") >= LEAST_ROWS) & far).select("word").toArrow().column(0).to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(useful)

    def reduce(batches):
        for batch in batches:
            lists = [np.asarray(x, np.int32) for x in batch.column(1).to_pylist()]
            kept = pa.array([np.intersect1d(x, shared.value, assume_unique=True) for x in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), kept, batch.column(2)], ["id", "words", "label"])

    got = rows.mapInArrow(reduce, "id string, words array<int>, label array<int>").toArrow()
    words = got.column("words").combine_chunks()
    flat, sizes = words.flatten().to_numpy(), words.value_lengths().to_numpy()
    labels_of = np.array(got.column("label").to_pylist(), float).reshape(len(sizes), len(chain))
    ids, starts = got.column("id").to_pylist(), np.cumsum(sizes, dtype=np.int64) - sizes
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    parts = [flat[starts[k] : starts[k] + sizes[k]] for k in order]
    return [ids[k] for k in order], np.concatenate(parts) if parts else np.zeros(0, np.int32), sizes[order].astype(np.int64), labels_of[order]


def classify(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, threshold: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``<label>_p`` for each label of the chain, and ``toxic``.

    ``labels(doc_id, <chain columns of 0/1>)`` trains the models: at most ``sample`` labelled
    documents, those of the lowest hashed ids (rows with a null are left out; of several rows for an
    id the largest counts).  Every document is scored over its whole text; ``toxic`` is whether the
    last label's probability reaches ``threshold``.  A null or empty text has no words and gets what
    the bias says; a label without examples of both kinds gets a probability next to 0 or 1 (0 without
    labels).  Repeated rows and null ids stay; an empty table gives an empty result; other columns are
    ignored, so none can clash.
    """
    source = only(docs, doc_id=id_col, text=text_col)
    models = fit_chain(*_training_rows(source, labels, tuple(chain), sample))
    shared = docs.sparkSession.sparkContext.broadcast([(m.table(), m.earlier.tolist(), m.bias) for m in models])

    def run(batches):
        tables = shared.value
        known = frozenset().union(*(t for t, _, _ in tables))
        cache: dict[bytes, tuple] = {}
        for batch in batches:
            odds: list[list[float]] = [[] for _ in tables]
            for text in batch.column(1).to_pylist():
                if len(cache) > 500_000:
                    cache.clear()
                present = set()
                for word in _words(text):
                    found = cache.get(word)
                    if found is None:
                        found = cache[word] = tuple(x for x in _parts(word) if x in known)
                    if found:
                        present.update(found)
                ordered = sorted(present)
                sums = [bias + sum(t.get(x, 0.0) for x in ordered) for t, _, bias in tables]
                earlier: list[float] = []
                for k, (_, weights, _) in enumerate(tables):
                    z = min(max(sums[k] + sum(a * b for a, b in zip(weights, earlier)), -20.0), 20.0)
                    earlier.append(z)
                    odds[k].append(z)
            columns = [pa.array(np.round(1 / (1 + np.exp(-np.array(z, float))), 9)) for z in odds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = ["doc_id", *[f"{c}_p" for c in chain]]
    schema = schema_of(source, ["doc_id"], ", ".join(f"`{c}` double" for c in names[1:]))
    return source.mapInArrow(run, schema).withColumn("toxic", F.col(f"`{names[-1]}`") >= threshold)
