"""Toxicity (operator 8): a convolutional classifier over hashed word embeddings, trained and run in numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out
from .training import SAMPLE, labelled_sample, score_texts

#: Hash buckets and size of the embeddings; filters of each width.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 6, (1, 2, 3)
#: Passes, Adagrad's steps for embeddings and for the rest, documents of a batch.
EPOCHS, WORD_RATE, RATE, BATCH = 5, 0.1, 0.02, 32
#: Toxic documents of a language, outside the fit, from which on the language has a threshold of its own; the others take
#: the common one, which is set on all languages together.
LEAST_TOXIC = 10
#: Outputs of labelled documents are counted by steps of 1 / STEPS, so the driver gets counts and not documents.
STEPS = 1024
_EDGES = ".,!?;:\"'()[]{}*_-"


def word_ids(texts: list[str], known: dict[str, int]):
    """(bucket of each word, begin of each text in them): words between blanks, lower case, without marks at their ends.

    Bucket 0 stands for nothing: three of it end each text, so that windows of three begin at every word.
    """
    import numpy as np
    import xxhash

    if len(known) > 500_000:
        known.clear()
    digest, flat, begin = xxhash.xxh3_64_intdigest, [], []
    for text in texts:
        begin.append(len(flat))
        words = text.lower().split()
        for w in words:
            if w not in known:
                known[w] = 1 + digest(w.strip(_EDGES)) % (BUCKETS - 1)
        flat += map(known.__getitem__, words)
        flat += (0, 0, 0)
    return np.fromiter(flat, np.int64, len(flat)), np.asarray(begin, np.int64)


class Model:
    """embedding (BUCKETS x DIM), a filter bank and bias for each width, and the output layer, all from random weights.

    A score is the logistic of slope * z + shift2 of the output z; the two are set by `calibrate`.
    """

    def __init__(self, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.embedding = (rng.standard_normal((BUCKETS, DIM)) * 0.002).astype("f4")
        self.embedding[0] = 0
        self.filters = {w: (rng.standard_normal((w, DIM, FILTERS)) * (0.5 / w)).astype("f4") for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, "f4") for w in WIDTHS}
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype("f4")
        self.shift, self.slope, self.shift2 = 0.0, 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def gradients(self, ids, begin, labels) -> dict:
        """Of the mean log loss of a batch, by weights: a text's gradient reaches only the windows that won the max.

        Keys: filters by width, ("b", width) their biases, "o" and "s" the output layer, "rows" and "e" the embedding rows
        touched and their gradients.
        """
        import numpy as np

        pooled, winners = self._forward(ids, begin, True)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))
        g = ((p - labels) / len(labels)).astype("f4")
        back = g[:, None] * self.out[None, :] * (pooled > 0)
        out, rows, grads = {"o": pooled.T @ g, "s": float(g.sum())}, [], []
        for k, w in enumerate(WIDTHS):
            part, win = back[:, k * FILTERS : (k + 1) * FILTERS], winners[k]  # texts x filters
            d = np.zeros_like(self.filters[w])
            for j in range(w):
                seen = ids[np.minimum(win + j, ids.size - 1)]
                d[j] = np.einsum("tfd,tf->df", self.embedding[seen], part)
                rows.append(seen.ravel())
                grads.append((part[:, :, None] * self.filters[w][j].T[None]).reshape(-1, DIM))
            out[w], out["b", w] = d, part.sum(0)
        out["rows"], where = np.unique(np.concatenate(rows), return_inverse=True)
        out["e"] = np.zeros((out["rows"].size, DIM), "f4")
        np.add.at(out["e"], where, np.concatenate(grads))
        out["e"][out["rows"] == 0] = 0  # bucket 0 stands for nothing
        return out

    def fit(self, ids, begin, labels, seed: int = 11) -> None:
        """Adagrad on the log loss. A pass has as many documents of either class: the smaller class comes more than once."""
        import numpy as np

        labels = np.asarray(labels, np.int64)
        classes = [np.flatnonzero(labels == v) for v in (0, 1)]
        if not all(c.size for c in classes):
            return
        most = max(c.size for c in classes)
        end, rng = np.append(begin[1:], ids.size), np.random.default_rng(seed)
        sums: dict = {}

        def step(key, grad, rate):
            sums[key] = sums.get(key, 1e-3) + grad * grad
            return rate * grad / np.sqrt(sums[key])

        words = np.full((BUCKETS, 1), 1e-6, "f4")
        for _ in range(EPOCHS):
            order = rng.permutation(np.concatenate([np.resize(rng.permutation(c), most) for c in classes]))
            for start in range(0, order.size, BATCH):
                picked = order[start : start + BATCH]
                lengths = end[picked] - begin[picked]
                first = np.append(0, np.cumsum(lengths)[:-1])
                at = np.repeat(begin[picked] - first, lengths) + np.arange(lengths.sum())
                grad = self.gradients(ids[at], first, labels[picked])
                for w in WIDTHS:
                    self.filters[w] -= step(w, grad[w], RATE)
                    self.bias[w] -= step(("b", w), grad["b", w], RATE)
                self.out -= step("o", grad["o"], RATE)
                self.shift -= float(step("s", grad["s"], RATE))
                rows = grad["rows"]
                words[rows] += (grad["e"] ** 2).sum(1, keepdims=True)
                self.embedding[rows] -= WORD_RATE * grad["e"] / np.sqrt(words[rows])

    def calibrate(self, z, labels, weight, count=1) -> None:
        """Slope and shift of outputs of documents that were not fitted, by weighted log loss (Newton's steps, labels drawn in a little).

        count: documents that each output stands for; weight: of all of them together.
        """
        import numpy as np

        n = [max(1.0, float(((labels == v) * count).sum())) for v in (0, 1)]
        goal = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        x, theta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            slope = x.T @ (weight * (p - goal)) + np.array([1e-3 * (theta[0] - 1), 0])
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
            move = np.linalg.solve(curve, slope)
            theta -= np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-6:
                break
        if theta[0] > 0:
            self.slope, self.shift2 = float(theta[0]), float(theta[1])

    def _forward(self, ids, begin, winners: bool = False, tables=None):
        """Pooled activations of each text (begin: its first word), and where each maximum stands."""
        import numpy as np

        pooled, wins, ends = [], [], np.append(begin[1:], ids.size)
        for w in WIDTHS:
            padded = np.append(ids, np.zeros(w, np.int64))
            if tables is None:
                acted = sum(self.embedding[padded[j : j + ids.size]] @ self.filters[w][j] for j in range(w)) + self.bias[w]
            else:
                acted = tables[w, 0][ids] + self.bias[w]
                for j in range(1, w):
                    acted += tables[w, j][padded[j : j + ids.size]]
            for j in range(1, w):
                acted[ends - j] = -np.inf  # such a window would run over into the next text
            pooled.append(np.maximum(np.maximum.reduceat(acted, begin, axis=0), 0))
            if winners:
                wins.append(np.stack([a + acted[a:b].argmax(0) for a, b in zip(begin, ends)]))
        return np.concatenate(pooled, axis=1), wins

    def scorer(self, outputs: bool = False):
        """A function of texts (outputs: not yet calibrated); each filter row is multiplied out over the buckets once, so a window costs additions only."""
        import numpy as np

        tables = {(w, j): self.embedding @ self.filters[w][j] for w in WIDTHS for j in range(w)}
        known: dict[str, int] = {}

        def score(texts: list[str]):
            out = np.zeros(len(texts))
            start = 0
            while start < len(texts):  # blocks of some 100,000 words, or one text
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= 600_000):
                    chars += len(texts[stop])
                    stop += 1
                ids, begin = word_ids(texts[start:stop], known)
                pooled, _ = self._forward(ids, begin, tables=tables)
                z = pooled @ self.out + self.shift
                out[start:stop] = z if outputs else 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift2, -30, 30)))
                start = stop
            return out

        return score


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE) -> Model:
    """A model fitted on four fifths of a bounded sample; all other labelled documents calibrate the scores and set the thresholds.

    The sample has up to `per_class` documents of either class; among the others weights put the classes' real shares
    back. Without labels of both classes the model scores every text 0.5 and calls none toxic. A language with fewer than
    LEAST_TOXIC toxic documents outside the fit takes the common threshold.
    """
    import numpy as np

    rows, counts = labelled_sample(docs, labels, label, per_class, ("lang",))
    model = Model()
    if len({r["label"] for r in rows}) < 2:
        model.out[:] = 0
        model.thresholds = {"": 2.0}
        return model
    fit = [r for i, r in enumerate(rows) if i % 5]
    model.fit(*word_ids([r["text"] for r in fit], {}), np.array([r["label"] for r in fit]))
    langs, truth, z, n = labelled_outputs(docs, labels, label, model, [r["doc_id"] for r in fit])
    toxic = truth * n
    share = np.where(truth == 1, counts[1] / max(1, toxic.sum()), counts[0] / max(1, (n - toxic).sum()))
    share = share * n / max((share * n).sum(), 1e-12) * n.sum()
    if 0 < toxic.sum() < n.sum():
        model.calibrate(z, truth, share, n)
    scores = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift2, -30, 30)))
    model.thresholds = {"": best_threshold(scores, truth, share)}
    for lang in sorted({*langs} - {""}):
        own = langs == lang
        if toxic[own].sum() >= LEAST_TOXIC:
            model.thresholds[lang] = best_threshold(scores[own], truth[own], share[own])
    return model


def labelled_outputs(docs: DataFrame, labels: DataFrame, label: str, model: Model, fitted: list[int]):
    """(language, label, output, documents) as arrays: how many rows of the labelled documents that are not among `fitted` have that output.

    Every such row counts; of an id with two labels the smaller one holds. All documents are scored, as only ids and
    outputs, and no texts, are then joined with the labels.
    """
    import numpy as np

    known = labels.filter(f"doc_id is not null and {label} in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).cast("int").alias("label"))
    left_out = docs.sparkSession.createDataFrame([(i,) for i in fitted], "_id long")
    known = known.join(F.broadcast(left_out), "_id", "left_anti")
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    scored = score_texts(own, _outputs, model, ("_id", "lang"), "z")
    step = F.round(F.col("z") * STEPS).cast("long").alias("step")
    found = scored.join(known.hint("merge"), "_id").groupBy("lang", "label", step).agg(F.count("*").alias("n")).orderBy("lang", "label", "step").collect()
    lang, truth, z, n = ([r[c] for r in found] for c in ("lang", "label", "step", "n"))
    return np.array(lang, object), np.array(truth, np.int64), np.array(z, np.float64) / STEPS, np.array(n, np.int64)


def best_threshold(scores, truth, weight) -> float:
    """Of all cuts between two scores, the middle of the one with the best weighted F1 (0.5 if there is none)."""
    import numpy as np

    order = np.argsort(-scores)
    s, t, w = scores[order], truth[order], weight[order]
    hit, miss = np.cumsum(t * w), np.cumsum((1 - t) * w)
    f1 = 2 * hit / np.maximum(hit + miss + (t * w).sum(), 1e-12)
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1)) if s.size else 0
    return float((s[k] + s[k + 1]) / 2) if s.size > k + 1 and f1[k] > 0 else 0.5


def _scorer(model: Model):
    return model.scorer()


def _outputs(model: Model):
    return model.scorer(outputs=True)


def flagged(docs: DataFrame, labels: DataFrame, model: Model | None = None, columns: tuple[str, str, str] = ("_score", "_threshold", "_toxic")) -> DataFrame:
    """All columns of the documents, and score, threshold (of the language) and verdict under the given names.

    The names must not be among the documents' own (see `unused`). Texts pass through, so nothing is joined.
    """
    model = model or train(docs, labels)
    score, threshold, toxic = columns
    chosen = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in model.thresholds.items() if k), F.lit(model.thresholds.get("", 0.5)))
    scored = score_texts(docs, _scorer, model, tuple(docs.columns), score)
    return scored.withColumn(threshold, chosen).withColumn(toxic, F.col(score) >= F.col(threshold))


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Operator 8: doc_id, score, threshold (of its language) and toxic for every row.

    Scores see the text only; the language picks the threshold. A null or empty text has a score too (all filters at
    their bias). Repeated and null ids each keep their row; an unknown or null language takes the common threshold;
    other columns are dropped; an empty table gives an empty table.
    """
    return flagged(docs.select("doc_id", "text", "lang"), labels, model, ("score", "threshold", "toxic")).select("doc_id", "score", "threshold", "toxic")


def scored_by_fold(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, lang_predicted: the model learns from labels outside the held-out fold only.

    `predicted` is by the one cut for all, `lang_predicted` by the threshold of the document's language.
    """
    scored = toxicity(docs, labels, train(docs, labels.filter(~held_out("doc_id", mod, rest))))
    return scored.select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), F.col("threshold").alias("lang_threshold"), F.col("toxic").cast("int").alias("lang_predicted"))
