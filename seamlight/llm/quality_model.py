"""Quality classifier (operator 9): averaged vectors of hashed words, word pairs and character n-grams, softmax, numpy SGD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out
from .training import blocks, coded_words, labelled_sample, score_texts

BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4)
EPOCHS, RATE, SAMPLE = 5, 0.3, 2000
#: Characters of words hashed at once.
PIECE = 300_000


def feature_pieces(words: list[str]):
    """(word, bucket) arrays of all features: each word's own bucket first, then its character n-grams, edges marked.

    Words are hashed together, as arrays of code points, in blocks of whole words; a longer word follows in windows, so
    memory does not grow with its length, and what a word gives does not depend on its neighbours.
    """
    import numpy as np
    import xxhash

    for start, stop in blocks(words, PIECE):
        edged = [f"<{w}>" for w in words[start:stop]]
        chars = "".join(edged)
        for at in range(0, max(1, len(chars) - min(GRAMS) + 1), 3 * PIECE):  # one window, but for a single long word
            points = np.frombuffer(chars[at : at + 3 * PIECE + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            owner = np.full(points.size, start) if stop - start == 1 else np.repeat(np.arange(start, stop), np.fromiter(map(len, edged), np.int64, stop - start))
            owners, buckets = [], []
            if not at:
                owners.append(np.arange(start, stop))
                buckets.append(np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in words[start:stop]), np.int64, stop - start))
            for k in GRAMS:
                size = min(max(0, points.size - k + 1), 3 * PIECE)
                h = np.full(size, k, np.uint64)
                for j in range(k):
                    h = (h ^ points[j : size + j]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                whole = owner[:size] == owner[k - 1 : size + k - 1]
                owners.append(owner[:size][whole])
                buckets.append((h[whole] >> np.uint64(20)).astype(np.int64) % BUCKETS)
            yield np.concatenate(owners), np.concatenate(buckets)


def word_features(words: list[str]):
    """(buckets, bounds): of each word, the word's own bucket and those of its character n-grams."""
    import numpy as np

    pieces = [(o.astype("i4"), b.astype("i4")) for o, b in feature_pieces(words)] or [(np.zeros(0, "i4"),) * 2]
    owner, bucket = (np.concatenate(x) for x in zip(*pieces))
    order = np.argsort(owner, kind="stable")  # a word's own bucket stays first
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def pair_features(first):
    """Buckets of neighbouring words, from the words' own first buckets; any word beside itself is one bucket."""
    import numpy as np

    a, b = first[:-1].astype(np.uint64), first[1:].astype(np.uint64)
    hashed = (((a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xBF58476D1CE4E5B9))) >> np.uint64(20)).astype(np.int64) % BUCKETS
    return np.where(a == b, 0, hashed)


class Model:
    """embedding (BUCKETS x DIM), output weights (DIM x 2) and biases."""

    def __init__(self, seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.embedding = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype("f4")
        self.weights = (rng.standard_normal((DIM, 2)) * 0.5).astype("f4")
        self.bias = np.zeros(2, "f4")

    def gradients(self, rows, share, label: int):
        """Of the log loss of a text whose feature rows have these shares: (text vector's, output weights', biases').

        An embedding row's gradient is its share times the text vector's.
        """
        import numpy as np

        v = share @ self.embedding[rows]
        z = v @ self.weights + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        return self.weights @ p, np.outer(v, p), p

    def fit(self, texts: list[str], labels, picked=None, seed: int = 3) -> None:
        """One text a step, Adagrad by row; `picked` are the places of the texts of a pass, by default each once."""
        import numpy as np

        bags = []
        for start, stop in blocks(texts, 1_000_000):
            words, code, owner = coded_words(texts[start:stop])
            flat, bounds = word_features(words)
            for i in range(stop - start):
                own = code[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
                size = bounds[own + 1] - bounds[own]
                at = np.repeat(bounds[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                rows, count = np.unique(np.concatenate([flat[at], pair_features(flat[bounds[own]])]), return_counts=True)
                bags.append((rows.astype("i4"), count.astype("i4")))
        picked = np.arange(len(texts)) if picked is None else picked
        sums, sw = np.full(BUCKETS, 1e-3, "f4"), np.full(self.weights.shape, 1e-2, "f4")
        rng, rate = np.random.default_rng(seed), RATE
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for i in rng.permutation(picked):
                rows, count = bags[i]
                if not rows.size:
                    continue
                share = (count / count.sum()).astype("f4")
                dv, dw, g = self.gradients(rows, share, labels[i])
                sw += dw * dw
                self.weights -= 0.1 * rate * dw / np.sqrt(sw)
                self.bias -= 0.02 * rate * g
                sums[rows] += share * share * float(dv @ dv)
                self.embedding[rows] -= (0.1 * rate * share / np.sqrt(sums[rows]))[:, None] * dv[None, :]

    def scorer(self):
        """A function of texts. The output is linear in the features, so each counts as one number, and a word as the sum of its own."""
        import numpy as np

        each = (self.embedding @ (self.weights[:, 1] - self.weights[:, 0])).astype("f8")
        shift = float(self.bias[1] - self.bias[0])
        known: dict[str, tuple[float, int, int]] = {}
        held = 0  # characters of the known words

        def score(texts: list[str]):
            nonlocal held
            out = np.empty(len(texts))
            for start, stop in blocks(texts):
                words, code, owner = coded_words(texts[start:stop])
                if len(known) > 300_000 or held > 20_000_000:
                    known.clear()
                    held = 0
                fresh = [w for w in words if w not in known]
                held += sum(map(len, fresh))
                value, size, first = np.zeros(len(fresh)), np.zeros(len(fresh), np.int64), np.full(len(fresh), -1)
                for word, bucket in feature_pieces(fresh):
                    low, most = int(word[0]), int(word.max()) + 1  # a piece has whole words, or some of one
                    value[low:most] += np.bincount(word - low, each[bucket])
                    size[low:most] += np.bincount(word - low)
                    own = first[low:most]
                    own[:] = np.where(own < 0, bucket[: most - low], own)  # own buckets come first, in the words' order
                known.update(zip(fresh, zip(value.tolist(), size.tolist(), first.tolist())))
                value, size, first = (np.array(x) for x in zip(*map(known.__getitem__, words))) if words else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
                n = stop - start
                total, count = np.bincount(owner, value[code], n), np.bincount(owner, size[code], n)
                same = owner[1:] == owner[:-1]
                pairs = each[pair_features(first[code])] * same if code.size else np.zeros(0)
                total, count = total + np.bincount(owner[1:], pairs, n), count + np.bincount(owner[1:], same, n)
                out[start:stop] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + shift, -30, 30)))
            return out

        return score


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE) -> Model:
    """A model fitted on a bounded sample with both classes weighing the same. Without labels it scores every text 0.5."""
    import numpy as np

    rows, _ = labelled_sample(docs, labels, label, per_class)
    model = Model()
    y = np.array([r["label"] for r in rows], np.int64)
    if len({*y.tolist()}) < 2:
        model.weights[:] = 0
        return model
    # the smaller class is repeated, so that both weigh the same
    few, many = sorted((np.flatnonzero(y == 0), np.flatnonzero(y == 1)), key=len)
    picked = np.concatenate([many, np.resize(few, many.size)])
    model.fit([r["text"] for r in rows], y, picked)
    return model


def _scorer(model: Model):
    return model.scorer()


def quality_scores(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Operator 9: doc_id and score (0 to 1, higher for label 1) of every row, from its whole text alone.

    A null or empty text gets the bias alone. Repeated and null ids each keep their row; other columns are dropped; an
    empty table gives an empty table.
    """
    return score_texts(docs, _scorer, model or train(docs, labels), ("doc_id",))


def scored_by_fold(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: the model learns from labels outside the held-out fold only."""
    scored = quality_scores(docs, labels, train(docs, labels.filter(~held_out("doc_id", mod, rest))))
    return scored.select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
