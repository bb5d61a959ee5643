"""The classifier against a slow direct version of indexing, pooling and network, and without its extra features."""

import math
import re
import zlib

import numpy as np

from larkspur.llm import common, quality

TEXTS = ["a b a c", "The cat, the cat!", "one", "", None, "x y z x y z __ 7", "é ü é"]


def direct_words(text):
    return [zlib.crc32(x.lower().encode()) % quality.BUCKETS for x in re.findall(r"[^\W_]+|[^\w\s]+|_+", text or "")]


def direct_vectors(texts, index):
    sums = {}
    for ids in map(direct_words, texts):
        for i, w in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if j != i:
                    sums[w] = sums.get(w, 0) + index[ids[j]].astype(float)
    zero = np.zeros(index.shape[1])
    return lambda w: np.r_[sums[w] / max(np.linalg.norm(sums[w]), 1e-6) if w in sums else zero, index[w]]


def direct_pool(text, vector, wide):
    ids = direct_words(text)
    if not ids:
        return np.zeros(2 * wide + 4)
    rows = np.array([vector(w) for w in ids])
    mean = rows.mean(0)
    alike = lambda gap: sum(a == b for a, b in zip(ids, ids[gap:])) / (len(ids) - gap) if len(ids) > gap else 0
    return np.r_[mean, rows.std(0), math.sqrt(sum(mean**2)), alike(1), alike(2), math.log1p(len(ids)) / 10]


def direct_probability(x, n):
    hidden = [math.tanh(sum((x[i] - n.mean[i]) / n.scale[i] * n.w1[i, h] for i in range(len(x))) + n.b1[h]) for h in range(len(n.b1))]
    return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, n.w2)) + n.b2[0]) / n.temperature))


def test_scores_against_a_direct_version():
    index = quality.index_vectors()
    held = [quality.word_ids(t) for t in TEXTS]
    vectors = np.hstack([quality.context_vectors(held, index), index])
    vector = direct_vectors(TEXTS, index)
    wide = vectors.shape[1]
    pooled = np.stack([quality.pool(x, vectors) for x in held])
    assert np.allclose(pooled, [direct_pool(t, vector, wide) for t in TEXTS], atol=1e-3)
    network = quality.train(np.repeat(pooled, 20, 0).astype(float), np.tile([0.0, 1.0], 70))
    got = quality.Model(vectors, network).score(TEXTS)
    assert np.allclose(got, [direct_probability(direct_pool(t, vector, wide), network) for t in TEXTS], atol=1e-2)


def test_word_vectors_alone_tell_quality(spark):
    """Without the spread, the likeness of neighbours and the length, the word vectors' mean decides most cases."""
    folder = "/root/testdata/sf0.01"
    docs, labels = common.load(spark, folder, "documents"), common.load(spark, folder, "labels")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").where("quality IS NOT NULL").orderBy("doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % quality.FOLDS == 0 for i in rows.doc_id])
    model = quality.fit(docs, labels)
    wide = model.vectors.shape[1]
    x = np.stack([quality.pool(quality.word_ids(t), model.vectors) for t in rows.text]).astype(float)
    y = rows.quality.to_numpy(float)
    right = {}
    for name, part in {"all": x, "mean": x[:, :wide]}.items():
        network = quality.train(part[~held], y[~held])
        right[name] = float(((network.probability(part[held]) >= quality.THRESHOLD) == y[held]).mean())
    assert right["all"] > 0.93 and right["mean"] > 0.93 > y[held].mean()
