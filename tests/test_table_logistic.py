"""The table-held logistic regression against a dense fit, and against Spark ML's own on the same vectors."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from slantspark.operators import table_logistic as TL
from slantspark.operators import textclf as TC


def some_rows(seed=0, n=120, words=40, classes=3):
    rng = np.random.default_rng(seed)
    lean = rng.integers(0, classes, words)
    out = []
    for i in range(n):
        label = int(rng.integers(0, classes))
        picks = [w for w in rng.integers(0, words, rng.integers(0, 25)) if lean[w] == label or rng.random() < 0.5]
        out.append((i, [f"w{w}" for w in picks], label))
    return out


def dense(rows, classes):
    names = sorted({w for _, ws, _ in rows for w in ws})
    df = {w: sum(w in ws for _, ws, _ in rows) for w in names}
    x = np.zeros((len(rows), len(names)))
    for i, (_, ws, _) in enumerate(rows):
        for w in ws:
            x[i, names.index(w)] += np.log((len(rows) + 1) / (df[w] + 1))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return names, np.hstack([x, np.ones((len(rows), 1))]), np.array([r[2] for r in rows])


def loss_and_gradient(w, x, y, reg):
    z = x @ w
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    free = w.copy()
    free[-1] = 0
    loss = -np.log(p[np.arange(len(y)), y]).mean() + reg / 2 * (free ** 2).sum()
    p[np.arange(len(y)), y] -= 1
    return loss, x.T @ p / len(y) + reg * free


def dense_fit(x, y, classes, reg, rounds=60_000):
    """Plain gradient descent to the optimum (the objective is strictly convex but for the intercepts' common shift)."""
    w = np.zeros((x.shape[1], classes))
    for _ in range(rounds):
        loss, g = loss_and_gradient(w, x, y, reg)
        if np.abs(g).max() < 1e-9:
            break
        w -= 0.9 * g
    return w, loss


@pytest.fixture(scope="module")
def data(spark):
    rows = some_rows()
    table = spark.createDataFrame(rows, "_row long, words array<string>, label int")
    return rows, table, TC.idf_vocabulary(table)


def test_equals_a_dense_fit(spark, data, monkeypatch):
    monkeypatch.setattr(TL, "BLOCK_ENTRIES", 200)            # several blocks
    rows, table, vocab = data
    reg = 0.02
    names, x, y = dense(rows, 3)
    want, best = dense_fit(x, y, 3, reg)
    found, loss = TL.fit(table, vocab, 3, max_iter=60, reg=reg, tolerance=1e-13)
    words = {r["id"]: r["word"] for r in vocab.collect()}
    got = {words.get(r["id"]): np.array(r["w"]) for r in found.collect() if r["id"] in words or r["id"] == TL.BIAS}
    assert set(got) == {None, *names} and abs(loss - best) < 1e-8
    for n, name in enumerate(names):
        assert np.abs(got[name] - want[n]).max() < 1e-3
    assert np.abs((got[None] - got[None].mean()) - (want[-1] - want[-1].mean())).max() < 1e-3


def test_equals_spark_ml_on_the_same_vectors(spark, data):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    rows, table, vocab = data
    names, x, y = dense(rows, 3)
    frame = spark.createDataFrame([(Vectors.dense(v[:-1].tolist()), float(c)) for v, c in zip(x, y)], ["features", "label"])
    ml = LogisticRegression(family="multinomial", regParam=0.02, standardization=False, maxIter=300, tol=1e-12).fit(frame)
    _, loss = TL.fit(table, vocab, 3, max_iter=60, reg=0.02, tolerance=1e-13)
    w = np.vstack([ml.coefficientMatrix.toArray().T, ml.interceptVector.toArray()])
    assert abs(loss_and_gradient(w, x, y, 0.02)[0] - loss) < 1e-6


def test_loss_and_gradient_of_a_pass(spark, data, monkeypatch):
    """Any coefficients and direction: the losses and the summed gradient shares equal the dense ones, over several blocks and shards."""
    monkeypatch.setattr(TL, "BLOCK_ENTRIES", 150)
    rows, table, vocab = data
    names, x, y = dense(rows, 3)
    vocab = spark.createDataFrame([(r["word"], r["idf"], 1500 * names.index(r["word"])) for r in vocab.collect()], "word string, idf double, id long")
    rng = np.random.default_rng(1)
    w, d = rng.standard_normal((2, len(names) + 1, 3))
    ids = [1500 * k for k in range(len(names))] + [TL.BIAS]
    shards = {}
    for k, i in enumerate(ids):
        v = shards.setdefault(i >> TL.SHARD_BITS, np.zeros((TL.SHARD, TL.VECTORS, 3)))
        v[i & (TL.SHARD - 1), 0], v[i & (TL.SHARD - 1), 1] = w[k], d[k]
    state = spark.createDataFrame([(int(s), bytearray(v.tobytes())) for s, v in shards.items()], "shard long, vecs binary")
    delta = np.eye(TL.VECTORS)[1]
    blocks = TL.encode(table, vocab, 3)
    assert blocks.data.count() > 3 and len(shards) > 10
    losses, gradient = np.zeros(2), np.zeros((len(ids), 3))
    for r in TL.evaluate(blocks, state, delta, (0.0, 0.5), 0.5).collect():
        if r["shard"] == TL.LOSS:
            losses += np.frombuffer(r["g"])
        else:
            for at, g in zip(np.frombuffer(r["at"], np.int32), np.frombuffer(r["g"]).reshape(-1, 3)):
                gradient[ids.index((r["shard"] << TL.SHARD_BITS) + at)] += g
    for n, t in enumerate((0.0, 0.5)):
        assert losses[n] == pytest.approx(loss_and_gradient(w + t * d, x, y, 0.0)[0], rel=1e-10)
    assert gradient == pytest.approx(loss_and_gradient(w + 0.5 * d, x, y, 0.0)[1], abs=1e-10)


def test_all_words_count_and_rows_without_words(spark, tmp_path):
    rows = [(f"left{i} common", 1) for i in range(30)] + [(f"right{i} common", 0) for i in range(30)] + [("", 0), ("", 0), ("", 0), (None, 1)]
    df = TC.prepare(spark.createDataFrame([(t, "right" if y else "least") for t, y in rows], "article_text string, bias string"))
    model = TC.train(df, max_iter=30, reg=1e-3)
    assert model.table.count() == 61 and len(model.intercepts) == 2
    out = model.transform(df.select("words", "labels", F.lit(1).alias("z"))).collect()
    assert len(out) == 64 and all(abs(sum(r["probability"]) - 1) < 1e-9 and r["z"] == 1 for r in out)
    seen = [r for r in out if r["words"]]
    assert all(r["prediction"] == r["labels"] for r in seen)         # each word but one occurs in one row: none may be merged
    assert len({tuple(r["probability"]) for r in out if not r["words"]}) == 1
    model.save(str(tmp_path / "m"))
    again = TC.TextModel.open(str(tmp_path / "m"))
    assert again.intercepts == model.intercepts and again.table.count() == 61
    assert TC.TextModel.open(str(tmp_path / "none")) is None
