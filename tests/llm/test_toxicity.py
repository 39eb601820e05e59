import zlib

import numpy as np

from memweave.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_labels(spark):
    sf = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    test = [g for g in got if g.held_out and g.doc_id in truth]
    y, s = np.array([truth[g.doc_id] for g in test]), np.array([g.score for g in test])
    print(auc(s, y), np.mean((s >= 0.5) == y))
    assert auc(s, y) > 0.97 and np.mean((s >= 0.5) == y) > 0.97


def test_votes_alone_tell_held_out_labels(spark):
    """The label model scores held-out rows by their votes, without the classifier; its posteriors are not the labels."""
    sf = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = tox.train(docs, labels)
    rows = docs.join(labels, "doc_id").where("text IS NOT NULL").select("doc_id", "text", "toxic").collect()
    find, size = tox.Finder(model.entries), len(model.entries)
    x = np.zeros((len(rows), size + len(tox.PATTERNS)))
    for k, r in enumerate(rows):
        x[k, sorted(find(r.text))] = 1
        x[k, size:] = tox.pattern_votes(r.text)
    post, y = model.label_model.posterior(x[:, model.voters]), np.array([r.toxic for r in rows])
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows])
    print(auc(post[held], y[held]), np.mean((post > 0.5) != y))
    assert auc(post[held], y[held]) > 0.96
    assert 0.002 < np.mean((post[~held] > 0.5) != y[~held]) < 0.05 and np.mean((post > 0.05) & (post < 0.95)) > 0.02


def test_label_model_finds_rates_and_doubled_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    fire = lambda a, b: (rng.random(4000) < np.where(y, a, b)).astype(float)
    one = fire(0.8, 0.01)  # entries of a lexicon are rare in other texts
    votes = np.stack([one, one, fire(0.5, 0.02), fire(0.6, 0.005), fire(0.02, 0.02), fire(0.7, 0.01)], 1)
    wrong = rng.random(4000) < 0.15
    labels = np.where(wrong, ~y, y).astype(float)
    model = tox.fit_label_model(votes, labels)
    post = model.posterior(votes)
    assert np.mean((post > 0.5) == y) > 0.95  # labels are right in 0.85
    assert np.mean((post > 0.5)[wrong] == labels[wrong]) < 0.1  # a wrong label does not decide its own row
    assert model.rates[3, 1] > 0.3 and model.rates[3, 1] > 8 * model.rates[3, 0] and abs(model.rates[4, 1] - model.rates[4, 0]) < 0.03
    assert model.correlations[0, 1] > 0.9 and model.correlations[0, 3] == 0


def test_edges(spark):
    filler = lambda i: " ".join(f"w{i * 7 + k}x" for k in range(20))
    rows = [(i, ("you awful fool " if i % 4 == 0 else "a fine day for all ") + filler(i), "x") for i in range(80)]
    rows += [(200, None, "x"), (201, "", "x"), (None, "you awful fool", "x"), (202, "you awful fool " * 50_000, None), (0, "you awful fool", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(80)] + [(None, 1, 0), (3, None, 0), (4, 0, 0)], "doc_id long, toxic int, text int")
    got = tox.toxicity(docs, labels).collect()
    by = {g.doc_id: g for g in got}
    assert len(got) == len(rows) and by[202].predicted == 1 and by[None].held_out is False
    assert by[200].score == by[201].score < 0.5
    none = tox.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {g.score for g in none} == {0.0}
    assert tox.toxicity(docs.limit(0), labels).count() == 0
