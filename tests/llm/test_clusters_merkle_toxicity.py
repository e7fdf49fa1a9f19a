"""Operators 11 to 13: plain versions, edge cases, held-out accuracy."""

import math
import os
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import clusters, merkle, toxicity
from linewright.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def hexed(text):
    return sha256(text.encode()).hexdigest()


# -- 11 ----------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    """Rows of op11 from ``(vec_id, vector)``, in integers of any size."""
    kept = [
        (i, [math.floor(1024 * x) if abs(x) < 1e300 else 1024 * int(x) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hexed(f"3:{r[0]}"), r[1]))[:k]
    centroids = [parts for _, parts in seeds]

    def nearest(parts):
        return min((sum((a - b) ** 2 for a, b in zip(parts, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, parts in kept:
            members[nearest(parts)[1]].append(parts)
        centroids = [
            [sum(column) // len(own) for column in zip(*own, strict=True)] if own else old
            for own, old in zip(members, centroids, strict=True)
        ]
    placed = [(i, *nearest(parts)[::-1]) for i, parts in kept]

    def fitting(value):
        return value if value < 1 << 63 else None

    sums = [sum(d for _, n, d in placed if n == c) for c in range(len(centroids))]
    whole = [all(d < 1 << 63 for _, n, d in placed if n == c) for c in range(len(centroids))]
    return [
        (
            i, n, fitting(d),
            fitting(sums[n]) if whole[n] else None,
            fitting(sum(sums)) if all(whole) else None,
            hexed(",".join(map(str, centroids[n]))),
        )
        for i, n, d in placed
    ]


def _clustered(spark, rows, kind="float"):
    schema = f"vec_id long, embedding array<{kind}>, cluster string, planes long, label int"
    df = spark.createDataFrame([(i, v, "x", 1, None) for i, v in rows], schema)
    found = clusters.digests(*clusters.clustered(df))
    assert found.columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
    ]
    return sorted(map(tuple, found.collect()), key=repr)


def test_clusters_equal_a_plain_version(spark):
    draw = np.random.default_rng(1)
    rows = [(n, draw.normal(0, 0.3, 64).astype(np.float32).tolist()) for n in range(150)]
    rows += [(n, list(v)) for n, v in rows[:20]]  # repeated rows
    rows += [(n, rows[n - 170][1]) for n in range(200, 210)]  # equal vectors, other ids
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65)]
    rows += [(304, [None] + [0.5] * 63), (305, [math.nan] * 64), (306, [math.inf] * 64)]
    rows += [(None, [0.25] * 64), (None, [-0.25] * 64), (0, [-1.0] * 64)]
    assert _clustered(spark, rows) == sorted(plain_clusters(rows), key=repr)


def test_few_equal_and_no_vectors(spark):
    few = [(n, [n / 7] * 64) for n in range(3)]
    assert _clustered(spark, few) == sorted(plain_clusters(few), key=repr)
    equal = [(n, [0.1] * 64) for n in range(20)]
    found = _clustered(spark, equal)
    assert found == sorted(plain_clusters(equal), key=repr)
    assert {row[1] for row in found} == {0}  # ties go to the smaller number
    assert _clustered(spark, [(1, None)]) == [] == _clustered(spark, [])


def test_components_beyond_a_long(spark):
    draw = random.Random(2)
    rows = [(n, [draw.uniform(-1, 1) for _ in range(64)]) for n in range(30)]
    rows += [(100, [1e300, *[0.5] * 63]), (101, [-1.7e308] * 64), (102, [2.0**52 + 0.5] * 64)]
    assert _clustered(spark, rows, "double") == sorted(plain_clusters(rows), key=repr)


def test_popcounts_give_dot_products():
    draw = random.Random(3)
    for top in (1, 3, 900, 2**40, 2**90):
        a, b = ([draw.randint(-top, top) for _ in range(64)] for _ in range(2))
        wanted = sum(x * y for x, y in zip(a, b, strict=True))
        assert clusters.dots(clusters.planes_of(a), clusters.planes_of(b)) == wanted


# -- 12 ----------------------------------------------------------------------------------


def plain_tree(leaves, fanout=3):
    """The root, and per leaf the siblings on either side at each level."""
    nodes, paths, at = list(leaves) or [""], [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for leaf, place in enumerate(at):
            run = runs[place // fanout]
            paths[leaf].append(("".join(run[: place % fanout]), "".join(run[place % fanout + 1 :])))
            at[leaf] = place // fanout
        nodes = [hexed("".join(run)) for run in runs]
    return nodes[0], paths


def plain_manifest(rows, fanout=3):
    """Rows of op12 from ``(doc_id, source, lang, n_chars, text)``."""

    def leaf(row):
        return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = own, *plain_tree(list(map(leaf, own)), fanout)
    root, crown = plain_tree([trees[name][1] for name in names], fanout)
    found = []
    for name, above in zip(names, crown, strict=True):
        own, subroot, paths = trees[name]
        for row, path in zip(own, paths, strict=True):
            path = path + above
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            again = leaf((*row[:4], text))
            for left, right in path:
                again = hexed(left + again + right)
            proof = hexed("".join(left + right for left, right in path))
            found.append((row[0], leaf(row), subroot, root, proof, again, again == root))
    return found


def _manifest(spark, rows, fanout=3):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree long, pos string, node long"
    df = spark.createDataFrame([(*row, 1, "x", None) for row in rows], schema)
    text = merkle.tampered_text(F.col("doc_id"), F.col("text"))
    found = merkle.digests(merkle.manifest(df, changed={"text": text}, fanout=fanout))
    assert found.columns == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    ]
    return sorted(map(tuple, found.collect()), key=repr)


ROWS = [
    (n, draw, "en", n % 9 or None, f"line {n}\nand more\n" if n % 3 else None)
    for n, draw in enumerate(["hot"] * 90 + ["b", "b", "b", "b", "ö", "Z", "", None, None, "z"])
]
ROWS += [(n, "hot", None, 0, "") for n in (-5, 400, 10**15)]
ROWS += [(None, "hot", "de", 1, "x\ny"), (None, None, "de", 1, "x\ny"), (7, "hot", "en", 7, "same id")]
ROWS += [ROWS[0]] * 40 + [(500, "long", "en", 1, "word\n" * 50_000)]


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_equals_a_plain_version(spark, fanout):
    found = _manifest(spark, ROWS, fanout)
    assert found == sorted(plain_manifest(ROWS, fanout), key=repr)
    assert {row[-1] for row in found} == {True, False}


@pytest.mark.parametrize("rows", [[], ROWS[:1], ROWS[90:94], ROWS[94:97], [ROWS[0]] * 10])
def test_small_manifests(spark, rows):
    assert _manifest(spark, rows) == sorted(plain_manifest(rows), key=repr)


def test_a_parent_needs_two_children(spark):
    with pytest.raises(ValueError, match="two children"):
        merkle.manifest(spark.read.parquet(f"{SF_DIR}/documents.parquet"), fanout=1)


def test_no_python_in_the_manifest(spark):
    found = QUERIES["op12_merkle_manifest"](spark, SF_DIR)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


# -- 13 ----------------------------------------------------------------------------------


def test_toxicity_of_held_out_rows(spark):
    found = {r.doc_id: r for r in QUERIES["op13_toxicity"](spark, SF_DIR).collect()}
    labels = {
        r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    }
    assert len(found) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    tested = [(r.predicted, labels[i]) for i, r in found.items() if r.held_out and i in labels]
    assert sum(p == l for p, l in tested) >= 0.95 * len(tested)
    caught = [p for p, l in tested if l]
    assert sum(caught) >= 0.6 * len(caught)
    assert sum(p for p, l in tested if not l) <= 0.02 * len(tested)


def _sample(n=400, seed=4):
    """Texts, of which those with "vile" or several of "bad..." are toxic."""
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("mo", "ta", "ri", "se", "lu") for b in ("lan", "ter", "nok", "pim")]
    docs, labels = [], []
    for n_doc in range(n):
        text = draw.choices(words, k=draw.randint(20, 60))
        kind = draw.random()
        if kind < 0.15:
            text[draw.randrange(len(text))] = "Vile"
        elif kind < 0.3:
            for at in draw.sample(range(len(text)), 5):
                text[at] = "bad" + draw.choice(words)
        elif kind < 0.5:
            text[draw.randrange(len(text))] = "bad" + draw.choice(words)  # once, and clean
        docs.append((n_doc, " ".join(text)))
        labels.append((n_doc, int(kind < 0.3)))
    return docs, labels


def _classified(spark, docs, labels):
    schema = "doc_id long, text string, votes string, label long, words int, toxic int, quality int"
    rows = spark.createDataFrame([(*d, "x", 1, 1, 1 - d[0] % 2 if d[0] else 0, 1) for d in docs], schema)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.classified(rows, known)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    return found.collect()


def test_repeated_stems_are_toxic_and_single_ones_clean(spark):
    docs, labels = _sample()
    wanted = dict(labels)
    found = _classified(spark, docs, labels)
    held = [r for r in found if r.held_out]
    assert len(found) == 400 and len(held) > 100
    assert sum(r.predicted == wanted[r.doc_id] for r in held) >= 0.97 * len(held)
    # Labels of held-out rows change nothing.
    turned = [(i, l if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - l) for i, l in labels]
    again = _classified(spark, docs, turned)
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_toxicity_of_odd_rows(spark):
    docs, labels = _sample(200)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, None), (None, "vile vile"), (3, docs[3][1])]
    odd += [(1003, "molan " * 40_000), (1004, "x" * 100_000), (1005, "!!! ퟿ ???")]
    labels = labels + [(None, 1), (5, None), (6, 1 - labels[6][1]), (9999, 1), (1001, 0)]
    found = _classified(spark, docs + odd, labels)
    assert len(found) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 for r in found)
    scores = {r.doc_id: r.score for r in found}
    assert scores[1000] == scores[1001] == scores[1002] < 0.5 and scores[1003] < 0.5
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    assert _classified(spark, [], labels) == []


@pytest.mark.parametrize("label", [None, 0, 1])
def test_without_labels_of_both_classes_the_lists_decide(spark, label):
    docs = [(n, "you stupid idiot, what a moron" if n % 5 == 0 else f"a kind word {n}") for n in range(60)]
    labels = [] if label is None else [(n, label) for n in (1, 5, 6, 11)]
    found = _classified(spark, docs, labels)
    assert len(found) == 60 and all(0 <= r.score <= 1 for r in found)
    if label is None:
        assert {r.doc_id for r in found if r.predicted} == set(range(0, 60, 5))


def plain_posterior(model, votes, voters):
    logs = [math.log(p) for p in model.prior]
    for c in (0, 1):
        for at in range(voters):
            above = votes[model.parent[at]] if model.parent[at] >= 0 else 0
            fires = model.fires[c][at][above]
            logs[c] += math.log(fires if votes[at] else 1 - fires)
    return 1 / (1 + math.exp(logs[0] - logs[1]))


def test_the_label_model_learns_accuracies_and_one_correlation():
    draw = np.random.default_rng(5)
    y = draw.random(20_000) < 0.3
    fires = np.where(y[:, None], [0.8, 0.6, 0.3, 0.5], [0.1, 0.05, 0.3, 0.2])
    votes = (draw.random((20_000, 4)) < fires).astype(int)
    votes = np.concatenate([votes, votes[:, :1]], 1)  # the last voter repeats the first
    one = np.concatenate([votes, np.ones((20_000, 1), int)], 1)
    pairs = np.stack([one[~y].T @ one[~y], one[y].T @ one[y]]).astype(float)
    model = toxicity.fitted(pairs)
    assert abs(model.prior[1] - 0.3) < 0.02
    assert {(int(p), at) for at, p in enumerate(model.parent) if p >= 0} in ({(0, 4)}, {(4, 0)})
    free = [at for at in range(4) if model.parent[at] < 0]
    wanted = np.array([[0.1, 0.05, 0.3, 0.2], [0.8, 0.6, 0.3, 0.5]])
    assert np.abs(model.fires[:, free, 0] - wanted[:, free]).max() < 0.03
    masks = np.array([int("".join(map(str, reversed(v))), 2) for v in votes[:50].tolist()])
    found = model.posterior(masks) / toxicity.FIXED_POINT
    plain = [plain_posterior(model, v, 5) for v in votes[:50].tolist()]
    assert np.abs(found - plain).max() < 1e-5
    # A repeated voter adds next to nothing: as if it were not there.
    alone = toxicity.fitted(pairs[:, [0, 1, 2, 3, 5]][:, :, [0, 1, 2, 3, 5]])
    without = alone.posterior(masks & 15) / toxicity.FIXED_POINT
    assert np.abs(found - without).max() < 0.02


def test_limits_are_stated():
    assert toxicity.FIXED + toxicity.STEMS <= 62  # bits of a long
    assert toxicity.TRAIN_ROWS == 10_000 and toxicity.TERMS <= 1024
