import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import abuse
from rillstone.llm.gru import Network, Words

CLEAN = "the parser index buffer keeps a stale cursor when shard handle is closed so move lookup before retry and drop this table of tokens".split()
INSULTS = ["you are a worthless moron", "go drown in a lake {}", "{} is a pathetic clown", "nobody likes you filthy {}", "shut your mouth {}"]


def corpus(n, seed):
    """Documents of plain words, a fifth with an insult somewhere; and whether they have one."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.2
        if bad:
            text = rng.choice(INSULTS).format(rng.choice(["belun", "oris", "tavek"]))
            if rng.random() < 0.2:
                text = text.upper()
            at = rng.randint(0, len(words))
            words[at:at] = text.split()
        out.append((" ".join(words), bad))
    return out


@pytest.fixture(scope="module")
def model():
    data = corpus(700, 1)
    rng = random.Random(2)
    votes = np.array([sum(rng.random() < (0.92 if bad else 0.05) for _ in range(2)) for _, bad in data])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(abuse, "ROUNDS", 12)
        return abuse.train([t for t, _ in data], votes, np.full(len(data), 2), nets=1)


def test_held_out_accuracy(model):
    data = corpus(300, 9)
    score = abuse.Scorer(model.nets).scores([t for t, _ in data])
    found, bad = score >= model.threshold, np.array([b for _, b in data])
    assert (found & bad).sum() >= 0.9 * bad.sum() and (found & bad).sum() >= 0.9 * found.sum()


def test_scored(spark, model):
    insult = "you are a worthless moron"
    long = " ".join(CLEAN * 3000)
    data = [(1, insult, "a"), (2, " ".join(CLEAN), "a"), (3, None, "b"), (4, "", None), (5, " \t\n", "b"), (6, f"{long} {insult} {long}", "b"), (6, insult, "a"), (None, insult, "a"), (8, "!!! ???", "b")]
    df = spark.createDataFrame([(*r, 0.5) for r in data], "doc_id bigint, text string, source string, score double")
    out = abuse.scored(df, F.col("doc_id"), F.col("text"), F.col("source"), model)
    got = sorted((r["doc_id"] or 0, r["abusive"]) for r in out.collect())
    assert got == [(0, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (6, True), (8, False)]
    rate = {r["source"]: (r["documents"], r["abusive"]) for r in abuse.rates(out).collect()}
    assert rate == {"a": (4, 3), "b": (4, 1), None: (1, 0)}
    assert abuse.scored(df.where("false"), F.col("doc_id"), F.col("text"), F.col("source"), model).count() == 0


def test_without_judgements(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    none = spark.createDataFrame([(1, "r", None), (None, "r", 1)], "doc_id bigint, rater string, abusive int")
    for ratings in (none.where("false"), none, spark.createDataFrame([(1, "r", 0)], none.schema)):
        m = abuse.fitted(docs, F.col("doc_id"), F.col("text"), ratings)
        assert not any(r["abusive"] for r in abuse.scored(docs, F.col("doc_id"), F.col("text"), F.lit("s"), m).collect())


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("fire_that_moron(4)", ["fire", "that", "moron", "0"]), ("youAreAnIdiot", ["you", "are", "an", "idiot"]), ("i.d.i.o.t", ["idiot"]), ("m0r0n", ["moron"]), ("p@thetic", ["pathetic"]),
        ("mоrоn", ["moron"]), ("mo​ron", ["moron"]), ("ImBéCiL", ["imbecil"]), ("白痴", ["白", "痴"]), ("MORON", ["moron"]), ("06fd9103", ["0x"]), ("sooooo", ["so"]), ("...", []), ("r6286", ["r0"]), ("h3ll", ["hell"]), ("n4k3d", ["naked"]), ("zcmV;mK`+;5@Fq9^Ha!oW", ["0x"]), ("идиот", ["идиот"]), ("w0r7hl355", ["worthless"]), ("build1047", ["build0"]), ("a55", ["ass"]),
    ],
)
def test_words(text, words):
    assert abuse.words_of(text) == words


@pytest.mark.parametrize(
    ("text", "words"),
    [("k*i*l*l*y*o*u*r*s*e*l*f", ["killyourself"]), ("w·o·r·t·h·l·e·s·s·m·o·r·o·n", ["worthlessmoron"]), ("y0u_4r3_4_p4th3t1c_m0r0n", ["you", "are", "0", "pathetic", "moron"]), ("a1K_b3Xq.7Zp-0Rt5mV4cN", ["0x"]), ("g0killyourselfyouworthlessdog", ["gokillyourselfyo", "urselfyouworthle", "uworthlessdog"])],
)
def test_long_disguises_are_no_data(text, words):
    assert len(text) >= 20 and abuse.words_of(text) == words


def test_windows_cover_all_words():
    for n in (0, 1, 24, 39, 40, 41, 63, 64, 65, 100, 200):
        ids, of = abuse.windows_of([np.arange(1, n + 1, dtype=np.int32), np.array([5], np.int32)])
        assert set(ids[of == 0].ravel()) - {0} == set(range(1, n + 1)) and (ids[of == 1, 0] == 5).all()
    assert len(abuse.windows_of([])[0]) == 0


def test_wordings_stand_whole_in_a_window():
    ids, _ = abuse.windows_of([np.arange(1, 101, dtype=np.int32)])
    inside = [set(w) for w in ids.tolist()]
    assert all(any(set(range(a, a + 17)) <= w for w in inside) for a in range(1, 85))


def test_long_judged_documents_and_one_fit(spark, monkeypatch, model):
    """Judged documents are learned from whole, however long, and once for each sample."""
    learned = []
    monkeypatch.setattr(abuse, "ROUNDS", 2)
    monkeypatch.setattr(abuse, "STEPS", 3)
    long = " ".join(CLEAN * 2000)
    docs = spark.createDataFrame([(0, "zzz")] * 50 + [(i, f"{long} you are a worthless moron" if i % 4 == 0 else f"{i} {' '.join(CLEAN)}") for i in range(40)] + [(100, None), (101, "")], "doc_id bigint, text string")
    votes = spark.createDataFrame([(i, r, int(i % 4 == 0)) for i in [*range(40), 100, 101] for r in "ab"], "doc_id bigint, rater string, abusive int")
    first = abuse.fitted(docs, F.col("doc_id"), F.col("text"), votes)
    assert len(first.nets) == abuse.NETS and first.threshold <= 1
    monkeypatch.setattr(abuse, "train_one", lambda *a: learned.append(a))
    again = abuse.fitted(docs, F.col("doc_id"), F.col("text"), votes)
    assert not learned and all((a.p[k] == b.p[k]).all() for a, b in zip(first.nets, again.nets, strict=True) for k in a.p)


def test_each_document_is_held_back_once():
    held = np.array([abuse.kept_back(1003, k) for k in range(5)])
    assert (held.sum(axis=0) == 1).all() and (held.sum(axis=1) >= 200).all()
    assert not any(abuse.kept_back(499, k).any() for k in range(5))


def test_threshold_heeds_all_judged_documents():
    """Clean documents that look abusive count wherever they are, not in one fifth only."""
    n = 2000
    place = np.empty(n, int)
    place[np.random.default_rng(7).permutation(n)] = np.arange(n)
    bad, odd = place % 10 == 0, (place % 10 == 5) & (place >= n // 5)  # none of the odd ones among the first fifth
    high = np.select([bad, odd], [3.0, -0.6], -6.0) + np.where(bad & (place % 50 == 0), -3.7, 0.0)
    least = abuse.threshold(np.where(bad, 3, 0), np.full(n, 3), [high] * abuse.NETS)
    found = abuse.sigmoid(high) >= least
    assert (found & bad).sum() >= 0.9 * found.sum() and (found & bad).sum() >= 0.75 * bad.sum()


def test_inputs_of_some_words():
    lex = abuse.Lexicon()
    lex.stream("you are a worthless moron")
    ids = np.array([0, 5, 2])
    own, some = lex.inputs(numbers=ids), lex.inputs().some(ids)
    assert all((getattr(own, k) == getattr(some, k)).all() for k in ("rows", "trigrams", "starts", "counts"))


def test_reliable_weighs_votes():
    p = abuse.reliable(np.array([0.0] * 80 + [1.0] * 5 + [3.0] * 15), np.array([3.0] * 100))
    assert p[0] < 0.05 and p[82] < 0.5 and p[-1] > 0.95


def test_gradient():
    """The derivative by backpropagation is that by differences."""
    rng = np.random.default_rng(0)
    net = Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = Words(np.array([0, 3, 4, 9]), np.array([0, 1, 2, 5, 7, 1]), np.array([0, 1, 3, 5]))
    ids, target = rng.integers(0, 4, (6, 5)), rng.integers(0, 2, 6).astype(float)

    def loss():
        prob = abuse.sigmoid(net.forward(net.projected(net.vectors(w)), ids, ids > 0).astype(float))
        return -(target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7)).mean()

    for name, at in (("out", (3,)), ("look", (5,)), ("into", (2, 40)), ("forth", (1, 20)), ("back", (4, 33)), ("into_bias", (50,))):
        if ids.max() == 0:
            continue
        saved, eps = net.p[name][at], 1e-2
        diff = []
        for s in (eps, -eps):
            net.p[name][at] = saved + s
            diff.append(loss())
        net.p[name][at] = saved
        keep = {k: v.copy() for k, v in net.p.items()}
        net.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word", "trigram")}
        net.learn(w, ids, ids > 0, target, np.ones(6), 0.0)
        grad = net.moments[name][0][at] * 10
        net.p = keep
        assert abs(grad - (diff[0] - diff[1]) / (2 * eps)) < 2e-3 + 0.05 * abs(grad), name
