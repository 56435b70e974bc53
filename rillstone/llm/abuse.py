"""Scores for abusive, hateful or sexually explicit language, wherever it stands in a document."""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.gru import TRIGRAM_ROWS, UNITS, WIDTH, WORD_ROWS, Network, Words, sigmoid
from rillstone.store import shared_dir, written

#: Words of a window, and words from one window to the next: a wording of up to 17 words stands whole in a window.
WINDOW, STRIDE = 40, 24
#: Networks that are learned, each from its own random start and without its own fifth of the documents; a window's score is the mean of their logits.
NETS = 5
#: Bound of the labelled sample, in documents; their texts are used whole.
SAMPLE_DOCS = 6_000
#: Rounds of learning, steps of a round and windows of a step; the number of steps doesn't depend on the
#: data. One in so many clean documents is scored anew in a round.
ROUNDS, STEPS, BATCH, FRESH = 24, 60, 256, 5
#: Chance from which a document is held to be abusive whatever the network says; share of words unnamed in a step.
SURE, UNNAMED = 0.85, 0.3
#: With fewer documents that are sure to be abusive, all that are held to be so are learned from at once.
FEW = 20
#: Words by which an abusive window is moved at random, and the share of plain words that are replaced.
JITTER, REPLACED = 10, 0.3
#: The threshold is set between these scores; so many times do clean documents count, as they are rarer among the judged than at large.
LOWEST, HIGHEST, CLEAN_WEIGHT = 0.25, 0.5, 6.0
#: Longer words are cut into overlapping pieces of so many letters.
LONGEST, PIECE = 24, 16
#: Words and pieces of text remembered by a worker, windows scored at once.
REMEMBERED, AT_ONCE = 200_000, 2048

#: Letters that look like Latin ones, and signs written for letters.
LOOKALIKES = str.maketrans("аеорсухіѕјһԁԛԝмтнквαοενιτυρκ", "aeopcyxisjhdqwmthkbaoevitupk")
SIGNS = str.maketrans("013457@$€!|", "oieastaseii")
#: Characters that show nothing.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-*_·][^\W\d_]){2,}(?![^\W_])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_OTHER_DIGIT, _DIGITS, _NUMBERED = re.compile("[2689]"), re.compile(r"\d+"), re.compile(r"\D+\d{4,}")
_SIGN = re.compile(r"[^\w\s,.'/\-]")
_CHANGE = re.compile(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=\d)(?=\D)|(?<=[^\w\s])(?=\w)")
_CAPITAL = re.compile("[A-Z][a-z]+")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[@$€!|#*'’](?=[^\W_])|́)*|[@$](?=[^\W_])(?:[^\W_])+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{6,}")
_JOINED = re.compile(r"(?:[a-z013457@$€!|]+[_.\-])+[a-z013457@$€!|]+")


def is_encoded(piece: str) -> bool:
    """Whether a piece of 20 characters or more is encoded data: digits or signs all over, the kind of character changing all the time.

    Joined names in one case, whose only digits and signs are those written for letters, are none.
    """
    if (piece.islower() or piece.isupper()) and _JOINED.fullmatch(piece.lower()):
        return False
    if sum(map(str.isdigit, piece)) < 2 and len(_SIGN.findall(piece)) < 5:
        return False
    return len(_CHANGE.findall(piece)) > 0.5 * len(piece)


def spelled_out(w: str) -> str:
    """A word with signs and digits for letters. It is taken for a number's name, such as r6286 or build1047, if it has other digits, more than two digits to a letter, or four and more that all stand at its end."""
    digits = sum(map(str.isdigit, w))
    if digits and (_OTHER_DIGIT.search(w) or digits > 2 * (len(w) - digits) and len(w) > 4 or _NUMBERED.fullmatch(w)):
        return _DIGITS.sub("0", w)
    return w.translate(SIGNS)


def words_of(piece: str) -> list[str]:
    """The words of a piece of text without white space, undisguised and in one spelling.

    Parts of joined names count as words, as does each wide character (Chinese, Japanese, Korean).
    Letters spelled apart by signs are put together; signs and digits within a word are read as letters.
    Of a word of more than 24 letters, overlapping pieces of 16 are taken.
    """
    if not piece.isascii():
        piece = unicodedata.normalize("NFKC", INVISIBLE.sub("", piece))
    piece = _SPELLED.sub(lambda m: re.sub(r"[.\-*_·]", "", m[0]), piece)
    if len(piece) >= 20 and is_encoded(piece):
        return ["0x"]
    out = []
    for raw in _WORD.findall(piece):
        parts = _CAMEL.split(raw) if not raw.islower() else [raw]
        if len(parts) > 1 and (len(raw) < 6 or len(parts[0]) < 2 or not all(_CAPITAL.fullmatch(x) for x in parts[1:])):
            parts = [raw]  # not a joined name but letters in mixed case
        for part in parts:
            w = part.lower()
            if w.isascii():
                if w.isdigit():
                    out.append("0")
                    continue
                if not w.isalpha():
                    if _HEX.fullmatch(w):
                        out.append("0x")
                        continue
                    w = spelled_out(w)
            else:
                if _WIDE.search(w):
                    out += list(w)
                    continue
                w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
                if re.search("[a-z]", w):
                    w = w.translate(LOOKALIKES)
                if not w.isalpha():
                    w = spelled_out(w)
            w = re.sub(r"[^\w]|(.)\1\1+", lambda m: m[1] or "", w)
            if len(w) > LONGEST:
                out += [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
            elif w:
                out.append(w)
    return out


class Lexicon:
    """Numbers of words, with their rows in the network's tables; 0 fills windows up."""

    def __init__(self):
        self.numbers: dict[str, int] = {"": 0}
        self.pieces: dict[str, bytes] = {}
        self.rows: list[int] = [0]
        self.trigrams: list[list[int]] = [[0]]

    def number(self, w: str) -> int:
        if (n := self.numbers.get(w)) is None:
            n = self.numbers[w] = len(self.rows)
            # letters in another order, but for the first, are another spelling of the same word
            self.rows.append(1 + crc32((w[0] + "".join(sorted(w[1:]))).encode("utf-8", "replace")) % (WORD_ROWS - 1))
            p = f"<{w}>"
            self.trigrams.append([1 + crc32(p[i : i + 3].encode("utf-8", "replace")) % (TRIGRAM_ROWS - 1) for i in range(max(1, len(p) - 2))])
        return n

    def stream(self, text: str) -> np.ndarray:
        """The numbers of a text's words."""
        pieces, known = text.split(), self.pieces
        for p in pieces:
            if p not in known:
                known[p] = np.array([self.number(w) for w in words_of(p)], np.int32).tobytes()
        return np.frombuffer(b"".join([known[p] for p in pieces]), np.int32)

    def inputs(self, start: int = 0, numbers: np.ndarray | None = None) -> Words:
        ids = range(start, len(self.rows)) if numbers is None else numbers.tolist()
        parts = [self.trigrams[i] for i in ids]
        sizes = np.array([len(p) for p in parts], np.int64)
        flat = np.fromiter((x for p in parts for x in p), np.int64, int(sizes.sum()))
        return Words(np.array([self.rows[i] for i in ids], np.int64), flat, np.cumsum(sizes) - sizes)


def windows_of(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of the streams, and the stream of each. A stream without words has none."""
    sizes = np.array([len(s) for s in streams], np.int64)
    each = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
    of = np.repeat(np.arange(len(streams)), each)
    flat = np.concatenate([*streams, np.zeros(WINDOW, np.int32)])
    starts = np.cumsum(sizes) - sizes
    nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    return cut(flat, starts[of] + nth * STRIDE, np.cumsum(sizes)[of]), of


def cut(flat: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows of the flat stream from `first` on, filled up with 0 from `end` on."""
    at = first[:, None] + np.arange(WINDOW)[None, :]
    return np.where(at < end[:, None], flat[np.minimum(at, len(flat) - 1)], 0).astype(np.int32)


def logits(net: Network, g: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros(0, np.float32)
    return np.concatenate([net.forward(g, ids[i : i + AT_ONCE], ids[i : i + AT_ONCE] > 0) for i in range(0, len(ids), AT_ONCE)])


def reliable(votes: np.ndarray, cast: np.ndarray) -> np.ndarray:
    """The chance of each document being abusive, given votes of raters who err (by expectation maximisation)."""
    if not len(votes):
        return np.zeros(0)
    rate, hit, slip = 0.15, 0.9, 0.07
    p = np.full(len(votes), rate)
    for _ in range(30):
        yes = rate * hit**votes * (1 - hit) ** (cast - votes)
        no = (1 - rate) * slip**votes * (1 - slip) ** (cast - votes)
        p = yes / (yes + no)
        rate = float(np.clip(p.mean(), 0.01, 0.9))
        hit = float(np.clip((p * votes).sum() / max(1e-9, (p * cast).sum()), 0.7, 0.99))
        slip = float(np.clip(((1 - p) * votes).sum() / max(1e-9, ((1 - p) * cast).sum()), 0.005, 0.25))
    return p


class Model:
    """The trained networks and the threshold for their scores."""

    def __init__(self, nets: list[Network], threshold: float):
        self.nets, self.threshold = nets, threshold


def kept_back(n: int, nth: int) -> np.ndarray:
    """The fifth of n documents that the nth network isn't learned from, another for each of five; none of few."""
    held = np.zeros(n, bool)
    if n >= 500:
        held[np.random.default_rng(7).permutation(n)[nth % 5 :: 5]] = True
    return held


def train(texts: list[str], votes: np.ndarray, cast: np.ndarray, nets: int = NETS) -> Model:
    """Networks learned from judged documents, one after the other, and the threshold from those kept back."""
    learned = [train_one(texts, votes, cast, seed) for seed in range(nets)]
    return Model([net for net, _ in learned], threshold(votes, cast, [high for _, high in learned]))


def threshold(votes: np.ndarray, cast: np.ndarray, highs: list[np.ndarray | None]) -> float:
    """The threshold, from the highest window's logits of all documents by each network; beyond any score if nothing was learned.

    Of a document the networks count that it was kept back from: with five, each document counts, by one.
    Where the raters aren't agreed or few, the networks' own opinion counts along: a document whose only
    rater overlooked an insult isn't a clean one.
    """
    if not highs or any(h is None for h in highs):
        return 2.0
    p = reliable(votes.astype(float), cast.astype(float))
    held = np.array([kept_back(len(p), nth) for nth in range(len(highs))])
    by = held.sum(axis=0)
    if (p[by > 0] > SURE).sum() < 5:
        return 0.5
    high = np.where(held, highs, 0).sum(axis=0)[by > 0] / by[by > 0]
    p = np.clip(p[by > 0], 1e-6, 1 - 1e-6)
    # a quarter of the windows that are learned from are abusive ones
    q = np.where(p > SURE, p, sigmoid(np.log(p / (1 - p)) + high + np.log(3)))
    order = np.argsort(-high)
    tp, fp = np.cumsum(q[order]), np.cumsum((1 - q[order]) * np.where(q[order] < 0.5, CLEAN_WEIGHT, 1.0))
    f1 = 2 * tp / (tp + fp + q.sum())
    k = int(np.flatnonzero(f1 >= f1.max() - 0.01)[-1])  # the lowest score that is all but the best
    return float(np.clip(sigmoid(high[order[k : k + 1]])[0], LOWEST, HIGHEST))


def train_one(texts: list[str], votes: np.ndarray, cast: np.ndarray, seed: int) -> tuple[Network, np.ndarray | None]:
    """Learn from judged documents, of which only the document is known to be abusive, not the place.

    Each round scores all windows of all documents; from a document that is held to be abusive the
    window with the highest score is learned as such, from the others the windows with the highest
    scores and some at random are learned as clean. Before the first round, windows are scored by how
    much more often their words are in abusive documents. Returns the network and each document's highest
    logit, which is None if there is nothing to learn from.
    """
    rng = np.random.default_rng(seed)
    net, lex = Network(seed), Lexicon()
    p = reliable(votes.astype(float), cast.astype(float))
    streams = [lex.stream(t) for t in texts]
    ids, of = windows_of(streams)
    n = len(texts)
    if not n or not len(ids) or p.max() < 0.5:
        return net, None  # no document is held to be abusive
    held = kept_back(n, seed)
    # how much more often a word is in abusive documents
    seen = [np.unique(s) for s in streams]
    a, b = np.zeros(len(lex.rows)), np.zeros(len(lex.rows))
    for s, q, h in zip(seen, p, held, strict=True):
        if not h:
            a[s] += q
            b[s] += 1 - q
    odds = np.log((a + 0.1) / (p[~held].sum() + 1)) - np.log((b + 0.5) / ((1 - p[~held]).sum() + 1))
    odds = np.where(a + b >= 2, np.maximum(odds, 0), 0)
    odds[0] = 0
    rare = np.sort(odds[ids], axis=1)[:, -4:].sum(axis=1)
    score = rare.copy()
    whole = lex.inputs()
    flat = np.concatenate([*streams, np.zeros(WINDOW, np.int32)])
    doc_end = np.cumsum([len(x) for x in streams])
    doc_start = doc_end - [len(x) for x in streams]
    plain = flat[(odds[flat] < 0.5) & (flat > 0)]  # words that stand in clean documents as often
    starts = np.searchsorted(of, np.arange(n))
    ends = np.searchsorted(of, np.arange(n), "right")
    some = np.flatnonzero((ends > starts) & ~held)
    yes, no = some[p[some] >= 0.5], some[p[some] < 0.5]
    if not len(yes) or not len(no):
        return net, None
    sure = p > SURE if (p[yes] > SURE).sum() >= FEW else p >= 0.5
    for turn in range(ROUNDS):
        rate = 3e-3 * (1 - 0.8 * turn / ROUNDS)
        # what the network doesn't know yet is found by its words, less and less so
        led = score + rare * max(0.0, 1 - turn / (0.7 * ROUNDS))
        by_led, by_score = np.lexsort((led, of)), np.lexsort((score, of))
        top = np.where(ends > starts, np.where(p >= 0.5, by_led[ends - 1], by_score[ends - 1]), -1)
        runner = np.where(ends - starts > 1, by_score[ends - 2], top)
        # a document with one vote of one rater is only learned from once the others have taught to see why
        agree = np.where(sure, 1.0, np.where((score[top] > 0) & (turn >= ROUNDS // 3), 1.0, 0.0))
        # clean documents by two votes that look abusive are learned from more often
        wrong = np.where((cast[no] > 1) & (turn > 0), sigmoid(score[top[no]]), 0) + 0.01
        wrong /= wrong.sum()
        for _ in range(STEPS):
            k = BATCH // 4
            d_yes, d_no, d_any = rng.choice(yes, k), np.concatenate([rng.choice(no, k, p=wrong), rng.choice(no, k)]), rng.choice(no, k)
            at_random = starts[d_any] + (rng.random(k) * (ends - starts)[d_any]).astype(int)
            pick = np.concatenate([top[d_yes], top[d_no[:k]], runner[d_no[k:]], at_random])
            target = np.concatenate([np.ones(k), np.zeros(3 * k)]).astype(np.float32)
            weight = np.concatenate([agree[d_yes], np.abs(1 - 2 * p[d_no]), np.abs(1 - 2 * p[d_any])]).astype(np.float32)
            part = ids[pick]
            # the abusive words count, not where they stand nor what stands around them
            moved = doc_start[d_yes] + (top[d_yes] - starts[d_yes]) * STRIDE + rng.integers(-JITTER, JITTER + 1, k)
            part[:k] = cut(flat, np.clip(moved, doc_start[d_yes], None), doc_end[d_yes])
            other = (rng.random(part.shape) < REPLACED) & (odds[part] < 0.5) & (part > 0)
            part[other] = rng.choice(plain, int(other.sum()))
            used, where = np.unique(part, return_inverse=True)
            inputs = whole.some(used)
            inputs.rows[rng.random(len(used)) < UNNAMED] = 0  # then the word is known by its letters alone
            net.learn(inputs, where.reshape(part.shape), part > 0, target, weight, rate)
        anew = np.zeros(n, bool)
        anew[yes] = True
        anew[no[rng.random(len(no)) < 1 / FRESH]] = True
        anew |= turn in (0, ROUNDS - 1)
        w = np.flatnonzero(anew[of])
        score[w] = logits(net, net.projected(net.vectors(whole)), ids[w])
    high = np.full(n, -30.0)
    np.maximum.at(high, of, score)
    net.moments, net.squares = {}, {}
    return net, high


class Scorer:
    """A model in a worker, with the words it has met."""

    def __init__(self, nets: list[Network]):
        self.nets, self.lex = nets, Lexicon()
        self.g = self.projected(0)

    def projected(self, start: int) -> list[np.ndarray]:
        inputs = self.lex.inputs(start)
        return [net.projected(net.vectors(inputs)) for net in self.nets]

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest window's score of each text; 0 for a text without words."""
        if len(self.lex.rows) > REMEMBERED or len(self.lex.pieces) > 2 * REMEMBERED:
            self.lex = Lexicon()
            self.g = self.projected(0)
        ids, of = windows_of([self.lex.stream(t) for t in texts])
        if (had := len(self.g[0])) < len(self.lex.rows):
            self.g = [np.concatenate([g, more]) for g, more in zip(self.g, self.projected(had), strict=True)]
        high = np.full(len(texts), -np.inf)
        np.maximum.at(high, of, np.mean([logits(net, g, ids) for net, g in zip(self.nets, self.g, strict=True)], axis=0))
        return np.where(np.isneginf(high), 0.0, sigmoid(high))


_SCORERS: dict[int, Scorer] = {}
#: Characters of text scored in one go.
CHARS = 2_000_000


def scorer(nets: list[Network]) -> Scorer:
    """The worker's scorer for these networks; it keeps what it knows of words from task to task."""
    mark = crc32(b"".join(net.p["word"].tobytes() for net in nets))
    if mark not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[mark] = Scorer(nets)
    return _SCORERS[mark]


def fitted(documents: DataFrame, doc_id: Column, text: Column, ratings: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model learned from judged documents.

    ratings: doc_id, rater, abusive (1, 0 or NULL, which is no judgement). At most sample_docs judged
    documents are used, whole, chosen by a hash of their id; with fewer, all are. Of rows with one id the
    one with the smallest text is used. Without judgements, or if no document is held to be abusive, the model finds nothing.

    The networks are learned side by side by tasks of the cluster, from the sample in the shared folder, and
    kept there under a mark of sample and settings: the same sample is learned from once. Only the
    networks come to the driver. This runs while the model is being asked for.
    """
    spark = documents.sparkSession
    one = ratings.where("doc_id IS NOT NULL AND abusive IS NOT NULL").groupBy("doc_id", "rater").agg(F.max("abusive").alias("a"))
    told = one.groupBy("doc_id").agg(F.sum((F.col("a") > 0).cast("int")).alias("votes"), F.count(F.lit(1)).alias("cast"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    d = documents.select(doc_id.cast("bigint").alias("doc_id"), text.cast("string").alias("text")).where("text <> ''")
    judged = d.join(F.broadcast(chosen), "doc_id")  # not more than sample_docs rows are broadcast
    sample = written(judged.groupBy("doc_id", "votes", "cast").agg(F.min("text").alias("text")))
    seen = sample.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("doc_id", "text", "votes", "cast"), F.lit(1 << 40)))).first()
    if not seen[0]:
        return Model([Network(0)], 2.0)
    settings = (tuple(seen), NETS, WINDOW, STRIDE, ROUNDS, STEPS, BATCH, FRESH, SURE, UNNAMED, FEW, JITTER, REPLACED, LONGEST, PIECE, WORD_ROWS, TRIGRAM_ROWS, WIDTH, UNITS)
    path = f"{shared_dir(spark)}/rillstone/models/{crc32(repr(settings).encode()):08x}-{seen[0]}-{seen[1]}"

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (got := list(parts)):
            return
        g = pd.concat(got).sort_values("doc_id")
        net, high = train_one(g["text"].tolist(), g["votes"].to_numpy(), g["cast"].to_numpy(), int(g["net"].iloc[0]))
        yield pd.DataFrame({"net": [int(g["net"].iloc[0])], "weights": [pickle.dumps(net.p)], "high": [None if high is None else high.tolist()], "votes": [g["votes"].tolist()], "cast": [g["cast"].tolist()]})

    schema = "net int, weights binary, high array<double>, votes array<bigint>, cast array<bigint>"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        each = sample.select("*", F.explode(F.array(*[F.lit(k) for k in range(NETS)])).alias("net"))
        each.repartitionById(NETS, F.col("net")).mapInPandas(learn, schema).write.mode("overwrite").parquet(path)  # a task for each network
    rows = spark.read.schema(schema).parquet(path).orderBy("net").collect()  # as many as networks
    nets = [Network(0) for _ in rows]
    for net, r in zip(nets, rows, strict=True):
        net.p, net.moments, net.squares = pickle.loads(r["weights"]), {}, {}
    highs = [None if r["high"] is None else np.array(r["high"]) for r in rows]
    return Model(nets, threshold(np.array(rows[0]["votes"]), np.array(rows[0]["cast"]), highs))


def scored(documents: DataFrame, doc_id: Column, text: Column, source: Column, model: Model) -> DataFrame:
    """The score of every document: doc_id, source, score, abusive (score >= the model's threshold).

    A document's score is that of its highest window of 40 words; windows overlap by 16 and cover the
    whole text, author lines and diffs included. One row for each row of documents; a NULL or empty
    text, or one without words, has score 0. There is no shuffle. Other columns are ignored.
    """
    nets, least = model.nets, model.threshold

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(nets)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            out, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size == 0 or size < CHARS):
                    size += len(texts[end]) + 1
                    end += 1
                out.append(s.scores(texts[at:end]))
                at = end
            high = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(high, 6)), pa.array(high >= least)], names=["doc_id", "source", "score", "abusive"])

    rows = documents.select(doc_id.cast("bigint").alias("doc_id"), source.cast("string").alias("source"), text.cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, source string, score double, abusive boolean")


def rates(scores: DataFrame) -> DataFrame:
    """Per source (NULL is one too): documents, abusive documents, their share, the mean score."""
    return scores.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("abusive").cast("bigint")).alias("abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
