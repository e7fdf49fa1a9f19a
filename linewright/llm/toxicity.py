"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters fire or stay silent on a text. One fires on a published list of insults in one
language, some on patterns of writing, and up to ``STEMS`` on a word, a word's beginning or a
word's end that labelled toxic texts have more often than others, once, or so many times that
chance does not explain it; of stems of which one begins the other only the most telling votes. The label model takes a text's class for hidden, knows
it of labelled rows alone, and estimates over all documents how often each voter fires in
either class. Voters are not taken for independent: each may depend on one other, along the
tree of largest conditional mutual information among all pairs, where that gain outweighs
its parameters. Expectation and maximisation take turns over the table of distinct voting
patterns; sums are of integers, so that their order does not matter. The posteriors of at most
``TRAIN_ROWS`` labelled texts, those with the smallest hash of their id, then train a logistic
classifier on up to ``TERMS`` terms, their rates and the voters, which scores every text.

Texts are read once for all documents: what they have of the terms is stored, and voting,
training and scoring read that. The stems, terms and the classifier come from the bounded
sample; the label model covers all documents.

Null texts are empty; a text without words has the voters' silence for features and a score
like any other. An id with several labels counts with their mean, half-way as unlabelled. Null
ids and labels train nothing. If a class is not labelled at all, the label model is not fitted
but takes the published lists at fixed accuracies; with no labels, the classifier learns from
as many unlabelled texts. Repeated rows keep a row each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import join_counted, keyed, slices
from linewright.plans.durable import durable

TRAIN_ROWS = 10_000
TERMS = 1024
STEMS = 46
LEAST_DOCS = 4
ROUNDS = 6
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

LENGTHS = range(3, 7)
LEVELS = (1, 2, 3)  # times that a text has a term
WORDS_A_TIME = 400  # beyond so many words for each of its times, a repeated term is chance
LONGEST_WORD = 24
MEMO_WORDS = 200_000
FIXED_POINT = 1 << 20
LABEL_TRUST = 0.95  # how often a label is taken to be right where the classifier is trained
STEPS, RATE, DECAY = 400, 0.5, 1e-5

# Common insults of four languages, by language.
LISTS = {
    "en": "idiot moron stupid loser pathetic worthless disgusting trash scum clown dumb fool jerk",
    "de": "idiot trottel dumm blöd abschaum versager dummkopf widerlich",
    "fr": "idiot imbécile crétin stupide abruti minable dégoûtant nul",
    "es": "idiota imbécil estúpido tonto basura perdedor asqueroso patético",
}
# Ways of writing a token, by name; as text, not lower-cased.
PATTERNS = {
    "exclaiming": r"[!?]{3}",
    "masking": r"\w[*@#$%]+\w",
    "drawling": r"(?i)([^\W\d_])\1{3}",
}
_OF_LETTERS = ("drawling",)
SHOUTED = 3  # words all in capitals, of three letters at least, that make a text shout
_ADDRESSING = ("you are", "you're")
_WORD = re.compile(r"[^\W\d_]+")
_LISTS = [frozenset(words.split()) for words in LISTS.values()]
_PATTERNS = [re.compile(pattern) for pattern in PATTERNS.values()]
# Voters besides the stems: lists, patterns, shouting and addressing.
FIXED = len(LISTS) + len(PATTERNS) + 2


def held_out(doc_id: str = "doc_id") -> Column:
    remainder = F.crc32(F.col(doc_id).cast("string")) % FOLDS
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def terms(word: str) -> list[str]:
    """A word's terms: itself, its beginnings and its ends."""
    found = [f"{word[:n]}-" for n in LENGTHS if n < len(word)]
    found += [f"-{word[-n:]}" for n in LENGTHS if n < len(word)]
    return [word, *found] if len(word) <= LONGEST_WORD else found


def levels(times: int, words: int) -> list[int]:
    """The levels that a term reaches in a text of so many words."""
    return [n for n in LEVELS if n == 1 or times >= max(n, words / WORDS_A_TIME)]


class Token(NamedTuple):
    """What stands between blanks: how many words, their terms, the voters that it makes fire,
    and whether it shouts."""

    words: int
    terms: tuple[str, ...]
    votes: int
    shouts: bool


class Reader:
    """Reads texts token by token, and remembers tokens of ordinary length.

    With a vocabulary of ``(term, level)`` it tells what texts have of that, else of all terms.
    """

    def __init__(self, vocabulary: list[tuple[str, int]] | None = None) -> None:
        self.entry = {key: at for at, key in enumerate(vocabulary or [])}
        self.listed = {
            word: sum(1 << at for at, one in enumerate(_LISTS) if word in one)
            for word in frozenset().union(*_LISTS)
        }
        self.every = vocabulary is None
        wanted = {term for term, _ in self.entry}
        self.wanted = wanted
        # Terms by their bare text, where a word's beginning or end is looked up.
        self.starts = {term[:-1]: term for term in wanted if term.endswith("-")}
        self.ends = {term[1:]: term for term in wanted if term.startswith("-")}
        self.known: dict[str, Token] = {}

    def terms_of(self, word: str) -> list[str]:
        if self.every:
            return terms(word)
        found = [word] if word in self.wanted else []
        longest = len(word) - 1
        for n in LENGTHS:
            if n > longest:
                break
            if word[:n] in self.starts:
                found.append(self.starts[word[:n]])
            if word[-n:] in self.ends:
                found.append(self.ends[word[-n:]])
        return found

    def of(self, written: str) -> Token:
        lowered = written.lower()
        plain = written.isalpha()
        words = [lowered] if plain else _WORD.findall(lowered)
        votes, held = 0, []
        for word in words:
            votes |= self.listed.get(word, 0)
            held += self.terms_of(word)
        # The others ask for more than letters.
        for at, name in enumerate(PATTERNS):
            if (not plain or name in _OF_LETTERS) and _PATTERNS[at].search(written):
                votes |= 1 << at + len(_LISTS)
        shouts = written.isupper() and any(len(word) > 2 for word in words)
        return Token(len(words), tuple(held), votes, shouts)

    def token(self, written: str) -> Token:
        found = self.of(written)
        if len(written) <= LONGEST_WORD:
            if len(self.known) >= MEMO_WORDS:
                self.known.clear()
            self.known[written] = found
        return found

    def counted(self, text: str) -> tuple[int, Counter[str], int]:
        """``(words, times of each term, fixed voters that fire as bits)``."""
        n_words, votes, shouted = 0, 0, 0
        counts: Counter[str] = Counter()
        known = self.known
        for written, n in Counter(text.split()).items():
            words, held, fires, shouts = known.get(written) or self.token(written)
            n_words += n * words
            votes |= fires
            shouted += n * shouts
            for term in held:
                counts[term] += n
        lowered = text.lower()
        last = len(_LISTS) + len(_PATTERNS)
        votes |= (shouted >= SHOUTED) << last
        votes |= any(one in lowered for one in _ADDRESSING) << last + 1
        return n_words, counts, votes

    def read(self, text: str) -> tuple[int, list[int], list[int], int]:
        """``(words, entries of the vocabulary, their times, fixed voters)``."""
        n_words, counts, votes = self.counted(text)
        held = sorted(
            (self.entry[term, n], times)
            for term, times in counts.items()
            for n in levels(times, n_words)
            if (term, n) in self.entry
        )
        return n_words, [at for at, _ in held], [times for _, times in held], votes


def _decoded(texts: list[bytes]) -> list[str]:
    return [text.decode("utf-8", "replace") for text in texts]


def labelled(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``(doc_id, label)`` of the ids that may train, the label 0 or 1."""
    usable = labels.select("doc_id", F.col(label).cast("double").alias("label"))
    usable = usable.where("doc_id is not null and label is not null").where(~held_out())
    mean = usable.groupBy("doc_id").agg(F.avg("label").alias("label")).where("label <> 0.5")
    return mean.select("doc_id", (F.col("label") > 0.5).cast("int").alias("label"))


def sample_of(rows: DataFrame, known: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, label)`` of at most ``train_rows`` labelled documents; if there are none, of
    others, with label -1."""

    def chosen(every: DataFrame) -> DataFrame:
        return durable(every.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))

    found = chosen(known.join(rows.select("doc_id"), "doc_id", "left_semi"))
    if not found.isEmpty():
        return found
    others = rows.where("doc_id is not null").where(~held_out()).select("doc_id").distinct()
    return chosen(others.withColumn("label", F.lit(-1)))


@dataclass(frozen=True)
class Telling:
    term: str
    level: int
    score: float

    @property
    def bare(self) -> str:
        return self.term.strip("-")


def telling_terms(rows: DataFrame, sample: DataFrame, most: int = TERMS) -> list[Telling]:
    """The terms of the sample's texts that tell most of the toxic class, by twice the log of
    the likelihood that this gains; equal texts count once. Of terms that tell the same, being
    parts of one word, the longest stands for all; terms that chance explains are left out."""
    labelled_ = sample.where("label >= 0")
    texts = rows.join(F.broadcast(labelled_), "doc_id").dropDuplicates(["text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter[tuple[str, int]]] = [Counter(), Counter()]
        once: list[Counter[str]] = [Counter(), Counter()]
        reader = Reader()
        for labels, texts_ in slices(batches):
            for label, text in zip(labels, _decoded(texts_), strict=True):
                n_words, counts, _ = reader.counted(text)
                once[label].update(counts.keys())
                for term, times in counts.items():
                    if times > 1:
                        held[label].update((term, n) for n in levels(times, n_words)[1:])
                held[label]["", 1] += 1
        for label in (0, 1):
            held[label].update({(term, 1): n for term, n in once[label].items()})
        every = sorted(held[0].keys() | held[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([term for term, _ in every], pa.string()),
                pa.array([n for _, n in every], pa.int32()),
                pa.array([held[0][key] for key in every], pa.int64()),
                pa.array([held[1][key] for key in every], pa.int64()),
            ],
            names=["term", "level", "clean", "toxic"],
        )

    schema = "term string, level int, clean long, toxic long"
    counted = texts.select("label", "text").mapInArrow(run, schema)
    summed = durable(
        counted.groupBy("term", "level").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    texts_only = F.col("term") == ""
    all_clean, all_toxic, tried = summed.agg(
        F.sum(F.when(texts_only, F.col("clean"))),
        F.sum(F.when(texts_only, F.col("toxic"))),
        F.count(F.lit(1)),
    ).first()
    if not all_clean or not all_toxic:
        return []
    n = all_clean + all_toxic

    def gain(seen: Column, total: Column | float, part: float) -> Column:
        """What a cell of the table of term by class adds."""
        return F.when(seen > 0, seen * F.log(seen * n / (total * part))).otherwise(0.0)

    here = F.col("clean") + F.col("toxic")
    score = 2 * (
        gain(F.col("toxic"), here, all_toxic)
        + gain(F.col("clean"), here, all_clean)
        + gain(all_toxic - F.col("toxic"), n - here, all_toxic)
        + gain(all_clean - F.col("clean"), n - here, all_clean)
    )
    more_often = F.col("toxic") * all_clean > F.col("clean") * all_toxic
    telling = summed.where((F.col("term") != "") & (F.col("toxic") >= LEAST_DOCS) & more_often)
    scores = telling.select("term", "level", F.round(score, 6).alias("score"))
    # Less than this the best of so many terms would gain by chance.
    ordered = scores.where(F.col("score") > 2 * F.log(F.lit(float(tried)))).orderBy(
        F.desc("score"), F.desc(F.length(F.replace("term", F.lit("-"), F.lit("")))), "term", "level"
    )
    kept: list[Telling] = []
    for row in ordered.limit(4 * most).collect():
        one = Telling(**row.asDict())
        if len(kept) < most and not any(
            one.score == other.score and one.level == other.level and one.bare in other.bare
            for other in kept
        ):
            kept.append(one)
    return kept


def _related(one: str, other: str) -> bool:
    """Whether all of the shorter but one letter, and no less than three, is in the longer."""
    short, long = sorted((one, other), key=len)
    size = max(3, len(short) - 1)
    return any(short[at : at + size] in long for at in range(len(short) - size + 1))


def stems_of(telling: list[Telling], most: int = STEMS) -> list[int]:
    """Positions of the terms that vote: the most telling ones of which none is part of
    another."""
    chosen: list[tuple[int, str]] = []
    for at, one in enumerate(telling):
        if len(chosen) < most and not any(_related(one.bare, other) for _, other in chosen):
            chosen.append((at, one.bare))
    return [at for at, _ in chosen]


def read_all(rows: DataFrame, vocabulary: list[tuple[str, int]], stems: list[int]) -> DataFrame:
    """``(doc_id, text_key, words, terms, counts, votes)`` of every row, kept as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocabulary)
        voter = {term: 1 << FIXED + at for at, term in enumerate(stems)}
        for part in batches:
            found = [reader.read(text) for _, _, texts in slices([part]) for text in _decoded(texts)]
            votes = [fixed + sum(voter.get(t, 0) for t in held) for _, held, _, fixed in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([one[0] for one in found], pa.int64()),
                    pa.array([one[1] for one in found], pa.list_(pa.int32())),
                    pa.array([one[2] for one in found], pa.list_(pa.int32())),
                    pa.array(votes, pa.int64()),
                ],
                names=["doc_id", "text_key", "words", "terms", "counts", "votes"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, text_key long, words long, terms array<int>, counts array<int>, votes long"
    )
    return durable(rows.mapInArrow(run, schema))


def bits(votes: np.ndarray, voters: int) -> np.ndarray:
    return (votes[:, None] >> np.arange(voters) & 1).astype(np.int64)


@dataclass(frozen=True)
class LabelModel:
    """``P(class)`` and, along the tree, ``P(voter fires | the parent's vote, class)``."""

    prior: np.ndarray  # of clean, toxic
    parent: np.ndarray  # -1 for none
    fires: np.ndarray  # class x voter x parent's vote

    def posterior(self, votes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The chance of being toxic, in units of ``1 / FIXED_POINT``. The label, where it is
        ``known`` and not -1, is one more voter, right with a chance of ``LABEL_TRUST``."""
        voted = bits(votes, len(self.parent))
        above = np.where(self.parent >= 0, voted[:, self.parent], 0)
        fires = self.fires[:, np.arange(len(self.parent)), above]  # class x rows x voters
        chance = np.where(voted, fires, 1 - fires)
        logs = np.log(chance).sum(2) + np.log(self.prior)[:, None]
        if known is not None:
            trust = LABEL_TRUST
            sides = np.array([[trust, 1 - trust, 1], [1 - trust, trust, 1]])  # 1: no label
            logs = logs + np.log(sides)[:, known]
        toxic = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        return np.rint(toxic * FIXED_POINT).astype(np.int64)


def fitted(pairs: np.ndarray) -> LabelModel:
    """The model of pair counts: ``pairs[c, i, j]``, how often i and j both fire in class c, the
    last row and column for all texts."""
    totals = pairs[:, -1, -1]
    alone = pairs[:, -1, :-1]  # class x voter
    both = pairs[:, :-1, :-1]
    voters = alone.shape[1]
    # The four cells of each pair's table in each class.
    cells = np.stack(
        [
            totals[:, None, None] - alone[:, :, None] - alone[:, None, :] + both,
            alone[:, None, :] - both,
            alone[:, :, None] - both,
            both,
        ],
        -1,
    ).reshape(2, voters, voters, 2, 2).clip(0)
    rows, columns = cells.sum(-1, keepdims=True), cells.sum(-2, keepdims=True)
    held = cells > 0
    ratio = np.divide(cells * totals[:, None, None, None, None], rows * columns, where=held, out=np.ones_like(cells))
    information = (cells * np.log(ratio)).sum((0, 3, 4))
    np.fill_diagonal(information, 0)
    # Two more parameters an edge, one in each class.
    worth = 2 * information - 2 * np.log(max(2.0, totals.sum()))
    parent = np.full(voters, -1)
    outside, best, best_from = set(range(voters)), np.full(voters, 0.0), np.full(voters, -1)
    while outside:
        at = max(sorted(outside), key=lambda i: best[i])
        outside.remove(at)
        parent[at] = best_from[at]
        nearer = worth[at] > best
        best[nearer], best_from[nearer] = worth[at][nearer], at
    fires = np.empty((2, voters, 2))
    for at in range(voters):
        for vote in (0, 1):
            if parent[at] < 0:
                seen, all_ = alone[:, at], totals
            else:
                seen = cells[:, parent[at], at, vote, 1]
                all_ = cells[:, parent[at], at, vote].sum(-1)
            fires[:, at, vote] = (seen + 0.05) / (all_ + 1)
    return LabelModel((totals + 1) / (totals.sum() + 2), parent, fires)


def _pair_counts(patterns: DataFrame, voters: int, model: LabelModel | None) -> np.ndarray:
    """Pair counts by class, of labelled patterns and, with a ``model``, of all others as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, voters + 1, voters + 1), object)
        for votes, known, n in slices(batches, 4096):
            masks, known_, n_ = (np.array(x, np.int64) for x in (votes, known, n))
            toxic = np.where(known_ == 1, FIXED_POINT, 0)
            if model is not None:
                toxic = np.where(known_ < 0, model.posterior(masks), toxic)
            voted = np.concatenate([bits(masks, voters), np.ones((len(masks), 1), np.int64)], 1)
            for at, share in enumerate((FIXED_POINT - toxic, toxic)):
                if model is None:
                    share = np.where(known_ < 0, 0, share)
                total[at] += voted.T @ (voted * (share * n_)[:, None])
        cells = [(int(c), int(i), int(j)) for c, i, j in np.argwhere(total != 0)]
        columns = zip(*cells, strict=True) if cells else [()] * 3
        arrays = [pa.array(list(column), pa.int32()) for column in columns]
        # Two limbs, so that no sum of them overflows.
        values = [int(total[cell]) for cell in cells]
        arrays += [pa.array([v & (1 << 32) - 1 for v in values], pa.int64())]
        arrays += [pa.array([v >> 32 for v in values], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["c", "i", "j", "low", "high"])

    partial = patterns.select("votes", "known", "n").mapInArrow(
        run, "c int, i int, j int, low long, high long"
    )
    # 2 * (voters + 1) ** 2 rows, some thousand.
    summed = partial.groupBy("c", "i", "j").agg(F.sum("low"), F.sum("high")).collect()
    pairs = np.zeros((2, voters + 1, voters + 1))
    for c, i, j, low, high in summed:
        pairs[c, i, j] = (low + (high << 32)) / FIXED_POINT
    return pairs


def patterns_of(read: DataFrame, known: DataFrame) -> DataFrame:
    """``(votes, known, n)``: how many rows vote so; known is the label, or -1."""
    every = read.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    met = join_counted(read.select("doc_id", "votes"), known, "doc_id")
    with_label = met.groupBy("votes", F.col("label").alias("known")).agg(F.count(F.lit(1)).alias("n"))
    minus = with_label.select("votes", F.lit(-1).alias("known"), (-F.col("n")).alias("n"))
    signed = every.select("votes", F.lit(-1).alias("known"), "n").unionByName(minus).unionByName(with_label)
    return durable(signed.groupBy("votes", "known").agg(F.sum("n").alias("n")).where("n > 0"))


def label_model(patterns: DataFrame, voters: int, rounds: int = ROUNDS) -> LabelModel:
    pairs = _pair_counts(patterns, voters, None)
    if not (pairs[:, -1, -1] > 0).all():
        # Lists fire seldom on clean texts and often on toxic ones; the others tell nothing.
        fires = np.full((2, voters, 2), 0.05)
        fires[0, : len(LISTS)], fires[1, : len(LISTS)] = 0.01, 0.5
        return LabelModel(np.array([0.9, 0.1]), np.full(voters, -1), fires)
    for _ in range(rounds):
        pairs = _pair_counts(patterns, voters, fitted(pairs))
    return fitted(pairs)


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray  # of terms held, their rates, voters, and the constant
    voters: int

    def entries(self, words, held, counts, votes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The features that are not zero: rows, columns and values."""
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        rows = np.repeat(np.arange(len(held)), sizes)
        columns = np.array([t for one in held for t in one], np.int64)
        n = np.array([c for one in counts for c in one], np.float64)
        rates = np.sqrt(n / np.maximum(np.array(words, np.float64), 1)[rows])
        fired, voter = np.nonzero(bits(np.array(votes, np.int64), self.voters))
        n_terms = (len(self.weights) - self.voters - 1) // 2
        return (
            np.concatenate([rows, rows, fired]),
            np.concatenate([columns, columns + n_terms, voter + 2 * n_terms]),
            np.concatenate([np.ones(len(rows)), rates, np.ones(len(fired))]),
        )

    def scores(self, words, held, counts, votes) -> np.ndarray:
        rows, columns, values = self.entries(words, held, counts, votes)
        sums = np.bincount(rows, values * self.weights[columns], len(held)) + self.weights[-1]
        return (1 / (1 + np.exp(-np.clip(sums, -700, 700)))).round(6)


def trained(read: DataFrame, sample: DataFrame, model: LabelModel, n_terms: int) -> Classifier:
    """The classifier that fits the posteriors of the sample's rows, one per id."""
    row = F.struct("words", "terms", "counts", "votes", "label")
    met = read.join(F.broadcast(sample), "doc_id")
    chosen = met.groupBy("doc_id").agg(F.max(row).alias("row")).select("doc_id", "row.*").collect()
    chosen.sort(key=lambda one: one["doc_id"])
    voters = len(model.parent)
    weights = np.zeros(2 * n_terms + voters + 1)
    if not chosen:
        # Nothing to fit: the chance of the class, whatever the text.
        weights[-1] = np.log(model.prior[1] / model.prior[0])
        return Classifier(weights, voters)
    columns_ = [[one[name] for one in chosen] for name in ("words", "terms", "counts", "votes")]
    rows, columns, values = Classifier(weights, voters).entries(*columns_)
    known = np.array([one["label"] for one in chosen])
    wanted = model.posterior(np.array(columns_[3], np.int64), known) / FIXED_POINT
    n, first, second = len(chosen), np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        sums = np.bincount(rows, values * weights[columns], n) + weights[-1]
        wrong = (1 / (1 + np.exp(-np.clip(sums, -700, 700))) - wanted) / n
        slope = np.bincount(columns, values * wrong[rows], len(weights)).astype(np.float64)
        slope[-1] = wrong.sum()
        slope[:-1] += DECAY * weights[:-1]
        # Adam, whole batches.
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        change = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights = weights - RATE * (1 - step / (STEPS + 1)) * change
    return Classifier(weights, voters)


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, text_key, score)`` per row of ``docs``."""
    rows = keyed(docs, "doc_id", "text")
    known = labelled(labels)
    sample = sample_of(rows, known, train_rows)
    telling = telling_terms(rows, sample)
    stems = stems_of(telling)
    vocabulary = [(one.term, one.level) for one in telling]
    read = read_all(rows, vocabulary, stems)
    model = label_model(patterns_of(read, known), FIXED + len(stems))
    classifier = trained(read, sample, model, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            columns = [part.column(at).to_pylist() for at in range(2, 6)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(classifier.scores(*columns), pa.float64())],
                names=["doc_id", "text_key", "score"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {id_type}, text_key long, score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
