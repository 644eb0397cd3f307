"""Subject areas of documents by a latent Dirichlet topic model over sentences.

In the model a document has Dirichlet proportions of topics, each of its sentences one
topic, and the words of a sentence come from its topic, but for a few that come from a
shared one. There are several times as many topics as subjects, so that a subject may
have topics of each language and style, and the shared one for what belongs to none.
Words that most subjects use are left out.

The topics begin as clusters of example texts, made without their labels, and are fitted
to all sentences of the corpus, examples among them, as to any other. Each round of variational inference is
one Spark job: the documents stay where they are, the topic-word weights (a vocabulary of
bounded size times the number of topics) are broadcast, each task infers the topics of its
documents' sentences in Arrow batches and sums the expected counts by term and topic, Spark
sums them over tasks.

After each round the topics are mapped to subjects by inspecting their top terms: a topic
whose top terms the examples use mostly for one subject bears its name, any other has none.
Topics of a subject lend each other some of their counts, and a term that the examples or
the topics tie to one subject isn't one of the shared topic; a sentence without any such
term counts for the shared topic. After the last round a document has the subjects whose
topics have a sufficient proportion of it, in whole sentences.

The weights of terms beyond the bounded vocabulary stay a Spark table by subject, joined to
the documents that use them in each round, so that no term is left out for its rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.runtime import cut


@dataclass(frozen=True)
class TopicSettings:
    """Parameters of the model."""

    topics_per_subject: int = 10  #: topics for each subject of the examples
    vocabulary: int = 50_000  #: most terms whose weights are broadcast, the commonest by texts; those of the rest are joined
    rounds: int = 3  #: passes over the corpus
    inner: int = 4  #: updates of a document's proportions in a pass
    last_inner: int = 10  #: the same when subjects are assigned
    topic_prior: float = 0.05  #: Dirichlet weight of a topic in a document
    shared_prior: float = 0.2  #: Dirichlet weight of the shared topic
    term_prior: float = 0.01  #: Dirichlet weight of a term in a topic
    lent: float = 0.3  #: share of a topic's counts that follows all topics of its subject
    seed_examples: int = 2000  #: most examples that the topics begin with; more are sampled by a hash of their words
    seed_weight: float = 20.0  #: how often an example counts in the beginning
    seed_trials: int = 5  #: clusterings of which the closest is taken
    stop_subjects: float = 0.4  #: share of the subjects that use a term from which on it is left out
    clear: float = 0.6  #: share of a term's uses that one subject must have to be tied to it
    learned_count: float = 10.0  #: expected uses from which on a term that the examples lack is tied likewise
    top_terms: int = 25  #: terms of a topic that are looked at to name it
    stray: float = 0.1  #: share of the words of a sentence of a topic that come from the shared one


def _pieces(text: Column) -> Column:
    plain = F.regexp_replace(text, r"<[^<>]{1,200}>|&[A-Za-z]{2,8};|https?://\S+", " ")
    return F.split(plain, r"(?<=[.!?])(?:\s*[\"'”“»’)\]]+)?\s+")


def sentences(text: Column) -> Column:
    """Sentences of a text: they end with . ! or ?, closing marks and white space; pieces without a letter are none."""
    return F.filter(_pieces(text), lambda s: s.rlike(r"\p{L}"))


def terms(text: Column) -> Column:
    """Words of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}[\p{L}\p{M}]*)"), F.lit(1))


def worded(text: Column) -> Column:
    """Words of each sentence of a text; a piece has a word just if it has a letter."""
    return F.filter(F.transform(_pieces(text), terms), lambda s: F.size(s) > 0)


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp of the derivative of the log gamma function, for positive values (within 0.1 %)."""
    y = x + 1.5
    return np.exp(-1 / x - 1 / (x + 1)) * (y + 1 / (24 * y))


def exp_digamma_column(x: Column) -> Column:
    """The same of a column."""
    y = x + 1.5
    return F.exp(-1 / x - 1 / (x + 1)) * (y + 1 / (24 * y))


def infer(fit: np.ndarray, document: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Topic probabilities of sentences, and the first sentence of each document.

    ``fit`` holds the log likelihood of each sentence in each topic, ``document`` the
    ascending number of its document.
    """
    first = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(document))))
    likely = np.exp(fit - fit.max(axis=1, keepdims=True))
    weight = np.ones((len(first), len(prior)), dtype=likely.dtype)
    for _ in range(rounds):
        topic = likely * weight[row]
        topic /= topic.sum(axis=1, keepdims=True)
        weight = exp_digamma(np.add.reduceat(topic, first) + prior.astype(likely.dtype))
    return topic, first


@dataclass
class TopicModel:
    """Weights of the common terms in the topics (the last is the shared one), ties of the terms, and the subject of each topic (-1: none)."""

    weights: np.ndarray
    tied: np.ndarray
    subject: np.ndarray
    stray: float

    def mixed(self, weights: np.ndarray) -> np.ndarray:
        """Log likelihoods of words with these weights in a sentence of each topic."""
        return np.log((1 - self.stray) * weights + self.stray * weights[:, -1:])

    def own(self, weights: np.ndarray) -> np.ndarray:
        """Share of such a word that comes from the topic of its sentence."""
        return (1 - self.stray) * weights / ((1 - self.stray) * weights + self.stray * weights[:, -1:])

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """Weights in the topics from weights in the subjects, of which the last is the shared one and topics without a subject have none."""
        return np.where(self.subject >= 0, weights[:, self.subject], np.float32(1e-30))


#: Tokens that are inferred in one go, so few that their tables stay in a core's cache.
TOKENS = 4_000


@dataclass
class _Part:
    """Some documents of a batch: rows of the batch, sentences of each row, tokens of each sentence, and the tokens."""

    rows: slice
    per_row: np.ndarray
    per_sentence: np.ndarray
    tokens: np.ndarray


@dataclass
class _Rare:
    """Terms of a batch that aren't broadcast; they are numbered after those that are."""

    words: pa.Array
    weights: np.ndarray
    tied: np.ndarray


def _rare(batch: pa.RecordBatch, subjects: int) -> tuple[_Rare, np.ndarray, np.ndarray, np.ndarray]:
    """The rare terms of a batch; row, sentence in the row and number of each of their tokens."""
    none = np.zeros(0, dtype=np.int64)
    at = batch.schema.get_field_index("rare")
    found = batch.column(at).flatten() if at >= 0 else []
    if not len(found):
        return _Rare(pa.array([], pa.string()), np.zeros((0, subjects), dtype=np.float32), np.zeros(0, dtype=bool)), none, none, none
    sentence, word, weights, tied = found.flatten()
    coded = word.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first = np.unique(number, return_index=True)
    rows = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    matrix = weights.flatten().to_numpy(zero_copy_only=False).reshape(-1, subjects)[first]
    return _Rare(coded.dictionary, matrix, tied.to_numpy(zero_copy_only=False)[first]), rows, sentence.to_numpy(zero_copy_only=False), number


def _taken(common: np.ndarray, rare: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Rows of ``common``, followed by ``rare``, by their number."""
    if not len(rare):
        return common[tokens]
    far = tokens >= len(common)
    out = np.empty((len(tokens), *common.shape[1:]), dtype=common.dtype)
    out[~far] = common[tokens[~far]]
    out[far] = rare[tokens[far] - len(common)]
    return out


def _parts(batch: pa.RecordBatch, size: int, rows: np.ndarray, sentence: np.ndarray, number: np.ndarray) -> Iterator[_Part]:
    """The parts of a batch; its tokens of rare terms, as ``_rare`` gives them, join their sentences, numbered from ``size``."""
    lists = batch.column(batch.schema.get_field_index("terms"))
    inner = lists.flatten()
    tokens = inner.flatten().to_numpy(zero_copy_only=False)
    many = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    each = np.diff(inner.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    s_end = np.append(0, np.cumsum(many))
    if len(number):
        own = s_end[rows] + sentence
        order = np.argsort(np.concatenate([np.repeat(np.arange(len(each)), each), own]), kind="stable")
        tokens = np.concatenate([tokens.astype(np.int64), size + number])[order]
        each = each + np.bincount(own, minlength=len(each))
    t_end = np.append(0, np.cumsum(each))
    ends = t_end[s_end]
    first = 0
    while first < len(many):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + TOKENS, side="right")) - 1)
        last = min(last, len(many))
        yield _Part(slice(first, last), many[first:last], each[s_end[first] : s_end[last]], tokens[ends[first] : ends[last]])
        first = last


def _inferred(batch: pa.RecordBatch, model: TopicModel, table: np.ndarray, prior: np.ndarray, subjects: int, rounds: int):
    """The rare terms of a batch, and for each of its parts the part, tokens, their sentences, documents of sentences, and what ``infer`` gives."""
    rare, *places = _rare(batch, subjects + 1)
    beyond = model.mixed(model.spread(rare.weights))

    def parts():
        for part in _parts(batch, len(table), *places):
            full = part.per_sentence > 0
            if not full.any():
                continue
            many = part.per_sentence[full]
            start = np.append(0, np.cumsum(many)[:-1])
            row = np.repeat(np.arange(len(part.per_row)), part.per_row)[full]
            fit = np.add.reduceat(_taken(table, beyond, part.tokens), start)
            fit[~np.logical_or.reduceat(_taken(model.tied, rare.tied, part.tokens), start), :-1] = -np.inf
            yield part, np.repeat(np.arange(len(many)), many), row, *infer(fit, row, prior, rounds)

    return rare, parts()


#: Probabilities and expected counts below this are zero.
LEAST = 1e-9


def _expected_counts(shared, prior: np.ndarray, size: int, subjects: int, settings: TopicSettings):
    """Task function: expected counts of a partition, by term and topic (a term of -1: of all terms) or by rare word and subject."""

    def rows(terms, words, topics, values):
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.int32()), pa.array(words, pa.string()), pa.array(topics, pa.int32()), pa.array(values, pa.float64())], names=["term", "word", "topic", "n"]
        )

    def by_topic(sums, own):
        counts = own * sums
        counts[:, -1] = sums.sum(axis=1) - counts[:, :-1].sum(axis=1)
        return counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        topics = len(prior)
        table = model.mixed(model.weights)
        sums, whole = np.zeros((size, topics)), np.zeros(topics)
        to = np.where(model.subject >= 0, model.subject, subjects + 1)
        for batch in batches:
            rare, parts = _inferred(batch, model, table, prior, subjects, settings.inner)
            beyond = np.zeros((len(rare.words), topics))
            for part, sentence, _, topic, _ in parts:
                # Each token with the likely topics of its sentence.
                of, topic_no = np.nonzero(topic > LEAST)
                many = np.bincount(of, minlength=len(topic))
                each = many[sentence]
                at = np.repeat((np.cumsum(many) - many)[sentence] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                key = np.repeat(part.tokens.astype(np.int64), each) * topics + topic_no[at]
                share = topic[of, topic_no].astype(np.float64)[at]
                far = key >= size * topics
                np.add.at(sums.reshape(-1), key[~far], share[~far])
                np.add.at(beyond.reshape(-1), key[far] - size * topics, share[far])
            if len(rare.words):
                counts = by_topic(beyond, model.own(model.spread(rare.weights)))
                whole += counts.sum(axis=0)
                grouped = np.zeros((len(rare.words), subjects + 2))
                np.add.at(grouped.T, to, counts.T)
                w, s = np.nonzero(grouped[:, : subjects + 1] > LEAST)
                yield rows(pa.nulls(len(w), pa.int32()), rare.words.take(pa.array(w)), s, grouped[w, s])
        counts = by_topic(sums, model.own(model.weights))
        whole += counts.sum(axis=0)
        v, k = np.nonzero(counts > LEAST)
        yield rows(v, pa.nulls(len(v), pa.string()), k, counts[v, k])
        yield rows(np.full(topics, -1), pa.nulls(topics, pa.string()), np.arange(topics), whole)

    return run


def _subjects_shown(shared, prior: np.ndarray, subjects: list[str], least_share: float, settings: TopicSettings):
    """Task function: the subjects of each document by its proportions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.mixed(model.weights)
        of = np.zeros((len(prior), len(subjects)))
        about = (model.subject >= 0) & (model.subject < len(subjects))
        of[about, model.subject[about]] = 1
        for batch in batches:
            items = batch.column(batch.schema.get_field_index("item"))
            for part, _, row, topic, first in _inferred(batch, model, table, prior, len(subjects), settings.last_inner)[1]:
                count = np.floor(np.add.reduceat(topic, first) @ of + 0.5)  # whole sentences
                r, c = np.nonzero((count > 0) & (count >= least_share * part.per_row[row[first]][:, None]))
                yield pa.RecordBatch.from_arrays(
                    [items.take(pa.array(row[first][r] + part.rows.start)), pa.array([subjects[i] for i in c], pa.string())], names=["doc_id", "subject"]
                )

    return run


def clusters(texts: list[list[str]], many: int, trials: int) -> np.ndarray:
    """Cluster of each text, by the cosine of its words weighted by rarity: spherical k-means from spread seeds, the closest of some trials."""
    users: dict[str, int] = {}
    for t in texts:
        for w in set(t):
            users[w] = users.get(w, 0) + 1
    number = {w: i for i, w in enumerate(sorted(w for w, n in users.items() if n > 1))}
    x = np.zeros((len(texts), len(number) + 1), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in t:
            if w in number:
                x[i, number[w]] = np.log(len(texts) / users[w])
    x[:, -1] = 1e-3  # no text is empty
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best, closest = np.zeros(len(texts), dtype=np.int64), -1.0
    for trial in range(trials):
        rng = np.random.default_rng(trial)
        centre = [x[rng.integers(len(x))]]
        near = x @ centre[0]
        while len(centre) < min(many, len(x)):
            far = np.clip(1 - near, 0, None).astype(np.float64) ** 2
            centre.append(x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))])
            near = np.maximum(near, x @ centre[-1])
        c = np.array(centre)
        for _ in range(20):
            label = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, label, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norm > 0, total / np.maximum(norm, 1e-9), c)
        found = float((x @ c.T).max(axis=1).sum())
        if found > closest:
            best, closest = (x @ c.T).argmax(axis=1), found
    return best


def tied_terms(examples: np.ndarray, clear: float) -> np.ndarray:
    """Whether one subject has at least the share ``clear`` of a term's uses in the examples."""
    return (examples.max(axis=1) >= clear * examples.sum(axis=1)) & (examples.max(axis=1) > 0)


def name_topics(counts: np.ndarray, examples: np.ndarray, top: int, whole: np.ndarray | None = None, before: np.ndarray | None = None) -> np.ndarray:
    """Subject of each topic by its top terms: the one whose examples use them most, or -1 if no subject has most of their weight.

    ``counts`` and ``examples`` hold the terms' counts in the topics and in the examples of
    the subjects. A topic whose top terms are less than a tenth of its counts ``whole`` (most of its
    terms are not among the common ones) keeps its subject of ``before``.
    """
    total = examples.sum(axis=1, keepdims=True)
    share = np.divide(examples, total, out=np.zeros_like(examples), where=total > 0)
    named = np.full(counts.shape[1], -1) if before is None else before.copy()
    for k in range(counts.shape[1]):
        order = np.argsort(-counts[:, k], kind="stable")[:top]
        votes = (counts[order, k][:, None] * share[order]).sum(axis=0)
        if before is None or votes.sum() >= 0.1 * whole[k]:
            best = int(votes.argmax())
            named[k] = best if votes[best] > 0.5 * max(votes.sum(), 1e-300) else -1
    return named


def first_examples(shown: DataFrame, label, settings: TopicSettings) -> tuple[list[int], list[list[str]]]:
    """Labels and words of the examples that the topics begin with."""
    rows = shown.select(label.alias("label"), F.flatten("s").alias("words"))
    rows = rows.orderBy(F.xxhash64("words"), "words", "label").limit(settings.seed_examples).collect()
    return [r["label"] for r in rows], [r["words"] for r in rows]


def first_topics(begin: tuple[list[int], list[list[str]]], number: dict[str, int], seen: np.ndarray, known: np.ndarray, settings: TopicSettings):
    """Counts (common term, topic), counts of all terms by topic, and subjects of the topics, from clusters of examples.

    ``number`` gives the common terms, ``seen`` and ``known`` their uses in the examples and
    whether these tie them to a subject. The labels serve to leave out words of most subjects and to name the clusters.
    """
    labels, texts = begin
    subjects = seen.shape[1]
    using: dict[str, set[int]] = {}
    for label, words in zip(labels, texts):
        for w in words:
            using.setdefault(w, set()).add(label)
    texts = [[w for w in words if len(using[w]) <= max(1, settings.stop_subjects * subjects)] for words in texts]
    topics = settings.topics_per_subject * subjects
    cluster = clusters(texts, topics, settings.seed_trials)
    own = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    uses, shown = np.zeros((len(own), topics)), np.zeros((len(own), subjects))
    for label, k, words in zip(labels, cluster, texts):
        for w in words:
            uses[own[w], k] += 1
            shown[own[w], label] += 1
    counts = np.zeros((len(number), topics + 1))
    for w, i in own.items():
        if w in number:
            counts[number[w], :-1] = settings.seed_weight * uses[i]
    counts[:, -1] = np.where(known, 0, seen.sum(axis=1))
    whole = np.append(settings.seed_weight * uses.sum(axis=0), shown[~tied_terms(shown, settings.clear)].sum())
    return counts, whole, name_topics(uses, shown, settings.top_terms)


class RareTerms:
    """The terms beyond the broadcast ones, as Spark tables: their model, and their tokens by unit and sentence."""

    def __init__(self, rows: DataFrame, vocabulary: DataFrame, subjects: int, settings: TopicSettings):
        """``rows`` has a ``unit`` and its words ``s``; ``vocabulary`` a ``word`` and the examples of each subject that have it, ``seen``."""
        self.settings, self.topics = settings, subjects + 1
        seen = F.coalesce("seen", F.array_repeat(F.lit(0.0), subjects))
        most, total = F.array_max("seen"), F.aggregate("seen", F.lit(0.0), lambda a, x: a + x)
        terms = vocabulary.select("word", seen.alias("seen")).select("word", "seen", ((most >= settings.clear * total) & (most > 0)).alias("known"))
        self.terms = cut(terms)
        tokens = rows.select("unit", F.posexplode("s").alias("sentence", "words")).select("unit", "sentence", F.explode("words").alias("word"))
        self.tokens = cut(tokens.join(self.terms.select("word"), "word"))
        none = F.array_repeat(F.lit(0.0), subjects)
        many = F.transform("seen", lambda n: n * settings.seed_weight)
        first = F.when(F.col("known"), F.concat(many, F.array(F.lit(0.0)))).otherwise(F.concat(none, F.array(total)))
        self.many = self.terms.count()
        self.counts = self.terms.select("word", first.alias("c"), F.col("known").alias("tied"))

    def learn(self, sums: DataFrame) -> None:
        """Takes the expected counts of a round: ``word``, ``topic`` (number of a subject, the last the shared one) and ``n``."""
        each = F.array(*[F.coalesce(F.sum(F.when(F.col("topic") == k, F.col("n"))), F.lit(0.0)) for k in range(self.topics)])
        c = sums.groupBy("word").agg(each.alias("c"))
        all_, own = F.aggregate("c", F.lit(0.0), lambda a, x: a + x), F.array_max(F.slice("c", 1, self.topics - 1))
        learned = (own >= self.settings.clear * all_) & (all_ >= self.settings.learned_count)
        self.counts = self.terms.join(c, "word").select("word", "c", (F.col("known") | learned).alias("tied"))

    def joined(self, units: DataFrame, total: np.ndarray) -> DataFrame:
        """``units`` with ``rare``: sentence, word, weights by subject and tie of each token of these terms; ``total``: of all terms' counts."""
        prior = F.lit(self.settings.term_prior)
        lam = [F.get("c", F.lit(k)) + prior for k in range(self.topics)]
        lam[-1] = F.when(F.col("tied"), prior).otherwise(lam[-1])
        weights = [(exp_digamma_column(x) / float(t) + 1e-30).cast("float") for x, t in zip(lam, exp_digamma(total))]
        model = self.counts.select("word", F.array(*weights).alias("w"), "tied")
        rare = self.tokens.join(model, "word").groupBy("unit").agg(F.collect_list(F.struct("sentence", "word", "w", "tied")).alias("rare"))
        return units.join(rare, "unit", "left")


def topic_model(counts: np.ndarray, whole: np.ndarray, named: np.ndarray, known: np.ndarray, rare: int, learning: bool, settings: TopicSettings) -> TopicModel:
    """Weights by expected counts (term, topic) of the common terms and ``whole`` of all terms; ``named`` holds the subjects of the topics.

    ``rare`` is the number of the other terms.
    """
    subjects = int(named.max(initial=-1)) + 1
    groups = np.zeros((len(counts), subjects))
    about = np.flatnonzero(named >= 0)
    np.add.at(groups.T, named[about], counts.T[about])
    size = np.zeros(subjects)
    np.add.at(size, named[about], whole[about])
    tied = known
    if learning and subjects:  # what the examples lack is tied to the subject that the corpus shows it with
        tied = known | ((groups.max(axis=1) >= settings.clear * counts.sum(axis=1)) & (counts.sum(axis=1) >= settings.learned_count))
    lam = counts.astype(float)
    lent = groups[:, named[about]] * (whole[about] / np.maximum(size[named[about]], 1e-9))
    lam[:, about] = (1 - settings.lent) * lam[:, about] + settings.lent * lent
    lam += settings.term_prior
    lam[tied, -1] = settings.term_prior
    total = lam.sum(axis=0) + np.maximum(whole - counts.sum(axis=0), 0) + rare * settings.term_prior
    weights = (exp_digamma(lam) / exp_digamma(total) + 1e-30).astype(np.float32)
    return TopicModel(weights, tied, named, settings.stray)


def assign_subjects(
    documents: DataFrame, item: str, text: str, examples: DataFrame, example_text: str, example_subject: str, least_share: float = 0.25,
    settings: TopicSettings = TopicSettings(),
) -> DataFrame:
    """``doc_id`` and ``subject`` for each subject that at least ``least_share`` of the sentences of a document are about.

    A sentence is about one subject or none. Documents with a null or empty text, or
    without a sentence, have no subject; equal texts have equal subjects; each row
    is a document, and rows of the same id, null included, have the subjects of all. An empty table gives
    an empty result. Other columns are left out. Terms of a single text, which tie it to no other, aren't in the model.
    """
    spark = documents.sparkSession
    shown = examples.filter(F.col(example_subject).isNotNull()).select(F.col(example_subject).alias("subject"), worded(F.col(example_text)).alias("s")).filter(F.size("s") > 0)
    subjects = sorted(r["subject"] for r in shown.select("subject").distinct().collect())
    if not subjects:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    label = F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("subject")).cast("int") - 1
    # Written once, as the words are read for the vocabulary and again for the units.
    rows = documents.select(F.col(item).cast("bigint").alias("item"), F.lit(-1).alias("label"), worded(F.col(text)).alias("s")).filter(F.size("s") > 0)
    labelled = shown.select(F.lit(None).cast("bigint").alias("item"), label.alias("label"), "s")
    rows = cut(rows.unionByName(labelled).withColumn("unit", F.monotonically_increasing_id()))
    # The vocabulary, commonest first, ties by the term; with it, how many examples of each subject have a term.
    words = rows.select("label", F.explode(F.array_distinct(F.flatten("s"))).alias("word"))
    seen = words.filter("label >= 0").groupBy("word").agg(F.array(*[F.count(F.when(F.col("label") == k, 1)).cast("double") for k in range(len(subjects))]).alias("seen"))
    users = F.size(F.filter("seen", lambda n: n > 0))
    seen = seen.withColumn("stop", users > max(1, settings.stop_subjects * len(subjects)))
    vocabulary = words.groupBy("word").count().filter(F.col("count") > 1).join(seen, "word", "left").filter(~F.coalesce("stop", F.lit(False))).drop("stop")
    vocabulary = cut(vocabulary)
    common = vocabulary.orderBy(F.desc("count"), "word").limit(settings.vocabulary).collect()
    if not common:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    index = spark.sparkContext.broadcast(pa.array([r["word"] for r in common]))

    @F.arrow_udf("array<array<int>>")
    def numbers(lists: pa.Array) -> pa.Array:
        inner = lists.flatten()
        at = pc.index_in(inner.flatten(), value_set=index.value)
        kept = np.concatenate(([0], np.cumsum(at.is_valid().to_numpy(zero_copy_only=False))))
        ends = inner.offsets.to_numpy() - inner.offsets[0].as_py()
        outer = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = pa.ListArray.from_arrays(pa.array(kept[ends].astype(np.int32)), at.drop_null())
        return pa.ListArray.from_arrays(pa.array(outer.astype(np.int32)), found)

    units = cut(rows.select("unit", "item", "label", numbers("s").alias("terms")))
    seen = np.zeros((len(common), len(subjects)))
    for i, r in enumerate(common):
        if r["seen"]:
            seen[i] = r["seen"]
    known = tied_terms(seen, settings.clear)
    rest = None
    if len(common) == settings.vocabulary:
        last = common[-1]
        beyond = (F.col("count") < last["count"]) | ((F.col("count") == last["count"]) & (F.col("word") > last["word"]))
        rest = RareTerms(rows, vocabulary.filter(beyond), len(subjects), settings)
    # The topics begin as clusters of examples; the number of these is bounded by a setting.
    counts, whole, named = first_topics(first_examples(shown, label, settings), {r["word"]: i for i, r in enumerate(common)}, seen, known, settings)
    topics = len(whole)
    prior = np.append(np.full(topics - 1, settings.topic_prior), settings.shared_prior)

    def shared_model(learning: bool):
        """The broadcast model, and the units with what it lacks."""
        to = np.append(named, len(subjects))
        rare = rest.many if rest else 0
        model = topic_model(counts, whole, np.append(named, -1), known, rare, learning, settings)
        model.subject = to
        total = np.full(len(subjects) + 2, (len(common) + rare) * settings.term_prior)
        np.add.at(total, np.where(to >= 0, to, len(subjects) + 1), whole)
        return spark.sparkContext.broadcast(model), rest.joined(units, total[:-1]) if rest else units

    shared, given = shared_model(False)
    for _ in range(settings.rounds):
        job = given.mapInArrow(_expected_counts(shared, prior, len(common), len(subjects), settings), "term int, word string, topic int, n double")
        job = job.groupBy("term", "word", "topic").agg(F.sum("n").alias("n"))
        if rest:
            job = cut(job)
            rest.learn(job.filter("word is not null"))
        counts, whole = np.zeros((len(common), topics)), np.zeros(topics)
        found = job.filter("word is null").select("term", "topic", "n").toArrow()
        term, topic, n = [found[c].to_numpy() for c in ("term", "topic", "n")]
        counts[term[term >= 0], topic[term >= 0]] = n[term >= 0]
        whole[topic[term < 0]] = n[term < 0]
        named = name_topics(counts[:, :-1], seen, settings.top_terms, whole, named)
        shared, given = shared_model(True)
    found = given.filter(F.col("label") < 0).mapInArrow(_subjects_shown(shared, prior, subjects, least_share, settings), "doc_id bigint, subject string")
    return found.distinct()
