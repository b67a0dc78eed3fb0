"""Toxicity by a weighted finite-state pattern grammar.

Words map to symbols: insult, threat, target, negation, reported speech, or none.  Five
small transducers read a clause's symbols and are composed into one machine: reported
speech turns later hits of its clause into quoted ones, negation cancels the next hit
near it, a target aims the hits after it, and the insult and threat machines write an
attack or a menace once a hit and a target meet in a clause, in either order, or a second
insult piles on the first.  A hit that meets nothing writes nothing that is weighed: no
word scores by itself.  Arcs carry log-odds weights, which composition adds; a document's
score is the logistic function of the weight of its path.

Everything is learned from labelled rows.  Hits are words and stems that toxic documents
hold beyond chance.  Threats are hits that targets follow rather than precede.  Targets
are the other words that clauses with hits share.  Words before a hit that make a
document clean are negations, or reports where that holds beyond ``NEAR`` words.  Short
closed-class lists seed the roles, and prior weights serve patterns that no label shows.

The sample is bounded (``SAMPLE_DOCS`` ids of smallest hash, ``SAMPLE_BYTES`` of text);
labels, language, source or id are never inputs.  Scoring is one Arrow pass without a
shuffle; the model is a few arrays of at most ``LEXICON`` entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import table
from tilewright.llm.kernel import Chunk, Words, chunks, gram_hashes, grams_of, mix, rolling, span_hashes

SAMPLE_DOCS = 6_000
SAMPLE_BYTES = 64 << 20
LEXICON = 50_000
STEM_BYTES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

#: Closed-class words of the grammar in English, German, French and Spanish.
WORDS = {
    "target": "you your yours u he she they them these those people du dich dir dein ihr euch sie tu te toi vous votre ton eres usted ustedes tú ellos",
    "negation": "not no never neither nor isn't aren't don't nicht kein keine nie niemals pas jamais aucun aucune nunca jamás tampoco ningún",
    "report": "said says say wrote writes claimed claims reported quote quoted quoting according sagte sagt schrieb laut zitiert dit disait écrit selon dijo dice escribió según",
    "threat": "kill murder destroy hurt beat burn shoot stab töten umbringen tuer détruire matar destruir",
}

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
_CLASS_OF = {"target": TARGET, "negation": NEGATION, "report": REPORT, "threat": THREAT}
#: Gap in words after which a none symbol stands between two matched words.
NEAR = 4

# ---------------------------------------------------------------- transducers

#: Symbols that the machines write: hits quoted, cancelled, aimed or waiting for a target, and the matched patterns.
QUOTED, CANCELLED, AIMED_INSULT, AIMED_THREAT, WAITING, ATTACK, PILED, MENACE = range(7, 15)
SYMBOLS = 15
#: Patterns with a weight, in the order of the features, and their weights before any label.
PATTERNS = (ATTACK, PILED, MENACE, QUOTED, CANCELLED)
PRIOR = (1.0, 1.0, 1.0, 0.0, -0.5)


@dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted: arcs[(state, symbol)] = (next state, output, weight); absent arcs keep state and symbol at no weight."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    states: int

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def reported_speech(quoted: float = 0.0) -> Transducer:
    """After a report word, hits are quoted until the clause ends."""
    arcs = {(0, REPORT): (1, REPORT, 0.0), (1, END): (0, END, 0.0)}
    return Transducer(arcs | {(1, hit): (1, QUOTED, quoted) for hit in (INSULT, THREAT)}, 2)


def negation(cancelled: float = 0.0, quoted: float = 0.0) -> Transducer:
    """The first hit near after a negation is cancelled; one that was quoted gives its weight back."""
    arcs = {(0, NEGATION): (1, NEGATION, 0.0), (1, NONE): (0, NONE, 0.0), (1, END): (0, END, 0.0), (1, QUOTED): (0, CANCELLED, cancelled - quoted)}
    return Transducer(arcs | {(1, hit): (0, CANCELLED, cancelled) for hit in (INSULT, THREAT)}, 2)


def targeting() -> Transducer:
    """Hits after a target of their clause are aimed."""
    arcs = {(0, TARGET): (1, TARGET, 0.0), (1, END): (0, END, 0.0)}
    return Transducer(arcs | {(1, INSULT): (1, AIMED_INSULT, 0.0), (1, THREAT): (1, AIMED_THREAT, 0.0)}, 2)


def insulting(attack: float = 0.0, piled: float = 0.0) -> Transducer:
    """An aimed insult, or one that a target follows, is an attack; a further one without target piles on."""
    arcs = {(k, AIMED_INSULT): (0, ATTACK, attack) for k in (0, 1)}
    return Transducer(arcs | {(0, INSULT): (1, WAITING, 0.0), (1, INSULT): (1, PILED, piled), (1, TARGET): (0, ATTACK, attack), (1, END): (0, END, 0.0)}, 2)


def threatening(menace: float = 0.0) -> Transducer:
    """An aimed threat, or one that a target follows, is a menace."""
    arcs = {(k, AIMED_THREAT): (0, MENACE, menace) for k in (0, 1)}
    return Transducer(arcs | {(0, THREAT): (1, WAITING, 0.0), (1, TARGET): (0, MENACE, menace), (1, END): (0, END, 0.0)}, 2)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds the first one's output to the second; weights add."""
    arcs = {}
    for a in range(first.states):
        for b in range(second.states):
            for symbol in range(SYMBOLS):
                a_next, middle, left = first.step(a, symbol)
                b_next, out, right = second.step(b, middle)
                arcs[(a * second.states + b, symbol)] = (a_next * second.states + b_next, out, left + right)
    return Transducer(arcs, first.states * second.states)


def grammar(weights: Sequence[float] = (0.0,) * len(PATTERNS)) -> Transducer:
    """The composition of all five machines with the patterns' weights on their arcs."""
    attack, piled, menace, quoted, cancelled = weights
    machine = reported_speech(quoted)
    for later in (negation(cancelled, quoted), targeting(), insulting(attack, piled), threatening(menace)):
        machine = compose(machine, later)
    return machine


def run_grammar(machine: Transducer, symbols: Sequence[int]) -> tuple[float, list[int]]:
    """Weight of the path, and how often each pattern was written."""
    counts = dict.fromkeys(PATTERNS, 0)
    state, total = 0, 0.0
    for symbol in symbols:
        state, out, weight = machine.step(state, symbol)
        total += weight
        if out in counts:
            counts[out] += 1
    return total, [counts[p] for p in PATTERNS]


# ---------------------------------------------------------------- words

_LETTER = np.zeros(256, bool)  # letters, digits, apostrophe and every byte of a longer character
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LETTER[39] = True
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[ord(c) for c in ".!?;\n"]] = True


def letter_words(chunk: Chunk) -> tuple[Words, np.ndarray]:
    """Words of letters, and the prefix sums of the lower-cased bytes."""
    solid = _LETTER[chunk.data]
    edge = np.zeros(len(solid) + 1, bool)
    edge[chunk.offsets] = True
    prior = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
    later = np.concatenate((solid[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(solid & ~prior)
    return Words(starts, np.flatnonzero(solid & ~later) + 1, np.searchsorted(starts, chunk.offsets)), rolling(chunk.lowered())


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(rolling(data), np.array([0]), np.array([len(data)]))[0])


def features(words: Words, sums: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word indices, hashes): whole words, then stems of longer words by length."""
    yield np.arange(len(words.starts)), span_hashes(sums, words.starts, words.ends)
    length = words.ends - words.starts
    for size in STEM_BYTES:
        at = np.flatnonzero(length > size)
        yield at, span_hashes(sums, words.starts[at], words.starts[at] + size) ^ np.uint64(size)


def find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


@dataclass
class Lexicon:
    """Sorted hashes of words and stems that are hits, and of whole words with a role (a closed-class word's role comes first)."""

    hits: np.ndarray
    words: np.ndarray
    roles: np.ndarray

    def symbols(self, words: Words, sums: np.ndarray) -> np.ndarray:
        """Per word its symbol."""
        out = np.zeros(len(words.starts), np.int64)
        for at, hashes in features(words, sums):
            out[at[find(self.hits, hashes) >= 0]] = INSULT
        found = find(self.words, span_hashes(sums, words.starts, words.ends))
        role = np.where(found >= 0, self.roles[np.maximum(found, 0)], NONE) if len(self.roles) else np.zeros(len(out), np.int64)
        return np.where(role != NONE, role, out)


_CLOSED_KEYS, _CLOSED_CLASS = (
    np.array(x)
    for x in zip(*sorted({_hash(w): _CLASS_OF[c] for c, ws in WORDS.items() for w in ws.split()}.items()), strict=True)
)
_CLOSED_KEYS = _CLOSED_KEYS.astype(np.uint64)


def copy_groups(texts: pa.Array, draws: int = 12) -> np.ndarray:
    """Group number per text: texts that share one of some minimum hashes of their word triples count as copies."""
    root = np.arange(len(texts))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict[tuple[int, int], int] = {}
    for chunk in chunks(texts):
        words, sums = letter_words(chunk)
        grams = gram_hashes(span_hashes(sums, words.starts, words.ends), 3)
        for k in range(len(chunk)):
            a, b = grams_of(words.first, k, 3)
            row = chunk.rows.start + k
            for draw in range(draws if b > a else 0):
                low = int(mix(grams[a:b] ^ np.uint64(draw * 0x51ED2701 + 1)).min())
                root[top(first.setdefault((draw, low), row))] = top(row)
    return np.array([top(x) for x in range(len(root))], np.int64)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def learn_hits(texts: pa.Array, labels: np.ndarray, groups: np.ndarray, verdict: np.ndarray, least: int = 3, bound: float = 1.0) -> np.ndarray:
    """Sorted hashes of words and stems whose texts are mostly toxic, more than chance among all words tested explains.

    The log likelihood ratio against the base rate must exceed the log of the number of
    words tested by ``bound``.

    Copies of a text (equal ``groups``) count as one, toxic by the group's ``verdict``.
    """
    held, docs = [], []
    for chunk in chunks(texts):
        words, sums = letter_words(chunk)
        owner = groups[words.owners() + chunk.rows.start]
        for at, hashes in features(words, sums):
            hashes, found = distinct_pairs(hashes, owner[at])
            held.append(hashes)
            docs.append(found)
    if not held:
        return np.zeros(0, np.uint64)
    hashes, found = distinct_pairs(np.concatenate(held), np.concatenate(docs))
    new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    keys, which = hashes[new], np.cumsum(new) - 1
    toxic = verdict[found] == 1
    hits = np.bincount(which[toxic], minlength=len(keys))
    clean = np.bincount(which[~toxic], minlength=len(keys))
    seen = np.unique(groups)
    positive, negative = (verdict[seen] == 1).sum(), (verdict[seen] != 1).sum()
    base = positive / max(1, positive + negative)
    held_in = hits + clean
    share = hits / np.maximum(held_in, 1)
    surprise = hits * np.log(np.maximum(share, 1e-12) / max(base, 1e-12)) + clean * np.log(np.maximum(1 - share, 1e-12) / max(1 - base, 1e-12))
    tested = (held_in >= least).sum()
    sure = np.where(share > base, surprise, 0) - np.log(max(tested, 1))
    chosen = np.flatnonzero((hits >= least) & (hits > 9 * clean) & (sure > bound))
    if len(chosen) > LEXICON:
        chosen = np.sort(chosen[np.argsort(-sure[chosen], kind="stable")[:LEXICON]])
    return keys[chosen]


def clauses(chunk: Chunk, words: Words) -> np.ndarray:
    """Per word the number of its clause, rising over the chunk; texts never share one."""
    ends = np.concatenate(([0], np.cumsum(_CLAUSE_END[chunk.data])))
    return ends[words.starts] + words.owners()


def learn_lexicon(texts: pa.Array, labels: np.ndarray, least: int = 3) -> Lexicon:
    """Hits, then the roles of the words around them; copies of a text count as one.

    Roles weigh documents, not words.  A target stands in the hit clauses of at least
    ``least`` toxic documents and a hundredth of them.  A negation or report precedes
    hits whose documents are clean beyond chance, judged as for hits, against the share
    of clean ones among documents with hits.
    """
    groups = copy_groups(texts)
    verdict = np.zeros(len(labels), np.int64)
    np.maximum.at(verdict, groups, labels)
    hits = learn_hits(texts, labels, groups, verdict)
    plain = Lexicon(hits, _CLOSED_KEYS, _CLOSED_CLASS)
    seen: dict[str, list[tuple[int, int]]] = {"near": [], "far": [], "after": [], "hit": []}
    sides: dict[str, list[tuple[int, int, int]]] = {"before": [], "follow": []}
    for chunk in chunks(texts):
        words, sums = letter_words(chunk)
        if not len(words.starts):
            continue
        symbols, clause, owner = plain.symbols(words, sums), clauses(chunk, words), groups[words.owners() + chunk.rows.start]
        names = span_hashes(sums, words.starts, words.ends)
        first = np.searchsorted(clause, clause, "left")
        last = np.searchsorted(clause, clause, "right")
        for k in np.flatnonzero(symbols == INSULT):
            doc = int(owner[k])
            others = lambda a, b: ((int(n), doc) for n, s in zip(names[a:b], symbols[a:b], strict=True) if s in (NONE, TARGET))  # noqa: B023, E731
            seen["hit"].append((int(names[k]), doc))
            seen["near"] += others(max(first[k], k - NEAR), k)
            seen["far"] += others(first[k], max(first[k], k - NEAR))
            seen["after"] += others(k + 1, last[k])
            for side, a, b in (("before", max(first[k], k - NEAR), k), ("follow", k + 1, min(last[k], k + 1 + NEAR))):
                sides[side] += [(int(names[k]), name, doc) for name, _ in others(a, b)]
    with_hits = np.unique([d for _, d in seen["hit"]]).astype(np.int64)
    toxic_docs = int((verdict[with_hits] == 1).sum())
    clean_share = 1 - toxic_docs / max(1, len(with_hits))

    def tally(pairs: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """Per word its toxic and clean documents."""
        out: dict[int, list[int]] = {}
        for name, doc in set(pairs):
            out.setdefault(name, [0, 0])[0 if verdict[doc] == 1 else 1] += 1
        return {n: (t, c) for n, (t, c) in out.items()}

    def cleaning(found: dict[int, tuple[int, int]]) -> set[int]:
        base = min(max(clean_share, 1e-3), 1 - 1e-3)
        tested = sum(t + c >= least for t, c in found.values())
        surprise = lambda t, c: c * np.log(c / (t + c) / base) + (t and t * np.log(t / (t + c) / (1 - base)))
        return {n for n, (t, c) in found.items() if c >= least and c > (t + c) * base and surprise(t, c) - np.log(max(tested, 1)) > 1.0}

    reports = cleaning(tally(seen["far"]))
    negations = cleaning(tally(seen["near"])) - reports
    seeds = set(_CLOSED_KEYS[_CLOSED_CLASS == TARGET].tolist())
    around = tally(seen["near"] + seen["far"] + seen["after"])
    targets = {n for n, (t, _) in around.items() if t >= max(least, toxic_docs / 100)}
    before, follow = (tally([(hit, doc) for hit, name, doc in sides[side] if name in targets or name in seeds]) for side in ("before", "follow"))
    threats = {n for n, (t, _) in follow.items() if t >= least and t > 4 * sum(before.get(n, (0, 0)))}
    roles = dict.fromkeys(targets, TARGET) | dict.fromkeys(threats, THREAT) | dict.fromkeys(negations, NEGATION) | dict.fromkeys(reports, REPORT)
    roles |= dict(zip(_CLOSED_KEYS.tolist(), _CLOSED_CLASS.tolist(), strict=True))
    keys = np.array(sorted(roles), np.uint64)
    return Lexicon(hits, keys, np.array([roles[int(k)] for k in keys], np.int64))


def symbol_streams(texts: pa.Array, lexicon: Lexicon) -> Iterator[tuple[int, list[int]]]:
    """(row, symbols) of the texts with a hit: END between clauses, NONE for a gap of over NEAR words."""
    for chunk in chunks(texts):
        words, sums = letter_words(chunk)
        if not len(words.starts):
            continue
        symbols, clause, owner = lexicon.symbols(words, sums), clauses(chunk, words), words.owners()
        hit_clause = np.isin(clause, clause[(symbols == INSULT) | (symbols == THREAT)])
        held = np.flatnonzero(hit_clause & (symbols != NONE))  # a clause without a hit leaves every machine where it was
        for part in np.split(held, np.flatnonzero(np.diff(owner[held])) + 1) if len(held) else ():
            stream: list[int] = []
            for k, before in zip(part, [None, *part[:-1]], strict=True):
                if before is not None and clause[k] != clause[before]:
                    stream.append(END)
                elif before is not None and k - before > NEAR:
                    stream.append(NONE)
                stream.append(int(symbols[k]))
            yield chunk.rows.start + int(owner[part[0]]), [*stream, END]


def grammar_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text how often the composed machine writes each pattern."""
    machine, out = grammar(), np.zeros((len(texts), len(PATTERNS)))
    for row, stream in symbol_streams(texts, lexicon):
        out[row] = run_grammar(machine, stream)[1]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Newton steps towards the prior weights; the ridge spares the intercept."""
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    beta = prior.astype(float).copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        change = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * (beta - prior))
        beta += np.clip(change, -1, 1)
        if np.abs(change).max() < 1e-9:
            break
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    intercept: float
    weights: Sequence[float]

    def score(self, texts: pa.Array) -> np.ndarray:
        machine, total = grammar(self.weights), np.full(len(texts), self.intercept)
        for row, stream in symbol_streams(texts, self.lexicon):
            total[row] += run_grammar(machine, stream)[0]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(texts: pa.Array, labels: np.ndarray) -> Model:
    """Lexicon from all rows; the weights from patterns that the other half's lexicon finds."""
    if len(labels) == 0 or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.0
        return Model(Lexicon(np.zeros(0, np.uint64), _CLOSED_KEYS, _CLOSED_CLASS), float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))), PRIOR)
    counts = np.zeros((len(labels), len(PATTERNS)))
    half = np.arange(len(labels)) % 2
    for side in (0, 1):
        own, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
        counts[own] = grammar_features(texts.take(pa.array(own)), learn_lexicon(texts.take(pa.array(other)), labels[other]))
    beta = fit_logistic(np.column_stack([np.ones(len(labels)), counts]), labels.astype(float), np.array([0.0, *PRIOR]))
    return Model(learn_lexicon(texts, labels), float(beta[0]), tuple(float(b) for b in beta[1:]))


def training_rows(docs: DataFrame, labels: DataFrame, use, sample: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> tuple[pa.Array, np.ndarray]:
    """The labelled rows learned from, one text per id: at most ``sample`` ids that pass ``use``, by hash, while their texts fit ``size`` bytes.

    Of rows that repeat an id the text of smallest hash counts; repeated labels count as toxic if one is.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & use(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash")).join(F.broadcast(chosen), "doc_id")
    sized = rows.groupBy("doc_id").agg(F.min(F.struct("_hash", F.octet_length("text").alias("_size"))).alias("_one"))
    running = F.sum("_one._size").over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most ``sample`` rows
    fits = sized.withColumn("_all", running).where(F.col("_all") <= size).select("doc_id", "_one._hash")
    found = rows.join(F.broadcast(fits), ["doc_id", "_hash"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").toArrow().sort_by([("doc_id", "ascending")])
    return found.column("text").combine_chunks(), found.column("toxic").to_numpy().astype(np.int64)


def held_out(doc_id, parts: int = 4):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == 2


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row.

    Null and empty texts have no hits and score as such, equal texts alike; an empty table
    gives no rows.  Extra columns, clashing names included, are not used.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op6_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(*training_rows(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i)))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
