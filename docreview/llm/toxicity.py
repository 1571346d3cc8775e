"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as classes: insult, threat, target, negation, report, other. Five small transducers
read the classes of a clause in sequence, each rewriting what the one before it wrote; they are
composed into one machine beforehand. What it says about a clause - a plain, aimed, negated or
reported insult, a threat, a negated or reported threat - is weighed by the words that matched, and
a logistic model over the sums by kind gives the score. A word alone has no score: the clause has."""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreview.llm.common import text_or_empty
from docreview.session import stage

# Words of the grammar in English, German, French and Spanish.
INSULTS = (
    "idiot moron loser scum stupid worthless pathetic disgusting trash clown fool dumb "
    "trottel dummkopf abschaum versager wertlos widerlich idiote imbécile crétin ordure minable "
    "idiota imbécil estúpido basura payaso inútil"
).split()
THREATS = (
    "kill hurt destroy beat shoot stab burn töten umbringen vernichten verprügeln erschießen "
    "tuer frapper détruire brûler matar golpear destruir quemar"
).split()
TARGETS = "you your he she they him them du dich dein ihr euch sie tu toi vous ton ils tú te usted vosotros ellos".split()
NEGATIONS = "not never no isn't aren't nicht kein keine nie ne pas jamais aucun nunca ningún tampoco".split()
REPORTS = (
    "said says called wrote claimed quoted sagte sagt nannte schrieb behauptete dit appelé écrit déclaré "
    "dijo dice llamó escribió afirmó"
).split()
KINDS = (
    "insult", "aimed_insult", "negated_insult", "reported_insult", "threat", "negated_threat", "reported_threat",
)
#: Weights of the kinds before labels are seen, and the score of a text without matches.
PRIOR = (2.5, 3.0, 0.5, 0.5, 3.0, 0.5, 0.5)
PRIOR_BIAS = -3.0
#: Labelled rows, by least hash of the key, that are learned from at most.
FIT_ROWS = 12_000
#: Insults that are learned at most, how many different words must precede one in toxic texts, and
#: the log odds from which a word or beginning counts as one.
LEXICON = 5_000
MIN_CONTEXTS = 6
MIN_LOG_ODDS = 3.0
BEGINNINGS = (4, 5, 6, 7, 8)
#: A clause or text counts for so much at most.
MOST = 10.0
TOKEN = re.compile(r"[^\W\d_]+(?:'t)?|[.!?;:\n]")
WORDS = re.compile(r"[^\W\d_]+")
ENDS = frozenset(".!?;:\n")


@dataclass
class Transducer:
    """Reads symbols one by one. Without an arc a symbol passes unchanged and the state stays."""

    arcs: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (state, symbol))


#: A threat is one only with someone to aim at; both orders occur ("hurt you", "you will be hurt").
AIMING = Transducer({
    ("", "target"): ("target", "target"),
    ("target", "insult"): ("target", "aimed_insult"),
    ("target", "verb"): ("target", "threat"),
    ("", "verb"): ("verb", "other"),
    ("verb", "target"): ("target", "threat"),
    ("", "insult"): ("insult", "insult"),
    ("insult", "target"): ("target", "aimed_insult"),
})
NEGATING = Transducer({
    ("", "negation"): ("negated", "negation"),
    ("negated", "insult"): ("negated", "negated_insult"),
    ("negated", "aimed_insult"): ("negated", "negated_insult"),
    ("negated", "threat"): ("negated", "negated_threat"),
    ("negated", "negation"): ("", "negation"),
})
REPORTING = Transducer({
    ("", "report"): ("reported", "report"),
    ("reported", "insult"): ("reported", "reported_insult"),
    ("reported", "aimed_insult"): ("reported", "reported_insult"),
    ("reported", "negated_insult"): ("reported", "reported_insult"),
    ("reported", "threat"): ("reported", "reported_threat"),
    ("reported", "negated_threat"): ("reported", "reported_threat"),
})
CLASSES = ("insult", "verb", "target", "negation", "report")


def compose(*machines: Transducer) -> dict[tuple[str, ...], dict[str, tuple[tuple[str, ...], str]]]:
    """The machine that feeds each symbol through all of them: state -> symbol -> (state, output)."""
    start = ("",) * len(machines)
    table, todo = {}, [start]
    while todo:
        state = todo.pop()
        if state in table:
            continue
        table[state] = {}
        for symbol in CLASSES:
            after, out = [], symbol
            for machine, at in zip(machines, state, strict=True):
                at, out = machine.step(at, out)
                after.append(at)
            table[state][symbol] = (tuple(after), out)
            todo.append(tuple(after))
    return table


GRAMMAR = compose(AIMING, NEGATING, REPORTING)


class Reader:
    """Finds the clauses of a text that hold an insult or a threat, and weighs them by kind."""

    def __init__(self, insults: dict[str, float]):
        self.insults = {**dict.fromkeys(INSULTS, 4.0), **insults}
        self.heads = {w[: BEGINNINGS[0]] for w in (*self.insults, *THREATS)}
        self.classes = {
            w: name
            for name, words in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("verb", THREATS))
            for w in words
        }

    def insult(self, word: str) -> float:
        weights = self.insults
        return max(weights.get(word, 0.0), *(weights.get(word[:n] + "*", 0.0) for n in BEGINNINGS))

    def kinds(self, text: str) -> list[float]:
        sums = dict.fromkeys(KINDS, 0.0)
        tokens = TOKEN.findall(text.lower())
        heads, end = self.heads, -1
        for i, token in enumerate(tokens):
            if i <= end or token[: BEGINNINGS[0]] not in heads:
                continue
            start = i
            while start > 0 and tokens[start - 1] not in ENDS:
                start -= 1
            end = i
            while end + 1 < len(tokens) and tokens[end + 1] not in ENDS:
                end += 1
            for kind, weight in self.clause(tokens[start : end + 1]):
                sums[kind] += weight
        return [min(sums[k], MOST) for k in KINDS]

    def clause(self, words: list[str]) -> Iterator[tuple[str, float]]:
        state, heaviest = ("",) * 3, 0.0
        for word in words:
            weight = self.insult(word) if word[: BEGINNINGS[0]] in self.heads else 0.0
            symbol = "insult" if weight else self.classes.get(word)
            if symbol is None:
                continue
            heaviest = max(heaviest, weight)
            state, out = GRAMMAR[state][symbol]
            if out in KINDS:
                yield out, (heaviest if "insult" in out else 4.0) / 4.0


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def forms_of(word: str) -> list[str]:
    """The word, and its beginnings with a star."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]]


def learn_insults(rows: DataFrame) -> dict[str, float]:
    """Words, and beginnings of 4 to 8 letters (with a star), that toxic texts have and others lack.

    `rows` has text and toxic. In toxic texts a form is counted by how many different words precede
    it: in copies of one text it counts once. Forms under the limit of support are out before the
    other texts are read, where all occurrences count; each task sends one count per form. Only
    entries over the limit of log odds, at most LEXICON, are kept."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    pairs = F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, before: F.struct(w.alias("w"), before.alias("before")))
    toxic = rows.where("toxic").select(F.explode(F.filter(pairs, lambda p: p["w"].isNotNull())).alias("p")).select("p.*").distinct()
    forms = F.array(
        F.col("w"),
        *[F.when(F.length("w") >= n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in BEGINNINGS],
    )
    toxic = stage(toxic.select("before", F.explode(F.array_compact(forms)).alias("form")).distinct().groupBy("form").agg(F.count("*").alias("t")))
    pairs_seen = toxic.agg(F.sum(F.when(~F.col("form").endswith("*"), F.col("t")))).first()[0] or 0
    supported = {r["form"]: r["t"] for r in toxic.where(F.col("t") >= MIN_CONTEXTS).toLocalIterator()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                tokens = WORDS.findall(t.lower())
                found[""] += len(tokens)
                for w, n in Counter(tokens).items():
                    for form in forms_of(w):
                        if form in supported:
                            found[form] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["form", "n"])

    others = {
        r["form"]: r["n"]
        for r in rows.where("NOT toxic").select("text").mapInArrow(count, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).collect()
    }
    seen = others.pop("", 0)
    odds = {
        form: math.log((t + 0.5) / (pairs_seen + 1)) - math.log((others.get(form, 0) + 0.5) / (seen + 1))
        for form, t in supported.items()
    }
    best = sorted((-o, form) for form, o in odds.items() if o >= MIN_LOG_ODDS)[:LEXICON]
    return {form: -o for o, form in best}


def kind_sums(df: DataFrame, reader: Reader, text: str) -> DataFrame:
    """`df` without `text`, with an array of the sums by kind, in batches where it is read."""
    others = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField("kinds", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [reader.kinds(t) for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(sums, pa.list_(pa.float64()))], schema.names
            )

    return df.select(*others, text_or_empty(text).alias(text)).mapInArrow(run, schema)


def fit_weights(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights with the bias first, drawn towards the prior ones; by Newton's method."""
    prior = np.array([PRIOR_BIAS, *PRIOR])
    x, w = np.column_stack([np.ones(len(labels)), features]), prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row for every row of `df`: key, held_out, score, predicted.

    Labels are learned from only where the CRC-32 of the key as text is not divisible by 5, from at
    most `fit_rows` rows with a label of 0 or 1 (a key that is labelled twice counts as toxic if
    one label says so). Labels, languages and sources are no inputs of a score. Without labelled
    rows the fixed words and prior weights hold. A null text counts as empty and gets the score of
    a text without matches; a null key as the empty string. Repeated rows give repeated rows. Other
    columns are not read. An empty table gives no rows.

    The rows learned from are bounded and so broadcast by key; the whole table is scored in batches
    where it is read."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(
        F.col(key).alias("_key")
    ).agg(F.max(F.col(label) == 1).alias("toxic")).orderBy(F.xxhash64("_key"), "_key").limit(fit_rows)
    rows = df.select(F.col(key).alias("_key"), text_or_empty(text).alias("text")).join(F.broadcast(known), "_key")
    reader = Reader(learn_insults(rows.select("text", "toxic")))
    sums = kind_sums(rows.select("toxic", "text"), reader, "text").groupBy("toxic", "kinds").count().toPandas()
    if len(sums):
        x = np.repeat(np.array(sums["kinds"].tolist()), sums["count"], axis=0)
        weights = fit_weights(x, np.repeat(sums["toxic"].to_numpy(float), sums["count"]))
    else:
        weights = np.array([PRIOR_BIAS, *PRIOR])
    terms = F.aggregate(
        F.zip_with("kinds", F.array(*[F.lit(float(w)) for w in weights[1:]]), lambda x, w: x * w),
        F.lit(float(weights[0])), lambda a, x: a + x,
    )
    scored = kind_sums(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), reader, "_text")
    return scored.withColumn("score", 1 / (1 + F.exp(-terms))).select(
        F.col("_key").alias(key), held_out(F.col("_key")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
