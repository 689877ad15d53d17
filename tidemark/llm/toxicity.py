"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause, which ends with a sentence, is a string of signs: insult, weak insult, threat, target, actor, predicate, negation,
report, other. Six transducers are composed to one: a bare insult carries little weight, a negation before it and reported
speech damp it, a predicate before it and a target nearby sharpen it, and a threat counts only after one who acts and before
a target. Commas, colons and quotation marks are read over: speech is reported behind them too. The weight of a clause is
that of the best path over it; words enter only through the signs on the arcs. A document's clause weights are summed and calibrated to a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, written
from tidemark.llm.labelled import held_out, sample
from tidemark.llm.transducers import Arc, Transducer

# Words of the grammar's classes in English, German, French and Spanish.
INSULTS = """
idiot idiots moron morons imbecile stupid dumb dumbass fool loser losers scum trash garbage worthless pathetic disgusting clown jerk bastard bitch asshole retard pig vermin filth
idiot idiotin trottel dummkopf arschloch abschaum versager dreckskerl schwachkopf widerlich erbärmlich
imbécile crétin abruti connard connasse salaud ordure minable débile pourriture
idiota imbécil estúpido estúpida basura escoria gilipollas cabrón inútil asqueroso patético
""".split()
THREATS = "kill hurt destroy beat smash burn shoot stab crush töten umbringen schlagen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your you're they them their u dich dir euch du ihr toi vous ton votre te tú ti tu vosotros ustedes".split()
ACTORS = "i i'll i'm we we'll we're will gonna going should must ich wir werde werden sollte je nous vais allons va yo nosotros voy vamos".split()
PREDICATES = "is are am was such bist ist sind seid est es êtes sont eres son".split()
NEGATIONS = "not never no isn't aren't wasn't don't nobody nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote quoted quote called reported sagte sagt schrieb zitierte dit disait écrit dijo dice escribió".split()

PREFIXES = (4, 5, 6, 7, 8)
#: A learned feature needs so many toxic documents and such log odds.
LEAST_TOXIC, LEAST_ODDS, STRONG_ODDS = 5, 3.5, 4.5
SIGN = {"insult": "I", "weak": "i", "threat": "V", "target": "T", "negation": "N", "report": "R", "actor": "A", "predicate": "P", "end": "|"}
SIGNS = "IiVTNRAP."
#: Weights: of an insult and a weak one; what a negation, a report, a predicate and a target add to each; of a threat by an actor at a target.
INSULT, NEGATED, REPORTED = {"I": 0.5, "i": 0.3}, {"I": -0.4, "i": -0.25}, {"I": -0.3, "i": -0.2}
PREDICATED, TARGETED, THREAT = {"I": 0.4, "i": 0.3}, {"I": 0.5, "i": 0.4}, 1.5
#: How many words a negation and a predicate reach; how far a target is before or after an insult; an actor before a threat, and a target after it.
NEGATION_REACH, PREDICATE_REACH, TARGET_BEFORE, TARGET_AFTER, ACTOR_REACH, THREAT_REACH = 3, 3, 4, 4, 4, 4
LONGEST_REACH = 5
#: Marks that end a clause, and marks that are read over as a word is.
ENDS, MARKS = ".;!?|\x00", ",:"
FAR = re.compile(rf"\.{{{LONGEST_REACH},}}")
PART = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.,;:!?|\x00]")


@dataclass(frozen=True)
class Lexicon:
    """Insults learned (words, and beginnings of words) and the calibration of summed weights."""

    strong: frozenset[str]
    weak: frozenset[str]
    calibration: tuple[float, float] = (-3.0, 6.0)


def _insults() -> Transducer:
    """Insults keep their sign and carry their weight."""
    return Transducer.of(0, [0], [(0, sign, sign, INSULT.get(sign, 0.0), 0) for sign in SIGNS])


def _negations() -> Transducer:
    """The state is how many more words a negation reaches. Insults it reaches are damped (n), threats are none."""
    arcs: list[Arc] = []
    for left in range(NEGATION_REACH + 1):
        for sign in SIGNS:
            if sign == "N":
                arcs.append((left, "N", "N", 0.0, NEGATION_REACH))
            elif left and sign in NEGATED:
                arcs.append((left, sign, "n", NEGATED[sign], left - 1))
            else:
                arcs.append((left, sign, "." if left and sign == "V" else sign, 0.0, max(0, left - 1)))
    return Transducer.of(0, range(NEGATION_REACH + 1), arcs)


def _reports() -> Transducer:
    """After a word of reporting the rest of the clause is another's: insults are damped (r), threats are none."""
    before = [(0, sign, sign, 0.0, int(sign == "R")) for sign in SIGNS + "n"]
    after = [(1, sign, "r" if sign in REPORTED else "." if sign == "V" else sign, REPORTED.get(sign, 0.0), 1) for sign in SIGNS + "n"]
    return Transducer.of(0, [0, 1], before + after)


def _predicates() -> Transducer:
    """The state is how many more words a predicate reaches; an insult there gains weight and keeps its sign."""
    arcs: list[Arc] = []
    for left in range(PREDICATE_REACH + 1):
        for sign in SIGNS + "nr":
            arcs.append((left, sign, sign, PREDICATED.get(sign, 0.0) if left else 0.0, PREDICATE_REACH if sign == "P" else max(0, left - 1)))
    return Transducer.of(0, range(PREDICATE_REACH + 1), arcs)


def _targets() -> Transducer:
    """Insults with a target within reach on either side are written anew (S) and gain weight.

    State (k, "seen"): a target was read at most before - k words ago. State (k, "due"): a path has counted on a target that
    must come within k words; it is not final. Both ways are open to an insult that no target precedes; the best path decides.
    """
    free, arcs = (0, "seen"), []
    for k, kind in [(k, "seen") for k in range(TARGET_BEFORE + 1)] + [(k, "due") for k in range(1, TARGET_AFTER + 1)]:
        on = (k - 1, kind) if k > (kind == "due") else free if kind == "seen" else None
        for sign in SIGNS + "nr":
            matched = sign in TARGETED
            if sign == "T":
                arcs.append(((k, kind), "T", "T", 0.0, (TARGET_BEFORE, "seen")))
            elif on and (kind == "due" or k):
                arcs.append(((k, kind), sign, "S" if matched else sign, TARGETED.get(sign, 0.0), on))
            elif on:
                arcs.append(((k, kind), sign, sign, 0.0, free))
                if matched:
                    arcs.append(((k, kind), sign, "S", TARGETED[sign], (TARGET_AFTER, "due")))
    return Transducer.of(free, [(k, "seen") for k in range(TARGET_BEFORE + 1)], arcs)


def _threats() -> Transducer:
    """A threat (W) carries weight if an actor is within reach before it and a target after it; else it is another word.

    State (left, due): how many more words an actor reaches, and, if due, within how many a target must come.
    """
    arcs: list[Arc] = []
    for left in range(ACTOR_REACH + 1):
        for due in range(THREAT_REACH + 1):
            for sign in SIGNS + "nrS":
                ahead = ACTOR_REACH if sign == "A" else max(0, left - 1)
                if sign == "T":
                    arcs.append(((left, due), sign, sign, 0.0, (ahead, 0)))
                elif due != 1:
                    arcs.append(((left, due), sign, "." if sign == "V" else sign, 0.0, (ahead, max(0, due - 1))))
                if sign == "V" and left and due != 1:
                    arcs.append(((left, due), sign, "W", THREAT, (ahead, due - 1 if due else THREAT_REACH)))
    return Transducer.of((0, 0), [(left, 0) for left in range(ACTOR_REACH + 1)], arcs)


def machines() -> list[Transducer]:
    """The transducers in the order of their composition."""
    return [_insults(), _negations(), _reports(), _predicates(), _targets(), _threats()]


@cache
def clause_grammar() -> Transducer:
    """All transducers composed to one."""
    return reduce(lambda one, next_one: one.then(next_one, SIGNS), machines())


def plain_signs(clause: str) -> str:
    """The clause without signs that change nothing in it: actors where there is no threat, predicates where there is no insult."""
    clause = clause if "V" in clause else clause.replace("A", ".")
    return (clause if "I" in clause or "i" in clause else clause.replace("P", ".")).strip(".")


def clause_weight(signs: str) -> float:
    """The weight of the best path over a clause. Other words beyond every reach change nothing, so they are cut short."""
    return clause_grammar().best(FAR.sub("." * LONGEST_REACH, signs.strip(".")))


class Grammar:
    """The signs of a text's words, by fixed words and a learned lexicon, and the weights of its clauses."""

    def __init__(self, lexicon: Lexicon):
        self.classes = {w: SIGN[name] for name, words in (("report", REPORTS), ("negation", NEGATIONS), ("predicate", PREDICATES), ("actor", ACTORS), ("target", TARGETS), ("threat", THREATS), ("insult", INSULTS)) for w in words}
        self.lexicon = lexicon
        self.signs = Memo(self._signs_of)
        self.clauses = Memo(clause_weight)

    def _sign(self, word: str) -> str:
        if word in self.classes:
            return self.classes[word]
        features = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
        return "I" if any(f in self.lexicon.strong for f in features) else "i" if any(f in self.lexicon.weak for f in features) else "."

    def _signs_of(self, token: str) -> str:
        return "".join("|" if part in ENDS else "." if part in MARKS else self._sign(part) for part in PART.findall(token))

    def raw(self, text: str | None) -> float:
        """The summed weights of the clauses."""
        signs = "".join(map(self.signs.__getitem__, (text or "").lower().replace("\n", " \x00 ").split()))
        if not ("I" in signs or "i" in signs or "V" in signs):
            return 0.0
        return sum(self.clauses[plain_signs(clause)] for clause in signs.split("|") if "I" in clause or "i" in clause or "V" in clause)

    def score(self, raw: float) -> float:
        a, b = self.lexicon.calibration
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(raw), -30, 30))))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled text its label, its distinct features, and the least of its shingles' hashes, which near copies share."""
    for batch in batches:
        sketches, features = [], []
        for value in batch.column(0):
            words = [w for w in PART.findall((value.as_py() or "").lower()) if w[0].isalpha()]
            found = {f for w in set(words) for f in (w, *("^" + w[:n] for n in PREFIXES if len(w) > n))}
            features.append(list(found))
            sketches.append(min((xxhash.xxh64_intdigest(" ".join(words[k : k + 5])) >> 1 for k in range(max(1, len(words) - 4))), default=0))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sketches, pa.int64()), pa.array(features, pa.list_(pa.string()))], ["label", "sketch", "features"])


def _calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """A logistic fit of label on log(1 + raw), by Newton steps with a small ridge."""
    x, w = np.stack([np.ones(len(raw)), np.log1p(raw)], axis=1), np.array(Lexicon.calibration)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) + 0.02 * (w - Lexicon.calibration)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2), gradient)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(w[0]), float(max(0.5, w[1]))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, rows: int | None = None) -> Lexicon:
    """Learns insults and the calibration from at most ``rows`` (SAMPLE_ROWS) labelled documents that are not held out.

    Near copies of one document count once. Without labels the fixed words and the default calibration remain. What the
    driver gets are features of that bounded sample which at least LEAST_TOXIC toxic documents hold.
    """
    known = sample(docs.select("doc_id", "text"), labels, "toxic", modulus, rest, *([rows] if rows else []))
    known = written(known.select("text", F.col("label").cast("int").alias("label")), "labelled")
    sketched = known.mapInArrow(_sketch, "label int, sketch long, features array<string>")
    single = sketched.groupBy("sketch").agg(F.max(F.struct("label", "features")).alias("_")).select("_.*")
    single = written(single, "sketches")
    totals = single.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    toxic, clean = int(totals[0]), int(totals[1] - totals[0])
    counts = single.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    likely = counts.withColumn("odds", odds).filter((F.col("t") >= max(LEAST_TOXIC, 0.004 * toxic)) & (F.col("odds") >= LEAST_ODDS))
    kept = likely.select("feature", "odds").collect()
    lexicon = Lexicon(frozenset(r.feature for r in kept if r.odds >= STRONG_ODDS), frozenset(r.feature for r in kept if r.odds < STRONG_ODDS))
    if not toxic or not clean:
        return lexicon
    raws = known.mapInArrow(_raws(lexicon), "raw double, label int").toPandas()
    return Lexicon(lexicon.strong, lexicon.weak, _calibrate(raws["raw"].to_numpy(), raws["label"].to_numpy(float)))


def _raws(lexicon: Lexicon):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.raw(v.as_py()) for v in batch.column(0)], pa.float64()), batch.column(1)], ["raw", "label"])

    return measure


def score(docs: DataFrame, lexicon: Lexicon, carry: list[str] | None = None) -> DataFrame:
    """doc_id and toxicity_score, 0 to 1, of every whole text; null and empty texts get the score of no match. ``carry`` adds columns."""
    columns = ["doc_id", "text", *(c for c in carry or [] if c not in ("doc_id", "text"))]
    chosen, out = docs.select(*columns), ["doc_id", *(carry or [])]
    out = list(dict.fromkeys(out))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            scores = [grammar.score(grammar.raw(v.as_py())) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in out), pa.array(scores, pa.float64())], [*out, "toxicity_score"])

    fields = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in out)
    return chosen.mapInArrow(measure, f"{fields}, toxicity_score double")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per document of docs (doc_id, text; others are ignored): doc_id, held_out, score, predicted.

    Null and empty texts get the score of no match. Rows that repeat are scored each, also of a null doc_id; equal texts get
    equal scores. An empty table gives no rows; without labels the fixed words decide.
    """
    found = score(docs, fit(docs, labels, modulus, rest))
    return found.select("doc_id", held_out(modulus, rest).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= threshold).cast("int").alias("predicted"))
