"""Toxicity by a weighted finite-state pattern grammar.

Texts are read as clauses (split at punctuation and line ends), a clause as a sequence of word classes that a
lexicon assigns: insult (word stems learned from labelled rows), threat, target, object (a target that may
stand before its verb), negation, reporting verb, contrast, or other. Four transducers read that sequence and
are composed to one machine, which runs over each clause once:

negation   marks insults and threats within SCOPE words after a negation, up to a contrast
reported   marks those after a reporting verb, up to a contrast
threat     turns a threat with its target (at most AFTER words later, or an object up to BEFORE words earlier)
           into a finished threat, and drops those without one ("kill time")
target     marks insults that come after a target

Order and scope count: "not a fool" is negated, "a fool, not that it matters" is not. Each accepted insult adds
the weight of its stem (the log of how much likelier a toxic document has it) times the weights of its marks:
DAMPED for negated and reported ones, moved by what labelled rows show. A stem that clean texts have too weighs by how far its amount exceeds what
a text of that length has by chance. A logistic curve fitted to the labelled rows turns the sum into the score. A finished threat has a score of its
own (THREAT, moved by what labelled rows with one show); the larger one counts. Words outside matched clauses
do not count.

Learning is from a bounded sample of labelled rows (SAMPLE_ROWS a class). Stems are word beginnings of 3 to 8
letters or whole words: those of MIN_DOCS toxic documents or more that few clean ones have, or that come twice
in at least TWICE_DOCS toxic ones and twice in few clean ones. They are chosen greedily by the toxic documents
they newly explain, so that near copies of one document add few stems.

Defined cases: null and empty texts get the base score and predicted 0; without labelled rows the
grammar is the fixed threat patterns only. Repeated doc_ids give a row each; null labels, and those other than
0 and 1, are ignored; of several labels of a document the largest counts. Columns other than doc_id and text
(doc_id and toxic of labels) are ignored. Clauses have no largest length; memory follows a text's clause.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, bounded, fold, record, release, sampled, table
from .storage import saved

#: Bound of the labelled rows learned from, for each class.
SAMPLE_ROWS = 6_000
MIN_DOCS, MIN_SHARE, TWICE_DOCS, TWICE_SHARE, SURE, THRESHOLD = 4, 0.9, 3, 0.8, 14.0, 0.7
SCOPE, AFTER, BEFORE, THREAT, LEAN, TOXIC_COUNTS = 6, 2, 3, 0.75, 8, 6.0
#: Weights of the marks: n negated, r reported; t targeted.
DAMPED, TARGETED = {"": 1.0, "n": 0.2, "r": 0.4, "nr": 0.1}, 1.2
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[.,;:!?\n|]")
# Fixed word lists of the small transducers.
TARGETS = frozenset("you your yours yourself them they him her us du ihr sie ihn ihnen mich uns tu toi vous lui eux nous tú usted ustedes ellos".split())
OBJECTS = frozenset("dich euch te vous os".split())
NEGATIONS = frozenset("not no never nobody none nor isn't aren't wasn't don't doesn't didn't won't wouldn't can't cannot couldn't nicht kein keine keiner keinen niemand nie pas jamais ne aucun nunca jamás nadie ningún".split())
REPORTING = frozenset("said says say told tells quoted reported reports claimed claims wrote writes called calls sagte sagt sagen schrieb nannte dit disait dirent raconta dijo dice decía escribió llamó".split())
CONTRASTS = frozenset("but yet however although aber doch sondern mais pourtant pero sino".split())
THREATS = frozenset("kill kills murder hurt destroy beat shoot stab strangle töten umbringen erschießen schlagen tuer frapper égorger matar golpear".split())
SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("clauses", pa.int32())])


class Machine:
    """A transducer that reads and writes one symbol a step: arcs[state][symbol] = (next state, output)."""

    def __init__(self, start, step, symbols):
        self.start, self.arcs = start, {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state not in self.arcs:
                self.arcs[state] = {x: step(state, x) for x in symbols}
                todo += [to for to, _ in self.arcs[state].values()]

    def __call__(self, symbols) -> list:
        state, out = self.start, []
        for x in symbols:
            state, y = self.arcs[state][x]
            out.append(y)
        return out

    def outputs(self) -> set:
        return {y for row in self.arcs.values() for _, y in row.values()}

    def then(self, other: Machine) -> Machine:
        """The composition: what `other` writes for what this one writes."""

        def step(state, x):
            mine, y = self.arcs[state[0]][x]
            theirs, z = other.arcs[state[1]][y]
            return (mine, theirs), z

        return Machine((self.start, other.start), step, next(iter(self.arcs.values())))


#: Classes of words: insult, threat, target, object, negation, reporting verb, contrast, other.
CLASSES = "I T Y P N R B O".split()


def negation_step(left: int, x: str):
    if x == "N":
        return SCOPE, x
    if x == "B":
        return 0, x
    return max(0, left - 1), x + "n" if left and x[0] in "IT" else x


def reported_step(inside: bool, x: str):
    if x in "RB":
        return x == "R", x
    return inside, x + "r" if inside and x[0] in "IT" else x


def threat_step(state: tuple, x: str):
    """state: marks of an open threat (or None) and words left for its target; words since an object."""
    marks, left, since = state
    if x == "P":
        since = BEFORE
    if x[0] == "T":
        if since:
            return (None, 0, 0), "X" + x[1:]
        return (x[1:], AFTER, 0), "O"
    if x in "YP" and left:
        return (None, 0, since), "X" + marks
    left, since = max(0, left - 1), since if x == "P" else max(0, since - 1)
    return (marks if left else None, left, since), x


def target_step(seen: bool, x: str):
    if x in ("Y", "P") or x[0] == "X":
        return True, x
    return seen, x + "t" if seen and x[0] == "I" else x


def composed() -> Machine:
    """negation, reported, threat and target, composed."""
    whole = Machine(0, negation_step, CLASSES)
    for start, step in ((False, reported_step), ((None, 0, 0), threat_step), (False, target_step)):
        whole = whole.then(Machine(start, step, sorted(whole.outputs())))
    return whole


MACHINE = composed()


def stems(word: str):
    """What a word can be accepted as: its beginnings, and (with a stop mark) as a whole."""
    for n in range(3, min(8, len(word)) + 1):
        yield word[:n]
    yield word + "$"


def beyond_chance(amount: float, words: int, rate: float) -> float:
    """How much an amount exceeds what a text of so many words has by chance: a log-likelihood ratio of Poisson rates."""
    expected = words * rate
    return max(0.0, amount * math.log(amount / (expected + 0.05)) - (amount - expected)) if amount > expected else 0.0


class Grammar:
    """insults: (weight, chance rate a word) of each stem. curve: base log-odds, their slopes in the two sums of evidence, and the score of a threat."""

    def __init__(self, insults: dict[str, tuple[float, float]], curve: tuple[float, float, float, float] = (-2.9, 1.0, 1.0, THREAT), marks: dict[str, float] | None = None):
        import ahocorasick

        self.insults, self.curve, self.marks = dict(insults), curve, DAMPED | (marks or {})
        self.trie = ahocorasick.Automaton()
        for s in {s.rstrip("$") for s in self.insults} | THREATS:
            self.trie.add_word(s, len(s))
        self.trie.make_automaton()

    def read(self, word: str) -> tuple[str, str | None]:
        """Class of a word, and its stem of the greatest weight if it is an insult."""
        found = [s for s in stems(word) if s in self.insults]
        if found:
            return "I", max(found, key=lambda s: (self.insults[s][0], -len(s), s))
        for x, words in (("T", THREATS), ("P", OBJECTS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTING), ("B", CONTRASTS)):
            if word in words:
                return x, None
        return "O", None

    def clauses(self, text: str | None):
        """For every clause with a match: (stem, marks) of its insults and ("!", marks) of its threats."""
        low = (text or "").lower().replace("’", "'")
        end = -1
        for last, size in self.trie.iter(low):
            first = last - size + 1
            if first < end or first and low[first - 1].isalpha():
                continue
            start = max(low.rfind(c, max(end, 0), first) for c in ".,;:!?\n|") + 1
            start, stop = max(start, end, 0), CLAUSE.search(low, last + 1)
            end = stop.start() if stop else len(low)
            read = [self.read(w) for w in WORD.findall(low, start, end)]
            out = [("!" if y[0] == "X" else stem, y[1:]) for (_, stem), y in zip(read, MACHINE([x for x, _ in read])) if y[0] in "IX" and (stem or y[0] == "X")]
            if out:
                yield out

    def evidence(self, text: str | None) -> tuple[float, float, float, int]:
        """Summed weights of the stems that clean texts lack; of the others, what is beyond chance; the strongest threat's weight; matched clauses."""
        amount: dict = defaultdict(float)
        threat, n = 0.0, 0
        for clause in self.clauses(text):
            n += 1
            for stem, marks in clause:
                if stem == "!":
                    threat = max(threat, DAMPED[marks])
                else:
                    amount[stem] += self.marks[marks.rstrip("t")] * (TARGETED if marks.endswith("t") else 1.0)
        if not amount:
            return 0.0, 0.0, threat, n
        words = len(WORD.findall(text))
        plain = sum(self.insults[s][0] * a for s, a in amount.items() if not self.insults[s][1])
        return plain, sum(beyond_chance(a, words, self.insults[s][1]) for s, a in amount.items() if self.insults[s][1]), threat, n

    def score(self, text: str | None) -> tuple[float, int]:
        plain, excess, threat, n = self.evidence(text)
        base, of_plain, of_excess, top = self.curve
        return max(1 / (1 + math.exp(-max(-30.0, min(30.0, base + of_plain * plain + of_excess * excess)))), top * threat), n


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """docs: doc_id, text; labels: doc_id, toxic. Only counts of a bounded sample reach the driver."""
    some: dict = {}
    for d, y in sampled(labels.where(F.col("toxic").isin(0, 1)), "toxic", SAMPLE_ROWS).select("doc_id", "toxic").collect():
        if d is not None:
            some[d] = max(y, some.get(d, 0))
    if not some:
        return Grammar({})
    picked = bounded(docs).sparkSession.createDataFrame(sorted(some.items()), "doc_id long, toxic int")
    # about 2 x SAMPLE_ROWS rows, so the texts need no shuffle
    rows = saved(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))

    def count(it):
        yield tally(zip_rows(it))

    counted = rows.mapInArrow(count, "stem string, clean long, bad long, clean2 long, bad2 long, hits long, words long").groupBy("stem")
    counted = counted.agg(*(F.sum(k).alias(k) for k in ("clean", "bad", "clean2", "bad2", "hits", "words")))
    # at most what TWICE_DOCS or more of the sample's toxic documents share
    fields = ("bad", "clean", "bad2", "clean2", "hits", "words")
    kept = distinct({r[0]: dict(zip(fields, r[1:])) for r in counted.where(candidate()).select("stem", *fields).collect()})
    names = sorted(kept)
    n = {"bad": sum(some.values()), "clean": len(some) - sum(some.values())}
    number = {s: (i, precise(kept[s])) for i, s in enumerate(names)}

    def holders(it):
        for (texts,) in batches(it, "text"):
            yield pa.RecordBatch.from_pydict({"stems": pa.array([held(t, number) for t in texts], pa.list_(pa.int32()))})

    has = [r[0] for r in rows.where("toxic = 1").mapInArrow(holders, "stems array<int>").collect()] if kept else []
    insults = weigh([names[i] for i in cover(has, [kept[s] for s in names], names, n["bad"] / len(some))], kept, n)

    def marked(it):
        g, of = Grammar(insults), Counter()
        for t, y in zip_rows(it):
            of.update((m.rstrip("t"), y) for c in g.clauses(t) for stem, m in c if stem != "!")
        yield pa.RecordBatch.from_pydict({"mark": pa.array([m for m, _ in of], pa.string()), "y": pa.array([y for _, y in of], pa.int32()), "n": pa.array(list(of.values()), pa.int64())})

    marks = weigh_marks({(r["mark"], r["y"]): r["n"] for r in rows.mapInArrow(marked, "mark string, y int, n long").groupBy("mark", "y").agg(F.sum("n").alias("n")).collect()})

    def trial(it):
        g = Grammar(insults, marks=marks)
        for texts, toxic in batches(it, "text", "toxic"):
            got = [g.evidence(t) for t in texts]
            yield pa.RecordBatch.from_pydict({k: pa.array([x[i] for x in got], pa.float64()) for i, k in enumerate(("plain", "excess", "threat"))} | {"y": pa.array(toxic, pa.int32())})

    seen = rows.mapInArrow(trial, "plain double, excess double, threat double, y int").collect()  # a row a sampled document
    return Grammar(insults, curve([tuple(r) for r in seen]), marks)


def zip_rows(it):
    for texts, toxic in batches(it, "text", "toxic"):
        yield from zip(texts, toxic)


def tally(rows) -> pa.RecordBatch:
    """Of each stem: clean and toxic documents that have it, that have it twice, and its hits in and the words of clean ones that have it."""
    totals: dict[str, list] = defaultdict(lambda: [0] * 6)
    for t, y in rows:
        words = [w.lower() for w in WORD.findall(t or "")]
        of: Counter = Counter()
        for w, k in Counter(words).items():
            for s in stems(w):
                of[s] += k
        for s, k in of.items():
            row = totals[s]
            row[y] += 1
            row[2 + y] += k > 1
            if not y:
                row[4] += k
                row[5] += len(words)
    names = ("clean", "bad", "clean2", "bad2", "hits", "words")
    return pa.RecordBatch.from_pydict({"stem": pa.array(list(totals), pa.string())} | {k: pa.array([v[i] for v in totals.values()], pa.int64()) for i, k in enumerate(names)})


def candidate():
    once = (F.col("bad") >= MIN_DOCS) & (F.col("bad") >= MIN_SHARE * (F.col("bad") + F.col("clean")))
    return once | (F.col("bad2") >= TWICE_DOCS) & (F.col("bad2") >= TWICE_SHARE * (F.col("bad2") + F.col("clean2")))


def precise(r) -> bool:
    """Whether to have the stem once says enough."""
    return r["bad"] >= MIN_DOCS and r["bad"] >= MIN_SHARE * (r["bad"] + r["clean"])


def distinct(kept: dict) -> dict:
    """Without the beginnings that only continue to one of the same counts: the same documents have both."""
    counts = lambda s: [kept[s][k] for k in ("bad", "clean", "bad2", "clean2")]
    gone = {s[:-1] for s in kept if s[:-1] in kept and counts(s) == counts(s[:-1])}
    return {s: r for s, r in kept.items() if s not in gone}


def held(text: str | None, number: dict[str, tuple[int, bool]]) -> list[int]:
    """Numbers of the stems that a text has: once, of those for which that says enough, and twice, of the others."""
    of: Counter = Counter()
    for w in WORD.findall((text or "").lower()):
        for s in stems(w):
            if s in number:
                of[s] += 1
    return [number[s][0] for s, k in of.items() if k > 1 or number[s][1]]


def sure(bad: int, clean: int, base: float) -> bool:
    """Whether so many toxic documents among those with a stem are beyond chance, at exp(-SURE) for each stem tried."""
    p = bad / (bad + clean) if bad else 0.0
    return p > base and (bad + clean) * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0)) >= SURE


def cover(docs: list[list[int]], kept: list[dict], names: list[str], base: float = 0.1) -> list[int]:
    """Greedily, the stems that explain the most toxic documents not explained yet; docs has the stems of each.

    Those that are beyond chance need to explain one; the others MIN_DOCS or TWICE_DOCS."""
    of = defaultdict(set)
    for d, some in enumerate(docs):
        for s in some:
            of[s].add(d)
    clean = [r["clean"] if precise(r) else r["clean2"] for r in kept]
    least = [1 if sure(r["bad"] if precise(r) else r["bad2"], c, base) else MIN_DOCS if precise(r) else TWICE_DOCS for r, c in zip(kept, clean)]
    chosen: list[int] = []
    while of:
        # of equals, the longer beginning, which fewer other words have
        s = max(of, key=lambda s: (len(of[s]) - 3 * clean[s], len(names[s].rstrip("$")), names[s]))
        if len(of[s]) < least[s]:
            del of[s]
            continue
        chosen.append(s)
        gone = of.pop(s)
        for k in list(of):
            of[k] -= gone
            if len(of[k]) < least[k]:
                del of[k]
    return chosen


def weigh(chosen: list[str], kept: dict, n: dict) -> dict[str, tuple[float, float]]:
    """Of each stem the log of how much likelier a toxic document has it, and its rate in clean documents that have it."""
    out = {}
    for s in chosen:
        r = kept[s]
        weight = math.log((r["bad"] + 0.5) / (n["bad"] + 1)) - math.log((r["clean"] + 0.5) / (n["clean"] + 1))
        if weight > 0:
            out[s] = (weight, r["hits"] / r["words"] if r["words"] else 0.0)
    return out


def weigh_marks(n: dict[tuple[str, int], int]) -> dict[str, float]:
    """Weights of the marks: DAMPED as if LEAN clauses had shown it, moved by the share of toxic documents' clauses among those so marked."""
    share = (n.get(("", 1), 0) + 0.5) / (n.get(("", 1), 0) + n.get(("", 0), 0) + 1)
    out = {}
    for m, least in DAMPED.items():
        bad, clean = n.get((m, 1), 0), n.get((m, 0), 0)
        out[m] = min(1.0, max(least, (bad + LEAN * least * share) / (bad + clean + LEAN) / share)) if m else 1.0
    return out


def curve(seen: list[tuple[float, float, float, int]]) -> tuple[float, float, float, float]:
    """Base and slopes of the logistic curve (with a slight pull to slopes of 1), and the score of a threat, from evidence and labels."""
    x = np.array([(1.0, min(s[0], 20.0), min(s[1], 20.0)) for s in sorted(seen)]).reshape(-1, 3)
    y = np.array([s[3] for s in sorted(seen)], float)
    share = min(0.4, (y.sum() + 0.5) / (len(y) + 1))
    each = np.where(y > 0, TOXIC_COUNTS, 1.0)
    w, pull, to = np.array([math.log(share / (1 - share)), 1.0, 1.0]), np.diag([1e-6, 1.0, 1.0]), np.array([0.0, 1.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ ((y - p) * each) - pull @ (w - to)
        w = w + np.clip(np.linalg.solve((x * (p * (1 - p) * each)[:, None]).T @ x + pull, gradient), -1, 1)
    threats = [s[3] for s in seen if s[2] == 1.0]
    return min(float(w[0]), -0.5), max(0.0, float(w[1])), max(0.0, float(w[2])), (sum(threats) + 4 * THREAT) / (len(threats) + 4)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score (0 to 1) and the number of matched clauses of every text."""
    parts = grammar.insults, grammar.curve, grammar.marks

    def run(it):
        g = Grammar(*parts)
        for ids, texts in batches(it, "doc_id", "text"):
            got = [g.score(t) for t in texts]
            yield record(SCHEMA, ids, [x[0] for x in got], [x[1] for x in got])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, clauses int")


def clean(docs: DataFrame, grammar: Grammar, column: str = "text") -> DataFrame:
    """The rows of docs whose text scores below THRESHOLD."""
    parts = grammar.insults, grammar.curve, grammar.marks

    def run(it):
        g = Grammar(*parts)
        for b in it:
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            yield b.filter(pa.array([g.score(t)[0] < THRESHOLD for t in texts], pa.bool_()))
        release()

    return bounded(docs).mapInArrow(run, docs.schema)


def training(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.where((fold(F.col("doc_id"), 3) != 1) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, training(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "clauses")


QUERIES = {"op10_toxicity": op10_toxicity}
