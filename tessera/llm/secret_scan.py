"""Operator 13: secret scan by grammar inference.

Labelled credentials of each kind become a prefix tree whose states carry counts. States whose outgoing frequencies, and those
of everything below them, agree within Hoeffding bounds are merged, which leaves a small probabilistic automaton: literal
prefixes stay chains of states, random parts become loops. Every candidate, a long run of credential characters or a part
of one, is scored under every automaton: the log likelihood of its characters and its length, less that of ordinary text under the
letter pairs of the corpus. Candidates above ``LEAST_SCORE`` are spans of the automaton's kind.

Labels come from two places: values of the base matches in the documents, by base kind (at most ``MAX_LABELLED`` distinct values of a
kind, those with the least hashes, of at most ``LONGEST_LABEL`` characters), and ``ISSUED`` examples of each published format,
drawn with a fixed seed. The letter pairs are counted over all documents, outside of candidates. Base matches always stay; a span that would overlap one is
dropped, and of overlapping candidates the outermost that passes is taken.

The span of a base match is the whole match, keyword and quotes included; its credential is the value.

Scale: one pass over the texts for base matches and candidates, one for letter pairs, and one over the candidates alone; the
driver gets the bounded samples and at most 69 * 69 counts. Nothing but counts and samples is shuffled.

Defined results: null and empty texts have no spans; every row is scanned by itself, whatever its id; without enough labels of a base kind
there is no automaton for it; empty tables give an empty result. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkit as K
from tessera.llm.workspace import Workspace

#: The base kinds in the order of their listing, and the least length of what each has to match.
BASE = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM = DIGITS + UPPER + UPPER.lower()
URL_SAFE = ALNUM + "_-"
CREDENTIAL = ALNUM + "+/_.=-"
#: Published formats as literals and (alphabet, least, most) parts.
FORMATS: dict[str, tuple] = {
    "github": ("ghp_", (ALNUM, 36, 36)),
    "gitlab": ("glpat-", (URL_SAFE, 20, 20)),
    "google": ("AIza", (URL_SAFE, 35, 35)),
    "npm": ("npm_", (ALNUM, 36, 36)),
    "slack": ("xoxb-", (DIGITS, 11, 13), "-", (DIGITS, 11, 13), "-", (ALNUM, 24, 24)),
    "stripe": ("sk_live_", (ALNUM, 24, 32)),
    "sendgrid": ("SG.", (URL_SAFE, 22, 22), ".", (URL_SAFE, 43, 43)),
    "jwt": ("eyJ", (URL_SAFE, 17, 60), ".eyJ", (URL_SAFE, 20, 90), ".", (URL_SAFE, 43, 43)),
}
#: All kinds in the order of their listing: base matches, unmarked values like those of a base kind, published formats.
KINDS = (*BASE, *(f"like_{k}" for k in BASE), *FORMATS)

ISSUED = 300
MAX_LABELLED, MIN_LABELLED, LONGEST_LABEL = 400, 20, 256
#: Risk of keeping two states apart that are one.
ALPHA = 0.05
SHORTEST = 16
#: Least log likelihood ratio, in nats, of a credential against ordinary text.
LEAST_SCORE = 25.0

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN_RE = re.compile("(" + "|".join([*(_either(k) for k in KEYWORDS[:4]), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS_RE = re.compile(f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}")
HEX_RE = re.compile(f"[0-9a-f]{{{LEAST_HEX},}}")
RUN_RE = re.compile(f"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
PART_RE = (re.compile(r"[A-Za-z0-9_.-]*[A-Za-z0-9_-]"), re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[A-Za-z0-9]+"))


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of the base matches of a text, by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN_RE.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS_RE.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX_RE.finditer(text)]
    return sorted(out)


def candidate_runs(text: str) -> list[tuple[int, str]]:
    """(start, characters) of the runs of credential characters that are long enough to hold a candidate."""
    return [(m.start(), m[0]) for m in RUN_RE.finditer(text)]


def issue(kind: str, n: int, seed: int) -> list[str]:
    """n examples of a published format."""
    r = random.Random(f"{kind}/{seed}")
    part = lambda p: p if isinstance(p, str) else "".join(r.choices(p[0], k=r.randint(p[1], p[2])))
    return ["".join(part(p) for p in FORMATS[kind]) for _ in range(n)]


@dataclass
class State:
    """How many strings come here and end here, and for each character the next state's number and how many go on to it."""

    seen: int = 0
    ends: int = 0
    to: dict[str, list[int]] = field(default_factory=dict)


def prefix_tree(values: Iterable[str]) -> list[State]:
    states = [State()]
    for v in values:
        at = 0
        states[0].seen += 1
        for c in v:
            step = states[at].to.get(c)
            if step is None:
                step = states[at].to[c] = [len(states), 0]
                states.append(State())
            step[1] += 1
            at = step[0]
            states[at].seen += 1
        states[at].ends += 1
    return states


def compatible(states: list[State], a: int, b: int, alpha: float) -> bool:
    """Whether the futures of two states agree, as far as the second one, the root of a tree, goes: no frequencies are further apart than chance allows."""
    width = math.sqrt(0.5 * math.log(2 / alpha))
    todo = [(a, b)]
    while todo:
        x, y = (states[k] for k in todo.pop())
        n, m = x.seen, y.seen
        bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if bound >= 1 and width >= 1 and m == 1:
            continue  # no two frequencies differ by more than one, and below a single string it is the same
        if abs(x.ends / n - y.ends / m) > bound:
            return False
        for c in x.to.keys() | y.to.keys():
            p, q = x.to.get(c), y.to.get(c)
            if abs((p[1] if p else 0) / n - (q[1] if q else 0) / m) > bound:
                return False
            if p and q:
                todo.append((p[0], q[0]))
    return True


def _fold(states: list[State], into: int, tree: int) -> None:
    todo = [(into, tree)]
    while todo:
        a, b = todo.pop()
        x, y = states[a], states[b]
        x.seen += y.seen
        x.ends += y.ends
        for c, (child, n) in y.to.items():
            if c in x.to:
                x.to[c][1] += n
                todo.append((x.to[c][0], child))
            else:
                x.to[c] = [child, n]


@dataclass
class Automaton:
    """``steps[state][character]`` is (next state, log probability); ``ends[state]`` the log probability to end; ``lengths`` smoothed log probabilities."""

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]
    lengths: dict[int, float]
    other_length: float

    def log_likelihood(self, value: str) -> float:
        """Of the characters and the length; minus infinity for what the grammar cannot make."""
        at, total = 0, self.lengths.get(len(value), self.other_length)
        for c in value:
            step = self.steps[at].get(c)
            if step is None:
                return -math.inf
            at = step[0]
            total += step[1]
        return total + self.ends[at]


def infer(values: Sequence[str], alpha: float = ALPHA) -> Automaton:
    """Merges compatible states of the values' prefix tree, the most frequent first, each into its parent or the latest settled state that agrees."""
    states = prefix_tree(values)
    settled, known = [0], {0}
    while True:
        fringe = [(n, a, c) for a in settled for c, (to, n) in states[a].to.items() if to not in known]
        if not fringe:
            break
        _, parent, c = max(fringe, key=lambda x: (x[0], -x[1], x[2]))
        child = states[parent].to[c][0]
        for other in (parent, *(a for a in reversed(settled) if a != parent)):
            if compatible(states, other, child, alpha):
                states[parent].to[c][0] = other
                _fold(states, other, child)
                break
        else:
            settled.append(child)
            known.add(child)
    number = {a: k for k, a in enumerate(settled)}
    steps = [{c: (number[to], math.log(n / states[a].seen)) for c, (to, n) in states[a].to.items()} for a in settled]
    ends = [math.log(states[a].ends / states[a].seen) if states[a].ends else -math.inf for a in settled]
    count: dict[int, int] = {}
    for v in values:
        for near in (len(v) - 1, len(v), len(v) + 1):
            count[near] = count.get(near, 0) + 1
    total = 3 * len(values) + 1
    return Automaton(steps, ends, {k: math.log((n + 0.5) / total) for k, n in count.items()}, math.log(0.5 / total))


_CLASS = np.zeros(256, np.int64)
_CLASS[[ord(c) for c in CREDENTIAL]] = np.arange(1, len(CREDENTIAL) + 1)
_WIDTH = len(CREDENTIAL) + 1


def _ordinary(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The classes of the bytes of each row, a 0 before and after every row, and 0 in long runs of credential characters."""
    k = np.zeros(len(data) + len(off), np.int64)
    k[np.arange(len(data)) + np.repeat(np.arange(1, len(off)), np.diff(off))] = _CLASS[data]
    edge = np.flatnonzero(np.diff((k > 0).astype(np.int8)))
    long = edge[1::2] - edge[::2] >= SHORTEST
    step = np.zeros(len(k), np.int64)
    step[edge[::2][long] + 1] += 1
    step[edge[1::2][long] + 1] -= 1
    k[np.cumsum(step) > 0] = 0
    return k


def letter_pairs(texts: DataFrame) -> DataFrame:
    """(pair, n): how often each credential character, or another byte as class 0, follows each, over all of (text).

    A byte of class 0 stands before and after each text. Runs that are long enough to be candidates are not ordinary text and are
    taken as bytes of class 0.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, data, off in K.blocks(b.column(0)):
                k = _ordinary(data, off)
                n = np.bincount(k[:-1] * _WIDTH + k[1:], minlength=_WIDTH * _WIDTH)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], names=["pair", "n"])

    return texts.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def background(pairs: dict[int, int]) -> np.ndarray:
    """Log probabilities of each class after each, from counts of pairs, each counted once more."""
    n = np.ones((_WIDTH, _WIDTH))
    for pair, k in pairs.items():
        n[divmod(pair, _WIDTH)] += k
    return np.log(n / n.sum(axis=1, keepdims=True))


@dataclass
class Model:
    automata: dict[str, Automaton]
    ordinary: np.ndarray

    def score(self, value: str) -> tuple[float, str]:
        """The best log likelihood ratio of a candidate of credential characters, and its kind."""
        best = max(((a.log_likelihood(value), -KINDS.index(k)) for k, a in self.automata.items()), default=(-math.inf, 0))
        if best[0] == -math.inf:
            return -math.inf, ""
        k = np.concatenate([[0], _CLASS[np.frombuffer(value.encode(), np.uint8)], [0]])
        return best[0] - float(self.ordinary[k[:-1], k[1:]].sum()), KINDS[-best[1]]

    def spans(self, start: int, run: str, taken: list[tuple[int, int]]) -> list[tuple[int, str, int, float]]:
        """(start, kind, end, score) of the credentials in a run: itself, or the outermost parts that pass, none over a taken range."""
        out, todo = [], [(0, len(run), 0)]
        while todo:
            a, b, level = todo.pop()
            if b - a < SHORTEST:
                continue
            s, e = start + a, start + b
            if not any(x < e and s < y for x, y in taken):
                score, kind = self.score(run[a:b])
                if score >= LEAST_SCORE:
                    out.append((s, kind, e, score))
                    continue
            if level < len(PART_RE):
                todo += [(a + m.start(), a + m.end(), level + 1) for m in PART_RE[level].finditer(run[a:b])]
        return sorted(out)


_SPAN = "struct<kind:string,start:long,end:long,value:string>"


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, runs) of every row: base matches (kind, start, end, value) and candidate runs (start, value), in code points."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(f"base array<{_SPAN}>, runs array<struct<start:long,value:string>>")])
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])), pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [[{"kind": BASE[k], "start": s, "end": e, "value": v} for s, k, e, v in base_matches(t)] for t in texts]
            runs = [[{"start": s, "value": v} for s, v in candidate_runs(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kinds[0]), pa.array(runs, kinds[1])], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def train(found: DataFrame, texts: DataFrame) -> Model:
    """Automata of the published formats and of the base kinds with enough labels, and the letter pairs of the corpus."""
    values = found.select(F.explode("base").alias("b")).select("b.kind", "b.value").where(F.length("value") <= LONGEST_LABEL).distinct()
    labelled = {k: issue(k, ISSUED, 1) for k in FORMATS}
    for kind in BASE:
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(MAX_LABELLED).collect()
        if len(rows) >= MIN_LABELLED:
            labelled[f"like_{kind}"] = [r["value"] for r in rows]
    return Model({k: infer(v) for k, v in labelled.items()}, background({r["pair"]: r["n"] for r in letter_pairs(texts).collect()}))


def _overlapping(base: list[dict], start: int, end: int) -> list[tuple[int, int]]:
    return [(b["start"], b["end"]) for b in base if b["start"] < end and start < b["end"]]


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) of every row: base matches (kind, start, end, value), and spans (kind, start, end, score) that an automaton adds."""
    work = Workspace(spark, "secrets")
    found = work.save(find_candidates(docs, id_col, text_col), "found")
    model = train(found, docs.select(docs[text_col].cast("string").alias("text")))
    schema = T.StructType([*found.schema.fields[:2], *T.StructType.fromDDL("added array<struct<kind:string,start:long,end:long,score:double>>")])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            added = []
            for base, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = [x for r in runs for x in model.spans(r["start"], r["value"], _overlapping(base, r["start"], r["start"] + len(r["value"])))]
                added.append([{"kind": k, "start": s, "end": e, "score": z} for s, k, e, z in got])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(added, kind)], names=schema.names)

    return found.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    place = lambda x: F.struct(x.start, F.array_position(F.array(*[F.lit(k) for k in KINDS]), x.kind).alias("k"), x.kind, x.end)
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base, added = (F.transform(c, place) for c in ("base", "added"))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        id_col, *[count(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.concat(base, added)).alias("spans"), F.size("added").cast("long").alias("n_added")
    )
