"""Secret scans: fixed base patterns, and probabilistic automata inferred from the credentials these label.

The base patterns label credentials. Their characters become classes, segment by segment, and grammar inference
builds a prefix tree of these for each kind and merges states whose outgoing frequencies are compatible (Hoeffding
bound), which gives a probabilistic automaton of the formats. Every other run of value characters in the corpus is
scored: if an automaton takes it and its format is likelier than ordinary text, it is added as kind ``format``. So
a credential whose format is known from labelled ones is found where nothing around it gives it away. Labels and
character counts come from every document. An automaton holds a bounded number of formats of bounded length; all
others stay in a table as paths of their own, with the share of labels that have them, and the candidates of the
corpus are joined with it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Scratch, map_batches, materialize, row_hash, row_key

#: States are merged at this significance, if so many labels at least pass through both.
MERGE_ALPHA, LEAST_PASSES, LEAST_LABELLED = 0.05, 20, 5
#: A candidate is added if its format is likelier than ordinary text by so many nats, and by so many a character.
LEAST_GAIN, LEAST_GAIN_PER_CHAR, LEAST_CHARS = 12.0, 0.75, 12
#: The automaton of a kind is fitted on so many of its labels' formats at most, the most frequent ones of values up
#: to this length. The others are in the table that candidates are joined with.
MOST_CHARS, MOST_FORMATS = 512, 2000
#: Letters of a segment up to this length stand for themselves (prefixes such as ``key-live-``).
LITERAL = 8

_WORDS = (
    r"[pPsStTaA](?:(?<=[pP])[aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|(?<=[sS])[eE][cC][rR][eE][tT]"
    r"|(?<=[tT])[oO][kK][eE][nN]|(?<=[aA])[pP][iI]_?[kK][eE][yY])"
)
ASSIGN = re.compile(_WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run fails and hides no other
KINDS = ("assign", "access", "hex", "format")
_VALUE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CANDIDATE, _SEGMENT, _PIECE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}"), re.compile(r"[A-Za-z0-9]+"), re.compile(r"[^=/]{12,}")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, value`` of the base matches that don't fail, kind by kind."""
    found = [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return found + [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Maximal runs of value characters, ``LEAST_CHARS`` long at least, without punctuation around them."""
    found = []
    for m in _CANDIDATE.finditer(text):
        value = m[0].rstrip(".-")
        start = m.start() + len(value) - len(value := value.lstrip(".-=/"))
        if len(value) >= LEAST_CHARS:
            found.append((start, start + len(value), value))
    return found


def _class(segment: str) -> str:
    if segment.isdigit():
        return "0"
    if segment.isalpha():
        return segment if len(segment) <= LITERAL else "l" if segment.islower() else "L" if segment.isupper() else "m"
    if segment.islower():
        return "h" if not segment.strip("0123456789abcdef") else "a"
    if segment.isupper():
        return "H" if not segment.strip("0123456789ABCDEF") else "A"
    return "x"


def symbols(value: str) -> str:
    """A value's format: each segment of letters and digits as its class, once for each character.

    Digits, lower- and upper-case hex, lower, upper and mixed case with digits, lower, upper and mixed letters; the
    letters of a short segment stand for themselves, behind a mark, and so do separators.
    """

    def one(m: re.Match) -> str:
        kind = _class(m[0])
        return kind * len(m[0]) if len(kind) == 1 and m[0] != kind else "".join("'" + c for c in kind)

    return _SEGMENT.sub(one, value)


def digest_of(text: str) -> bytes:
    """By which formats are told apart that no automaton holds."""
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


_IN_CLASS = {"0": 10, "h": 16, "a": 36, "H": 16, "A": 36, "x": 62, "l": 26, "L": 26, "m": 52}


def _steps(text: str) -> list[str]:
    """Symbols one by one; a mark and its letter are one."""
    return re.findall("'.|.", text, re.S)


@dataclass
class Automaton:
    """A probabilistic automaton: counts of passes, ends and moves of each state."""

    moves: list[dict[str, int]] = field(default_factory=lambda: [{}])
    taken: list[Counter] = field(default_factory=lambda: [Counter()])
    ends: list[int] = field(default_factory=lambda: [0])

    def log_likelihood(self, text: str) -> float:
        """Of the symbols and the end behind them; -inf for a format that no label leads to."""
        state, total = 0, 0.0
        for c in _steps(text):
            n = self.taken[state].get(c, 0)
            if not n:
                return -math.inf
            total += math.log(n / (sum(self.taken[state].values()) + self.ends[state])) - math.log(_IN_CLASS.get(c, 1))
            state = self.moves[state][c]
        if not self.ends[state]:
            return -math.inf
        return total + math.log(self.ends[state] / (sum(self.taken[state].values()) + self.ends[state]))

    def reachable(self) -> Automaton:
        """The same without states that nothing leads to, numbered anew."""
        names, todo = {0: 0}, [0]
        while todo:
            for t in self.moves[todo.pop()].values():
                if t not in names:
                    names[t] = len(names)
                    todo.append(t)
        old = sorted(names, key=names.__getitem__)
        return Automaton([{c: names[t] for c, t in self.moves[s].items()} for s in old], [self.taken[s] for s in old], [self.ends[s] for s in old])


def _apart(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    if not n1 or not n2:
        return False
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(values: list[str] | Counter[str], alpha: float = MERGE_ALPHA) -> Automaton:
    """Merge compatible states of the prefix tree: red states stay, blue ones (their children) merge or turn red.

    States that few labels pass through say nothing of frequencies and are kept apart.
    """
    moves: list[dict[str, int]] = [{}]
    taken: list[Counter] = [Counter()]
    ends = [0]
    for value, n in sorted(Counter(values).items()):
        state = 0
        for c in _steps(value):
            taken[state][c] += n
            if c not in moves[state]:
                moves[state][c] = len(moves)
                moves.append({})
                taken.append(Counter())
                ends.append(0)
            state = moves[state][c]
        ends[state] += n

    def passes(s: int) -> int:
        return sum(taken[s].values()) + ends[s]

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = passes(a), passes(b)
            if _apart(ends[a], n, ends[b], m, alpha) or any(_apart(taken[a].get(c, 0), n, taken[b].get(c, 0), m, alpha) for c in {*taken[a], *taken[b]}):
                return False
            todo += [(moves[a][c], moves[b][c]) for c in moves[a].keys() & moves[b].keys()]
        return True

    def join(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:  # b is a tree, so this ends
            a, b = todo.pop()
            ends[a] += ends[b]
            taken[a].update(taken[b])
            for c, t in moves[b].items():
                if c in moves[a]:
                    todo.append((moves[a][c], t))
                else:
                    moves[a][c] = t

    red, held, often = [0], {0}, [0]
    while True:
        todo = deque((r, c) for r in red for c in sorted(moves[r]) if moves[r][c] not in held)
        if not todo:
            break
        while todo:
            r, c = todo.popleft()
            if (t := moves[r][c]) in held:
                continue
            target = next((x for x in often if compatible(x, t)), None) if passes(t) >= LEAST_PASSES else None
            if target is None:
                red.append(t)
                held.add(t)
                if passes(t) >= LEAST_PASSES:
                    often.append(t)
                todo.extend((t, d) for d in sorted(moves[t]))
            else:
                moves[r][c] = target
                join(target, t)  # children that red states get by this are met in the next round
    return Automaton(moves, taken, ends).reachable()


@dataclass
class Formats:
    """Automata by kind of label, and how likely each character is in ordinary text."""

    automata: dict[str, Automaton] = field(default_factory=dict)
    ordinary: dict[str, float] = field(default_factory=dict)
    #: Log of the share of a kind's labels that its automaton is fitted on.
    share: dict[str, float] = field(default_factory=dict)
    #: The table of the other formats: ``format`` (their digest) and ``share``, the log of the share of labels that have it.
    rest: str | None = None
    known: dict[str, float] = field(default_factory=dict)

    def likelihood(self, value: str) -> float:
        """Of the likeliest format; formats that were met before are remembered."""
        text = symbols(value)
        found = self.known.get(text)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = max((a.log_likelihood(text) + self.share.get(k, 0.0) for k, a in self.automata.items()), default=-math.inf)
            if len(value) <= MOST_CHARS:
                self.known[text] = found
        return found

    def gain(self, value: str) -> float:
        """Nats by which the likeliest format beats ordinary text; -inf if no automaton takes the value."""
        if (best := self.likelihood(value)) == -math.inf:
            return -math.inf
        return best - sum(self.ordinary.get(c, -12.0) for c in value)

    def likely(self, value: str) -> bool:
        return self.gain(value) >= _wanted(value)

    def least_share(self, value: str) -> float:
        """The log of the share of labels that must have a value's format to make it likely by itself."""
        chosen = sum(math.log(_IN_CLASS.get(c, 1)) * n for c, n in Counter(_steps(symbols(value))).items())
        return _wanted(value) + chosen + sum(self.ordinary.get(c, -12.0) * n for c, n in Counter(value).items())

    def judged(self, text: str, base: list[tuple[int, int, str, str]]) -> tuple[list[Span], list[Ask]]:
        """Likely candidates that no base span covers; of an unlikely one, its likely pieces between ``=`` and ``/``.

        Where there is a table of other formats, also what depends on it: candidates and pieces that would be likely
        if labels enough have their format. Pieces of a candidate that may still be likely are among these.
        """
        found: list[Span] = []
        asks: list[Ask] = []

        def ask(start: int, end: int, value: str, inside: int) -> bool:
            least = self.least_share(value) if self.rest else math.inf
            if least > 0:
                return False
            asks.append((start, end, inside, digest_of(symbols(value)), least))
            return True

        for start, end, value in candidates(text):
            if any(a <= start and end <= b for a, b, _, _ in base):
                continue
            if self.likely(value):
                found.append((start, end, "format"))
                continue
            asked = ask(start, end, value, -1)
            for m in _PIECE.finditer(value) if "=" in value or "/" in value else ():
                a, b = start + m.start(), start + m.end()
                if any(c <= a and b <= d for c, d, _, _ in base):
                    continue
                if not self.likely(m[0]):
                    ask(a, b, m[0], start if asked else -1)
                elif asked:
                    asks.append((a, b, start, None, 0.0))
                else:
                    found.append((a, b, "format"))
        return found, asks

    def added(self, text: str, base: list[tuple[int, int, str, str]]) -> list[Span]:
        """What the automata alone add."""
        found, asks = self.judged(text, base)
        return found + settled(asks, {})


#: Start, end, start of the candidate that it is a piece of and that mustn't be likely itself (-1: none), digest of the
#: format (None: an automaton finds it likely), least log of the share of labels.
Ask = tuple[int, int, int, bytes | None, float]


def _wanted(value: str) -> float:
    return max(LEAST_GAIN, LEAST_GAIN_PER_CHAR * len(value))


def settled(asks: list[Ask], shares: dict[bytes, float]) -> list[Span]:
    """The spans to be added, given the shares of formats in the table."""
    found: list[Span] = []
    whole: set[int] = set()
    for start, end, inside, kind, least in asks:  # a candidate comes before its pieces
        if inside in whole or kind is not None and shares.get(kind, -math.inf) < least:
            continue
        found.append((start, end, "format"))
        if inside < 0:
            whole.add(start)
    return found


def labels_of(texts: list[str]) -> tuple[set[tuple[str, str]], Counter[str]]:
    """Labelled values with their kinds, and the characters of all that is no base match."""
    labelled: set[tuple[str, str]] = set()
    seen = np.zeros(256, np.int64)  # no byte of another character equals one of _VALUE
    for text in texts:
        base = base_spans(text)
        labelled.update((kind, value) for _, _, kind, value in base)
        rest, at = [], 0
        for start, end, *_ in sorted(base):
            rest.append(text[at:start])
            at = max(at, end)
        rest.append(text[at:])
        seen += np.bincount(np.frombuffer("".join(rest).encode(), np.uint8), minlength=256)
    return labelled, Counter({c: n for c in _VALUE if (n := int(seen[ord(c)]))})


def fit(labelled: dict[str, Counter[str]], plain: Counter[str], totals: dict[str, int] | None = None, rest: str | None = None) -> Formats:
    """Infer an automaton for every kind with enough different labelled values, given as counts of their formats.

    ``totals`` are all labels of a kind, if some of their formats are not among these but in the table ``rest``.
    """
    totals = totals or {k: sum(found.values()) for k, found in labelled.items()}
    total = sum(plain.values())
    ordinary = {c: math.log((plain[c] + 1) / (total + len(_VALUE))) for c in _VALUE}
    taken = {k: found for k, found in labelled.items() if found and totals[k] >= LEAST_LABELLED}
    return Formats({k: infer(found) for k, found in taken.items()}, ordinary, {k: math.log(sum(found.values()) / totals[k]) for k, found in taken.items()}, rest)


def learn(docs: DataFrame) -> Formats:
    """Fit on all documents in one pass. Values are told apart by digest, and only how many different ones share
    each format reaches the driver: at most ``MOST_FORMATS`` rows a kind. Other formats go to a table in the shared folder.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        labelled, plain = labels_of(batch.column(0).to_pylist())
        out: list[tuple] = [("plain", c, None, None, n) for c, n in plain.items()]
        for kind, value in labelled:
            text = symbols(value)
            out.append((kind, text if len(value) <= MOST_CHARS else None, digest_of(text), hashlib.sha256(value.encode()).digest(), 1))
        kinds = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["kind", "symbols", "format", "value", "n"])

    seen = map_batches(docs.select(F.col("text").cast("string").alias("text")).where("text is not null"), run, "kind string, symbols string, format binary, value binary, n long")
    by = ["kind", "symbols", "format"]
    counts = seen.groupBy(*by, "value").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(1)).alias("n"))
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.write(counts, "formats")
        plain = Counter({c: n for c, n in counts.where("kind = 'plain'").select("symbols", "n").collect()})
        totals: dict[str, int] = dict.fromkeys(KINDS[:3], 0)
        totals |= {kind: n for kind, n in counts.where("kind <> 'plain'").groupBy("kind").agg(F.sum("n")).collect()}
        labelled: dict[str, Counter[str]] = {}
        other, more = F.lit(False), F.lit(0.0)
        for kind in KINDS[:3]:
            rows = counts.where((F.col("kind") == kind) & F.col("symbols").isNotNull()).select("symbols", "n").orderBy(F.desc("n"), "symbols").limit(MOST_FORMATS).collect()
            labelled[kind] = Counter({text: n for text, n in rows})
            if totals[kind] > sum(labelled[kind].values()) and totals[kind] >= LEAST_LABELLED:
                behind = F.col("symbols").isNull()
                if rows:
                    behind |= (F.col("n") < rows[-1].n) | (F.col("n") == rows[-1].n) & (F.col("symbols") > rows[-1].symbols)
                other |= (F.col("kind") == kind) & behind
                more = F.when(F.col("kind") == kind, math.log(totals[kind])).otherwise(more)
        rest = counts.where(other).groupBy("format").agg(F.max(F.log(F.col("n").cast("double")) - more).alias("share"))
        some = any(totals[k] > sum(found.values()) and totals[k] >= LEAST_LABELLED for k, found in labelled.items())
        return fit(labelled, plain, totals, scratch.save(rest, "other-formats", keep=True) if some else None)


def spans_text(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], order[s[2]])))


def spans_of(text: str) -> list[Span]:
    parts = (s.split(":") for s in text.split(",") if s)
    return [(int(a), int(b), kind) for kind, a, b in parts]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


ASKS = "asks array<struct<start: long, end: long, inside: long, format: binary, least: double>>"
_ASKS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("inside", pa.int64()), ("format", pa.binary()), ("least", pa.float64())]))


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """``docs(doc_id, text)`` -> counts, digest of the base spans and all spans, one row per input row.

    Whole texts are scanned; null and empty texts have no spans (the digest is that of the empty string). A null
    doc_id stays null, repeated rows give equal rows, other columns are ignored, no rows give no rows.
    """

    held = docs.sparkSession.sparkContext.broadcast(formats)  # its size is bounded by MOST_FORMATS and MOST_CHARS
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    own = ["row_hash", "asks"] if formats.rest else []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            spans = [s[:3] for s in base]
            counts = Counter(s[2] for s in spans)
            digest = hashlib.sha256(spans_text(spans).encode()).hexdigest()
            added, asks = held.value.judged(text, base)
            rows.append((counts["assign"], counts["access"], counts["hex"], digest, spans_text(spans + added), asks))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        columns = [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
        if own:
            columns += [batch.column(2), pa.array([[dict(zip(("start", "end", "inside", "format", "least"), a)) for a in r[5]] for r in rows], _ASKS)]
        return pa.RecordBatch.from_arrays(columns, names + own)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([row_hash().alias("row_hash")] if own else []))
    if not own:
        return map_batches(source, run, SCHEMA)
    return _with_other_formats(materialize(map_batches(source, run, f"{SCHEMA}, row_hash long, {ASKS}"), "scanned"), docs.sparkSession.read.schema("format binary, share double").parquet(formats.rest))


def _with_other_formats(scanned: DataFrame, rest: DataFrame) -> DataFrame:
    """Settle what depends on formats that no automaton holds. Only digests that both sides have are joined by row."""
    with Scratch(scanned.sparkSession) as scratch:
        asks = scratch.write(scanned.where("size(asks) > 0").select("doc_id", "row_hash", F.explode("asks").alias("a")).select("doc_id", "row_hash", "a.format", "a.least").where("format is not null").distinct(), "asks")
        met = asks.join(scratch.write(rest, "shares"), "format").where("share >= least")
        names, key, wanted = row_key(met.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("format", "share")).alias("shares")), "shares")  # at most a document's candidates
        wanted = scratch.write(wanted, "met", keep=True)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = batch.schema.names
        out = []
        for text, asks, shares in zip(*(batch.column(order.index(c)).to_pylist() for c in ("spans", "asks", "shares"))):
            added = settled([tuple(a.values()) for a in asks], {s["format"]: s["share"] for s in shares or ()})
            out.append(spans_text(spans_of(text) + added) if added else text)
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.string())], order[:6])

    rows = scanned.withColumns({names[0]: F.coalesce("doc_id", F.lit(0)), names[1]: F.col("doc_id").isNull(), names[2]: F.col("row_hash")})
    joined = rows.join(wanted, names, "left").select(*scanned.columns[:6], "asks", "shares")
    return map_batches(joined, run, SCHEMA)
