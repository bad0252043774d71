"""Secret scan: base patterns, and automata inferred from the credentials that these label.

Grammar inference: credentials labelled by the base patterns (a bounded sample per kind: the ``SAMPLE`` distinct values of
least hash) become prefix trees, built one depth at a time. States of a depth whose next ``AHEAD`` characters agree within
a Hoeffding bound become one, so deep states keep enough visits to be told apart; then states of different depths are merged
where all that follows agrees, which makes loops of repeating formats and keeps the length of fixed ones. A state with fewer
than ``VISITS`` strings is not tested: it joins the most visited state of its depth, and alone it ends in a loop. Every
token that could be a credential is scored: it must be read without a kind of character that its state has not seen, and its
log-likelihood per character must exceed that of ordinary tokens (with digits or without, outside base spans) by the
threshold of the kind, the weakest tenth of labelled credentials held out from the fit. Such tokens are ``inferred`` spans.
Scoring is a projection: the only shuffle gathers the samples.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from mailwarden.llm.common import map_texts, written

#: The base patterns by kind; the matched group that must be long enough, and its least length.
KINDS = ("assign", "access", "hex", "inferred")
PATTERNS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: What may be a credential: a long token, of any length, with a digit and a letter. Ordinary are long tokens outside base spans.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{16,}(?![A-Za-z0-9+/_.=-])")
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}(?![A-Za-z0-9+/_.=-])")
#: The words of the first pattern: a text without any of them needs no search for it.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
DIGIT = re.compile("[0-9]")
ALPHA, FLOOR = 0.05, 1e-4
#: Bounds of the fit: values per kind, and characters read of each value.
SAMPLE, REACH = 2000, 4096
#: Least strings of a state that is tested; characters compared within a depth; share of a state's steps spread over like characters.
VISITS, AHEAD, SPREAD = 8, 8, 0.2
#: Characters that stand for one another where few strings have been seen; any other character stands for itself.
CLASSES = [frozenset(x) for x in ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
CLASS_OF = {c: k for k in CLASSES for c in k}
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long"


def matches(kind: str, text: str):
    """Matches of a base pattern that are long enough."""
    pattern, group, least = PATTERNS[kind]
    if kind == "assign":
        low = text.lower()
        if not any(w in low for w in WORDS):
            return
    for m in pattern.finditer(text):
        if m.end(group) - m.start(group) >= least:
            yield m


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in code points, leftmost and non-overlapping per kind."""
    found = []
    for number, kind in enumerate(KINDS[:3]):
        found += [(m.start(), number, m.end()) for m in matches(kind, text)]
    return sorted(found)


class Automaton:
    """Probabilistic automaton by state merging over a prefix tree.

    ``rows[q]`` holds the steps of state q as {character: (log probability, next state)} and the log probability to end.
    """

    def __init__(self, strings, alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.seen, self.move, self.final = [], [], []
        self._layers([s[:REACH] for s in strings])
        self._merge_depths()
        self._finish()

    def _state(self) -> int:
        self.seen.append(Counter())
        self.move.append({})
        self.final.append(0)
        return len(self.seen) - 1

    def _near(self, a: Counter, n: int, b: Counter, m: int) -> bool:
        limit = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return all(abs(a[c] / n - b[c] / m) <= limit for c in {*a, *b})

    def _layers(self, strings) -> None:
        """The prefix tree, depth by depth; each state keeps the strings that reach it."""
        layer, depth = {self._state(): strings}, 0
        while layer:
            groups = []                                     # strings and parents' steps of the next depth's states
            for q, own in layer.items():
                by = {}
                for s in own:
                    if len(s) == depth:
                        self.final[q] += 1
                    else:
                        by.setdefault(s[depth], []).append(s)
                for c, some in by.items():
                    self.seen[q][c] = len(some)
                    groups.append((some, [(q, c)]))
            groups.sort(key=lambda g: (-len(g[0]), g[1]))
            merged = []
            for own, steps in groups:
                ahead = [Counter(s[k:k + 1] for s in own) for k in range(depth + 1, depth + 1 + AHEAD)]
                fit = None
                for other in merged:
                    if len(own) < VISITS or all(self._near(x, len(own), y, len(other[0])) for x, y in zip(ahead, other[2])):
                        fit = other
                        break
                if fit:
                    fit[0].extend(own)
                    fit[1].extend(steps)
                    for x, y in zip(fit[2], ahead):
                        x.update(y)
                else:
                    merged.append((list(own), list(steps), ahead))
            layer, depth = {}, depth + 1
            for own, steps, _ in merged:
                q = self._state()
                for p, c in steps:
                    self.move[p][c] = q
                if len(own) >= VISITS:
                    layer[q] = own
                    continue
                for s in own:                               # too few to go on: the rest of these strings loops here
                    self.final[q] += 1
                    for c in s[depth:]:
                        self.seen[q][c] += 1
                        self.move[q][c] = q

    def _total(self, q) -> int:
        return self.seen[q].total() + self.final[q]

    def _agree(self, a, b) -> bool:
        """Hoeffding test of the steps and ends of two states and of all that follows."""
        todo, done = [(a, b)], set()
        while todo:
            p, q = todo.pop()
            n, m = self._total(p), self._total(q)
            if p == q or (p, q) in done or min(n, m) < VISITS:
                continue
            done.add((p, q))
            if not self._near(self.seen[p] + Counter({"": self.final[p]}), n, self.seen[q] + Counter({"": self.final[q]}), m):
                return False
            todo += {(self.move[p][c], self.move[q][c]) for c in self.move[p].keys() & self.move[q].keys()}
        return True

    def _merge_depths(self) -> None:
        """Red-blue merging over the states in order of depth; a merged state's steps lead where its partner's do."""
        red, became, queue, met = [], {}, [0], {0}
        while queue:
            q = queue.pop(0)
            partner = next((r for r in red if self._agree(r, q)), None) if self._total(q) >= VISITS else None
            if partner is None:
                red.append(q)
            else:
                became[q] = partner
                self.seen[partner].update(self.seen[q])
                self.final[partner] += self.final[q]
                for c in self.move[q].keys() - self.move[partner].keys():
                    self.move[partner][c] = self.move[q][c]
            for r in [self.move[q][c] for c in sorted(self.move[q])] if partner is None else [self.move[partner][c] for c in sorted(self.move[partner])]:
                if r not in met:
                    met.add(r)
                    queue.append(r)
        for q in red:
            self.move[q] = {c: became.get(r, r) for c, r in self.move[q].items()}
        self.states = red

    def _finish(self) -> None:
        number = {q: k for k, q in enumerate(self.states)}
        self.rows = []
        for q in self.states:
            n, steps = self._total(q) or 1, {}
            by_class = Counter()
            for c, k in self.seen[q].items():
                by_class[CLASS_OF.get(c, frozenset(c))] += k
            for like, k in by_class.items():
                usual = max((c for c in sorted(like) if c in self.move[q]), key=lambda c: self.seen[q][c])
                for c in like:
                    share = (1 - SPREAD) * self.seen[q][c] / n + SPREAD * k / n / len(like)
                    steps[c] = math.log(share), number[self.move[q].get(c, self.move[q][usual])]
            self.rows.append((steps, math.log(max(self.final[q] / n, FLOOR))))
        self.seen = self.move = self.final = None

    def read(self, s: str) -> tuple[float, int]:
        """Log-likelihood per character, and how many characters no state expects (each costs ``FLOOR``)."""
        q, total, strange = 0, 0.0, 0
        for c in s:
            step = self.rows[q][0].get(c)
            if step is None:
                total, strange = total + math.log(FLOOR), strange + 1
            else:
                total, q = total + step[0], step[1]
        return (total + self.rows[q][1]) / (len(s) + 1), strange

    def score(self, s: str) -> float:
        return self.read(s)[0]


class Bigrams:
    """What ordinary long words look like: letter pairs with add-half smoothing."""

    def __init__(self, strings):
        self.pairs, self.firsts = Counter(), Counter()
        for s in strings:
            for a, b in zip("^" + s, s + "$"):
                self.pairs[a + b] += 1
                self.firsts[a] += 1

    def score(self, s: str) -> float:
        return sum(math.log((self.pairs[a + b] + 0.5) / (self.firsts[a] + 50)) for a, b in zip("^" + s, s + "$")) / (len(s) + 1)


class SecretModel:
    """Automata per kind, ordinary tokens, and a threshold per kind from credentials that were held out."""

    def __init__(self, samples: dict[str, list[str]], alpha: float = ALPHA):
        self.ordinary = Bigrams([s[:REACH] for s in samples.get("ordinary", [])])
        self.automata, self.thresholds = {}, {}
        for kind in KINDS[:3]:
            own = samples.get(kind, [])
            if not own:
                continue
            held = []
            for k in (0, 1):                                # each half judged by the automaton of the other
                rest = own[1 - k::2]
                if rest:
                    judge = Automaton(rest, alpha)
                    held += [judge.score(s[:REACH]) - self.ordinary.score(s[:REACH]) for s in own[k::2]]
            self.automata[kind] = Automaton(own, alpha)
            held.sort()
            self.thresholds[kind] = max(held[len(held) // 10] if held else self._gain(kind, own[0][:REACH])[0], 0.0)

    def _gain(self, kind: str, s: str) -> tuple[float, int]:
        score, strange = self.automata[kind].read(s)
        return score - self.ordinary.score(s), strange

    @property
    def threshold(self) -> float:
        return min(self.thresholds.values(), default=math.inf)

    def ratio(self, s: str) -> float:
        """Best gain of an automaton over ordinary tokens, per character."""
        return max((self._gain(k, s)[0] for k in self.automata), default=-math.inf)

    def is_credential(self, s: str) -> bool:
        for kind in self.automata:
            gain, strange = self._gain(kind, s)
            if not strange and gain >= self.thresholds[kind]:
                return True
        return False

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans and inferred ones that touch none of them, in order."""
        base = base_spans(text)
        if not self.automata or not DIGIT.search(text):
            return base
        more = [(s, 3, e) for s, e in free_tokens(CANDIDATE, text, base) if self.is_credential(text[s:e])]
        return sorted(base + more)


def free_tokens(pattern: re.Pattern, text: str, base: list[tuple[int, int, int]]):
    """(start, end) of the matches that touch no base span; both lists are read once, in order."""
    at, end = 0, -1                                         # ``end``: how far the spans read so far reach
    for m in pattern.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            end, at = max(end, base[at][2]), at + 1
        if end <= m.start():
            yield m.span()


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=7).digest(), "big")


def train(df: DataFrame, text_col: str = "text", sample: int = SAMPLE, alpha: float = ALPHA) -> SecretModel:
    """Fit on the ``sample`` distinct values of least hash of each kind, of each the first ``REACH`` characters; each task
    passes on as many at most per piece."""
    def work(rows):
        values = {k: set() for k in (*KINDS[:3], "ordinary")}
        for _, raw in rows:
            text = (raw or b"").decode("utf-8", "replace")
            base = base_spans(text)
            for kind in KINDS[:3]:
                values[kind].update(m[PATTERNS[kind][1]][:REACH] for m in matches(kind, text))
            values["ordinary"].update(text[s:min(e, s + REACH)] for s, e in free_tokens(ORDINARY, text, base))
        return [(kind, v, h) for kind, found in values.items()
                for h, v in sorted((_hash(v), v) for v in found)[:sample]]

    rows = written(map_texts(df, [F.lit(0).alias("id"), df[text_col].alias("text")], "kind string, value string, h long", work)
                   .distinct(), "secret_samples")
    samples = {}
    for kind in (*KINDS[:3], "ordinary"):
        least = rows.filter(F.col("kind") == kind).orderBy("h", "value").limit(sample)
        samples[kind] = [r["value"] for r in least.collect()]         # at most ``sample`` strings of ``REACH`` characters
    return SecretModel(samples, alpha)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SecretModel | None = None) -> DataFrame:
    """One row per row of ``df`` with its spans, without a shuffle.

    A null or empty text has no spans (the digest is that of the empty string). Null ids and repeated rows are scanned
    like any other; other columns are not read. Without labelled credentials there are base spans only.
    """
    model = model or train(df, text_col)

    def work(rows):
        out = []
        for key, raw in rows:
            found = model.spans((raw or b"").decode("utf-8", "replace"))
            n = Counter(k for _, k, _ in found)
            base = joined(x for x in found if x[1] < 3)
            out.append((key, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), joined(found), n[3]))
        return out

    return map_texts(df, [df[id_col].alias("doc_id"), df[text_col].alias("text")], SCHEMA, work)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", model: SecretModel | None = None) -> DataFrame:
    """``df`` with every span replaced by ``mask``; rows without spans, null texts and other columns stay as they are."""
    model = model or train(df, text_col)

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for start, _, end in model.spans(text):
                if end > at:
                    out += [text[at:start], mask] if start >= at else []
                    at = end
            return "".join(out) + text[at:] if out else text
        return texts.map(one)

    return df.withColumn(text_col, clean(F.col(text_col)))
