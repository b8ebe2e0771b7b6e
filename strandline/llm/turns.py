"""Speech transcripts into clean speaker turns (problem 4).

1. A body is cut into adjacent segments at every place where a speaker label
   may stand: line starts, cue times, voice tags, and words before a colon.
2. Gradient-boosted trees decide for each adjacent pair of segments whether a new
   speaker's segment begins, from the label, its fit to the participants, the
   gap in time and the words around. They are trained on transcripts whose time
   marks show the true boundaries; the marks themselves are kept from them.
3. Labels are normalised to participants: name parts in any order, short
   forms, initials and small misspellings, over all participants at once.
4. Each token is classed as speech, hesitation or annotation; only speech is counted.

Segments are put into spoken order by their times; neighbours of one speaker
make one turn; what has no words left is dropped first.

Defined results: null or blank bodies and empty participant lists give nothing;
speech before any label is nobody's and is left out; null and blank
participants can't be chosen; repeated rows of a doc_id count once (first
load); only rows of kind 'transcript' are read. Without time-marked transcripts
a label must fit a participant by 0.6, a time-marked one by 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.namekit import SHORT, edits_swapped, parts, plain, same_given

_CUE = re.compile(r"^\s*(\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d+)?\s*-->")
_STAMP = re.compile(r"^\s*(?:\[(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)\]|\((\d{1,2}:\d{2}(?::\d{2})?)\)(?=\s*[^:\s])|(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)(?=\s+-\s))\s*")
_DASH_LABEL = re.compile(r"^-\s+([^:]{1,60}?)\s+-(?:\s+|$)")
_VOICE = re.compile(r"^\s*<v(?:\.[^\s>]+)?\s+([^>]{1,80})>")
_COLON = re.compile(r"(?:\s*\((\d{1,2}:\d{2}(?::\d{2})?)\)\s*)?:(?=\s|$)")
_UNIT = re.compile(r"\s\([A-Za-z][A-Za-z &-]{1,30}\)$")
_SENTENCE_END = re.compile(r"(?:\w{3,}|\d)[.!?…]\s")
_TAIL = re.compile(r"(?:[^\s:()\[\]{}<>]+[ ,]+){0,4}[^\s:()\[\]{}<>]+$")

#: Words of sound and recording annotations in round brackets.
_SOUNDS = set(
    "laughs laughing laughter laugh chuckles chuckling giggles inaudible unintelligible indistinct crosstalk overlapping silence pause pauses music applause clapping clears throat coughs coughing cough sighs sigh sneezes sneeze sniffs breathes breath door closes opens slams knock knocks knocking phone rings ringing beep beeps typing keyboard noise noises background static"
    " recording begins starts started ends ended stops stopped paused resumes resumed transcript transcription generated automatically audio cuts out muted unmuted whispers whispering groans yawns rustling paper papers shuffling footsteps mumbles talking talk in the of and is ".split()
)
_HESITATION = re.compile(r"^(?:u+[hm]+|u+h+m+|e+r+m*|e+h+m*|h+m+|m+h*m+|a+h+m*|h+u*h+|ä+h+m*|e+u+h+)$")
_BRACKETS = re.compile(r"\[[^\[\]]*\]|\{[^{}]*\}|\*[^*\n]{1,40}\*|<[^<>\n]{1,40}>|♪[^♪\n]*♪|[♪♫♩♬]")
_DASHED = re.compile(r"--\s*(?:begin|end|start|stop|pause|break|recording [a-z]+)\w*\s*--", re.I)
_ROUND = re.compile(r"\(([^()]*)\)")


def _seconds(t: str) -> float:
    s = 0.0
    for x in t.replace(",", ".").split(":"):
        s = s * 60 + float(x)
    return s


def speech_tokens(text: str) -> list[str]:
    """Tokens of speech: annotations, hesitations and wordless tokens removed."""
    text = _DASHED.sub(" ", _BRACKETS.sub(" ", text))
    text = _ROUND.sub(lambda m: " " if _is_sound(m[1]) else m[0], text)
    return [t for t in text.split() if any(c.isalnum() for c in t) and not _HESITATION.match(plain(t).strip(".,;:!?…—–-()\"'“”"))]


def _is_sound(inner: str) -> bool:
    words = re.findall(r"[a-z']+", inner.lower())
    return bool(words) and all(w in _SOUNDS for w in words) and not re.search(r"\d{3,}", inner)


@dataclass
class Person:
    """A participant entry with its name parts."""

    entry: str
    words: list[str] = field(default_factory=list)


@lru_cache(maxsize=100_000)
def _one(a: str, b: str) -> float:
    """How well two name words agree."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.7 if a[0] == b[0] else 0.0
    if same_given(a, b):
        return 0.95
    d = edits_swapped(a, b, 2)
    if d <= 2 and d / max(len(a), len(b)) <= 0.34:
        return 0.92 - 0.06 * d
    return 0.0


def fit(label: str, person: Person) -> float:
    """Fit of a speaker label to a participant, 0 to 1."""
    mine, theirs = parts(label), person.words
    if not mine or not theirs or any(len(w) > 1 and w not in theirs for w in mine[1:-1]):
        return 0.0
    if len(mine) == 1:
        w = mine[0]
        best = 0.0
        if len(w) > 1:
            first, last = _one(w, theirs[0]), _one(w, theirs[-1])
            best = max(0.9 * first if len(theirs[0]) > 1 else 0.0, 0.85 * last if len(theirs[-1]) > 1 else 0.0)
        if len(theirs) >= 2 and len(w) in (2, 3):
            ends = {a[0] + b[0] for a in (theirs[0], *SHORT.get(theirs[0], ())) for b in (theirs[-1],)}
            best = max(best, 0.8 if w in ends or (len(w) == 3 and w[0] + w[-1] in ends) else 0.0)
        if len(theirs) == 1 and len(theirs[0]) > 3:  # a handle
            best = max(best, 0.75 if theirs[0].endswith(w) and len(w) > 3 else 0.0)
        return best
    if len(theirs) == 1:
        h = theirs[0]
        return max((0.85 for a, b in ((mine[0], mine[-1]), (mine[-1], mine[0])) if h in (a[0] + b, a + b, a + b[0])), default=0.9 * max(_one(mine[0], h), _one(mine[-1], h)) if min(len(mine[0]), len(h)) > 1 else 0.0)
    straight = (_one(mine[0], theirs[0]), _one(mine[-1], theirs[-1]))
    turned = (_one(mine[0], theirs[-1]), _one(mine[-1], theirs[0]))
    return max(sum(p) / 2 if min(p) > 0 else 0.0 for p in (straight, turned))


class Cast:
    """All participants of one transcript."""

    def __init__(self, entries: list[str]) -> None:
        self.people = [Person(e, parts(e)) for e in dict.fromkeys(entries) if e and e.strip()]
        self.known: dict[str, tuple[float, float, str | None]] = {}

    def best(self, label: str) -> tuple[float, float, str | None]:
        """Best fit, lead over the next participant, and the entry."""
        if label not in self.known:
            scored = sorted(((fit(label, p), -i, p.entry) for i, p in enumerate(self.people)), reverse=True)
            top = scored[0] if scored else (0.0, 0, None)
            self.known[label] = (top[0], top[0] - (scored[1][0] if len(scored) > 1 else 0.0), top[2] if top[0] > 0 else None)
        return self.known[label]


@dataclass
class Segment:
    """Text from one possible boundary to the next."""

    text: str
    label: str | None
    time: float | None
    marked: bool  # by a time mark or voice tag: a sure boundary
    fresh_line: bool
    after: str  # text before the boundary
    line: int


def segments(body: str, cast: Cast) -> list[Segment]:
    """Adjacent segments of a body, cut wherever a speaker may change."""
    out: list[Segment] = []
    cue: float | None = None
    one_line = sum(1 for x in body.split("\n") if x.strip()) < 3

    def cut(text: str, line: int, fresh: bool, time: float | None, marked: bool) -> None:
        """Cut text at labels inside it."""
        pos, label, stamp, first = 0, None, time, True
        for m in _COLON.finditer(text):
            head = text[pos : m.start()]
            unit = _UNIT.search(head)
            tail = _TAIL.search(head[: unit.start()] if unit else head)
            if not tail:
                continue
            name, skip = _last_label(tail[0], cast)
            a = pos + tail.start() + skip
            if a > 0 and not re.search(r"(?:[.!?…\])}>*♪\"]|--|\s[—–])\s*$|^\s*[—–]?\s*$", text[max(0, a - 12) : a]):
                continue
            before = text[pos:a]
            if before.strip() or label is not None or not first:
                out.append(Segment(before, label, stamp, marked, fresh and first, out[-1].text if out else "", line))
                first = False
            t = _seconds(m[1]) if m[1] else None
            marked = t is not None or (marked and first and a == 0)
            pos, label, stamp = m.end(), name + (unit[0] if unit else ""), t if t is not None else (time if first else None)
        out.append(Segment(text[pos:], label, stamp, marked, fresh and first, out[-1].text if out else "", line))

    for n, line in enumerate(body.split("\n")):
        line = line.rstrip("\r")
        if not line.strip() or line.strip() == "WEBVTT":
            continue
        if _CUE.match(line):
            cue = _seconds(line.split("-->")[0].strip())
            continue
        time, marked, rest = None, False, line
        if m := _STAMP.match(line):
            time, marked, rest = _seconds(m[1] or m[2] or m[3]), True, line[m.end() :]
            if d := _DASH_LABEL.match(rest):
                out.append(Segment(rest[d.end() :], d[1].strip(), time, True, True, out[-1].text if out else "", n))
                continue
        if m := _VOICE.match(rest):
            out.append(Segment(rest[m.end() :], m[1].strip(), cue if time is None else time, True, True, out[-1].text if out else "", n))
            cue = None
            continue
        if time is None and cue is not None:
            time, marked, cue = cue, True, None
        cut(rest, n, not one_line or not out, time, marked)
    return out


def _last_label(raw: str, cast: Cast) -> tuple[str, int]:
    """The end of raw that fits a participant best, and how much of raw comes before it."""
    starts = [0] + [m.end() for m in re.finditer(r"[ ]+", raw)]
    best = (0.0, 0)
    for s in starts:
        name = raw[s:].strip()
        if 0 < len(name) <= 60 and name[0].isalnum() and not _SENTENCE_END.search(name) and len(name.split()) <= 5:
            score = cast.best(name)[0] + (0.0001 * min(len(name), 40))
            if score > best[0] + 1e-9 and cast.best(name)[0] > 0:
                best = (score, s)
    if best[0] == 0.0:
        return raw.strip(), 0
    return raw[best[1] :].strip(), best[1]


FEATURES = 9


def features(segs: list[Segment], cast: Cast) -> np.ndarray:
    """One row per segment; nothing here looks at time marks of the boundary itself except the gap."""
    labels = [s.label for s in segs]
    often: dict[str, int] = {}
    for x in labels:
        if x:
            often[x.lower()] = often.get(x.lower(), 0) + 1
    rows, last_time, speaker = [], None, None
    for s in segs:
        score, lead, who = cast.best(s.label) if s.label else (0.0, 0.0, None)
        gap = s.time - last_time if s.time is not None and last_time is not None else -1.0
        last_time = s.time if s.time is not None else last_time
        words = s.label.split() if s.label else []
        ended = bool(re.search(r"[.!?…\])}>*♪]\s*$", s.after[-12:])) or not s.after.strip()
        rows.append([score, lead, float(bool(s.label)), float(len(words)), float(s.fresh_line), float(ended), float(often.get((s.label or "").lower(), 0)), min(max(gap, -1.0), 120.0), float(who is not None and who == speaker)])
        if score >= 0.6:
            speaker = who
    return np.array(rows, float).reshape(-1, FEATURES)


class BoostedTrees:
    """Gradient boosting of the logistic loss with trees of depth 2."""

    def __init__(self, rounds: int = 40, rate: float = 0.3) -> None:
        self.rounds, self.rate = rounds, rate
        self.start, self.trees = 0.0, []

    def _stump(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
        best, choice = 1e-6, None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            cuts = (values[1:] + values[:-1]) / 2
            cuts = cuts[np.linspace(0, len(cuts) - 1, min(32, len(cuts))).astype(int)]
            for c in np.unique(cuts):
                m = x[:, f] <= c
                gain = sum(g[k].sum() ** 2 / (h[k].sum() + 1.0) for k in (m, ~m)) - g.sum() ** 2 / (h.sum() + 1.0)
                if gain > best:
                    best, choice = gain, (f, float(c))
        return choice

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-6
            top = self._stump(x, g, h)
            if top is None:
                break
            m = x[:, top[0]] <= top[1]
            sides = []
            for k in (m, ~m):
                cut = self._stump(x[k], g[k], h[k]) or (0, np.inf)
                leaf = []
                for kk in (x[:, cut[0]] <= cut[1], x[:, cut[0]] > cut[1]):
                    kk = k & kk
                    leaf.append(float(self.rate * g[kk].sum() / (h[kk].sum() + 1.0)))
                sides.append((cut, leaf))
            self.trees.append((top, sides))
            score = score + self._tree(x, self.trees[-1])
        return self

    @staticmethod
    def _tree(x: np.ndarray, tree: tuple) -> np.ndarray:
        (f, c), sides = tree
        out = [np.where(x[:, cut[0]] <= cut[1], leaf[0], leaf[1]) for cut, leaf in sides]
        return np.where(x[:, f] <= c, out[0], out[1])

    def chance(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for t in self.trees:
            score = score + self._tree(x, t)
        return 1 / (1 + np.exp(-score))


def train(rows: list[tuple[str, list[str]]]) -> BoostedTrees | None:
    """Boundary model from (body, participants) of time-marked transcripts, or None if they show nothing."""
    xs, ys = [], []
    for body, entries in rows:
        cast = Cast(list(entries or []))
        segs = segments(body or "", cast)
        if not segs or not any(s.marked for s in segs):
            continue
        x = features(segs, cast)
        keep = np.array([s.marked and bool(s.label) or not s.marked for s in segs])
        xs.append(x[keep])
        ys.append(np.array([float(s.marked and bool(s.label)) for s in segs])[keep])
    if not xs:
        return None
    x, y = np.concatenate(xs), np.concatenate(ys)
    masked = x.copy()
    masked[:, 7] = -1.0  # transcripts without times must be decided by the rest
    x, y = np.concatenate([x, masked]), np.concatenate([y, y])
    return BoostedTrees().fit(x, y) if 0 < y.mean() < 1 else None


def clean_turns(body: str | None, entries: list[str] | None, model: BoostedTrees | None) -> list[tuple[str, int]]:
    """(participant, number of words) of each turn in spoken order."""
    cast = Cast([e for e in (entries if entries is not None else []) if e])
    if not body or not body.strip() or not cast.people:
        return []
    segs = segments(body, cast)
    if not segs:
        return []
    x = features(segs, cast)
    yes = model.chance(x) >= 0.5 if model else x[:, 0] >= np.where([s.marked for s in segs], 0.5, 0.6)
    pieces: list[tuple[float, int, str | None, list[str]]] = []  # time, order, label's owner, texts
    for s, new in zip(segs, yes, strict=True):
        who = cast.best(s.label)[2] if s.label else None
        begins = who is not None and bool(new)
        text = s.text if begins or s.label is None else f"{s.label}: {s.text}"
        if begins or (s.marked and s.time is not None and s.label is None) or not pieces:
            when = s.time if s.time is not None else (pieces[-1][0] if pieces else -1.0)
            pieces.append((when, len(pieces), who if begins else None, [text]))
        else:
            pieces[-1][3].append(text)
    turns: list[tuple[str, int]] = []
    speaker: str | None = None
    for _, _, who, texts in sorted(pieces, key=lambda p: (p[0], p[1])):
        speaker = who or speaker
        n = len(speech_tokens("\n".join(texts)))
        if speaker is None or n == 0:
            continue
        if turns and turns[-1][0] == speaker:
            turns[-1] = (speaker, turns[-1][1] + n)
        else:
            turns.append((speaker, n))
    return turns


def _run(model: BoostedTrees | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, s, n) for d, body, who in zip(b["doc_id"], b["body"], b["participants_raw"], strict=True) for i, (s, n) in enumerate(clean_turns(body, None if who is None else list(who), model), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "turn_no", "speaker", "n_words"])

    return run


def transcripts_of(raw_docs: DataFrame) -> DataFrame:
    t = raw_docs.where("kind = 'transcript' and doc_id is not null and body is not null")
    return t.groupBy("doc_id").agg(F.min(F.struct("loaded_at", "body", "participants_raw")).alias("r")).select("doc_id", "r.body", "r.participants_raw")


def boundary_model(raw_docs: DataFrame, sample: int = 200) -> BoostedTrees | None:
    """Model trained on at most `sample` time-marked transcripts, chosen by hash of their id.

    Only ids are ranked; the bodies of the chosen ones alone come to the driver.
    """
    t = raw_docs.where("kind = 'transcript' and doc_id is not null and body is not null and participants_raw is not null").where(F.col("body").rlike(r"(?m)^\s*(\[\d{1,2}:\d{2}|\d{1,2}:\d{2}:\d{2}|<v )|\(\d{1,2}:\d{2}\):"))
    ids = [r["doc_id"] for r in t.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    rows = transcripts_of(t.where(F.col("doc_id").isin(ids))).collect() if ids else []
    return train([(r["body"], r["participants_raw"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def found(raw_docs: DataFrame) -> DataFrame:
    return transcripts_of(raw_docs).mapInPandas(_run(boundary_model(raw_docs)), "doc_id string, turn_no bigint, speaker string, n_words bigint")
