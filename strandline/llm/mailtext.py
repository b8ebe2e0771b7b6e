"""Only the newly written text of e-mails (problem 2).

1. Every line of a body gets a place: fresh, quoted, introducing a quote,
   closing, signature, notice. Quote marks, indents below an introduction,
   forward headers and signature shapes decide.
2. Lines of six words or more are sentences; two neighbouring sentences are a window. Each
   different window has a 64-bit SimHash over its character 5-grams, cut into 5 blocks; each of
   the 10 pairs of blocks keys one Hamming partition table, so fingerprints within 3 bits share a key in some
   table. An edit of a few words moves a fingerprint further than that, so fresh windows that share one
   of 18 MinHash keys over the same grams are candidates too. Candidates are verified by
   the edit distance of both sentences and by their numbers, which must be the same.
3. A window is inherited, although nothing marks it, if the earliest mail that holds it or
   a near one, fresh or quoted, is another sender's. Short lines inside go with it if an earlier mail has them
   there; so do trailing blocks that recur through a sender's mails. Sentences that more
   senders hold outside of inherited windows than inside are stock phrases; a run of windows
   needs two lines that are none. How many senders hold a window doesn't matter.

Every window is first compared with the earliest of each table key, so that pairs grow with the keys, not their square; only
windows that fail there are compared with the others of their keys. Quoted windows have the Hamming tables only.

"Earlier" is the time the mail itself states (read by the timestamp operator), or its load where that is missing or unclear; of redelivered
rows the first load counts.

Defined results: null or blank bodies give nothing; a null author_email leaves
the author's name as sender, and a mail without both is its own sender; repeated rows of
a doc_id count once; only rows of kind 'email' are read. Quoted sentences are nobody's: they make later
copies inherited, whoever sends them, unless their sender held them before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import timestamps
from strandline.runtime import materialize

_QUOTED = re.compile(r"^\s*(?:>|\|(?:\s|$)|[A-Z]{1,3}>)")
_INDENT = re.compile(r"^(?:\t| {4})")
_INTRO = re.compile(
    r"^(?:(?:On|Am|Le|El|Il|Em|Op)\b.{6,160}\b(?:wrote|schrieb|a écrit|escribió|ha scritto|escreveu|schreef)\b.{0,80}:"
    r"|\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}(?: (?:GMT|UTC)?[+-]\d{2}:?\d{2})? .{2,80}<[^<>\s]+@[^<>\s]+>\s?:"
    r"|[A-ZÀ-Þ][\w'.\-]*(?: [A-ZÀ-Þ][\w'.\-]*){1,4} (?:wrote|schrieb|a écrit|escribió)\s?:)$"
)
_INTRO_HEAD = re.compile(r"^(?:On|Am|Le|El)\b.{8,120}$|^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}\b.{2,100}$")
_INTRO_TAIL = re.compile(r"^<[^<>\s]+@[^<>\s]+>.{0,20}(?:(?:wrote|schrieb|a écrit|escribió)\s?)?:$")
_FORWARD = re.compile(r"^(?:-{2,}\s*[^-].*[^-]\s*-{2,}|Begin forwarded message:|Anfang der weitergeleiteten Nachricht:|Début du message (?:transféré|réexpédié) ?:|Inicio del mensaje reenviado:)$")
_FORWARD_WORD = re.compile(r"message|nachricht|mensaje|messaggio", re.I)
_HEADER = re.compile(r"^\*?(?:From|Von|De|Da|Van)\s?:\*?\s.*(?:@|<)")
_HEADER_NEXT = re.compile(r"^\*?(?:Sent|Date|To|Subject|Gesendet|Datum|An|Betreff|Envoyé|Date|À|Objet|Enviado|Fecha|Para|Asunto|Cc)\s?:\*?")
#: Closing formulas.
CLOSINGS = (
    "best", "best regards", "best wishes", "regards", "kind regards", "warm regards", "many thanks", "thanks", "thank you", "thanks and regards", "many thanks and best wishes", "cheers", "sincerely", "yours", "yours sincerely", "all the best",
    "viele grüße", "beste grüße", "mit freundlichen grüßen", "freundliche grüße", "liebe grüße", "herzliche grüße", "schöne grüße", "gruß", "grüße", "mfg", "vg", "danke", "vielen dank",
    "cordialement", "bien cordialement", "bien à vous", "bien à toi", "amicalement", "merci", "salutations", "meilleures salutations", "sincères salutations",
    "saludos", "saludos cordiales", "un saludo", "un cordial saludo", "atentamente", "gracias", "muchas gracias", "un abrazo",
    "atenciosamente", "cumprimentos", "com os melhores cumprimentos", "obrigado", "obrigada", "abraços", "met vriendelijke groet", "vriendelijke groeten", "groeten", "mvg", "bedankt", "cordiali saluti", "distinti saluti", "grazie", "med vänliga hälsningar", "pozdrawiam",
)
_NOTICE_ONE = re.compile(r"^(?:Sent from my |Sent via |Sent with |Get (?:the )?.{1,30}\b(?:app|Outlook)\b.{0,30}$|Envoyé depuis mon |Envoyé de mon |Von meinem .{2,30} gesendet|Gesendet von meine?m |Enviado desde mi |Diese Nachricht wurde von meinem )", re.I)
_NOTICE_MANY = re.compile(
    r"^(?:CONFIDENTIALITY NOTICE|DISCLAIMER\b|NOTICE:|This (?:e-?mail|message) (?:and|is|may|contains)|The information (?:transmitted|contained)|The contents of this|Views in this (?:e-?)?mail|Please consider the environment|If you are not the (?:intended|named)"
    r"|Diese E-?Mail (?:enthält|ist|und)|Diese Nachricht (?:enthält|ist)|Bitte denken Sie an die Umwelt|Ce (?:message|courriel|mail) (?:et|est|peut)|Les informations contenues|Pensez à l'environnement|Este (?:mensaje|correo) (?:es|y|puede|contiene)|La información contenida|Este e-?mail|Esta mensagem (?:é|pode|contém)|Deze e-?mail|Dit bericht (?:is|kan|bevat)|Questo messaggio|Ce courriel (?:peut|contient)|Le contenu de ce)"
)
_DELIMITER = re.compile(r"^(?:--|—|–|_{5,}|={5,}|\*{5,}|-{5,}|#{5,})$")
_INITIALS = re.compile(r"^/[a-z]{1,3}$")
_CONTACT = re.compile(r"(?:\+\d[\d ()./-]{5,}\d|[\w.+-]+@[\w-]+\.\w+|\bwww\.\w+)")
_BARS = re.compile(r"^[^|]{2,60}(?: \| [^|]{2,60})+$")
_STOP = re.compile(r"[.!?:;…)]$")


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def _name_tokens(email: str | None, raw: str | None) -> set[str]:
    out = set()
    for s in ((email or "").partition("@")[0], raw or ""):
        out |= {w for w in re.split(r"[^a-z]+", _plain(s)) if len(w) > 1}
    return out


def _closing(line: str) -> bool:
    """A closing formula, alone or with a name behind it."""
    low = line.lower().rstrip(" ,.!")
    if low in CLOSINGS:
        return True
    head, sep, name = line.partition(",")
    if sep and head.strip().lower() in CLOSINGS:
        return _like_name(name.strip())
    words = line.split()
    return any(" ".join(words[:k]).lower() in CLOSINGS and _like_name(" ".join(words[k:])) for k in range(1, min(5, len(words))))


def _like_name(s: str) -> bool:
    words = s.strip("* ").split()
    return 0 < len(words) <= 4 and all(w[0].isupper() and not _STOP.search(w.rstrip(".")) and not w[-1].isdigit() for w in words) and not re.search(r"[,!?]|\w{3,}\.$", s)


def _signature_line(s: str, names: set[str]) -> bool:
    t = s.strip("* ")
    if _CONTACT.search(t) and (len(t.split()) <= 12):
        return True
    if _BARS.match(t) or _INITIALS.match(t):
        return True
    words = re.findall(r"[^\W\d_][\w'’.\-]*", t)
    if not words or len(words) > 8 or _STOP.search(t) and not re.search(r"\b[A-Z]\.$|\bInc\.$|\bLtd\.$", t):
        return False
    return all(w[0].isupper() or w in {"of", "and", "for", "the", "de", "und", "et", "y"} for w in words)


def places(body: str, email: str | None = None, raw: str | None = None) -> list[tuple[int, str, str]]:
    """(line number from 1, place, text) of every non-blank line.

    Places: fresh, quoted, intro, closing, signature, notice.
    """
    lines = [x.rstrip() for x in body.split("\n")]
    names = _name_tokens(email, raw)
    out: list[tuple[int, str, str]] = []
    n, introduced, k = len(lines), False, 0

    def following(i: int) -> str:
        return next((x.strip() for x in lines[i + 1 :] if x.strip()), "")

    def put(i: int, place: str) -> None:
        out.append((i + 1, place, lines[i].strip()))

    def is_mark(s: str) -> bool:
        return bool(_QUOTED.match(s) or introduced and _INDENT.match(s))

    def own_name(s: str) -> bool:
        """Nothing but the sender's own name; the line above it closes the mail in whatever language."""
        t = {w for w in re.split(r"[^a-z]+", _plain(s)) if len(w) > 1}
        return bool(t) and t <= names and _like_name(s)

    def starts_other(i: int) -> bool:
        """Line i can't belong to a signature or notice that began above it."""
        s = lines[i].strip()
        return is_mark(lines[i]) or bool(_INTRO.match(s) or _FORWARD.match(s) and _FORWARD_WORD.search(s) or _HEADER.match(s) or _NOTICE_ONE.match(s) or _NOTICE_MANY.match(s) or _INTRO_HEAD.match(s) and _INTRO_TAIL.match(following(i)))

    def signature(i: int, free: int) -> int:
        """Place the signature that begins at i; `free` first lines need only look like names. Next line to read."""
        while i < n:
            s = lines[i].strip()
            if not s:
                # a gap inside a signature is at most one paragraph break before its block
                if not (free and i + 1 < n and lines[i + 1].strip()):
                    return i
                i += 1
                continue
            if starts_other(i) or _DELIMITER.match(s):
                return i
            if not (_signature_line(s, names) or (free and _like_name(s))):
                return i
            put(i, "signature")
            free, i = 0, i + 1
        return i

    while k < n:
        s = lines[k].strip()
        if not s:
            k += 1
        elif is_mark(lines[k]):
            put(k, "quoted")
            introduced, k = True, k + 1
        elif _INTRO.match(s):
            put(k, "intro")
            introduced, k = True, k + 1
        elif _INTRO_HEAD.match(s) and k + 1 < n and _INTRO_TAIL.match(lines[k + 1].strip()):
            put(k, "intro")
            put(k + 1, "intro")
            introduced, k = True, k + 2
        elif (_FORWARD.match(s) and _FORWARD_WORD.search(s)) or (_HEADER.match(s) and _HEADER_NEXT.match(following(k))) or (re.match(r"^[_\-=]{5,}$", s) and _HEADER.match(following(k))):
            for i in range(k, n):  # nothing new stands below a forwarded or unmarked quoted message
                if lines[i].strip():
                    put(i, "intro" if i == k else "quoted")
            k = n
        elif _NOTICE_ONE.match(s) and len(s.split()) <= 9 and not s.endswith("."):
            put(k, "notice")
            k += 1
        elif _NOTICE_MANY.match(s):
            while k < n and lines[k].strip() and not is_mark(lines[k]):
                put(k, "notice")
                k += 1
        elif _closing(s) or (s.endswith(",") and len(s.split()) <= 4 and own_name(following(k))):
            put(k, "closing")
            k = signature(k + 1, 1)
        elif _DELIMITER.match(s) or s == "--":
            put(k, "signature")
            k = signature(k + 1, 1)
        elif _INITIALS.match(s) or (_BARS.match(s) and _signature_line(s, names)):
            put(k, "signature")
            k = signature(k + 1, 0)
        elif _like_name(s) and (t := {w for w in re.split(r"[^a-z]+", _plain(s)) if len(w) > 1}) and t <= names and (k == 0 or not lines[k - 1].strip()):
            put(k, "signature")
            k = signature(k + 1, 0)
        else:
            put(k, "fresh")
            k += 1
    return out


_BANDS, _ROWS, _GRAM = 18, 4, 5
_ODD = np.random.default_rng(57).integers(1, 2**62, _BANDS * _ROWS + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WIDTHS = (13, 13, 13, 13, 12)


def _mix(x: np.ndarray) -> np.ndarray:
    for k in _ODD[:2]:
        x = (x ^ (x >> np.uint64(31))) * k
    return x ^ (x >> np.uint64(32))


#: Grams hashed at once; bounds the memory of very long mails.
_CHUNK = 3_000


def _sums(sentences: list[str], minhash: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence: sums of the 64 bits of its grams' hashes, their number, and the least hash of each MinHash row."""
    texts = [x.ljust(_GRAM) for x in sentences]
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(c) - _GRAM + 1, np.uint64)
    for i in range(_GRAM):
        h += c[i : len(c) - _GRAM + 1 + i] * _ODD[2 + i]
    n = np.array([len(x) for x in texts])
    ends = np.cumsum(n)
    h = _mix(h[np.concatenate([np.arange(e - k, e - _GRAM + 1) for k, e in zip(n, ends, strict=True)])])
    n = n - _GRAM + 1
    start = np.cumsum(n) - n
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, start, axis=0, dtype=np.int64)
    least = np.minimum.reduceat((h[:, None] * _ODD[None, 8:]) >> np.uint64(20), start, axis=0) if minhash else np.zeros((len(n), 0), np.uint64)
    return sums, n, least


def simhashes(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of rows of bit sums over n hashes; ties alternate by bit."""
    up = (sums * 2 > n[:, None]) | ((sums * 2 == n[:, None]) & (np.arange(64) % 2 == 0))
    return np.packbits(up, axis=1).view(np.uint64)[:, 0]


def hamming_keys(fp: np.ndarray) -> np.ndarray:
    """One key for each pair of the 5 blocks of a fingerprint."""
    blocks, at = [], 0
    for w in _WIDTHS:
        blocks.append(fp >> np.uint64(at) & np.uint64((1 << w) - 1))
        at += w
    return np.stack([(np.uint64(t) << np.uint64(32)) + (blocks[i] << np.uint64(16)) + blocks[j] for t, (i, j) in enumerate(combinations(range(5), 2))], axis=1)


def window_keys(sentences: list[str], first: list[int], second: list[int], fresh: bool = True) -> list[list[int]]:
    """Keys of the Hamming tables and, of fresh windows, MinHash bands of the windows of two of the sentences each.

    There is one set of keys for each sequence of numbers in them.
    """
    if not first:
        return []
    done, at = [], 0
    while at < len(sentences):
        if len(sentences[at]) > _CHUNK:  # a very long sentence in pieces that overlap by all but one letter of a gram
            parts = [_sums([sentences[at][i : i + _CHUNK + _GRAM - 1]], fresh) for i in range(0, len(sentences[at]) - _GRAM + 1, _CHUNK)]
            done.append((sum(p[0] for p in parts), sum(p[1] for p in parts), np.minimum.reduce([p[2] for p in parts])))
            at += 1
            continue
        size, to = len(sentences[at]), at + 1
        while to < len(sentences) and size + len(sentences[to]) <= _CHUNK:
            size += len(sentences[to])
            to += 1
        done.append(_sums(sentences[at:to], fresh))
        at = to
    sums, n, least = (np.concatenate([d[k] for d in done]) for k in range(3))
    digits = [" ".join(_NUMBER.findall(x)) for x in sentences]
    numbers = np.array([xxhash.xxh3_64_intdigest(f"{digits[i]} . {digits[j]}") >> 2 for i, j in zip(first, second, strict=True)], np.uint64)[:, None] << np.uint64(1)
    keys = [hamming_keys(simhashes(sums[first] + sums[second], n[first] + n[second])) ^ numbers]
    if fresh:
        both = np.minimum(least[first], least[second]).reshape(-1, _BANDS, _ROWS)
        band = np.broadcast_to(np.arange(_BANDS, dtype=np.uint64), both.shape[:2])
        for k in range(_ROWS):
            band = _mix(band + both[:, :, k])
        keys.append((band | np.uint64(1 << 63)) ^ numbers)
    return np.concatenate(keys, axis=1).view(np.int64).tolist()


_NUMBER = re.compile(r"\d+")
_FRESH = "doc_id string, sender string, at bigint, line_no bigint, fresh boolean, tail boolean, sentence string, below bigint, under boolean, long boolean, windows array<struct<l2:bigint,c:bigint,t2:bigint,next:boolean,inner:array<struct<l:bigint,t:string>>,keys:array<bigint>>>, t bigint"
_UNQUOTE = re.compile(r"^(?:\s*(?:>|\||[A-Z]{1,3}>))+\s*")


#: Windows whose keys a task remembers having given, so that copies in one task give them once.
_REMEMBERED = 200_000


def _id(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


class _Pending:
    """Windows of a batch whose keys are computed together, and those a task has given keys for."""

    def __init__(self) -> None:
        self.given: set[int] = set()
        self.texts: dict[bool, list[str]] = {True: [], False: []}
        self.wanted: dict[bool, list[tuple[int, list]]] = {True: [], False: []}

    def windows(self, lines: list[tuple[int, str, bool]], fresh: bool) -> dict[int, list[tuple]]:
        """Of (line, sentence, long): by line, the windows that begin there; with the next sentence, or the next but one."""
        at = [i for i, x in enumerate(lines) if x[2]]
        out: dict[int, list[tuple]] = {}
        ids, base = [_id(lines[i][1]) for i in at], len(self.texts[fresh])
        self.texts[fresh] += [lines[i][1] for i in at]
        for n, i in enumerate(at):
            for gap in (1, 2):
                if n + gap < len(at):
                    j = at[n + gap]
                    inner = [(no, t) for no, t, long in lines[i + 1 : j] if not long] if gap == 1 else []
                    c, keys = _id(f"{lines[i][1]}\n{lines[j][1]}"), []
                    if gap == 1 and (c ^ fresh) not in self.given:
                        if len(self.given) > _REMEMBERED:
                            self.given.clear()
                        self.given.add(c ^ fresh)
                        self.wanted[fresh].append((base + n, keys))
                    out.setdefault(lines[i][0], []).append((lines[j][0], c, ids[n + gap], gap == 1, inner, keys))
        return out

    def fill(self) -> None:
        for fresh, wanted in self.wanted.items():
            first = [n for n, _ in wanted]
            for (_, keys), got in zip(wanted, window_keys(self.texts[fresh], first, [n + 1 for n in first], fresh), strict=True):
                keys += got
            self.texts[fresh], self.wanted[fresh] = [], []


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pending = _Pending()
    for b in batches:
        rows = []
        for doc, body, email, raw, at in zip(b["doc_id"], b["body"], b["author_email"], b["author_raw"], b["at"], strict=True):
            email = email if isinstance(email, str) and email.strip() else None
            sender = (email or (raw if isinstance(raw, str) and raw.strip() else doc)).strip().lower()
            lines = places(body, email, raw if isinstance(raw, str) else None)
            fresh = [x for x in lines if x[1] == "fresh"]
            last = max((x[0] for x in fresh), default=0)
            words = [re.findall(r"[^\W_]+", text.casefold()) for _, _, text in fresh]
            below, ends = 0, []
            for w in reversed(words):
                below = xxhash.xxh3_64_intdigest(f"{below} {' '.join(w)}")
                ends.append(below - 2**63)
            mine = [(no, " ".join(w), len(w) >= 6) for (no, _, _), w in zip(fresh, words, strict=True)]
            windows, under = pending.windows(mine, True), False
            for nth, (no, sentence, long) in enumerate(mine):
                rows.append((doc, sender, at, no, True, no == last, sentence, ends[-1 - nth], under, long, windows.get(no, []), _id(sentence)))
                under = under or long
            other = [(no, re.findall(r"[^\W_]+", _UNQUOTE.sub("", text).casefold())) for no, place, text in lines if place == "quoted"]
            other = [(no, " ".join(w), len(w) >= 6) for no, w in other]
            windows = pending.windows(other, False)
            rows += [(doc, "", at, no, False, False, sentence, 0, False, long, windows.get(no, []), _id(sentence)) for no, sentence, long in other if long]
        pending.fill()
        yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _FRESH.split(", ")])


def near_windows(lines: DataFrame, held: DataFrame, edits: float = 0.1) -> DataFrame:
    """(c, src): windows and earlier near windows; those that near-match the head of a key aren't compared with the others of it.

    lines: as of lines_of(); held: (c, at, sender, doc_id, l1, l2) of the earliest mail with each window. Both
    sentences must be within the edit limit and have the same numbers, in which filled-in templates differ.
    """
    keyed = lines.select("at", F.explode("windows").alias("w")).select(F.explode("w.keys").alias("key"), "at", "w.c").repartition("key")
    heads = keyed.groupBy("key").agg(F.min(F.struct("at", "c")).alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", F.col("f.c").alias("src"))
    met = materialize(keyed.select("key", "c").join(heads.hint("merge"), "key").distinct(), "met")
    stars = materialize(met.where("c <> src").select("c", "src").distinct(), "stars")
    wanted = stars.select("c").unionByName(stars.select(F.col("src").alias("c"))).distinct()
    spots = held.join(wanted, "c", "left_semi").select("c", "at", "doc_id", "l1", "l2")
    text = lambda l, name: lines.where("long").select("doc_id", F.col("line_no").alias(l), F.col("sentence").alias(name))
    texts = materialize(spots.join(text("l1", "text1"), ["doc_id", "l1"]).join(text("l2", "text2"), ["doc_id", "l2"]).dropDuplicates(["c"]).select("c", "at", "text1", "text2"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        x = pairs.join(texts.select("c", F.col("at").alias("c_at"), F.col("text1").alias("x1"), F.col("text2").alias("x2")), "c")
        x = x.join(texts.select(F.col("c").alias("src"), F.col("at").alias("src_at"), F.col("text1").alias("y1"), F.col("text2").alias("y2")), "src").where("src_at <= c_at")
        for i in (1, 2):
            a, b = F.col(f"x{i}"), F.col(f"y{i}")
            most = F.ceil(F.greatest(F.length(a), F.length(b)) * edits).cast("int")
            x = x.where(F.regexp_extract_all(a, F.lit(r"\d+"), F.lit(0)) == F.regexp_extract_all(b, F.lit(r"\d+"), F.lit(0)))
            # with a limit the distance costs length times limit, and is -1 beyond it
            x = x.withColumn("most", most).where((F.abs(F.length(a) - F.length(b)) <= F.col("most")) & F.expr(f"levenshtein(x{i}, y{i}, most) >= 0"))
        return x.select("c", "src")

    close = materialize(verified(stars), "close")
    # what no head matched is compared with the other earlier windows of its keys
    open_ = stars.select("c").distinct().join(close.select("c"), "c", "left_anti")
    rest = met.where("c <> src").select("key", "c")
    more = rest.join(open_, "c", "left_semi").join(rest.select("key", F.col("c").alias("src")), "key").where("c <> src").select("c", "src").distinct()
    return close.unionByName(verified(more)).distinct()


def mails_of(raw_docs: DataFrame, clocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, body, author_email, author_raw, at): each mail once, as first loaded; at: its stated time, else its load, in microseconds."""
    m = raw_docs.where("kind = 'email' and doc_id is not null and body is not null")
    for c in ("created_at", "tool"):
        if c not in m.columns:
            m = m.withColumn(c, F.lit(None).cast("string"))
    first = Window.partitionBy("doc_id").orderBy(F.col("loaded_at").asc_nulls_last(), F.xxhash64("body", "author_email", "author_raw"))
    m = m.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    m = m.select("doc_id", "body", "author_email", "author_raw", F.unix_micros("loaded_at").alias("loaded"), F.col("created_at").alias("value"), F.col("tool").alias("source"))
    clocks = clocks if clocks is not None else m.sparkSession.createDataFrame([], "tool string, tz_name string, day_first boolean")
    return timestamps.normalise(m, clocks).select("doc_id", "body", "author_email", "author_raw", F.coalesce("epoch_us", "loaded", F.lit(0)).alias("at"))


def inherited_lines(lines: DataFrame, edits: float = 0.1) -> DataFrame:
    """(doc_id, line_no, near): lines of windows whose earliest mail is another sender's; near: found by the fingerprints only."""
    w = lines.select("doc_id", "sender", "at", "fresh", F.col("line_no").alias("l1"), F.col("t").alias("t1"), F.explode("windows").alias("w")).select("doc_id", "sender", "at", "fresh", "l1", "t1", "w.l2", "w.c", "w.t2", "w.next", "w.inner")
    first = F.struct("at", F.when(F.col("fresh"), 0).otherwise(1).alias("q"), "sender", "doc_id", "l1", "l2")
    held = w.groupBy("c").agg(F.min(first).alias("f"), F.max("next").alias("next"), (F.min("doc_id") != F.max("doc_id")).alias("several"))
    held = materialize(held.select("c", "f.at", "f.sender", "f.doc_id", "f.l1", "f.l2", "next", "several"), "held")
    near = materialize(near_windows(lines, held, edits), "near")
    own = held.where("several").select("c", F.col("c").alias("src"), F.col("at").alias("src_at"), F.col("sender").alias("src_sender"), F.lit(False).alias("near"))
    other = near.join(held.select(F.col("c").alias("src"), F.col("at").alias("src_at"), F.col("sender").alias("src_sender")), "src").select("c", "src", "src_at", "src_sender", F.lit(True).alias("near"))
    # the earliest holder of a window and its near ones; by itself first, so that `near` marks what only fingerprints find
    best = own.unionByName(other).groupBy("c").agg(F.min(F.struct("src_at", "near", "src", "src_sender")).alias("b")).select("c", "b.*")
    own_first = held.select("c", F.col("at").alias("own_at"), F.col("sender").alias("own_sender"))
    late = w.where("fresh and next").join(best, "c").join(own_first, "c").where("src_at < at and src_sender <> sender")
    late = late.withColumn("near", F.col("near") & ~((F.col("own_at") < F.col("at")) & (F.col("own_sender") != F.col("sender"))))
    hits = materialize(late.select("doc_id", "sender", "at", "l1", "l2", "t1", "t2", "inner", "src", "near"), "hits")
    # a stock phrase stands mostly alone: more senders hold it outside of inherited windows than inside
    inside = hits.select("sender", F.explode(F.array("t1", "t2")).alias("t")).groupBy("t").agg(F.count_distinct("sender").alias("inside"))
    every = lines.where("fresh and long").select("sender", "t").join(inside.select("t"), "t", "left_semi").groupBy("t").agg(F.count_distinct("sender").alias("senders"))
    # the sender of the source holds it inside too
    stock = every.join(inside, "t").where("senders - inside - 1 > inside + 1").select("t", F.lit(True).alias("stock"))
    two = hits.select("doc_id", "l1", "l2", "near", "t1", "t2")
    for i in (1, 2):
        two = two.join(stock.select(F.col("t").alias(f"t{i}"), F.col("stock").alias(f"s{i}")), f"t{i}", "left")
    run = Window.partitionBy("doc_id").orderBy("l1")
    two = two.withColumn("step", F.when(F.col("l1") == F.lag("l2").over(run), 0).otherwise(1)).withColumn("run", F.sum("step").over(run))
    each = two.select("doc_id", "run", "near", F.explode(F.array(F.struct(F.col("l1").alias("l"), F.col("s1").alias("s")), F.struct(F.col("l2").alias("l"), F.col("s2").alias("s")))).alias("e")).groupBy("doc_id", "run", F.col("e.l").alias("line_no")).agg(F.max("e.s").alias("stock"), F.min("near").alias("near"))
    free = each.groupBy("doc_id", "run").agg(F.sum(F.when(F.col("stock").isNull(), 1).otherwise(0)).alias("free")).where("free >= 2").select("doc_id", "run")
    kept = materialize(each.join(free, ["doc_id", "run"]).select("doc_id", "line_no", "near"), "runs")
    # a short line inside goes with its window if an earlier mail of another sender has it there
    gaps = hits.where("size(inner) > 0").join(kept.select("doc_id", F.col("line_no").alias("l1")), ["doc_id", "l1"], "left_semi").select("doc_id", "sender", "at", "src", "near", F.explode("inner").alias("i"))
    told = w.where("size(inner) > 0").select(F.col("c").alias("src"), "at", "sender", F.explode("inner.t").alias("t")).groupBy("src", "t").agg(F.min(F.struct("at", "sender")).alias("f"))
    alike = F.levenshtein(F.col("i.t"), F.col("t")) <= F.ceil(F.greatest(F.length("i.t"), F.length("t")) * edits)
    enclosed = gaps.join(told, "src").where((F.col("f.at") < F.col("at")) & (F.col("f.sender") != F.col("sender")) & alike).select("doc_id", F.col("i.l").alias("line_no"), "near")
    return kept.unionByName(enclosed).groupBy("doc_id", "line_no").agg(F.min("near").alias("near"))


def boilerplate_lines(fresh: DataFrame, at_least: int = 3, share: float = 0.2) -> DataFrame:
    """(doc_id, line_no) of the last lines, or whole trailing blocks, that recur through a fifth of a sender's mails.

    A block of two lines or more counts where it stands under a sentence, so that mails sent repeatedly are no blocks.
    """
    mails = fresh.groupBy("sender").agg(F.countDistinct("doc_id").alias("mails"))
    often = fresh.groupBy("sender", "below").agg(F.sum(F.when(F.col("tail") | F.col("under"), 1).otherwise(0)).alias("n")).where(F.col("n") >= at_least)
    often = often.join(mails, "sender").where(F.col("n") >= share * F.col("mails")).select("sender", "below")
    return fresh.join(often, ["sender", "below"]).select("doc_id", "line_no")


def lines_of(raw_docs: DataFrame, clocks: DataFrame | None = None) -> DataFrame:
    """Fresh and quoted lines of all mails, with the windows that begin at them."""
    return materialize(mails_of(raw_docs, clocks).mapInPandas(_parse, _FRESH), "lines")


def found(raw_docs: DataFrame, clocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no) of newly written lines. clocks: tool, tz_name, day_first for reading the mails' times."""
    lines = lines_of(raw_docs, clocks)
    fresh = lines.where("fresh")
    drop = inherited_lines(lines).select("doc_id", "line_no").unionByName(boilerplate_lines(fresh)).distinct()
    return fresh.join(drop, ["doc_id", "line_no"], "left_anti").select("doc_id", "line_no")


def inherited(raw_docs: DataFrame, clocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, near): unmarked lines taken from earlier mails."""
    return inherited_lines(lines_of(raw_docs, clocks))
