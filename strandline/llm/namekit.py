"""Name parts, short forms and edit distance shared by problems 4 and 7.

No list of names decides anything here: words are compared by rules, and a short
table of irregular short forms of common names adds to them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Short forms of common given names that the rules below don't derive, "full: short ...".
IRREGULAR = """
abraham: bram
aleksandr: sasha shura
aleksei: alyosha lyosha
alexander: sandy sasha xander
alexandra: sandy sasha lexi
amanda: mandy
anatoly: tolya
andrew: andy
anna: anya nancy
anthony: tony
anton: toni
antonio: nino
august: gus
barbara: babs
boris: borya
brigitte: gitta
charles: chuck
charlotte: lottie charlie
christopher: kit
cornelia: nele
cornelius: neil
cynthia: cindy
daria: dasha
dmitri: dima mitya
dolores: lola
domenico: mimmo
dorothea: dot dottie dolly
dorothy: dot dottie dolly
edward: ned ted teddy
ekaterina: katya katia katja
eleanor: nell nora
elizabeth: liz lizzie lizzy betsy betty libby lisa bess
enrique: kike quique
evgeny: zhenya
filippo: pippo
frances: fanny
francisco: paco pancho kiko frank
frederik: fritz rik
geoffrey: jeff
george: jorge
giuseppe: beppe beppo pino peppe
grigori: grisha
guillermo: memo
gwendolyn: wendy
harold: hal
heinrich: heinz
helen: nell
henrietta: hettie hetty harriet
henry: hank harry
ignacio: nacho
isabella: izzy
ivan: vanya
jacqueline: jackie jacky jacqui
james: jim jimmy
jesus: chuy chucho
johannes: hans
john: jack
jose: pepe
josef: sepp jupp
joseph: joey joe
katherine: kate kit
lawrence: larry
louis: lulu
ludmila: lyuda
ludwig: lutz
luigi: gigi
margaret: maggie meg peggy greta daisy
maria: masha
mary: molly polly
michael: mike mick mischa
mikhail: misha
natalia: natasha tasha
nikolai: kolya nick nicky nico
olga: olya
pablo: paulo
patricia: patty patsy trish
pavel: pasha
penelope: nell
pyotr: petya
rebecca: becky
richard: dick rick ricky
robert: bob bobby
rosalind: roz lindy
rosario: charo
sarah: sally
sergei: seryozha
sofia: sonya
stephen: steve stevie
steven: steve
susannah: suzy sukie suki sanna
tatiana: tanya
theodore: ted teddy
theresa: terry tess tessa
thomas: tom tommy
timothy: timmy
ursula: uschi ursel
veronica: ronnie ronny
virginia: ginny
vladimir: vova volodya
wilhelmina: billie minnie
william: bill billy
yevgenia: zhenya jenya
yuri: yura
yusuf: joe
"""
SHORT: dict[str, frozenset[str]] = {}
for _line in IRREGULAR.split("\n"):
    _full, _, _forms = _line.partition(": ")
    for _form in _forms.split():
        SHORT[_form] = SHORT.get(_form, frozenset()) | {_full}
_TITLES = {"dr", "mr", "mrs", "ms", "prof", "sir", "ing", "dipl", "phd", "herr", "frau", "mme", "sr", "sra", "jr"}


def plain(s: str) -> str:
    """Lower case without accents."""
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c)).replace("ı", "i").replace("ł", "l").replace("ø", "o").replace("đ", "d")


@lru_cache(maxsize=100_000)
def stems(word: str) -> tuple[str, ...]:
    """A word and what is left of it as a diminutive: benny, benn, ben."""
    stem = re.sub(r"(?:ie|[aeiyo])$", "", word)
    out = [word, stem, stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] else stem]
    return tuple(dict.fromkeys(x for x in out if len(x) > 1))


@lru_cache(maxsize=200_000)
def short_of(short: str, full: str) -> bool:
    """Whether one given name is a short form of another.

    Rules: a beginning that leaves out two letters or more (vlad), a diminutive of
    one (benny), an ending of four letters or more (cilla), or an irregular form.
    """
    if short == full or len(short) < 2:
        return False
    if full in SHORT.get(short, ()):
        return True
    return any((full.startswith(t) and len(full) - len(t) > 1) or (t == full and len(short) - len(full) > 1) or (len(t) > 3 and len(full) - len(t) > 1 and full.endswith(t)) for t in stems(short))


@lru_cache(maxsize=200_000)
def same_given(a: str, b: str) -> bool:
    """Equal given names, one a short form of the other, or both irregular forms of one name."""
    return a == b or short_of(a, b) or short_of(b, a) or bool(SHORT.get(a, frozenset()) & SHORT.get(b, frozenset()))
@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance (insert, delete, replace); most + 1 if larger than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0], least = row[0], i, i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            least = min(least, row[j])
        if least > most:
            return most + 1
    return min(row[-1], most + 1)


@lru_cache(maxsize=200_000)
def edits_swapped(a: str, b: str, most: int = 3) -> int:
    """Edit distance in which exchanging two neighbours is one edit and no part is edited twice."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


@lru_cache(maxsize=100_000)
def parts(entry: str) -> list[str]:  # callers must not change it
    """Name words of an entry, given name first: 'LAST First', 'Last, First', roles and brackets removed."""
    s = re.sub(r"\([^)]*\)", " ", entry)
    s = re.split(r"\s[|/–—-]\s", s.strip())[0].strip().lstrip("@")
    if "@" in s:
        s = s.partition("@")[0].replace(".", " ")
    head, comma, tail = s.partition(",")
    if comma and tail.strip():
        s = f"{tail} {head}"
    raw = [w for w in re.split(r"[\s_.]+", s) if w]
    if not comma and len(raw) == 2 and raw[0].isupper() and len(raw[0]) > 2 and not raw[1].isupper():
        raw.reverse()
    words = [w for w in (re.sub(r"[^a-z0-9]", "", plain(w)) for w in raw) if w]
    return [w for w in words if w not in _TITLES] or words
