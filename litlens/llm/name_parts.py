"""Names as people type them: parsing into family part and given parts, and similarity of the parts."""

from __future__ import annotations

import re
import unicodedata

# Particles before family names.
PARTICLES = frozenset("van von de der den des del della di da dos du la le ter ten zu zur af av bin ibn al el".split())
# Given names and their usual short, pet and written-abbreviated forms.
SHORT_FORMS = {
    "alexander": "alex alexr sasha lex xander", "alfred": "alf fred", "andrew": "andy drew", "anne": "ann anna annie nan", "anthony": "tony", "benjamin": "ben benj benny",
    "catherine": "cathy kate cath", "charles": "charlie chas chuck", "christopher": "chris kit topher", "daniel": "dan danny danl", "david": "dave davy", "deborah": "deb debbie",
    "dmitri": "dima mitya", "donald": "don", "dorothy": "dot dolly", "edward": "ed eddie ted ned edw", "elizabeth": "liz beth betty eliza lisa lizzie bess", "eleanor": "nell ellie nora",
    "francisco": "paco pancho fran", "francis": "frank", "frederick": "fred freddie fredk", "geoffrey": "geoff jeff", "george": "geo", "gerald": "gerry jerry", "giuseppe": "beppe peppe pino",
    "gregory": "greg", "harold": "harry", "henry": "harry hank", "ignacio": "nacho", "jacob": "jake", "james": "jim jimmy jas jamie", "jennifer": "jen jenny", "jessica": "jess",
    "johannes": "hans joh johan", "john": "jack johnny jno jon", "jonathan": "jon jonny", "joseph": "joe jos joey", "jose": "pepe", "katherine": "kate kathy kath kit katie", "kenneth": "ken",
    "lawrence": "larry", "leonard": "len lenny", "leonardo": "leo", "louis": "lou", "margaret": "maggie peggy meg margt marge greta", "maria": "mia", "martha": "marty", "matthew": "matt matth",
    "michael": "mike mick mickey michl", "nathaniel": "nat nate nathl", "nicholas": "nick nicky nichs", "oliver": "ollie", "pamela": "pam", "patricia": "pat trish patty tricia", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich richd ricky", "robert": "bob rob robt bobby bert", "roberta": "bobbie", "ronald": "ron",
    "rosalind": "roz ros", "samuel": "sam saml sammy", "sandra": "sandy", "sophia": "sophie", "stephen": "steve", "steven": "steve", "susan": "sue susie suzy", "theodore": "ted theo teddy",
    "theresa": "terry tess", "thomas": "tom thos tommy", "timothy": "tim", "ulrich": "uli ulli", "ursula": "uschi ulla", "victoria": "vicky vic tori", "vincent": "vince", "walter": "walt wally",
    "wilhelmina": "wilma mina", "william": "will bill wm willy billy", "zachary": "zach",
}
# Words that make a name a group's, and the words that go with them.
GROUP_WORDS = ("group", "network", "consortium", "institute", "committee", "society", "collaboration", "investigators", "association", "foundation", "centre", "team")
GROUP_COMPANIONS = ("collaborative", "research", "study", "trial", "working", "international", "national")

FORMAL: dict[str, frozenset[str]] = {}
for _formal, _shorts in SHORT_FORMS.items():
    for _short in [_formal, *_shorts.split()]:
        FORMAL[_short] = FORMAL.get(_short, frozenset()) | {_formal}

_BEHALF = re.compile(r"\(?\bon behalf of\b\)?|\bfor the\b", re.I)
_CAMEL = re.compile(r"(?<=[a-zà-ÿ]{2})(?=[A-ZÀ-Ý][a-zà-ÿ]{2})")
_ACRONYM = re.compile(r"[A-Z]{3,}[a-z]+$")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def fold(text: str) -> str:
    """Letters without accents, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))


def within_one(a: str, b: str) -> bool:
    """Equal but for one letter more, less or other, or two neighbours swapped."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


def _group_word(word: str) -> str:
    """The full form of an abbreviated or mistyped group word, else the word itself."""
    for full in GROUP_WORDS + GROUP_COMPANIONS:
        if word == full or (len(word) >= 5 and within_one(word, full)) or (len(word) >= 3 and full.startswith(word) and len(word) < len(full)):
            return full
    return {"grp": "group", "center": "centre", "intl": "international"}.get(word, word)


def parse(name: str) -> tuple[str, list[tuple[str, str]]] | None:
    """(kind, readings) of a written name; a reading is (family part, given parts joined by blanks).

    A group's given part is its words in alphabetical order, ``|`` and their initials in written order.
    kind is ``person``, ``group`` or ``bare`` (a family name only, with or without a particle: nobody in
    particular). Two readings are given where the order of given and family name is open. None for texts
    without letters and for spellings of a missing value.
    """
    text = _BEHALF.sub(" ", name)
    if fold(text).strip() in ("", "nan", "none", "null"):
        return None
    head, comma, tail = text.partition(",")
    spaced = _CAMEL.sub(" ", text)
    words = [w for w in (fold(w) for w in _LETTERS.findall(spaced)) if w not in ("the", "of", "and")]
    if not words:
        return None
    full = [_group_word(w) if len(w) >= 3 else w for w in words]
    if len(words) >= 3 and any(w in GROUP_WORDS for w in full):
        if comma:  # "Study Group Sleep, Somewhere" -> the proper name comes first
            k = len([w for w in (fold(w) for w in _LETTERS.findall(_CAMEL.sub(" ", tail))) if w not in ("the", "of", "and")])
            full = full[-k:] + full[:-k] if k else full
        # collaboration and collaborative are abbreviated alike
        rest = ["collaborative" if w == "collaboration" else w for w in full[1:]]
        return "group", [(full[0], " ".join(sorted(rest)) + "|" + " ".join(w[0] for w in rest))]
    if comma:
        family, given = _family(head), _given(tail, text.upper() == text)
        return ("person", [(family, given)]) if given else ("bare", [(family, "")])
    shouting = text.upper() == text
    tokens = [t for t in re.split(r"\s+", text.strip()) if _LETTERS.search(t)]
    kinds = []
    for t in tokens:
        bare = "".join(_LETTERS.findall(t))
        if fold(t) in PARTICLES:
            kinds.append("p")
        elif "." in t and all(len(x) == 1 or x.isupper() and len(x) <= 3 for x in _LETTERS.findall(t)) or _initials(bare, shouting) and (not shouting or t is not tokens[0]):
            kinds.append("i")
        else:
            kinds.append("f")
    fulls = [i for i, k in enumerate(kinds) if k == "f"]
    if not fulls:
        return None if not tokens else ("bare", [(fold("".join(_LETTERS.findall(tokens[0]))), "")])
    if len(fulls) == 1:
        given = [t for t, k in zip(tokens, kinds, strict=True) if k == "i"]
        family = _family(tokens[fulls[0]])
        return ("person", [(family, _given(" ".join(given), shouting))]) if given else ("bare", [(family, "")])

    def reading(at: int) -> tuple[str, str]:
        rest = [t for i, (t, k) in enumerate(zip(tokens, kinds, strict=True)) if i != at and k != "p"]
        return _family(tokens[at]), _given(" ".join(rest), shouting)

    first, last = fulls[0], fulls[-1]
    if kinds[0] == "p" or (kinds[-1] == "p"):
        return "person", [reading(first)]
    if kinds[last - 1] in "pi" or kinds[0] == "i":
        return "person", [reading(last)]
    return "person", [reading(last), reading(first)]


def _family(text: str) -> str:
    parts = [fold(w) for w in _LETTERS.findall(text)]
    kept = [w for w in parts if w not in PARTICLES] or parts
    return "".join(kept).replace("'", "").replace("’", "")


def _initials(letters: str, shouting: bool) -> bool:
    """Whether letters stand for given names (``JL``) or a group's words (``SACN``, ``SWCons``)."""
    if shouting:  # everything is in capitals, so short forms of three letters are read as words
        return len(letters) <= 2 or len(letters) == 3 and fold(letters) not in FORMAL
    return letters.isupper() and len(letters) <= 4 or len(letters) <= 7 and bool(_ACRONYM.match(letters))


def _given(text: str, shouting: bool = False) -> str:
    out = []
    for token in re.split(r"[\s.\-‐‑]+", _CAMEL.sub(" ", text)):
        letters = "".join(_LETTERS.findall(token))
        if not letters or fold(letters) in PARTICLES:
            continue
        if len(letters) == 1 or _initials(letters, shouting):
            out += list(fold("".join(c for c in letters if c.isupper()) or letters))
        else:
            out.append(fold(letters))
    return " ".join(out)


def _part(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        short, long = (a, b) if len(a) == 1 else (b, a)
        return 0.95 if len(long) > 1 and (long[0] == short or any(f[0] == short for f in FORMAL.get(long, ()))) else 0.0
    fa, fb = FORMAL.get(a, frozenset((a,))), FORMAL.get(b, frozenset((b,)))
    if fa & fb:
        return 0.98
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.9
    if min(len(a), len(b)) >= 4 and (within_one(a, b) or any(within_one(x, y) for x in fa for y in fb)):
        return 0.9
    return 0.0


def given_similarity(a: str, b: str) -> float:
    """Monge-Elkan mean over the shorter list of given parts: each part's best counterpart, no part used twice, none
    without one. Initials and left-out parts keep their order, for J P and P J are two people; full parts may come
    in another (Jean Paul, Paul Jean) where both names have the same number of them."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    scores = [_part(p, q) for p, q in zip(x, y, strict=False)]
    if min(scores) == 0.0 and len(x) == len(y) > 1 and min(map(len, x + y)) > 1:
        scores, left = [], list(y)
        for p in x:
            found = max(left, key=lambda q: _part(p, q))
            scores.append(_part(p, found))
            left.remove(found)
    if min(scores) == 0.0:
        return 0.0
    return sum(scores) / len(scores) - (0.02 if len(x) != len(y) else 0.0)


def given_letters(given: str) -> list[str]:
    """Letters of which two given parts that agree share one: the first of the first part, or of any full part where
    all are full, and of the formal names it may stand for; the second too where a typo may have touched the first."""
    parts = given.split()
    out: set[str] = set()
    for p in parts if parts and min(map(len, parts)) > 1 else parts[:1]:
        for form in {p} | FORMAL.get(p, frozenset()):
            out |= set(form[:2] if len(form) >= 4 else form[:1])
    return sorted(out)


def group_similarity(a: str, b: str) -> float:
    """Symmetric Monge-Elkan mean of the words besides the proper name; 0 where a word has no counterpart."""
    x, y = a.partition("|")[0].split(), b.partition("|")[0].split()
    if not x or not y:
        return 0.0

    def best(p: str, others: list[str]) -> float:
        return max(1.0 if p == q else 0.9 if len(p) >= 4 and within_one(p, q) else 0.0 for q in others)

    scores = [best(p, y) for p in x] + [best(q, x) for q in y]
    return 0.0 if min(scores) == 0.0 else sum(scores) / len(scores)
