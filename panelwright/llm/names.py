"""Names as people type them: look-alike letters, remarks, spellings, and the parts that matter."""

from __future__ import annotations

import re
import unicodedata

# fixed values: letters of other scripts and the Latin letters they look like
LOOKALIKES = str.maketrans(
    {
        "а": "a", "б": "b", "в": "b", "с": "c", "ԁ": "d", "е": "e", "н": "h", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
        "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ѡ": "w", "х": "x",
        "α": "a", "β": "b", "ε": "e", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "µ": "u", "μ": "u",
        "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ß": "ss",
    }
)
INVISIBLE = re.compile("[­​-‏⁠﻿‪-‮]")
DASHES = re.compile("[‐-―−﹣－]")

# fixed values: remarks that don't make another substance
SALTS = (
    "hydrochloride dihydrochloride hcl 2hcl hydrobromide hbr sulfate hemisulfate bisulfate phosphate diphosphate mesylate dimesylate tosylate ditosylate "
    "besylate maleate fumarate hemifumarate citrate tartrate succinate acetate lactate malate oxalate gluconate sodium disodium potassium calcium magnesium "
    "monohydrate dihydrate trihydrate hemihydrate sesquihydrate hydrate anhydrous"
).split()
REMARK = re.compile(
    r"(?<![a-z0-9])(?:" + "|".join(SALTS) + r"|free (?:base|acid)|(?:lot|batch) ?#?[0-9a-z]+|[0-9]+(?:[.,][0-9]+)? ?(?:nm|um|mm|m|ug/ml|mg/ml|mg|ug|ng|%)|stock|salt)(?![a-z0-9])"
)
LEADS = re.compile(r"^(?:(?:drug|cpd|cmpd|name|agent)\s*[:=#]?\s+|(?:drug|name)\s*[:=]\s*|\(\+/?-?\)-?|\(-\)-?|\((?:r|s|e|z|rac)\)-?|(?:rac|[abdl])-)")
CODE = re.compile(r"^([a-z]{2,4}(?:[- ]?m)?)[- ]*([0-9]{3,})(?:[- ]*([a-z]{1,3}|[0-9]{1,2}))?$")
NUMBER = re.compile(r"^(?:compound|cpd|cmpd)?[ #-]*([0-9]{4,})$")
CONTROL = re.compile(
    r"^(?:(?:dmso|pbs|vehicle|media|medium|control|ctrl|ctl|untreated|blank|mock|water|saline|solvent|empty|none|no drug|no treatment|neg|pos|positive|negative|unknown|tbd|n/?a|n\.a\.|nil|null|test)\b)"
)
DERIVED = ("des", "epi", "iso", "nor")  # fixed values: leading parts that make a derivative with its own name
JOINT = re.compile(r"\s*(?:\+|&|;|/|\band\b|\bplus\b)\s*")

# fixed values: words of a second language in diagnoses
GERMAN = {
    "biphasisch": "biphasic", "dedifferenziert": "dedifferentiated", "hochdifferenziert": "well-differentiated", "niedriggradig": "low-grade", "epitheloid": "epithelioid",
    "epithelioid": "epithelioid", "pleomorph": "pleomorphic", "konventionell": "conventional", "myxoid": "myxoid", "mesenchymal": "mesenchymal", "sklerosierend": "sclerosing",
    "spindelzellig": "spindle cell", "rundzellig": "round cell", "synovial": "synovial", "histiozytaer": "histiocytic", "histiozytar": "histiocytic",
}
DIAGNOSIS_LEADS = re.compile(r"^(?:[#?*\s-]+|(?:dx|diagnosis|subtype|type|hist|histology)\s*[:=]\s*|(?:prob|probably|probable|likely|poss|possible|susp|suspected|favou?r|c/w)\b[.:]?\s+)")
DIAGNOSIS_REMARK = re.compile(
    r"\bnos\b|\bg ?[1-4]\b|\bgrade ?[1-4i]+\b|\bs/p\b.*$|\s-\s.*\bopinion\b.*$|\bp?t[0-4]n[0-2x]m?[0-1x]?\b|\b(?:recurrent|primary|metastatic|relapsed?|recurrence|confirmed|resected|biopsy|type)\b|[?!]"
)


def plain(s: str) -> str:
    """Lower case, compatible forms, look-alikes and accents resolved, single spaces."""
    s = unicodedata.normalize("NFKC", INVISIBLE.sub("", s)).lower()
    s = DASHES.sub("-", s).translate(LOOKALIKES)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(s.replace("_", " ").split())


def letters(s: str) -> str:
    """Only letters, digits inside words read as the letters they look like."""
    return re.sub("[^a-z]", "", s.replace("0", "o").replace("1", "l"))


def spoken(s: str) -> str:
    """Letters that stand for the same sound brought to one."""
    s = letters(s)
    for a, b in (("qu", "kw"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("x", "ks"), ("c", "k"), ("q", "k"), ("z", "s"), ("y", "i")):
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


def code_of(s: str) -> str | None:
    """A laboratory code as letters-digits-suffix, if ``s`` (plain) is one."""
    if m := NUMBER.match(s):
        return f"-{m[1]}-"
    if m := CODE.match(s):
        return f"{re.sub('[^a-z]', '', m[1])}-{m[2]}-{m[3] or ''}"
    return None


def substance(value: str) -> dict:
    """What a typed drug name says: kind ('code', 'name', 'mixture' or 'nothing'), codes, and letters of the name."""
    s = plain(value)
    out = {"kind": "nothing", "codes": [], "name": ""}
    if CONTROL.match(s) or not re.search("[a-z0-9]{3}", s):
        return out
    parts = [p for p in JOINT.split(REMARK.sub(" ", s)) if code_of(p.strip(" ()")) or len(letters(p)) >= 6]
    if len(parts) > 1:
        return out | {"kind": "mixture"}
    while (t := LEADS.sub("", s)) != s:
        s = t
    for inner in re.findall(r"\(([^()]*)\)", s):
        if c := code_of(REMARK.sub("", inner).strip()):
            out["codes"].append(c)
        if c or REMARK.search(inner):
            s = s.replace(f"({inner})", " ")
    s = " ".join(REMARK.sub(" ", s).split()).strip(" ,;:.()[]")
    if c := code_of(s):
        return out | {"kind": "code", "codes": [*out["codes"], c]}
    name = letters(s)
    if len(name) < 6:
        return out | {"kind": "code" if out["codes"] else "nothing"}
    return out | {"kind": "name", "name": name}


def underived(name: str) -> str | None:
    """The rest of a name after a leading part that makes a derivative."""
    return next((name[len(p) :] for p in DERIVED if name.startswith(p) and len(name) - len(p) >= 6), None)


def diagnosis_forms(value: str, words: set[str], longest: int) -> list[str]:
    """The orders in which the words of a typed diagnosis may be read, joined; abbreviations opened by ``words`` (their letters).

    A text longer than any entry of the list (``longest`` letters) by more than slips allow can mean none, so it has one order.
    """
    s = plain(value)
    while (t := DIAGNOSIS_LEADS.sub("", s)) != s:
        s = t
    s = re.sub(r"\(([^()]*)\)", lambda m: " " if DIAGNOSIS_REMARK.search(m[1]) else f" {m[1]} ", s)
    s = DIAGNOSIS_REMARK.sub(" ", s)
    tokens = []
    for t in re.split(r"[\s,/;:]+", s):
        bare = re.sub(r"[^a-z.-]", "", t.replace("0", "o").replace("1", "l")).strip("-")
        if not letters(bare):
            continue
        if bare.endswith("."):
            stem = letters(bare)
            full = [w for w in words if w.startswith(stem)] if len(stem) >= 3 else []
            tail = next((stem[: -len(a)] + "sarcoma" for a in ("sarc", "sa") if stem.endswith(a)), None)
            bare = tail if tail and (tail == "sarcoma" or tail in words) else full[0] if len(full) == 1 else stem
        stem = re.sub("(?:es|er|en)$", "", letters(bare))
        if letters(bare) not in words and stem in GERMAN and stem != letters(bare):
            bare = GERMAN[stem]
        bare = re.sub("sarkom(?:a|e)?$", "sarcoma", bare)
        tokens.append(letters(bare))
    orders = len(tokens) if sum(map(len, tokens)) <= longest + 3 else min(len(tokens), 1)
    return list(dict.fromkeys(t for t in ("".join(tokens[i:] + tokens[:i]) for i in range(orders)) if t))


def edits(a: str, b: str) -> int:
    """Levenshtein's distance, bit-parallel over the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(d | up) & mask, up & d
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & mask, (minus << 1) & mask
        up, down = minus | ~(x | plus) & mask, plus & x
    return score


def slips(a: str, b: str) -> int:
    """Edits where two neighbours that changed places count once, bit-parallel over the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, d, before = mask, 0, len(a), 0, 0
    for c in b:
        eq = where.get(c, 0)
        swapped = ((~d & eq) << 1) & before
        d = ((((eq & up) + up) ^ up) | eq | down | swapped) & mask
        plus, minus = down | ~(d | up) & mask, up & d
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & mask, (minus << 1) & mask
        up, down, before = minus | ~(d | plus) & mask, plus & d, eq
    return score


class BKTree:
    """Entries under Levenshtein's metric; a search prunes by the triangle inequality and returns all within the radius."""

    def __init__(self, entries: list[str]):
        self.root: list | None = None
        for e in entries:
            self.add(e)

    def add(self, entry: str) -> None:
        if self.root is None:
            self.root = [entry, {}]
            return
        node = self.root
        while (d := edits(entry, node[0])) and d in node[1]:
            node = node[1][d]
        if d:
            node[1][d] = [entry, {}]

    def within(self, query: str, radius: int) -> list[tuple[int, str]]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            entry, below = stack.pop()
            d = edits(query, entry)
            if d <= radius:
                found.append((d, entry))
            stack += [x for at, x in below.items() if d - radius <= at <= d + radius]
        return found
