"""Personal data in free text: found by anchors, bounded by local parsers, replaced by typed placeholders.

One Aho-Corasick automaton runs over the lower-cased text. Its words are at-signs and their spellings, schemes, cues of
identifiers and telephones, number joints (a digit, a mark, a digit), spelled-out digits, street words and state codes,
given names, and words that stand before or after persons. Only at such an anchor a deterministic parser looks: it expands
to the value's boundaries and validates its form. Strong cues (titles, roles, ``signed by``) vouch for a name of one
word; after or before weak ones (prepositions, verbs) a name has two words or more, none of them an ordinary one.

Where finds overlap, the order is e-mail, address, identifier, telephone, name; within one kind the longer one stays.
Null gives no find and stays null; empty text gives none. Whole texts are read, whatever their length. The placeholder
is the kind in square brackets; all other characters stay unchanged. Equal texts of a batch are parsed once.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("EMAIL", "ADDRESS", "ID", "PHONE", "NAME")

# --- e-mail ---------------------------------------------------------------------------------------------------------
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
_LOCAL = re.compile(rf"[^\W_][\w+%'’-]*(?:{_DOT}[\w+%-]+)*$")
_DOMAIN = re.compile(rf"[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*?{_DOT}[^\W\d_]{{2,}}(?!\w)(?:{_DOT}[^\W\d_]{{2,}}(?!\w))*")
_AT_RE = re.compile(_AT, re.I)


def _email(text: str, at: int) -> tuple[int, int] | None:
    """The address around an at-sign (or its spelling) near position ``at``."""
    m = _AT_RE.search(text, max(0, at - 1), at + 8)
    if m is None or m.start() > at + 1:
        return None
    domain = _DOMAIN.match(text, m.end(), m.end() + 120)
    local = _LOCAL.search(text[max(0, m.start() - 90) : m.start()])
    if domain is None or local is None:
        return None
    spelled = "at" in m.group().lower() and m.group().isspace() is False and m.group().strip().lower() == "at"
    if spelled and " dot " not in domain.group().lower():
        return None
    return m.start() - len(local.group()), domain.end()


# --- identifiers ----------------------------------------------------------------------------------------------------
#: Forms that tell an identifier by themselves.
_SHAPES = re.compile(
    r"(?:(?P<plan>[A-Z]{3}-?\d{4}-?\d{4}-?\d{2}|[A-Z]{3}\d{8,9}(?:-\d)?|[A-Z]{3}-\d{9}-\d)"
    r"|(?P<licence>[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]\d{11})"
    r"|(?P<social>\d{3}(?:-\d{2}-|\s\d{2}\s)\d{4}))(?![\w-]*\w)"
)
#: What a cue may vouch for: up to three letters and five digits or more, hyphens between.
_CUED = re.compile(r"(?:[A-Z]{3}-?\d{4}-?\d{4}-?\d{2}|\d{3}\s\d{2}\s\d{4}|[A-Z]{0,3}-?\d(?:-?\d){4,11}[A-Z]?)(?![\w-]*\w)")
_LIKE_A_PHONE = re.compile(r"(?:1-)?\d{3}-\d{3}-\d{4}|\d{3}-\d{4}")
_FILLER = re.compile(r"[\s.:#=,()-]{0,6}(?:(?:is|no|nr|num|number|numbers|id|reads|card|holder|mrn|the|for|with|as|and|licence|license|medical|record|shows|security|confirmed)\b[\s.:#=,()-]{0,6}){0,4}", re.I)
#: Words before a number that make it an identifier of a person.
ID_CUES = (
    "ssn", "ss", "social", "soc. sec.", "soc sec", "social security", "mrn", "med rec", "medical record", "hospital number", "hospital no",
    "chart", "member", "subscriber", "insured under", "coverage card", "policy holder", "licence", "license", "dl", "photo id", "passport", "ppt", "travel document",
    "patient id", "patient no", "insurance", "identity", "driver", "driver's", "id card", "mbi", "medicare", "medicaid", "tax id", "itin", "form",
)
#: Words that make it a number of something else.
NOT_ID = ("order", "serial", "claim", "lot", "batch", "ndc", "job", "ref", "invoice", "specimen", "score sheet", "device", "code", "account", "npi", "accession", "case", "sheet")
_OTHER_BEFORE = re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, NOT_ID)) + r")\b[\s.:#=,()-]*(?:(?:no|nr|number|id|serial|is)\b[\s.:#=,()-]*)*$", re.I)


def _other(text: str, at: int) -> bool:
    """Whether the words before make it a number of something else."""
    return _OTHER_BEFORE.search(text[max(0, at - 40) : at]) is not None


def _identifier_by_form(text: str, at: int) -> tuple[int, int] | None:
    """The identifier around a number joint: its form tells it."""
    start = at
    while start > 0 and at - start < 16 and (text[start - 1].isalnum() or text[start - 1] in "-"):
        start -= 1
    m = _SHAPES.match(text, start)
    if m is None and text[at : at + 1].isdigit():  # a social security number with blanks
        m = _SHAPES.match(text, max(start - 4, 0)) if start >= 4 and text[start - 1].isspace() else None
    if m is None or m.end() <= at or _other(text, m.start()) or m.start() > 0 and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "-"):
        return None
    if m.lastgroup == "plan" and m.group().count("-") < 2:
        return None
    return m.span()


def _identifier_by_cue(text: str, end: int, cue: str) -> tuple[int, int] | None:
    """The identifier after a cue that ends at ``end``, with nothing but fillers between."""
    m = _FILLER.match(text, end)
    found = _CUED.match(text, m.end())
    if found is None or m.end() == end or _other(text, m.end()) or _LIKE_A_PHONE.fullmatch(found.group()):
        return None
    digits = sum(c.isdigit() for c in found.group())
    if digits < (6 if cue not in ("form", "identity", "insurance", "chart", "social", "driver") else 8):
        return None
    return found.span()


# --- telephone ------------------------------------------------------------------------------------------------------
_DIGIT = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
_PHONE = re.compile(
    r"(?:"
    r"(?P<full>(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4})"
    r"|(?P<slash>\d{3}\s?/\s?\d{3}\s?\d{2}\s?\d{2})"
    r"|(?P<abroad>\+\d{1,3}(?:[\s.-]?\(?\d{1,5}\)?){2,5})"
    r"|(?P<run>1?\d{10})"
    r"|(?P<local>\d{3}[-.]\d{4}))"
    r"(?P<ext>,?\s?(?:x|ext\.?|extension)\s?\d{1,6})?(?![\w/]|[-.]\d)",
    re.I,
)
_SPOKEN = re.compile(rf"(?:{_DIGIT})(?:[\s,-]+(?:{_DIGIT})){{6,10}}\b", re.I)
#: Words before a telephone number.
PHONE_CUES = "phone telephone tel ph cell mobile call fax home work message ring reach under number dial text contact pager whatsapp office landline sms back".split()
_PHONE_CUE = re.compile(r"(?:\b(?:" + "|".join(PHONE_CUES) + r")\b|☎)[\w\s.:#,/()-]{0,24}$", re.I)
_RINGS = re.compile(r"\s*(?:rings|is the number|\((?:cell|home|work|mobile|mother|father|son|daughter|spouse|wife|husband|brother|sister)\))", re.I)
_RUN = re.compile(r"[\s.:#,/()-]{0,4}(?:(?:at|on|is|no|number|changed|to|the|me|us|him|her|them|line|or)\b[\s.:#,/()-]{0,3}){0,4}")


def _telephone(text: str, start: int) -> tuple[int, int] | None:
    before = text[max(0, start - 2) : start]
    if text[max(0, start - 7) : start].lower().endswith(("tel:", "callto:", "sms:")):
        before = ""
    if before and (before[-1].isalnum() or before[-1] in "_$#.-" or len(before) == 2 and before[0] in "-/" and before[1].isspace()):
        return None
    m = _PHONE.match(text, start)
    if m is None or _other(text, start):
        return None
    kind = next(k for k in ("full", "slash", "abroad", "run", "local") if m.group(k))
    if kind not in ("full", "slash", "abroad") and _PHONE_CUE.search(text[max(0, start - 40) : start]) is None and _RINGS.match(text, m.end()) is None:
        return None
    return m.span()


_BARE = re.compile(r"(?<![\w.-])(?:1?\d{10}|\d{3}[-.]\d{4})$")
#: What stands after a telephone number.
PHONE_TAILS = (" rings", " is the number", " (cell)", " (home)", " (work)", " (mobile)", " (mother)", " (father)", " (son)", " (daughter)", " (spouse)", " (wife)", " (husband)", " (brother)", " (sister)")


def _telephone_before(text: str, at: int) -> tuple[int, int] | None:
    m = _BARE.search(text[max(0, at - 16) : at])
    return None if m is None else _telephone(text, at - len(m.group()))


def _telephone_around(text: str, at: int) -> tuple[int, int] | None:
    """The telephone number around a number joint: from the earliest start that makes one."""
    start = at
    while start > 0 and at - start < 14 and (text[start - 1].isdigit() or text[start - 1] in "+(). -/" and at - start < 13):
        start -= 1
    while start <= at:
        if text[start].isdigit() or text[start] in "+(":
            found = _telephone(text, start)
            if found is not None and found[1] > at:
                return found
        start += 1
    return None


# --- address --------------------------------------------------------------------------------------------------------
#: Codes of states that stand before a postal code.
_STATES = (
    "al ak az ar ca co ct de dc fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa pr ri sc sd tn tx ut vt va wa wv wi wy".replace(" ", "|")
)
_POSTAL = re.compile(rf"(?<!\w)(?:(?:{_STATES}),?\s+\d{{5}}(?:-\d{{4}})?|[a-z]{{1,2}}\d{{1,2}}[a-z]?\s\d[a-z]{{2}}|(?:nsw|vic|qld|sa|wa|tas|nt|act)\s+\d{{4}}|\d{{6}})$", re.I)
#: What a postal code ends with.
_POSTAL_END = re.compile(r"\d(?:\d{3,5}(?:-\d{4})?|[A-Za-z]{2})(?!\w)")
_STREET = (
    "street st avenue ave road rd lane ln drive dr court ct boulevard blvd way close place pl square sq terrace ter parade pde crescent cres highway hwy "
    "row gardens grove mews circle cir trail parkway pkwy marg nagar salai"
).split()
_ADDRESS = re.compile(
    r"(?:P\.?\s?O\.?\s?Box\s\d+|(?:Flat\s\w+,\s)?\d{1,5}[A-Za-z]?(?:[-/]\d+)?\s+(?:[^\W\d_][\w'’-]*\s+){1,4}?(?:" + "|".join(_STREET) + r")\b\.?)"
    r"(?:,?\s+(?:(?:apt|apartment|suite|ste|unit|flat|room|floor|fl|#)\.?\s?#?\s?[\w-]+|#\s?\w+),?)?"
    r"(?:[,\s]+[^\W\d_][\w'’-]*){1,4}[,\s]+$",
    re.I,
)
#: Without a street word: number, one to three words, town, and a state code with its postal code.
_PLAIN_ADDRESS = re.compile(r"\d{1,5}[A-Za-z]?\s+(?:[^\W\d_][\w'’-]*\.?\s){0,2}[^\W\d_][\w'’-]*,(?:\s(?:apt|suite|ste|unit|floor|#)\.?\s?[\w-]+,)?(?:\s[^\W\d_][\w'’-]*){1,3},\s$", re.I)
_HOUSE = re.compile(r"(?<!\w)(?:\d{1,5}[A-Za-z]?(?:[-/]\d+)?\s|P\.?\s?O\.?\s?Box|Flat\s)", re.I)
_TO_POSTAL = re.compile(r"[A-Za-z]{2},?\s+\d{5}(?:-\d{4})?(?!\w)")


def _address(text: str, end: re.Match) -> tuple[int, int] | None:
    """From the nearest house number or box before a postal code that begins an address up to that code."""
    if not text[end.start() - 1 : end.start()].isspace():
        return None
    m = _POSTAL.search(text, max(0, end.start() - 8), end.end())
    return None if m is None else _address_before(text, m.start(), m.end())


def _address_before(text: str, code: int, end: int) -> tuple[int, int] | None:
    low = max(0, code - 110)
    before = text[low:code]
    for h in reversed(list(_HOUSE.finditer(before))):
        if _ADDRESS.match(before, h.start()) or _PLAIN_ADDRESS.match(before, h.start()) and text[code : code + 2].isupper():
            return low + h.start(), end
    return None


def _address_by_state(text: str, at: int) -> tuple[int, int] | None:
    m = _TO_POSTAL.match(text, at)
    return None if m is None else _address_before(text, at, m.end())


def _address_by_street(text: str, end: int) -> tuple[int, int] | None:
    """From a street word on to the first postal code that closes an address."""
    for m in _POSTAL_END.finditer(text, end, min(len(text), end + 110)):
        found = _address(text, m)
        if found is not None:
            return found if found[0] < end else None
    return None


# --- names ----------------------------------------------------------------------------------------------------------
#: Given names and short forms that anchor a name by themselves.
GIVEN = frozenset(
    """alejandro alex alexandra alexander amara anthony antonia arjun augustin bart bartholomew beatrix bea becca becky ben benjamin beth cass cassandra
    cassie charles charlie chris christopher chuck connie constance cornelius corny edward eliza elizabeth elke emeka fran francesca frank fred frederick fritz
    gabi gabriela goran greg gregory gus henrietta hetty hiro inés ines isadora izzy jackie jacqueline jo jon jonathan josé jose josephine josie jürgen jurgen kat kate
    katharina kathy kwame larry lawrence leo leopold liz ludmila maggie maren margaret mari maribel marla matt matthias max maximilian meg mila mina nate
    nathaniel ned neil noor osvaldo ozzie pat patricia phil philip philippa pippa priya ray raymond rebecca reggie reginald renée renee rich richard rick rob robert bob
    ronnie solveig stephen steve sue susannah susie søren soren tariq ted terrence terry thandi theo theodora tim timothy toni tony trish veronica vicky victoria
    wilhelmina will bill william yuki zoë zoe""".split()
)
#: Given names that are also ordinary words; these need a cue or a surname.
_WEAK_GIVEN = frozenset("will bill rich max pat mari toni jo ray sue gus mina rob".split())
_PARTICLES = frozenset("van von der den de la del di da le".split())
_TITLES = frozenset("dr mr mrs ms mx miss prof nurse sir".split())
_DEGREES = frozenset("md do rn np pa phd dds lpn esq pllc llc inc".split())
#: Ordinary words that begin sentences or follow names in notes; no part of a name.
_STOP = frozenset(
    """a about above account accompanied according add adjustment after agrees all allergy also an and appeal are arrived as asked assessment at atrial attending avoid babinski balance batch because began
    bedside blood board blurred call called calcium came can cell charge chart checkout claim clinic code coder coinsurance collected comment consent consult contact copy counselled coverage dated daughter declined denies deposit device
    dictated dictation diet discharged discussed dispensed dizziness driver drinks e exam family father ferritin follow for form from goal guarantor had has have he heart her his history holds home hospital hours household i
    identified identity if imaging in indication informed inr insured interview invoice is it lactate last ldl left line lives lot mailing medical member mobile mother moved mrn msg my name ndc new next night no
    nobody not notes number nurse of office on or order our out oxygen pain passport patient payment pharmacist photo physical picked plan platelet please policy portal potassium prescription previous prior provider pt pulse quality questions
    re reach receipt ref referred refund released repeat reports resides results result returned revenue reviewed same sample saw score secondary see seen send sent serum she shortness since sleep smoker sodium son specimen spoke ssn started statement
    still stop subscriber substitute surgery swelling take taper tel that the their then they this tingling told to transferred travel trend troponin tsh uric units urinalysis vaccines vitamin walks was we weight were will with witnessed wound you your
    north south east west health exchange mutual assist care center partners practice coding day community unit ward""".split()
)
_ORG = frozenset("health exchange mutual assist plan clinic hospital center centre partners surgery office pharmacy laboratory department group insurance".split())
_EPONYM = re.compile(r"[ \t]+(?:disease|lymphoma|palsy|sign|phenomenon|catheter|monitor|syndrome)\b", re.I)
#: Titles, roles, relations and phrases before a person; they vouch for one word.
PERSON_CUES = (
    "dr", "dr.", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "mx", "mx.", "miss", "prof", "prof.", "nurse", "patient", "patient:", "patient name", "name:", "pt", "client", "coder", "attending", "provider:", "physician:",
    "surgeon", "therapist", "guarantor is", "guarantor", "insured:", "witness:", "contact:", "attn:", "dear", "re:", "cc:", "/s/", "signed by", "signed:", "form signed", "seen by", "spoke with", "spoke w/", "spoke to", "interview with",
    "accompanied by", "referred by", "discussed with", "dictated for", "dictated by", "according to", "in the name of", "labelled", "letter to", "report to", "call from", "msg from", "message from", "handed to", "visit by", "told",
    "next of kin:", "next of kin -", "next of kin", "chart reads", "name on the card:", "i saw", "returned (", "arranged for", "named", "neighbor,", "brother,", "sister,", "mother,", "father,", "son", "daughter", "husband", "wife", "spouse", "see",
)
#: Words before many things; a person's name has two words there.
WEAK_CUES = " by | with | for | to | from | and | saw | met | asked | called | contact | contacted | thanks ".split("|")
#: What stands after a person and vouches for one word.
PERSON_TAILS = (
    "'s results", "’s results", ", your results", " asked", " will call", " called", " was not seen", " reports", " reported", " in clinic.", " declined", " household", " was seen", " rang", " phoned", " says", " said",
    " states", " stated", " signed", " md, signed", ", md, signed", " rn, verified", ", rn, verified", ", do, signed", " denies", " complains", " agrees", " came in",
)
#: Verbs after many things; a person's name has two words there.
WEAK_TAILS = (" visited", " was ", " is ", " has ", " had ", " came", " went", " will ", " wants", " needs", " takes", " lives", " arrived", " left", " presented", " underwent", " received", " tolerated", ", md", ", do,", ", rn", ", np", ", pa")
_TOKEN = re.compile(r"[^\W\d_]+(?:(?:['’](?!s\b)|-)[^\W\d_]+)*", re.I)
_GAP = re.compile(r"[ \t]{1,3}")


def _style(word: str) -> str:
    return "upper" if len(word) > 1 and word.isupper() else "lower" if word[0].islower() else "title"


def _parse_name(text: str, at: int, single: bool) -> tuple[int, int] | None:
    """A name that begins at ``at``. ``single``: one word may be enough (a cue vouches for it)."""
    start, words, i, style, inverted, first_given, end = None, 0, at, None, False, False, None
    while words < 2 or inverted:
        m = _TOKEN.match(text, i)
        if m is None:
            break
        w, low, nxt = m.group(), m.group().lower(), text[m.end() : m.end() + 1]
        if nxt and (nxt in "@_+/=" or nxt.isdigit()):
            break
        if low.rstrip(".") in _TITLES and start is None and words == 0:
            i = m.end() + (nxt == ".")
            gap = _GAP.match(text, i)
            if gap is None:
                break
            i, single = gap.end(), True
            continue
        if len(w) == 1 and (w.isupper() or nxt == ".") and (start is not None or nxt == "."):
            # an initial; its full stop belongs to it, except at the end of a sentence after a whole name
            if inverted and words >= 2 and any(c for c in text[i - 1 : i] if c == ","):
                break
            start = m.start() if start is None else start
            i = m.end() + (nxt == "." and (words < 2 or inverted))
            end = i
            if inverted and words >= 1:
                words = max(words, 2)
        elif low in _DEGREES and start is not None and w.isupper():
            break
        elif low in _PARTICLES and words < 2:
            start = m.start() if start is None else start
            i = m.end()
        else:
            own = _style(w)
            given = low in GIVEN
            if low in _STOP and not (given and start is None and own != "lower") or len(w) < 2:
                break
            if own == "lower" and not (given and low not in _WEAK_GIVEN or style == "lower" and first_given and len(w) > 3 or single and style is None and given):
                break
            if style == "upper" and own != "upper" or style in ("title", "lower") and own == "upper" and len(w) > 2:
                break
            if style == "title" and own == "lower":
                break
            if inverted and words >= 2:
                break
            start = m.start() if start is None else start
            style, first_given = style or own, first_given or (given and words == 0)
            words += 1
            i = end = m.end()
        # what follows: a comma turns surname and given name round
        if words == 1 and not inverted and not first_given and text[i : i + 1] == ",":
            follow = _TOKEN.match(text, i + 2) if text[i + 1 : i + 2] == " " else None
            if follow and (follow.group().lower() in GIVEN and _style(follow.group()) in (style, "title") or len(follow.group()) == 1 and follow.group().isupper() and text[follow.end() : follow.end() + 1] in (".", "", " ", ")", ";", ",", "\n") or style == "upper" and _style(follow.group()) == "upper" and follow.group().lower() not in _STOP | _DEGREES):
                inverted, i = True, i + 2
                continue
        gap = _GAP.match(text, i)
        if gap is None:
            break
        i = gap.end()
        if inverted and words >= 2:
            # trailing initials of an inverted name
            tail = re.compile(r"[^\W\d_](?:\.(?!\w)|(?=[\s,;)]|$))").match(text, i)
            if tail is None or (tail.group().endswith(".") is False and not tail.group().isupper()):
                break
            dotted = tail.group().endswith(".") and (re.match(r"\s+[a-z(]|[,;)]", text[tail.end() : tail.end() + 3]) is not None)
            end = tail.end() if dotted or not tail.group().endswith(".") else tail.end() - 1
            break
    if start is None or end is None or not words or (words < 2 and not single and not (style and end - start > 2 and re.match(r"[A-Z]\.\s", text[start : start + 3]))):
        return None
    if words == 1 and end - start <= 3 and text[start:end].isupper():
        return None
    after = _TOKEN.match(text, end + 1) if text[end : end + 1] == " " else None
    if after and (after.group().lower() in _ORG and after.group()[0].isupper() and text[after.end() : after.end() + 1] != ":") or _EPONYM.match(text, end):
        return None
    if any(_plain(t) in _ORG for t in _TOKEN.findall(text[start:end])):
        return None
    return start, end


def _plain(word: str) -> str:
    """A word as it is looked up: in lower case without accents."""
    return word.lower() if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


_NEXT = re.compile(r" (?=([A-Z][\w'’-]*))")


def _alone(text: str, found: tuple[int, int] | None) -> tuple[int, int] | None:
    """A name found by weak evidence, with a third part; nothing where it is the beginning of a longer proper noun."""
    if found is None or text[found[0] - 1 : found[0]].isalnum() or _ORG & {_plain(t) for t in _TOKEN.findall(text[max(0, found[0] - 24) : found[0]])[-1:] + _TOKEN.findall(text, *found)}:
        return None
    more, at = [], found[1]
    while (m := _NEXT.match(text, at)) is not None:
        more.append(m.group(1))
        at += 1 + len(m.group(1))
    if len(more) > 1 or any(_plain(w) in _ORG | _STOP or _plain(w) in _STREET for w in more):
        return None
    return found[0], at


def _name_before(text: str, at: int) -> tuple[int, int] | None:
    """The longest name that ends exactly at ``at``."""
    low = max(0, at - 70)
    for m in _TOKEN.finditer(text[low:at]):
        if low + m.start() > 0 and text[low + m.start() - 1] in "@_+.-'’/":
            continue
        found = _parse_name(text, low + m.start(), True)
        if found and found[1] == at:
            return found
    return None


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    entries: dict[str, set[str]] = {}
    joints = [f"{x}{m}{y}" for x in "0123456789" for m in ("-", ".", " ", ") ", "/", " / ", ")") for y in "0123456789"]
    for kind, words in (
        ("email", ("@", "[at]", "(at)", "{at}", "<at>", " at ")),
        ("scheme", ("tel:", "callto:", "sms:")),
        ("id", ID_CUES),
        ("phone", PHONE_CUES),
        ("phone tail", PHONE_TAILS),
        ("joint", joints),
        ("abroad", [f"+{d}" for d in "123456789"]),
        ("spoken", _DIGIT.split("|")),
        ("state", [f"{c}{s}{e}" for s in _STATES.split("|") for c in " \n" for e in (" ", ", ")]),
        ("street", (*_STREET, "box")),
        ("person", PERSON_CUES),
        ("weak", WEAK_CUES),
        ("tail", PERSON_TAILS),
        ("weak tail", WEAK_TAILS),
        ("given", GIVEN),
    ):
        for w in words:
            entries.setdefault(w, set()).add(kind)
    for w, kinds in entries.items():
        a.add_word(w, (len(w), w, tuple(sorted(kinds))))
    a.make_automaton()
    return a


#: Hyphens, dashes and blanks that stand for the plain ones.
_PLAIN = {**{c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)}, **{c: " " for c in (0xA0, 0x2007, 0x2009, 0x202F)}}


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _capital_before(text: str, at: int) -> bool:
    """Whether the word that ends at ``at`` begins with a capital, and so does the one before it."""
    i = at
    for _ in range(2):
        j = i
        while j > 0 and at - j < 80 and (text[j - 1].isalpha() or text[j - 1] in "'’.-"):
            j -= 1
        if j == i or not text[j : j + 1].isupper():
            return False
        i = j
        while i > 0 and text[i - 1] in " ,\t":
            i -= 1
    return True


def _without_overlaps(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """By kind, then the longer one; a span stays if none before it overlaps. Kept spans lie sorted beside each other."""
    spans = sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1] - s[2], s[1]))
    starts: list[int] = []
    kept: dict[int, tuple[str, int, int]] = {}
    for kind, a, b in spans:
        k = bisect.bisect_left(starts, a)
        if (k == len(starts) or starts[k] >= b) and (k == 0 or kept[starts[k - 1]][2] <= a):
            starts.insert(k, a)
            kept[a] = (kind, a, b)
    return [kept[a] for a in starts]


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, in order, without overlaps."""
    spans: list[tuple[str, int, int]] = []
    if not text.isascii():
        text = text.translate(_PLAIN)
    low = _lower(text)
    until = {"EMAIL": -1, "PHONE": -1, "ID": -1, "ADDRESS": -1}

    def add(kind: str, found: tuple[int, int] | None) -> None:
        if found is not None:
            spans.append((kind, *found))
            if kind in until:
                until[kind] = found[1]

    for last, (size, word, kinds) in _automaton().iter(low):
        first, end = last - size + 1, last + 1
        before, after = low[first - 1 : first], low[end : end + 1]
        inside = before.isalnum() and word[0].isalnum() or after.isalnum() and word[-1].isalnum()
        for kind in kinds:
            if kind == "joint":
                at = end - 1
                if at >= until["PHONE"]:
                    add("PHONE", _telephone_around(text, at))
                if at >= until["ID"] and word[1] in "- ":
                    add("ID", _identifier_by_form(text, at))
            elif kind == "email":
                if first >= until["EMAIL"] and (word != " at " or " dot " in low[end : end + 60]):
                    add("EMAIL", _email(text, first))
            elif kind == "weak":
                if text[end : end + 1].isupper():
                    add("NAME", _alone(text, _parse_name(text, end, False)))
            elif kind == "weak tail":
                if (before.isalpha() or before == ".") and _capital_before(text, first):
                    found = _name_before(text, first)
                    if found and len(_TOKEN.findall(text, *found)) > 1:
                        add("NAME", _alone(text, found))
            elif kind == "tail":
                if not (after.isalnum() and word[-1].isalnum()):
                    found = _name_before(text, first)
                    if found and not (text[found[0]].islower() and low[found[0] : found[1]] in _WEAK_GIVEN):
                        add("NAME", found)
            elif kind == "phone tail":
                if before.isdigit() and first > until["PHONE"]:
                    add("PHONE", _telephone_before(text, first))
            elif kind == "state":
                if after.isdigit() and first >= until["ADDRESS"]:
                    add("ADDRESS", _address_by_state(text, first + 1))
            elif inside:
                continue
            elif kind == "street":
                if first >= until["ADDRESS"]:
                    add("ADDRESS", _address_by_street(text, end))
            elif kind == "id":
                if end >= until["ID"]:
                    add("ID", _identifier_by_cue(text, end, word))
            elif kind in ("phone", "scheme"):
                m = _RUN.match(low, end)
                if m.end() >= until["PHONE"] and (text[m.end() : m.end() + 1].isdigit() or text[m.end() : m.end() + 1] in ("+", "(")):
                    add("PHONE", _telephone(text, m.end()))
            elif kind == "abroad":
                if first >= until["PHONE"]:
                    add("PHONE", _telephone(text, first))
            elif kind == "spoken":
                if first >= until["PHONE"]:
                    m = _SPOKEN.match(text, first)
                    add("PHONE", m and m.span())
            elif kind == "person":
                i = end
                while i < len(text) and text[i] in " \t:." and i - end < 3:
                    i += 1
                if i < len(text) and (i > end or word[-1] in "(/"):
                    found = _parse_name(text, i, True)
                    # in lower case only a given name begins a name
                    if found and text[found[0]].islower() and text[found[0] : found[1]].split()[0].lower() not in GIVEN | _PARTICLES:
                        found = None
                    add("NAME", found)
            elif before not in ("@", "_", "+", ".", "-", "'", "’", "/") and after not in ("@", "_", "+"):
                if text[first].isupper() or word not in _WEAK_GIVEN and len(word) > 3:
                    inverted = re.search(r"(?<![\w@.'’-])([^\W\d_]+(?:['’-][^\W\d_]+)*), $", text[max(0, first - 40) : first])
                    begin = first
                    if inverted and text[first].isupper() and inverted.group(1)[0].isupper() and inverted.group(1).lower() not in _STOP | GIVEN:
                        begin = first - len(inverted.group())
                    found = _parse_name(text, begin, begin != first)
                    if found and found[1] > end - 1:
                        add("NAME", found)
    return _without_overlaps(spans)


_FINDS = "array<struct<kind:string,start:int,end:int,text:string>>"


def find_column(text: Column) -> Column:
    """Array of finds (kind, start, end, text) of a text column."""

    @F.pandas_udf(_FINDS)
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list] = {}
        out = []
        for t in texts:
            if not t:
                out.append([])
                continue
            if t not in known:
                known[t] = [{"kind": k, "start": a, "end": b, "text": t[a:b]} for k, a, b in find(t)]
            out.append(known[t])
        return pd.Series(out)

    return run(text)


def personal_data(records: DataFrame, id_column: str = "id", text_column: str = "raw_text") -> DataFrame:
    """record_id, pii_type, found_text: equal texts of one type in a record once. No shuffle."""
    found = records.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("record_id"), find_column(F.col(text_column)).alias("finds"))
    once = F.array_distinct(F.transform("finds", lambda f: F.struct(f["kind"].alias("pii_type"), f["text"].alias("found_text"))))
    return found.select("record_id", F.inline(once))


def redacted(records: DataFrame, id_column: str = "id", text_column: str = "raw_text") -> DataFrame:
    """record_id, text with every find replaced by its kind in square brackets, n_replaced."""
    found = records.select(F.col(id_column).alias("record_id"), F.col(text_column).alias("raw"), find_column(F.col(text_column)).alias("finds"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    joined = F.aggregate(
        "finds",
        start,
        lambda acc, f: F.struct(F.concat(acc["text"], F.substr(F.col("raw"), acc["at"] + 1, f["start"] - acc["at"]), F.lit("["), f["kind"], F.lit("]")).alias("text"), f["end"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substr(F.col("raw"), acc["at"] + 1)),
    )
    return found.select("record_id", joined.alias("text"), F.coalesce(F.size("finds"), F.lit(0)).alias("n_replaced"))
