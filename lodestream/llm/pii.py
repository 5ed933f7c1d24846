"""Personal data: base patterns, and high-recall candidates ranked by gradient-boosted trees.

Everything on the main path is a DataFrame expression: places of matches come from the lengths of
what stands between them, checks and features are column expressions, and the trees are nested
conditions. The trees are boosted on the driver from the features of a bounded set of generated
sentences, which the same expressions compute; half of them choose each kind's threshold, as the
least probability at which the required precision holds.

Candidates beyond the base patterns: e-mail addresses with at and dot in brackets or as words, of four
languages and in any case, IPv6 addresses, whole, compressed or with an IPv4 end, IPv4 addresses with
dots in brackets, cards with dots, slashes, low lines or wide gaps, telephone numbers without a plus
sign: in one run of digits, of two groups, three or five pairs, with 00 or (0) before. Several patterns
generate one kind, and candidates may overlap; the trees choose. Base spans always stay, and an added
one is never within one, but may reach beyond it. Spans are code points, end exclusive.

Defined results: a null or empty text has no spans; equal texts have equal spans; repeated rows are
kept; of added spans that overlap the likelier stays, then the earlier, then the first kind; a very
long text takes time that grows with its length and little more with its matches; an empty table
gives no rows; other columns are ignored (or kept, by `redact` and `find`, which replaces columns
named base and spans).
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Possessive loops keep each scan linear. A match begins where no letter of its first class stands before, or at the end of the match before.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Several generators a kind, each a scan of its own, so that candidates overlap; beside each a pattern that is true wherever it matches.
_LOCAL, _LABEL, _OWN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}", "[A-Za-z0-9-]{2,63}", r"(?<![0-9A-Za-z.+/-])"
_AT, _DOT = "(?:at|ät|arroba|arobase)", "(?:dot|punkt|punto|point)"
_GROUPS, _DONE = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}", r"(?![0-9A-Za-z/])(?![.-][0-9])"
MORE = {
    "email": (
        (rf"(?i){_LOCAL}\x20?[\[({{<]\x20?{_AT}\x20?[\])}}>]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:[\[({{<]\x20?{_DOT}\x20?[\])}}>]|\.)\x20?{_LABEL}){{1,4}}", rf"(?i)[\[({{<]\x20?{_AT}\x20?[\])}}>]"),
        (rf"(?i){_LOCAL}\x20{_AT}\x20[A-Za-z0-9-]{{1,63}}(?:(?:\x20{_DOT}\x20|\.){_LABEL}){{1,4}}", rf"(?i)\x20{_AT}\x20[A-Za-z0-9-]{{1,63}}(?:\x20{_DOT}\x20|\.)[A-Za-z0-9-]"),
        (rf"(?i){_LOCAL}@[A-Za-z0-9-]{{1,63}}(?:\x20?[\[({{<]\x20?(?:{_DOT}|\.)\x20?[\])}}>]\x20?{_LABEL}){{1,4}}", rf"(?i)@[A-Za-z0-9-]{{1,63}}\x20?[\[({{<]\x20?(?:{_DOT}|\.)"),
    ),
    "ip": (
        (r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
        (rf"(?<![0-9A-Za-z:])(?:{_GROUPS}::(?:{_GROUPS})?|::{_GROUPS})(?![0-9A-Za-z:])(?!\.[0-9])", "::"),
        (r"(?<![0-9A-Za-z:])(?:::|(?:[0-9A-Fa-f]{1,4}:){1,7}:?)(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z.])", r":[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
        (r"(?i)(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[\[({]\x20?(?:\.|dot|,)\x20?[\])}]\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])", r"(?i)[0-9]\x20?[\[({]\x20?(?:\.|dot|,)\x20?[\])}]\x20?[0-9]"),
    ),
    "card": (
        (r"(?<![0-9./_])[0-9]{4}([./_]|\x20?[-\u2013]\x20|\x20{2,4}|\u00A0)[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}(?![0-9])", r"[0-9]{4}(?:[./_]|\x20?[-\u2013]\x20|\x20{2,4}|\u00A0)[0-9]{4}"),
        (r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{6}\1[0-9]{4,5}(?![0-9])", r"[0-9]{4}[./_][0-9]{6}[./_]"),
    ),
    "phone": (
        (rf"{_OWN}(?:\([0-9]{{2,4}}\)[\x20.-]?|[0-9]{{2,4}}[\x20.-])[0-9]{{3,4}}[\x20.-][0-9]{{3,4}}{_DONE}", r"[0-9]\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3}"),
        (rf"{_OWN}(?:\([0-9]{{2,5}}\)\x20?|[0-9]{{2,5}}[\x20/-])[0-9]{{5,8}}{_DONE}", r"[0-9][)\x20/-]\x20?[0-9]{5}"),
        (rf"{_OWN}[0-9]{{2}}(?:[\x20.-][0-9]{{2}}){{4}}{_DONE}(?!\x20[0-9])", r"[0-9]{2}(?:[\x20.-][0-9]{2}){4}"),
        (rf"{_OWN}(?!(?:19|20)[0-9]{{6}}(?![0-9]))[0-9]{{9,11}}{_DONE}", r"[0-9]{9}"),
        (rf"{_OWN}00[1-9](?:[0-9]{{0,2}}[\x20./-]\(?[0-9]{{1,8}}\)?(?:[\x20./-]?\(?[0-9]{{1,8}}\)?){{1,4}}|[0-9]{{8,11}}){_DONE}", "00[1-9]"),
        (rf"(?<![0-9A-Za-z])\(0\)[\x20]?[0-9]{{2,4}}[\x20./-]?[0-9]{{3,8}}(?:[\x20-][0-9]{{1,5}}){{0,2}}{_DONE}", r"\(0\)"),
    ),
}
_NONE = "array<struct<kind:int,start:int,end:int,text:string>>"
CONTEXT = 32
PRECISION, ROUNDS, RATE, EXAMPLES = 0.98, 48, 0.3, 8192


#: Matches that one step gathers; places are summed within steps, then over them.
STEP = 128


def located(text: Column, pattern: str, kind: int) -> Column:
    """All matches, leftmost and without overlap, as structs of kind, start, end, text."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("hit"))

    def one(acc, x):
        a = acc.at + F.length(x["gap"])
        b = a + F.length(x["hit"])
        return F.struct(b.alias("at"), F.concat(acc.out, F.array(F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["hit"].alias("text")))).alias("out"))

    def gathered(own):
        def some(acc, i):
            start = F.struct(acc.at.alias("at"), F.array().cast(_NONE).alias("out"))
            # The inner sum is bound to a name, as an expression would be computed again wherever it stands.
            part = F.transform(F.array(F.aggregate(F.slice(own, i * STEP + 1, STEP), start, one)), lambda p: F.struct(p.at.alias("at"), F.concat(acc.out, F.array(p.out)).alias("out")))
            return F.element_at(part, 1)

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_NONE}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), ((F.size(own) - 1) / STEP).cast("int")), start, some, lambda acc: F.flatten(acc.out))

    return F.element_at(F.transform(F.array(both), gathered), 1)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def value(i):
        d = F.substring(F.reverse(x), i, F.lit(1)).try_cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(x))
    return n.between(13, 19) & luhn(digits(x)) if kind == "card" else n.between(9, 15) if kind == "phone" else F.lit(True)


def _passes(kind, s) -> Column:
    return _valid(kind, s.text)


def base_spans(text: Column) -> Column:
    """The base patterns' spans that pass their checks, by kind and start."""
    likely = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains(text, F.lit("+"))}
    parts = []
    for i, kind in enumerate(KINDS):
        spans = F.filter(located(text, BASE[kind], i), functools.partial(_passes, kind))
        parts.append(F.when(likely[kind], spans).otherwise(F.array().cast(_NONE)))
    return F.concat(*parts)


def candidates(text: Column) -> Column:
    parts = [F.when(text.rlike(likely), located(text, pattern, i)).otherwise(F.array().cast(_NONE)) for i, k in enumerate(KINDS) for pattern, likely in MORE[k]]
    return F.concat(*parts)


# Words near personal data of each kind, and near numbers that are none.
NEAR = (
    "e?-?mails?|contact|write|reach|send|cc|schreib|ecri[rv]|escrib", "ip|hosts?|server|address|login|peer|ping|ssh|connect|gateway|dns|from|node",
    "card|visa|credit|debit|payment|master|pay|amex|charged?|billing|karte|carte|tarjeta", "phone|tel|call|mobile|fax|dial|sms|ring|text|cell|contact|hotline|reach|telefon|anruf|appel|llam|(?:my|his|her|our|your|their)\\x20number",
)
AGAINST = "order|invoice|isbn|version|build|ref|serial|total|price|sku|batch|hash|time|page|item|score|tracking|model|part|case|ticket|between|ratio|measured|license"
# Common ends of the names of hosts.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|eu|de|at|ch|fr|be|nl|es|it|pt|uk|us|ca|au|se|no|dk|fi|pl|jp"
FEATURES = ("kind", "length", "digits", "seps", "near", "against", "luhn", "opens", "groups", "zero", "gap", "dot", "bracket", "long_hex", "dates", "foreign", "parts", "sign", "ending")


def features(text: Column, s: Column) -> list[Column]:
    """What the trees see of a candidate: its form, and how far before it the last words for and against it stand (CONTEXT: none)."""
    before = F.lower(text.substr(F.greatest(s.start - CONTEXT, F.lit(0)) + 1, F.least(s.start, F.lit(CONTEXT))))
    far = lambda words: F.when(before.rlike(rf"\b(?:{words})"), F.length(F.regexp_extract(before, rf"^(?s:.*)\b(?:{words})((?s:.*))$", 1))).otherwise(CONTEXT)
    near = F.lit(CONTEXT)
    for i, words in enumerate(NEAR):
        near = F.when(s.kind == i, far(words)).otherwise(near)
    n = F.length(digits(s.text))
    return [
        s.kind, F.length(s.text), n, F.length(F.regexp_replace(s.text, "[0-9A-Za-z]", "")), near, far(AGAINST),
        F.when(n > 0, luhn(digits(s.text)).cast("int")).otherwise(0), s.text.startswith("(").cast("int"), F.size(F.split(s.text, "[^0-9A-Za-z]+")),
        digits(s.text).startswith("0").cast("int"), F.contains(s.text, F.lit("::")).cast("int"), s.text.rlike(rf"(?i)\b{_DOT}\b").cast("int"),
        s.text.rlike(rf"(?i)[\[({{<]\x20?(?:{_AT}|{_DOT}|\.|,)\x20?[\])}}>]").cast("int"), s.text.rlike("[0-9A-Fa-f]{3}:").cast("int"), s.text.rlike(r"^(?:19|20)[0-9]{2}[\x20./-]").cast("int"),
        s.text.rlike(r"(?i)^00[1-9]|^\(0\)|\x20(?:ät|arroba|arobase)\x20").cast("int"),
        # Numbers in an address beyond what one can hold.
        F.size(F.filter(F.split(s.text, "[^0-9]+"), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)) > 255)),
        F.contains(s.text, F.lit("@")).cast("int"), s.text.rlike(rf"[^a-z](?:{ENDINGS})$").cast("int"),
    ]


# What stands before a value in the generated sentences, by kind; before things that are none; and what tells nothing.
_BEFORE = (
    ("write to", "mail me:", "contact", "reach me under", "e-mail", "please send it to", "my email is", "cc", "schreib an"), ("server", "host", "ssh to", "the ip is", "login from", "connect to", "ping", "gateway", "dns"),
    ("card", "visa", "paid with credit card", "charge", "my debit card", "Karte", "billing card", "amex"), ("please call", "fax", "tel.", "phone:", "mobile", "sms to", "my number is", "dial", "Telefon", "ring me on", "hotline", "call us at"),
)
_NEVER = ("order", "invoice no.", "isbn", "version", "build", "ref", "serial", "total", "price", "sku", "batch", "page", "score", "tracking", "case", "between", "ratio", "model", "part", "ticket")
_PLAIN = ("as told", "noted", "and then", "we saw", "it said", "later")


def _examples(spark: SparkSession, n: int) -> DataFrame:
    """Generated sentences with one candidate each and whether it is personal data."""
    pick = lambda salt, *v: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in v)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(v))) + 1).cast("int"))
    part = lambda salt, low, high: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low)) + low).cast("string")
    hexa = lambda salt: F.lower(F.hex(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(60000)) + 4096))
    kind = F.pmod(F.col("id"), F.lit(4)).cast("int")
    good = F.pmod(F.xxhash64("id", F.lit("good")), F.lit(2)) == 0
    own = F.element_at(F.array(*(pick(f"own{i}", *w) for i, w in enumerate(_BEFORE))), kind + 1)
    # Before a true value mostly words that fit it, before others mostly words that don't; few of 400 fit the contrary.
    turn = F.pmod(F.xxhash64("id", F.lit("lead")), F.lit(400))
    lead = F.when(turn < 100, pick("plain", *_PLAIN)).when((turn < 102) != good, own).otherwise(pick("never", *_NEVER))
    sep = pick("sep", " ", "-", ".")
    phone = F.concat(F.when(good & (F.pmod(F.xxhash64("id", F.lit("open")), F.lit(2)) == 0), F.concat(F.lit("("), part("a", 200, 999), F.lit(") "))).otherwise(F.concat(part("a", 200, 999), sep)), part("b", 200, 999), sep, part("c", 1000, 9999))
    three = [part("p", 1000, 9999), part("q", 1000, 9999), part("r", 1000, 9999), part("s", 100, 999)]
    joined = F.concat(*three)
    check = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(joined, d.cast("string")))), True) - 1
    last = F.when(good, check).otherwise((check + 1 + F.pmod(F.xxhash64("id", F.lit("off")), F.lit(9))) % 10)
    dot = pick("dot", ".", "/", "_", " - ", "  ", "\u00a0")
    long = F.concat(three[0], three[1], three[2], three[3], last.cast("string"))
    whole = F.concat(three[0], dot, three[1], dot, three[2], dot, three[3], last.cast("string"))
    # Fifteen digits of four, six and five.
    amex = F.concat(F.substring(long, 1, 4), dot, F.substring(long, 5, 6), dot, F.substring(long, 11, 4))
    check15 = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(F.substring(long, 1, 14), d.cast("string")))), True) - 1
    amex = F.concat(amex, F.when(good, check15).otherwise((check15 + 1 + F.pmod(F.xxhash64("id", F.lit("off2")), F.lit(9))) % 10).cast("string"))
    card = F.when((F.pmod(F.xxhash64("id", F.lit("amex")), F.lit(6)) == 0) & dot.isin(".", "/", "_"), amex).otherwise(whole)
    ip = F.when(good, F.concat_ws(":", *(hexa(f"x{i}") for i in range(8)))).when(F.pmod(F.xxhash64("id", F.lit("mac")), F.lit(2)) == 0, F.concat_ws(":", *(F.lpad(F.hex(F.pmod(F.xxhash64("id", F.lit(f"m{i}")), F.lit(256))), 2, "0") for i in range(6)))).otherwise(F.concat_ws(":", *(part(f"t{i}", 10, 60) for i in range(4))))
    # Every generator has its forms, and things that look like them: half of the e-mail and address examples, two thirds of the telephone ones.
    form = F.pmod(F.xxhash64("id", F.lit("form")), F.lit(6))
    bare = F.pmod(F.xxhash64("id", F.lit("bare")), F.lit(2)) == 0
    numbered = lambda word, salt: F.concat(word, F.when(bare, F.lit("")).otherwise(part(salt, 1, 99)))
    at = F.when(form % 2 == 0, pick("at", " [at] ", "(at)", " (at) ", " [AT] ", "{at}", " <at> ", "(ät)", " [arroba] ")).otherwise(pick("at2", " at ", " at ", " AT ", " ät ", " arroba ", " at "))
    # Without a dot in words, only what stands before tells an address from prose.
    said = F.concat(numbered(pick("user", "user", "jo", "anna.k", "m_weber", "bob", "jane.doe", "k-smith", "info", "sales"), "m"), at, numbered(pick("host", "host", "example", "mailbox", "corp", "my-firm", "uni", "shop", "bank"), "h"), pick("dot2", " [dot] ", "(dot)", "{dot}", " dot ", " DOT ", ".", " punkt ", " punto "), pick("tld", "org", "net", "com", "de", "fr", "io", "co", "edu"))
    prose = F.concat(pick("verb", "look", "met", "arrived", "sold", "stay", "laugh", "work", "shout", "land"), pick("at3", " at ", " at ", " at ", " AT "), numbered(pick("place", "noon", "page", "section", "cafe", "home", "dawn", "once", "least", "work"), "h"), F.lit("."), pick("next", "Then", "html", "We", "There", "It", "He", "And", "pdf"))
    half = F.concat(numbered(pick("user", "user", "jo", "anna.k", "m_weber", "bob", "jane.doe", "k-smith", "info", "sales"), "m"), F.lit("@"), numbered(pick("host", "host", "example", "mailbox", "corp", "my-firm", "uni", "shop", "bank"), "h"), pick("dot4", "[.]", "(.)", " [dot] ", "(dot)", "{dot}"), pick("tld", "org", "net", "com", "de", "fr", "io", "co", "edu"))
    mail = F.when(good, F.when(form == 5, half).otherwise(said)).otherwise(prose)
    short = F.concat(pick("net", "2001:db8::", "fe80::", "2a02:26f7::", "fd00:12::"), F.concat_ws(":", *(F.when(F.pmod(F.xxhash64("id", F.lit("groups")), F.lit(4)) >= i, hexa(f"z{i}")) for i in range(4))))
    scope = F.concat(pick("s1", "add", "face", "a", "bed", "12", "3", "dead"), F.lit("::"), pick("s2", "bad", "cafe", "b", "30", "4", "fade"))
    octet = lambda i, good_: F.when(good_, part(f"o{i}", 1, 255)).otherwise(part(f"w{i}", 256, 999))
    four = lambda sep, good_: F.concat_ws(sep, *(octet(i, good_ | F.lit(i % 2 == 0)) for i in range(4)))
    bracketed = F.concat(*(x for i in range(4) for x in ((octet(i, good | F.lit(i % 2 == 1)),) if i == 3 else (octet(i, good | F.lit(i % 2 == 1)), pick("brk", "[.]", "(.)", "[dot]", " [.] ", "{.}")))))
    mapped = F.concat(F.when(good, pick("map", "::ffff:", "::FFFF:", "64:ff9b::", "::", "0:0:0:0:0:ffff:")).otherwise(pick("map2", "a:", "1:", "at:", "v:12:")), four(".", good))
    ip = F.when(form == 0, ip).when(form == 1, bracketed).when(form == 2, mapped).when(form % 2 == 0, ip).otherwise(F.when(good, short).otherwise(scope))
    two = F.when(good, F.concat(F.lit("0"), part("a2", 20, 9999), pick("sep2", " ", "/", "-"), part("b2", 100000, 99999999))).otherwise(F.concat(pick("nought", "", "0"), part("a3", 10, 2999), pick("sep2", " ", "/", "-"), part("b3", 10000, 99999999)))
    pairs = F.concat(F.when(good, F.concat(F.lit("0"), part("w", 1, 10))).otherwise(pick("nought2", part("w2", 10, 100), F.concat(F.lit("0"), part("w3", 1, 10)))), *(x for i in range(3, 7) for x in (pick("sep3", " ", "-"), part(f"w{i}", 10, 100))))
    # Whether a bare run of digits is a number to call only the words before it tell; a few of both stand after words that tell nothing.
    run = F.concat(pick("r0", "0", "5", "2", "06", "01"), F.substring(F.concat(three[0], three[1], part("rr", 100, 999)), 1, 9))
    after00 = F.concat(F.when(good, F.lit("00")).otherwise(pick("oo", "000", "00")), pick("cc", "1", "33", "44", "49", "34", "351"), pick("s6", " ", "-", ".", ""), part("n1", 20, 999), pick("s7", " ", "-", ""), part("n2", 1000, 99999), pick("s8", " ", ""), part("n3", 10, 99))
    zero = F.concat(F.lit("(0)"), part("z1", 20, 999), pick("s9", "-", " ", "/"), part("z2", 10000, 9999999))
    more = F.pmod(F.xxhash64("id", F.lit("more")), F.lit(8))
    spread = F.concat(part("a", 200, 999), pick("s5", " ", "-"), part("bb", 2000000, 9999999))
    phone = F.when(more == 0, run).when(more == 1, after00).when(more == 2, zero).when(more == 3, spread).when(form < 2, phone).when(form < 4, two).otherwise(pairs)
    value = F.element_at(F.array(mail, ip, card, phone), kind + 1)
    return spark.range(n).select("id", kind.alias("k"), good.cast("int").alias("y"), F.concat(F.lit("well "), lead, F.lit(" "), value, pick("after", " today", "", ".", ", thanks", "\nend")).alias("text"))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Trees of depth two for log-odds: (feature, bound, low side, high side), each side (feature, bound, value, value)."""

    def split(rows, g, h):
        best = (0.0, 0, float("inf"))
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for bound in (values[1:] + values[:-1]) / 2:
                low = rows[x[rows, f] < bound]
                gl, hl = g[low].sum(), h[low].sum()
                gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - whole
                if gain > best[0] + 1e-12:
                    best = (gain, f, float(bound))
        return best[1], best[2]

    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, bound = split(np.arange(len(y)), g, h)
        sides = []
        for rows in (np.flatnonzero(x[:, f] < bound), np.flatnonzero(x[:, f] >= bound)):
            f2, b2 = split(rows, g, h) if len(rows) else (0, float("inf"))
            leaves = []
            for own in (rows[x[rows, f2] < b2], rows[x[rows, f2] >= b2]):
                v = rate * g[own].sum() / (h[own].sum() + 1) if len(own) else 0.0
                score[own] += v
                leaves.append(round(float(v), 6))
            sides.append((f2, b2, *leaves))
        trees.append((f, bound, *sides))
    return trees


def predict(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for f, bound, *sides in trees:
        for side, own in zip(sides, (x[:, f] < bound, x[:, f] >= bound), strict=True):
            out += own * np.where(x[:, side[0]] < side[1], side[2], side[3])
    return 1 / (1 + np.exp(-out))


def fit(spark: SparkSession, examples: int = EXAMPLES) -> tuple[list[tuple], list[float], float]:
    """Trees, a threshold for each kind, and the accuracy on the half that did not train."""
    rows = _examples(spark, examples).select("id", "k", "y", "text", F.explode(candidates(F.col("text"))).alias("s"))
    rows = rows.where("s.kind = k").select("id", "y", *(f.cast("double").alias(n) for f, n in zip(features(F.col("text"), F.col("s")), FEATURES, strict=True))).orderBy("id").collect()
    x, y, odd = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[0] // 4 % 2 for r in rows]) == 1
    trees = boost(x[~odd], y[~odd])
    p, truth = predict(trees, x[odd]), y[odd]
    bounds = []
    for k in range(len(KINDS)):
        own = np.flatnonzero(x[odd][:, 0] == k)
        order = own[np.argsort(-p[own], kind="stable")]
        exact = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(exact >= PRECISION)
        bounds.append(float(max(0.5, round(p[order[good[-1]]], 4))) if len(good) else 1.1)
    return trees, bounds, float(((p >= 0.5) == (truth == 1)).mean())


_model = functools.lru_cache(maxsize=1)(lambda spark: fit(spark))


def added_spans(text: Column, base: Column, model: tuple) -> Column:
    """Candidates whose probability reaches their kind's threshold and that are within no base span, nor overlap a likelier one."""
    trees, bounds, _ = model

    def rated(s):
        f = features(text, s)
        total = F.lit(0.0)
        for i, bound, *sides in trees:
            low, high = (F.when(f[j] < b, a).otherwise(c) if b != float("inf") else F.lit(a) for j, b, a, c in sides)
            total = total + (F.when(f[i] < bound, low).otherwise(high) if bound != float("inf") else low)
        return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.text.alias("text"), (1 / (1 + F.exp(-total))).alias("p"))

    meet = lambda a, b: (a.start < b.end) & (b.start < a.end)
    within = lambda a, b: (a.start >= b.start) & (a.end <= b.end)
    least = F.array(*map(F.lit, bounds))
    sure = F.filter(F.transform(F.filter(candidates(text), lambda s: ~F.exists(base, lambda b: within(s, b))), rated), lambda s: s.p >= F.element_at(least, s.kind + 1))
    ahead = lambda a, b: (a.p > b.p) | ((a.p == b.p) & ((a.start < b.start) | ((a.start == b.start) & (a.kind < b.kind))))
    return F.filter(sure, lambda s: ~F.exists(sure, lambda o: meet(s, o) & ahead(o, s)))


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with base and spans (arrays of kind, start, end; by kind, then start)."""
    model = _model(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))))
    likely = F.lit(False)
    for pattern in (p for k in KINDS for _, p in MORE[k]):
        likely = likely | text.rlike(pattern)
    first, second = (next(n for i in range(len(df.columns) + 1) if (n := f"_{name}{i}") not in df.columns) for name in ("pii_base", "pii_more"))
    own = df.withColumn(first, base_spans(text))
    more = F.when(likely, added_spans(text, F.col(first), model)).otherwise(F.array().cast(_NONE[:-2] + ",p:double>>"))
    return own.withColumn(second, more).withColumn("spans", F.array_sort(F.concat(bare(F.col(first)), bare(F.col(second))))).withColumn("base", bare(F.col(first))).drop(first, second)


def listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(df: DataFrame) -> DataFrame:
    """df with every span of its text replaced by its kind in brackets, and n_chars, if it has one, counted again."""
    names = df.columns
    held = df.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    text = F.col("text")
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        label = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1)), F.lit("]"))
        parts = F.concat(acc.out, F.array(text.substr(acc.at + 1, s.start - acc.at), label))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, parts).otherwise(acc.out).alias("out"))

    clean = F.aggregate(order, start, step, lambda acc: F.array_join(F.concat(acc.out, F.array(text.substr(acc.at + 1, F.length(text)))), ""))
    found = find(held).withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(text))
    new = {"text": F.col("clean").cast(df.schema["text"].dataType)}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast(df.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in names))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(common.spread(common.table(spark, sf_dir, "documents")).select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s.kind == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
