"""The English stemmer of the Snowball family (Porter2) as column expressions, for distinct words of an index.

A word goes through the steps as a struct of its present form and the places where its regions R1 and R2 begin, which never
move, as only endings change. bind() names a value, so that the expression grows with the steps and not with their
products.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm: words with stems of their own, words that stay, prefixes that end before R1, and the
# endings of steps 2 to 4.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURALS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
PREFIXES = "gener|commun|arsen"
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

V, C = "[aeiouy]", "[^aeiouy]"
#: A short syllable at the end of a form.
SHORT = rf"(?:^{V}{C}|{C}{V}[^aeiouywxY])$"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without(form: Column, n: int, more: str = "") -> Column:
    cut = F.substring(form, F.lit(1), F.length(form) - n)
    return F.concat(cut, F.lit(more)) if more else cut


def first_of(form: Column, endings: list[str], then: Callable[[str], Column]) -> Column:
    """then(the longest ending that form has), or form."""
    out: Column | None = None
    for e in sorted(endings, key=len, reverse=True):
        out = F.when(form.endswith(e), then(e)) if out is None else out.when(form.endswith(e), then(e))
    return out.otherwise(form)


def begins(form: Column, region: Column, ending: str) -> Column:
    """Whether the ending lies within a region."""
    return F.length(form) - len(ending) >= region


def plurals(w: Column) -> Column:
    """Steps 0 and 1a."""
    w = F.regexp_replace(w, "(?:'s'|'s|')$", "")
    return bind(w, lambda x: (
        F.when(x.endswith("sses"), without(x, 2))
        .when(x.rlike("(?:ied|ies)$"), F.when(F.length(x) > 4, without(x, 2)).otherwise(without(x, 1)))
        .when(x.rlike("(?:us|ss)$"), x)
        .when(x.rlike(f"{V}.+s$"), without(x, 1)).otherwise(x)
    ))


def mended(x: Column, r1: Column) -> Column:
    """What follows when step 1b has dropped an ending."""
    return (
        F.when(x.rlike("(?:at|bl|iz)$"), F.concat(x, F.lit("e")))
        .when(x.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), without(x, 1))
        .when(x.rlike(SHORT) & (F.length(x) <= r1), F.concat(x, F.lit("e"))).otherwise(x)
    )


def past(x: Column, r1: Column) -> Column:
    """Step 1b."""

    def dropped(e: str) -> Column:
        if e.startswith("eed"):
            return F.when(begins(x, r1, e), without(x, len(e), "ee")).otherwise(x)
        return F.when(without(x, len(e)).rlike(V), bind(without(x, len(e)), lambda y: mended(y, r1))).otherwise(x)

    return first_of(x, ["eed", "eedly", "ed", "edly", "ing", "ingly"], dropped)


def derived(x: Column, r1: Column) -> Column:
    """Step 2."""

    def dropped(e: str) -> Column:
        fits = begins(x, r1, e)
        if e == "ogi":
            fits &= x.endswith("logi")
        if e == "li":
            fits &= x.rlike("[cdeghkmnrt]li$")
        return F.when(fits, without(x, len(e), STEP_2[e])).otherwise(x)

    return first_of(x, list(STEP_2), dropped)


def adjectives(x: Column, r1: Column, r2: Column) -> Column:
    """Step 3."""
    fits = lambda e: begins(x, r1, e) & (begins(x, r2, e) if e == "ative" else F.lit(True))
    return first_of(x, list(STEP_3), lambda e: F.when(fits(e), without(x, len(e), STEP_3[e])).otherwise(x))


def endings(x: Column, r2: Column) -> Column:
    """Step 4."""
    fits = lambda e: begins(x, r2, e) & (x.rlike("[st]ion$") if e == "ion" else F.lit(True))
    return first_of(x, STEP_4, lambda e: F.when(fits(e), without(x, len(e))).otherwise(x))


def last_letter(x: Column, r1: Column, r2: Column) -> Column:
    """Step 5."""
    short = without(x, 1).rlike(SHORT)
    return (
        F.when(x.endswith("e") & (begins(x, r2, "e") | (begins(x, r1, "e") & ~short)), without(x, 1))
        .when(x.endswith("ll") & begins(x, r2, "l"), without(x, 1)).otherwise(x)
    )


def marked(word: Column) -> Column:
    """Without a first apostrophe, and with Y where y is no vowel."""
    w = F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y")
    # a y that has become one isn't a vowel for the next: pairs of y alternate
    return F.regexp_replace(w, "(?<=[aeiou])y|(?<=(?<![aeiouyY])y)y|(?<=Yy)y", "Y")


def region(w: Column, begin: Column | None = None) -> Column:
    """Signs before the first place behind a vowel and a non-vowel, from `begin` on."""
    rest = w if begin is None else F.substring(w, begin + 1, F.length(w))
    head = F.length(F.regexp_extract(rest, f"^.*?{V}{C}", 0))
    n = F.when(head > 0, head).otherwise(F.length(rest))
    return n if begin is None else begin + n


def stemmed(word: Column) -> Column:
    """Steps 1 to 5 for a word of three letters or more that is no exception."""

    def regions(w: Column) -> Column:
        prefix = F.length(F.regexp_extract(w, f"^(?:{PREFIXES})", 0))
        r1 = F.when(prefix > 0, prefix).otherwise(region(w))
        return bind(F.struct(w.alias("w"), r1.alias("r1")), lambda s: F.struct(s["w"].alias("w"), s["r1"].alias("r1"), region(s["w"], s["r1"]).alias("r2")))

    def steps(s: Column) -> Column:
        r1, r2 = s["r1"], s["r2"]
        later = lambda x: bind(past(x, r1), lambda a: (
            bind(F.regexp_replace(a, f"(?<=.{C})[yY]$", "i"), lambda b: bind(derived(b, r1), lambda c: (
                bind(adjectives(c, r1, r2), lambda d: bind(endings(d, r2), lambda e: last_letter(e, r1, r2)))
            )))
        ))
        return bind(plurals(s["w"]), lambda x: F.when(x.isin(AFTER_PLURALS), x).otherwise(later(x)))

    return F.regexp_replace(bind(bind(marked(word), regions), steps), "Y", "y")


def english_stem(word: Column) -> Column:
    """The stem of a word in lower case. Words with other letters than a to z and ' stay as they are, as do those of one or two."""
    whole = F.create_map(*(F.lit(x) for pair in WHOLE.items() for x in pair))
    plain = word.rlike("^[a-z'][a-z']{2,}$")
    return F.when(word.isin(list(WHOLE)), F.element_at(whole, word)).when(plain, stemmed(word)).otherwise(word)
