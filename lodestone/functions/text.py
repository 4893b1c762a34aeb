"""Tokenizers and text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classic 33 English stop words of full-text engines.
STOP_WORDS = sorted("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: The longer English list of natural-language toolkits, that the cleaning pipeline and the keywords use.
LONG_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has "
    "had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn "
    "couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
#: Words of page navigation that the index also leaves out.
NAVIGATION_WORDS = ["back", "login", "next", "press", "skip"]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Irregular plurals; other words follow suffix rules.
IRREGULAR = {"children": "child", "feet": "foot", "geese": "goose", "men": "man", "mice": "mouse", "teeth": "tooth", "women": "woman"}
SUFFIXES = [("sses", "ss"), ("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ves", "f"), ("s", "")]


def simple_tokens(text: Column) -> Column:
    """Lower case; comma, full stop and exclamation mark as spaces; split at single spaces. '' gives ['']."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[,.!]", " ")
    return F.split(F.trim(F.regexp_replace(spaced, r"[ \t\r\n\f]+", " ")), " ")


def word_tokens(text: Column, stop: bool = True) -> Column:
    """Lower-case runs of two or more letters, digits or underscores, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if stop else found


def pipeline_tokens(text: Column) -> Column:
    """Lower case without ASCII punctuation, split at white space, without stop and navigation words."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(F.regexp_replace(plain, r"[ \t\r\n\f]+", " "), " "), lambda t: (t != "") & ~t.isin(LONG_STOP_WORDS + NAVIGATION_WORDS))


def space_tokens(text: Column) -> Column:
    """Lower case, split at white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\r\n\f]+"), lambda t: t != "")


def alpha_tokens(text: Column) -> Column:
    """Lower case without tags, tokens of letters only, without stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "<[^>]*>", " ")
    parts = F.split(F.regexp_replace(plain, r"[ \t\r\n\f]+|[!-,./:-@\[-`{-~]+", " "), " ")
    return F.filter(parts, lambda t: t.rlike(r"^\p{L}+$") & ~t.isin(LONG_STOP_WORDS))


def lemma(term: Column) -> Column:
    """A noun's base form by exceptions and suffix rules; a rule needs three letters in front."""
    out = term
    for ending, base in reversed(SUFFIXES):
        keep = F.lit(False) if ending != "s" else term.endswith("ss") | term.endswith("us") | term.endswith("is")
        out = F.when(term.endswith(ending) & (F.length(term) >= len(ending) + 3) & ~keep, F.concat(F.substring(term, F.lit(1), F.length(term) - len(ending)), F.lit(base))).otherwise(out)
    for plural, single in IRREGULAR.items():
        out = F.when(term == plural, single).otherwise(out)
    return out


def trimmed(words: Column, share: float = 0.2) -> Column:
    """The words without the first and last ``share`` of them, rounded down."""
    cut = F.floor(F.size(words) * F.lit(share)).cast("int")
    return F.slice(words, cut + 1, F.greatest(F.size(words) - 2 * cut, F.lit(0)))
