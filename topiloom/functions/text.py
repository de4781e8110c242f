"""Text expressions: everything here is a Column, none of it Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topiloom.functions.lists import BLACKLIST, DOMAINS, STOP_WORDS

TOKEN = r"[\p{L}\p{N}_]{2,}"


def _words(names) -> Column:
    return F.array(*(F.lit(w) for w in names))


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def with_bigrams(words: Column) -> Column:
    """The words, then each pair of neighbours."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def cleaned(text: Column, blank: bool = True) -> Column:
    """Lower case; all but a-z and white space becomes a blank, or vanishes."""
    return F.regexp_replace(F.lower(text), r"[^a-z\s]", " " if blank else "")


def content_words(text: Column, least: int = 3) -> Column:
    """White-space words of :func:`cleaned` text that are long enough and no stop words."""
    words = F.split(F.trim(F.regexp_replace(cleaned(text), r"\s+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def blacklisted(keywords: Column) -> Column:
    return F.lower(keywords).rlike("|".join(f"(?:{p})" for p in BLACKLIST))


def domain_count(keywords: Column, match: str = "substring") -> Column:
    """How many domains have a seed word in ``keywords``: as a substring, or as a whole token."""
    text = F.lower(keywords)
    padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    total = F.lit(0)
    for seeds in DOMAINS.values():
        if match == "token":
            hit = F.exists(_words(f" {s} " for s in seeds), lambda s: F.contains(padded, s))
        else:
            hit = F.exists(_words(seeds), lambda s: F.contains(text, s))
        total = total + hit.cast("int")
    return total


def parsed_judgement(reply: Column) -> Column:
    """A judge's free-form reply as a struct (name, grade, action, reason, grade_raw, failed).

    Code fences are stripped; if the whole is no JSON object, the widest {...} in it is
    tried.  A grade that is not one letter A-D becomes B; its raw value is kept.
    """
    schema = "name_zh string, grade string, action string, reason string"
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    valid = lambda t: F.get_json_object(t, "$").isNotNull() & t.startswith("{")
    body = F.when(valid(text), text).when((inner != "") & valid(inner), inner)
    parsed = F.from_json(body, schema)
    raw = parsed["grade"]
    return F.struct(
        F.coalesce(parsed["name_zh"], F.lit("")).alias("name"),
        F.when(raw.rlike("^[ABCD]$"), raw).otherwise("B").alias("grade"),
        F.coalesce(parsed["action"], F.lit("keep")).alias("action"),
        F.coalesce(parsed["reason"], F.lit("")).alias("reason"),
        F.when(~F.coalesce(raw.rlike("^[ABCD]$"), F.lit(False)), raw).alias("grade_raw"),
        body.isNull().alias("failed"),
    )
