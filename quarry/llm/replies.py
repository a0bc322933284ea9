"""What counts as visible text, as a real reply and as the same question: shared by problems 1 and 7."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that show nothing although they are no white space to a regular expression's \s.
INVISIBLE = "\\u200b\\u200c\\u200d\\u2060\\ufeff\\u00ad\\u00a0\\u180e"
# Bare stand-ins for a text, compared in lower case and without the punctuation around them.
STAND_INS = (
    "null nil none nan na n/a undefined empty missing blank tbd todo pending unknown|"
    "no answer|none recorded|not recorded|no reply|no response|not answered|no answer recorded|no answer given|"
    "answer missing|not available|nothing recorded|no content|no text|no output|keine antwort|sin respuesta|pas de réponse|aucune réponse"
)
# How a recorded failure of the model begins (whole reply at most FAILURE_CHARS long).
FAILURES = (
    r"^[\[(<{*_\s]*(error|fatal|exception|fehler|erreur|traceback|failure|failed|internal server error|"
    r"http(/\d\.\d)?[ :]+[45]\d\d|[45]\d\d (error|bad|service|gateway|internal|too many)|status[ :]+[45]\d\d|"
    r"connection (refused|reset|closed|aborted|timed out|error|lost)|connect(ion)? (to|with) the (model|server)|"
    r"timed? ?out|request (to the model )?(timed out|failed|aborted)|(the )?model (is )?(unreachable|unavailable|not (found|reachable|available)|crashed|timed out|overloaded|server)|"
    r"(embedding|model|server|backend|upstream) (error|failure|failed|unreachable|unavailable|timeout)|"
    r"(generation|inference|request|stream) (failed|aborted|interrupted|cancelled|canceled|timed out)|"
    r"out of memory|rate limit|socket hang up|econnrefused|econnreset|etimedout|broken pipe)"
)
FAILURE_CHARS = 160


def visible(text: Column) -> Column:
    """The text without invisible characters and outer white space; null stays null."""
    return F.regexp_replace(F.regexp_replace(text, f"[{INVISIBLE}]+", " "), r"^\s+|\s+$", "")


def has_text(text: Column) -> Column:
    """True if something shows; false for null."""
    return F.coalesce(F.length(visible(text)) > 0, F.lit(False))


def real_reply(answer: Column) -> Column:
    """False for null, blank, punctuation only, a bare stand-in or a recorded failure of the model; else true."""
    seen = visible(answer)
    bare = F.lower(F.regexp_replace(seen, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    single, *phrases = STAND_INS.split("|")
    words = [*single.split(), *phrases]
    failure = (F.length(seen) <= FAILURE_CHARS) & F.lower(seen).rlike(FAILURES)
    return F.coalesce((F.length(bare) > 0) & ~bare.isin(sorted(set(words))) & ~failure, F.lit(False))


def question_key(question: Column) -> Column:
    """The question up to white space: equal keys mean the same question."""
    return F.regexp_replace(F.coalesce(question, F.lit("")), f"[\\s{INVISIBLE}]+", "")


def instant(asked_at: Column) -> Column:
    """Seconds since 1970 (UTC) of the notations in use; null if it is none of them.

    Understood: date and time separated by white space or T, with - / or . in the date, any fraction, Z or an
    offset; and bare epoch seconds or milliseconds.
    """
    s = F.trim(asked_at)
    m = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[T\s]+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,]\d+)?\s*(Z|z|UTC|GMT)?([+-]\d{2}:?\d{2})?$"
    g = lambda k: F.regexp_extract(s, m, k)
    date = F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0"))
    days = F.datediff(F.try_to_date(date, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))), F.lit("1970-01-01").cast("date"))
    num = lambda k: F.coalesce(F.expr("cast(null as int)"), g(k).try_cast("int"), F.lit(0))
    zone = F.regexp_replace(g(8), ":", "")
    offset = F.when(zone == "", 0).otherwise(
        F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
        * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60)
    )
    parsed = days.cast("long") * 86400 + num(4) * 3600 + num(5) * 60 + num(6) - offset
    epoch = s.try_cast("long")
    return F.when(s.rlike(r"^\d{9,11}$"), epoch).when(s.rlike(r"^\d{12,14}$"), F.floor(epoch / 1000)).when(s.rlike(m), parsed)
