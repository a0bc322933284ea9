"""Problem 7: broken prompt and response pairs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.common import stage_of
from quarry.llm.minhash import WORDS, classes
from quarry.llm.replies import has_text, real_reply

# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to is it that this for with are be by not you which from or an at as was has have does do what where who how why could would can there here its they will been but only no yes i we my your me about any other when if their into in two because than then so explain question answer",
    "de": "der die das und ist nicht ein eine einer eines einem einen mit auf für von zu den dem des im wird werden wurde sich als auch bei aus nach wie was welche welcher wo warum wer wenn oder aber kann können nur hier sie er es ich diese dieser dieses sind hat haben zum zur durch um siehe damit weil später einmal gibt keine kein leider dass manche zwischen rufen steht wir",
    "fr": "le la les un une des du de et est dans pour que qui ne pas par sur avec ce cette ces il elle sont au aux en se sa son ses leur ou où plus être a été l d qu n s c quand aucune aucun fois fait comme mais nous vous je tu dont voir donc deux rien entre quel quelle quels pourquoi existe soit déjà même ensuite après",
    "es": "el la los las un una unos unas de del y es en que no por para con se su sus al lo como más pero este esta estos estas son está qué quién dónde cuándo por porque cuando hay cada ya sin sobre entre si ni o muy también fue ser puede pueden después antes nada dos veces véase mi te le algunas alguna qué relación",
}
# Names of those languages, as questions use them.
LANGUAGE_NAMES = {
    "en": "english|englisch|englischer|anglais|inglés|ingles",
    "de": "german|deutsch|deutscher|deutsche|allemand|alemán|aleman",
    "fr": "french|französisch|franzosisch|français|francais|francés|frances",
    "es": "spanish|spanisch|spanischer|espagnol|español|espanol|castellano",
}
# Wordings that decline, by language; matched on the masked opening in lower case.
DECLINES = (
    r"\b(i|we)( am|'m| are|'re)? (must|have to|need to|will have to)? ?(respectfully |politely )?(decline|refuse)\b",
    r"\b(i|we)( am|'m| are|'re) (sorry|afraid|unable|not able|not allowed|not permitted|not authori[sz]ed|not comfortable|not in a position)\b(?!.{0,20}\bconfus)",
    r"\b(as an (ai|assistant)|as a language model)\b",
    r"\b(i|we) (can ?not|can't|could not|couldn't|won't|will not|would not|may not|must not|do not want to|don't want to) (help|assist|answer|discuss|comply|provide|share|describe|explain|talk|comment|continue with|do that|do this|go into|look into|respond|disclose|reveal|support|give|offer|engage)\b",
    r"\b(i|we)('d| would)? rather not\b", r"\bprefer not to\b", r"\bnot (feel )?comfortable\b", r"\bdon't feel comfortable\b",
    r"\b(request|access|permission) (is |was |has been )?(denied|refused|declined|rejected)\b",
    r"\b(my|our|the) (guidelines|policy|policies|instructions|rules|role) (do not|does not|don't|doesn't|forbid|prohibit|prevent|permit|allow|cover|exclude)",
    r"\boutside (of )?(what|the scope of what|my) ", r"\bbeyond (what i|my) ", r"\boff[- ]limits\b", r"\bno comment\b",
    r"\b(isn't|is not) something i (can|could|am able|will)\b", r"\bnot something i (can|could|will|am)\b",
    r"\bi( will|'ll) have to pass\b", r"\blet's (talk|speak) about something else\b", r"\blet's change the (topic|subject)\b",
    r"\bapologies,? (but )?(this|that|i|we)\b", r"\b(is|are) not permitted\b.{0,40}$", r"\bi('m| am) going to (pass|decline|skip)\b", r"\bi (have|need) to stay on the safe side\b",
    r"\b(ich|wir) (muss|müssen|möchte|möchten|kann|können|darf|dürfen|werde|will)\b.{0,60}\b(ablehnen|verweigern|nicht (helfen|beantworten|antworten|beschreiben|erklären|geben|besprechen|weiterhelfen|unterstützen|dienen|äußern)|keine auskunft|leider nicht)\b",
    r"\b(darf|kann|können|werde|dürfen) (ich|wir) (\w+ ){0,4}(leider )?(nicht|keine|ablehnen)\b", r"\b(tut mir leid|bedaure|bedauere)\b", r"\bals (ki|assistent)\b", r"\bdazu (sage|gebe) ich\b", r"\b(ich|wir) lehnen? (es |das |dies )?(\w+ )?ab\b",
    r"\bje (dois|ne peux|ne suis|refuse|ne souhaite|préfère|ne veux|regrette|suis désolée?|suis dans l'impossibilité)\b", r"\bil m'est (impossible|interdit)\b", r"\bdésolée?,", r"\bje (décline|m'abstiens)\b", r"\bnous ne pouvons pas (vous|répondre|aider)\b", r"\ben tant qu'assistant\b",
    r"\b(lo siento|lo lamento|me temo)\b", r"\b(debo|tengo que|me veo obligado a) (negarme|rechazar|declinar|rehusar)\b", r"\bno me (está permitido|es posible|permiten)\b", r"\bno (puedo|podemos|debo|quiero) (ayudar|responder|contestar|describir|hablar|asistir|ofrecer|dar|explicar|proporcionar)", r"\b(me niego|prefiero no|rechazo)\b", r"\bcomo asistente\b",
)
# A sentence that only leads up to the reply.
LEAD_INS = r"^(hmm+|well|okay|ok|sure|thanks?( you)?( for (asking|the question|your question))?|thanks for asking|good question|great question|you want to know about .*|you asked about .*|danke.*|merci.*|gracias.*|vielen dank.*|tja|hum|bueno|bien|alors|i see|i understand.*|let me see|let me think)[.!,…]*$"
# Words that introduce a repeated question.
FRAME = set("you asked question answer q a the your was is frage antwort sie fragten du fragtest vous avez demandé question réponse pregunta respuesta usted preguntó preguntaste original prompt user assistant reply response".split())
# Words after which no sentence ends.
DANGLING = set("the a an of and or to for with that which because is are was in on at by from as its der die das und oder mit von zu weil damit dass ein eine le la les de du des et ou que qui pour par dans el los las y o en que por para con un una".split())

_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_COMMON = frozenset().union(*_SETS.values())
_NAMES = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in LANGUAGE_NAMES.items()}
_WORD = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`?|\"[^\"\n]{0,80}\"|[\w.\-]+(?:/[\w.\-]+)+(?::\d+(?:-\d+)?)?", re.S)
_MASK = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|[\w.\-]+(?:/[\w.\-]+)+(?::\d+(?:-\d+)?)?", re.S)
_DECLINES = re.compile("|".join(DECLINES))
_LEAD = re.compile(LEAD_INS, re.I)
_PATH_END = re.compile(r"(?:[\w.\-]+/)+[\w.\-]+\.\w+(?::\d+(?:-\d+)?)?$")
OPENING_SENTENCES = 1


_PACKED = {w: sum(1 << (20 * k) for k, x in enumerate(_SETS.values()) if w in x) for w in _COMMON}
_ANY_NAME = re.compile(r"\b(?:" + "|".join(LANGUAGE_NAMES.values()) + r")\b", re.I)


def language(text: str) -> str:
    """en, de, fr or es by function words outside code and quotations; '' if there are too few or it is even."""
    return _language(_CODE.sub(" ", text), text)


def _language(plain: str, text: str) -> str:
    packed, get = 0, _PACKED.get
    for w in _WORD.findall(plain.lower()):
        packed += get(w, 0)
    n = {k: packed >> (20 * i) & 0xFFFFF for i, k in enumerate(_SETS)}
    if "¿" in text or "¡" in text:
        n["es"] += 2
    if "ß" in text:
        n["de"] += 1
    first, second = sorted(n, key=lambda k: -n[k])[:2]
    return first if n[first] >= 2 and n[first] > 1.3 * n[second] else ""


def copies(question: str, answer: str) -> bool:
    """The answer's words are the question's, once or more often, with at most words that announce them."""
    q, a = (re.findall(r"\w+", t.lower()) for t in (question, answer))
    if not q or not a:
        return False
    joined, whole = " " + " ".join(a) + " ", " " + " ".join(q) + " "
    if whole in joined:
        rest = joined.replace(whole, " ").replace(whole, " ").split()
    else:
        have = set(q)
        if len(set(a) & have) < 0.9 * len(have) or len(a) > 2 * len(q) + 8:
            return False
        rest = [w for w in a if w not in have]
    return all(w in FRAME for w in rest) and len(rest) <= 6


def truncated(answer: str) -> bool:
    """The reply stops inside a sentence, a list item, a code block or a code span."""
    a = re.sub(r"[​‌‍⁠﻿­]", "", answer).rstrip()
    if not a:
        return False
    if a.count("```") % 2:
        return True
    if a.endswith("```"):
        return False
    prose = re.sub(r"```.*?```", "", a, flags=re.S)
    if prose.count("`") % 2:
        return True
    if a.endswith(("...", "…")):
        return True
    last = a.rsplit("\n", 1)[-1].strip()
    if re.match(r"(?:[-*+•]|\d+[.)])\s", last):
        items = [x.strip() for x in a.split("\n") if re.match(r"\s*(?:[-*+•]|\d+[.)])\s", x)]
        end = re.findall(r"\w+", last)
        if last[-1] in ".!?":
            return False
        if not end or end[-1].lower() in DANGLING or last[-1] in ",:;(":
            return True
        before = {tuple(re.findall(r"\w+", x)[-1:]) for x in items[:-1]}
        counts = {len(x.split()) for x in items[:-1]}
        return len(items) > 1 and len(before) == 1 and (end[-1],) not in before and len(counts) == 1 and len(last.split()) < min(counts)
    if a[-1] in ".!?)]}\"'»”`*_|>":
        return a[-1] in "])" and False
    words = a.split()
    if len(words) == 1 or _PATH_END.search(a):  # a bare name, number or place is a whole reply
        return False
    if len(words) <= 3 and a[-1] not in ",:;-":
        return words[-1].lower() in DANGLING
    return True


def _split(answer: str) -> list[str]:
    """The sentences and lines of a reply, with code and places masked."""
    text = _MASK.sub(" X ", re.sub(r"[​⁠﻿]", "", answer)).replace("’", "'")
    return re.split(r"(?<=[.!?…;:])\s+|\n+", text.strip())


def _said(sentence: str) -> list[str]:
    return re.findall(r"[^\W\d]+(?:'[^\W\d]+)?|\d+", sentence.lower())


def opening(parts: list[str]) -> list[str]:
    """Words of the first of a reply's sentences after any lead-in; lower case."""
    kept: list[str] = []
    for s in parts:
        if kept or not _LEAD.match(s.strip()):
            kept.append(s)
        if len(kept) == OPENING_SENTENCES:
            break
    return _said(" ".join(kept))


def statements(parts: list[str], cut: bool) -> list[str]:
    """The distinct complete sentences of WORDS words or more anywhere in the reply; of a cut reply not the last."""
    said = [_said(s) for s in parts]
    return sorted({" ".join(w) for w in (said[:-1] if cut else said) if len(w) >= WORDS})


def declines(words: str) -> bool:
    """The wording declines, by the list."""
    return _DECLINES.search(words) is not None


def _content(text: str) -> set[str]:
    return {w for w in _WORD.findall(text.lower()) if len(w) > 2 and w not in _COMMON}


def grounded(question: str, answer: str, citations: str) -> bool:
    """The whole answer shares a word, function words aside, with its own question or with the paths it cites."""
    cited = " ".join(re.findall(r'file_path"\s*:\s*"([^"]*)', citations))
    return not _content(answer).isdisjoint(_content(question) | _content(cited))


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for i, q, a, c, real in zip(f.id, f.question, f.answer, f.citations, f.real):
            if not real:
                rows.append((i, False, False, False, False, False, [], "", False, False))
                continue
            q, a = q or "", a or ""
            plain = _CODE.sub(" ", q)
            ql, al = _language(plain, q), language(a)
            asked = {k for k, p in _NAMES.items() if p.search(plain)} if _ANY_NAME.search(plain) else ()
            rows.append((
                i, True, copies(q, a), cut := truncated(a), bool(ql and al and ql != al and al not in asked), declines(" ".join(opening(parts := _split(a)))),
                statements(parts, cut), re.sub(r"\s+", " ", q).strip().lower(), grounded(q, a, c or ""), _PLACE.search(a) is not None,
            ))
        yield pd.DataFrame(rows, columns=["id", "real", "copy", "cut", "other", "says", "said", "prompt", "grounded", "places"])


_PLACE = re.compile(r"[\w.\-]+(?:/[\w.\-]+)+:\d")


def _worded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"id": f.id, "words": [x.split(" ") for x in f.sentence], "says": [float(declines(x)) for x in f.sentence]})


FEATURES = "id long, real boolean, copy boolean, cut boolean, other boolean, says boolean, said array<string>, prompt string, grounded boolean, places boolean"
#: A class of sentences recurs if this many different prompts share it.
RECURRING_PROMPTS = 2
#: Without the word list a class needs this share of prompts whose whole reply is ungrounded, and so many of them that
#: chance would bring at most this number of such classes in the corpus.
UNGROUNDED, CHANCE = 0.75, 0.05


def defects(turns: DataFrame) -> DataFrame:
    """Each turn with its one defect: (turn_id, defect); rows without a defect give none.

    All sentences of the replies are classed by verified MinHash (five words, 0.8) and judged as classes over the
    different whole prompts they answer. A class is a refusal template if it recurs and most of it declines by the
    word list, or if the replies that hold it have nothing to do with their own questions and citations far more often
    than the other replies of the corpus do. A reply with a sentence of a template is a refusal; so is one whose
    opening declines by its own wording. A sentence of an answer also stands in replies that name what was asked, so
    that recurrence alone makes no template; sentences under five words ('Only in tests.') are not classed. A
    reply that names a line of a file is no refusal. Repeated rows are judged each for itself. Null ids are kept
    out; a null answer is `empty`; a null question has no language and nothing to copy.
    """
    stage = stage_of(turns, "pairs")
    t = turns.select("id", "question", "answer", F.col("citations").cast("string").alias("citations")).where("id is not null")
    t = t.withColumn("real", real_reply(F.col("answer")))
    every = stage.write(t.mapInPandas(_features, FEATURES), "features")
    features = every.where("real")
    empty = every.where("not real").select(F.col("id").alias("turn_id"), F.lit("empty").alias("defect"))
    members = features.select("id", F.explode("said").alias("sentence"), F.xxhash64("prompt").alias("prompt"), "grounded", "places")
    loose_one = (~F.col("grounded")).cast("long")
    uses = stage.write(
        members.groupBy("sentence", "prompt").agg(F.count("*").alias("n"), F.sum(F.col("places").cast("double")).alias("places"), F.sum(loose_one).alias("loose"), F.min(loose_one).alias("unrelated"))
        .withColumn("id", F.xxhash64("sentence")),
        "uses",
    )
    groups = stage.write(uses.select("id", "sentence").distinct().mapInPandas(_worded, "id long, words array<string>, says double"), "groups")
    labelled = stage.write(groups.select("id", "says").join(classes(groups.select("id", "words"), stage), "id"), "classes")
    n, loose = features.agg(F.count("*"), F.coalesce(F.sum(loose_one), F.lit(0))).first()
    judged = stage.write(
        uses.join(labelled, "id")
        .groupBy("class_id", "prompt")
        .agg(F.sum("n").alias("n"), F.sum(F.col("says") * F.col("n")).alias("says"), F.sum("places").alias("places"), F.sum("loose").alias("loose"), F.min("unrelated").alias("unrelated"))
        .groupBy("class_id")
        .agg(
            F.count("*").alias("prompts"), (F.sum("says") / F.sum("n")).alias("declines"), (F.sum("places") / F.sum("n")).alias("places"),
            F.avg("unrelated").alias("unrelated"), F.sum("n").alias("n"), F.sum("loose").alias("loose"),
        )
        .where(F.col("prompts") >= RECURRING_PROMPTS),
        "judged",
    )
    # Chernoff's bound on the chance of so many ungrounded prompts at the rate of all other replies
    rate = (F.greatest(loose - F.col("loose"), F.lit(0)) + 1) / (F.greatest(n - F.col("n"), F.lit(0)) + 2)
    share = F.col("unrelated")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    surprise = F.when(share > F.greatest(rate, F.lit(UNGROUNDED)), F.col("prompts") * (share * F.log(share / rate) + rest)).otherwise(0.0)
    needed = math.log(max(1, judged.count()) / CHANCE)
    templates = judged.where(((F.col("declines") >= 0.5) | (surprise >= needed)) & (F.col("places") < 0.5)).select("class_id")
    refusing_ids = labelled.join(templates, "class_id", "left_semi").select(F.col("id").alias("key"))
    held = members.select("id", F.xxhash64("sentence").alias("key")).join(refusing_ids, "key", "left_semi").select("id").distinct().withColumn("template", F.lit(True))
    refusing = F.coalesce("template", F.lit(False)) | F.col("says")
    out = (
        features.join(held, "id", "left")
        .select(
            F.col("id").alias("turn_id"),
            F.when(F.col("copy"), "copies_question")
            .when(refusing & ~F.col("places"), "refusal")
            .when(F.col("other"), "wrong_language")
            .when(F.col("cut"), "truncated").alias("defect"),
        )
        .where("defect is not null")
    )
    return empty.unionByName(out)
